"""Periodic runs of words: branching tandem repeats read off an enhanced suffix array.

Texts of a slice are laid end to end as word numbers, a separator of its own behind each. Prefix doubling
gives the suffix array, its inverse (ISA), and, from the ranks of its rounds, the common prefixes of
neighbours (LCP). A boundary of LCP ``depth`` parts the stretch of suffixes that share ``depth`` words
into a left and a right side; for each suffix i of the smaller side, i + depth or i - depth on the other
side (looked up in ISA) is a square of that period that does not go on to the right. No tree is
built; taking the smaller side bounds the look-ups by n log n. A square is rotated to the left as long as the word
before it agrees with the word a period on; squares that end alike and lie within the run of a shorter period that
divides theirs are the same run.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6            # words of a run, at least
EXPONENT = 4         # periods of a run, at least
SLICE_WORDS = 250_000
PAIRS = 2_000_000    # look-ups at a time


def changed(words: list, doc_id) -> list:
    """The words with the tail that the contract makes periodic, for a tenth of the documents by their id."""
    h = zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, LCP of each suffix and the one before it) of numbers that end in one
    which occurs nowhere else.

    Ranks of 1, 2, 4 ... words; only suffixes that still share their rank are sorted again. A rank is the first
    place of its group, so ranks of later rounds refine earlier ones.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    start = np.r_[True, text[order][1:] != text[order][:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, width, array = [rank.astype(np.int32)], 1, order
    open_ = np.flatnonzero(~(start & np.r_[start[1:], True]))     # places of suffixes in groups of two and more
    while len(open_):
        suffix = array[open_]
        follow = suffix + width
        key = rank[suffix] * (n + 1) + np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        array[open_] = suffix
        start = np.r_[True, key[1:] != key[:-1]]
        group = open_[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
        rank[suffix] = group
        levels.append(rank.astype(np.int32))
        open_ = open_[~(start & np.r_[start[1:], True])]
        width *= 2
    # Common prefixes from the longest ranks down; neighbours with different words have none.
    lcp = np.zeros(n, np.int64)
    at = 1 + np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]])
    left, right = array[at - 1].copy(), array[at].copy()
    common = np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][np.minimum(left, n - 1)] == levels[level][np.minimum(right, n - 1)]
        same &= (left < n) & (right < n)
        step = same * (1 << level)
        common += step
        left += step
        right += step
    lcp[at] = common
    return array, rank, lcp


def sides(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each boundary with a common prefix (itself), the first place of its left and the last of its right side.

    To the left up to a smaller LCP, to the right up to one that is not greater, so that of equal
    neighbours each parts one sibling from those before it.
    """
    places = np.flatnonzero(lcp > 0)
    lo, hi = [0] * len(places), [0] * len(places)
    stack: list[tuple[int, int]] = []      # (lcp, number) with LCPs that rise
    before = -2
    for number, (place, depth) in enumerate(zip(places.tolist(), lcp[places].tolist())):
        if place != before + 1:            # a boundary without a common prefix lies between
            for _, at in stack:
                hi[at] = before
            stack = []
            base = place - 1
        else:
            base = -1
        while stack and stack[-1][0] >= depth:
            gone, at = stack.pop()
            hi[at] = place - 1
            # An equal one passes on how far left it reaches, a greater one too: all between share enough.
            base = lo[at]
        if base < 0:
            base = place - 1
        lo[number] = base
        stack.append((depth, number))
        before = place
    for _, at in stack:
        hi[at] = before
    return places, np.array(lo, np.int64), np.array(hi, np.int64)


def squares(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that do not go on to the right, and may be part of a run."""
    array, rank, lcp = suffix_array(text)
    place, lo, hi = sides(lcp)
    depth = lcp[place]
    left = place - lo <= hi - place + 1
    small_lo, small_hi = np.where(left, lo, place), np.where(left, place - 1, hi)
    other_lo, other_hi = np.where(left, place, lo), np.where(left, hi, place - 1)
    size = small_hi - small_lo + 1
    bounds, starts, periods, n = np.cumsum(size), [], [], len(text)
    at = 0
    while at < len(place):
        end = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + PAIRS, "right")))
        some = slice(at, end)
        owner = np.repeat(np.arange(at, end), size[some])
        inside = np.arange(len(owner)) - np.repeat(bounds[some] - size[some] - (bounds[at - 1] if at else 0), size[some])
        suffix = array[small_lo[owner] + inside]
        period = depth[owner]
        for sign in (1, -1):
            partner = suffix + sign * period
            whole = (partner >= 0) & (partner < n)
            where = rank[np.where(whole, partner, 0)]
            whole &= (where >= other_lo[owner]) & (where <= other_hi[owner])
            found = np.flatnonzero(whole)
            start, q = np.minimum(suffix[found], partner[found]), period[found]
            # A run holds at least two more periods to the left of its last square.
            for times in (0, 1, EXPONENT - 2):
                far = start - (q * times if times else 1)
                kept = far >= 0
                kept[kept] = text[far[kept]] == text[far[kept] + q[kept]]
                start, q = start[kept], q[kept]
            starts.append(start), periods.append(q)
        at = end
    return np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(periods) if periods else np.zeros(0, np.int64)


def _rotated(text: np.ndarray, start: int, period: int) -> int:
    """Where the run begins whose last square starts here."""
    block = 16
    while start:
        lo = max(0, start - block)
        differ = np.flatnonzero(text[lo:start] != text[lo + period:start + period])
        if len(differ):
            return lo + int(differ[-1]) + 1
        start, block = lo, block * 2
    return 0


def runs(text: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    start, period = squares(text)
    end = start + 2 * period
    out, at, begins, last = [], [], [], -1
    for k in np.lexsort((period, end)):
        s, q, e = int(start[k]), int(period[k]), int(end[k])
        if e != last:
            begins, last = [], e
        if any(q % p == 0 and s >= b for b, p in begins):
            continue
        b = _rotated(text, s, q)
        begins.append((b, q))
        if e - b >= max(LEAST, EXPONENT * q):
            out.append((b, e - b, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


class Numbers(dict):
    """Numbers of different words in the order they are met."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def runs_of(documents: list[list]) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words, found over all of them together; no run leaves its list."""
    number = Numbers()
    parts = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in documents]
    if not any(map(len, parts)):
        return [[] for _ in documents]
    sizes = np.array([len(p) for p in parts])
    bounds = np.r_[0, np.cumsum(sizes + 1)]
    text = np.empty(int(bounds[-1]), np.int64)
    # Words of different lists are different numbers: no suffix is compared across lists.
    words = len(number)
    for i, part in enumerate(parts):
        text[bounds[i]:bounds[i + 1] - 1] = part + i * words
        text[bounds[i + 1] - 1] = len(parts) * words + i
    out: list[list] = [[] for _ in documents]
    for s, n, q in runs(text):
        doc = int(np.searchsorted(bounds, s, "right")) - 1
        out[doc].append((s - int(bounds[doc]), n, q))
    return out


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        gone[s + q] += 1
        gone[s + n] -= 1
    return list(itertools.compress(words, (np.cumsum(gone[:-1]) == 0).tolist()))


def split(text: str | None) -> list[bytes]:
    """Words as they stand, between space and the ASCII controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def slices(batches, planted: bool):
    """Groups of documents of about ``SLICE_WORDS`` words: ids and words."""
    ids, held, total = [], [], 0
    for frame in batches:
        docs = frame["doc_id"].astype("Int64")
        for doc, missing, text in zip(docs.fillna(0).tolist(), docs.isna().tolist(), frame["text"]):
            words = split(text)
            ids.append(None if missing else doc)
            held.append(changed(words, ids[-1]) if planted else words)
            total += len(words)
            if total >= SLICE_WORDS or len(held) >= 4096:
                yield ids, held
                ids, held, total = [], [], 0
    if ids:
        yield ids, held


def detect(documents: DataFrame, planted: bool = False) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start, then period), collapsed text.

    A run is a longest stretch of words with smallest period q and at least ``max(LEAST, EXPONENT * q)`` words. Null and empty
    texts have no words, no runs and an empty collapsed text. Repeated rows give equal rows, a null doc_id stays null,
    an empty table gives no rows. Other columns are not looked at. Texts are read whole; a slice of texts is in memory at a time,
    a very long text is a slice of its own. With ``planted`` a tenth of the documents get a periodic tail first.
    """
    def found(batches):
        for ids, held in slices(batches, planted):
            rows = [(doc, [{"start": s, "length": n, "period": q} for s, n, q in some], b" ".join(collapsed(words, some)).decode("utf-8", "surrogatepass"))
                    for doc, words, some in zip(ids, held, runs_of(held))]
            yield _table(rows, ["doc_id", "runs", "text"])

    return _rows(documents).mapInPandas(found, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for name in names:
        if name in ("doc_id", "start", "length", "period", "exponent_milli"):
            frame[name] = pd.array(frame[name], dtype="Int64")
    return frame


def report(documents: DataFrame) -> DataFrame:
    """One row per document with its number of runs, the longest one, and digests of the runs and of the
    collapsed words, after the periodic tails that the contract plants; else as ``detect``.

    The digests are taken where the runs are found, so neither texts nor lists of runs leave the task.
    """
    def found(batches):
        for ids, held in slices(batches, True):
            rows = []
            for doc, words, some in zip(ids, held, runs_of(held)):
                best = min(some, key=lambda r: (-r[1], r[0], r[2])) if some else (None, None, None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in some)
                rows.append((doc, len(some), *best, best[1] * 1000 // best[2] if some else None, hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(b" ".join(collapsed(words, some))).hexdigest()))
            yield _table(rows, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return _rows(documents).mapInPandas(found, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                                               "runs_sha256 string, collapsed_sha256 string")
