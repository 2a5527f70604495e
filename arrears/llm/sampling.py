"""Sampled segmentations of texts: Gumbel top-k without replacement over the piece lattice.

A text is a chain of lattices, cut only where no piece can cross, so a segmentation is a way through all of them. Its perturbed
score is its log probability plus Gumbel noise; the k segmentations with the best perturbed scores
are a sample without replacement. They are found without listing segmentations: a node of the search
stands for all ways that begin alike, its perturbed score is the maximum over them, and the backward
sums of the lattice give their mass. Following the best node down costs one draw per piece. What is
left aside on the way - at each piece, all other pieces together - is one node each, whose maximum is
a Gumbel cut off at the score of the path. The next sample starts from the best node set aside.

Draws are hashes of the row key, the sample and the place in the text, so a rerun draws the same.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.lattice import SPACE, VOCABULARY, Lattices, byte_ids, pieces, spans_words

SAMPLES = 2
SLICE_CHARS = 500_000
EMITTED = 500_000    # ids handed on at a time
STEPS = 1 << 24      # counters of draws set apart for a unit
UNIT = re.compile("▁*[^▁]+|▁+")
# A cycle of three letters, so that every text can be told from its marked form.
MARK = {0x20: 0x2581, 0x2581: 0xE000, 0xE000: 0x20}
UNMARK = {b: a for a, b in MARK.items() if a != 0x20}
UNCOVERED = 1e-7     # weight of a letter spelled in bytes


def units(text: str, path: str = VOCABULARY) -> list[str]:
    """An escaped text, cut where no piece can cross: words with all the spaces before them, of any length.

    With a vocabulary whose pieces go on over a space the whole text is one unit.
    """
    rare = SPACE in text or "\ue000" in text
    escaped = SPACE + (text.translate(MARK) if rare else text.replace(" ", SPACE))
    return [escaped] if spans_words(path) else UNIT.findall(escaped)


@functools.lru_cache(maxsize=2)
def spelled(path: str = VOCABULARY) -> list[bytes]:
    """What each piece stands for in a text."""
    out = [t.replace(SPACE, " ").encode() for t in pieces(path)[1]]
    for value, piece in enumerate(byte_ids(path).tolist()):
        out[piece] = bytes([value])
    return out


@functools.lru_cache(maxsize=2)
def spelled_pieces(path: str = VOCABULARY) -> pa.Array:
    return pa.array(spelled(path), pa.large_binary())


def decode(ids, path: str = VOCABULARY) -> str:
    """The text of piece ids; inverse of any segmentation that this module draws."""
    return b"".join(map(spelled(path).__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def uniform(key: np.ndarray, a: np.ndarray, b) -> np.ndarray:
    """Numbers in (0, 1) from a 64-bit key and two counters."""
    x = key + a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53


def cut_gumbel(phi: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at ``phi`` given that it is below ``most``."""
    with np.errstate(over="ignore", invalid="ignore"):
        return phi - np.log(np.exp(phi - most) - np.log(u))


def numbered(texts: list[str], path: str = VOCABULARY) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct units of the texts, the numbers of the units of one text after the other, and where each text begins and ends."""
    if spans_words(path):
        cut = [units(text, path) for text in texts]
    else:
        # Single spaces between words are cut all at once.
        cut = [None if text and text[0] != " " != text[-1] and not ("  " in text or SPACE in text or "\ue000" in text) else units(text, path)
               for text in texts]
    try:
        plain = pc.split_pattern(pa.array([text for text, found in zip(texts, cut) if found is None], pa.large_string()), " ")
        rest = [unit[1:] for found in cut if found is not None for unit in found]   # each begins with a mark
        words = pa.concat_arrays([plain.flatten(), pa.array(rest, pa.large_string())]).dictionary_encode()
    except UnicodeEncodeError:   # halves of letters
        index, cut = Index(), [found or units(text, path) for text, found in zip(texts, cut)]
        flat = np.fromiter((index[unit] for found in cut for unit in found), np.int32)
        return list(index), flat, np.cumsum([0, *map(len, cut)])
    unit, names = words.indices.to_numpy(), [SPACE + name for name in words.dictionary.to_pylist()]
    length = np.array([-1 if found is None else len(found) for found in cut], np.int64)
    rows = np.flatnonzero(length < 0)
    if len(rows) == len(cut):
        return names, unit, plain.offsets.to_numpy().astype(np.int64)
    # Units of plain texts come first; each text's are put in its place.
    others = np.flatnonzero(length >= 0)
    length[rows] = np.diff(plain.offsets.to_numpy())
    bounds, order = np.r_[0, np.cumsum(length)], np.r_[rows, others]
    held = np.cumsum(length[order]) - length[order]
    came = np.empty(len(cut), np.int64)
    came[order] = held
    return names, unit[np.repeat(came - bounds[:-1], length) + np.arange(len(unit))], bounds


class Index(dict):
    """Numbers of different keys in the order they are asked for."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Chain:
    """Lattices of distinct words with the chance of each arc given its node, ready for drawing."""

    def __init__(self, words: list[str], weight: np.ndarray, path: str):
        lat = Lattices(words, path)
        chance = lat.chances(weight[lat.piece])
        # A letter that is spelled in bytes is known by its code, behind the pieces.
        bare = np.flatnonzero(lat.piece < 0)
        if len(bare):
            letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
            lat.piece[bare] = letters[lat.source[bare] - lat.word[bare]].astype(np.int32) + len(weight)
        order = np.argsort(lat.source, kind="stable")
        source, self.chance = lat.source[order], chance[order]
        self.offset, self.target, self.piece = lat.offset, lat.target[order], lat.piece[order]
        nodes = int(lat.offset[-1])
        del lat, chance, order
        count = np.bincount(source, minlength=nodes)
        self.first = np.r_[0, np.cumsum(count)].astype(np.int32)
        some = np.flatnonzero(count)         # all nodes but the last of each word
        begin, count = self.first[some], count[some]
        # Key of an arc: its node plus the summed chance up to it, the last one lifted to the next node.
        self.key = np.cumsum(self.chance)
        self.key -= np.repeat(np.r_[0.0, self.key][begin], count)
        np.minimum(self.key, 1.0, out=self.key)
        self.key += source
        self.key[begin + count - 1] = some + 1.0
        # The likeliest arc of each node and its part of the keys: most draws fall there. The end of a word has none (-1).
        self.best, self.low, self.high = np.full(nodes, -1, np.int32), np.zeros(nodes), np.zeros(nodes)
        if len(some):
            top = np.flatnonzero(self.chance == np.maximum.reduceat(self.chance, begin).repeat(count))
            self.best[source[top]] = top
            arc = self.best[some]
            self.low[some] = np.where(arc > begin, self.key[np.maximum(arc - 1, 0)], some)
            self.high[some] = self.key[arc]

    def arcs_of(self, arc: int) -> range:
        """All arcs of the node that an arc begins at."""
        node = int(np.searchsorted(self.first, np.int32(arc), "right")) - 1
        return range(int(self.first[node]), int(self.first[node + 1]))

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        at, arc = node + u, self.best[node]
        rest = np.flatnonzero((at < self.low[node]) | (at >= self.high[node]))
        arc[rest] = np.minimum(np.searchsorted(self.key, at[rest], "right"), self.first[node[rest] + 1] - 1)
        return arc


def draw(chain: Chain, node: np.ndarray, key: np.ndarray, place: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Arcs from each node to the end of its word, in order, and how many each word got."""
    steps, count, who = [], np.zeros(len(node), np.int64), np.flatnonzero(chain.best[node] >= 0)
    at, place, key = node[who], place[who] * np.int64(STEPS), key[who]
    while len(who):
        arc = chain.pick(at, uniform(key, place + len(steps), salt))
        steps.append((who, arc))
        count[who] += 1
        at = chain.target[arc]
        on = np.flatnonzero(chain.best[at] >= 0)
        who, at, place, key = who[on], at[on], place[on], key[on]
    start = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for step, (who, arc) in enumerate(steps):
        out[start[who] + step] = arc
    return out, count


class Search:
    """The search over one group of texts; each text has its own frontier and its own draws."""

    def __init__(self, chain: Chain, unit: np.ndarray, bounds: np.ndarray, keys: np.ndarray):
        self.chain, self.unit, self.bounds, self.keys = chain, unit, bounds, keys
        self.paths: list[list] = [[] for _ in keys]      # per text: (arcs, log prob, perturbed score)
        self.frontier: list[list] = [[] for _ in keys]   # per text: (scores set aside, path, first step, excluded, prefix log)

    def _extend(self, docs, node, word, start_log, score, salt, made):
        """Draw from ``node`` of ``word`` (in the text) to the end of each text of ``docs``."""
        first, last = self.bounds[docs] + word, self.bounds[docs + 1]
        lengths = last - first
        where = np.repeat(np.arange(len(docs)), lengths)
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        occurrence = first[where] + inside
        nodes = self.chain.offset[self.unit[occurrence]].astype(np.int64)
        head = np.flatnonzero(inside == 0)
        nodes[head] = np.where(node[where[head]] >= 0, node[where[head]], nodes[head])
        place = inside + word[where]
        arcs, count = draw(self.chain, nodes, self.keys[docs][where], place, 3 * salt)
        owner = np.repeat(where, count)
        number = np.bincount(owner, minlength=len(docs))
        base = np.cumsum(number) - number
        chance = self.chain.chance[arcs]
        log = np.log(chance)
        total = np.cumsum(log)
        behind = total - log
        behind -= np.r_[0.0, total][base][owner] - start_log[owner]     # log probability before each step
        step = np.arange(len(arcs)) - base[owner]
        # Where another arc can be taken at all.
        fork = np.flatnonzero(chance <= 1 - 1e-12)
        of, aside = owner[fork], np.full(len(arcs), -np.inf)
        u = uniform(self.keys[docs][of], step[fork] + 1, 3 * salt + 1)
        aside[fork] = cut_gumbel(behind[fork] + np.log1p(-chance[fork]), score[of], u)
        words = np.repeat(place.astype(np.int32), count)
        for i in range(len(docs)):
            lo, hi = base[i], base[i] + number[i]
            end_log = start_log[i] + (total[hi - 1] - (total[lo - 1] if lo else 0.0) if hi > lo else 0.0)
            made(i, arcs[lo:hi], aside[lo:hi], behind[lo:hi], words[lo:hi], float(end_log))

    def run(self, samples: int) -> list[tuple[list[tuple[np.ndarray, float, float]], float]]:
        """Per text its samples, best first, and the perturbed score of the next one (the threshold)."""
        every = np.arange(len(self.keys))
        top = -np.log(-np.log(uniform(self.keys, np.zeros(len(every), np.int64), 2)))

        def begin(i, arcs, aside, behind, words, end_log):
            self.paths[i].append((arcs, end_log, float(top[i])))
            self.frontier[i].append([aside, arcs, 0, behind, words])

        self._extend(every, np.full(len(every), -1), np.zeros(len(every), np.int64), np.zeros(len(every)), top, 1, begin)
        closed: list[list] = [[] for _ in every]   # nodes with several arcs left out: (score, prefix arcs, arcs out, log, word)
        for sample in range(1, samples):
            picks, salt = [], 3 * (sample + 1) + 2
            draws = np.stack([uniform(self.keys, np.full(len(every), n), salt) for n in (0, 1)], axis=1)
            for i in range(len(every)):
                best = self._best(i, closed[i])
                if best is None:
                    continue
                score, take = best
                prefix, out, log, word = take()
                picks.append((i, score, *self._branch(score, prefix, out, log, word, draws[i], closed[i])))
            if not picks:
                break
            docs = np.array([p[0] for p in picks])

            def go_on(i, arcs, aside, behind, words, end_log):
                doc, score, prefix = picks[i][0], picks[i][1], picks[i][2]
                self.paths[doc].append((np.r_[prefix, arcs], end_log, float(score)))
                self.frontier[doc].append([aside, self.paths[doc][-1][0], len(prefix), behind, words])

            self._extend(docs, np.array([p[3] for p in picks]), np.array([p[4] for p in picks]), np.array([p[5] for p in picks]),
                         np.array([p[1] for p in picks]), sample + 1, go_on)
        return [(self.paths[i], b[0] if (b := self._best(i, closed[i], peek=True)) else -np.inf) for i in range(len(every))]

    def _best(self, i, closed, peek=False):
        best, take = -np.inf, None
        for entry in self.frontier[i]:
            if len(entry[0]):
                at = int(entry[0].argmax())
                if entry[0][at] > best:
                    best, take = float(entry[0][at]), (entry, at)
        for entry in closed:
            if entry[0] > best:
                best, take = entry[0], entry
        if take is None:
            return None

        def open_node():
            if isinstance(take, tuple):
                entry, at = take
                entry[0][at] = -np.inf
                arcs, offset = entry[1], entry[2]
                return arcs[:offset + at], [int(arcs[offset + at])], float(entry[3][at]), int(entry[4][at])
            closed[:] = [entry for entry in closed if entry is not take]
            return take[1:]
        return best, open_node

    def _branch(self, score, prefix, out, log, word, u, closed):
        """Take one of the arcs not left out yet; the others stay set aside."""
        chain = self.chain
        arcs = [arc for arc in chain.arcs_of(out[0]) if arc not in out]
        chance = chain.chance[arcs]
        pick = int(min(np.searchsorted(np.cumsum(chance), u[0] * chance.sum(), "right"), len(arcs) - 1))
        arc, rest = arcs[pick], chance.sum() - chance[pick]
        if len(arcs) > 1 and rest > 0:
            aside = float(cut_gumbel(np.array([log + np.log(rest)]), np.array([score]), u[1:])[0])
            closed.append([aside, prefix, [*out, arc], log, word])
        return np.r_[prefix, np.int32(arc)], int(chain.target[arc]), word, log + float(np.log(chain.chance[arc]))


def weights(path: str, temperature: float = 1.0) -> np.ndarray:
    """Weight of each piece (spelled letter last): the vocabulary is in order of merging."""
    base = 1.0 / (np.arange(len(pieces(path)[1])) + 100.0)
    return np.r_[base / base.sum(), UNCOVERED] ** temperature


def row_key(doc_id, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(pd.NA if doc_id is None else doc_id), seed)


def spell(ids: np.ndarray, length: np.ndarray, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the bytes of letters in the place of their codes, and the lengths of the rows they lie in."""
    known = len(pieces(path)[1]) + 1
    bare = np.flatnonzero(ids >= known)
    if not len(bare):
        return ids, length
    letters, which = np.unique(ids[bare] - known, return_inverse=True)
    spelt = [byte_ids(path)[list(chr(letter).translate(UNMARK).encode("utf-8", "surrogatepass"))] for letter in letters.tolist()]
    size = np.array([len(s) for s in spelt])[which]
    count = np.ones(len(ids), np.int64)
    count[bare] = size
    out, start = np.repeat(ids, count), (np.cumsum(count) - count)[bare]
    for n in range(int(size.max())):
        some = np.flatnonzero(size > n)
        out[start[some] + n] = np.array([s[n] if len(s) > n else 0 for s in spelt])[which[some]]
    row = np.searchsorted(np.cumsum(length), bare, "right")
    return out, length + np.bincount(row, size - 1, len(length)).astype(np.int64)


def drawn(texts: list[str], keys: list[int], samples: int, weight: np.ndarray, path: str):
    """Ids of the segmentations of all texts, one after the other; of each its length and (text, number, log_prob, perturbed, inclusion)."""
    words, unit, bounds = numbered(texts, path)
    chain = Chain(words, weight, path)
    arcs, told = [np.zeros(0, np.int32)], []
    for row, (got, threshold) in enumerate(Search(chain, unit, bounds, np.array(keys, dtype=np.uint64)).run(samples)):
        for number, (way, log_prob, perturbed) in enumerate(got, 1):
            arcs.append(way)
            told.append((row, number, log_prob, perturbed, 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(log_prob - threshold)))))
    length = np.array([len(a) for a in arcs[1:]], np.int64)
    return *spell(chain.piece[np.concatenate(arcs)], length, path), told


def segmentations(texts: list[str], keys: list[int], samples: int = SAMPLES, path: str = VOCABULARY, temperature: float = 1.0):
    """Per text a list of (ids, log_prob, perturbed, inclusion): distinct segmentations, best first.

    ``inclusion`` is the chance that a segmentation of this probability is above the threshold, the
    perturbed score of the first one left out; with nothing left out it is 1.
    """
    ids, length, told = drawn(texts, keys, samples, weights(path, temperature), path)
    out: list[list] = [[] for _ in texts]
    for (row, _, *scores), end, size in zip(told, np.cumsum(length).tolist(), length.tolist()):
        out[row].append((ids[end - size:end], *scores))
    yield from out


def decoded(ids: np.ndarray, length: np.ndarray, texts: list[str], path: str = VOCABULARY) -> list[bool]:
    """Whether the ids of each row (of ``length`` each, one row after the other) give its text back."""
    taken = spelled_pieces(path).take(pa.array(ids))
    raw, offsets = taken.buffers()[2].to_pybytes(), np.frombuffer(taken.buffers()[1], np.int64)
    ends = offsets[np.r_[0, np.cumsum(length)]].tolist()
    return [raw[lo + 1:hi] == text.encode("utf-8", "surrogatepass") for lo, hi, text in zip(ends, ends[1:], texts)]


def slices(texts, ids, seed):
    """Groups of rows of about ``SLICE_CHARS`` letters: positions, texts, keys."""
    rows, chars = [], 0
    for i, text in enumerate(texts):
        if text is not None:
            rows.append(i)
            chars += len(text)
        if rows and chars >= SLICE_CHARS:
            yield rows, [texts[r] for r in rows], [row_key(ids[r], seed) for r in rows]
            rows, chars = [], 0
    if rows:
        yield rows, [texts[r] for r in rows], [row_key(ids[r], seed) for r in rows]


def encode(documents: DataFrame, samples: int = SAMPLES, seed: int = 17, path: str = VOCABULARY, checked: bool = False) -> DataFrame:
    """Rows (doc_id, sample, ids, log_prob, perturbed, inclusion), sample from 1, best first.

    A text with fewer segmentations than ``samples`` gives all of them; a null text gives no row, an
    empty text the one segmentation of its leading space. Repeated rows give equal results. With
    ``checked`` a column ``decodes`` says whether the ids give the text back. Other columns are not looked
    at. An empty table gives no rows. Texts are segmented whole, over their whole lattice.
    """
    def sampled(batches):
        weight = weights(path)
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for rows, some, keys in slices(texts, ids, seed):
                found, length, told = drawn(some, keys, samples, weight, path)
                row, number, *scores = zip(*told)
                ends = np.r_[0, np.cumsum(length)]
                cuts = np.r_[0, np.flatnonzero(np.diff(ends[1:] // EMITTED)) + 1, len(told)]
                for lo, hi in zip(cuts, cuts[1:]):
                    part = found[ends[lo]:ends[hi]]
                    columns = [pa.array([ids[rows[r]] for r in row[lo:hi]], pa.int64()), pa.array(number[lo:hi], pa.int32()),
                               pa.ListArray.from_arrays(pa.array(ends[lo:hi + 1] - ends[lo], pa.int32()), pa.array(part, pa.int32()))]
                    if checked:
                        columns.append(pa.array(decoded(part, length[lo:hi], [some[r] for r in row[lo:hi]], path), pa.bool_()))
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(s[lo:hi], pa.float64()) for s in scores)], names)

    names = ["doc_id", "sample", "ids", *(["decodes"] if checked else []), "log_prob", "perturbed", "inclusion"]
    schema = f"doc_id long, sample int, ids array<int>{', decodes boolean' if checked else ''}, log_prob double, perturbed double, inclusion double"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sampled, schema)
