"""Token ids and packed matrices: best-fit-decreasing packing with a segment tree over free room.

Texts become ids of a public byte-pair vocabulary. A document longer than a row is split into pieces
of a row's length, each with its place in the document, so nothing is lost. Pieces are packed from the
longest down into the row with the least room that still fits, found in a segment tree indexed by
room. A window of documents is packed at a time, within the task that reads them: no text or id
is shuffled, and memory is bounded by the window.
"""

from __future__ import annotations

import base64
import functools
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.operators.common import shared_folder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern that belongs to the vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256           # free id that closes a document
LENGTH = 2048         # ids of a row
WINDOW_IDS = 4_000_000
TASK_CHARS = 12_000_000   # letters of a task at least, about a window, so that small partitions leave no rows half empty


@functools.lru_cache(maxsize=2)
def tokenizer(path: str = VOCABULARY):
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """Ids of a text and the closing one, as 16-bit numbers."""
    ids = tokenizer(path).encode_to_numpy(text, disallowed_special=()) if text else []
    return np.append(np.asarray(ids, dtype="<u2"), np.array([END], "<u2"))


def decode(ids: np.ndarray, path: str = VOCABULARY) -> str:
    return tokenizer(path).decode([int(i) for i in ids if i != END], errors="strict")


class Rooms:
    """Segment tree over amounts of room: the least amount of at least so much that some row has."""

    def __init__(self, length: int):
        self.base = 1
        while self.base < length + 1:
            self.base *= 2
        self.has = bytearray(2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = self.base + room
        while at and not self.has[at]:
            self.has[at] = 1
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the tightest row with at least ``need``; the row leaves the tree."""
        at = self.base + need
        if not self.has[at]:
            while at > 1 and (at & 1 or not self.has[at + 1]):   # up to a node whose right sibling has room
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.has[2 * at] else 2 * at + 1
        room = at - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.has[at] = 0
            at //= 2
            while at and not (self.has[2 * at] or self.has[2 * at + 1]):
                self.has[at] = 0
                at //= 2
        return room, row


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Best fit, longest first: for each row the pieces in it. Ties go to the earlier piece."""
    rooms, rows = Rooms(length), []
    for piece in sorted(range(len(sizes)), key=lambda p: (-sizes[p], p)):
        found = rooms.take(sizes[piece])
        if found is None:
            rows.append([])
            found = (length, len(rows) - 1)
        room, row = found
        rows[row].append(piece)
        if room > sizes[piece]:
            rooms.add(room - sizes[piece], row)
    return rows


def packed(documents: DataFrame, length: int = LENGTH, path: str = VOCABULARY, window: int = WINDOW_IDS) -> DataFrame:
    """One row per packed row of at most ``length`` ids of (doc_id, text).

    ids (16-bit little-endian), cumulative segment lengths (one more than segments, from 0), the doc_id
    and the offset in its document of each segment, and the position at which each segment starts anew
    (its offset in the row, where position ids return to 0). Every text is closed by one end id, also
    an empty one; a null text counts as empty, a null doc_id stays null. Repeated rows are packed each.
    Other columns are not looked at. An empty table gives no rows. A window closes after ``window`` ids.
    """
    def windows(batches):
        held, total = [], 0
        for frame in batches:
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = encode(text if isinstance(text, str) else None, path)
                held.append((None if doc is None or doc != doc else int(doc), ids))
                total += len(ids)
                if total >= window:
                    yield held
                    held, total = [], 0
        if held:
            yield held

    def rows(batches):
        for held in windows(batches):
            pieces = [(doc, at, ids[at:at + length]) for doc, ids in held for at in range(0, len(ids), length)]
            out = []
            for row in pack([len(p[2]) for p in pieces], length):
                some = [pieces[p] for p in row]
                ids = np.concatenate([p[2] for p in some]).astype("<u2").tobytes()
                bounds = np.r_[0, np.cumsum([len(p[2]) for p in some])]
                out.append((ids, int(bounds[-1]), bounds.tolist(), [p[0] for p in some], [p[1] for p in some], bounds[:-1].tolist()))
                if len(out) >= 512:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["ids", "n_ids", "cumulative_lengths", "doc_ids", "offsets", "resets"]
    schema = "ids binary, n_ids int, cumulative_lengths array<int>, doc_ids array<long>, offsets array<int>, resets array<int>"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.coalesce(tasks(texts)).mapInPandas(rows, schema)


def tasks(texts: DataFrame) -> int:
    """How many tasks the letters of the texts fill; more partitions than that are joined."""
    letters = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-letters // TASK_CHARS))


def write(documents: DataFrame, path: str, **options) -> None:
    """Packed matrices as a Parquet folder: a row of ids, and what tells its segments apart."""
    packed(documents, **options).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unpacked(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of documents whose segments stand in packed rows, joined by document and offset.

    Rows that repeat a doc_id cannot be told apart in the matrices; they are left out.
    """
    cut = rows.select("ids", F.explode(F.arrays_zip("doc_ids", "offsets", "resets", F.slice("cumulative_lengths", F.lit(2), F.size("resets")).alias("ends"))).alias("s")).select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.offsets").alias("offset"),
        F.expr("substring(ids, 2 * s.resets + 1, 2 * (s.ends - s.resets))").alias("ids"))
    pieces = cut.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
                                       F.count_if(F.col("offset") == 0).alias("heads")).filter("heads = 1")

    @F.pandas_udf("string")
    def text_of(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ps: decode(np.frombuffer(b"".join(p["ids"] for p in ps), "<u2"), path))

    return pieces.select("doc_id", text_of("parts").alias("text"))


def report(documents: DataFrame) -> DataFrame:
    """The packed rows as they are read back from the written matrices, each with a hash of its ids in their place."""
    path = f"{shared_folder(documents.sparkSession)}/packed-{uuid.uuid4().hex}"
    write(documents, path)
    return read(documents.sparkSession, path).select(
        F.xxhash64("ids").alias("ids_hash"), "n_ids", "cumulative_lengths", "doc_ids", "offsets", "resets")


def position_ids(cumulative_lengths, offsets=None) -> np.ndarray:
    """Position of each id within its segment; with ``offsets``, within its document."""
    bounds = np.asarray(cumulative_lengths)
    lengths = np.diff(bounds)
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)
    return inside if offsets is None else inside + np.repeat(np.asarray(offsets), lengths)
