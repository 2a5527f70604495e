"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a normalised vector are quantised separately; a pair of centroids is a cell. A query
walks the cells by the sum of its two distances, kept in a heap that holds the frontier of the two
sorted lists. It walks twice: first over a small part of the rows, which gives a cosine that its neighbours reach at least,
then on until the cells it has seen hold a stated share of the rows that are expected to reach it. What a cell is
expected to hold follows from its rows, the cosine of its centroids, and how far rows lie from their centroids. So a query
with near neighbours stops early, and one without any walks far. Rows of the cells are ranked by their exact cosine.

The codebooks are fitted on a bounded sample and grow with the rows: the cells with their square root. Every row is
indexed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrears.llm.common import groups_of, stage
from arrears.llm.near_embeddings import unit_rows, unpack, usable
from arrears.operators.common import positions

SAMPLE_ROWS = 20_000   # vectors the codebooks are fitted on
GROWTH = 4             # centroids of a half: so many times the fourth root of the rows
FIRST = 0.05           # of all rows whose cells the first walk covers
SHARE = 0.97           # of the expected rows beyond the first walk's cosine whose cells the second one covers
WORD = 62              # cells of a first centroid in one long of a mask
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


def k_means(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        owner = distances(points, centres).argmin(axis=1)
        count = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None] - 2 * points @ centres.T)


class Codebooks:
    """Centroids of the halves of unit vectors, for each length of vectors, and the mean squared distance to each."""

    def __init__(self, by_length: dict[int, tuple[np.ndarray, np.ndarray]], spread: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.by_length, self.spread = by_length, spread

    def halves(self, unit: np.ndarray):
        half = unit.shape[1] // 2
        first, second = self.by_length[unit.shape[1]]
        return distances(unit[:, :half], first), distances(unit[:, half:], second)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self.halves(unit)
        return first.argmin(axis=1), second.argmin(axis=1)

    def expected(self, unit: np.ndarray, counts: np.ndarray, floor: float) -> np.ndarray:
        """How many rows of each cell are expected to have a cosine of at least ``floor`` with one unit vector.

        The cosine of a row is that of its centroids and a remainder, taken as normal.
        """
        size = len(unit)
        parts = unit[:size // 2], unit[size // 2:]
        means = [c @ p for c, p in zip(self.by_length[size], parts)]
        spread = [s * float(p @ p) / max(1, len(p)) for s, p in zip(self.spread[size], parts)]
        z = (floor - means[0][:, None] - means[1][None]) / np.sqrt(spread[0][:, None] + spread[1][None] + 1e-9)
        return counts / (1 + np.exp(np.clip(1.5976 * z + 0.0706 * z ** 3, -500, 500)))


def centroids(rows: int) -> int:
    """Centroids of a half for so many rows."""
    return max(1, min(round(GROWTH * rows ** 0.25), rows // 4))


def fit(vectors: DataFrame, seed: int = 11) -> Codebooks:
    """Codebooks from at most ``SAMPLE_ROWS`` vectors, the first by a hash of the id."""
    by_length, spread = {}, {}
    for size, rows in vectors.groupBy(F.size("embedding")).count().collect():
        frame = (vectors.filter(F.size("embedding") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
                 .select("embedding").toPandas())
        unit = unit_rows(unpack(frame["embedding"]))
        halves = unit[:, :size // 2], unit[:, size // 2:]
        by_length[size] = tuple(k_means(part, centroids(rows), seed) for part in halves)
        spread[size] = tuple(_spread(part, c) for part, c in zip(halves, by_length[size]))
    return Codebooks(by_length, spread)


def _spread(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Mean squared distance of the points of each centre; of all points where it has none."""
    far = distances(points, centres)
    owner = far.argmin(axis=1)
    least = far[np.arange(len(points)), owner]
    count = np.bincount(owner, minlength=len(centres))
    return np.where(count > 0, np.bincount(owner, least, len(centres)) / np.maximum(count, 1), least.mean())


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Cells (i, j) by rising ``first[i] + second[j]`` until they hold ``wanted`` of what ``counts`` says, rows or expected ones."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b, counts = a.tolist(), b.tolist(), counts.tolist()
    heap, done, out, got = [(x[0] + y[0], 0, 0)], [0] * len(a), [], 0
    # done[i]: cells of row i that were taken. (i, j) enters when both of its neighbours are out.
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        out.append((a[i], b[j]))
        got += counts[a[i]][b[j]]
        done[i] = j + 1
        if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return out


def masks(cells: list[tuple[int, int]], width: int) -> dict[int, np.ndarray]:
    """Second centroids of the cells of each first one, as bits in longs."""
    out: dict[int, np.ndarray] = {}
    for i, j in cells:
        if i not in out:
            out[i] = np.zeros(-(-width // WORD), np.int64)
        out[i][j // WORD] |= 1 << j % WORD
    return out


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, share: float = SHARE, codebooks: Codebooks | None = None) -> DataFrame:
    """The ``k`` nearest other rows of each row whose vec_id is divisible by ``every``.

    Rows (query_id, rank, vec_id, score), ties to the smaller vec_id; all others if there are fewer.
    A vec_id that stands on several rows counts once, with the least of its vectors. Rows with a null
    id, and vectors without a direction, take no part; vectors of another length are no candidates.
    Equal scores rank by vec_id. Other columns are not looked at. An empty table gives no rows. With a ``share`` of 1
    every cell is walked and the answer is exact.

    Queries are grouped by their own cell, so that those of a block walk alike. A row goes to the blocks that walk its
    cell and to no others; rows of a first centroid that holds many are dealt by hash. A task holds one block of each.
    """
    one = stage(vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable()))
    books = codebooks or fit(one)

    def coded(batches):
        for frame in batches:
            for size, part in frame.groupby(frame["embedding"].map(len)):
                first, second = books.cells(unit_rows(unpack(part["embedding"])))
                yield part.assign(size=np.int32(size), first=first.astype(np.int32), second=second.astype(np.int32))

    cells = stage(one.mapInPandas(coded, "vec_id long, embedding array<float>, size int, first int, second int"))
    table = {}
    for size, i, j, n in cells.groupBy("size", "first", "second").count().collect():   # as many as the square root of the rows
        first, second = books.by_length[size]
        table.setdefault(size, np.zeros((len(first), len(second)), np.int64))[i, j] = n

    queries = positions(cells.filter(F.col("vec_id") % every == 0), ["size"], [F.col("first"), F.col("second"), F.col("vec_id")], "place")
    queries = stage(queries.select("vec_id", "embedding", "size", F.floor((F.col("place") - 1) / QUERY_BLOCK).cast("int").alias("block"))
                    .withColumn("floor", F.lit(None).cast("double")))
    chunks = cells.groupBy("size", "first").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("_c"))
    walks = "vec_id long, embedding array<float>, size int, block int, first int, mask array<long>"

    def walked(batches):
        """What each query of a block walks, and, without a vec_id, what any of them does."""
        for group in groups_of(batches, ["size", "block"]):
            size, block = int(group["size"].iloc[0]), int(group["block"].iloc[0])
            counts, rows, union = table[size], [], {}
            unit = unit_rows(unpack(group["embedding"]))
            least = 2 * k + 1
            for vec_id, embedding, floor, x, first, second in zip(group["vec_id"], group["embedding"], group["floor"], unit, *books.halves(unit)):
                if floor != floor:      # the first walk: none is known yet
                    held, wanted = counts, max(FIRST * counts.sum(), least)
                else:
                    held = books.expected(x, counts, floor)
                    wanted = share * held.sum()
                for i, mask in masks(walk(first, second, held, np.inf if share >= 1 else wanted), counts.shape[1]).items():
                    union[i] = union[i] | mask if i in union else mask
                    rows.append((vec_id, embedding, i, mask))
            rows += [(None, None, i, mask) for i, mask in union.items()]
            frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "first", "mask"])
            frame["vec_id"] = frame["vec_id"].astype("Int64")
            yield frame.assign(size=np.int32(size), block=np.int32(block))[["vec_id", "embedding", "size", "block", "first", "mask"]]

    columns = ["size", "block", "first", "chunk", "vec_id", "is_query", "second", "mask", "embedding"]
    keys = columns[:4]

    def ranked(batches):
        for group in groups_of(batches, keys):
            asks = group["is_query"].to_numpy() == 1
            if not asks.any() or asks.all():
                continue
            q, r = group[asks], group[~asks]
            x, y = unit_rows(unpack(q["embedding"])), unit_rows(unpack(r["embedding"]))
            bits, second, ids = np.stack(q["mask"].to_numpy()), r["second"].to_numpy(), r["vec_id"].to_numpy().astype(np.int64)
            near = x @ y.T
            near[(bits[:, second // WORD] >> (second % WORD) & 1) == 0] = -9.0
            found = []
            for i, query in enumerate(q["vec_id"].to_numpy().astype(np.int64)):
                seen = near[i]
                seen[ids == query] = -9.0
                least = np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) > k else -2.0
                pick = np.flatnonzero(seen >= max(least - 1e-9, -2.0))
                if len(pick):
                    # One order of summation for all, so that equal vectors get equal scores.
                    score = (y[pick] * x[i]).sum(axis=1)
                    best = np.lexsort((ids[pick], -score))[:k]
                    found.append(pd.DataFrame({"query_id": query, "vec_id": ids[pick][best], "score": score[best]}))
            if found:
                yield pd.concat(found)

    def search(asked: DataFrame) -> DataFrame:
        # Blocks are dealt to as many tasks as there are blocks: one holds up to QUERY_BLOCK walks.
        probes = stage(asked.repartition(blocks, "size", "block").sortWithinPartitions("size", "block").mapInPandas(walked, walks))
        mine = (probes.filter("vec_id is not null").join(chunks, ["size", "first"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
                .withColumns({"is_query": F.lit(1), "second": F.lit(0)}))
        union = probes.filter("vec_id is null").select("size", "first", "block", "mask")
        bit = F.expr(f"shiftright(get(mask, cast(second div {WORD} as int)), second % {WORD}) & 1")
        rows = (cells.join(chunks, ["size", "first"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("_c")).cast("int"))
                .join(union, ["size", "first"]).filter(bit == 1).withColumns({"is_query": F.lit(0), "mask": F.lit(None).cast("array<long>")}))
        merged = (rows.select(*columns).unionByName(mine.select(*columns)).repartition(*keys).sortWithinPartitions(*keys)
                  .mapInPandas(ranked, "query_id long, vec_id long, score double"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    blocks = max(1, queries.select("size", "block").distinct().count())
    if share < 1:
        floors = stage(search(queries).groupBy(F.col("query_id").alias("vec_id")).agg(
            F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(-1.0)).alias("floor")))
        queries = queries.drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0)))
    return search(queries).select("query_id", "rank", "vec_id", "score")
