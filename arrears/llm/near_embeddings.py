"""Near duplicates among embeddings: p-stable hashing in several tables, then exact cosine.

A normalised vector x gets, in each table, the key of ``floor((a . x + b) / width)`` for several
Gaussian directions a. Vectors at cosine t are sqrt(2 - 2 t) apart; the chance that one direction
keeps such a pair together is known in closed form, which fixes the number of directions (so that
a bucket of unrelated vectors stays small at any number of rows) and of tables (so that a pair just
at the threshold is missed with the stated chance; closer pairs are missed far more rarely).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears.llm.common import components, groups_of, local_roots, stage

WIDTH = 1.5
BUCKET_ROWS = 4096   # larger buckets are dealt out as pairs of chunks
CROWD = 32           # unrelated vectors a bucket should hold
BLOCK = 1024         # rows of a block product inside a task


def stays(distance: float, width: float = WIDTH) -> float:
    """Chance that two points so far apart fall into one cell of one direction."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Directions per table and tables."""
    near, far = stays(math.sqrt(2 - 2 * threshold)), stays(math.sqrt(2))
    directions = max(4, round(math.log(max(rows, 1) / CROWD) / -math.log(far))) if rows > CROWD else 4
    return directions, math.ceil(math.log(miss) / math.log(1 - near ** directions))


class Hasher:
    def __init__(self, directions: int, tables: int, seed: int):
        self.directions, self.tables, self.seed, self.made = directions, tables, seed, {}

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Bucket key of each row in each table, 64 bits."""
        dim = unit.shape[1]
        if dim not in self.made:
            rng = np.random.default_rng([self.seed, dim])
            self.made[dim] = (rng.normal(size=(dim, self.directions * self.tables)),
                              rng.uniform(0, WIDTH, self.directions * self.tables),
                              rng.integers(1, 2**63 - 1, self.directions, dtype=np.uint64) | np.uint64(1))
        a, b, mixers = self.made[dim]
        cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).astype(np.uint64)
        mixed = (cells.reshape(len(unit), self.tables, self.directions) * mixers).sum(axis=2, dtype=np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
        return mixed.view(np.int64)


def unpack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    # Scaling by the largest entry first keeps huge and tiny vectors from over- and underflowing.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(column: str = "embedding") -> F.Column:
    """True for vectors with a direction: not null, no null or non-finite component, not zero."""
    c = F.col(column)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return c.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(c, lambda v: v != 0)


def near_pairs(x: np.ndarray, split: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of unit rows at or above the threshold; with ``split`` only across it."""
    left, right = [], []
    first = range(0, len(x) if split is None else split, BLOCK)
    for lo in first:
        hi = min(lo + BLOCK, len(x) if split is None else split)
        for start in range(lo if split is None else split, len(x), BLOCK):
            block = x[lo:hi] @ x[start:start + BLOCK].T
            i, j = np.nonzero(block >= threshold)
            i, j = i + lo, j + start
            keep = i < j
            left.append(i[keep])
            right.append(j[keep])
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-3, seed: int = 7) -> DataFrame:
    """One row per vec_id of (vec_id, embedding): n_links, component_id, kept.

    Vectors of different lengths never link. Equal vectors are linked and compared once. A vec_id
    that stands on several rows counts once, with the least of its vectors. A null vec_id and an
    unusable vector link with nothing. Other columns are not looked at. An empty table gives no rows.

    Buckets above ``BUCKET_ROWS`` are split into chunks by a hash of the id and every pair of chunks
    is a group of its own; inside a group, cosines are block products and leave only a count and a
    local root per vector, never pairs. A pair counts in the first table that holds it.
    """
    one = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    good = one.filter(F.col("vec_id").isNotNull() & usable())
    unique = stage(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    members = good.join(unique.filter("copies > 1"), "embedding").select("vec_id", "rep")
    hasher = Hasher(*shape(unique.count(), threshold, miss), seed)

    def hashed(batches):
        for frame in batches:
            for _, part in frame.groupby(frame["embedding"].map(len)):
                keys = hasher.keys(unit_rows(unpack(part["embedding"])))
                n, tables = keys.shape
                take = np.repeat(np.arange(n), tables)
                out = part.iloc[take]
                yield pd.DataFrame({"table": np.tile(np.arange(tables, dtype=np.int32), n), "bucket": keys.ravel(),
                                    "rep": out["rep"].to_numpy(), "copies": out["copies"].to_numpy(),
                                    "embedding": out["embedding"].to_numpy()})

    def keyed(batches):
        for frame in hashed(batches):
            yield frame[["table", "bucket"]]

    hot = (unique.mapInPandas(keyed, "table int, bucket long").groupBy("table", "bucket").count()
           .filter(F.col("count") > BUCKET_ROWS)
           .select("table", "bucket", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("_c")))
    rows = unique.mapInPandas(hashed, "table int, bucket long, rep long, copies long, embedding array<float>")
    chunk = F.pmod(F.xxhash64("rep"), F.col("_c")).cast("int")
    dealt = (rows.join(hot, ["table", "bucket"], "left").withColumn("_c", F.coalesce("_c", F.lit(1)))
             .withColumn("_k", chunk).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1)))
             .select("table", "bucket", F.least("_k", "_o").alias("lo"), F.greatest("_k", "_o").alias("hi"), F.col("_k").alias("chunk"),
                     "rep", "copies", "embedding")
             .repartition("table", "bucket", "lo", "hi").sortWithinPartitions("table", "bucket", "lo", "hi", "chunk"))

    def linked(batches):
        for group in groups_of(batches, ["table", "bucket", "lo", "hi"]):
            if len(group) < 2:
                continue
            lo, hi, table = group["lo"].iat[0], group["hi"].iat[0], int(group["table"].iat[0])
            split = None if lo == hi else int((group["chunk"] == lo).sum())
            x = unit_rows(unpack(group["embedding"]))
            a, b = near_pairs(x, split, threshold)
            if len(a) and table:
                keys = hasher.keys(x)[:, :table]
                fresh = np.ones(len(a), bool)
                for t in range(table):
                    fresh &= keys[a, t] != keys[b, t]
                a, b = a[fresh], b[fresh]
            if not len(a):
                continue
            ids, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), int)
            place[order] = np.arange(len(ids))
            root = ids[order][local_roots(len(ids), place[a], place[b])][place]
            links = (np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))).astype(np.int64)
            hit = links > 0
            yield pd.DataFrame({"rep": ids[hit], "links": links[hit], "root": root[hit]})

    found = stage(dealt.mapInPandas(linked, "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    state = unique.select("rep", "copies").join(counts, "rep", "left").join(joined, "rep", "left")
    state = state.filter("copies > 1 or links is not null")
    own = members.unionByName(unique.filter("copies = 1").select(F.col("rep").alias("vec_id"), "rep"))
    result = one.select("vec_id").join(own.join(state, "rep"), "vec_id", "left")
    component = F.coalesce("component_id", "rep", "vec_id")
    return result.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
