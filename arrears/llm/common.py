"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrears.operators.common import stage

__all__ = ["components", "fold", "local_roots", "stage", "words_of"]


def fold(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, separated by space and the ASCII controls 9 to 13.

    ``bytes`` methods know exactly these separators and letters, ``str`` methods know more.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the smallest position reachable over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable from each id of ``edges`` (a, b: long): rows (id, component_id).

    Large-star and small-star steps alternate until the edges no longer change; the number of
    rounds grows with the logarithm of the longest path. Each round is a written table, so a lost
    executor costs no earlier round. Ids without an edge do not appear. Only the fingerprint of
    the edges reaches the driver.
    """
    current = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        print_of = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if print_of == seen or print_of[0] == 0:
            return current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).unionByName(
                current.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
        seen = print_of
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def groups_of(batches, keys: list[str]):
    """Frames of equal ``keys`` from batches that are sorted by them; a group may span batches."""
    rest = None
    for frame in batches:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        change = np.zeros(len(frame), bool)
        for key in keys:
            values = frame[key].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        starts = [0, *np.flatnonzero(change)]
        for lo, hi in zip(starts, starts[1:]):
            yield frame.iloc[lo:hi]
        rest = frame.iloc[starts[-1]:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest
