"""Mixing sources to target weights along a time-varying curriculum.

Everything is built-in DataFrame work. A source's weight over training time t in [0, 1] is linear,
``w(t) = 2 w ((1 - slope) / 2 + slope t)``, so its integral is ``w ((1 - slope) t + slope t**2)``
and over the whole run it is the plain weight. Demand for a source's words up to time t is that
integral in parts of its target; inverting it gives each document the time at which it is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrears.operators.common import stage

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3            # no source and no document is repeated more often
BROADCAST_ROWS = 1_000_000   # rows of a plan (48 bytes each) sent to every executor; a longer one is joined by shuffle
SLICES = 12        # bits of the hash that name a slice of a source


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Target words of each source from (source, source_size): sources share all words by weight.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... A target stops at ``cap`` times the
    source; what is left goes to the others by weight. Sources ordered by ``cap * size / weight``
    fill up one after the other, so the level all others share is a running sum, not a loop.
    The rows are one per source; the input of the ranking is the number of sources.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ranked = (sizes.withColumn("_n", F.row_number().over(order))
              .withColumn("weight", ((F.col("_n") - 1) % 3 + 1).cast("double")).drop("_n")
              .withColumn("_cap", F.col("source_size") * F.lit(float(cap))))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # In this order the full sources come first; the first open one has the level of all open ones,
    # and later ones, counted as if it were full, have a lower one.
    level = ranked.withColumn("_level", left / open_weight)
    full = F.col("_cap") <= F.col("_level") * F.col("weight")
    shared = level.withColumn("_open", F.max(F.when(~full, F.col("_level"))).over(every))
    return shared.select("source", "source_size", "weight",
                         F.when(full, F.col("_cap")).otherwise(F.least("_cap", F.col("_open") * F.col("weight"))).alias("target"))


def slope_of(weight: Column) -> Column:
    """Light sources fade out, heavy ones come up, the middle stays level."""
    return (weight - 2.0) / 2.0


def time_of(demand: Column, slope: Column) -> Column:
    """Inverse of the integrated schedule: the t at which ``(1 - slope) t + slope t**2 = demand``."""
    flat = 1.0 - slope
    return F.when(F.abs(slope) < 1e-9, demand).otherwise(
        2.0 * demand / (flat + F.sqrt(F.greatest(flat * flat + 4.0 * slope * demand, F.lit(0.0)))))


def plan(documents: DataFrame, cap: int = CAP, slices: int = SLICES) -> DataFrame:
    """Each document with its size, its source's size and target, how often it is used and where.

    Within a source documents stand in the order of a hash of their id. Their running sum of words
    is taken in two steps, over the slices of a source and within a slice, so that a source with
    most of the rows is spread over ``2**slices`` keys. Pass p of a source covers demand from
    p times its size on; a copy is used if its middle lies below the target. Reruns agree.

    Null text has no words and is never used; null source is a source of its own; an empty table
    gives no rows. Repeated rows stand side by side, each with its own share. Other columns are not
    looked at.
    """
    return planned(stage(documents.select("doc_id", "source", words(F.col("text")).alias("size"))), cap, slices)


def planned(rows: DataFrame, cap: int = CAP, slices: int = SLICES) -> DataFrame:
    """The plan of written rows (doc_id, source, size); a column ``_id`` goes along."""
    keep = [c for c in rows.columns if c == "_id"]
    rows = rows.withColumn("_h", F.xxhash64("doc_id")).withColumn("_slice", F.shiftrightunsigned("_h", 64 - slices))
    per_slice = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("source", "_slice", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    goal = targets(per_slice.groupBy("source").agg(F.sum("_sum").alias("source_size")), cap)
    keyed = offsets.join(goal, offsets["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    within = Window.partitionBy("source", "_slice").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_end", F.sum("size").over(within)).withColumnRenamed("source", "_s").withColumnRenamed("_slice", "_sl")
    joined = placed.join(keyed, placed["_s"].eqNullSafe(keyed["source"]) & (placed["_sl"] == keyed["_slice"]))
    start = (F.col("_offset") + F.col("_end") - F.col("size")).cast("double")
    middle = start + F.col("size") / 2.0
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(
        F.lit(cap), F.ceil((F.col("target") - middle) / F.col("source_size")))))
    return joined.select("doc_id", F.col("_s").alias("source"), "size", "source_size", "weight", "target",
                         middle.alias("middle"), copies.cast("int").alias("copies"), *keep)


def level(planned: DataFrame, cap: int = CAP) -> DataFrame:
    """Bring each source nearer to its target: one document whose size comes closest to what is
    missing is used once more, or to what is too much once less, if that helps at all."""
    off = planned.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("_off"))
    near = planned.join(off.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    fits = (F.col("size") > 0) & F.when(F.col("_off") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    miss = F.abs(F.col("size") - F.abs("_off"))
    chosen = near.filter(fits & (miss < F.abs("_off"))).groupBy(F.col("source").alias("_of")).agg(
        F.min(F.struct(miss.alias("miss"), "middle", "doc_id")).alias("_at"), F.max(F.signum("_off")).alias("_sign"))
    change = F.when((F.col("middle") == F.col("_at.middle")) & F.col("doc_id").eqNullSafe(F.col("_at.doc_id")), F.col("_sign")).otherwise(0)
    return (planned.join(chosen, F.col("source").eqNullSafe(F.col("_of")), "left")
            .withColumn("copies", (F.col("copies") + F.coalesce(change, F.lit(0))).cast("int")).drop("_of", "_at", "_sign"))


def positions(planned: DataFrame) -> DataFrame:
    """One row per copy with its training time in [0, 1], sorted by it over the whole result."""
    copy = planned.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    demand = F.least(F.lit(1.0), (F.col("middle") + F.col("copy") * F.col("source_size")) / F.col("target"))
    return copy.withColumn("position", time_of(demand, slope_of(F.col("weight")))).orderBy("position", "doc_id", "copy")


def mix(documents: DataFrame, carry=None, cap: int = CAP) -> DataFrame:
    """The whole mixture: doc_id, source, copy, position in training order; with ``carry``, these
    columns of each document instead, in that order.

    The plan is made on numbers of rows. What is carried is written once with its number, joined to the finished plan and
    sorted once; a plan of a checked size is sent to the rows, so that they move only to be sorted.
    """
    if carry is None:
        return positions(level(plan(documents, cap), cap)).select("doc_id", "source", "copy", "position")
    rows = stage(documents.select(F.struct(*carry).alias("_row"), "doc_id", "source", words(F.col("text")).alias("size"),
                                  F.monotonically_increasing_id().alias("_id")))
    light = level(stage(planned(rows.select("doc_id", "source", "size", "_id"), cap)), cap).filter("copies > 0")
    uses = stage(light.select("_id", "source_size", "target", "weight", "middle", "copies"))
    few = uses.count() <= BROADCAST_ROWS
    whole = rows.select("_id", "_row", "doc_id").join(F.broadcast(uses) if few else uses, "_id")
    return positions(whole).select("_row.*")


def report(documents: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per document, sorted by the time of its first use; unused documents come last."""
    first = time_of(F.least(F.lit(1.0), F.try_divide("middle", "target")), slope_of(F.col("weight")))
    return level(stage(plan(documents, cap)), cap).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, first).alias("position")).orderBy(F.col("position").asc_nulls_last(), "doc_id")
