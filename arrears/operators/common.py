"""Skew-safe building blocks used by the other operators."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

SPREAD = 32  # slices of a ranked group
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def salt(columns, buckets: int) -> Column:
    """Deterministic bucket of a row, so that a recomputed task repeats its placement."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by keys over as many tasks as the session shuffles into.

    Left to itself, adaptive execution merges tasks until they hold a number of compressed bytes. Narrow rows compress so
    well that this is millions of rows, and a join, its sorts and the hash tables above it hold them all at once. A stated
    number is kept, also for what is joined to these rows by the same keys.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int | None, *,
                  rank: str = "row_number", position: str = "position") -> DataFrame:
    """First ``limit`` ranks of every group, with their position; ``limit=None`` ranks all rows.

    A rank filter directly above a window lets Spark prune each group inside the map task, before
    the shuffle. What is left of a group - one set of leaders per map task - is ranked in two
    steps: first in slices of map tasks, then over the slices' leaders. So a group that holds most
    of the rows never meets in one task. A row that leads its group leads every slice it is in, so
    slices may cut through ties. A position for every row comes from ``positions``.
    """
    if limit is None:
        return positions(df, keys, order, position)
    function = getattr(F, rank)
    df = df.withColumn("_slice", F.spark_partition_id() % SPREAD)
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    df = (df.withColumn("_inner", function().over(inner))
          .filter(F.col("_inner") <= limit).drop("_inner", "_slice"))
    outer = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(position, function().over(outer)).filter(F.col(position) <= limit)
    return ranked.withColumn(position, F.col(position).cast("long"))


def _in_order(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows by keys and order over ranges, written; ``_part`` numbers the ranges, ``_row`` the rows of one."""
    by = [*[F.col(k) for k in keys], *order]
    rows = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def _with_offsets(rows: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """Rows in order with ``_first``, the first row of their group in their range, and ``_ahead``, what the group sums to
    in the ranges before."""
    pieces = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_piece"), "_first",
                           F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    same = F.col("_part") == F.col("_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(pieces, same).drop("_piece", *[f"_{k}" for k in keys])


def positions(df: DataFrame, keys: list[str], order: list[Column], position: str = "position") -> DataFrame:
    """The position of every row in its group.

    Rows are sorted by ranges of (keys, order), so a group lies in as many tasks as it fills. Each row knows its
    place in its range; what a group holds in the ranges before is a running sum over one row per group and range.
    Ties keep the order they are written in, so that ``order`` should be total.
    """
    rows = _with_offsets(_in_order(df, keys, order), keys, F.lit(1))
    return rows.withColumn(position, (F.col("_ahead") + F.col("_row") - F.col("_first") + 1).cast("long")).select(*df.columns, position)


def running_sums(df: DataFrame, keys: list[str], order: list[Column], amount: str, before: str) -> DataFrame:
    """The sum of ``amount`` over the rows of a group that come before each row, taken as in ``positions``."""
    rows = _with_offsets(_in_order(df, keys, order), keys, F.col(amount))
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(before, F.col("_ahead") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).select(*df.columns, before)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a session without executors may make one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Files of a shuffle go as soon as the write that needed it has ended.

    Left to itself, Spark keeps them until the driver collects its garbage, so that the shuffles of steps long done add up.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def _write(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return path


def stage(df: DataFrame, sort_by: tuple[str, ...] = ()) -> DataFrame:
    """Write an intermediate that several jobs read and continue from the written table.

    Readers prune its columns, their plans start at this table, and a lost executor costs no
    recomputation. ``sort_by`` orders each file, so that readers filtering on those columns skip
    most pages; one file per task keeps the file count at the task count. The table lies in the
    shared checkpoint folder and is as short-lived.
    """
    path = _write(df.sortWithinPartitions(*sort_by) if sort_by else df)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Written states of an iteration: each round starts from a table of known size and removes the one before.

    A checkpoint keeps the size estimated for the plan it replaces, and joins multiply estimates, so an iteration
    over checkpoints plans with ever larger numbers; a written table has its true size.
    """

    def __init__(self):
        self.path = None

    def next(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
        """The written rows, and a few counts taken by the same job."""
        watch, session, before = Observation(), df.sparkSession, self.path
        self.path = _write(df.observe(watch, *[value.alias(name) for name, value in counts.items()]) if counts else df)
        if before is not None:
            folder = session._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)
        return session.read.schema(df.schema).parquet(self.path), watch.get if counts else {}


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order`` (a later duplicate replaces an earlier)."""
    return top_per_group(df, keys, [F.col(order).desc()], 1).drop("position")


def sum_cents(column: str, alias: str | None = None) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("decimal(28,2)").alias(alias or column)
