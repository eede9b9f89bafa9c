"""Building blocks that keep one hot key from becoming one slow task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geneweft.session import stored

#: Rows that a task sorts or groups in memory where the caller knows how many there are.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """In how many tasks so many rows stand with at most :data:`TASK_ROWS` in each, at least one for every core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows of equal keys together in one of ``tasks`` tasks; without a number Spark deals them where it must."""
    return df.repartition(tasks, *keys) if tasks else df


#: Bits of a row's number inside its partition in ``monotonically_increasing_id``.
PLACE_BITS = 33


def index_points(
    df: DataFrame, keys: list[str], order_by: list[str], seq: str = "seq", length: str | None = "n_points",
    tasks: int | None = None,
) -> DataFrame:
    """Number the rows of every group from 0 without putting a whole group into one task.

    Rows are dealt by ranges of (keys, order), so a large group lies in several tasks, also where
    its first order column is one value throughout. They are sorted there and written with their
    places to the shared scratch folder; what each task holds of a group is counted, and the counts
    of earlier tasks are the offsets, which are stored too: the result can be read several times.
    Rows with null keys form groups like any other; rows that tie in all of ``order_by`` are numbered
    in any order. ``tasks`` says how many ranges there are, else Spark's settings do.
    """
    placed = df.repartitionByRange(*([tasks] if tasks else []), *keys, *order_by).sortWithinPartitions(*keys, *order_by)
    rows = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    names = [f"_key{n}" for n in range(len(keys))]
    along = Window.partitionBy(*names).orderBy("_in")
    parts = stored(
        rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_part").alias("_in"))
        .agg(F.count(F.lit(1)).alias("_held"), F.min("_at").alias("_first"))
        .withColumn("_before", F.sum("_held").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_held"))
        .withColumn("_total", F.sum("_held").over(Window.partitionBy(*names)))
        .drop("_held"),
        "offsets",
    )
    if tasks:
        # rows and offsets of a range meet in one task; as a broadcast, offsets of few bytes on disk unfold to a large table in memory
        rows, parts = dealt(rows, tasks, "_part"), dealt(parts, tasks, "_in").hint("merge")
    same = F.col("_part") == F.col("_in")
    for k, n in zip(keys, names):
        same &= F.col(k).eqNullSafe(F.col(n))
    numbered = rows.join(parts, same).withColumn(seq, F.col("_before") + F.col("_at") - F.col("_first"))
    if length:
        numbered = numbered.withColumn(length, F.col("_total"))
    return numbered.drop("_at", "_part", "_in", "_first", "_before", "_total", *names)
