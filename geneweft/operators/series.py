"""Trajectory operators: one long table of points in, one row per series (or sample, or design) out.

A point carries ``seq`` (0-based position) and ``n_points`` (length of its series), so that
tails and windows are plain filters and every metric is a group-by with a map-side half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geneweft.functions.values import clamp_log
from geneweft.operators.skew import index_points
from geneweft.schemas import SERIES
from geneweft.session import stored

SAMPLE = ("design_id", "sample_id")
STATE = ("design_id", "sample_id", "state_name")


def melt_trajectories(df: DataFrame, id_cols: list[str], time_col: str | None = None) -> DataFrame:
    """Wide simulation frames to long points; the role of a column is read off its name.

    The time column is ``Time``, else ``time``, else the first column that is not an id.
    """
    others = [c for c in df.columns if c not in id_cols]
    clock = time_col or next((c for c in ("Time", "time") if c in others), others[0])
    values = [c for c in others if c != clock]
    long = df.unpivot([*id_cols, clock], values, "column", "value").withColumnRenamed(clock, "time")
    column = F.col("column")
    kind = (
        F.when(column.endswith("_mRNA"), F.lit("mrna"))
        .when(column.startswith("Input_"), F.lit("input"))
        .otherwise(F.lit("protein"))
    )
    species = F.regexp_replace(F.regexp_replace(column, "_mRNA$", ""), "^Input_", "")
    return long.select(*id_cols, "time", species.alias("species"), kind.alias("kind"), "value")


def trajectory_points(df: DataFrame, id_cols: list[str], time_col: str | None = None) -> DataFrame:
    """Wide simulation frames to numbered points: long rows with ``seq`` and ``n_points``.

    A frame's rows are numbered by time before they are reshaped, once for all its columns.
    """
    others = [c for c in df.columns if c not in id_cols]
    clock = time_col or next((c for c in ("Time", "time") if c in others), others[0])
    numbered = index_points(df, id_cols, [clock])
    return melt_trajectories(numbered, [*id_cols, "seq", "n_points"], clock)


def is_protein() -> Column:
    return F.col("kind") == "protein"


def is_target(target: str) -> Column:
    """Rows of the target's protein; its mRNA and an input of the same name are other series."""
    return is_protein() & (F.col("species") == target)


def is_burden_species(target: str | None = None) -> Column:
    """Protein rows; the kinetic score also leaves out its target species."""
    return is_protein() if target is None else is_protein() & (F.col("species") != target)


def with_length(traj: DataFrame, keys: tuple[str, ...] = SERIES, block: int = 65536) -> DataFrame:
    """Add ``n_points`` to points that only carry ``seq``.

    The lengths are spread over blocks of positions and joined by (series, block), so a long
    series is looked up by many tasks. Null keys are keys like any other.
    """
    lengths = traj.groupBy(*keys).agg((F.max("seq") + 1).alias("n_points"))
    spread = lengths.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_points") - 1) / block)))
    )
    same = F.floor(F.col("seq") / block) == F.col("_block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    spread = spread.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return traj.join(spread, same).drop("_block", *[f"_of_{k}" for k in keys])


def points_from_events(
    df: DataFrame, keys: tuple[str, ...] = SERIES, order_by: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """Number raw readings into points.

    Only raw readings need this. Stored trajectories carry their positions.
    """
    return index_points(df, list(keys), list(order_by))


def in_tail(fraction: float) -> Column:
    return F.col("seq") >= F.floor(F.col("n_points") * F.lit(float(fraction)))


def tail_slice(traj: DataFrame, fraction: float = 0.9) -> DataFrame:
    return traj.where(in_tail(fraction))


def steady_state(traj: DataFrame, keys: tuple[str, ...] = SERIES, fraction: float = 0.9) -> DataFrame:
    """Mean of the last tenth of every series."""
    return tail_slice(traj, fraction).groupBy(*keys).agg(F.avg("value").alias("steady_state"))


def turns(values: Column, mean: Column) -> Column:
    """struct(head, last, turns) of values in order: the first and last side of the mean and the changes of side between.

    Summaries of neighbouring stretches join to the summary of both: turns add up, and one more where the sides
    at the edge differ.
    """
    side = lambda v: F.signum(v - mean)
    start = F.struct(side(F.element_at(values, 1)).alias("last"), F.lit(0).cast("long").alias("turns"))
    step = lambda acc, v: F.struct(
        side(v).alias("last"), (acc["turns"] + F.coalesce((side(v) != acc["last"]).cast("long"), F.lit(0))).alias("turns")
    )
    return F.aggregate(
        values, start, step, lambda acc: F.struct(side(F.element_at(values, 1)).alias("head"), acc["last"].alias("last"), acc["turns"].alias("turns"))
    )


def oscillation(
    traj: DataFrame,
    min_points: int = 100,
    min_amp: float = 100.0,
    keys: tuple[str, ...] = SERIES,
    block: int = 65536,
) -> DataFrame:
    """Crossings of the tail mean over the last half of each series, and whether it oscillates.

    The tail is read once and packed into blocks of at most ``block`` values in order, which are
    stored. Their sums give the mean; every block is then reduced to its turns, and the few
    summaries of a series are joined across the block edges. A task sees one block at a time.
    """
    k = list(keys)
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value")))
    packed = stored(
        tail_slice(traj, 0.5)
        .groupBy(*k, F.floor(F.col("seq") / block).alias("_block"))
        .agg(
            F.sum("value").alias("_sum"), F.count("value").alias("_count"), F.min("value").alias("_low"), F.max("value").alias("_high"),
            F.max("n_points").alias("n_points"), F.transform(ordered, lambda p: p["value"]).alias("_values"),
        ),
        "blocks",
    )
    stats = packed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in k]).agg(
        (F.sum("_sum") / F.sum("_count")).alias("mean"),
        (F.max("_high") - F.min("_low")).alias("amplitude"),
        F.max("n_points").alias("n_points"),
    )
    same = F.lit(True)
    for c in k:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    summaries = packed.drop("n_points").join(stats, same).select(*k, "_block", "amplitude", "n_points", turns(F.col("_values"), F.col("mean")).alias("_t"))
    edge = F.col("_t")["head"] != F.lag(F.col("_t")["last"]).over(Window.partitionBy(*k).orderBy("_block"))
    crossings = F.sum(F.col("_t")["turns"] + F.coalesce(F.col("_edge").cast("long"), F.lit(0)))
    return (
        summaries.withColumn("_edge", edge)
        .groupBy(*k)
        .agg(F.max("n_points").alias("n_points"), crossings.alias("crossings"), F.max("amplitude").alias("amplitude"))
        .withColumn(
            "oscillates",
            (F.col("n_points") >= min_points) & (F.col("crossings") >= 3) & (F.col("amplitude") > min_amp),
        )
    )


def rise_column(threshold: float) -> Column:
    return F.coalesce(F.min(F.when(F.col("value") >= threshold, F.col("time"))), F.max("time"))


def rise_time(traj: DataFrame, threshold: float = 1000.0, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """First time at or above the threshold, else the last time."""
    return traj.groupBy(*keys).agg(rise_column(threshold).alias("rise_time"))


def leakage_window() -> Column:
    """Leading points averaged by the summary: a twentieth of the series, at least 3 and at most 25."""
    return F.greatest(F.lit(3), F.least(F.lit(25), F.floor(F.col("n_points") / 20)))


def _summary_columns() -> list[Column]:
    initial = F.avg(F.when(F.col("seq") < leakage_window(), F.col("value")))
    return [
        initial.alias("initial_mean"),
        F.max("value").alias("peak_value"),
        F.max_by("value", "seq").alias("final_value"),
    ]


def _with_ranges(df: DataFrame) -> DataFrame:
    peak, initial = F.col("peak_value"), F.col("initial_mean")
    return df.withColumn("dynamic_range", peak - initial).withColumn(
        "leakage_ratio", F.when(peak > 0, initial / peak).otherwise(F.lit(0.0))
    )


def summarize(
    traj: DataFrame, keys: tuple[str, ...] = SERIES, output: str | None = None, position: str | None = None
) -> DataFrame:
    """Initial mean, peak, final value, dynamic range and leakage ratio per series.

    With ``output`` only the protein of that species is kept; a group that lacks it falls back to its
    last column, the series with the highest ``position`` (by name unless given).
    """
    position = F.max(position or "species").alias("_position")
    summary = _with_ranges(traj.groupBy(*keys).agg(*_summary_columns(), position))
    if output is None:
        return summary.drop("_position")
    groups = [k for k in keys if k not in ("species", "kind")]
    rest = [c for c in summary.columns if c not in groups and c != "_position"]
    chosen = F.max_by(F.struct(*rest), F.struct(is_target(output), F.col("_position"))).alias("_row")
    return summary.groupBy(*groups).agg(chosen).select(*groups, "_row.*").select(*keys, *[c for c in rest if c not in keys])


def series_metrics(traj: DataFrame, threshold: float = 1000.0, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Steady state, last value, rise time and summary of every series in one aggregation."""
    return _with_ranges(
        traj.groupBy(*keys).agg(
            F.max("n_points").alias("n_points"),
            F.avg(F.when(in_tail(0.9), F.col("value"))).alias("steady_state"),
            rise_column(threshold).alias("rise_time"),
            *_summary_columns(),
        )
    )


def ensemble_mean(traj: DataFrame) -> DataFrame:
    """Mean over samples per species, kind and position, values clamped for a log axis."""
    return traj.groupBy("design_id", "state_name", "species", "kind", "seq").agg(
        F.avg(clamp_log(F.col("value"))).alias("mean_value"), F.count(F.lit(1)).alias("n_samples")
    )


def burden_by_point(traj: DataFrame, target: str | None = None) -> DataFrame:
    """Total protein level of every point, null where no counted protein is there."""
    counted = F.when(is_burden_species(target), F.col("value"))
    return traj.groupBy(*STATE, "seq").agg(F.sum(counted).alias("burden"))


def max_burden(traj: DataFrame, variant: str = "sample", target: str | None = None) -> DataFrame:
    """Largest total protein level at any point.

    ``sample``: per sample over all proteins. ``design``: per design without the target species. A group
    without any counted protein has burden 0.
    """
    if variant == "sample":
        keys, left_out = SAMPLE, None
    elif variant == "design":
        keys, left_out = ("design_id",), target
    else:
        raise ValueError(f"unknown burden variant {variant!r}")
    highest = burden_by_point(traj, left_out).groupBy(*keys).agg(F.max("burden").alias("_b"))
    return highest.select(*keys, F.greatest(F.coalesce("_b", F.lit(0.0)), F.lit(0.0)).alias("max_burden"))


def drop_failed(runs: DataFrame, traj: DataFrame, keys: tuple[str, ...] = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Points of runs that gave any value, and per design how many runs were expected, kept and lost."""
    points = traj.where(F.col("value").isNotNull())
    alive = points.select(*keys).distinct().withColumn("_alive", F.lit(1))
    counts = (
        runs.select(*keys)
        .distinct()
        .join(alive, list(keys), "left")
        .groupBy("design_id")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.count("_alive").alias("n_ok"))
        .withColumn("n_failed", F.col("n_runs") - F.col("n_ok"))
    )
    return points, counts
