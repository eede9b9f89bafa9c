"""Mixing sources to target weights by entropy balancing.

The mix asks every source for a share of all words. Among the non-negative document rates that give each source its
words, entropy balancing takes those closest to one in relative entropy. The convex dual has one multiplier per
source and the rates are exponential tilts ``exp(lambda * size / mean size)``, held at ``cap``. Newton steps on the
dual run as Spark aggregations over the (source, size) histogram, which is all that the rates depend on.

Rates are rounded into whole copies: each document gets the whole part, and the fractional parts are drawn by
sequential Poisson sampling on a hash of the row, cut where the source's words reach its target; one more
move, adding a row or swapping two, comes as near the target as one move can.

Defined cases: a null text has size 0; a null source is a source of its own, last in the order; sources without words
have target 0; repeated rows are separate documents that share a decision; an empty table gives an empty result; other
columns are kept by :func:`apply_mix` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geneweft.llm.registry import stored

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
ROUNDS = 60
TOLERANCE = 1e-7


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(histogram: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per source: rank, source_size, documents, target words.

    Weights repeat over the sources in code-point order, null last. Targets are ``min(weight * level, cap * size)`` with
    the one level at which they add up to all words, which is where resharing the excess ends. Sources are few beside
    their documents; they are ordered as one row each.
    """
    sizes = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents")
    )
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1)
    limit = F.col("source_size") * F.lit(float(cap))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", limit)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level)
    # the first source in order that stays under its limit sets the level of all that follow
    free = F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))
    return leveled.withColumn("free", F.min(free).over(everything)["level"]).select(
        "source", "rank", "source_size", "documents",
        F.least("limit", F.col("weight") * F.coalesce("free", F.lit(float("inf")))).alias("target"),
    )


def solve_rates(histogram: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """Dual multipliers: ``targets`` with ``tilt`` per source and ``mean`` size.

    Each round is one aggregation of value and slope per source, then a Newton step on the logarithm of the words
    taken, kept inside the bracket found so far. A source at its cap needs no tilt: all its rates are ``cap``.
    """
    ratio = F.col("target") / F.col("source_size")
    state = stored(
        targets.select(
            "*",
            (F.col("source_size") / F.col("documents")).alias("mean"),
            ((F.col("source_size") > 0) & (ratio < cap * (1 - 1e-12))).alias("open"),
            F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"),
            F.lit(None).cast("double").alias("gap"),
        ),
        "mix-state",
    )
    cells = stored(
        histogram.where("size > 0").join(beside(state).select(F.col("source").alias("s"), "rank"), F.col("source").eqNullSafe(F.col("s")))
        .select("rank", F.col("size").cast("double").alias("size"), F.col("n").cast("double").alias("n")),
        "mix-cells",
    )
    for _ in range(ROUNDS):
        words = F.col("n") * F.col("size")
        share = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("tilt") * share, F.lit(50.0)))
        sums = (
            cells.join(beside(state).where("open").select("rank", "tilt", "mean"), "rank")
            .groupBy("rank")
            .agg(
                F.sum(words * F.least(rate, F.lit(float(cap)))).alias("value"),
                F.sum(F.when(rate < cap, words * rate * share).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.log(F.greatest(F.col("value"), F.lit(1e-300)) / F.col("target"))
        low = F.when(F.col("new_gap") < 0, F.greatest("low", "tilt")).otherwise(F.col("low"))
        high = F.when(F.col("new_gap") > 0, F.least("high", "tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.when(F.col("slope") > 0, F.col("new_gap") * F.col("value") / F.col("slope"))
        # without a usable Newton step: halve the bracket, or double the distance while one end is still unknown
        fallback = (
            F.when(F.col("new_high") >= 1e9, F.greatest(2 * F.col("new_low"), F.lit(1.0)))
            .when(F.col("new_low") <= -1e9, F.least(2 * F.col("new_high"), F.lit(-1.0)))
            .otherwise((F.col("new_low") + F.col("new_high")) / 2)
        )
        moved = (
            state.join(sums, "rank", "left")
            .withColumn("new_gap", gap).withColumn("new_low", low).withColumn("new_high", high)
            .withColumn("step", step)
            .withColumn("next", F.when((F.col("step") > F.col("new_low")) & (F.col("step") < F.col("new_high")), F.col("step")).otherwise(fallback))
        )
        settled = ~F.col("open") | (F.abs("new_gap") < TOLERANCE)
        state = stored(
            moved.select(
                *targets.columns, "mean", "open",
                F.when(settled, F.col("tilt")).otherwise(F.col("next")).alias("tilt"),
                F.coalesce("new_low", "low").alias("low"), F.coalesce("new_high", "high").alias("high"),
                F.when(F.col("open"), F.abs("new_gap")).alias("gap"),
            ),
            "mix-state",
        )
        if not state.where(F.col("gap") >= TOLERANCE).limit(1).count():
            break
    return state


SMALL = 100_000


def beside(few: DataFrame) -> DataFrame:
    """A stored table of one row per source, broadcast where counting it shows that it is small."""
    return F.broadcast(few) if few.limit(SMALL + 1).count() <= SMALL else few


def _rate(cap: float) -> Column:
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("open"), F.least(tilted, F.lit(float(cap)))).otherwise(F.when(F.col("source_size") > 0, F.lit(float(cap))).otherwise(F.lit(1.0)))


def _order(rate: Column, key: Column) -> Column:
    """Place of a row in the draw of its source, 0 to 1: small for a large fraction and a small hash."""
    uniform = (F.pmod(key, F.lit(1 << 40)).cast("double") + 0.5) / F.lit(float(1 << 40))
    fraction = rate - F.floor(rate)
    return F.when(fraction > 0, uniform / (uniform + fraction)).otherwise(F.lit(1.0))


def solve_mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Everything a row needs to know of its source: target, tilt and the cut of its draw.

    ``sized`` has source, size and key (a hash of the row) and is read a few times; store it first.
    """
    histogram = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    solved = solve_rates(histogram, source_targets(histogram, weights, cap), cap)
    rows = (
        sized.where("size > 0").join(beside(solved).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("rank", "size", "target", _rate(cap).alias("rate"), "key")
        .select("rank", "size", "target", F.floor("rate").alias("whole"), _order(F.col("rate"), F.col("key")).alias("place"))
    )
    cell = F.floor(F.col("place") * CELLS)
    cells = rows.groupBy("rank", cell.alias("cell")).agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("base"), F.first("target").alias("target")
    )
    source = Window.partitionBy("rank")
    before = F.coalesce(F.sum("words").over(source.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    missing = F.col("target") - F.sum("base").over(source) - before
    turning = stored(
        cells.select("rank", "cell", "words", missing.alias("missing"))
        .where((F.col("missing") >= 0) & (F.col("missing") < F.col("words"))),
        "mix-turning",
    )
    inside = rows.withColumn("cell", cell).join(beside(turning).select("rank", "cell", "missing"), ["rank", "cell"])
    steps = inside.groupBy("rank", "missing", "place").agg(F.sum("size").alias("words")).withColumn(
        "after", F.sum("words").over(source.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    )
    within = F.col("after") <= F.col("missing")
    cuts = steps.groupBy("rank").agg(
        F.max(F.when(within, F.col("place"))).alias("inner"),
        F.min(F.when(~within, F.struct("place", "words"))).alias("cross"),
    )
    all_cuts = turning.select("rank", (F.col("cell") / F.lit(float(CELLS))).alias("edge")).join(cuts, "rank", "left").select(
        F.col("rank").alias("r"), "inner", "edge", "cross"
    )
    cut = stored(
        solved.join(all_cuts, F.col("rank") == F.col("r"), "left").select(
            *solved.columns, "inner", "cross",
            # without a turning cell the fractions do not reach the target: all of them are drawn
            F.when(F.col("r").isNull(), F.lit(1.0)).otherwise(F.col("edge")).alias("edge"),
        ),
        "mix-cut",
    )
    # the draw stops short of its target: add the undrawn row, or swap the next row for the drawn one, that leaves least
    marked = rows.join(beside(cut).select("rank", "inner", "edge", "cross"), "rank").withColumn("drawn", _drawn(F.col("place")))
    left = marked.groupBy("rank").agg(
        (F.first("target") - F.sum(F.col("size") * (F.col("whole") + F.when(F.col("drawn"), 1).otherwise(0)))).alias("left")
    )
    moves = marked.where(F.col("place") < 1).groupBy("rank", "place", "drawn").agg(F.sum("size").alias("words"), F.first("cross").alias("cross"))
    gain = F.when(~F.col("drawn"), F.col("words")).otherwise(F.col("cross.words") - F.col("words"))
    miss = F.abs(F.col("left") - gain)
    move = F.struct(
        miss.alias("miss"), F.when(F.col("drawn"), F.col("cross.place")).otherwise(F.col("place")).alias("add"),
        F.when(F.col("drawn"), F.col("place")).alias("remove"),
    )
    best = moves.join(beside(stored(left, "mix-left")), "rank").where(miss < F.abs("left")).groupBy("rank").agg(F.min(move).alias("move"))
    return stored(cut.drop("cross").join(best.select("rank", "move.add", "move.remove"), "rank", "left"), "mix-solved")


def _drawn(place: Column) -> Column:
    return (place < 1) & F.when(F.col("inner").isNotNull(), place <= F.col("inner")).otherwise(place < F.col("edge"))


def apply_mix(sized: DataFrame, solved: DataFrame, cap: float = 3.0) -> DataFrame:
    """``sized`` with source_size, target and copies (whole, at most ``cap``)."""
    place = _order(_rate(cap), F.col("key"))
    plan = beside(solved).select(
        F.col("source").alias("_source"), "source_size", "target", "tilt", "mean", "open", "inner", "edge", "add", "remove"
    )
    is_place = lambda c: F.coalesce(place == F.col(c), F.lit(False))
    drawn = (_drawn(place) | is_place("add")) & ~is_place("remove")
    return (
        sized.join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", (F.floor(_rate(cap)) + F.when(drawn & (F.col("size") > 0), 1).otherwise(0)).cast("long"))
        .drop("_source", "tilt", "mean", "open", "inner", "edge", "add", "remove")
    )


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.lit("mix"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``docs``."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key().alias("key")), "mix-docs")
    return apply_mix(sized, solve_mix(sized, weights, cap), cap).drop("key")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it, with the columns of ``docs``."""
    columns = docs.columns
    sized = stored(docs.select("source", word_count(F.col("text")).alias("size"), row_key().alias("key")), "mix-docs")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "source", word_count(F.col("text")).alias("size"), row_key().alias("key"))
    copies = apply_mix(whole, solve_mix(sized, weights, cap), cap).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
