"""Truth-table verdicts, functional, kinetic and plausibility scores, viability and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geneweft.config import FEEDBACK_TEXT, MC_TEXT, PENALTY_TEXT, FunctionalConfig, KineticConfig, VerdictConfig, ViabilityConfig
from geneweft.functions import scores as S
from geneweft.operators.series import SAMPLE, in_tail, is_protein, is_target, max_burden, rise_column, rise_time


def level() -> Column:
    return F.col("value")


# --- joining levels to the truth table ---------------------------------------------------


def join_spec(
    levels: DataFrame, spec: DataFrame, how: str = "left", fill: float | None = 0.0, keys: tuple[str, ...] = ("design_id",)
) -> DataFrame:
    """Levels per (keys, state) against the truth table (design, state, expected).

    ``left`` keeps every row of the table for every group, with ``fill`` where a level is
    missing, and once for a design without any level (its other keys are null); ``inner``
    ignores states the table does not name. For ``left`` the levels of a group, one per state
    of its circuit, are packed into a map and looked up, so they are computed once.
    """
    if how == "inner":
        return levels.join(spec, ["design_id", "state_name"])
    entries = F.collect_list(F.struct("state_name", "value"))
    packed = levels.groupBy(*keys).agg(F.map_from_entries(entries).alias("_levels"))
    value = F.coalesce(F.try_element_at("_levels", F.col("state_name")), F.lit(fill))
    joined = spec.join(packed, "design_id", "left").withColumn("value", value)
    return joined.select(*keys, *[c for c in spec.columns if c not in keys], "value")


def on_off_columns() -> list[Column]:
    value, on, off = level(), F.col("expected") == 1, F.col("expected") == 0
    return [
        F.coalesce(F.min(F.when(on, value)), F.lit(0.0)).alias("min_on"),
        F.coalesce(F.max(F.when(off, value)), F.lit(0.0)).alias("max_off"),
        F.count(F.when(on, value)).alias("n_on"),
        F.count(F.when(off, value)).alias("n_off"),
    ]


def on_off_levels(matched: DataFrame, keys: tuple[str, ...] = ("design_id",)) -> DataFrame:
    """Lowest ON and highest OFF level with their counts; 0 where a side is empty."""
    return matched.groupBy(*keys).agg(*on_off_columns())


def two_sided() -> Column:
    return (F.col("n_on") > 0) & (F.col("n_off") > 0)


def fold_change(matched: DataFrame, rule: str, keys: tuple[str, ...] = ("design_id",), zero_off: str = "fail") -> DataFrame:
    """Fold change under one of three rules.

    ``verdict``: lowest ON over highest non-ON, 0 without leakage, infinite without ON states.
    ``functional``: guarded ratio, 0 if a side is empty. ``kinetic``: guarded ratio, 1 if a side is empty.
    """
    if rule == "verdict":
        on = F.col("expected") == 1
        low = F.coalesce(F.min(F.when(on, level())), F.lit(float("inf")))
        high = F.coalesce(F.max(F.when(~on, level())), F.lit(float("-inf")))
        bounds = matched.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"))
        return bounds.select(*keys, _verdict_fold(F.col("_low"), F.col("_high"), zero_off).alias("fold_change"))
    empty = {"functional": 0.0, "kinetic": 1.0}[rule]
    ratio = F.when(two_sided(), S.fold_ratio(F.col("min_on"), F.col("max_off"))).otherwise(F.lit(empty))
    return on_off_levels(matched, keys).select(*keys, ratio.alias("fold_change"))


def _verdict_fold(low: Column, high: Column, zero_off: str) -> Column:
    otherwise = F.lit(float("inf")) if zero_off == "inf" else F.lit(0.0)
    return F.when(high > 0, low / high).otherwise(otherwise)


# --- functional score --------------------------------------------------------------------


def logic_compliance(
    matched: DataFrame, cfg: FunctionalConfig = FunctionalConfig(), keys: tuple[str, ...] = ("design_id",)
) -> DataFrame:
    term = S.compliance_term(level(), F.col("expected"), cfg)
    return matched.groupBy(*keys).agg(F.coalesce(F.product(term), F.lit(1.0)).alias("compliance"))


def functional_score(
    matched: DataFrame, cfg: FunctionalConfig = FunctionalConfig(), keys: tuple[str, ...] = ("design_id",)
) -> DataFrame:
    """Compliance times the weighted fold-change and margin scores, all from one aggregation."""
    term = S.compliance_term(level(), F.col("expected"), cfg)
    base = matched.groupBy(*keys).agg(*on_off_columns(), F.coalesce(F.product(term), F.lit(1.0)).alias("compliance"))
    fc = F.when(two_sided(), S.fold_ratio(F.col("min_on"), F.col("max_off"))).otherwise(F.lit(0.0))
    scored = base.withColumn("fold_change", fc).withColumns(
        {
            "fc_score": S.fc_score(F.col("fold_change"), two_sided(), cfg),
            "margin_score": S.margin_score(F.col("min_on"), F.col("max_off"), F.col("n_on"), F.col("n_off"), cfg),
        }
    )
    total = F.col("compliance") * (F.lit(cfg.w_fc) * F.col("fc_score") + F.lit(cfg.w_margin) * F.col("margin_score"))
    return scored.withColumn("score_functional", total)


# --- kinetic score -----------------------------------------------------------------------


def last_levels(traj: DataFrame, target: str) -> DataFrame:
    """Last value of the target species per (design, sample, state)."""
    return (
        traj.where(is_target(target))
        .groupBy(*SAMPLE, "state_name")
        .agg(F.max_by("value", "seq").alias("value"))
    )


def robustness(
    traj: DataFrame, spec: DataFrame, target: str, cfg: KineticConfig = KineticConfig()
) -> DataFrame:
    """Retention of the fold change over the samples of a design; samples without a matched state count as 1."""
    matched = last_levels(traj, target).join(spec, ["design_id", "state_name"], "left")
    folds = fold_change(matched, "kinetic", SAMPLE)
    spread = folds.groupBy("design_id").agg(
        F.avg("fold_change").alias("fc_mean"), F.stddev_pop("fold_change").alias("_std")
    )
    return spread.select(
        "design_id",
        "fc_mean",
        S.variation(F.col("fc_mean"), F.col("_std")).alias("cv"),
        S.retention(F.col("fc_mean"), F.col("_std"), cfg).alias("r_kinetic"),
    )


def temporal(traj: DataFrame, spec: DataFrame, target: str, cfg: KineticConfig = KineticConfig()) -> DataFrame:
    """Mean rise time over samples and ON states, and its score; designs without ON states have rise time 0."""
    series = rise_time(traj.where(is_target(target)), cfg.on)
    rises = series.join(spec, ["design_id", "state_name"], "left").groupBy("design_id").agg(
        F.coalesce(F.avg(F.when(F.col("expected") == 1, F.col("rise_time"))), F.lit(0.0)).alias("t_rise_avg")
    )
    return rises.withColumn("score_temporal", S.temporal_score(F.col("t_rise_avg"), cfg))


def burden(traj: DataFrame, target: str, cfg: KineticConfig = KineticConfig()) -> DataFrame:
    return max_burden(traj, "design", target).withColumn("p_burden", S.burden_penalty(F.col("max_burden"), cfg))


def kinetic_score(traj: DataFrame, spec: DataFrame, target: str, cfg: KineticConfig = KineticConfig()) -> DataFrame:
    """Retention, temporal score and burden penalty per design, and their product.

    The target's rows are read once for fold changes and rise times, the other rows once for
    the burden.
    """
    series = (
        traj.where(is_target(target))
        .groupBy(*SAMPLE, "state_name")
        .agg(F.max_by("value", "seq").alias("value"), rise_column(cfg.on).alias("_rise"))
    )
    on = F.col("expected") == 1
    samples = (
        series.join(spec, ["design_id", "state_name"], "left")
        .groupBy(*SAMPLE)
        .agg(*on_off_columns(), F.sum(F.when(on, F.col("_rise"))).alias("_rise"))
        .withColumn("_fold", F.when(two_sided(), S.fold_ratio(F.col("min_on"), F.col("max_off"))).otherwise(F.lit(1.0)))
    )
    designs = samples.groupBy("design_id").agg(
        F.avg("_fold").alias("fc_mean"),
        F.stddev_pop("_fold").alias("_std"),
        F.coalesce(F.try_divide(F.sum("_rise"), F.sum("n_on")), F.lit(0.0)).alias("t_rise_avg"),
    )
    scored = designs.withColumns(
        {
            "cv": S.variation(F.col("fc_mean"), F.col("_std")),
            "r_kinetic": S.retention(F.col("fc_mean"), F.col("_std"), cfg),
            "score_temporal": S.temporal_score(F.col("t_rise_avg"), cfg),
        }
    ).drop("_std")
    return (
        scored.join(max_burden(traj, "design", target), "design_id", "left")
        .withColumn("max_burden", F.coalesce("max_burden", F.lit(0.0)))
        .withColumn("p_burden", S.burden_penalty(F.col("max_burden"), cfg))
        .withColumn("kinetic_multiplier", F.col("r_kinetic") * F.col("score_temporal") * F.col("p_burden"))
    )


# --- plausibility ------------------------------------------------------------------------


def repeat_counts(parts: DataFrame) -> DataFrame:
    """Listed and distinct parts per design; copies of a part collapse before the shuffle."""
    per_part = parts.groupBy("design_id", "part").agg(F.count(F.lit(1)).alias("_n"))
    return per_part.groupBy("design_id").agg(
        F.sum("_n").alias("n_parts"), F.count(F.lit(1)).alias("n_distinct")
    ).withColumn("n_repeats", F.col("n_parts") - F.col("n_distinct"))


def plausibility(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Complexity penalty times repeat penalty; what a design lacks counts as 0."""
    node_counts = nodes.groupBy("design_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    edge_counts = edges.groupBy("design_id").agg(F.count(F.lit(1)).alias("n_edges"))
    joined = node_counts.join(edge_counts, "design_id", "full").join(
        repeat_counts(parts).select("design_id", "n_repeats"), "design_id", "full"
    )
    zero = F.lit(0).cast("long")
    filled = joined.select(
        "design_id", *[F.coalesce(c, zero).alias(c) for c in ("n_nodes", "n_edges", "n_repeats")]
    )
    return filled.withColumn(
        "c_plausibility",
        S.ockham(F.col("n_nodes"), F.col("n_edges")) * S.repeat_penalty(F.col("n_repeats")),
    )


def first_repeat(parts: DataFrame) -> DataFrame:
    """The part whose second occurrence comes first in the list of a design."""
    seen = Window.partitionBy("design_id", "part").orderBy("pos")
    second = parts.withColumn("_rn", F.row_number().over(seen)).where("_rn = 2")
    return second.groupBy("design_id").agg(F.min_by("part", "pos").alias("first_repeat"))


# --- viability ---------------------------------------------------------------------------


def viability(
    plausible: DataFrame, functional: DataFrame, kinetic: DataFrame, cfg: ViabilityConfig = ViabilityConfig()
) -> DataFrame:
    """Product of all scores and its rating; a design without levels or samples gets ``error`` instead."""
    joined = plausible.join(functional, "design_id", "full").join(kinetic.drop("fc_mean"), "design_id", "full")
    error = F.when(F.col("r_kinetic").isNull(), F.lit("no samples")).when(
        F.col("score_functional").isNull(), F.lit("no steady states")
    )
    plausible_or_one = F.coalesce("c_plausibility", F.lit(1.0))
    total = (
        F.col("score_functional") * F.col("c_plausibility") * F.col("r_kinetic") * F.col("p_burden") * F.col("score_temporal")
    )
    scored = joined.withColumn("c_plausibility", plausible_or_one).withColumn("error", error)
    return scored.withColumn("total_score", F.when(F.col("error").isNull(), total)).withColumn(
        "rating", F.when(F.col("error").isNull(), S.rating(F.col("total_score"), cfg))
    )


def nest_report(scored: DataFrame) -> DataFrame:
    """The nested report: rating, total, multipliers and one struct per module."""
    return scored.select(
        "design_id",
        F.col("rating").alias("evaluation_rating"),
        F.col("total_score").alias("total_viability_score"),
        F.struct("score_functional", "c_plausibility", "r_kinetic", "p_burden", "score_temporal").alias("multipliers"),
        F.struct(
            F.struct("c_plausibility").alias("static_plausibility"),
            F.struct(
                F.col("score_functional").alias("total_functional_score"),
                F.col("compliance").alias("compliance_multiplier"),
                "fc_score",
                "margin_score",
                F.struct("min_on", "max_off", "fold_change").alias("raw_metrics"),
            ).alias("functional_correctness"),
            F.struct(
                F.col("r_kinetic").alias("r_kinetic_retention"),
                "score_temporal",
                "p_burden",
                "kinetic_multiplier",
                F.struct("cv", "max_burden", "t_rise_avg").alias("raw_metrics"),
            ).alias("kinetic_robustness"),
        ).alias("module_reports"),
    )


def flatten_report(report: DataFrame) -> DataFrame:
    """The 13 scalars of a nested report."""
    functional = "module_reports.functional_correctness.raw_metrics"
    kinetic = "module_reports.kinetic_robustness.raw_metrics"
    return report.select(
        "design_id",
        F.col("total_viability_score").alias("total_score"),
        F.col("evaluation_rating").alias("rating"),
        *[F.col(f"multipliers.{c}").alias(c) for c in
          ("c_plausibility", "score_functional", "r_kinetic", "p_burden", "score_temporal")],
        *[F.col(f"{functional}.{c}").alias(f"metrics_{c}") for c in ("fold_change", "min_on", "max_off")],
        *[F.col(f"{kinetic}.{c}").alias(f"metrics_{c}") for c in ("cv", "max_burden", "t_rise_avg")],
    )


def penalty_reasons(flat: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """Add ``penalty_codes`` and ``penalty_reasons``, in fixed order.

    ``repeats`` is (design_id, first_repeat) over the part lists; without part lists the
    plausibility reason stays general.
    """
    if repeats is not None:
        flat = flat.join(repeats, "design_id", "left")
        found = F.col("first_repeat").isNotNull()
        code = F.when(found, F.lit("repeat")).otherwise(F.lit("complexity"))
        text = F.when(found, F.format_string(PENALTY_TEXT["repeat"], F.col("first_repeat").cast("string"))).otherwise(
            F.lit(PENALTY_TEXT["complexity"])
        )
    else:
        code, text = F.lit("plausibility"), F.lit(PENALTY_TEXT["plausibility"])
    rules = [(F.col("c_plausibility") < 1.0, code, text)]
    for name, score, bound, metric in (
        ("functional", "score_functional", 80.0, "metrics_fold_change"),
        ("kinetic", "r_kinetic", 0.9, "metrics_cv"),
        ("burden", "p_burden", 0.9, "metrics_max_burden"),
        ("temporal", "score_temporal", 0.9, "metrics_t_rise_avg"),
    ):
        rules.append((F.col(score) < bound, F.lit(name), F.format_string(PENALTY_TEXT[name], F.col(metric))))
    return flat.withColumn("penalty_codes", F.array_compact(F.array(*[F.when(c, k) for c, k, _ in rules]))).withColumn(
        "penalty_reasons", F.array_compact(F.array(*[F.when(c, t) for c, _, t in rules]))
    )


def render_report(flat: DataFrame, full: bool = True) -> DataFrame:
    """Markdown per design from flat metrics; the full form adds status flags and reasons."""

    def flag(name: str, bound: float, bad: str) -> Column:
        return F.when(F.col(name) > bound, F.lit("🟢")).otherwise(F.lit(bad))

    head = [
        F.lit("# Circuit benchmark report"),
        F.format_string("- **Total score:** `%.2f / 100`", F.col("total_score")),
        F.format_string("- **Rating:** **%s**", F.col("rating")),
        F.lit(""),
    ]
    rows = [
        ("Static plausibility", "c_plausibility", "%.4f", 0.9, "🟡"),
        ("Functional correctness", "score_functional", "%.2f", 80.0, "🔴"),
        ("Kinetic robustness", "r_kinetic", "%.4f", 0.9, "🟡"),
        ("Burden control", "p_burden", "%.4f", 0.9, "🔴"),
        ("Temporal efficiency", "score_temporal", "%.4f", 0.9, "🟡"),
    ]
    metrics = [
        F.format_string(
            "- Fold change: `%.2f` (min ON `%.1f` nM, max OFF `%.1f` nM)",
            F.col("metrics_fold_change"), F.col("metrics_min_on"), F.col("metrics_max_off"),
        ),
        F.format_string("- CV under noise: `%.4f`", F.col("metrics_cv")),
        F.format_string("- Max burden: `%.1f` nM", F.col("metrics_max_burden")),
        F.format_string("- Average rise time: `%.1f` s", F.col("metrics_t_rise_avg")),
    ]
    if full:
        table = [F.lit("| Module | Value | Status |"), F.lit("| :--- | :--- | :--- |")] + [
            F.concat(F.lit(f"| {label} | `"), F.format_string(fmt, F.col(c)), F.lit("` | "), flag(c, bound, bad), F.lit(" |"))
            for label, c, fmt, bound, bad in rows
        ]
        reasons = F.when(F.size("penalty_reasons") == 0, F.lit("- no major penalty")).otherwise(
            F.array_join(F.transform("penalty_reasons", lambda r: F.concat(F.lit("- "), r)), "\n")
        )
        lines = head + table + [F.lit("")] + metrics + [F.lit(""), reasons]
    else:
        lines = head + [
            F.concat(F.lit(f"- {label}: `"), F.format_string(fmt, F.col(c)), F.lit("`")) for label, c, fmt, _, _ in rows
        ] + metrics
    return flat.select("design_id", F.concat_ws("\n", *lines).alias("report"))


# --- verdicts ----------------------------------------------------------------------------


def state_levels(traj: DataFrame, target: str) -> DataFrame:
    """Steady state of the target per (design, sample, state), and whether the state has the target at all."""
    hit = is_target(target)
    return traj.groupBy(*SAMPLE, "state_name").agg(
        F.avg(F.when(hit & in_tail(0.9), F.col("value"))).alias("value"), F.max(hit).alias("has_target")
    )


def levels_and_burden(traj: DataFrame, target: str) -> DataFrame:
    """As :func:`state_levels`, with the largest total protein level of the state; one pass over the points."""
    hit = is_target(target)
    tail = F.when(hit & in_tail(0.9), F.col("value"))
    by_point = traj.groupBy(*SAMPLE, "state_name", "seq").agg(
        F.sum(F.when(is_protein(), F.col("value"))).alias("_burden"),
        F.sum(tail).alias("_sum"),
        F.count(tail).alias("_n"),
        F.max(hit).alias("_hit"),
    )
    return by_point.groupBy(*SAMPLE, "state_name").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("value"),
        F.max("_hit").alias("has_target"),
        F.greatest(F.coalesce(F.max("_burden"), F.lit(0.0)), F.lit(0.0)).alias("max_burden"),
    )


def verdict_from_levels(levels: DataFrame, spec: DataFrame, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    """Truth-table verdict per sample from levels (design, sample, state, value[, has_target]).

    States missing from a sample count as level 0; a sample with a state that lacks the
    target species fails with score 0, and so does one without any truth table.
    """
    if "has_target" not in levels.columns:
        levels = levels.withColumn("has_target", F.lit(True))
    carried = [F.max(c).alias(c) for c in ("max_burden",) if c in levels.columns]
    on, other = F.col("expected") == 1, F.col("expected") != 1
    seen = (
        levels.join(spec, ["design_id", "state_name"], "left")
        .groupBy(*SAMPLE)
        .agg(
            F.min("has_target").alias("has_target"),
            F.count_if(on & (level() < cfg.on)).alias("_logic"),
            F.count_if(other & (level() > cfg.off)).alias("_leak"),
            F.min(F.when(on, level())).alias("_low"),
            F.max(F.when(other, level())).alias("_high"),
            F.count_if(on).alias("_on"),
            F.count_if(other).alias("_off"),
            *carried,
        )
    )
    wanted = spec.groupBy("design_id").agg(F.count_if(on).alias("_want_on"), F.count_if(other).alias("_want_off"))
    # states without a level stand at 0: they miss every ON threshold above 0 and pull both extremes to 0
    no_on, no_off = F.col("_want_on") - F.col("_on"), F.col("_want_off") - F.col("_off")
    zero, count = F.lit(0.0), F.lit(0).cast("long")
    judged = seen.join(wanted, "design_id", "left").withColumns(
        {
            "logic_failures": F.col("_logic") + (no_on if cfg.on > 0 else count),
            "leak_failures": F.col("_leak") + (no_off if cfg.off < 0 else count),
            "_low": F.coalesce(F.when(no_on > 0, F.least("_low", zero)).otherwise(F.col("_low")), F.lit(float("inf"))),
            "_high": F.coalesce(F.when(no_off > 0, F.greatest("_high", zero)).otherwise(F.col("_high")), F.lit(float("-inf"))),
            "evaluated": F.col("has_target") & F.col("_want_on").isNotNull(),
        }
    )
    clean = (F.col("logic_failures") == 0) & (F.col("leak_failures") == 0)
    partial = F.greatest(zero, F.lit(100.0) - 20 * F.col("logic_failures") - 10 * F.col("leak_failures"))
    return (
        judged.withColumn("fold_change", F.when(F.col("evaluated"), _verdict_fold(F.col("_low"), F.col("_high"), cfg.zero_off)).otherwise(zero))
        .withColumn("pass", F.col("evaluated") & clean & (F.col("fold_change") >= cfg.on / cfg.off))
        .withColumn("pass", F.coalesce("pass", F.lit(False)))
        .withColumn("score", F.when(~F.col("evaluated"), zero).when(F.col("pass"), F.lit(100.0)).otherwise(partial))
        .select(
            *SAMPLE,
            "pass",
            "score",
            "fold_change",
            *[F.when(F.col("evaluated"), F.col(c)).otherwise(count).alias(c) for c in ("logic_failures", "leak_failures")],
            "evaluated",
            *[c for c in ("max_burden",) if c in levels.columns],
        )
    )


def verdict(traj: DataFrame, spec: DataFrame, target: str, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    return verdict_from_levels(state_levels(traj, target), spec, cfg)


def verdict_failures(levels: DataFrame, spec: DataFrame, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    """One row per failed state with its level and the threshold it missed."""
    rows = join_spec(levels.drop("has_target"), spec, "left", 0.0, SAMPLE)
    on = F.col("expected") == 1
    kind = F.when(on & (level() < cfg.on), F.lit("ON")).when(~on & (level() > cfg.off), F.lit("OFF"))
    return rows.withColumn("failed", kind).where("failed is not null").select(
        *SAMPLE,
        "state_name",
        "failed",
        "value",
        F.when(F.col("failed") == "ON", F.lit(cfg.on)).otherwise(F.lit(cfg.off)).alias("threshold"),
    )


def two_decimals(x: Column) -> Column:
    """A number as text with two decimals, ties of the binary value to the even digit."""
    text = F.call_function("format_number", x, F.lit("0.00"))
    return F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).otherwise(text)


def verdict_feedback(levels: DataFrame, spec: DataFrame, target: str, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    """The verdict of every sample with ``feedback``: what each failed state missed and what to change.

    Leaking states come before silent ones, each kind by name. A sample without truth table or without the target
    in one of its states says so instead.
    """
    off = F.col("failed") == "OFF"
    line = F.when(
        off, F.format_string(FEEDBACK_TEXT["leak"], "state_name", two_decimals(F.col("value")), F.lit(str(cfg.off)))
    ).otherwise(F.format_string(FEEDBACK_TEXT["logic"], "state_name", two_decimals(F.col("value")), F.lit(str(cfg.on))))
    failed = verdict_failures(levels, spec, cfg).groupBy(*SAMPLE).agg(
        # the states of one circuit
        F.array_sort(F.collect_list(F.struct(F.when(off, 0).otherwise(1).alias("kind"), "state_name", line.alias("line")))).alias("_failed")
    )
    tables = spec.select("design_id").distinct().withColumn("_spec", F.lit(True))
    judged = verdict_from_levels(levels, spec, cfg).join(failed, list(SAMPLE), "left").join(tables, "design_id", "left")
    advice = lambda count, name: F.when(F.col(count) > 0, F.lit(FEEDBACK_TEXT[name])).otherwise(F.lit(""))
    fold = two_decimals(F.col("fold_change"))
    states = F.concat(
        F.lit(FEEDBACK_TEXT["prefix"]),
        F.array_join(F.transform("_failed", lambda f: f["line"]), " "),
        F.format_string(FEEDBACK_TEXT["fold"], fold),
        advice("leak_failures", "leak_advice"),
        advice("logic_failures", "logic_advice"),
    )
    feedback = (
        F.when(F.col("_spec").isNull(), F.lit(FEEDBACK_TEXT["empty"]))
        .when(~F.col("evaluated"), F.lit(FEEDBACK_TEXT["no_target"] % target))
        .when(F.col("pass"), F.lit(FEEDBACK_TEXT["pass"]))
        .when(F.col("_failed").isNotNull(), states)
        .otherwise(F.format_string(FEEDBACK_TEXT["weak_fold"], fold))
    )
    return judged.withColumn("feedback", feedback).drop("_failed", "_spec")


def sample_feedback(outcomes: DataFrame, feedback: DataFrame, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    """One message per failed sample: its burden where it is toxic, else the feedback of its verdict."""
    burden = F.format_string(FEEDBACK_TEXT["sample_burden"], two_decimals(F.col("max_burden")), F.lit(str(cfg.toxicity)))
    failed = outcomes.where(~F.col("pass")).join(feedback.select(*SAMPLE, "feedback"), list(SAMPLE), "left")
    body = F.when(F.col("toxic"), burden).otherwise(F.col("feedback"))
    return failed.select(
        *SAMPLE, "toxic", F.format_string(FEEDBACK_TEXT["sample"], F.col("sample_id").cast("string"), body).alias("message")
    )


def mc_feedback(
    verdicts: DataFrame, noise: float = 0.05, iterations: int = 10, cfg: VerdictConfig = VerdictConfig()
) -> DataFrame:
    """Rows of ``mc_verdict`` (made with the same arguments) with the text of their decision."""
    death = F.when(F.col("expects_death"), F.lit(MC_TEXT["death"])).otherwise(F.lit(""))
    rate = F.bround("score", 0).cast("long").cast("string")
    run = [F.lit(f"{noise * 100:.0f}"), F.lit(str(iterations)), rate, F.lit(str(cfg.pass_threshold))]
    is_reason = lambda name: F.col("reason") == name
    if iterations == 1 or noise == 0.0:
        passed = F.format_string(MC_TEXT["quiet pass"], death)
    else:
        passed = F.format_string(MC_TEXT["pass"], *run, death)
    n, toxic = F.col("n_samples").cast("string"), F.col("toxicity_failures").cast("string")
    return verdicts.withColumn(
        "feedback",
        F.when(is_reason("pass"), passed)
        .when(is_reason("mostly toxic"), F.format_string(MC_TEXT["mostly toxic"], n, toxic, F.lit(str(cfg.toxicity))))
        .when(is_reason("not robust"), F.format_string(MC_TEXT["not robust"], *run))
        .when(is_reason("no samples"), F.lit(MC_TEXT["no samples"]))
        .when(is_reason("toxic"), F.lit(MC_TEXT["toxic"]))
        .when(is_reason("logic"), F.lit(MC_TEXT["logic"])),
    )


def sample_outcomes(
    traj: DataFrame, spec: DataFrame, target: str, cfg: VerdictConfig = VerdictConfig(), intents: DataFrame | None = None
) -> DataFrame:
    """Verdict and toxicity per sample; ``intents`` is (design_id, expects_death)."""
    outcomes = verdict_from_levels(levels_and_burden(traj, target), spec, cfg)
    if intents is not None:
        outcomes = outcomes.join(intents.select("design_id", "expects_death"), "design_id", "left")
    else:
        outcomes = outcomes.withColumn("expects_death", F.lit(False))
    toxic = (F.coalesce("max_burden", F.lit(0.0)) > cfg.toxicity) & ~F.coalesce("expects_death", F.lit(False))
    return outcomes.withColumn("toxic", toxic).withColumn("pass", F.col("pass") & ~F.col("toxic"))


def mc_verdict(
    outcomes: DataFrame,
    noise: float = 0.05,
    iterations: int = 10,
    cfg: VerdictConfig = VerdictConfig(),
    designs: DataFrame | None = None,
) -> DataFrame:
    """Verdict over all samples of a design: pass rate, toxicity count and the reason of the decision.

    ``designs`` (design_id) names those that must have a row; one without samples fails with score 0.
    """
    counts = outcomes.groupBy("design_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if("pass").alias("n_pass"),
        F.count_if("toxic").alias("toxicity_failures"),
        F.max(F.coalesce("expects_death", F.lit(False))).alias("expects_death"),
    )
    if designs is not None:
        counts = designs.select("design_id").distinct().join(counts, "design_id", "left").fillna(
            {"n_samples": 0, "n_pass": 0, "toxicity_failures": 0, "expects_death": False}
        )
    rate = F.coalesce(F.try_divide("n_pass", "n_samples"), F.lit(0.0))
    none = F.when(F.col("n_samples") == 0, F.lit("no samples"))
    if iterations == 1 or noise == 0.0:
        reason = (
            none.when(F.col("toxicity_failures") > 0, F.lit("toxic"))
            .when(rate * 100.0 >= 100.0, F.lit("pass"))
            .otherwise(F.lit("logic"))
        )
    else:
        reason = (
            none.when(F.col("toxicity_failures") > F.col("n_samples") * 0.5, F.lit("mostly toxic"))
            .when(rate * 100.0 >= cfg.pass_threshold, F.lit("pass"))
            .otherwise(F.lit("not robust"))
        )
    return counts.withColumns({"pass_rate": rate, "score": rate * 100.0, "reason": reason}).withColumn(
        "pass", F.col("reason") == "pass"
    )


def failure_messages(outcomes: DataFrame, cfg: VerdictConfig = VerdictConfig()) -> DataFrame:
    """One message per failed sample."""
    message = F.when(
        F.col("toxic"),
        F.format_string(f"sample %d: UNINTENDED_BURDEN (max burden %.2f > {cfg.toxicity})", F.col("sample_id"), F.col("max_burden")),
    ).otherwise(
        F.format_string(
            "sample %d: %d logic and %d leakage failures, fold change %.2f",
            F.col("sample_id"), F.col("logic_failures"), F.col("leak_failures"), F.col("fold_change"),
        )
    )
    return outcomes.where(~F.col("pass")).withColumn("message", message)


def failure_sample(messages: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` failure messages of each design by sample."""
    order = Window.partitionBy("design_id").orderBy("sample_id")
    return messages.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


# --- scorer plug-ins ---------------------------------------------------------------------

SCORERS: dict[str, Callable[..., DataFrame]] = {}


def scorer(name: str):
    """Register a function that takes the tables it needs by keyword and gives one row per design."""

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SCORERS[name] = fn
        return fn

    return register


def run_scorers(tables: dict[str, object], names: list[str] | None = None) -> DataFrame:
    """Run registered scorers over the same tables and join their results by design."""
    results = [SCORERS[name](**tables) for name in (names or list(SCORERS))]
    joined = results[0]
    for result in results[1:]:
        shared = [c for c in result.columns if c in joined.columns and c != "design_id"]
        joined = joined.join(result.drop(*shared), "design_id", "full")
    return joined


@scorer("plausibility")
def _plausibility_scorer(nodes, edges, parts, **_):
    return plausibility(nodes, edges, parts)


@scorer("functional")
def _functional_scorer(matched, config: ViabilityConfig = ViabilityConfig(), **_):
    return functional_score(matched, config.functional)


@scorer("kinetic")
def _kinetic_scorer(traj, spec, target, config: ViabilityConfig = ViabilityConfig(), **_):
    return kinetic_score(traj, spec, target, config.kinetic)
