"""Queries over levels, verdicts and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.config import FEEDBACK_TEXT, MC_TEXT, FunctionalConfig, KineticConfig, VerdictConfig, ViabilityConfig
from geneweft.functions import scores as S
from geneweft.functions.text import expects_death
from geneweft.operators import scoring as O
from geneweft.operators import series
from geneweft.plans import views as V
from geneweft.plans.registry import SQL, prepared, query, table

# The readings lie between 98 and 992, so the thresholds are moved there.
VERDICT = VerdictConfig(on=350.0, off=650.0, toxicity=7000.0)
FUNCTIONAL = FunctionalConfig(on=350.0, off=650.0, k_ideal=1.0)
KINETIC = KineticConfig(on=350.0, limit_soft=6000.0, fc_ideal=1.0, t_target=43200.0)
VIABILITY = ViabilityConfig(functional=FUNCTIONAL, kinetic=KINETIC)
SAMPLE = series.SAMPLE


def levels(spark, sf, view="t1d"):
    return levels_of(V.points(spark, sf, view))


def levels_of(points):
    """Steady state of the target per (design, sample, state)."""
    target = points.where(series.is_target(V.TARGET))
    return series.steady_state(target).select(*SAMPLE, "state_name", F.col("steady_state").alias("value"))


def matched(spark, sf, view="t1d", spec=V.SPEC):
    return O.join_spec(levels(spark, sf, view), V.spec_for(spark, sf, view, spec), "inner")


def levels_sql(view="t1d"):
    return f"""levels as (select design_id, sample_id, state_name, avg(value) as value from {view}
      where species = 'purchase' and kind = 'protein' and seq >= cast(floor(n_points * cast(0.9 as double)) as bigint) group by all)"""


def base_sql(view="t1d", spec=V.SPEC):
    return (V.points_sql(view), V.spec_sql(view, spec), levels_sql(view))


MATCHED_SQL = "matched as (select l.design_id, l.sample_id, l.state_name, l.value, s.expected from levels l join spec s using (design_id, state_name))"
ONOFF_SQL = """onoff as (select design_id, sample_id, coalesce(min(value) filter (expected = 1), 0) as min_on,
      coalesce(max(value) filter (expected = 0), 0) as max_off, count(*) filter (expected = 1) as n_on,
      count(*) filter (expected = 0) as n_off,
      coalesce(product(case when expected = 1 then 1 / (1 + exp(cast(-0.01 as double) * (value - 350)))
        when expected = 0 then 1 / (1 + exp(cast(0.01 as double) * (value - 650))) end), 1) as compliance
      from matched group by all)"""
FUNCTIONAL_SQL = """scored as (select *, case when n_on > 0 and n_off > 0 then min_on / (max_off + cast(1e-6 as double)) else 0 end as fold_change from onoff),
    functional as (select *, case when n_on > 0 and n_off > 0 then 100 * pow(fold_change, 2) / (1 + pow(fold_change, 2)) else 0 end as fc_score,
      (case when n_on > 0 then 50 * (1 - exp(cast(-0.001 as double) * greatest(0, min_on - 350))) else 0 end)
      + (case when n_off > 0 then 50 * exp(cast(-0.02 as double) * max_off) else 0 end) as margin_score from scored)"""
ALL_FUNCTIONAL = (*base_sql(), MATCHED_SQL, ONOFF_SQL, FUNCTIONAL_SQL)


@query(
    "spec_left_join",
    V.with_sql(*base_sql(spec=V.SPEC_PARTIAL))
    + """select s.design_id, g.sample_id, s.state_name, s.expected, round(coalesce(l.value, 0), 6) as value
      from spec s left join (select distinct design_id, sample_id from levels) g using (design_id)
      left join levels l on l.design_id = g.design_id and l.sample_id = g.sample_id and l.state_name = s.state_name""",
)
def _left(spark, sf):
    spec = V.spec_for(spark, sf, "t1d", V.SPEC_PARTIAL)
    return O.join_spec(levels(spark, sf), spec, "left", 0.0, SAMPLE)


@query(
    "spec_inner_join",
    V.with_sql(*base_sql(spec=V.SPEC_PARTIAL), MATCHED_SQL)
    + "select design_id, sample_id, state_name, expected, round(value, 6) as value from matched",
)
def _inner(spark, sf):
    return matched(spark, sf, spec=V.SPEC_PARTIAL)


@query(
    "on_off_levels",
    V.with_sql(*ALL_FUNCTIONAL)
    + "select design_id, sample_id, round(min_on, 6) as min_on, round(max_off, 6) as max_off, n_on, n_off from onoff",
)
def _onoff(spark, sf):
    return O.on_off_levels(matched(spark, sf), SAMPLE)


@query(
    "fold_change_verdict",
    V.with_sql(*base_sql(spec=V.SPEC_PARTIAL), MATCHED_SQL)
    + """select design_id, sample_id, round(case when max(value) filter (expected <> 1) > 0 then
        coalesce(min(value) filter (expected = 1), cast('inf' as double)) / max(value) filter (expected <> 1) else 0 end, 6) as fold_change
      from matched group by all""",
)
def _fold_verdict(spark, sf):
    return O.fold_change(matched(spark, sf, spec=V.SPEC_PARTIAL), "verdict", SAMPLE)


@query(
    "fold_change_functional",
    V.with_sql(*ALL_FUNCTIONAL) + "select design_id, sample_id, round(fold_change, 6) as fold_change from functional",
)
def _fold_functional(spark, sf):
    return O.fold_change(matched(spark, sf), "functional", SAMPLE)


LAST_SQL = "last_level as (select design_id, sample_id, state_name, arg_max(value, seq) as value from {view} where species = 'purchase' and kind = 'protein' group by all)"
FOLD_K_SQL = """fold_k as (select l.design_id, l.sample_id, case when count(*) filter (expected = 1) > 0 and count(*) filter (expected = 0) > 0
        then min(value) filter (expected = 1) / (max(value) filter (expected = 0) + cast(1e-6 as double)) else 1 end as fold_change
      from last_level l left join spec s using (design_id, state_name) group by all)"""
ROBUST_SQL = """robust as (select design_id, avg(fold_change) as fc_mean,
      case when avg(fold_change) > 0 then stddev_pop(fold_change) / avg(fold_change) else 0 end as cv from fold_k group by all),
    retained as (select *, exp(-2 * cv) * least(1, fc_mean / 1.0e0) as r_kinetic from robust)"""
TEMPORAL_SQL = """rises as (select design_id, sample_id, state_name, coalesce(min(time) filter (value >= 350), max(time)) as rise
      from {view} where species = 'purchase' and kind = 'protein' group by all),
    temporal as (select r.design_id, coalesce(avg(rise) filter (expected = 1), 0) as t_rise_avg
      from rises r left join spec s using (design_id, state_name) group by all),
    timed as (select *, exp(-ln(2) / 43200 * t_rise_avg) as score_temporal from temporal)"""
BURDEN_SQL = """burden as (select design_id, greatest(coalesce(max(b), 0), 0) as max_burden from (select design_id, sample_id, state_name, seq,
      sum(value) filter (species <> 'purchase' and kind = 'protein') as b from {view} group by all) group by all),
    taxed as (select *, 1 / (1 + exp(least(500, greatest(-500, cast(0.001 as double) * (max_burden - 6000))))) as p_burden from burden)"""


def kinetic_sql(view):
    return (
        LAST_SQL.format(view=view), FOLD_K_SQL, ROBUST_SQL, TEMPORAL_SQL.format(view=view), BURDEN_SQL.format(view=view),
        """kinetic as (select design_id, fc_mean, cv, r_kinetic, t_rise_avg, score_temporal, coalesce(max_burden, 0) as max_burden,
          coalesce(p_burden, 1 / (1 + exp(cast(0.001 as double) * -6000))) as p_burden
          from retained join timed using (design_id) left join taxed using (design_id))""",
    )


KINETIC_BASE = (V.points_sql("t1d"), V.spec_sql("t1d"), *kinetic_sql("t1d"))


@query(
    "fold_change_kinetic",
    V.with_sql(*KINETIC_BASE) + "select design_id, sample_id, round(fold_change, 6) as fold_change from fold_k",
)
def _fold_kinetic(spark, sf):
    points = V.points(spark, sf, "t1d")
    joined = O.last_levels(points, V.TARGET).join(V.spec_for(spark, sf, "t1d"), ["design_id", "state_name"], "left")
    return O.fold_change(joined, "kinetic", SAMPLE)


@query(
    "logic_compliance",
    V.with_sql(*ALL_FUNCTIONAL) + "select design_id, sample_id, round(compliance, 6) as compliance from onoff",
)
def _compliance(spark, sf):
    return O.logic_compliance(matched(spark, sf), FUNCTIONAL, SAMPLE)


@query(
    "fold_change_score",
    V.with_sql(*ALL_FUNCTIONAL) + "select design_id, sample_id, round(fc_score, 6) as fc_score from functional",
)
def _fc_score(spark, sf):
    return O.functional_score(matched(spark, sf), FUNCTIONAL, SAMPLE).select(*SAMPLE, "fc_score")


@query(
    "margin_score",
    V.with_sql(*ALL_FUNCTIONAL) + "select design_id, sample_id, round(margin_score, 6) as margin_score from functional",
)
def _margin(spark, sf):
    return O.functional_score(matched(spark, sf), FUNCTIONAL, SAMPLE).select(*SAMPLE, "margin_score")


@query(
    "functional_score",
    V.with_sql(*ALL_FUNCTIONAL)
    + """select design_id, sample_id, round(fold_change, 6) as fold_change, round(fc_score, 6) as fc_score,
      round(margin_score, 6) as margin_score, round(compliance, 6) as compliance,
      round(compliance * (cast(0.6 as double) * fc_score + cast(0.4 as double) * margin_score), 6) as score_functional from functional""",
)
def _functional(spark, sf):
    return O.functional_score(matched(spark, sf), FUNCTIONAL, SAMPLE).select(
        *SAMPLE, "fold_change", "fc_score", "margin_score", "compliance", "score_functional"
    )


@query(
    "robustness",
    V.with_sql(*KINETIC_BASE)
    + "select design_id, round(fc_mean, 6) as fc_mean, round(cv, 6) as cv, round(r_kinetic, 6) as r_kinetic from retained",
)
def _robustness(spark, sf):
    points = V.points(spark, sf, "t1d")
    return O.robustness(points, V.spec_for(spark, sf, "t1d"), V.TARGET, KINETIC)


@query(
    "temporal_score",
    V.with_sql(*KINETIC_BASE)
    + "select design_id, round(t_rise_avg, 6) as t_rise_avg, round(score_temporal, 6) as score_temporal from timed",
)
def _temporal(spark, sf):
    points = V.points(spark, sf, "t1d")
    return O.temporal(points, V.spec_for(spark, sf, "t1d"), V.TARGET, KINETIC)


@query(
    "burden_penalty",
    V.with_sql(*KINETIC_BASE)
    + "select design_id, round(max_burden, 6) as max_burden, round(p_burden, 6) as p_burden from taxed",
)
def _burden(spark, sf):
    return O.burden(V.points(spark, sf, "t1d"), V.TARGET, KINETIC)


@query(
    "kinetic_score",
    V.with_sql(*KINETIC_BASE)
    + """select design_id, round(fc_mean, 6) as fc_mean, round(cv, 6) as cv, round(r_kinetic, 6) as r_kinetic,
      round(t_rise_avg, 6) as t_rise_avg, round(score_temporal, 6) as score_temporal, round(max_burden, 6) as max_burden,
      round(p_burden, 6) as p_burden, round(r_kinetic * score_temporal * p_burden, 6) as kinetic_multiplier from kinetic""",
)
def _kinetic(spark, sf):
    points = V.points(spark, sf, "t1d")
    return O.kinetic_score(points, V.spec_for(spark, sf, "t1d"), V.TARGET, KINETIC)


# --- plausibility and viability: one design per user or order ----------------------------

PLAUSIBLE_SQL = (
    V.NODES_SQL, V.LINES_SQL, V.EDGES_SQL, V.PARTS_SQL,
    """plausible as (select design_id, coalesce(n_nodes, 0) as n_nodes, coalesce(n_edges, 0) as n_edges, coalesce(n_repeats, 0) as n_repeats,
      exp(cast(-0.1 as double) * greatest(0, coalesce(n_nodes, 0) + cast(0.5 as double) * coalesce(n_edges, 0) - cast(5.5 as double)))
        * pow(cast(0.6 as double), coalesce(n_repeats, 0)) as c_plausibility
      from (select design_id, count(*) as n_nodes from t7n group by all)
      full join (select design_id, count(*) as n_edges from t7e group by all) using (design_id)
      full join (select design_id, count(*) - count(distinct part) as n_repeats from t7p group by all) using (design_id))""",
    """repeated as (select design_id, arg_min(part, pos) as first_repeat from (select design_id, part, pos,
      row_number() over (partition by design_id, part order by pos) as rn from t7p) where rn = 2 group by all)""",
)
VIABLE_SQL = (
    *PLAUSIBLE_SQL, V.points_sql("t1u"), V.spec_sql("t1u"), levels_sql("t1u").replace("levels as", "sample_levels as"),
    "levels as (select design_id, 0 as sample_id, state_name, avg(value) as value from sample_levels group by all)",
    MATCHED_SQL, ONOFF_SQL, FUNCTIONAL_SQL, *kinetic_sql("t1u"),
    """viable as (select coalesce(p.design_id, f.design_id, k.design_id) as design_id, coalesce(c_plausibility, 1) as c_plausibility,
      compliance * (cast(0.6 as double) * fc_score + cast(0.4 as double) * margin_score) as score_functional,
      r_kinetic, p_burden, score_temporal, fold_change, min_on, max_off, cv, max_burden, t_rise_avg,
      case when r_kinetic is null then 'no samples' when fc_score is null then 'no steady states' end as error
      from plausible p full join functional f on p.design_id = f.design_id
      full join kinetic k on k.design_id = coalesce(p.design_id, f.design_id)),
    final as (select *, case when error is null then score_functional * c_plausibility * r_kinetic * p_burden * score_temporal end as total_score from viable),
    rated as (select *, case when error is not null then null when total_score >= 80 then 'Excellent' when total_score >= 60 then 'Pass' else 'Fail' end as rating from final)""",
)


def viable(spark, sf):
    points = V.points(spark, sf, "t1u")  # stored trajectories carry their positions
    spec = V.spec_for(spark, sf, "t1u")
    means = levels_of(points).groupBy("design_id", "state_name").agg(F.avg("value").alias("value"))
    functional = O.functional_score(O.join_spec(means, spec, "inner"), FUNCTIONAL)
    kinetic = O.kinetic_score(points, spec, V.TARGET, KINETIC)
    plausible = O.plausibility(V.nodes(spark, sf), V.unordered_parts(spark, sf), V.unordered_parts(spark, sf))
    return O.viability(plausible, functional, kinetic, VIABILITY)


@query(
    "plausibility",
    V.with_sql(*PLAUSIBLE_SQL)
    + "select design_id, n_nodes, n_edges, n_repeats, round(c_plausibility, 6) as c_plausibility from plausible",
)
def _plausibility(spark, sf):
    return O.plausibility(V.nodes(spark, sf), V.unordered_parts(spark, sf), V.unordered_parts(spark, sf))


@query("first_repeat", V.with_sql(*PLAUSIBLE_SQL) + "select design_id, first_repeat from repeated")
def _first_repeat(spark, sf):
    return O.first_repeat(V.parts(spark, sf))


@query(
    "viability",
    V.with_sql(*VIABLE_SQL)
    + """select design_id, round(score_functional, 6) as score_functional, round(c_plausibility, 6) as c_plausibility,
      round(r_kinetic, 6) as r_kinetic, round(p_burden, 6) as p_burden, round(score_temporal, 6) as score_temporal,
      round(total_score, 6) as total_score, rating, error from rated""",
)
def _viability(spark, sf):
    return viable(spark, sf).select(
        "design_id", "score_functional", "c_plausibility", "r_kinetic", "p_burden", "score_temporal", "total_score", "rating", "error"
    )


@query(
    "diagnostic_report",
    V.with_sql(*VIABLE_SQL)
    + """select design_id, round(total_score, 6) as total_score, rating, round(c_plausibility, 6) as c_plausibility,
      round(score_functional, 6) as score_functional, round(r_kinetic, 6) as r_kinetic, round(p_burden, 6) as p_burden,
      round(score_temporal, 6) as score_temporal, round(fold_change, 6) as metrics_fold_change, round(min_on, 6) as metrics_min_on,
      round(max_off, 6) as metrics_max_off, round(cv, 6) as metrics_cv, round(max_burden, 6) as metrics_max_burden,
      round(t_rise_avg, 6) as metrics_t_rise_avg from rated""",
)
def _diagnostic(spark, sf):
    return O.flatten_report(O.nest_report(viable(spark, sf)))


@query(
    "penalty_reasons",
    V.with_sql(*VIABLE_SQL)
    + """select r.design_id, concat_ws(',', case when c_plausibility < 1 then case when f.design_id is not null then 'repeat' else 'complexity' end end,
      case when score_functional < 80 then 'functional' end, case when r_kinetic < 0.9e0 then 'kinetic' end,
      case when p_burden < 0.9e0 then 'burden' end, case when score_temporal < 0.9e0 then 'temporal' end) as codes,
      f.first_repeat from rated r left join repeated f on f.design_id = r.design_id""",
)
def _penalties(spark, sf):
    flat = O.flatten_report(O.nest_report(viable(spark, sf)))
    reasons = O.penalty_reasons(flat, O.first_repeat(V.parts(spark, sf)))
    return reasons.select("design_id", F.array_join("penalty_codes", ",").alias("codes"), "first_repeat")


@query("benchmark_report")
def _report(spark, sf):
    """Markdown per design; the numbers behind it are compared in diagnostic_report."""
    flat = O.flatten_report(O.nest_report(viable(spark, sf)))
    return O.render_report(O.penalty_reasons(flat, O.first_repeat(V.parts(spark, sf))))


@query(
    "registered_scorers",
    V.with_sql(*VIABLE_SQL)
    + """select design_id, round(p.c_plausibility, 6) as c_plausibility,
      round(k.r_kinetic * k.score_temporal * k.p_burden, 6) as kinetic_multiplier
      from plausible p full join kinetic k using (design_id)""",
)
def _scorers(spark, sf):
    points = V.points(spark, sf, "t1u")
    tables = {
        "nodes": V.nodes(spark, sf), "edges": V.unordered_parts(spark, sf), "parts": V.unordered_parts(spark, sf),
        "traj": points, "spec": V.spec_for(spark, sf, "t1u"), "target": V.TARGET, "config": VIABILITY,
    }
    return O.run_scorers(tables, ["plausibility", "kinetic"]).select("design_id", "c_plausibility", "kinetic_multiplier")


@query(
    "rating",
    """select o_orderkey, case when s >= 80 then 'Excellent' when s >= 60 then 'Pass' else 'Fail' end as rating
      from (select o_orderkey, cast(floor(o_totalprice) as bigint) % 101 as s from orders)""",
)
def _rating(spark, sf):
    score = F.expr("cast(floor(o_totalprice) as bigint) % 101")
    return table(spark, sf, "orders").select("o_orderkey", S.rating(score).alias("rating"))


# --- verdicts ----------------------------------------------------------------------------

VERDICT_SQL = """states as (select design_id, sample_id, state_name, bool_or(species = 'purchase' and kind = 'protein') as has_target,
      coalesce(avg(value) filter (species = 'purchase' and kind = 'protein' and seq >= cast(floor(n_points * cast(0.9 as double)) as bigint)), 0) as value
      from t1d group by all),
    checked as (select g.design_id, g.sample_id, evaluated, count(*) filter (expected = 1 and coalesce(value, 0) < 350) as logic_failures,
      count(*) filter (expected <> 1 and coalesce(value, 0) > 650) as leak_failures,
      min(coalesce(value, 0)) filter (expected = 1) as low, max(coalesce(value, 0)) filter (expected <> 1) as high
      from (select design_id, sample_id, bool_and(has_target) as evaluated from states group by all) g join spec s using (design_id)
      left join states l on l.design_id = g.design_id and l.sample_id = g.sample_id and l.state_name = s.state_name group by all),
    folded as (select design_id, sample_id, evaluated, case when evaluated then logic_failures else 0 end as logic_failures,
      case when evaluated then leak_failures else 0 end as leak_failures,
      case when evaluated and high > 0 then low / high else 0 end as fold_change from checked),
    verdicts as (select *, evaluated and logic_failures = 0 and leak_failures = 0 and fold_change >= 350e0 / 650e0 as passed from folded),
    judged as (select *, case when not evaluated then 0e0 when passed then 100e0
      else greatest(0e0, 100e0 - 20 * logic_failures - 10 * leak_failures) end as score from verdicts)"""


@query(
    "verdict",
    V.with_sql(*base_sql(), VERDICT_SQL)
    + """select design_id, sample_id, passed as pass, round(score, 6) as score, round(fold_change, 6) as fold_change,
      logic_failures, leak_failures, evaluated from judged""",
)
def _verdict(spark, sf):
    points = V.points(spark, sf, "t1d")
    return O.verdict(points, V.spec_for(spark, sf, "t1d"), V.TARGET, VERDICT)


@query(
    "verdict_failures",
    V.with_sql(*base_sql(spec=V.SPEC_PARTIAL))
    + """select s.design_id, g.sample_id, s.state_name, case when expected = 1 then 'ON' else 'OFF' end as failed,
      round(coalesce(value, 0), 6) as value, case when expected = 1 then 350e0 else 650e0 end as threshold
      from spec s left join (select distinct design_id, sample_id from t1d) g using (design_id)
      left join levels l on l.design_id = g.design_id and l.sample_id = g.sample_id and l.state_name = s.state_name
      where (expected = 1 and coalesce(value, 0) < 350) or (expected <> 1 and coalesce(value, 0) > 650)""",
)
def _failures(spark, sf):
    points = V.points(spark, sf, "t1d")
    return O.verdict_failures(O.state_levels(points, V.TARGET), V.spec_for(spark, sf, "t1d", V.SPEC_PARTIAL), VERDICT)


# levels at six places, so that both engines print the same two
ROUNDED_SQL = VERDICT_SQL.replace("coalesce(avg(value)", "round(coalesce(avg(value)").replace(", 0) as value\n", ", 0), 6) as value\n")
_number = "' || printf('%.2f', {}) || '"


@query(
    "verdict_feedback",
    V.with_sql(
        *base_sql(),
        ROUNDED_SQL,
        f"""missed as (select s.design_id, g.sample_id, string_agg(case when expected = 1
          then '{FEEDBACK_TEXT["logic"] % ("' || s.state_name || '", _number.format("coalesce(value, 0)"), "350.0")}'
          else '{FEEDBACK_TEXT["leak"] % ("' || s.state_name || '", _number.format("coalesce(value, 0)"), "650.0")}' end, ' ' order by expected = 1, s.state_name) as lines
          from spec s join (select distinct design_id, sample_id from states) g using (design_id)
          left join states l on l.design_id = g.design_id and l.sample_id = g.sample_id and l.state_name = s.state_name
          where (expected = 1 and coalesce(value, 0) < 350) or (expected <> 1 and coalesce(value, 0) > 650) group by all)""",
    )
    + f"""select design_id, sample_id, passed as pass, case when not evaluated then '{(FEEDBACK_TEXT["no_target"] % V.TARGET).replace("'", "''")}'
      when passed then '{FEEDBACK_TEXT["pass"]}' when lines is not null then '{FEEDBACK_TEXT["prefix"]}' || lines
        || '{FEEDBACK_TEXT["fold"] % _number.format("fold_change")}' || case when leak_failures > 0 then '{FEEDBACK_TEXT["leak_advice"]}' else '' end
        || case when logic_failures > 0 then '{FEEDBACK_TEXT["logic_advice"]}' else '' end
      else '{FEEDBACK_TEXT["weak_fold"] % _number.format("fold_change")}' end as feedback from judged left join missed using (design_id, sample_id)""",
)
def _feedback(spark, sf):
    levels = O.state_levels(V.points(spark, sf, "t1d"), V.TARGET).withColumn("value", F.round("value", 6))
    spec = V.spec_for(spark, sf, "t1d")
    return O.verdict_feedback(levels, spec, V.TARGET, VERDICT).select("design_id", "sample_id", "pass", "feedback")


OUTCOME_SQL = """burdens as (select design_id, sample_id, greatest(coalesce(max(b), 0), 0) as max_burden from
      (select design_id, sample_id, state_name, seq, sum(value) filter (kind = 'protein') as b from t1d group by all) group by all),
    intents as (select doc_id as design_id, regexp_matches(lower(text), 'lysis|裂解|細胞死亡|suicide|cell death|死亡|凋亡|death') as expects_death from documents),
    outcomes as (select j.*, b.max_burden, coalesce(i.expects_death, false) as expects_death,
      b.max_burden > 7000 and not coalesce(i.expects_death, false) as toxic from judged j join burdens b using (design_id, sample_id)
      left join intents i using (design_id)),
    samples as (select *, passed and not toxic as pass from outcomes),
    counted as (select design_id, count(*) as n_samples, count(*) filter (pass) as n_pass, count(*) filter (toxic) as toxicity_failures,
      bool_or(expects_death) as expects_death from samples group by all
      union all select -1, 0, 0, 0, false)"""


def outcomes(spark, sf):
    """Samples of the seven designs; the intent of a design is the document of the same number."""
    points = V.points(spark, sf, "t1d")
    intents = table(spark, sf, "documents").select(
        F.col("doc_id").alias("design_id"), expects_death(F.col("text")).alias("expects_death")
    )
    return O.sample_outcomes(points, V.spec_for(spark, sf, "t1d"), V.TARGET, VERDICT, intents)


def mc_sql(reason):
    return V.with_sql(*base_sql(), VERDICT_SQL, OUTCOME_SQL) + f"""select *, reason = 'pass' as pass from (
      select design_id, n_samples, n_pass, toxicity_failures, expects_death, round(coalesce(n_pass / nullif(n_samples, 0), 0), 6) as pass_rate,
      round(coalesce(n_pass / nullif(n_samples, 0), 0) * 100.0e0, 6) as score, {reason} as reason from counted)"""


@query(
    "mc_verdict",
    mc_sql("""case when n_samples = 0 then 'no samples' when toxicity_failures > n_samples * 0.5e0 then 'mostly toxic' when n_pass / n_samples * 100.0e0 >= 90 then 'pass' else 'not robust' end"""),
)
def _mc(spark, sf):
    return O.mc_verdict(outcomes(spark, sf), cfg=VERDICT, designs=V.spec_for(spark, sf, "t1d"))


@query(
    "mc_verdict_noise_free",
    mc_sql("""case when n_samples = 0 then 'no samples' when toxicity_failures > 0 then 'toxic' when n_pass = n_samples then 'pass' else 'logic' end"""),
)
def _mc_quiet(spark, sf):
    return O.mc_verdict(outcomes(spark, sf), noise=0.0, iterations=1, cfg=VERDICT, designs=V.spec_for(spark, sf, "t1d"))


_run = ("5", "10", "' || cast(cast(round_even(score, 0) as bigint) as varchar) || '", "90.0")
_death = f"' || case when expects_death then '{MC_TEXT['death']}' else '' end || '"


@query(
    "mc_feedback",
    f"""select design_id, reason, case reason when 'no samples' then '{MC_TEXT["no samples"]}' when 'pass' then '{MC_TEXT["pass"] % (*_run, _death)}'
      when 'mostly toxic' then '{MC_TEXT["mostly toxic"] % ("' || n_samples || '", "' || toxicity_failures || '", "7000.0")}'
      else '{MC_TEXT["not robust"] % _run}' end as feedback from ({SQL["mc_verdict"]})""",
)
def _mc_feedback(spark, sf):
    verdicts = O.mc_verdict(outcomes(spark, sf), cfg=VERDICT, designs=V.spec_for(spark, sf, "t1d"))
    return O.mc_feedback(verdicts, cfg=VERDICT).select("design_id", "reason", "feedback")


@query(
    "failure_sample",
    V.with_sql(*base_sql(), VERDICT_SQL, OUTCOME_SQL)
    + """select design_id, sample_id, toxic, logic_failures, leak_failures from (select *,
      row_number() over (partition by design_id order by sample_id) as rn from samples where not pass) where rn <= 30""",
)
def _failure_sample(spark, sf):
    messages = O.failure_messages(outcomes(spark, sf), VERDICT)
    return O.failure_sample(messages, 30).select("design_id", "sample_id", "toxic", "logic_failures", "leak_failures")
