"""Hand-worked numbers for every formula and its edges."""

import math

import pytest
from pyspark.sql import functions as F

from geneweft.config import FunctionalConfig, KineticConfig, VerdictConfig, ViabilityConfig
from geneweft.functions import kinetics as K
from geneweft.functions import scores as S
from geneweft.functions import text as X
from geneweft.functions import units as U
from geneweft.functions import values as V
from geneweft.operators import retrieval, runs, scoring, series, sweep, topology
from geneweft.operators import components as C
from geneweft.operators import mining as M
from geneweft.operators import requests as R


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def points(spark, values, species="GFP", design=1, sample=0, state="1_state", dt=1.0, kind="protein"):
    n = len(values)
    data = [(design, sample, state, species, kind, i, n, i * dt, float(v)) for i, v in enumerate(values)]
    return rows(
        spark, data,
        "design_id long, sample_id long, state_name string, species string, kind string, seq long, n_points long, time double, value double",
    )


LEVELS = "design_id long, sample_id long, state_name string, value double"
SPEC = "design_id long, state_name string, expected int"


# --- scores ------------------------------------------------------------------------------


def matched(spark, pairs):
    return rows(spark, [(1, 0, f"s{i}", float(v), e) for i, (v, e) in enumerate(pairs)], LEVELS + ", expected int")


def test_functional_score(spark):
    row = scoring.functional_score(matched(spark, [(2000, 1), (50, 0)])).first()
    assert row.fold_change == pytest.approx(39.9999992, abs=1e-7)
    assert row.fc_score == pytest.approx(39.0243893, abs=1e-7)
    # 50 (1 - e^-1) + 50 e^-1
    assert row.margin_score == pytest.approx(50.0)
    assert row.compliance == pytest.approx(0.6224311, abs=1e-7)
    assert row.score_functional == pytest.approx(27.0226170, abs=1e-6)


def test_functional_score_with_one_side(spark):
    row = scoring.functional_score(matched(spark, [(2000, 1), (3000, 1)])).first()
    assert (row.fold_change, row.fc_score) == (0.0, 0.0)
    assert row.min_on == 2000.0 and row.max_off == 0.0


def test_plausibility(spark):
    nodes = rows(spark, [(1, i) for i in range(5)], "design_id long, n int")
    edges = rows(spark, [(1, i) for i in range(6)], "design_id long, n int")
    parts = rows(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "b")], "design_id long, pos long, part string")
    assert scoring.plausibility(nodes, edges, parts).first().c_plausibility == pytest.approx(0.4672805, abs=1e-7)
    assert scoring.first_repeat(parts).first().first_repeat == "b"


def test_first_repeat_is_the_earliest_second_occurrence(spark):
    parts = rows(spark, [(1, i, p) for i, p in enumerate("abba")], "design_id long, pos long, part string")
    assert scoring.first_repeat(parts).first().first_repeat == "b"


def test_kinetic_formulas(spark):
    cfg = KineticConfig()
    assert one(spark, S.retention(F.lit(50.0), F.lit(10.0), cfg)) == pytest.approx(0.6703200, abs=1e-7)
    assert one(spark, S.temporal_score(F.lit(3600.0), cfg)) == pytest.approx(0.7071068, abs=1e-7)
    assert one(spark, S.burden_penalty(F.lit(45000.0), cfg)) == pytest.approx(0.5)
    assert one(spark, S.burden_penalty(F.lit(50000.0), cfg)) == pytest.approx(0.0066929, abs=1e-7)
    assert one(spark, S.burden_penalty(F.lit(1e9), cfg)) == pytest.approx(1 / (1 + math.exp(500)))
    assert one(spark, S.retention(F.lit(0.0), F.lit(1.0), cfg)) == 0.0


def test_viability(spark):
    plausible = rows(spark, [(1, 0.4672805)], "design_id long, c_plausibility double")
    functional = rows(spark, [(1, 27.0226170)], "design_id long, score_functional double")
    kinetic = rows(
        spark, [(1, 50.0, 0.67032, 0.7071068, 0.5)],
        "design_id long, fc_mean double, r_kinetic double, score_temporal double, p_burden double",
    )
    row = scoring.viability(plausible, functional, kinetic).first()
    assert row.total_score == pytest.approx(2.9925557, abs=1e-5)
    assert row.rating == "Fail" and row.error is None
    alone = scoring.viability(plausible, functional, kinetic.where("design_id = 2")).first()
    assert alone.error == "no samples" and alone.rating is None


@pytest.mark.parametrize("score,expected", [(80.0, "Excellent"), (79.99, "Pass"), (60.0, "Pass"), (59.99, "Fail")])
def test_rating(spark, score, expected):
    assert one(spark, S.rating(F.lit(score), ViabilityConfig())) == expected


def test_fold_change_rules_differ(spark):
    on_only = matched(spark, [(10, 1)])
    assert scoring.fold_change(on_only, "functional").first().fold_change == 0.0
    assert scoring.fold_change(on_only, "kinetic").first().fold_change == 1.0
    assert scoring.fold_change(on_only, "verdict").first().fold_change == 0.0
    assert scoring.fold_change(matched(spark, [(10, 0)]), "verdict").first().fold_change == math.inf
    no_leak = matched(spark, [(10, 1), (0, 0)])
    assert scoring.fold_change(no_leak, "verdict").first().fold_change == 0.0
    assert scoring.fold_change(no_leak, "verdict", zero_off="inf").first().fold_change == math.inf


# --- verdicts ----------------------------------------------------------------------------


def judge(spark, levels, spec, cfg=VerdictConfig()):
    got = rows(spark, [(1, 0, s, float(v)) for s, v in levels.items()], LEVELS)
    want = rows(spark, [(1, s, e) for s, e in spec.items()], SPEC)
    return scoring.verdict_from_levels(got, want, cfg).first()


def test_verdict_is_inclusive(spark):
    row = judge(spark, {"0": 100, "1": 1000}, {"0": 0, "1": 1})
    assert row["pass"] and row.fold_change == 10.0 and row.score == 100.0


def test_verdict_without_leakage_fails_by_default(spark):
    row = judge(spark, {"0": 0, "1": 5000}, {"0": 0, "1": 1})
    assert not row["pass"] and row.fold_change == 0.0 and row.score == 100.0
    assert judge(spark, {"0": 0, "1": 5000}, {"0": 0, "1": 1}, VerdictConfig(zero_off="inf"))["pass"]


def test_verdict_counts_failures(spark):
    row = judge(spark, {"0": 101, "1": 999}, {"0": 0, "1": 1})
    assert (row.logic_failures, row.leak_failures, row.score) == (1, 1, 70.0)


def test_verdict_missing_state_is_zero(spark):
    row = judge(spark, {"0": 50}, {"0": 0, "1": 1})
    assert row.logic_failures == 1 and row.fold_change == 0.0


def test_verdict_without_target_fails(spark):
    traj = points(spark, [1000] * 10, state="1").unionByName(points(spark, [5] * 10, species="other", state="0"))
    spec = rows(spark, [(1, "0", 0), (1, "1", 1)], SPEC)
    row = scoring.verdict(traj, spec, "GFP").first()
    assert not row["pass"] and not row.evaluated and row.score == 0.0


def outcome_rows(spark, passes, toxic):
    return rows(
        spark, [(1, i, p, t, False) for i, (p, t) in enumerate(zip(passes, toxic))],
        "design_id long, sample_id long, pass boolean, toxic boolean, expects_death boolean",
    )


def test_mc_verdict(spark):
    nine = scoring.mc_verdict(outcome_rows(spark, [True] * 9 + [False], [False] * 10)).first()
    assert nine["pass"] and nine.pass_rate == 0.9
    half = scoring.mc_verdict(outcome_rows(spark, [True, True, False, False], [False, False, True, True])).first()
    assert half.reason == "not robust"
    most = scoring.mc_verdict(outcome_rows(spark, [True, False, False], [False, True, True])).first()
    assert most.reason == "mostly toxic"
    quiet = scoring.mc_verdict(outcome_rows(spark, [True, False], [False, True]), noise=0.0).first()
    assert quiet.reason == "toxic" and not quiet["pass"]


def test_toxicity_is_strict_and_spares_expected_death(spark):
    spec = rows(spark, [(1, "1_state", 1)], SPEC)
    at = points(spark, [50000.0] * 10)
    above = points(spark, [50001.0] * 10)
    assert not scoring.sample_outcomes(at, spec, "GFP").first().toxic
    assert scoring.sample_outcomes(above, spec, "GFP").first().toxic
    intents = rows(spark, [(1, True)], "design_id long, expects_death boolean")
    assert not scoring.sample_outcomes(above, spec, "GFP", intents=intents).first().toxic


# --- series ------------------------------------------------------------------------------


def test_steady_state(spark):
    assert series.steady_state(points(spark, range(10))).first().steady_state == 9.0
    assert series.steady_state(points(spark, [3.0])).first().steady_state == 3.0


def test_oscillation(spark):
    wave = [0, 1000] * 50
    assert series.oscillation(points(spark, wave)).first().oscillates
    assert not series.oscillation(points(spark, wave[:99])).first().oscillates
    assert not series.oscillation(points(spark, [0, 100] * 50)).first().oscillates  # amplitude is not above 100
    cut = series.oscillation(points(spark, wave), block=7).first()
    assert cut.crossings == series.oscillation(points(spark, wave)).first().crossings == 49


def test_rise_time(spark):
    assert series.rise_time(points(spark, [999, 1000], dt=10.0)).first().rise_time == 10.0
    assert series.rise_time(points(spark, [1, 2, 3], dt=10.0)).first().rise_time == 20.0


def test_summary(spark):
    row = series.summarize(points(spark, [1, 2, 3, 10, 4])).first()
    assert (row.initial_mean, row.peak_value, row.final_value, row.dynamic_range) == (2.0, 10.0, 4.0, 8.0)
    assert row.leakage_ratio == pytest.approx(0.2)
    assert series.summarize(points(spark, [0, 0, 0])).first().leakage_ratio == 0.0


def test_summary_falls_back_to_the_last_species(spark):
    traj = points(spark, [1, 1, 1], species="A").unionByName(points(spark, [2, 2, 2], species="B"))
    assert series.summarize(traj, output="GFP").first().species == "B"
    assert series.summarize(traj, output="A").first().species == "A"


def test_lengths_are_found_by_block(spark):
    traj = points(spark, range(100)).drop("n_points")
    got = series.with_length(traj, block=8)
    assert got.count() == 100 and got.agg(F.min("n_points"), F.max("n_points")).first()[:] == (100, 100)


def test_burden(spark):
    traj = points(spark, [1, 5, 2]).unionByName(points(spark, [10, 1, 1], species="X")).unionByName(
        points(spark, [1e6] * 3, species="X", kind="mrna")
    )
    assert series.max_burden(traj, "sample").first().max_burden == 11.0
    assert series.max_burden(traj, "design", "X").first().max_burden == 5.0


def test_melt(spark):
    wide = rows(spark, [(1, 0.0, 1.0, 2.0, 3.0)], "run long, Time double, GFP double, GFP_mRNA double, Input_IPTG double")
    got = {(r.species, r.kind, r.value) for r in series.melt_trajectories(wide, ["run"]).collect()}
    assert got == {("GFP", "protein", 1.0), ("GFP", "mrna", 2.0), ("IPTG", "input", 3.0)}


def test_failed_runs(spark):
    expected = rows(spark, [(1, 0), (1, 1), (2, 0)], "design_id long, sample_id long")
    kept, counts = series.drop_failed(expected, points(spark, [1, 2]))
    assert {(r.design_id, r.n_runs, r.n_failed) for r in counts.collect()} == {(1, 2, 1), (2, 1, 1)}
    assert kept.count() == 2


# --- kinetics ----------------------------------------------------------------------------


def test_hill(spark):
    r, kd, n = F.lit(2000.0), F.lit(1000.0), F.lit(2.0)
    assert one(spark, K.hill_rep(r, kd, n)) == pytest.approx(0.2)
    assert one(spark, K.hill_act(r, kd, n)) == pytest.approx(0.8)
    active = K.active_repressor(r, F.lit(5000.0), F.lit(5000.0), n)
    assert one(spark, K.hill_rep(active, kd, n)) == pytest.approx(0.5)


def test_frames_to_scores(spark):
    """A protein, its mRNA and an input of the same name stay apart on the way from frames to levels."""
    frame = rows(spark, [(1, 0, "1", float(t), 2000.0, 20.0, 7.0) for t in range(20)] + [(1, 0, "0", float(t), 50.0, 500.0, 7.0) for t in range(20)],
                 "design_id long, sample_id long, state_name string, Time double, GFP double, GFP_mRNA double, Input_GFP double")
    points = series.trajectory_points(frame, ["design_id", "sample_id", "state_name"])
    assert points.count() == 120 and {r.n_points for r in points.collect()} == {20}
    levels = {(r.state_name, r.kind): r.steady_state for r in series.steady_state(points).collect()}
    assert levels[("1", "protein")] == 2000 and levels[("1", "mrna")] == 20 and levels[("1", "input")] == 7
    spec = rows(spark, [(1, "1", 1), (1, "0", 0), (2, "1", 1)], "design_id long, state_name string, expected int")
    verdict = scoring.verdict(points, spec, "GFP").first()
    assert verdict["pass"] and verdict.fold_change == 40
    empty = scoring.join_spec(scoring.state_levels(points, "GFP"), spec, "left").where("design_id = 2").first()
    assert empty.value == 0
    assert {r.design_id: r.max_burden for r in series.max_burden(points, "design", "GFP").collect()} == {1: 0}
    mc = {r.design_id: (r.n_samples, r["pass"], r.reason) for r in scoring.mc_verdict(scoring.sample_outcomes(points, spec, "GFP"), designs=spec).collect()}
    assert mc == {1: (1, True, "pass"), 2: (0, False, "no samples")}


def test_decision_numbers_and_scores(spark):
    df = rows(spark, [('{"decision":"PASS","selected_index":0.0}', ["a", "b"])], "response string, candidates array<string>")
    assert runs.parse_decision(df).first().best_topology == "a"
    results = rows(spark, [("r", 0, "NaN", None, None), ("r", 1, "5", None, None)], "run_id string, pos long, score string, fold_change string, error string")
    assert runs.fallback_design(results).first().chosen_pos == 1
    turns = rows(spark, [("s-1", 1, "b", "c")], "session_id string, round_number long, builder_output string, critic_output string")
    assert "s-1" in runs.render_transcript(turns).first().line


def test_netlist_with_text_parameters(spark):
    text = '{"nodes":[{"id":"a","node_type":"x","parameters":{"promoter":"pTac","kd":2}}],"edges":[]}'
    nodes = topology.split_netlists(rows(spark, [(1, text)], "design_id long, content string"))[0]
    assert nodes.first().parameters == {"kd": 2.0}


def test_stimulus(spark):
    df = rows(spark, [(float(t),) for t in (0, 10, 15, 20, 21)], "t double")
    spec = F.from_json(F.lit('{"type":"pulse","start":10,"duration":10,"amp":5}'), "struct<type:string,start:double,duration:double,amp:double,freq:double>")
    assert [r[0] for r in df.select(K.stimulus(F.col("t"), spec)).collect()] == [0, 5, 5, 5, 0]
    expr = [r[0] for r in df.select(K.stimulus_expression("15: 2 * t + exp(0)")).collect()]
    assert expr == [0, 0, 31, 41, 43]
    assert [r[0] for r in df.select(K.stimulus_expression("15: t ** 2 + cos(pi) + 0 * e")).collect()] == [0, 0, 224, 399, 440]
    for bad in ("100: import os", "t; drop", "x: t", "2 * (t", "sha2(t, 256)", "t.real", "pow(t)"):
        assert [r[0] for r in df.select(K.stimulus_expression(bad)).collect()] == [0.0] * 5


def test_parameter_override(spark):
    m = F.create_map(F.lit("kd_A"), F.lit(1.0), F.lit("kd"), F.lit(2.0))
    assert one(spark, V.param(m, "kd", F.lit("A"), 3.0), V.param(m, "kd", F.lit("B"), 3.0), V.param(m, "n", F.lit("A"), 3.0)) == (1.0, 2.0, 3.0)


# --- units and mining --------------------------------------------------------------------


@pytest.mark.parametrize(
    "value,unit,kind,expected,error",
    [
        (0.5, "uM/min", "transcription_rate", 8.3333333, None),
        (2.0, "1/min", "translation_rate", 2 / 60, None),
        (1.0, "uM", "kd", 1000.0, None),
        (1.0, "M", "kd", 1e9, None),
        (3.0, "anything", "n", 3.0, None),
        (1.0, "h^-1", "mrna_deg_rate", 1 / 3600, None),
        (1.0, "", "kd", None, "empty unit"),
        (1.0, None, "kd", None, "empty unit"),
        (1.0, "nM", "transcription_rate", None, "unknown compound unit"),
        (1.0, "nM/day", "transcription_rate", None, "unknown compound unit parts"),
        (1.0, "1/day", "translation_rate", None, "unknown time unit"),
        (1.0, "mg", "km_ribo", None, "unknown concentration unit"),
        (1.0, "nM", "speed", None, "unknown parameter type"),
    ],
)
def test_units(spark, value, unit, kind, expected, error):
    row = one(spark, U.normalize_unit(F.lit(value), F.lit(unit).cast("string"), F.lit(kind)))
    assert row.error == error
    assert row.value is None if expected is None else row.value == pytest.approx(expected, rel=1e-6)


def test_fallback_parameters(spark):
    df = rows(spark, [(1, "yeast", None), (2, "", {"kd": 5.0})], "id long, host string, params map<string,double>")
    got = {r.id: r.params for r in M.fallback_parameters(df, "params").collect()}
    assert got[1]["kd"] == 500.0 and got[1]["km_rnap"] == 100.0 and got[2] == {"kd": 5.0}


def test_context_of_blank_request(spark):
    df = rows(spark, [(1, 0, "p", "h", "x" * 5000, None), (1, 1, "q", "h", None, "timeout")],
              "request_id long, pos long, part string, host string, snippet string, failure string")
    parts = [r.section for r in M.assemble_context(df).orderBy("pos").collect()]
    assert parts[0].count("x") == 4000 and parts[1].endswith("\nFailed to scrape q: timeout")


def test_html(spark):
    html = "<!DOCTYPE html><head><title>A &amp;amp; B</title><script>var t='</p>';</script></head><p> one <b>two</b>\n</p><!-- c -->3 &lt; 4"
    assert one(spark, X.html_text(F.lit(html))) == "A &amp; B\none\ntwo\n3 < 4"
    assert "var t" in one(spark, X.html_text(F.lit(html), keep_scripts=True))
    odd = '<p title="a > b">one</p><p>&nbsp;</p>two&#150;three&#x000000041;<p title="open>four</p>'
    assert one(spark, X.html_text(F.lit(odd))) == "one\ntwo\u2013threeA\nfour"


def test_paragraphs(spark):
    text = "Kd is 5\n  no number rate \nrate 3 \n\n12 apples"
    assert one(spark, X.relevant_paragraphs(F.lit(text))) == "Kd is 5\nrate 3"
    assert one(spark, X.relevant_paragraphs(F.lit("rate ٣"))) == ""
    assert one(spark, X.relevant_paragraphs(F.lit("\u3000Kd 5\u00a0\v"))) == "Kd 5"
    assert one(spark, X.relevant_paragraphs(F.lit("rate ٣"), unicode_digits=True)) == "rate ٣"


# --- text and decisions ------------------------------------------------------------------


def test_fences_and_slices(spark):
    assert one(spark, X.strip_fences(F.lit(' ```json\n{"a":1}\n``` '))) == '{"a":1}'
    assert one(spark, X.strip_fences(F.lit('\n\n```json\n{"a":1}\n```\n'))) == '{"a":1}'
    assert one(spark, X.extract_proposals(F.lit('x {"a":{"b":1},"c":2} y'))) == ['{"b":1}']
    assert one(spark, X.extract_proposals(F.lit('x {"c":2} y'))) == ['{"c":2}']
    assert one(spark, X.extract_proposals(F.lit("plain"))) == ["plain"]
    assert one(spark, X.extract_proposals(F.lit("bad {c} y"))) is None


@pytest.mark.parametrize(
    "text,valid",
    [('{"a":1}', True), ("[1]", True), (' "x" ', True), ('{"a":1}x', False), ('{"a":1},{"b":2}', False), ('{"a":1}}', False),
     ("[1]]", False), ("", False), ("  ", False), ('{"a":1},"b":{}', False), (None, False)],
)
def test_is_json(spark, text, valid):
    assert one(spark, V.is_json(F.lit(text).cast("string"))) is valid


def test_hdl(spark):
    good = "module m(input a, output b); assign b = a; endmodule"
    check = lambda t: one(spark, X.validate_hdl(F.lit(t)))
    assert check(good) is None
    assert check("assign x") == "missing module"
    assert check(good.replace("input ", "in")) == "missing input"
    assert check(good.replace("assign ", "")) == "missing logic"
    assert check(good + " always") == "forbidden always"
    assert check(good + " reg") == "forbidden reg" and check(good + " regular") is None
    assert check(good + " #1") == "forbidden delay"
    assert one(spark, X.extract_module(F.lit("hi " + good + " bye endmodule"))) == good


def decide(spark, text):
    df = rows(spark, [(text, ["t0", "t1"])], "response string, candidates array<string>")
    return runs.parse_decision(df).first()


def test_decisions(spark):
    ok = decide(spark, '```json\n{"decision":"PASS","error_type":"NONE","selected_index":1,"feedback":"fine"}\n```')
    assert ok.approved and ok.best_topology == "t1" and ok.feedback == "fine"
    out = decide(spark, '{"decision":"PASS","selected_index":5,"feedback":"f"}')
    assert out.approved and out.best_topology is None
    assert out.feedback == "Warning: Valid PASS but invalid selected_index 5. f"
    negative = decide(spark, '{"decision":"PASS","selected_index":-1}')
    assert negative.best_topology is None and negative.feedback.startswith("Warning")
    empty = decide(spark, "{}")
    assert not empty.approved and empty.feedback == "[ROUTE: REVISE] [ERROR: NONE] No feedback provided."
    ucf = decide(spark, '{"decision":"REVISE","error_type":"PART_ERROR","recommended_ucf":"E2","feedback":"x"}')
    assert ucf.feedback == "[ROUTE: REVISE] [ERROR: PART_ERROR] [UCF: E2] x"
    assert decide(spark, "I pass").malformed and decide(spark, '{"decision":').decision is None


@pytest.mark.parametrize(
    "human,error,approved,topology,number,fallback,node",
    [
        (True, "NONE", True, True, 1, True, "Builder"),
        (True, "NONE", True, True, 3, True, "Human_in_Loop"),
        (False, "NONE", False, True, 1, True, "Consolidator"),
        (False, "LOGIC_ERROR", False, True, 2, True, "Builder"),
        (False, "PART_ERROR", False, True, 2, True, "Translator"),
        (False, "BOTH", False, False, 3, True, "Consolidator"),
        (False, "BOTH", False, False, 3, False, "Failed"),
        (False, "NONE", True, False, 1, True, "Builder"),
    ],
)
def test_route(spark, human, error, approved, topology, number, fallback, node):
    df = rows(spark, [(human, error, approved, topology, number, fallback)],
              "has_human_feedback boolean, error_type string, approved boolean, has_topology boolean, current_round int, has_fallback boolean")
    assert runs.route(df).first().next_node == node


def test_best_and_fallback(spark):
    its = rows(spark, [(1, i + 1, f"d{i}", s) for i, s in enumerate((50.0, 70.0, 70.0))] + [(2, 1, "x", 0.0)],
               "run_id long, iteration long, design string, score double")
    best = {r.run_id: (r.best_design, r.best_score) for r in runs.best_design(its).collect()}
    assert best == {1: ("d1", 70.0), 2: (None, 0.0)}
    res = rows(
        spark,
        [(1, i, s, None, None) for i, s in enumerate(("50", "70", "70"))] + [(2, 0, None, None, "e"), (2, 1, None, None, "e")]
        + [(3, 0, None, "2", None), (3, 1, "x", "9", None)],
        "run_id long, pos long, score string, fold_change string, error string",
    )
    assert {r.run_id: r.chosen_pos for r in runs.fallback_design(res).collect()} == {1: 2, 2: 0, 3: 0}


def test_best_so_far_stops_at_the_first_hit(spark):
    its = rows(spark, [(1, 1, 50), (1, 2, 80), (1, 3, 99), (2, 1, 1), (2, 2, 2), (2, 3, 0), (2, 4, 90)], "run_id long, iteration long, score long")
    got = sorted((r.run_id, r.iteration, r.best_score) for r in runs.best_so_far(its).collect())
    assert got == [(1, 1, 50), (1, 2, 80), (2, 1, 1), (2, 2, 2), (2, 3, 2)]


# --- components --------------------------------------------------------------------------

FILES = {
    "array": '[{"collection":"gates","name":"A1","gate_type":"NOR","response_function":{"equation":"hill","parameters":{"n":2,"K":0.1}},"toxicity":0.2}, 3]',
    "wrapped": '{"ucf":[{"collection":"input_sensors","id":"pTac","inducer":"IPTG"}],"x":{"collection":"gates"}}',
    "dicts": '{"a":{"collection":"output_devices","device_name":"YFP_out","reporter":"YFP"},"b":5}',
    "lists": '{"a":[{"type":"gate","name":"G","family":"NOT"}],"ucf":[]}',
    "bom": '﻿[{"collection":"gates","name":"","id":0,"toxicity":false,"organism":[]}]',
    "bad": '[{"collection":',
    "scalar": "7",
}


def test_component_shapes(spark):
    files = rows(spark, list(FILES.items()), "path string, content string")
    records, broken = C.parse_components(files)
    got = {(r.path, r.name, r.role): r for r in C.describe(records).collect()}
    assert set(got) == {
        ("array", "A1", "gate"), ("wrapped", "pTac", "sensor"), ("dicts", "YFP_out", "output"), ("lists", "G", "gate"), ("bom", "0", "gate"),
    }
    assert {r.path for r in broken.collect()} == {"bad", "scalar"}
    first = got[("array", "A1", "gate")]
    assert first.document == (
        "元件名稱：A1。 類型：gates（邏輯閘（gate））。 功能描述：這是一個 NOR 邏輯閘。適用宿主/生物體：未指定。 "
        '反應函數：equation=hill；parameters={"K":0.1,"n":2}。 毒性：0.2。'
    )
    assert "毒性：false。" in got[("bom", "0", "gate")].document
    assert got[("bom", "0", "gate")].organism is None


def test_component_values_keep_their_types(spark):
    files = rows(spark, [
        ("string", '["{\\"collection\\":\\"gates\\",\\"name\\":\\"ghost\\"}", [{"collection":"gates","name":"nested"}]]'),
        ("order", '{"z":[{"collection":"gate","name":"first"}],"a":{"collection":"gate","name":"second"},"z2":"{}"}'),
        ("equal", '{"a":{"collection":"gate","name":"old","name":"new","toxicity":"high"},"a":{"collection":"gate","name":"last"}}'),
        ("nan", '{"b":{"collection":"gate","name":"n","toxicity":NaN},"a":{"collection":"gate","name":"i","burden":-Infinity}}'),
        ("named", '[{"collection":"gate","name":{"x":1},"response":{"model":"hill"}}]'),
        ("params", '[{"collection":"gate","name":"p","response":{"params":{"n":2}},"tox":"0.2","burden":false}]'),
        ("tail", '[{"collection":"gate","name":"p"}] x'), ("none", None), ("empty", " "),
    ], "path string, content string")
    records, broken = C.parse_components(files)
    got = {(r.path, r.pos): r for r in C.select_components(records).collect()}
    assert {k: r.name for k, r in got.items()} == {
        ("order", 0): "first", ("order", 1): "second", ("equal", 0): "last", ("nan", 0): "i", ("nan", 1): "n", ("named", 0): '{"x":1}', ("params", 0): "p",
    }
    assert "毒性：NaN。" in got["nan", 1].document and "代謝負擔：-Infinity。" in got["nan", 0].document
    assert got["named", 0].document.endswith('{"collection":"gate","name":{"x":1},"response":{"model":"hill"}}')
    assert '反應函數：{"parameters":{"n":2}}。 毒性："0.2"。 代謝負擔：false。' in got["params", 0].document
    assert {r.path for r in broken.collect()} == {"tail", "none", "empty"}
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_content_id(spark):
    assert one(spark, V.content_id(F.lit("abc"))) == "part_ba7816bf8f01cfea"
    docs = rows(spark, [("a",), ("a",), (" ",), ("b",)], "document string")
    assert C.distinct_documents(C.with_ids(docs)).count() == 2


# --- topology ----------------------------------------------------------------------------


def test_netlist(spark):
    text = (
        '{"nodes":[{"id":"1","node_type":"PRIMARY_INPUT","name":"in"},{"id":"2","node_type":"NOR_GATE","gate_name":"G","parameters":{"kd":5}},'
        '{"id":"3","node_type":"REPORTER","protein":"YFP"},{"node_type":"SENSOR"},{"id":"2","node_type":"OTHER","name":"late"}],'
        '"edges":[{"source":"in","target":"2"},{"source":"2","target":"3"},{"source":"9","target":"3"},{"source":"1","target":"3","parameters":{"n":1}}]}'
    )
    files = rows(spark, [("d1", text), ("d2", '{"nodes":[]}'), ("d3", "junk")], "design_id string, content string")
    species, interactions, errors = topology.parse_netlists(files)
    assert {(r.name, r.type) for r in species.collect()} == {("in", "sensor"), ("G", "repressor"), ("YFP", "reporter"), ("late", "unknown")}
    got = {(r.source, r.target, r.type, tuple((r.parameters or {}).items())) for r in interactions.collect()}
    assert got == {("in", "G", "repression", ()), ("G", "YFP", "repression", (("kd", 5.0),)), ("in", "YFP", "expression", (("n", 1.0),))}
    assert {r.design_id for r in errors.collect()} == {"d2", "d3"}


# --- sweeps ------------------------------------------------------------------------------


def test_truth_table(spark):
    df = rows(spark, [(1, ["a", "b"]), (2, [])], "design_id long, inputs array<string>")
    got = [(r.design_id, r.state_name, r.state_inputs) for r in sweep.truth_table(df).orderBy("design_id", "state_index").collect()]
    assert [g[1] for g in got] == ["00_state", "01_state", "10_state", "11_state", "default_state"]
    assert got[1][2] == {"a": 0.0, "b": 1.0} and got[4][2] == {}


def test_verdict_feedback(spark):
    levels = rows(spark, [(1, 0, "0", 0.125), (1, 0, "1", 2000.0), (1, 1, "0", 600.125), (1, 1, "1", 30.0), (2, 0, "0", 1.0), (3, 0, "1", 5000.0), (4, 0, "0", 50.0), (4, 0, "1", 1000.0)], LEVELS)
    levels = levels.withColumn("has_target", F.col("design_id") != 3)
    spec = rows(spark, [(1, "0", 0), (1, "1", 1), (3, "1", 1), (4, "0", 0), (4, "1", 1), (4, "2", 0)], SPEC)
    judged = scoring.verdict_feedback(levels, spec, "GFP", VerdictConfig(on=1000.0, off=100.0))
    got = {(r.design_id, r.sample_id): r.feedback for r in judged.collect()}
    assert got[1, 0].startswith("【ODE 驗證成功】")
    parts = got[1, 1].split("。")
    assert "條件 0 " in parts[0] and "達 600.12 a.u. (高於 OFF 閾值 100.0)" in parts[0]
    assert "條件 1 " in parts[1] and "僅為 30.00 a.u. (低於 ON 閾值 1000.0)" in parts[1]
    assert "僅為 0.05 倍" in got[1, 1] and got[1, 1].endswith("增加訊號放大。") and "降解標籤" in got[1, 1]
    assert "真值表" in got[2, 0] and "'GFP'" in got[3, 0] and got[4, 0].startswith("【ODE 驗證成功】")
    outcomes = judged.drop("feedback").withColumn("toxic", F.col("design_id") == 2).withColumn("max_burden", F.lit(60000.5))
    messages = {(r.design_id, r.sample_id): r.message for r in scoring.sample_feedback(outcomes, judged).collect()}
    assert messages[2, 0] == "樣本 0: UNINTENDED_BURDEN (Max burden 60,000.50 > 50000.0)".replace(",", "")
    assert messages[1, 1] == "樣本 1: " + got[1, 1] and set(messages) == {(1, 1), (2, 0), (3, 0)}


def test_mc_feedback(spark):
    verdicts = rows(
        spark, [(1, 8, 3, False, 12.5, "not robust"), (2, 9, 0, True, 100.0, "pass"), (3, 4, 3, False, 0.0, "mostly toxic"), (4, 0, 0, False, 0.0, "no samples")],
        "design_id long, n_samples long, toxicity_failures long, expects_death boolean, score double, reason string",
    )
    got = {r.design_id: r.feedback for r in scoring.mc_feedback(verdicts).collect()}
    assert "在 5% 噪音與 10 次模擬中，穩健度僅為 12% (未能達到及格門檻 90.0%)" in got[1]
    assert "穩健度為 100%" in got[2] and got[2].endswith("驗證通過。 (EXPECTED_DEATH)")
    assert "在 4 組變異參數中，有 3 組" in got[3] and ">50000.0" in got[3] and got[4] == "未提供任何模擬數據。"
    quiet = {r.design_id: r.feedback for r in scoring.mc_feedback(verdicts, noise=0.0).where("design_id = 2").collect()}
    assert quiet[2].startswith("【ODE 快速驗證】") and quiet[2].endswith("(EXPECTED_DEATH)")


def test_truth_table_over_tasks(spark):
    df = rows(spark, [(1, [f"i{n}" for n in range(14)]), (2, []), (3, None), (4, ["a"])], "design_id long, inputs array<string>")
    flat = lambda t: t.withColumn("state_inputs", F.to_json("state_inputs")).drop("inputs")
    dealt = sweep.truth_table(df, tasks=8, low_bits=6)
    assert flat(dealt).exceptAll(flat(sweep.truth_table(df))).count() == 0 and dealt.count() == 2**14 + 4
    shares = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 8 and max(shares) <= 2**11 + 2 * 64


def test_dispatch_reads_requests_once(spark):
    requests = rows(spark, [(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "c/d=", "w")], "request_id long, tool string, text string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    answer = lambda word: lambda r: r.select("request_id", F.concat(F.lit(word), "text").alias("content"))
    got = R.dispatch(requests.mapInArrow(seen, requests.schema), {"a": answer("A"), "c/d=": answer("C")})
    assert {(r.request_id, r.content) for r in got.collect()} == {
        (1, "Ax"), (4, "Cw"), (2, "TOOL_ERROR: unknown tool `b`"), (3, "TOOL_ERROR: unknown tool ``"),
    }
    assert read.value == 4
    assert R.dispatch(requests.limit(0), {"a": answer("A")}).count() == 0
    assert R.dispatch(requests, {}).count() == 4


def test_mined_parameters(spark):
    good = '{"raw_value": 1, "raw_unit": "%s"}'
    units = {"transcription_rate": "nM/s", "translation_rate": "1/s", "mrna_deg_rate": "1/s", "protein_deg_rate": "1/s",
             "kd": "nM", "n": "", "km_rnap": "nM", "km_ribo": "nM"}
    body = lambda **other: "{" + ", ".join(f'"{k}": {other.get(k, good % u)}' for k, u in units.items()) + "}"
    answers = [(1, body()), (2, body(km_ribo="{}")), (3, body(kd="null", km_ribo="{}")), (4, "[]"), (5, ""), (6, None), (7, "{}"),
               (8, body(n='{"raw_value": "2.5"}'))]
    df = rows(spark, answers, "id long, answer string").withColumn("host", F.lit("yeast"))
    got = {r.id: r for r in M.mined_parameters(df).collect()}
    assert got[1].error is None and got[1].params == dict.fromkeys(units, 1.0)
    assert got[2].error == "km_ribo: no value" and got[2].params["km_ribo"] == 500.0 and got[2].params["kd"] == 500.0
    assert got[3].error == "kd: no value" and got[7].error == "transcription_rate: no value"
    assert {got[i].error for i in (4, 5, 6)} == {"answer is not a JSON object"}
    assert got[8].error is None and got[8].params["n"] == 2.5


def test_noise_is_keyed_and_about_right(spark):
    params = rows(spark, [(i, "kd", 100.0) for i in range(20)] + [(1, "text", None)], "design_id long, key string, value double")
    noisy = sweep.noisy_parameters(params, 0.15, 100, seed=1)
    again = sweep.noisy_parameters(params.repartition(7), 0.15, 100, seed=1)
    assert noisy.exceptAll(again).count() == 0
    mean, std = noisy.agg(F.avg("noisy_value"), F.stddev_pop("noisy_value")).first()
    assert mean == pytest.approx(100, abs=1.5) and std == pytest.approx(15, abs=1)
    assert noisy.where("value is null and noisy_value is not null").count() == 0
    assert sweep.noisy_parameters(params, 0.0, 2).where("noisy_value <> value").count() == 0


def test_memo(spark):
    df = rows(spark, [('{"b":1,"a":2}', 10), ('{"a":2, "b":1}', 10), ('{"a":2}', 10)], "params string, n int")
    keyed = sweep.memo_key(df, ["params"], ["n"])
    assert keyed.select("memo_key").distinct().count() == 2
    store = keyed.where("params = '{\"a\":2}'")
    assert sweep.pending_runs(keyed, store).count() == 1
    assert sweep.pending_runs(keyed, None).count() == 2


# --- retrieval ---------------------------------------------------------------------------


def items(spark, texts):
    return rows(spark, [("q", i + 1, t) for i, t in enumerate(texts)], "query_id string, rank int, text string")


def test_budget(spark):
    kept = retrieval.budget(items(spark, ["x" * 1198, "y" * 1197, ""]))
    assert [r.rank for r in kept.orderBy("rank").collect()] == [1, 2]
    assert retrieval.budget(items(spark, [str(i) for i in range(20)])).count() == 8


def test_keyword_filter(spark):
    both = retrieval.keyword_filter(items(spark, ["a Sensor", "plain"]))
    assert [r.text for r in both.collect()] == ["a Sensor"]
    assert retrieval.keyword_filter(items(spark, ["plain", "other"])).count() == 2


def test_compact_context(spark):
    text = retrieval.compact_context(items(spark, [" gate B ", "plain", "gate A", "gate B"])).first().context
    assert text == "- gate B\n- gate A"


def test_search_edges(spark):
    index = rows(spark, [("b", [0.0, 1.0]), ("a", [0.0, 1.0]), ("c", [5.0, 5.0])], "part_id string, embedding array<float>")
    query = rows(spark, [("q", [0.0, 1.0], "t"), ("blank", [0.0, 0.0], " ")], "query_id string, embedding array<float>, text string")
    got = [(r.query_id, r.part_id, r.distance) for r in retrieval.search(query, index, 2).orderBy("rank").collect()]
    assert got == [("q", "a", 0.0), ("q", "b", 0.0)]
    assert retrieval.search(query, index, 0).count() == 0
    assert retrieval.search(query.limit(0), index, 3).count() == 0
    context = retrieval.retrieve_context(query, index.withColumn("document", F.lit("gate")), 2)
    assert {r.query_id: r.context for r in context.collect()} == {"q": "- gate", "blank": retrieval.NO_RESULTS}


def test_requests(spark):
    df = rows(spark, [(1, '{"query":"a"}'), (2, ""), (3, "{"), (4, '{"query":"a","n_results":"x"}'), (5, '{"query":"a","n_results":null}')],
              "request_id long, arguments string")
    got = {r.request_id: (r.query, r.n_results, r.error) for r in R.validate_requests(df).collect()}
    assert got[1] == ("a", 5, None)
    assert got[2][2] == "TOOL_ERROR: blank query" and got[3][2] == "TOOL_ERROR: invalid JSON"
    assert got[4][2].startswith("TOOL_ERROR: n_results") and got[5][2].startswith("TOOL_ERROR: n_results")


@pytest.mark.parametrize(
    "text,expected",
    [("&eacute;&#233;&#xE9;", "ééé"), ("&amp;#39; &#39;", "&#39; '"), ("&bogus; & &lt", "&bogus; & &lt"), ("&#128512;", "😀"), ("a&nbsp;b", "a\xa0b"),
     ("&amp;lt;", "&lt;"), ("plain", "plain")],
)
def test_references(spark, text, expected):
    assert one(spark, X.decode_references(F.lit(text))) == expected
