"""Same rows whatever the partitioning, hot keys included; and agreement with plain Python on random tables."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geneweft.config import FunctionalConfig
from geneweft.operators import retrieval, runs, scoring, series, skew, sweep, topology
from geneweft.operators.components import distinct_documents, with_ids
from geneweft.plans import views as V
from geneweft.operators.skew import index_points
from geneweft.plans.registry import table
from geneweft import session
from geneweft.session import clear_scratch, stored

SF = "/root/testdata/sf0.001"


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def hot_points(spark, n=3000):
    """Readings of which one series holds a third."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        key = (0, 0, "s0", "GFP") if i % 3 == 0 else (rnd.randrange(4), rnd.randrange(3), f"s{rnd.randrange(2)}", rnd.choice("AB"))
        rows.append((*key, "protein", rnd.random() * 50000, i, rnd.random() * 1000))
    return spark.createDataFrame(
        rows,
        "design_id long, sample_id long, state_name string, species string, kind string, time double, event_id long, value double",
    )


def numbered(df):
    return series.points_from_events(df, order_by=("time", "event_id"))


@pytest.mark.parametrize("n", [1, 64])
def test_positions(spark, n):
    raw = hot_points(spark)
    base = numbered(raw)
    same(numbered(raw.repartition(n)), base)
    rows = base.where("species = 'GFP'").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1000)) and {r.n_points for r in rows} == {1000}
    assert [r.time for r in rows] == sorted(r.time for r in rows)


@pytest.mark.parametrize("n", [1, 64])
@pytest.mark.parametrize(
    "operator",
    [
        lambda t: series.oscillation(t, block=50).select("design_id", "sample_id", "species", "crossings", "oscillates"),
        lambda t: series.summarize(t).select("design_id", "sample_id", "species", "peak_value", "final_value"),
        lambda t: series.rise_time(t, 500.0),
        lambda t: series.tail_slice(t, 0.5),
    ],
)
def test_series(spark, n, operator):
    base = numbered(hot_points(spark))
    same(operator(base.repartition(n)), operator(base))


def test_series_against_plain_python(spark):
    got = {}
    base = numbered(hot_points(spark))
    for r in series.oscillation(base, min_amp=0.0, block=64).join(series.steady_state(base), list(series.SERIES)).collect():
        got[(r.design_id, r.sample_id, r.state_name, r.species, r.kind)] = r
    frame = base.toPandas().sort_values("seq")
    for key, group in frame.groupby(list(series.SERIES)):
        v = group["value"].to_numpy()
        tail = v[int(len(v) * 0.5):]
        crossings = int(np.count_nonzero(np.diff(np.sign(tail - tail.mean()))))
        assert got[key].crossings == crossings
        assert got[key].steady_state == pytest.approx(v[int(len(v) * 0.9):].mean())


def test_functional_score_against_plain_python(spark):
    rnd = random.Random(5)
    cfg = FunctionalConfig(on=500.0, off=300.0, k_ideal=2.0)
    data = [(d, 0, f"s{i}", rnd.random() * 1000, rnd.choice([0, 1])) for d in range(20) for i in range(rnd.randrange(1, 6))]
    df = spark.createDataFrame(data, "design_id long, sample_id long, state_name string, value double, expected int")
    for r in scoring.functional_score(df.repartition(5), cfg).collect():
        mine = [(v, e) for d, _, _, v, e in data if d == r.design_id]
        on, off = [v for v, e in mine if e == 1], [v for v, e in mine if e == 0]
        compliance = math.prod(
            1 / (1 + math.exp(-0.01 * (v - cfg.on))) if e else 1 / (1 + math.exp(0.01 * (v - cfg.off))) for v, e in mine
        )
        fc = min(on) / (max(off) + 1e-6) if on and off else 0.0
        score = 100 * fc**2 / (cfg.k_ideal**2 + fc**2) if on and off else 0.0
        margin = (50 * (1 - math.exp(-0.001 * max(0, min(on) - cfg.on))) if on else 0) + (50 * math.exp(-0.02 * max(off)) if off else 0)
        assert r.score_functional == pytest.approx(compliance * (0.6 * score + 0.4 * margin))


def test_rounds_of_a_long_session(spark):
    turns = spark.createDataFrame([("a", 7 * i) for i in range(500)] + [("b", 3)], "session_id string, turn long")
    got = runs.number_rounds(turns.repartition(16)).where("session_id = 'a'").orderBy("turn").collect()
    assert [r.round_number for r in got] == list(range(1, 501))


@pytest.mark.parametrize("n", [1, 64])
def test_edges(spark, n):
    nodes, edges = V.nodes(spark, SF), V.edges(spark, SF)
    plain = topology.netlist_interactions(nodes, edges).drop("parameters")
    same(topology.netlist_interactions(nodes.repartition(n), edges.repartition(n)).drop("parameters"), plain)


def test_hub_node(spark):
    nodes = spark.createDataFrame(
        [("d", str(i), "NOR_GATE", None, None, f"n{i}", i) for i in range(5)],
        "design_id string, node_id string, node_type string, gate_name string, protein string, name string, pos int",
    ).withColumn("parameters", F.lit(None).cast("map<string,double>"))
    edges = spark.range(4000).select(
        F.lit("d").alias("design_id"), F.col("id").alias("edge_pos"), F.lit("0").alias("source_id"),
        (F.col("id") % 7).cast("string").alias("target_id"), F.lit(None).cast("map<string,double>").alias("parameters"),
    )
    assert topology.resolve_edges(nodes, edges).count() == sum(1 for i in range(4000) if i % 7 < 5)


def test_budget_and_dedup(spark):
    df = spark.createDataFrame(
        [("hot", i, f"gate {i % 40} " + "x" * (i % 90)) for i in range(3000)] + [("q", 1, "gate")], "query_id string, rank int, text string"
    )
    base = retrieval.compact_context(df)
    same(retrieval.compact_context(df.repartition(64)), base)


def test_copies_collapse(spark):
    df = spark.createDataFrame([("copy",)] * 500 + [(f"t{i}",) for i in range(500)], "document string").repartition(16)
    assert distinct_documents(with_ids(df)).count() == 501
    several = with_ids(df).withColumn("n", F.monotonically_increasing_id())
    assert distinct_documents(several).count() == 501


# --- nearest neighbours ------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["l2sq", "cosine"])
@pytest.mark.parametrize("path", ["blocks", "cells"])
def test_neighbours_against_brute_force(spark, metric, path):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 8)).astype(np.float32)
    vectors[100:200] = vectors[0]  # a third of all rows are copies
    vectors[200:240] += 20 * rng.normal(size=8)  # far away
    vectors[[7, 30]] = 0
    queries = vectors[::10]
    index = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "part_id string, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(queries)], "query_id string, embedding array<float>")
    held = retrieval.cell_index(index.repartition(7), metric) if path == "cells" else index.repartition(7)
    got = {}
    for r in retrieval.knn_join(asked, held, 4, metric, block_rows=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.part_id)
    for i, q in enumerate(queries.astype(np.float64)):
        v = vectors.astype(np.float64)
        if metric == "l2sq":
            d = ((v - q) ** 2).sum(axis=1)
        else:
            norms = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
            d = 1 - np.divide(v @ q, norms, out=np.zeros(300), where=norms > 0)
        want = [f"p{j:03d}" for j in sorted(range(300), key=lambda j: (round(d[j], 9) + 0.0, j))[:4]]
        assert got[f"q{i:02d}"] == want


def test_cells_far_away_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 50
    vectors = np.concatenate([c + rng.normal(size=(40, 6)) for c in centres])
    index = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "part_id string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(centres)], "query_id string, embedding array<double>")
    retrieval.cell_index(index, cells=24).write(str(tmp_path / "cells"))
    held = retrieval.CellIndex.read(spark, str(tmp_path / "cells"))
    assert held.rows.count() == 480 and held.cells.agg(F.sum("n")).first()[0] == 480
    same(retrieval.knn_join(asked, held, 7), retrieval.knn_join(asked, index, 7))
    share = retrieval.cells_read(asked, held, 7).agg(F.avg((F.col("first") + F.col("further")) / F.col("cells"))).first()[0]
    assert share < 0.5
    assert retrieval.knn_join(asked, retrieval.cell_index(index.limit(0)), 7).count() == 0


def test_null_keys_are_numbered(spark):
    rows = [(None, i) for i in range(30)] + [("a", i) for i in range(5)] + [(None, 7)]
    df = spark.createDataFrame(rows, "k string, t int").repartition(5)
    got = index_points(df, ["k"], ["t"]).collect()
    assert sorted((r.k or "", r.seq, r.n_points) for r in got) == sorted([("", i, 31) for i in range(31)] + [("a", i, 5) for i in range(5)])
    bare = spark.createDataFrame([(r.k, r.seq) for r in got], "k string, seq long")
    assert sorted((r.k or "", r.n_points) for r in series.with_length(bare, ("k",), block=8).collect()) == [("", 31)] * 31 + [("a", 5)] * 5


def test_oscillation_over_block_edges(spark):
    r = np.random.default_rng(5)
    rows = [(k, i, 500, float(v)) for k in ("a", None) for i, v in enumerate(r.integers(-300, 300, 500))] + [("flat", i, 200, 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, seq long, n_points long, value double").repartition(6)
    got = {x.k: (x.crossings, x.amplitude, x.oscillates) for x in series.oscillation(df, keys=("k",), block=7).collect()}
    for k, n in (("a", 500), (None, 500), ("flat", 200)):
        tail = [v for kk, i, _, v in sorted(rows, key=lambda x: x[1]) if kk == k and i >= n // 2]
        side = np.sign(np.array(tail) - np.mean(tail))
        crossings = int((side[1:] != side[:-1]).sum())
        amplitude = max(tail) - min(tail)
        assert got[k] == (crossings, amplitude, crossings >= 3 and amplitude > 100)


def test_scratch_is_cleared(spark):
    df = stored(spark.range(5), "probe")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder) and clear_scratch(spark) >= 1 and not os.path.exists(folder)


# --- plans -------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_python_and_no_nested_loop(spark):
    from geneweft.plans import load_all

    queries = load_all()[0]
    python_ones = {"embed", "hash_embed", "search", "knn_join", "retrieve_context"}
    written = {"upsert_documents", "write_rounds", "ingest_skills", "ingest_skills_stream", "read_pending_skills", "pending_after_archive", "rejected_skills"}
    for name, query in queries.items():
        if name in written | python_ones:
            continue
        text = plan(query(spark, SF))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
        assert "Python" not in text and "InPandas" not in text, name


def test_neighbours_have_no_nested_loop(spark):
    from geneweft.plans import load_all

    for name in ("search", "knn_join", "retrieve_context"):
        text = plan(load_all()[0][name](spark, SF))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name


def test_one_exchange_for_all_series_metrics(spark):
    stored = spark.createDataFrame(
        [], "design_id long, sample_id long, state_name string, species string, kind string, seq long, n_points long, time double, value double"
    ).coalesce(4)
    text = plan(series.series_metrics(stored))
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text


def test_filters_reach_the_scan(spark):
    text = plan(retrieval.exclude_experiment(table(spark, SF, "orders"), 605, "o_custkey").select("o_orderkey"))
    assert "PushedFilters: [" in text and "605" in text.split("PushedFilters")[1]
    assert "o_totalprice" not in text.split("ReadSchema")[1]


def test_noise_does_not_shuffle(spark):
    params = table(spark, SF, "part").select(F.col("p_partkey").alias("design_id"), F.lit("kd").alias("key"), F.col("p_retailprice").alias("value"))
    assert "Exchange" not in plan(sweep.noisy_parameters(params))


def test_numbering_spreads_one_hot_time(spark, monkeypatch, tmp_path):
    """A group with a single time value is dealt over many tasks and still numbered in order."""
    monkeypatch.setattr(session, "scratch_path", lambda _, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    raw = spark.range(20000).select(F.lit("hot").alias("k"), F.lit(1.0).alias("time"), (F.col("id") * 7919 % 20000).alias("event"))
    try:
        got = skew.index_points(raw.repartition(5), ["k"], ["time", "event"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.where("seq <> event or n_points <> 20000").count() == 0
    files = spark.read.parquet(str(tmp_path / "numbered")).groupBy(F.input_file_name()).count()
    assert files.agg(F.max("count")).first()[0] < 10000


def test_top_k_is_cut_before_the_shuffle(spark):
    from geneweft.plans import load_all

    for name in ("first_repeat", "failure_sample", "prefer_netlists", "context_budget", "search"):
        assert "WindowGroupLimit" in plan(load_all()[0][name](spark, SF)), name
