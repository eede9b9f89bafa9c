"""Work per row that must not multiply, and memory that must not grow with the tables."""

import json

import numpy as np
from pyspark.sql import functions as F

from geneweft.operators import mining, topology

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_mined_answer_is_parsed_once(spark):
    df = spark.createDataFrame([("{}", "yeast")], "answer string, host string")
    text = optimized(mining.mined_parameters(df.repartition(2)))
    # the result and two tests for trailing text
    assert text.count("from_json(") == 1 and text.count("TryParse") + text.count("parseJson") <= 2 and "transform(" not in text


NETLISTS = [
    ("a", {"nodes": [{"id": "n1", "name": "x", "parameters": {"kd": 1}}, None, {"id": "p", "name": "x", "protein": "P", "node_type": "NOR_GATE"}, {"id": "n1", "gate_name": "late"}],
           "edges": [{"source": "x", "target": "n1"}, {"source": "n9", "target": "x"}, None, {"source": None, "target": "x"},
                     {"source": "n1", "target": "p", "parameters": {"n": 2, "t": "text"}}]}),
    ("b", {"nodes": [{"name": "only"}, {"id": "g", "name": "only"}], "edges": [{"source": "only", "target": "g"}, {"source": "g", "target": "only"}]}),
    ("c", {"nodes": [{"id": "n"}], "edges": []}),
    ("d", {"nodes": [{"id": "n"}]}),
    ("e", {"edges": [{"source": "n", "target": "n"}]}),
    ("f", {"nodes": [], "edges": [{"source": "n", "target": "n"}]}),
]


def test_edges_meet_their_nodes_in_the_text(spark):
    rows = [(k, json.dumps(v)) for k, v in NETLISTS] + [("g", None), ("h", ""), ("i", "[1")]
    texts = spark.createDataFrame(rows, "design_id string, content string")
    shown = lambda df: sorted(map(repr, df.withColumn("parameters", F.to_json("parameters")).collect()))
    own, joined = topology.text_interactions(texts), topology.text_interactions(texts, max_bytes=0)
    assert shown(own) == shown(joined) == shown(topology.text_interactions(texts, max_bytes=120))
    assert {(r.design_id, r.edge_pos, r.source, r.target, r.type) for r in own.collect()} == {
        ("a", 0, "x", "x", "expression"), ("a", 4, "x", "P", "repression"),
        ("b", 0, "only", "only", "expression"), ("b", 1, "only", "only", "expression"),
    }
    # one parse before the edges unfold and no exchange on the way of texts of usual length
    branch = optimized(topology.parse_netlists(texts)[1]).split("Join")[0]
    assert branch.count("from_json(") == 1 and "Aggregate" not in branch
    assert optimized(topology.parse_netlists(texts)[0]).count("from_json(") == 1


def test_dealt_edges_are_the_same_edges(spark):
    from geneweft.operators.skew import index_points
    from geneweft.plans import views as V

    nodes, edges = V.nodes(spark, SF, 37), V.edges(spark, SF)
    plain = topology.netlist_interactions(nodes, edges)
    parts = topology.netlist_interactions(nodes, edges, 37)
    shown = lambda df: sorted(map(repr, df.collect()))
    assert shown(parts) == shown(plain)
    signed = plain.withColumn("type", F.lit("repress"))
    assert shown(topology.regulators(signed, 37)) == shown(topology.regulators(signed))
    # the number of tasks holds at every step that sorts rows, whatever Spark's settings say
    assert optimized(parts).count("RepartitionByExpression") >= 6 and ", 37" in optimized(parts)
    # nodes are dealt before their copies are removed, not held by the tasks of the scan
    assert optimized(nodes).index("Aggregate") < optimized(nodes).index("RepartitionByExpression")
    raw = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(300)], "k string, t int")
    got = index_points(raw.repartition(5), ["k"], ["t"], tasks=7)
    assert all(r.seq == r.t and r.n_points == 300 for r in got.collect()) and got.count() == 600


def test_texts_and_visits_stay_in_small_pieces(spark, monkeypatch):
    from geneweft.operators import retrieval

    texts = spark.range(1000, numPartitions=1).select("id", F.repeat(F.lit("word "), 50).alias("document"))
    embedded = retrieval.embed(texts, lambda batch: [[float(len(batch))] for _ in batch])
    assert embedded.schema["embedding"].dataType.simpleString() == "array<float>"
    assert embedded.agg(F.max(F.col("embedding")[0])).first()[0] == 64
    # the texts of a whole batch never become Python objects at once
    plan = embedded._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 4))
    index = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(vectors)], "part_id string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i:02d}", v.tolist()) for i, v in enumerate(vectors[:30])], "query_id string, embedding array<double>")
    plain = retrieval.knn_join(asked, index, 6)
    monkeypatch.setattr(retrieval, "STEP_NUMBERS", 40)  # ten visits, two rows against the pivots
    pruned = retrieval.knn_join(asked, retrieval.cell_index(index), 6)
    assert sorted(map(repr, pruned.collect())) == sorted(map(repr, plain.collect()))
