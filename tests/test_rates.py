"""Rates from packed edges against loops over single snapshots."""

import math

from pyspark.sql import functions as F

from geneweft.operators import rates
from geneweft.operators.topology import expand_topology

ROWS = "design_id long, t long, species string, protein double, mrna double, params map<string,double>"
EDGES = "design_id long, edge_pos int, source string, target string, type string"
INDUCERS = "design_id long, inducer string, species string, level double, pos int"

PARAMS = {"kd": 50.0, "n_B": 3.0, "kd_inducer_IPTG": 10.0}
SNAPSHOTS = [
    (1, 0, "A", 10.0, 1.0, PARAMS), (1, 0, "B", 80.0, 2.0, PARAMS), (1, 0, "C", None, 3.0, PARAMS),
    (1, 1, "A", 0.0, 1.0, PARAMS), (1, 1, "A", 30.0, 1.0, PARAMS), (1, 1, "C", 5.0, 0.0, PARAMS),
    (2, 0, "A", 7.0, 1.0, {}), (2, 0, None, 7.0, 1.0, {}), (None, 0, "A", 1.0, 1.0, {}),
]
INTERACTIONS = [
    (1, 0, "A", "B", "repression"), (1, 1, "A", "B", "repress"), (1, 2, "B", "C", "activation"), (1, 3, "C", "A", "repression"),
    (1, 4, "A", "C", "unknown"), (1, 5, "gone", "A", "repression"), (3, 0, "A", "A", "repression"),
]
ACTING = [(1, "IPTG", "A", 900.0, 0), (1, "aTc", "A", 40.0, 1), (1, "IPTG", "B", 5.0, 0), (1, "IPTG", None, 5.0, 0)]
SIGNS = {"repression": "repression", "repress": "repression", "activation": "activation"}


def tables(spark):
    return spark.createDataFrame(SNAPSHOTS, ROWS), spark.createDataFrame(INTERACTIONS, EDGES), spark.createDataFrame(ACTING, INDUCERS)


def acting(design, species):
    found = [(pos, name, level) for d, name, s, level, pos in ACTING if d == design and s == species and s is not None]
    return max(found)[1:] if found else (None, None)


def factor(row, sign, cfg):
    design, _, species, protein, _, params = row
    if protein is None:
        return 1.0
    get = lambda key, default: params.get(f"{key}_{species}", params.get(key, default))
    inducer, level = acting(design, species)
    if sign == "repression" and inducer:
        ratio = (level or 0.0) / params.get(f"kd_inducer_{inducer}", cfg.kd_inducer)
        protein = protein / (1 + ratio ** params.get(f"n_inducer_{inducer}", cfg.n_inducer))
    x = (protein / get("kd", cfg.kd)) ** get("n", cfg.n)
    return 1 / (1 + x) if sign == "repression" else x / (1 + x)


def test_activity_against_loops(spark):
    snapshots, interactions, inducers = tables(spark)
    cfg = rates.RateConfig()
    got = rates.promoter_activity(snapshots, interactions, ("t",), inducers).collect()
    expected = []
    for row in SNAPSHOTS:
        activity = 1.0
        for design, _, source, target, kind in INTERACTIONS:
            if design == row[0] and target == row[2] and kind in SIGNS:
                for other in SNAPSHOTS:
                    if other[:2] == row[:2] and other[2] == source:
                        activity *= factor(other, SIGNS[kind], cfg)
        expected.append((*row[:5], activity))
    key = lambda r: tuple((v is None, v or 0) if not isinstance(v, str) else (False, v) for v in r[:4])
    got = sorted(((r.design_id, r.t, r.species or "", r.protein, r.mrna, r.activity) for r in got), key=key)
    expected = sorted(((d, t, s or "", p, m, a) for d, t, s, p, m, a in expected), key=key)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(math.isclose(g[5], e[5], rel_tol=1e-12) for g, e in zip(got, expected))


def test_every_interaction_of_a_snapshot(spark):
    snapshots, interactions, inducers = tables(spark)
    got = expand_topology(snapshots, interactions, inducers, ("t",))
    expected = sorted(
        (row[0], row[1], pos, source, target, SIGNS[kind], *acting(row[0], source))
        for row in SNAPSHOTS for design, pos, source, target, kind in INTERACTIONS
        if design == row[0] and source == row[2] and kind in SIGNS
    )
    columns = ["design_id", "t", "edge_pos", "source", "target", "sign", "inducer", "inducer_level"]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(expected, key=key)


def test_one_exchange_of_snapshots(spark):
    snapshots, interactions, inducers = tables(spark)
    hot = snapshots.where("design_id = 1").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(999))))
    table = rates.rate_table(hot, interactions, ("t",), inducers)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "Generate" not in plan.split("REPARTITION_BY_COL")[0]
    loads = rates.resource_load(rates.promoter_activity(hot, interactions, ("t",), inducers), ("t",))
    assert table.select("t", F.round("rnap_load", 9)).distinct().count() == loads.count() == 1000
    assert table.where("tx_rate is null").count() == 0


def test_without_rows(spark):
    snapshots, interactions, inducers = tables(spark)
    assert rates.rate_table(snapshots.limit(0), interactions, ("t",), inducers).count() == 0
    bare = rates.promoter_activity(snapshots, interactions.limit(0), ("t",), None)
    assert {r.activity for r in bare.collect()} == {1.0} and bare.count() == len(SNAPSHOTS)
