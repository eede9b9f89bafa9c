"""Files in and out, and the skill stream with restart and repeated delivery."""

import json

import pytest
from pyspark.sql import functions as F

from geneweft.operators.components import with_ids
from geneweft.session import scratch_path
from geneweft.sources import readers, sinks
from geneweft.streaming import skills


def write(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")


def test_component_files(spark, tmp_path):
    write(tmp_path, "a.json", '﻿{"UCF":[{"collection":"gates","name":"A"}]}')
    write(tmp_path, "b.json", "[1, {\n \"type\": \"input_sensors\",\n \"id\": \"S\"}]")
    write(tmp_path, "c.json", "{oops")
    records, broken = readers.read_components(spark, str(tmp_path))
    assert {(r.name, r.collection) for r in records.collect()} == {("A", "gates"), ("S", "input_sensors")}
    assert [r.path.rsplit("/", 1)[1] for r in broken.collect()] == ["c.json"]


def test_catalogue(spark, tmp_path):
    write(tmp_path, "c.json", '["one",\n "two"]')
    assert [(r.pos, r.entry) for r in readers.read_catalogue(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "one"), (1, "two")]


def test_netlist_files(spark, tmp_path):
    write(tmp_path / "d1", "a.json", "{}")
    write(tmp_path / "d1", "z_netlist.json", '{"nodes":[],"edges":[]}')
    write(tmp_path / "d2", "b.json", "{}")
    write(tmp_path / "d3", "x.log", "")
    got = readers.read_netlists(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1] for r in got.collect()} == {"z_netlist.json", "b.json"}
    folders = got.select("design_id").union(spark.createDataFrame([("nowhere",)], "design_id string"))
    assert [r.design_id for r in readers.missing_netlists(folders, got).collect()] == ["nowhere"]


def test_upsert(spark):
    path = scratch_path(spark, "index")
    docs = lambda *t: with_ids(spark.createDataFrame([(x,) for x in t], "document string"))
    sinks.upsert_documents(docs("a", "a", "b", " "), path)
    sinks.upsert_documents(docs("b", "c"), path)
    assert sorted(r.document for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_round_files(spark):
    runs = spark.createDataFrame(
        [("r", 1, ["x", "y"], ["{}"], "ok"), ("r", 2, [], [], None)],
        "run_id string, round_number int, codes array<string>, topologies array<string>, critic_output string",
    )
    path = scratch_path(spark, "rounds")
    sinks.write_rounds(sinks.round_artefacts(runs), path)
    got = {(r.round_number, r.artefact): r.content for r in spark.read.parquet(path).collect()}
    assert got == {(1, "design_A.v"): "x", (1, "design_B.v"): "y", (1, "topologies.json"): "[{}]", (1, "critic_decision.txt"): "ok"}
    spec = scratch_path(spark, "spec")
    sinks.write_specifications(spark.createDataFrame([("r", "text"), ("s", None)], "run_id string, specification string"), spec)
    assert spark.read.parquet(spec).count() == 1


def record(i, has=True):
    body = {"experiment_id": f"E:{i} x", "user_intent": "i", "final_score": 1.5, "iterations": 2}
    if has:
        body["skills"] = {"module_1_plausibility": {"has_skill": True}}
    return json.dumps(body, indent=1)


def test_skill_packages(spark):
    df = spark.createDataFrame([("E:1 x", None, 2)], "experiment_id string, user_intent string, iterations int").withColumn(
        "skills", F.from_json(F.lit('{"module_3_kinetic":{"has_skill":true}}'), "struct<module_3_kinetic:struct<has_skill:boolean,rule_summary:string>>")
    )
    row = sinks.package_skills(df, ["experiment_id", "user_intent", "iterations"]).first()
    assert row.file_id == "skill_E-1_x.json"
    assert json.loads(row.package) == {"experiment_id": "E:1 x", "iterations": 2, "skills": {"module_3_kinetic": {"has_skill": True}}}
    path = scratch_path(spark, "packages")
    sinks.write_skills(sinks.package_skills(df, ["experiment_id"]), path)
    sinks.write_skills(sinks.package_skills(df, ["experiment_id"]), path)
    back = readers.read_pending_skills(spark, path, multi_line=False).collect()
    assert [(r.experiment_id, r.skills) for r in back] == [("E:1 x", '{"module_3_kinetic":{"has_skill":true}}')]


@pytest.fixture
def places(spark):
    return [scratch_path(spark, n) for n in ("index", "ledger", "rejects")]


def fill(folder):
    write(folder, "a.json", record(1))
    write(folder, "b.json", record(2, has=False))
    write(folder, "c.json", "{broken")
    write(folder, "d.txt", record(3))
    write(folder, "e.json", json.dumps({"experiment_id": "E:5", "skills": {}}))


def contents(spark, places):
    index, ledger, rejects = places
    return (
        sorted(tuple(r) for r in spark.read.parquet(index).select("experiment_id", "document").collect()),
        sorted(r[0] for r in spark.read.parquet(ledger).select("experiment_id").collect()),
        sorted((r.experiment_id or "", r.reason) for r in spark.read.parquet(rejects).collect()),
    )


def test_batch_and_stream_agree(spark, tmp_path, places):
    folder = tmp_path / "pending"
    fill(folder)
    skills.ingest_skills(spark, str(folder), *places)
    batch = contents(spark, places)
    assert [b[0] for b in batch[0]] == ["E:1 x"] and batch[1] == ["E:1 x"]
    assert batch[2] == [("", "malformed"), ("E:2 x", "no skills"), ("E:5", "no skills")]
    row = spark.read.parquet(places[0]).first()
    assert row.metadata == {"experiment_id": "E:1 x", "user_intent": "i", "final_score": "1.5", "iterations": "2"}

    others = [scratch_path(spark, n) for n in ("index", "ledger", "rejects")]
    checkpoint = scratch_path(spark, "state")
    skills.ingest_skills_stream(spark, str(folder), *others, checkpoint).awaitTermination()
    assert contents(spark, others) == batch
    # restart: a new record and one delivered again under another name
    write(folder, "f.json", record(6))
    write(folder, "g.json", record(1))
    skills.ingest_skills_stream(spark, str(folder), *others, checkpoint).awaitTermination()
    stored, ledger, _ = contents(spark, others)
    assert [s[0] for s in stored] == ["E:1 x", "E:6 x"] and ledger == ["E:1 x", "E:6 x"]


def test_replayed_batch_and_other_writers(spark, tmp_path, places):
    folder, more = tmp_path / "pending", tmp_path / "more"
    write(folder, "a.json", record(1))
    write(folder, "b.json", record(2))
    records = readers.read_pending_skills(spark, str(folder))
    for _ in range(2):  # a batch delivered twice
        skills.ingest_batch(records, *places, "q-0", "q")
    assert [d[0] for d in contents(spark, places)[0]] == ["E:1 x", "E:2 x"]
    # what others stored is found, also by a stream whose state is empty
    write(more, "c.json", record(2))
    write(more, "d.json", record(3))
    skills.ingest_skills(spark, str(more), *places)
    stream = lambda: skills.ingest_skills_stream(spark, str(folder), *places, scratch_path(spark, "state")).awaitTermination()
    stream()
    write(folder, "e.json", record(3))
    stream()
    stored, ledger, _ = contents(spark, places)
    assert [d[0] for d in stored] == ledger == ["E:1 x", "E:2 x", "E:3 x"]


def test_stream_reads_only_its_batch(spark, tmp_path, places):
    folder, checkpoint = tmp_path / "pending", scratch_path(spark, "state")
    stream = lambda: skills.ingest_skills_stream(spark, str(folder), *places, checkpoint)
    write(folder, "a.json", record(1))
    first = stream()
    first.awaitTermination()
    write(folder, "b.json", record(1))
    write(folder, "c.json", record(2))
    second = stream()
    second.awaitTermination()
    assert first.id == second.id
    assert second.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
    own = {r.batch for r in spark.read.parquet(places[0]).select("batch").collect()}
    assert own == {f"{first.id}-0", f"{first.id}-1"}
    for path, key in zip(places, ("part_id", "record_id")):
        others = skills.known_elsewhere(spark, path, key, str(first.id))
        assert others.count() == 0
        plan = others._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(batch" in plan


def test_pages_and_failures(spark):
    df = spark.createDataFrame([("u", "<p>x</p>", None), ("v", None, "timeout")], "url string, html string, failure string")
    assert [r.scrape_note for r in readers.page_lines(df, "failure").collect()] == [None, "Failed to scrape v: timeout"]
