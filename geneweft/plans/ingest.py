"""Queries that write through a sink (or a stream) to the shared folder and read the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.operators import runs as O
from geneweft.operators.components import with_ids
from geneweft.plans import views as V
from geneweft.plans.registry import query, table
from geneweft.session import scratch_path
from geneweft.sources import sinks as K
from geneweft.sources.readers import read_pending_skills
from geneweft.streaming import skills as S


@query(
    "upsert_documents",
    "select 'part_' || substr(sha256(text), 1, 16) as part_id, count(distinct text) as n from documents group by all",
)
def _upsert(spark, sf):
    """The labelled documents first, then all of them, then all again: every id is stored once."""
    documents = table(spark, sf, "documents")
    labelled = with_ids(documents.join(table(spark, sf, "labels"), "doc_id", "left_semi").select("text"), "text")
    everything = with_ids(documents.select("text"), "text")
    path = scratch_path(spark, "index")
    for batch in (labelled, everything, everything):
        K.upsert_documents(batch, path)
    return spark.read.parquet(path).groupBy("part_id").agg(F.count("text").alias("n"))


@query(
    "write_rounds",
    V.with_sql(
        V.TURNS_SQL,
        """rounds as (select session_id as run_id, round_number, arg_max(text, turn) filter (role = 'builder') as b,
          arg_max(text, turn) filter (role = 'critic') as c from t6 group by all)""",
    )
    + """select run_id, round_number, 'design_A.v' as artefact, coalesce(b, '') as content from rounds
      union all select run_id, round_number, 'design_B.v', 'module' from rounds
      union all select run_id, round_number, 'topologies.json', '[{"run":' || run_id || '},{"round":' || round_number || '}]' from rounds
      union all select run_id, round_number, 'critic_decision.txt', c from rounds where c is not null""",
)
def _write_rounds(spark, sf):
    rounds = O.round_records(V.turns(spark, sf)).select(
        F.col("session_id").alias("run_id"),
        "round_number",
        F.array(F.coalesce("builder_output", F.lit("")), F.lit("module")).alias("codes"),
        F.array(
            F.concat(F.lit('{"run":'), "session_id", F.lit("}")), F.concat(F.lit('{"round":'), "round_number", F.lit("}"))
        ).alias("topologies"),
        "critic_output",
    )
    path = scratch_path(spark, "rounds")
    for _ in range(2):  # a rerun adds nothing
        K.write_rounds(K.round_artefacts(rounds), path, buckets=4)
    return spark.read.parquet(path).select("run_id", F.col("round_number").cast("long"), "artefact", "content")


# --- skill records -----------------------------------------------------------------------

RULE = "case when user_id % 3 = 0 then concat('rule of ', event_type) end"


DOCUMENT_SQL = """'{"module_2_functional":{"has_skill":true' || case when user_id % 3 = 0 then ',"rule_summary":"rule of ' || event_type || '"' else '' end
      || '}' || case when user_id % 5 = 0 then ',"module_4_new":{"confidence":0.5}' else '' end || '}'"""


def pending_json(spark, sf):
    """Events as pending skill files; errors carry no skills, and some records have modules and fields of their own."""
    skills = F.when(
        F.col("event_type") != "error",
        F.struct(
            F.struct(F.lit(True).alias("has_skill"), F.expr(RULE).alias("rule_summary")).alias("module_2_functional"),
            F.when(F.col("user_id") % 5 == 0, F.struct(F.lit(0.5).alias("confidence"))).alias("module_4_new"),
        ),
    )
    records = table(spark, sf, "events").select(
        F.concat(F.lit("EXP-"), "event_id").alias("experiment_id"),
        F.col("event_type").alias("user_intent"),
        F.lit("Escherichia coli").alias("host_organism"),
        F.col("value").alias("final_score"),
        F.expr("cast(user_id as int)").alias("iterations"),
        F.when(F.col("user_id") % 7 == 0, F.lit("north")).alias("lab"),
        skills.alias("skills"),
    )
    path = scratch_path(spark, "pending")
    records.write.json(path)
    return path


def stored(spark, index):
    return spark.read.parquet(index).select(
        "experiment_id", "document", F.element_at("metadata", F.lit("user_intent")).alias("user_intent"),
        F.element_at("metadata", F.lit("final_score")).cast("double").alias("final_score"), F.size("metadata").alias("n_fields"),
    )


STORED_SQL = f"""select 'EXP-' || event_id as experiment_id, {DOCUMENT_SQL} as document, event_type as user_intent,
      round(value, 6) as final_score, 5 + case when user_id % 7 = 0 then 1 else 0 end as n_fields from events where event_type <> 'error'"""


@query(
    "read_pending_skills",
    f"""select 'EXP-' || event_id as experiment_id, event_type as user_intent, user_id as iterations,
      case when event_type <> 'error' then {DOCUMENT_SQL} end as skills from events""",
)
def _pending(spark, sf):
    rows = read_pending_skills(spark, pending_json(spark, sf), multi_line=False)
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return rows.select("experiment_id", field("user_intent").alias("user_intent"), field("iterations").cast("long").alias("iterations"), "skills")


@query("ingest_skills", STORED_SQL)
def _ingest(spark, sf):
    """The same files twice; every record is stored once."""
    path = pending_json(spark, sf)
    index, ledger, rejects = (scratch_path(spark, n) for n in ("index", "ledger", "rejects"))
    for _ in range(2):
        S.ingest_skills(spark, path, index, ledger, rejects, multi_line=False)
    return stored(spark, index)


@query("ingest_skills_stream", STORED_SQL)
def _stream(spark, sf):
    """As ingest_skills, from a file stream that is restarted once."""
    path = pending_json(spark, sf)
    index, ledger, rejects, checkpoint = (scratch_path(spark, n) for n in ("index", "ledger", "rejects", "state"))
    for _ in range(2):
        S.ingest_skills_stream(spark, path, index, ledger, rejects, checkpoint, multi_line=False).awaitTermination()
    return stored(spark, index)


@query(
    "write_skills",
    f"""select 'EXP-' || event_id as experiment_id, {DOCUMENT_SQL} as skills, count(*) over (partition by event_id) as n
      from events where event_type <> 'error'""",
)
def _write_skills(spark, sf):
    """Packages written twice and read back: each record is there once."""
    records = spark.read.json(pending_json(spark, sf)).where("skills is not null")
    packages, path = K.package_skills(records, ["experiment_id", "iterations"]), scratch_path(spark, "packages")
    for _ in range(2):
        K.write_skills(packages, path)
    back = read_pending_skills(spark, path, multi_line=False)
    return back.groupBy("experiment_id", "skills").agg(F.count(F.lit(1)).alias("n"))


@query(
    "second_record_of_an_experiment",
    f"""select 'EXP-' || event_id as experiment_id, user_id % 5 = 0 as changed, count(*) as n
      from events, (values (false), (true)) v(later) where event_type <> 'error' and (not later or user_id % 5 = 0) group by all""",
)
def _second(spark, sf):
    """A later file with new skills for a known experiment is stored beside the first."""
    first = pending_json(spark, sf)
    changed = spark.read.json(first).where("skills.module_4_new is not null").select("*", F.lit("later").alias("note"))
    changed = changed.withColumn("skills", F.struct(F.struct(F.lit(True).alias("has_skill")).alias("module_5_later")))
    later = scratch_path(spark, "pending")
    changed.write.json(later)
    index, ledger, rejects = (scratch_path(spark, n) for n in ("index", "ledger", "rejects"))
    for path in (first, later, first):
        S.ingest_skills(spark, path, index, ledger, rejects, multi_line=False)
    return spark.read.parquet(index).groupBy("experiment_id").agg((F.count(F.lit(1)) > 1).alias("changed"), F.count(F.lit(1)).alias("n"))


@query("pending_after_archive", "select 'EXP-' || event_id as experiment_id from events where event_type = 'error'")
def _archive(spark, sf):
    """What is still pending once the records with skills are in the ledger."""
    records = read_pending_skills(spark, pending_json(spark, sf), multi_line=False)
    ledger = scratch_path(spark, "ledger")
    K.archive_ingested(records.withColumn("has_skills", S.has_skills()), ledger)
    return K.pending_records(records, ledger).select("experiment_id")


@query("rejected_skills", "select 'EXP-' || event_id as experiment_id, 'no skills' as reason from events where event_type = 'error'")
def _rejected(spark, sf):
    records = read_pending_skills(spark, pending_json(spark, sf), multi_line=False)
    return S.rejected_skills(records).select("experiment_id", "reason")
