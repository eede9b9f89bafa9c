"""Arriving skill records: the same transform for a batch and for a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geneweft.functions.values import content_id
from geneweft.operators.components import distinct_documents
from geneweft.sources.readers import read_pending_skills
from geneweft.sources.sinks import table_exists

#: Skills that hold nothing.
EMPTY = ("{}", "[]", "null", "false", "0", "0.0", "")


def has_skills() -> Column:
    """A skills member with any content."""
    return F.coalesce(~F.col("skills").isin(*EMPTY), F.lit(False))


def skill_documents(records: DataFrame) -> DataFrame:
    """Document (the skills as JSON), metadata (all other fields) and content id of every record with skills."""
    return records.where(F.col("_corrupt_record").isNull() & has_skills()).select(
        # experiments may share a rule, so the id covers the experiment as well
        content_id(F.concat_ws("|", "experiment_id", "skills")).alias("part_id"),
        F.col("skills").alias("document"),
        F.col("fields").alias("metadata"),
        "experiment_id",
    )


def rejected_skills(records: DataFrame) -> DataFrame:
    """Malformed and skill-less records with the reason they were left."""
    reason = F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed")).when(~has_skills(), F.lit("no skills"))
    return records.withColumn("reason", reason).where("reason is not null").select("experiment_id", "reason", "_corrupt_record")


def known_elsewhere(spark: SparkSession, path: str, key: str, own: str | None) -> DataFrame | None:
    """Keys of a stored table, without the batches of the stream ``own``: these are pruned, so their files are not read."""
    if not table_exists(spark, path):
        return None
    stored = spark.read.schema(f"{key} string, batch string").parquet(path)
    return (stored if own is None else stored.where(~F.col("batch").startswith(own))).select(key)


def ingest_batch(
    records: DataFrame, index_path: str, ledger_path: str, rejects_path: str, batch: str = "all", own: str | None = None
) -> None:
    """Store one batch of records: new documents to the index, stored ids to the ledger, the rest to the rejects.

    Each table is partitioned by batch, and a batch that runs twice writes the same folders again. Index and ledger
    are asked for the keys of other writers alone: what the stream ``own`` stored before, its state has left out.
    Add to such tables through this function only.
    """
    spark = records.sparkSession
    name = batch if own else f"{batch}-{uuid.uuid4().hex[:12]}"  # runs over all files leave each other's folders alone
    records = records.persist()  # read and parsed once for documents, ledger and rejects
    try:
        good = records.where(F.col("_corrupt_record").isNull() & has_skills()).dropDuplicates(["record_id"])
        documents = distinct_documents(skill_documents(good))
        for rows, path, key in (
            (documents, index_path, "part_id"),
            (good.select("record_id", "experiment_id"), ledger_path, "record_id"),
        ):
            known = known_elsewhere(spark, path, key, own)
            fresh = rows if known is None else rows.join(known, key, "left_anti")
            fresh.write.mode("overwrite").parquet(f"{path}/batch={name}")
        rejected_skills(records).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch}")
    finally:
        records.unpersist()


def ingest_skills(
    spark: SparkSession, path: str, index_path: str, ledger_path: str, rejects_path: str, multi_line: bool = True
) -> None:
    """All pending files at once."""
    ingest_batch(read_pending_skills(spark, path, multi_line=multi_line), index_path, ledger_path, rejects_path)


def first_records(records: DataFrame) -> DataFrame:
    """The first record of every document, and of every text without one.

    On a stream Spark keeps the keys met so far in its state store, so neither index nor ledger is read to know them.
    """
    document = F.when(
        F.col("_corrupt_record").isNull() & has_skills(), content_id(F.concat_ws("|", "experiment_id", "skills"))
    )
    return records.withColumn("_first", F.coalesce(document, "record_id")).dropDuplicates(["_first"]).drop("_first")


def ingest_skills_stream(
    spark: SparkSession,
    path: str,
    index_path: str,
    ledger_path: str,
    rejects_path: str,
    checkpoint: str,
    multi_line: bool = True,
) -> StreamingQuery:
    """Every file once as it arrives; stops when the folder is used up.

    Records met before, in this run or before a restart with the same checkpoint, are left out by state.
    """

    def store(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # kept over restarts
        ingest_batch(batch, index_path, ledger_path, rejects_path, f"{own}-{number}", own)

    return (
        first_records(read_pending_skills(spark, path, True, multi_line))
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
