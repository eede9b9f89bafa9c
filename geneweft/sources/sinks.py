"""Sinks: index append, round artefacts, skill packages and the ingest ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geneweft.operators.components import distinct_documents, missing_documents


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop)


def upsert_documents(new: DataFrame, index_path: str) -> None:
    """Append the documents (by ``part_id``) an index folder lacks, each once.

    Only the ids of the index are read; the folder is created when absent.
    """
    spark = new.sparkSession
    if table_exists(spark, index_path):
        rows = missing_documents(new, spark.read.parquet(index_path))
    else:
        rows = distinct_documents(new)
    rows.write.mode("append").parquet(index_path)


def append_missing(new: DataFrame, path: str, keys: list[str], **layout) -> None:
    """Append the rows whose keys a Parquet folder lacks, so that a rerun stores nothing twice."""
    spark = new.sparkSession
    if table_exists(spark, path):
        new = new.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    writer = new.write.mode("append")
    (writer.partitionBy(*layout["partition_by"]) if layout else writer).parquet(path)


def candidate_letter(pos: Column) -> Column:
    """A for position 0, B for 1 and so on."""
    return F.char(pos + 65)


def candidate_file(pos: Column) -> Column:
    return F.concat(F.lit("design_"), candidate_letter(pos), F.lit(".v"))


def round_artefacts(runs: DataFrame) -> DataFrame:
    """One row per artefact of a round: (run_id, round_number, artefact, content).

    runs: (run_id, round_number, codes array, topologies array of JSON, critic_output). Codes
    give one file each, the topologies one JSON document, the critic one text.
    """
    keys = ["run_id", "round_number"]
    codes = runs.select(*keys, F.posexplode("codes").alias("pos", "content")).select(
        *keys, candidate_file(F.col("pos")).alias("artefact"), "content"
    )
    topologies = runs.where(F.size("topologies") > 0).select(
        *keys,
        F.lit("topologies.json").alias("artefact"),
        F.concat(F.lit("["), F.array_join("topologies", ","), F.lit("]")).alias("content"),
    )
    critic = runs.where("critic_output is not null").select(
        *keys, F.lit("critic_decision.txt").alias("artefact"), F.col("critic_output").alias("content")
    )
    return codes.unionByName(topologies).unionByName(critic)


def write_rounds(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Write round artefacts partitioned by round and by a hash bucket of the run.

    A folder per run would make millions of small files, so runs share ``buckets`` folders
    and stay a column; rows of a run are written together.
    """
    bucketed = df.withColumn("run_bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))
    dealt = bucketed.repartition("round_number", "run_bucket", F.col("artefact"))
    append_missing(dealt, path, ["run_id", "round_number", "artefact"], partition_by=("round_number", "run_bucket"))


def write_specifications(df: DataFrame, path: str) -> None:
    """Final specification per run: (run_id, specification); runs that have one are left out."""
    append_missing(df.where("specification is not null"), path, ["run_id"])


def skill_file_id(experiment: Column) -> Column:
    return F.concat(F.lit("skill_"), F.translate(experiment, ": ", "-_"), F.lit(".json"))


def package_skills(df: DataFrame, metadata: list[str], skills: str = "skills") -> DataFrame:
    """File id, JSON and fields of every experiment: metadata and skills, the JSON without null fields."""
    record = F.struct(*metadata, skills)
    return df.select(
        F.col("experiment_id"),
        skill_file_id(F.col("experiment_id")).alias("file_id"),
        F.to_json(record).alias("package"),
        record.alias("record"),
    )


def write_skills(packages: DataFrame, path: str) -> None:
    """One JSON record per line in ``*.json`` files under a staging folder, each once.

    ``read_pending_skills(..., multi_line=False)`` reads them back.
    """
    spark = packages.sparkSession
    if table_exists(spark, path):
        packages = packages.join(spark.read.text(path).select(F.col("value").alias("package")).distinct(), "package", "left_anti")
    packages.select("record.*").write.mode("append").json(path)


def archive_ingested(records: DataFrame, ledger_path: str) -> None:
    """Enter stored records in the ledger by their content; records without skills are not entered and stay pending."""
    spark = records.sparkSession
    stored = records.where("has_skills").select("record_id", "experiment_id").dropDuplicates(["record_id"])
    if table_exists(spark, ledger_path):
        stored = stored.join(spark.read.parquet(ledger_path), "record_id", "left_anti")
    stored.write.mode("append").parquet(ledger_path)


def pending_records(records: DataFrame, ledger_path: str) -> DataFrame:
    """Records whose content the ledger does not list; a changed record of a known experiment is pending."""
    spark = records.sparkSession
    if not table_exists(spark, ledger_path):
        return records
    return records.join(spark.read.parquet(ledger_path).select("record_id"), "record_id", "left_anti")
