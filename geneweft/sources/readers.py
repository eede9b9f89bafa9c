"""Readers: component collections, catalogues, netlists, pages and pending skill files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geneweft.functions.text import BLANK
from geneweft.functions.values import content_id, is_json
from geneweft.operators.components import parse_components


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: (path, content)."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_components(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Component records of all JSON files under a path, and the files that could not be used."""
    return parse_components(read_texts(spark, path))


def explode_catalogue(files: DataFrame, text: str = "content") -> DataFrame:
    """Entries of catalogue texts, each a JSON array of strings."""
    return files.select(
        *[c for c in files.columns if c != text], F.posexplode(F.from_json(text, "array<string>")).alias("pos", "entry")
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Entries of fallback catalogues: (path, pos, entry)."""
    return explode_catalogue(read_texts(spark, path))


def catalogue_context(files: DataFrame, text: str = "content") -> DataFrame:
    """The entries of each catalogue joined by newline, straight from the parsed array."""
    return files.withColumn("context", F.array_join(F.from_json(text, "array<string>"), "\n")).drop(text)


def prefer_netlists(files: DataFrame) -> DataFrame:
    """One file per folder: a ``*_netlist.json`` if there is one, else any ``*.json``, by name."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    preferred = F.when(F.col("path").endswith("_netlist.json"), 0).otherwise(1)
    order = Window.partitionBy("folder").orderBy(preferred, "path")
    return (
        files.where(F.col("path").endswith(".json"))
        .withColumn("folder", folder)
        .withColumn("_rn", F.row_number().over(order))
        .where("_rn = 1")
        .drop("_rn")
    )


def read_netlists(spark: SparkSession, path: str) -> DataFrame:
    """Preferred netlist of every folder below a path: (design_id, path, content).

    Files are chosen by name alone; then only the chosen ones are joined to their text.
    """
    files = read_texts(spark, path, "*.json")
    chosen = prefer_netlists(files.select("path")).withColumnRenamed("folder", "design_id")
    return chosen.join(files, "path").select("path", "content", "design_id")


def missing_netlists(folders: DataFrame, netlists: DataFrame) -> DataFrame:
    """Error rows for folders without any JSON output."""
    return folders.join(netlists.select("design_id"), "design_id", "left_anti").withColumn(
        "error", F.lit("no netlist found")
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages as a table (page_id, url, html[, failure]); nothing is fetched inside the job."""
    return spark.read.parquet(path)


def page_lines(pages: DataFrame, failure: str | None = None) -> DataFrame:
    """Pages with ``scrape_note``: null for a fetched page, a failure line for one without content."""
    reason = F.col(failure) if failure else F.lit("empty response")
    failed = F.col("html").isNull() | (F.trim("html") == "")
    return pages.withColumn(
        "scrape_note", F.when(failed, F.concat(F.lit("Failed to scrape "), F.col("url"), F.lit(": "), reason))
    )


def read_pending_skills(
    spark: SparkSession, path: str, streaming: bool = False, multi_line: bool = True
) -> DataFrame:
    """Skill records of all ``*.json`` files: (record_id, experiment_id, fields, skills, _corrupt_record).

    ``fields`` holds every member but ``skills`` as text, ``skills`` is its JSON. A text that is not a
    JSON object stands in ``_corrupt_record``. ``record_id`` is the content id of the text.
    ``multi_line`` is for one record per file; otherwise every line is a record.
    """
    reader = spark.readStream if streaming else spark.read
    raw = reader.option("pathGlobFilter", "*.json").text(path, wholetext=multi_line)
    text = F.col("value")
    good = is_json(text) & F.ltrim(text, F.lit(BLANK)).startswith("{")
    members = F.when(good, F.from_json(text, "map<string,string>"))
    return raw.where(F.trim(text, F.lit(BLANK)) != "").select(
        content_id(text).alias("record_id"),
        F.try_element_at(members, F.lit("experiment_id")).alias("experiment_id"),
        F.map_filter(members, lambda k, v: (k != "skills") & v.isNotNull()).alias("fields"),
        F.try_element_at(members, F.lit("skills")).alias("skills"),
        F.when(~good, text).alias("_corrupt_record"),
    )
