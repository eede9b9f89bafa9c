"""Batch requests: input guards, validation and dispatch by operator name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geneweft.config import GUARD_TEXT
from geneweft.functions.text import is_error
from geneweft.functions.values import is_json, literal_map
from geneweft.session import scratch_path

BLANK = " \n\r\t"
#: Route of the requests that no operator takes.
UNKNOWN = -1


def guard_inputs(df: DataFrame, text: str = "code") -> tuple[DataFrame, DataFrame]:
    """Usable inputs, and error rows for blank texts and texts that already report an error."""
    body = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANK))
    error = F.when(body == "", F.lit(GUARD_TEXT["blank"])).when(
        is_error(body), F.concat(F.lit(GUARD_TEXT["invalid"]), body)
    )
    flagged = df.withColumn("error", error)
    return flagged.where("error is null").drop("error"), flagged.where("error is not null").drop(text)


def validate_requests(df: DataFrame, arguments: str = "arguments", query: str = "query", default_n: int = 5) -> DataFrame:
    """Query and result count out of JSON arguments; every failure has its own error text."""
    text = F.when(F.coalesce(F.col(arguments), F.lit("")) == "", F.lit("{}")).otherwise(F.col(arguments))
    fields = F.from_json(text, "map<string,string>")
    bad_json = ~is_json(text) | fields.isNull()
    asked = F.trim(F.coalesce(F.try_element_at(fields, F.lit(query)), F.lit("")), F.lit(BLANK))
    raw_n = F.try_element_at(fields, F.lit("n_results"))
    n = F.when(F.map_contains_key(fields, "n_results"), F.trim(raw_n).try_cast("double").try_cast("int")).otherwise(F.lit(default_n))
    error = (
        F.when(bad_json, F.lit("TOOL_ERROR: invalid JSON"))
        .when(n.isNull(), F.concat(F.lit("TOOL_ERROR: n_results is not an integer: "), F.coalesce(raw_n, F.lit("null"))))
        .when(asked == "", F.lit("TOOL_ERROR: blank query"))
    )
    return df.withColumn("error", error).withColumns(
        {
            "query": F.when(F.col("error").isNull(), asked),
            "n_results": F.when(F.col("error").isNull(), n.cast("long")),
        }
    )


def dispatch(requests: DataFrame, registry: dict[str, Callable[[DataFrame], DataFrame]], name: str = "tool") -> DataFrame:
    """Run every request with the operator of its name; an unknown name gives an error row.

    An operator takes its requests and returns (request_id, content). The requests are read once whatever the
    number of operators: one pass writes them to the shared folder by operator, and each reads its own part.
    """
    spark = requests.sparkSession
    routes = literal_map({tool: float(n) for n, tool in enumerate(registry)}) if registry else None
    route = F.coalesce(F.try_element_at(routes, F.col(name)).cast("int"), F.lit(UNKNOWN)) if registry else F.lit(UNKNOWN)
    path = scratch_path(spark, "requests")
    requests.withColumn("_route", route).write.partitionBy("_route").parquet(path)
    dealt = spark.read.schema(T.StructType([*requests.schema.fields, T.StructField("_route", T.IntegerType())])).parquet(path)
    part = lambda n: dealt.where(F.col("_route") == n).drop("_route")
    answers = part(UNKNOWN).select(
        "request_id",
        F.concat(F.lit("TOOL_ERROR: unknown tool `"), F.coalesce(F.col(name), F.lit("")), F.lit("`")).alias("content"),
    )
    for n, run in enumerate(registry.values()):
        answers = answers.unionByName(run(part(n)).select("request_id", "content"))
    return answers
