"""Parameters out of page text: units, host baselines, completion and request context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geneweft.config import CONTEXT_TEXT, KM_DEFAULTS
from geneweft.functions.text import html_text, relevant_paragraphs, strip_fences
from geneweft.functions.units import canonical_parameter, host_baseline, normalize_host, normalize_unit
from geneweft.functions.values import is_json, literal_map
from geneweft.schemas import MINED


def normalize_units(df: DataFrame) -> DataFrame:
    """Add ``norm_value`` and ``unit_error`` to rows of (param_type, raw_value, raw_unit)."""
    result = normalize_unit(F.col("raw_value"), F.col("raw_unit"), F.col("param_type"))
    return (
        df.withColumn("_n", result)
        .withColumn("norm_value", F.col("_n.value"))
        .withColumn("unit_error", F.col("_n.error"))
        .drop("_n")
    )


def with_host_baseline(df: DataFrame, host: str = "host") -> DataFrame:
    """Add the normalised host and its baseline parameter map (a literal table, no join)."""
    return df.withColumn("host_norm", normalize_host(F.col(host))).withColumn(
        "baseline", host_baseline(F.col("host_norm"))
    )


def complete_parameters(requests: DataFrame, mined: DataFrame) -> DataFrame:
    """Value of every requested key: the mined one, else the baseline of the host.

    requests: (request_id, key, host); mined: (request_id, param_type, norm_value), one row per
    request and parameter. An unknown key stands for ``kd``.
    """
    canonical = with_host_baseline(requests).withColumn("param_type", canonical_parameter(F.col("key")))
    joined = canonical.join(
        mined.select("request_id", "param_type", "norm_value"), ["request_id", "param_type"], "left"
    )
    return joined.withColumn(
        "value", F.coalesce(F.col("norm_value"), F.try_element_at("baseline", F.col("param_type")))
    ).withColumn("is_mined", F.col("norm_value").isNotNull()).drop("baseline")


def fallback_parameters(df: DataFrame, params: str, host: str = "host") -> DataFrame:
    """A parameter map as mined, or the baseline plus the binding defaults where mining failed (null map)."""
    return (
        with_host_baseline(df, host)
        .withColumn(params, F.coalesce(F.col(params), F.map_concat("baseline", literal_map(KM_DEFAULTS))))
        .drop("baseline")
    )


#: Parameters of a mined record, in the order in which they are checked.
MINED_KEYS = ("transcription_rate", "translation_rate", "mrna_deg_rate", "protein_deg_rate", "kd", "n", "km_rnap", "km_ribo")


def mined_parameters(df: DataFrame, answer: str = "answer", host: str = "host") -> DataFrame:
    """Parameter map out of a miner's answer: all of its members, or none of them.

    The answer is a JSON object (a code fence around it is removed) of ``schemas.MINED``. One member without value,
    with a text that is no number or with an unknown unit turns the whole map into the baseline of the host and the
    binding defaults; ``error`` holds the first such fault in the order of ``MINED_KEYS``, else null. Further
    members are ignored.
    """
    # every step is a column of its own: an answer is parsed once, and no step is repeated inside a function over an array
    rows = df.withColumn("_text", strip_fences(F.col(answer)))
    whole = is_json(F.col("_text")) & F.col("_text").startswith("{")
    rows = rows.withColumn("_members", F.when(whole, F.from_json("_text", MINED)))
    rows = rows.withColumns({f"_raw_{k}": F.try_element_at("_members", F.lit(k)) for k in MINED_KEYS})
    rows = rows.withColumns({f"_number_{k}": F.col(f"_raw_{k}.raw_value").try_cast("double") for k in MINED_KEYS})

    def norm(key: str) -> Column:
        return normalize_unit(F.col(f"_number_{key}"), F.col(f"_raw_{key}.raw_unit"), F.lit(key))

    def fault(key: str) -> Column:
        found = F.when(F.col(f"_raw_{key}.raw_value").isNull(), F.lit("no value"))
        found = found.when(F.col(f"_number_{key}").isNull(), F.lit("not a number")).otherwise(F.col(f"_norm_{key}.error"))
        return F.concat(F.lit(f"{key}: "), found)

    rows = rows.withColumns({f"_norm_{k}": norm(k) for k in MINED_KEYS})
    unread = F.when(F.col("_members").isNull(), F.lit("answer is not a JSON object"))
    rows = rows.withColumn("error", F.coalesce(unread, *[fault(k) for k in MINED_KEYS]))
    mined = F.create_map(*[c for k in MINED_KEYS for c in (F.lit(k), F.col(f"_norm_{k}.value"))])
    mapped = fallback_parameters(rows.withColumn("params", F.when(F.col("error").isNull(), mined)), "params", host)
    return mapped.drop("_text", "_members", *[f"_{step}_{k}" for step in ("raw", "number", "norm") for k in MINED_KEYS])


def page_paragraphs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Visible text of each page and its relevant paragraphs."""
    return pages.withColumn("text", html_text(F.col(html))).withColumn("snippet", relevant_paragraphs(F.col("text")))


def snippet_section(part: Column, host: Column, snippet: Column, failure: Column | None, max_chars: int) -> Column:
    """Header line and the snippet of one part, held to the budget; a failed fetch leaves its own line."""
    good = F.concat(F.format_string(CONTEXT_TEXT["header"], part, host), F.substring(snippet, 1, max_chars))
    if failure is None:
        return good
    return F.when(failure.isNotNull(), F.format_string(CONTEXT_TEXT["failure"], part, failure)).otherwise(good)


def assemble_context(df: DataFrame, max_chars: int = 4000) -> DataFrame:
    """Sections of each request in part order: (request_id, pos, section).

    Input: (request_id, pos, part, host, snippet[, failure]), one row per part. A request without
    any part that says something has one section with the notice that nothing was found.
    """
    failure = F.col("failure") if "failure" in df.columns else None
    section = snippet_section(F.col("part"), F.col("host"), F.coalesce("snippet", F.lit("")), failure, max_chars)
    blank = F.trim(section, F.lit(" \n\r\t")) == ""
    sections = df.select("request_id", F.col("pos").cast("long").alias("pos"), section.alias("section"), blank.alias("_blank"))
    said = sections.where(~F.col("_blank")).drop("_blank")
    silent = sections.groupBy("request_id").agg(F.bool_and("_blank").alias("_silent")).where("_silent")
    notice = silent.select("request_id", F.lit(0).cast("long").alias("pos"), F.lit(CONTEXT_TEXT["none"]).alias("section"))
    return said.unionByName(notice)
