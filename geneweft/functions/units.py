"""Unit and host normalisation, all from literal lookup tables (no join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geneweft.config import CONCENTRATION_UNITS, DEFAULT_HOST, HOST_BASELINES, TIME_UNITS
from geneweft.functions.values import literal_map

RATE_TYPES = ("translation_rate", "protein_deg_rate", "mrna_deg_rate")
CONCENTRATION_TYPES = ("kd", "km_rnap", "km_ribo")


def normalize_unit(value: Column, unit: Column, param_type: Column) -> Column:
    """Struct ``(value, error)``: the value in nM and seconds, or null with a reason."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    seconds = literal_map(TIME_UNITS)
    nanomolar = literal_map(CONCENTRATION_UNITS)

    bare_time = F.trim(F.replace(F.replace(F.replace(u, F.lit("1/"), F.lit("")), F.lit("^-1"), F.lit("")), F.lit("-1"), F.lit("")))
    rate_factor = F.try_element_at(seconds, bare_time)
    conc_factor = F.try_element_at(nanomolar, u)
    pieces = F.split(u, "/")
    top = F.try_element_at(nanomolar, F.trim(F.get(pieces, F.lit(0))))
    bottom = F.try_element_at(seconds, F.trim(F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))))

    is_rate = param_type.isin(*RATE_TYPES)
    is_conc = param_type.isin(*CONCENTRATION_TYPES)
    is_tx = param_type == "transcription_rate"
    number = value.cast("double")
    result = (
        F.when(param_type == "n", number)
        .when(is_rate, number / rate_factor)
        .when(is_conc, number * conc_factor)
        .when(is_tx, number * top / bottom)
    )
    error = (
        F.when(param_type == "n", None)
        .when(u == "", F.lit("empty unit"))
        .when(is_rate & rate_factor.isNull(), F.lit("unknown time unit"))
        .when(is_conc & conc_factor.isNull(), F.lit("unknown concentration unit"))
        .when(is_tx & ~u.contains("/"), F.lit("unknown compound unit"))
        .when(is_tx & (top.isNull() | bottom.isNull()), F.lit("unknown compound unit parts"))
        .when(param_type.isNull() | ~(is_rate | is_conc | is_tx), F.lit("unknown parameter type"))
    )
    return F.struct(F.when(error.isNull(), result).alias("value"), error.alias("error"))


def normalize_host(host: Column) -> Column:
    h = F.lower(F.coalesce(host, F.lit("")))
    return (
        F.when(h.contains("bacillus"), F.lit("Bacillus subtilis"))
        .when(h.contains("saccharomyces") | h.contains("yeast"), F.lit("Saccharomyces cerevisiae"))
        .otherwise(F.lit("Escherichia coli"))
    )


def host_baseline(host: Column) -> Column:
    """Baseline parameter map of a host name; an unknown host gets the default one."""
    result = literal_map(HOST_BASELINES[DEFAULT_HOST])
    for name, values in HOST_BASELINES.items():
        if name != DEFAULT_HOST:
            result = F.when(host == name, literal_map(values)).otherwise(result)
    return result


def canonical_parameter(key: Column) -> Column:
    """Which baseline parameter a requested key stands for; tested by substring, in order."""
    chain = F.when(key.contains("protein_deg_rate"), F.lit("protein_deg_rate"))
    for name in ("mrna_deg_rate", "transcription_rate", "translation_rate"):
        chain = chain.when(key.contains(name), F.lit(name))
    return chain.otherwise(F.lit("kd"))
