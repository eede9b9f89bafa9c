"""Value handling: first present value, canonical JSON, ids, parameter overrides."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def nullif_empty(value: Column) -> Column:
    """Null for text that stands for nothing: empty text, ``[]`` and ``{}``. ``0`` and ``false`` stay."""
    text = value.cast("string")
    return F.when(text.isNull() | text.isin("", "[]", "{}"), None).otherwise(text)


def present(fields: Column) -> Column:
    """A ``map<string,string>`` without the keys whose value stands for nothing."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}"))


def pick_present(fields: Column, *keys: str) -> Column:
    """The first key found in a map that went through :func:`present`."""
    return F.coalesce(*[F.try_element_at(fields, F.lit(k)) for k in keys])


def pick_first(fields: Column, *keys: str) -> Column:
    """The first key of a ``map<string,string>`` whose value is present and not empty."""
    return pick_present(present(fields), *keys)


def pick_first_of(*columns: Column) -> Column:
    """As :func:`pick_first` over columns instead of map keys."""
    return F.coalesce(*[nullif_empty(c) for c in columns])


def as_list(value: Column, is_list: bool = False) -> Column:
    """Null becomes ``[]``, a list stays, a scalar becomes a list of one."""
    if is_list:
        return F.coalesce(value, F.array())
    return F.array_compact(F.array(value))


def is_json(text: Column) -> Column:
    """True for text that is one whole JSON value.

    The parser stops after the first value and ignores what follows, so the text is read
    inside a list and inside an object: trailing text breaks at least one of them.
    """
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(in_list & in_object & (F.trim(text) != ""), F.lit(False))


@contextmanager
def last_key_wins(spark: SparkSession) -> Iterator[None]:
    """JSON read by frames that are built inside takes the last of an object's equal keys instead of being refused."""
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def json_variant(text: Column) -> Column:
    """Variant of text that is one whole JSON value, else null; ``NaN`` and the infinities count as numbers."""

    def read(t: Column) -> Column:
        return F.coalesce(F.try_parse_json(t), F.from_json(t, "variant", {"allowNonNumericNumbers": "true"}))

    in_list, in_object = read(F.concat(F.lit("["), text, F.lit("]"))), read(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.trim(text) != "") & in_list.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def members_of(value: Column) -> Column:
    """The members of a variant object, null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements_of(value: Column) -> Column:
    """The elements of a variant array, null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def variant_text(value: Column) -> Column:
    """A variant string as it is, anything else as JSON."""
    return F.try_variant_get(value, "$", "string")


def variant_json(value: Column) -> Column:
    """JSON of a variant, keys sorted; strings keep their quotes, a number that is not finite is written without any."""
    number = F.try_variant_get(value, "$", "double")
    odd = (F.schema_of_variant(value) == "DOUBLE") & (F.isnan(number) | (F.abs(number) == float("inf")))
    return F.when(odd, variant_text(value)).otherwise(F.to_json(value))


def is_filled(value: Column) -> Column:
    """Whether a variant stands for something: not null, empty text, ``[]`` or ``{}``; ``0`` and ``false`` do."""
    size = F.coalesce(F.size(elements_of(value)), F.size(members_of(value)))
    filled = F.when(size.isNotNull(), size > 0).otherwise(variant_text(value) != "")
    return F.coalesce(value.isNotNull() & ~F.is_variant_null(value) & filled, F.lit(False))


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object sorted; text that is not JSON is returned unchanged."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def canonical_map_json(mapping: Column) -> Column:
    """JSON of a map column with its keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(mapping))))


def content_id(text: Column) -> Column:
    return F.concat(F.lit("part_"), F.substring(F.sha2(text, 256), 1, 16))


def experiment_id(started: Column, key: Column) -> Column:
    """``EXP-yyyyMMdd-XXXXXX``; the suffix is derived from ``key`` so that re-runs agree."""
    return F.concat(
        F.lit("EXP-"),
        F.date_format(started, "yyyyMMdd"),
        F.lit("-"),
        F.upper(F.substring(F.md5(key), 1, 6)),
    )


def clamp_log(value: Column, floor: float = 1e-3) -> Column:
    return F.greatest(value, F.lit(floor))


def param(params: Column, key: str, species: Column | None, default: float | None) -> Column:
    """``key_species``, else ``key``, else the literal default."""
    options = []
    if species is not None:
        options.append(F.try_element_at(params, F.concat(F.lit(f"{key}_"), species)))
    options.append(F.try_element_at(params, F.lit(key)))
    if default is not None:
        options.append(F.lit(float(default)))
    return F.coalesce(*options)


def literal_map(values: dict[str, float]) -> Column:
    """A fixed lookup table as a literal map, so that lookups need no join."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """True where the lower-cased text holds any of the (lower-case) words; one pass over the text."""
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))
