"""Component libraries: parse, describe, select, and keep a content-addressed index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geneweft.config import COMPONENT_TEXT
from geneweft.functions.components import FIELD_KEYS, WRAPPER_KEYS, component_role, field, response_function
from geneweft.functions.values import (
    canonical_json,
    content_id,
    elements_of,
    is_filled,
    json_variant,
    last_key_wins,
    members_of,
    nullif_empty,
    pick_first_of,
    variant_json,
    variant_text,
)


def parse_components(files: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Component records out of JSON texts, and the texts that are not usable.

    A list gives its objects. An object gives the list under the first wrapper key that is not
    empty, otherwise all its values with lists flattened one level. Values keep their JSON types, so a
    string that looks like an object is no component. Of equal keys of an object the last wins, at
    the place of the first; ``NaN`` and the infinities are numbers, and in an object that holds one the
    members go by key. A text with both oddities, other top levels and broken JSON go to the second result.
    """
    body = F.trim(F.regexp_replace(F.col(text), "^﻿", ""), F.lit(" \n\r\t"))
    with last_key_wins(files.sparkSession):
        shaped = files.withColumn("_body", body).withColumn("_value", json_variant(F.col("_body")))
    shaped = shaped.withColumns({"_members": members_of(F.col("_value")), "_elements": elements_of(F.col("_value"))})
    usable = F.col("_members").isNotNull() | F.col("_elements").isNotNull()
    broken = shaped.where(~usable).drop("_body", "_value", "_members", "_elements")

    members = F.col("_members")
    wrapped = F.coalesce(*[F.when(is_filled(m), m) for m in (F.try_element_at(members, F.lit(k)) for k in WRAPPER_KEYS)])
    in_order = F.coalesce(F.array_distinct(F.json_object_keys("_body")), F.map_keys(members))
    values = F.transform(in_order, lambda k: F.try_element_at(members, k))
    flattened = F.flatten(F.transform(values, lambda v: F.coalesce(elements_of(v), F.array(v))))
    items = F.coalesce(F.col("_elements"), elements_of(wrapped), flattened)
    # texts that are not usable explode to nothing, so no filter is pushed below the parsing
    items = F.when(usable, items)
    # objects and their filled members come out of the generator together: nothing above it repeats this work
    objects = F.transform(items, lambda v: F.struct(v.alias("item"), F.map_filter(members_of(v), lambda _, m: is_filled(m)).alias("fields")))
    records = shaped.select(*files.drop(text).columns, F.posexplode(objects).alias("pos", "_object"))
    return promote_fields(records), broken


def promote_fields(records: DataFrame) -> DataFrame:
    """Component columns from ``_object`` (item, fields), and ``raw``, the item's JSON; anything but objects is dropped.

    Labels are texts; toxicity, burden and the parts of the response are JSON. An entry whose name is an object
    cannot be described and is ``malformed``.
    """
    labels = ("name", "organism", "gate_type", "gate_family", "sensor_type", "output_type", "description")
    fields = F.col("_object")["fields"]
    # every field is a column of its own before it is used, so that no lookup is repeated
    picked = records.where(fields.isNotNull()).withColumns({f"_{n}": field(fields, n) for n in FIELD_KEYS})
    return (
        picked.withColumns({n: variant_text(F.col(f"_{n}")) for n in labels})
        .withColumn("collection", F.coalesce(F.trim(variant_text(F.col("_collection"))), F.lit("")))
        .withColumn("response", response_function(F.col("_response")))
        .withColumns({n: variant_json(F.col(f"_{n}")) for n in ("toxicity", "metabolic_burden")})
        .withColumn("malformed", members_of(F.col("_name")).isNotNull())
        .withColumn("raw", F.to_json(F.col("_object")["item"]))
        .drop("_object", *[f"_{n}" for n in FIELD_KEYS])
    )


def with_all_fields(df: DataFrame) -> DataFrame:
    """Add the promoted columns a flat component table lacks, as nulls."""
    missing = {n: F.lit(None).cast("string") for n in FIELD_KEYS if n not in df.columns and n != "response"}
    if "response" not in df.columns:
        missing["response"] = F.lit(None).cast("struct<equation:string,parameters:string,raw:string>")
    if "malformed" not in df.columns:
        missing["malformed"] = F.lit(False)
    return df.withColumns(missing) if missing else df


def describe(df: DataFrame, labels: dict[str, str] = COMPONENT_TEXT) -> DataFrame:
    """Add ``role`` and ``document``, the description of a component; missing pieces vanish.

    Toxicity, burden and the parts of the response are JSON texts and stand as they are, so a text keeps its
    quotes. A malformed entry has no document.
    """
    df = with_all_fields(df)
    kept = df.columns

    def fill(key: str, *parts: Column) -> Column:
        return F.format_string(labels[key], *parts)

    # every piece is a column of its own before it is used, so that no expression is repeated
    prepared = (
        df.withColumns({f"_{n}": pick_first_of(F.col(n)) for n in
                        ("name", "organism", "gate_type", "gate_family", "output_type", "sensor_type", "description",
                         "toxicity", "metabolic_burden")})
        .withColumn("_collection", F.coalesce(nullif_empty(F.col("collection")), F.lit("")))
        .withColumn("role", component_role(F.col("_collection")))
        .withColumn(
            "_subject",
            F.when(F.col("role") == "gate", F.coalesce("_gate_type", "_gate_family"))
            .when(F.col("role") == "output", F.col("_output_type"))
            .when(F.col("role") == "sensor", F.col("_sensor_type")),
        )
    )
    function, role_text = F.lit(labels["component"]), F.lit(labels["role_component"])
    for name in ("sensor", "output", "gate"):
        here = F.col("role") == name
        known = fill(f"{name}_of", F.col("_subject"))
        function = F.when(here & F.col("_subject").isNotNull(), known).when(here, F.lit(labels[name])).otherwise(function)
        role_text = F.when(here, F.lit(labels[f"role_{name}"])).otherwise(role_text)

    shown = F.when(F.col("_collection") == "", F.lit(labels["unknown_collection"])).otherwise(F.col("_collection"))
    response = F.col("response")
    other = F.coalesce(
        response["raw"],
        F.to_json(F.when(response["equation"].isNotNull(), F.struct(response["equation"].alias("equation")))),
        F.concat(F.lit('{"parameters":'), response["parameters"], F.lit("}")),
    )
    both = response["equation"].isNotNull() & response["parameters"].isNotNull()
    document = F.concat_ws(
        " ",
        fill("name", F.coalesce(F.trim("_name"), F.lit(labels["unnamed"]))),
        fill("type", shown, role_text),
        fill("function", function, F.coalesce("_organism", F.lit(labels["unspecified_host"]))),
        F.when(F.col("_description").isNotNull(), fill("note", F.trim("_description"))),
        F.when(both, fill("response_equation", response["equation"], response["parameters"])).when(
            response.isNotNull(), fill("response_other", other)
        ),
        F.when(F.col("_toxicity").isNotNull(), fill("toxicity", F.col("_toxicity"))),
        F.when(F.col("_metabolic_burden").isNotNull(), fill("burden", F.col("_metabolic_burden"))),
    )
    return prepared.withColumn("document", F.when(~F.col("malformed"), document)).select(*kept, "role", "document")


def select_components(df: DataFrame, labels: dict[str, str] = COMPONENT_TEXT) -> DataFrame:
    """Sensors, gates and output devices with their documents; a malformed entry shows its raw fields instead."""
    described = describe(df, labels).where(F.col("role") != "component")
    raw = F.col("raw") if "raw" in df.columns else F.lit("")
    fallback = F.format_string(
        labels["failed"], F.coalesce(F.col("name"), F.lit(labels["unnamed"])), F.col("collection"), canonical_json(raw)
    )
    # out of a generator, so that later filters on the document do not build it a second time
    return described.withColumn("document", F.explode(F.array(F.coalesce("document", fallback))))


def component_documents(df: DataFrame) -> DataFrame:
    return with_ids(select_components(df).select("document"))


def with_ids(df: DataFrame, text: str = "document") -> DataFrame:
    """Add the content id; blank texts are skipped."""
    return df.where(F.trim(F.col(text), F.lit(" \n\r\t")) != "").withColumn("part_id", content_id(F.col(text)))


def distinct_documents(df: DataFrame, text: str = "document") -> DataFrame:
    """One row per content id; copies collapse before the shuffle, so a hot text costs nothing.

    Id and text alone are simply distinct. With further columns exact copies go first, then
    each id keeps the row that is smallest in those columns.
    """
    rest = [c for c in df.columns if c not in ("part_id", text)]
    if not rest:
        return df.distinct()
    keep = [c for c in df.columns if c != "part_id"]
    sortable = [c for c in rest if not isinstance(df.schema[c].dataType, T.MapType)]
    rank = F.struct(*(sortable or ["part_id"]))
    return df.groupBy("part_id").agg(F.min_by(F.struct(*keep), rank).alias("_row")).select("part_id", "_row.*")


def missing_documents(new: DataFrame, index: DataFrame, text: str = "document") -> DataFrame:
    """Distinct new documents whose id the index does not hold; known ones go before any text is deduplicated."""
    return distinct_documents(new.join(index.select("part_id"), "part_id", "left_anti"), text)
