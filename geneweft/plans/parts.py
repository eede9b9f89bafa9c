"""Queries over component libraries and their content-addressed index."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.config import COMPONENT_TEXT
from geneweft.functions import components as C
from geneweft.functions import values as X
from geneweft.operators import components as O
from geneweft.plans import views as V
from geneweft.plans.registry import query, table
from geneweft.sources.readers import catalogue_context, explode_catalogue

RESPONSE_KIND = "case p_partkey % 4 when 0 then 'full' when 1 then 'plain' when 2 then 'other' else 'none' end"
SOURCE_EXPR = """case p_size % 4 when 0 then concat('﻿[', o, ', 3]') when 1 then concat('{"ucf": [', o, ']}')
  when 2 then concat('{"x": ', o, ', "y": 7}') else concat('{"entries": [], "x": [', o, ', "text"]}') end"""


def component_files(spark, sf):
    """One JSON text per part, in four top-level shapes; parts of one size are cut off mid-text."""
    parts = table(spark, sf, "part").withColumn("kind", F.expr(RESPONSE_KIND))
    response = (
        F.when(F.col("kind") == "full", F.expr("""concat('{"model": "hill", "params": {"n": 2, "K": ', p_size, '}}')"""))
        .when(F.col("kind") == "other", F.expr("""concat('{"z": 1, "K": ', p_size, '}')"""))
        .when(F.col("kind") == "plain", F.lit('"linear"'))
    )
    collection = F.expr(V.COMPONENT_EXPR["collection"])
    rest = F.concat(
        F.lit('{"name": "'), F.col("p_name"), F.lit('", "id": '), F.col("p_partkey"), F.lit(', "collection": "'), collection,
        F.lit('", "gate_type": "'), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit("")),
        F.lit('", "host": "E. coli", "tox": '), F.col("p_size"), F.lit(', "burden": 0'),
        F.when(response.isNotNull(), F.concat(F.lit(', "response": '), response)).otherwise(F.lit("")), F.lit("}"),
    )
    text = parts.withColumn("o", rest).withColumn("content", F.expr(SOURCE_EXPR))
    broken = F.when(F.col("p_size") == 50, F.expr("substring(content, 1, length(content) - 2)")).otherwise(F.col("content"))
    return text.select("p_partkey", broken.alias("content"))


@query(
    "read_components",
    f"""with s as (select *, {RESPONSE_KIND} as kind, {V.COMPONENT_EXPR['collection']} as collection from part where p_size <> 50)
    select p_partkey, p_name as name, collection, case when p_size % 2 = 0 then p_brand end as gate_type, 'E. coli' as organism,
      cast(p_size as varchar) as toxicity, '0' as metabolic_burden, case kind when 'full' then 'hill' end as equation,
      case kind when 'full' then '{{"K":' || p_size || ',"n":2}}' end as parameters,
      case kind when 'other' then '{{"K":' || p_size || ',"z":1}}' when 'plain' then '"linear"' end as raw_response,
      {V.ROLE_SQL} as role from s""",
)
def _read(spark, sf):
    records, _ = O.parse_components(component_files(spark, sf))
    return O.describe(records).select(
        "p_partkey", "name", "collection", "gate_type", "organism", "toxicity", "metabolic_burden",
        F.col("response.equation").alias("equation"), F.col("response.parameters").alias("parameters"),
        F.col("response.raw").alias("raw_response"), "role",
    )


@query("broken_component_files", "select p_partkey from part where p_size = 50")
def _broken(spark, sf):
    return O.parse_components(component_files(spark, sf))[1].select("p_partkey")


@query(
    "read_catalogue",
    """select doc_id, pos - 1 as pos, entry from (select doc_id, unnest(string_split(text, chr(10))) as entry,
      generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)""",
)
def _catalogue(spark, sf):
    """Every document as a catalogue of its lines."""
    files = table(spark, sf, "documents").select("doc_id", F.to_json(F.split("text", "\n")).alias("content"))
    return explode_catalogue(files)


@query("catalogue_context", "select doc_id, text as context from documents")
def _catalogue_context(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.to_json(F.split("text", "\n")).alias("content"))
    return catalogue_context(files)


@query(
    "pick_first",
    V.with_sql(V.COMPONENT_SQL)
    + "select comp_id, coalesce(nullif(sensor_type, ''), gate_type, name) as picked, coalesce(gate_type, sensor_type) as zero_kept from t3".replace(
        "coalesce(gate_type, sensor_type) as zero_kept", "'0' as zero_kept"
    ),
)
def _pick(spark, sf):
    rows = V.components(spark, sf)
    fields = F.create_map(
        F.lit("sensor"), F.col("sensor_type"), F.lit("gate"), F.col("gate_type"), F.lit("name"), F.col("name"),
        F.lit("empty"), F.lit("[]"), F.lit("none"), F.lit("{}"), F.lit("zero"), F.lit("0"),
    )
    return rows.select(
        "comp_id",
        X.pick_first(fields, "absent", "sensor", "gate", "name").alias("picked"),
        X.pick_first(fields, "empty", "none", "zero").alias("zero_kept"),
    )


@query(
    "as_list",
    V.with_sql(V.COMPONENT_SQL)
    + """select comp_id, case when gate_type is null then 0 else 1 end as n_gate, coalesce(gate_type, '') as gates,
      len(string_split(name, ' ')) as n_words from t3""",
)
def _as_list(spark, sf):
    rows = V.components(spark, sf)
    gates = X.as_list(F.col("gate_type"))
    return rows.select(
        "comp_id",
        F.size(gates).alias("n_gate"),
        F.array_join(gates, ",").alias("gates"),
        F.size(X.as_list(F.split("name", " "), is_list=True)).alias("n_words"),
    )


@query(
    "canonical_json",
    """select p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || ',"type":{"a":1,"b":"' || p_type || '"}}' as canonical,
      p_name as kept from part""",
)
def _canonical(spark, sf):
    text = F.expr("""concat('{"type": {"b": "', p_type, '", "a": 1}, "size": ', p_size, ', "brand": "', p_brand, '"}')""")
    return table(spark, sf, "part").select(
        "p_partkey", X.canonical_json(text).alias("canonical"), X.canonical_json(F.col("p_name")).alias("kept")
    )


@query("component_role", V.with_sql(V.COMPONENT_SQL) + f"select comp_id, {V.ROLE_SQL} as role from t3")
def _role(spark, sf):
    return V.components(spark, sf).select("comp_id", C.component_role(F.col("collection")).alias("role"))


@query(
    "response_function",
    f"""with s as (select *, {RESPONSE_KIND} as kind from part)
    select p_partkey, case kind when 'full' then 'hill' end as equation,
      case kind when 'full' then '{{"K":' || p_size || ',"n":2}}' end as parameters,
      case kind when 'other' then '{{"K":' || p_size || '}}' when 'plain' then '"' || p_type || '"' end as raw from s""",
)
def _response(spark, sf):
    rows = table(spark, sf, "part").withColumn("kind", F.expr(RESPONSE_KIND))
    text = (
        F.when(F.col("kind") == "full", F.expr("""concat('{"equation": "hill", "coefficients": {"n": 2, "K": ', p_size, '}}')"""))
        .when(F.col("kind") == "other", F.expr("""concat('{"K": ', p_size, '}')"""))
    )
    value = F.when(F.col("kind") == "plain", F.col("p_type").cast("variant")).otherwise(F.parse_json(text))
    return rows.select("p_partkey", C.response_function(value).alias("r")).select("p_partkey", "r.*")


@query(
    "toxicity_burden",
    V.with_sql(V.COMPONENT_SQL) + "select comp_id, round(toxicity_value, 6) as toxicity, round(toxicity_value, 6) as burden from t3",
)
def _toxicity(spark, sf):
    value = F.col("toxicity_value").cast("string")
    fields = F.create_map(F.lit("toxic"), value, F.lit("toxicity"), F.lit(""), F.lit("load"), value)
    pair = C.toxicity_burden(fields)
    return V.components(spark, sf).select(
        "comp_id",
        pair["toxicity"].cast("double").alias("toxicity"),
        pair["metabolic_burden"].cast("double").alias("burden"),
    )


def described(spark, sf):
    return V.components(spark, sf).select(
        "comp_id", "name", "collection", "gate_type", "sensor_type",
        F.expr("cast(comp_id % 7 as string)").alias("toxicity"),
    )


L = COMPONENT_TEXT


def _fill(key, *parts):
    pieces = L[key].split("%s")
    sql = f"'{pieces[0]}'"
    for part, piece in zip(parts, pieces[1:]):
        sql += f" || {part} || '{piece}'"
    return f"({sql})"


FUNCTION_SQL = (
    f"case role when 'gate' then case when gate_type is not null then {_fill('gate_of', 'gate_type')} else '{L['gate']}' end "
    f"when 'output' then '{L['output']}' "
    f"when 'sensor' then case when nullif(sensor_type, '') is not null then {_fill('sensor_of', 'sensor_type')} else '{L['sensor']}' end "
    f"else '{L['component']}' end"
)
ROLE_TEXT_SQL = "case role " + " ".join(f"when '{r}' then '{L['role_' + r]}'" for r in ("gate", "output", "sensor", "component")) + " end"
DOCUMENT_SQL = (
    f"{_fill('name', 'name')} || ' ' || {_fill('type', 'collection', ROLE_TEXT_SQL)} || ' ' || "
    f"{_fill('function', FUNCTION_SQL, repr(L['unspecified_host']))} || ' ' || {_fill('toxicity', 'cast(comp_id % 7 as varchar)')}"
)
DESCRIBED_SQL = f"described as (select *, {DOCUMENT_SQL} as document from (select *, {V.ROLE_SQL} as role from t3))"


@query("describe_components", V.with_sql(V.COMPONENT_SQL, DESCRIBED_SQL) + "select comp_id, role, document from described")
def _describe(spark, sf):
    return O.describe(described(spark, sf)).select("comp_id", "role", "document")


@query(
    "select_components",
    V.with_sql(V.COMPONENT_SQL, DESCRIBED_SQL) + "select comp_id, role, document from described where role <> 'component'",
)
def _select(spark, sf):
    return O.select_components(described(spark, sf)).select("comp_id", "role", "document")


ODD_FILES = """case p_partkey % 6
  when 0 then concat('["{\\\\"collection\\\\":\\\\"gates\\\\",\\\\"name\\\\":\\\\"ghost\\\\"}", {"collection":"gates","name":"', p_name, '","toxicity":1}]')
  when 1 then concat('{"z":{"collection":"gates","name":"', p_name, '","toxicity":"high"},"a":"text"}')
  when 2 then concat('{"ucf":[{"collection":"input_sensors","name":"first","name":"', p_name, '","toxicity":2,"toxicity":', p_size, '}]}')
  when 3 then concat('[{"collection":"output_devices","name":"', p_name, '","toxicity":NaN}]')
  when 4 then concat('[{"collection":"gates","name":{"en":"', p_name, '"},"toxicity":[]}]')
  else concat('[{"collection":"gates","name":"', p_name, '","response":"linear","burden":{"b":1,"a":[]}}]') end"""


def _odd_sql():
    body = lambda collection, role, function, *more: " || ' ' || ".join((
        _fill("name", "p_name"), _fill("type", f"'{collection}'", f"'{L['role_' + role]}'"),
        _fill("function", f"'{L[function]}'", f"'{L['unspecified_host']}'"), *more,
    ))
    raw = """'{"collection":"gates","name":{"en":"' || p_name || '"},"toxicity":[]}'"""
    return f"""select p_partkey, case p_partkey % 6 when 2 then 'sensor' when 3 then 'output' else 'gate' end as role, document,
      'part_' || substr(sha256(document), 1, 16) as part_id from (select p_partkey, case p_partkey % 6
      when 0 then {body("gates", "gate", "gate", _fill("toxicity", "'1'"))}
      when 1 then {body("gates", "gate", "gate", _fill("toxicity", "'" + chr(34) + "high" + chr(34) + "'"))}
      when 2 then {body("input_sensors", "sensor", "sensor", _fill("toxicity", "p_size"))}
      when 3 then {body("output_devices", "output", "output", _fill("toxicity", "'NaN'"))}
      when 4 then {_fill("failed", '\'{"en":"\' || p_name || \'"}\'', "'gates'", raw)}
      else {body("gates", "gate", "gate", _fill("response_other", "'" + chr(34) + "linear" + chr(34) + "'"), _fill("burden", "'" + '{"a":[],"b":1}' + "'"))}
      end as document from part)"""


@query("odd_components", _odd_sql())
def _odd(spark, sf):
    """Strings that look like components, text toxicity, equal keys, NaN and a name that is no text."""
    files = table(spark, sf, "part").select("p_partkey", F.expr(ODD_FILES).alias("content"))
    selected = O.with_ids(O.select_components(O.parse_components(files)[0]))
    return selected.select("p_partkey", "role", "document", "part_id")


ID_SQL = "'part_' || substr(sha256(text), 1, 16)"


@query("content_id", f"select doc_id, {ID_SQL} as part_id from documents where trim(text, ' ' || chr(10) || chr(13) || chr(9)) <> ''")
def _content_id(spark, sf):
    return O.with_ids(table(spark, sf, "documents"), "text").select("doc_id", "part_id")


@query("distinct_documents", f"select distinct {ID_SQL} as part_id, text from documents")
def _distinct(spark, sf):
    return O.distinct_documents(O.with_ids(table(spark, sf, "documents").select("text"), "text"), "text")


@query(
    "missing_documents",
    f"""select distinct {ID_SQL} as part_id, text from documents where text not in
      (select text from documents join labels using (doc_id))""",
)
def _missing(spark, sf):
    """The index holds the labelled documents; everything else is missing from it."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    index = O.with_ids(documents.join(table(spark, sf, "labels"), "doc_id"), "text")
    return O.missing_documents(O.with_ids(documents.select("text"), "text"), index, "text")
