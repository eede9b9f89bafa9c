"""Queries over pages, texts, units and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.config import HOST_BASELINES, PARAGRAPH_WORDS
from geneweft.functions import text as X
from geneweft.functions.units import normalize_host
from geneweft.operators import mining as O
from geneweft.operators import requests as R
from geneweft.operators.runs import failure_flags
from geneweft.plans import views as V
from geneweft.plans.registry import query, table
from geneweft.sources.readers import page_lines

BLANK = "' ' || chr(10) || chr(13) || chr(9)"


# --- pages -------------------------------------------------------------------------------


@query(
    "page_source",
    """select page_id, url, case when html is null or trim(html) = '' then 'Failed to scrape ' || url || ': empty response' end as scrape_note
      from (select page_id, url, regexp_extract(html, '(?s)<b>(.*)</b>', 1) as html from pages)""",
)
def _pages(spark, sf):
    rows = table(spark, sf, "pages").withColumn("html", F.regexp_extract("html", "(?s)<b>(.*)</b>", 1))
    return page_lines(rows).select("page_id", "url", "scrape_note")


# the references that occur in the pages; the ampersand comes last
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _entities(sql: str) -> str:
    for entity, char in ENTITIES:
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


STRIPPED = "html"
for _pattern in (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
    r"(?s)<[!/?A-Za-z][^>]*>",
):
    STRIPPED = f"regexp_replace({STRIPPED}, '{_pattern}', chr(1), 'g')"
TEXT_SQL = (
    f"array_to_string(list_filter(list_transform(string_split({_entities(STRIPPED)}, chr(1)), lambda s: trim(s, {BLANK})), "
    "lambda s: s <> ''), chr(10))"
)


def paragraphs_sql(text: str) -> str:
    words = "|".join(PARAGRAPH_WORDS)
    return (
        f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(13))), "
        f"lambda p: regexp_matches(p, '[0-9]') and regexp_matches(lower(p), '{words}')), chr(10))"
    )


@query("html_text", f"select page_id, {TEXT_SQL} as text from pages")
def _html(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("relevant_paragraphs", f"select doc_id, {paragraphs_sql('text')} as snippet from documents")
def _paragraphs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.relevant_paragraphs(F.col("text")).alias("snippet"))


@query("page_paragraphs", f"select page_id, {paragraphs_sql('text')} as snippet from (select page_id, {TEXT_SQL} as text from pages)")
def _page_paragraphs(spark, sf):
    return O.page_paragraphs(table(spark, sf, "pages")).select("page_id", "snippet")


@query(
    "assemble_context",
    """select conv_id as request_id, turn as pos, chr(10) || '--- Search results for turn ' || turn || ' in ' || role
      || ' ---' || chr(10) || substr(text, 1, 4000) as section from conversations""",
)
def _context(spark, sf):
    """Turns as parts of a request, their role as host."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"),
        F.col("turn").alias("pos"),
        F.concat(F.lit("turn "), F.col("turn")).alias("part"),
        F.col("role").alias("host"),
        F.col("text").alias("snippet"),
    )
    return O.assemble_context(rows)


# --- units, hosts, completion ------------------------------------------------------------

UNIT_SQL = """units as (select meas_id, param_type, raw_value, case
      when param_type = 'n' then raw_value
      when param_type = 'kd' then case raw_unit when 'nM' then raw_value when 'uM' then raw_value * 1000 end
      when param_type = 'transcription_rate' then case raw_unit when 'uM/min' then raw_value * 1000 / 60 else raw_value end
      else case raw_unit when '1/min' then raw_value / 60 when 'h^-1' then raw_value / 3600 else raw_value end end as norm_value,
      case when raw_unit = 'furlong' then 'unknown concentration unit' end as unit_error from t8)"""


@query(
    "normalize_units",
    V.with_sql(V.MEASUREMENT_SQL, UNIT_SQL) + "select meas_id, param_type, round(norm_value, 6) as norm_value, unit_error from units",
)
def _units(spark, sf):
    return O.normalize_units(V.measurements(spark, sf)).select("meas_id", "param_type", "norm_value", "unit_error")


HOST_TEXT = (
    "case s_suppkey % 5 when 0 then concat('Bacillus subtilis ', s_name) when 1 then concat('Baker yeast ', s_name) "
    "when 2 then 'SACCHAROMYCES c.' when 3 then '' else s_name end"
)
HOST_SQL = (
    "case when lower(host) like '%bacillus%' then 'Bacillus subtilis' when lower(host) like '%saccharomyces%' "
    "or lower(host) like '%yeast%' then 'Saccharomyces cerevisiae' else 'Escherichia coli' end"
)


@query("normalize_host", f"select s_suppkey, {HOST_SQL} as host from (select s_suppkey, {HOST_TEXT} as host from supplier)")
def _host(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", normalize_host(F.expr(HOST_TEXT)).alias("host"))


NATION_HOST = "case n_nationkey % 4 when 0 then 'bacillus' when 1 then 'Yeast' when 2 then n_name else null end"


def _baseline_sql(key: str) -> str:
    return "case host_norm " + " ".join(
        f"when '{h}' then cast({v[key]} as double)" for h, v in HOST_BASELINES.items()
    ) + " end"


@query(
    "host_baseline",
    f"""select c_custkey, host_norm, {_baseline_sql('kd')} as kd, {_baseline_sql('total_rnap')} as total_rnap,
      {_baseline_sql('mrna_deg_rate')} as mrna_deg_rate from (select c_custkey, {HOST_SQL.replace('lower(host)', "lower(coalesce(host, ''))")} as host_norm
      from (select c_custkey, {NATION_HOST} as host from customer join nation on c_nationkey = n_nationkey))""",
)
def _baseline(spark, sf):
    hosts = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.expr(NATION_HOST).alias("host"))
    rows = O.with_host_baseline(hosts)
    keys = [F.element_at("baseline", F.lit(k)).alias(k) for k in ("kd", "total_rnap", "mrna_deg_rate")]
    return rows.select("c_custkey", "host_norm", *keys)


KEYS = ("protein_deg_rate_x", "my_mrna_deg_rate", "transcription_rate", "kd_rep", "unheard_of")
CANONICAL_SQL = (
    "case when key like '%protein_deg_rate%' then 'protein_deg_rate' when key like '%mrna_deg_rate%' then 'mrna_deg_rate' "
    "when key like '%transcription_rate%' then 'transcription_rate' when key like '%translation_rate%' then 'translation_rate' else 'kd' end"
)
REQUEST_HOST = "case p_size % 3 when 0 then 'Bacillus' when 1 then 'yeast' else '' end"


@query(
    "complete_parameters",
    V.with_sql(
        V.MEASUREMENT_SQL,
        UNIT_SQL,
        f"""req as (select p_partkey as request_id, key, {HOST_SQL} as host_norm, {CANONICAL_SQL} as param_type from
          (select p_partkey, {REQUEST_HOST} as host, unnest({list(KEYS)}) as key from part))""",
    )
    + f"""select r.request_id, key, host_norm, r.param_type, u.norm_value is not null as is_mined, round(coalesce(u.norm_value,
      case r.param_type {" ".join(f"when '{k}' then {_baseline_sql(k)}" for k in ("protein_deg_rate", "mrna_deg_rate", "transcription_rate", "translation_rate", "kd"))} end), 6) as value
      from req r left join units u on u.meas_id = r.request_id and u.param_type = r.param_type""",
)
def _complete(spark, sf):
    requests = table(spark, sf, "part").select(
        F.col("p_partkey").alias("request_id"),
        F.expr(REQUEST_HOST).alias("host"),
        F.explode(F.array(*[F.lit(k) for k in KEYS])).alias("key"),
    )
    mined = O.normalize_units(V.measurements(spark, sf)).withColumnRenamed("meas_id", "request_id")
    return O.complete_parameters(requests, mined).select("request_id", "key", "host_norm", "param_type", "is_mined", "value")


MINED_KD = """case p_partkey % 7 when 1 then '{"raw_unit": "uM"}' when 2 then '{"raw_value": "about 5", "raw_unit": "uM"}'
  when 3 then concat('{"raw_value": ', p_size, ', "raw_unit": "furlong"}') else concat('{"raw_value": "', p_size, '", "raw_unit": " uM"}') end"""
MINED_BODY = f"""concat('{{"transcription_rate": {{"raw_value": ', p_size, ', "raw_unit": "nM/min"}}, "translation_rate": {{"raw_value": 0.5, "raw_unit": "1/min"}},
  "mrna_deg_rate": {{"raw_value": 0.2, "raw_unit": "h^-1"}}, "protein_deg_rate": {{"raw_value": 0.1, "raw_unit": "1/h"}}, "kd": ', {MINED_KD},
  ', "n": {{"raw_value": 2, "is_empirical": true}}, "km_rnap": {{"raw_value": 9, "raw_unit": "nM"}}, "km_ribo": {{"raw_value": 1, "raw_unit": "uM"}}, "note": null}}')"""
MINED_ANSWER = f"""case p_partkey % 7 when 0 then concat('```json', chr(10), {MINED_BODY}, chr(10), '```') when 4 then concat({MINED_BODY}, ' done')
  when 5 then null else {MINED_BODY} end"""


@query(
    "mined_parameters",
    f"""select request_id, host_norm, error, case when error is null then p_size * 1000e0 else {_baseline_sql('kd')} end as kd,
      round(case when error is null then p_size / 60e0 else {_baseline_sql('transcription_rate')} end, 6) as transcription_rate,
      case when error is null then 1000e0 else 500e0 end as km_ribo, case when error is null then 8 else 10 end as n_params
      from (select p_partkey as request_id, p_size, {HOST_SQL} as host_norm, case p_partkey % 7 when 1 then 'kd: no value'
        when 2 then 'kd: not a number' when 3 then 'kd: unknown concentration unit' when 4 then 'answer is not a JSON object'
        when 5 then 'answer is not a JSON object' end as error from (select *, {REQUEST_HOST} as host from part))""",
)
def _mined(spark, sf):
    """Answers with a missing, an unreadable and an unknown member, with trailing text, and none at all."""
    # the columns read are a few bytes a row, so that a million rows are one task of a scan; the work on them is dealt to all cores
    parts = table(spark, sf, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    answers = parts.select(
        F.col("p_partkey").alias("request_id"), F.expr(REQUEST_HOST).alias("host"), F.expr(MINED_ANSWER).alias("answer")
    )
    value = lambda k: F.try_element_at("params", F.lit(k)).alias(k)
    return O.mined_parameters(answers).select(
        "request_id", "host_norm", "error", value("kd"), value("transcription_rate"), value("km_ribo"), F.size("params").alias("n_params")
    )


# --- answers and code --------------------------------------------------------------------

FENCED = "case turn % 3 when 0 then concat('```json', chr(10), text, chr(10), '```') when 1 then concat('```', text, '```') else text end"


@query(
    "strip_fences",
    f"""select conv_id, turn, trim(regexp_replace(regexp_replace(trim(raw), '^```(json)?', ''), '```$', ''), {BLANK}) as answer
      from (select conv_id, turn, {FENCED} as raw from conversations)""",
)
def _fences(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.strip_fences(F.expr(FENCED)).alias("answer")
    )


PROPOSED = """case turn % 3 when 0 then concat('Plan: {"a": {"x": ', turn, '}, "b": 3, "c": {"y": "', role, '"}} done')
  when 1 then concat('So {"b": ', turn, '}.') else text end"""


@query(
    "extract_proposals",
    """select conv_id, turn, unnest(case turn % 3 when 0 then ['{"x":' || turn || '}', '{"y":"' || role || '"}']
      when 1 then ['{"b": ' || turn || '}'] else [text] end) as proposal from conversations""",
)
def _proposals(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.explode(X.extract_proposals(F.expr(PROPOSED))).alias("proposal")
    )


CODE = "concat(text, ' module gate', doc_id, ' (input a, output b); ', text, ' assign b = a; endmodule ', lang)"


@query(
    "extract_module",
    f"""select doc_id, trim(regexp_extract(code, '(?s)module\\s+\\w+\\s*\\(.*?\\);.*?endmodule', 0)) as code
      from (select doc_id, {CODE} as code from documents)""",
)
def _module(spark, sf):
    """A module with the whole text as its body, embedded in prose."""
    return table(spark, sf, "documents").select("doc_id", X.extract_module(F.expr(CODE)).alias("code"))


HDL = "case doc_id % 4 when 0 then text else concat('module m(input a, output b); ', text, case doc_id % 4 when 1 then '' else ' assign b = a;' end, ' endmodule') end"
WORD = r"(^|[^\p{L}\p{N}_])%s($|[^\p{L}\p{N}_])"


@query(
    "validate_hdl",
    f"""select doc_id, case when not (contains(code, 'module ') and contains(code, 'endmodule')) then 'missing module'
      when not contains(code, 'input ') then 'missing input' when not contains(code, 'output ') then 'missing output'
      when not (contains(code, 'and(') or contains(code, 'or(') or contains(code, 'not(') or contains(code, 'nor(')
        or contains(code, 'nand(') or contains(code, 'assign ')) then 'missing logic'
      when regexp_matches(code, '{WORD % "always"}') then 'forbidden always' when regexp_matches(code, '{WORD % "reg"}') then 'forbidden reg'
      when contains(code, '#') then 'forbidden delay' end as violation from (select doc_id, {HDL} as code from documents)""",
)
def _hdl(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.validate_hdl(F.expr(HDL)).alias("violation"))


GUARDED = "case turn % 4 when 0 then '  ' when 1 then concat(' ERROR: ', text) else text end"


@query(
    "guard_inputs",
    f"""select conv_id, turn, case when trim(code, {BLANK}) = '' then 'Empty Verilog code provided.'
      when starts_with(trim(code, {BLANK}), 'ERROR:') then 'Invalid Verilog: ' || trim(code, {BLANK}) end as error
      from (select conv_id, turn, {GUARDED} as code from conversations)""",
)
def _guard(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(GUARDED).alias("code"))
    valid, invalid = R.guard_inputs(rows)
    return valid.select("conv_id", "turn", F.lit(None).cast("string").alias("error")).unionByName(invalid)


@query(
    "intent_flags",
    """select doc_id, regexp_matches(lower(text), 'lysis|裂解|細胞死亡|suicide|cell death|死亡|凋亡|death') as expects_death,
      case when regexp_matches(lower(text), 'toggle|memory|bistable|雙穩態|記憶') then 'toggle'
        when regexp_matches(lower(text), 'oscillat|repressilator|振盪') then 'oscillator' else 'default' end as motif
      from (select doc_id, case doc_id % 5 when 0 then concat(text, ' Death switch') when 1 then concat(text, ' a BISTABLE latch')
        when 2 then concat('Oscillator: ', text) else text end as text from documents)""",
)
def _intent(spark, sf):
    text = F.expr(
        "case doc_id % 5 when 0 then concat(text, ' Death switch') when 1 then concat(text, ' a BISTABLE latch') "
        "when 2 then concat('Oscillator: ', text) else text end"
    )
    return table(spark, sf, "documents").select("doc_id", X.intent_flags(text).alias("f")).select("doc_id", "f.*")


@query(
    "error_flags",
    """select conv_id, bool_or(failed) as any_failed, bool_and(failed) as all_failed from (select conv_id,
      starts_with(case when role = 'assistant' then 'ERROR: ' || text else text end, 'ERROR:') as failed from conversations) group by all""",
)
def _errors(spark, sf):
    text = F.expr("case when role = 'assistant' then concat('ERROR: ', text) else text end")
    return failure_flags(table(spark, sf, "conversations"), X.is_error(text), "conv_id")


@query(
    "truncate_context",
    f"select doc_id, substr(trim(text, {BLANK}), 1, 2400) as context from documents",
)
def _truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate_context(F.col("text")).alias("context"))


ARGUMENTS = """case event_id % 6 when 0 then concat('{"query": " ', event_type, ' ", "n_results": ', user_id, '}')
  when 1 then '{"query": "  ", "n_results": 3}' when 2 then concat('{"query": "', event_type, '", "n_results": "many"}')
  when 3 then concat(props, 'x') when 4 then props else concat('{"query": "', event_type, '"}') end"""


@query(
    "validate_requests",
    """select event_id, case event_id % 6 when 0 then event_type when 5 then event_type end as query,
      case event_id % 6 when 0 then user_id when 5 then 5 end as n_results,
      case event_id % 6 when 1 then 'TOOL_ERROR: blank query' when 2 then 'TOOL_ERROR: n_results is not an integer: many'
        when 3 then 'TOOL_ERROR: invalid JSON' when 4 then 'TOOL_ERROR: blank query' end as error from events""",
)
def _validate(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(ARGUMENTS).alias("arguments"))
    return R.validate_requests(rows).select("event_id", "query", "n_results", "error")
