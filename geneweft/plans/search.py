"""Queries over embeddings, search results and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from geneweft.config import COMPONENT_WORDS
from geneweft.functions.text import motif_class
from geneweft.functions.units import normalize_host
from geneweft.operators import requests as Q
from geneweft.operators import retrieval as O
from geneweft.operators.components import distinct_documents, with_ids
from geneweft.plans.registry import prepared, query, table

BLANK = "' ' || chr(10) || chr(13) || chr(9)"


def centroids(spark, sf):
    """One query per label: the mean of its vectors."""
    dims = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = dims.groupBy("label", "d").agg(F.avg("x").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "c")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["c"]).alias("embedding")).select(
        F.col("label").alias("query_id"), "embedding"
    )


@query(
    "search",
    """with dims as (select vec_id, label, generate_subscripts(embedding, 1) as d, cast(unnest(embedding) as double) as x from embeddings),
      cent as (select label, d, avg(x) as c from dims group by all),
      dist as (select c.label as q, e.vec_id as v, round(sum((e.x - c.c) * (e.x - c.c)), 9) as distance from dims e join cent c using (d) group by all)
    select cast(q as varchar) as query_id, cast(v as varchar) as part_id, round(distance, 6) as distance, rank from (select *,
      row_number() over (partition by q order by distance, cast(v as varchar)) as rank from dist) where rank <= 5""",
)
def _search(spark, sf):
    index = table(spark, sf, "embeddings").select(F.col("vec_id").alias("part_id"), "embedding")
    return O.search(centroids(spark, sf), index, 5)


def document_index(spark, sf):
    """Distinct documents with hashed word counts as their vectors, embedded once and stored as an index is."""
    documents = distinct_documents(with_ids(table(spark, sf, "documents").select(F.col("text").alias("document"))))
    return prepared(O.hash_embed(documents), "index")


def item_queries(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return O.hash_embed(items, "text")


def _counts(name: str, source: str, key: str) -> str:
    return f"""{name}_words as (select {key} as id, unnest(string_split_regex(lower(text), '\\s+')) as w from {source}),
      {name}_counts as (select id, cast('0x' || substr(md5(w), 1, 4) as int) % 64 as d, count(*) as c from {name}_words where w <> '' group by all),
      {name}_norms as (select id, sqrt(sum(c * c)) as n from {name}_counts group by all)"""


NEAREST_SQL = f"""docs as (select distinct 'part_' || substr(sha256(text), 1, 16) as part_id, text from documents
      where trim(text, {BLANK}) <> ''),
    {_counts('doc', 'docs', 'part_id')},
    {_counts('item', 'benchmark', 'cast(item_id as varchar)')},
    dots as (select i.id as q, d.id as v, sum(i.c * d.c) as dot from item_counts i join doc_counts d using (d) group by all),
    dist as (select q.id as query_id, v.id as part_id, round(1.0e0 - coalesce(dot, 0) / (q.n * v.n), 9) as distance
      from item_norms q cross join doc_norms v left join dots on dots.q = q.id and dots.v = v.id),
    nearest as (select * from (select *, row_number() over (partition by query_id order by distance, part_id) as rank from dist) where rank <= 5)"""


@query("knn_join", f"with {NEAREST_SQL} select query_id, part_id, round(distance, 6) as distance, rank from nearest")
def _knn(spark, sf):
    """Benchmark items against all documents, through a cell index."""
    return O.knn_join(item_queries(spark, sf), O.cell_index(document_index(spark, sf), "cosine"), 5)


@query(
    "hash_embed",
    f"""with docs as (select doc_id, text from documents), {_counts('doc', 'docs', 'doc_id')}
    select id as doc_id, d, cast(c as double) as n from doc_counts""",
)
def _hash(spark, sf):
    rows = O.hash_embed(table(spark, sf, "documents"), "text").select("doc_id", F.posexplode("embedding").alias("d", "n"))
    return rows.where("n > 0").select("doc_id", "d", F.col("n").cast("double").alias("n"))


def text_shape(texts: list[str]) -> list[list[float]]:
    return [[len(t), t.count(" ")] for t in texts]


@query(
    "embed",
    """select doc_id, cast(length(text) as double) as n_chars, cast(length(text) - length(replace(text, ' ', '')) as double) as n_spaces from documents""",
)
def _embed(spark, sf):
    """A caller's embedder, 64 texts at a time."""
    rows = O.embed(table(spark, sf, "documents").select("doc_id", F.col("text").alias("document")), text_shape)
    return rows.select("doc_id", F.col("embedding")[0].cast("double").alias("n_chars"), F.col("embedding")[1].cast("double").alias("n_spaces"))


WORDS_SQL = "|".join(COMPONENT_WORDS)


@query(
    "keyword_filter",
    f"""select doc_id, query_id from (select *, max(hit) over (partition by query_id) as any_hit from (select doc_id, source || lang as query_id,
      cast(regexp_matches(lower(text), '{WORDS_SQL}') as int) as hit from documents)) where hit = 1 or any_hit = 0""",
)
def _keyword(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat("source", "lang").alias("query_id"), "text")
    return O.keyword_filter(rows).select("doc_id", "query_id")


@query("exclude_experiment", "select o_orderkey, o_custkey from orders where o_custkey <> 605")
def _exclude(spark, sf):
    return O.exclude_experiment(table(spark, sf, "orders"), 605, "o_custkey").select("o_orderkey", "o_custkey")


@query("dedup_ordered", "select lang as query_id, text, min(doc_id) as rank from documents group by all")
def _dedup(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), "text", F.col("doc_id").alias("rank"))
    return O.dedup_ordered(rows)


@query(
    "context_budget",
    """with items as (select *, row_number() over (partition by query_id order by rank) as item
        from (select conv_id as query_id, turn as rank, text from conversations)),
      sized as (select *, cast(sum(length(text) + 3) over (partition by query_id order by rank) - 1 as bigint) as chars from items where item <= 8)
    select query_id, rank, item, chars from sized where chars <= 900""",
)
def _budget(spark, sf):
    """Turns of a conversation as ranked results, held to 900 characters."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text")
    return O.budget(rows, max_items=8, max_chars=900).select("query_id", "rank", "item", "chars")


@query(
    "retrieve_context",
    f"""with {NEAREST_SQL},
      found as (select n.query_id, rank, trim(text, {BLANK}) as text from nearest n join docs using (part_id)),
      flagged as (select *, cast(regexp_matches(lower(text), '{WORDS_SQL}') as int) as hit from found),
      kept as (select * from (select *, max(hit) over (partition by query_id) as any_hit from flagged) where hit = 1 or any_hit = 0),
      uniq as (select query_id, text, min(rank) as rank from kept group by all),
      items as (select *, row_number() over (partition by query_id order by rank) as item from uniq),
      sized as (select *, sum(length(text) + 3) over (partition by query_id order by rank) - 1 as chars from items where item <= 8),
      lines as (select query_id, string_agg('- ' || text, chr(10) order by item) as context from sized where chars <= 2400 group by all)
    select cast(item_id as varchar) as query_id, coalesce(context, '{O.NO_RESULTS}') as context from benchmark left join lines on query_id = cast(item_id as varchar)""",
)
def _retrieve(spark, sf):
    return O.retrieve_context(item_queries(spark, sf), document_index(spark, sf), 5, "cosine")


@query(
    "dispatch_requests",
    """select event_id as request_id, case event_type when 'view' then case when user_id % 2 = 0 then 'Bacillus subtilis' else 'Escherichia coli' end
      when 'click' then case when user_id % 2 = 0 then 'toggle' else 'default' end else 'TOOL_ERROR: unknown tool `' || event_type || '`' end as content from events""",
)
def _dispatch(spark, sf):
    """The event type names the operator; two of the five are known."""
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("event_type").alias("tool"),
        F.expr("case when user_id % 2 = 0 then 'a Bacillus memory' else 'other' end").alias("text"),
    )
    registry = {
        "view": lambda r: r.select("request_id", normalize_host(F.col("text")).alias("content")),
        "click": lambda r: r.select("request_id", motif_class(F.col("text")).alias("content")),
    }
    return Q.dispatch(rows, registry)
