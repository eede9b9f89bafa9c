"""The numbered queries over the supplied tables and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geneweft.llm import (
    alignment, bpe, chat, conversation_trie, fingerprint, mixing, neighbours, quality, secret_scan, shards, toxicity, trie_join, url_rules,
)
from geneweft.llm.labelled import remainder
from geneweft.llm.registry import QUERIES, SQL, query, table

CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *,
        length(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'))
            + length(role) - length(replace(role, chr(10), '')) AS role_chars,
        CASE WHEN contains(text, '### ') OR contains(text, '</turn>')
            THEN length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')) + 8
            ELSE length(text) + 6 END AS body_chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(4 + role_chars + 2 + body_chars + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


JOIN_SQL = r"""
WITH RECURSIVE texts AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS gram
    FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM texts WHERE len(words) > 0)
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS MATERIALIZED (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)
), reached AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(y), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached ON x = d.doc_id GROUP BY d.doc_id
"""


TRIE_SQL = r"""
WITH numbered AS MATERIALIZED (
    SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), digest) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda v, i: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)::BIGINT))) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM numbered)
), rebuilt AS (
    SELECT c.conv_id, p, digest, words FROM convs c JOIN numbered n ON n.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
    UNION ALL SELECT c.conv_id, p, digest, words FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND p > h
), placed AS (
    SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS depth FROM rebuilt
), prefixes AS MATERIALIZED (
    SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
        count(*) OVER (PARTITION BY conv_id) AS turns FROM placed
    UNION ALL SELECT conv_id, 0, 0, '', (SELECT count(*) FROM placed p WHERE p.conv_id = c.conv_id) FROM convs c
), nodes AS MATERIALIZED (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '') AS ends
    FROM prefixes GROUP BY path, depth
), family AS (
    SELECT n.path, count(c.path) AS n_children FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND left(c.path, n.depth * 64) = n.path GROUP BY n.path
), under AS (
    SELECT left(path, above * 64) AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
    FROM (SELECT n.path, n_convs, words, n_children, unnest(generate_series(0, depth)) AS above FROM nodes n JOIN family f USING (path))
    GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
    CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN family USING (path) JOIN under USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = left(n.path, p.depth * 64)
"""


def judged(docs: DataFrame, held_out) -> DataFrame:
    return docs.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned where crc32 of the id modulo 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = remainder(F.col("doc_id"), 5)
    model = toxicity.fit(docs, labels, fold != 0)
    return judged(toxicity.score(docs.select("doc_id", "text"), model), fold == 0)


@query("op2_fingerprint")
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents")
    return fingerprint.compare_edited(docs, fingerprint.ranks(fingerprint.level_counts(docs)))


@query("op3_bpe_tokens")
def op3_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of what they decode to."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary)


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    found = secret_scan.findings(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@query("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query("op6_one_bit_search")
def op6_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_shingle_join", JOIN_SQL)
def op7_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under shared shingles."""
    return trie_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned where crc32 of the id modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = remainder(F.col("doc_id"), 3)
    trees = quality.fit(docs, labels, fold != 1)
    return judged(quality.score(docs.select("doc_id", "text"), trees), fold == 1)


@query("op9_chat_format", CHAT_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation read back from its formatted text."""
    said = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    read = chat.read_back(chat.format_conversations(rows.unionByName(added)))
    everything = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("turns"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(everything, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op11_pack_shards")
def op11_pack_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, bytes, words and rows balanced jointly."""
    rows = shards.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return shards.shard(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op12_conversation_trie", TRIE_SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    files = alignment.read_files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), *files)


__all__ = ["QUERIES", "SQL"]
