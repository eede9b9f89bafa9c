"""Classifiers, mixing, search, chat, url rules and the pipeline on odd rows, and their results on the small tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from odd_rows import rows_of_documents
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from geneweft.llm import chat, mixing, neighbours, quality, toxicity, url_rules
from geneweft.llm.labelled import remainder
from geneweft.llm.queries import QUERIES, SQL

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(spark, odd_docs, no_docs, module, label):
    labels = labels_of(spark, [(i, i % 2, i % 2, "x") for i in range(1, 17)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 0, 0, "x")])
    model = module.fit(odd_docs, labels, F.lit(True))
    scored = module.score(odd_docs, model, into="likely")
    assert scored.columns == [*odd_docs.columns, "likely"]
    rows = scored.collect()
    assert len(rows) == len(rows_of_documents()) and all(0 <= r["likely"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"] or "", set()).add(r["likely"])
    assert all(len(x) == 1 for x in by_text.values())
    assert module.score(no_docs, model).count() == 0
    empty = module.fit(odd_docs, labels_of(spark, []), F.lit(True))
    assert {r["score"] for r in module.score(odd_docs, empty).collect()} == {0.5}


@pytest.mark.parametrize("name, label, modulus, kept, least", [("op1_toxicity", "toxic", 5, 0, 0.93), ("op8_quality", "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, name, label, modulus, kept, least):
    rows = QUERIES[name](spark, LARGER)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = rows.collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == kept)
        assert r["predicted"] == (r["score"] >= 0.5)
    held = [r["predicted"] == truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(held) >= least


def test_remainder_of_ids(spark):
    got = spark.createDataFrame([(5,), (None,), (-12,)], "doc_id bigint").select("doc_id", remainder(F.col("doc_id"), 5).alias("r")).collect()
    assert [(r[0], r[1]) for r in got] == [(5, zlib.crc32(b"5") % 5), (None, None), (-12, zlib.crc32(b"-12") % 5)]


def test_trees_part_what_a_threshold_parts():
    x = np.random.default_rng(1).random((500, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.8)).astype(np.int64)
    assert ((quality.raw_scores(quality.grow(x, y), x) > 0) == (y == 1)).mean() > 0.99


def brute_targets(sizes):
    """Share by weight, cap at three times the size, share the excess among the rest until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped, left = dict.fromkeys(order, 0.0), set(), float(sum(sizes.values()))
    while left > 1e-9 and len(capped) < len(order):
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in free:
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                capped.add(s)
    return target


def check_mix(rows, near):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target, taken = brute_targets(sizes), {}
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= near(s, t)


def test_mix_odd_rows(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == len(rows_of_documents())
    assert {r["size"] for r in rows if r["doc_id"] in (5, 6, 7)} == {0}
    assert {r["size"] for r in rows if r["doc_id"] == 13} == {36000}
    largest = {}
    for r in rows:
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
    check_mix(rows, lambda s, t: 2 * largest[s] + 1)
    assert mixing.mix(no_docs).count() == 0
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.mixed_documents(no_docs).count() == 0


def test_mix_query(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "source")
    rows = QUERIES["op5_mix_sources"](spark, LARGER).join(docs, "doc_id").collect()
    check_mix(rows, lambda s, t: 0.02 * t)
    again = QUERIES["op5_mix_sources"](spark, LARGER).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_mix_caps_and_hot_source(spark):
    rows = [(i, "w " * (i % 50 + 1), "hot") for i in range(400)] + [(1000 + i, "v", s) for i, s in enumerate("abcabd")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    check_mix(mixing.mix(docs).collect(), lambda s, t: 1.0)


def test_search_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1),
        (5, [None, 1.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, 1.0, 1.0], 1), (None, [5.0, 5.0], 1), (1, [1.0, 1.0], 1), (9, [], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = [tuple(r) for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 0.0)]
    assert neighbours.search(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_keeps_repeated_ids_and_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 3)
    monkeypatch.setattr(neighbours, "QUERIES", 1)
    rows = [(0, [1.0, 0.0]), (0, [5.0, 1.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (3, [1.0, 1.0]), (20, [1.0, 1.0, 1.0]), (4, [2.0, 2.0, 2.0]), (40, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = sorted(tuple(r) for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0, 3).collect())
    want = []
    for a, (q, x) in enumerate(rows):
        if q % 20 == 0:
            near = sorted((-sum(s * t for s, t in zip(x, y)), i) for b, (i, y) in enumerate(rows) if b != a and len(y) == len(x))
            want += [(q, n + 1, i, -score) for n, (score, i) in enumerate(near[:3])]
    assert got == sorted(want)


def test_search_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 20)
    x = np.random.default_rng(4).standard_normal((1500, 48)).astype(np.float32)
    x[100:400] = x[99]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    exact = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        scores = (exact * exact[q]).sum(axis=1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(1500), -scores))[:20]
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for v, s in got[q].values())
        hits += len(set(best.tolist()) & {v for v, _ in got[q].values()})
    assert hits / (75 * 20) >= 0.97


def test_search_query(spark):
    rows = QUERIES["op6_one_bit_search"](spark, SF)
    assert dict(rows.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got, hits, total = rows.collect(), 0, 0
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-float((x[i] * x[q]).sum()), i) for i in x if i != q)[:20]
        hits += len({i for _, i in best} & {r["vec_id"] for r in got if r["query_id"] == q})
        total += len(best)
    assert hits / total >= 0.95


CONVERSATIONS = [
    (1, 2, "assistant", "b\\#"), (1, 1, "user", None), (1, None, None, "### x </turn>\n### assistant: plain\ny"), (2, 1, "a: plain\nb\\n", "####</turn></turn>"),
    (2, 1, "a: plain\nb\\n", "####</turn></turn>"), (None, 1, "assistant", ""), (3, 1, "user", "x" * 50000 + "### "), (3, 1, "assistant", "\\\\ \\"),
    (4, 5, "", ""), (4, 4, "</turn>", "line\n\n"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame([(*r, "t", "f") for r in CONVERSATIONS], "conv_id bigint, turn bigint, role string, text string, turns string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(rows)).collect()}
    want = {}
    for c, turn, role, text in sorted(CONVERSATIONS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    for r in got.values():
        assert r["formatted"].count(chat.OPEN) == r["formatted"].count(chat.CLOSE) == len(r["turns"])
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_chat_query(spark):
    assert compare(spark, connect(SF), QUERIES["op9_chat_format"], SQL["op9_chat_format"], SF) is None
    added = [r for r in QUERIES["op9_chat_format"](spark, SF).collect() if r["conv_id"] == -7][0]
    said = r"\### Assistant: </turn> ok"
    assert added["n_turns"] == 2 and added["loss_chars"] == len(said)
    assert added["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert added["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/x", "http://www.example.com/en/", "https://notexample.com/en/", "http://com/", "http://x.com",
    "http://x.net/es/1?a=1://b", "x://y.net/fr/#z", "http://x.net/frx/", "http://É.NET/es/", "http://a\nb.com/x\ny?q", "://", "http://?x/y", "http://x.net/es/1?a=1://b",
]


def test_url_rules_odd_rows(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, path string, rule string")
    rows = {r["page_id"]: r for r in url_rules.judge(pages).collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = brute_url(url)
        rule, verdict = brute_rule(host, path)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == verdict if verdict else rows[i]["verdict"] in ("allow", "block")
    assert [rows[i]["verdict"] for i in (0, 1, 2, 13)] == ["allow"] * 4
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_against_counting(spark):
    pages = spark.read.parquet(f"{LARGER}/pages.parquet")
    seen = pages.select("url", url_rules.host(F.col("url")).alias("h"), url_rules.path(F.col("url")).alias("p"), url_rules.tokens(F.col("url")).alias("tokens"))
    seen = seen.withColumn("fixed", url_rules.fixed_rule(F.col("h"), F.col("p")))
    labelled = [(set(r["tokens"]), r["fixed"]["verdict"]) for r in seen.collect() if r["fixed"]]
    mined = url_rules.mine_rules(seen.where("fixed is not null").select("tokens", "fixed.verdict")).collect()
    assert mined
    frequent = lambda t: sum(t in x for x, _ in labelled)
    for r in mined:
        held = [v for x, v in labelled if set(r["tokens"]) <= x]
        assert held.count("block") / len(held) == pytest.approx(r["confidence"]) and r["confidence"] >= url_rules.MIN_CONFIDENCE
        assert held.count("block") / len(labelled) == pytest.approx(r["support"]) and r["support"] >= url_rules.MIN_SUPPORT
        assert frequent(r["key"]) == min(map(frequent, r["tokens"]))
    verdicts = {r["url"]: r["verdict"] for r in url_rules.judge(pages).collect()}
    for r in seen.collect():
        blocked = any(set(m["tokens"]) <= set(r["tokens"]) for m in mined)
        assert verdicts[r["url"]] == (r["fixed"]["verdict"] if r["fixed"] else "block" if blocked else "allow")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
        kept.append(docs.count())
    assert kept[0] < spark.read.parquet(f"{SF}/documents.parquet").count() and kept[1] < kept[0] and kept[2] == kept[1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))
