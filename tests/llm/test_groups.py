"""Sharding, the conversation trie and the alignment of tokenizers against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd_rows import rows_of_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geneweft.llm import alignment, conversation_trie, shards
from geneweft.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# sharding


def check_shards(rows, texts):
    """Every row once with its size and checksum; slots gapless; groups whole unless they are large."""
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted(
        (d is None, d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(0 <= s < 16 for s in slots)


def test_shards_odd_rows(odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL")
    got = shards.shard(shards.measured(docs))
    assert set(docs.columns) <= set(got.columns)
    check_shards(got.collect(), [r[:2] for r in rows_of_documents() if r[0] is not None])
    assert shards.shard(shards.measured(odd_docs)).count() == odd_docs.count()
    assert shards.shard(shards.measured(no_docs)).count() == 0


def test_shards_query_balances_bytes_and_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op11_pack_shards"](spark, sf).collect()
    check_shards(rows, [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    size, count = Counter(), Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
    longest = max(r["size"] for r in rows)
    assert max(size.values()) - min(size.values()) <= longest and max(count.values()) - min(count.values()) <= 8
    again = QUERIES["op11_pack_shards"](spark, sf).collect()
    assert sorted((r["doc_id"], r["shard"]) for r in rows) == sorted((r["doc_id"], r["shard"]) for r in again)


def test_a_hot_group_is_cut_and_small_groups_stay_whole(spark):
    rows = [(i, "the same text") for i in range(4000)] + [(4000 + i, f"text {i % 3000} " + "x" * (i % 50)) for i in range(6000)]
    got = shards.shard(shards.measured(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))).collect()
    check_shards(got, rows)
    text, size, count, where = dict(rows), Counter(), Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        count[r["shard"]] += 1
        where[text[r["doc_id"]]].add(r["shard"])
    assert max(size.values()) / min(size.values()) < 1.02 and max(count.values()) / min(count.values()) < 1.02
    assert len(where.pop("the same text")) == 16 and all(len(s) == 1 for s in where.values())


def test_packer_follows_the_largest_dot_product():
    rng = np.random.default_rng(4)
    sizes = rng.random((200, 3)) / 100
    packer = shards.Packer(sizes.sum(axis=0) / 5, 5)
    left = np.tile(sizes.sum(axis=0) / 5, (5, 1))
    for one in sizes:
        dots = [sum(a * b for a, b in zip(row, one)) for row in left]
        best = dots.index(max(dots))
        assert packer.place(one) == best
        left[best] -= one


def test_written_shards(spark, odd_docs, tmp_path):
    path = str(tmp_path / "shards")
    sharded = shards.shard(shards.measured(odd_docs))
    shards.write_shards(sharded, path)
    assert spark.read.parquet(path).count() == odd_docs.count()


# conversation trie


def brute_trie(rows):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role or "", digest[:32], text or ""))
    own = {c: [(x[1], x[3]) for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append((c, d == len(path)))
    below = lambda p: [q for q in members if q[: len(p)] == p]
    child = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        saved = sum((len(members[q]) - 1) * len(word.findall(q[-1][1])) for q in below(p) if q)
        out.append((
            m[0][0], len(p), members[p[:-1]][0][0] if p else None, len(m), child[p], sum(not child[q] for q in below(p)), saved,
            sha(",".join(str(c) for c, end in m if end)),
        ))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ).collect()), key=repr)


CONVS = "conv_id bigint, turn int, role string, text string, path string, words int, block int, shard int, node int"


def odd_conversations():
    r, rows = random.Random(7), []
    texts = ["hello there", "hello there", "a  b\tc", "", None, "tell me more", "x " * 3000]
    for c in [*range(0, 70), 1000, 1001, 1020, 1021, 5_000_000_000]:
        for t in range(r.randrange(1, 7)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", "", None]), r.choice(texts) if t else texts[0]))
    rows += [(3, 0, "user", "again"), (3, 0, "user", "again"), (None, 0, "user", "nobody's"), (60, 1, "user", "ü 世")]
    return rows


@pytest.mark.parametrize("n", [1, 13])
def test_trie_odd_rows(spark, n):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "p", 1, 2, 3, 4) for r in rows], CONVS).repartition(4)
    pathed = conversation_trie.paths(conversation_trie.rebuilt(conversation_trie.conversations(df)))
    assert trie_rows(conversation_trie.trie(pathed, n)) == brute_trie(rows)


def test_trie_without_rows(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], CONVS)).count() == 0


def test_trie_of_many_equal_conversations(spark):
    """A conversation that most ids repeat lies in several shards; its ends travel in pieces."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(4)] + [(c, t, "user", f"own {c} {t}") for c in range(400, 430) for t in range(3)]
    df = spark.createDataFrame([(*r, "p", 1, 2, 3, 4) for r in rows], CONVS)
    pathed = conversation_trie.paths(conversation_trie.rebuilt(conversation_trie.conversations(df)))
    assert trie_rows(conversation_trie.trie(pathed, 8, ends_chars=40)) == brute_trie(rows)


def test_skeleton_is_bounded_and_the_result_is_the_same(spark, monkeypatch):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "p", 1, 2, 3, 4) for r in rows], CONVS)
    pathed = conversation_trie.paths(conversation_trie.rebuilt(conversation_trie.conversations(df))).cache()
    known = conversation_trie.skeleton(pathed, 20, bound=6)
    assert len(known.parents) <= 6 or len(known.splitters) == 1
    monkeypatch.setattr(conversation_trie, "SAMPLE_TURNS", 1)
    assert trie_rows(conversation_trie.trie(pathed, 9)) == brute_trie(rows)


# alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    aligner = alignment.Aligner(*alignment.read_files(*PATHS))
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1]), aligner.a_bytes, aligner.b_bytes


def whole(text, libraries):
    """Tokens of the whole text with the byte ends that their bytes add up to."""
    a, b, a_bytes, b_bytes = libraries
    if not text:
        return None
    raw, x, y = (" " + text).encode(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[i] for i in x) != raw or b"".join(b_bytes[i] for i in y) != raw:
        return None
    ends = lambda ids, table: list(itertools.accumulate(len(table[i]) for i in ids))
    return x, ends(x, a_bytes), y, ends(y, b_bytes)


def brute_alignment(docs, libraries):
    rows, links = [], []
    for doc, text in docs:
        found = whole(text, libraries)
        if found is None:
            rows.append((doc, 0, 0, 0, ""))
            links.append([])
            continue
        a, ae, b, be = found
        groups, i, j = [], 0, 0
        for cut in sorted(set(ae) & set(be)):
            x, y = ae.index(cut, i) + 1, be.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        held, j = [], 0
        for i in range(len(a)):
            start = ae[i - 1] if i else 0
            while be[j] <= start:
                j += 1
            k = j
            while k < len(b) and (be[k - 1] if k else 0) < ae[i]:
                held.append((a[i], b[k]))
                k += 1
        links.append(held)
        rows.append((doc, len(a), len(b), len(groups), sha(";".join(groups))))
    counts = Counter(p for held in links for p in set(held))
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return sorted((
        (d, n_a, n_b, n_g, len(held), sum(counts[p] == top[p[0]] for p in held), sum(counts[p] for p in held), digest)
        for (d, n_a, n_b, n_g, digest), held in zip(rows, links)
    ), key=repr)


def aligned(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    ).collect()), key=repr)


ODD = ["a▁b c", "trail  ", "  lead", " x \n\n y", "𓀀𓀀 b 𓀀", "<|endoftext|> <s> </s>", "ﬁ Å é", "\x00a \x1c b", "🏳️‍🌈 z", "　  x"]


def test_spans_of_random_texts(libraries):
    aligner, r = alignment.Aligner(*alignment.read_files(*PATHS)), random.Random(1)
    pieces = [*"aab  c\n\t'sd.,!019é世▁", "<|endoftext|>", "<s>", " ", "　", "ſ", "😀", "𓀀", "🏳️‍🌈", "'ll", "the", "ﬁ", "\x00", "\x1c", "\r\n", "́"]
    for text in ODD + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 14))) for _ in range(3000)]:
        want, got = whole(text, libraries), aligner.tokens(" " + text)
        assert (want is None) == (got is None), text
        if want is not None:
            assert [list(map(int, x)) for x in got] == [list(x) for x in want], text
            cut = [aligner.tokens(w) for w in alignment.words_of(text)]
            assert [int(i) for f in cut for i in f[0]] == want[0] and [int(i) for f in cut for i in f[2]] == want[2], text


@pytest.mark.parametrize("block", [1, alignment.BLOCK_BYTES])
def test_alignment_odd_rows(spark, odd_docs, no_docs, libraries, block):
    files = alignment.read_files(*PATHS)
    docs = [r[:2] for r in rows_of_documents()] + list(enumerate(ODD, 100))
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(ODD, 100)), "doc_id bigint, text string"))
    assert aligned(alignment.alignment_digests(df.withColumn("block", F.lit("b")), *files, block_bytes=block)) == brute_alignment(docs, libraries)
    assert alignment.alignment_digests(no_docs, *files).count() == 0


def test_words_are_forgotten_and_met_again(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 20)
    known, r = alignment.Words(alignment.Aligner(*alignment.read_files(*PATHS))), random.Random(2)
    for _ in range(20):
        texts = [" ".join(r.choice(["the", "cat", "▁", "ﬁne", f"w{r.randrange(40)}", "éé"]) for _ in range(12)) for _ in range(5)]
        rows, pairs, held = alignment.block_of(known, texts)
        want = brute_alignment(list(enumerate(texts)), libraries)
        assert [(d, x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"]) for d, x in enumerate(rows)] == [(*w[:5], w[7]) for w in want]
        assert len(known.numbers) == len(known.written) == len(known.sizes)


def test_alignment_query(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert aligned(QUERIES["op13_token_alignment"](spark, SF)) == brute_alignment(docs, libraries)


def test_spans_keep_columns(odd_docs):
    got = alignment.spans(odd_docs, *alignment.read_files(*PATHS))
    assert got.columns == [*odd_docs.columns, "a_ids", "a_ends", "b_ids", "b_ends"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[5]["a_ids"] is None and rows[8]["a_ends"][-1] == rows[8]["b_ends"][-1] == 6
