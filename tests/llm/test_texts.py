"""BPE, secrets, fingerprints and the shingle join against brute force, on odd rows and on the smallest tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from odd_rows import rows_of_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geneweft.llm import bpe, fingerprint, secret_scan, trie_join
from geneweft.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def sf_docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def check_tokens(rows, docs, library):
    want = []
    for doc, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_bpe_odd_rows(spark, odd_docs, no_docs, library):
    vocabulary = bpe.read_vocabulary(PATH)
    check_tokens(bpe.token_digests(odd_docs, vocabulary).collect(), [r[:2] for r in rows_of_documents()], library)
    assert bpe.token_digests(no_docs, vocabulary).count() == 0
    kept = bpe.encode(odd_docs, vocabulary, ids="tokens")
    assert kept.columns == [*odd_docs.columns, "tokens"]


def test_bpe_query(spark, sf_docs, library):
    check_tokens(QUERIES["op3_bpe_tokens"](spark, SF).collect(), sf_docs, library)


def test_bpe_random_strings(library):
    ours, r = bpe.Tokenizer(bpe.read_vocabulary(PATH)), random.Random(3)
    pieces = [*"aab  c\n\t'sdtre.,!019é世", "<|endoftext|>", "  ", "\u00a0", "\u3000", "ſ", "😀", "'ll", "aaaa"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == want
        assert ours.decode(ours.encode(text)) == library.decode(want, skip_special_tokens=False)


def brute_secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_odd_rows(odd_docs, no_docs):
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in secret_scan.findings(odd_docs).collect()]
    want = [(r[0], [(a, p + 1, b, k) for a, p, b, k in brute_secrets(r[1])]) for r in rows_of_documents()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert secret_scan.findings(no_docs).count() == 0


def test_secrets_query(spark, sf_docs):
    want = {d: ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute_secrets(t)) for d, t in sf_docs}
    got = {r["doc_id"]: (r["spans"], r["base_sha256"]) for r in QUERIES["op4_secret_scan"](spark, SF).collect()}
    assert got == {d: (s, sha(s)) for d, s in want.items()}


def test_secrets_are_masked(odd_docs):
    got = odd_docs.columns, sorted((tuple(r) for r in secret_scan.redacted(odd_docs).collect()), key=repr)
    want = []
    for row in rows_of_documents():
        text, spans = row[1], []
        for a, _, b, _ in brute_secrets(text):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for a, b in reversed(spans):
            text = text[:a] + secret_scan.MASK + text[b:]
        want.append((row[0], text, *row[2:4], len(text) if spans else row[4], *row[5:]))
    assert got == (odd_docs.columns, sorted(want, key=repr))


def test_ledger_scans_a_blob_once(spark, odd_docs, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = secret_scan.findings(odd_docs, ledger).collect()
    blobs = secret_scan.read_ledger(spark, ledger).count()
    assert blobs == len({r[1] or "" for r in rows_of_documents()})
    assert sorted(map(repr, secret_scan.findings(odd_docs, ledger).collect())) == sorted(map(repr, first))
    assert secret_scan.read_ledger(spark, ledger).count() == blobs
    changed = (*secret_scan.RULES[:2], ("hex", "[0-9a-f]+", 0, 30, ()))
    secret_scan.findings(odd_docs, ledger, changed).count()
    again = secret_scan.read_ledger(spark, ledger).where(f"array_contains(versions, '{secret_scan.rule_version(changed[2])}')")
    assert again.count() == blobs and again.where("size(versions) > 1").count() == 0


def in_order(docs):
    """By descending id, null last, equal ids by text."""
    return sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))


def check_edited(rows, docs):
    docs, want = in_order(docs), []
    for i, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        want.append((doc, len(text), sha(text[: len(text) - half] + after[:half])))
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=repr) == sorted(want, key=repr)


def test_fingerprints_odd_rows(spark, odd_docs, no_docs):
    rank = fingerprint.ranks(fingerprint.level_counts(odd_docs))
    rows = fingerprint.compare_edited(odd_docs, rank).collect()
    check_edited(rows, [r[:2] for r in rows_of_documents()])
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert all((r["fingerprint"] == "0:") == (r["n_chars"] == 0) for r in rows)
    assert fingerprint.compare_edited(no_docs, fingerprint.ranks(fingerprint.level_counts(no_docs))).count() == 0


def test_fingerprint_query(spark, sf_docs):
    rows = QUERIES["op2_fingerprint"](spark, SF).collect()
    check_edited(rows, sf_docs)
    texts, by_text = dict(sf_docs), {}
    for r in rows:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    long = [r for r in rows if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] for r in long]) > 0.2 > np.mean([r["near_next"] for r in long])


def test_window_levels_are_entropies():
    data = np.frombuffer(random.Random(1).randbytes(300) + b"abc" * 90 + b"z" * 200, dtype=np.uint8)
    levels = fingerprint.window_levels(data)
    for i in range(len(data) - 63):
        counts = np.bincount(data[i : i + 64])
        p = counts[counts > 0] / 64
        assert abs(levels[i] - 1000 / 6 * -(p * np.log2(p)).sum()) <= 1.01


def test_likeness_of_copies_and_strangers():
    r = random.Random(2)
    one, two = (" ".join(r.choice("abcdefghij") * r.randrange(1, 9) for _ in range(3000)).encode() for _ in "ab")
    rank = np.arange(fingerprint.LEVELS, dtype=np.int32)
    (a, b, c) = (fingerprint.chains([x], rank)[0] for x in (one, two, one[: len(one) // 2] + two))
    assert fingerprint.read(fingerprint.written(a))[1].tolist() == a[1].tolist()
    assert fingerprint.likeness(a[1], a[1]) == 1 and fingerprint.likeness(a[1], b[1]) < 0.1
    assert 0.3 < fingerprint.likeness(a[1], c[1]) < 0.9


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(docs):
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc)
    smallest = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((docs[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(docs))), key=repr)


def test_join_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, trie_join.jaccard_components(odd_docs).collect()), key=repr)
    assert got == brute_components([r[:2] for r in rows_of_documents()])
    assert trie_join.jaccard_components(no_docs).count() == 0


def test_join_query(spark, sf_docs):
    got = sorted(map(tuple, QUERIES["op7_shingle_join"](spark, SF).collect()), key=repr)
    assert got == brute_components(sf_docs)


def family(r, size, words, edits):
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(r.randrange(edits)):
            copy[r.randrange(words)] = f"e{r.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("crowd", [2, 64])
def test_join_families_around_the_threshold(spark, monkeypatch, crowd):
    r = random.Random(5)
    texts = [t for words in (8, 20, 40, 80) for t in family(r, 60, words, words // 8 + 3)]
    docs = list(enumerate(texts))
    monkeypatch.setattr(trie_join, "TRIE_SETS", 16)
    monkeypatch.setattr(trie_join, "FREQUENT", 4)
    monkeypatch.setattr(trie_join, "CROWD", crowd)
    got = trie_join.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(docs)


def test_join_bound_between_the_ends_of_a_component(spark, monkeypatch):
    """A set of 100 links, at exactly 0.75, with the 103 of a component of sizes 97, 103 and 104 alone."""
    monkeypatch.setattr(trie_join, "FREQUENT", 2)
    hasher = trie_join.WordHasher(trie_join.space_separated())

    def least(text):
        s = next(iter(trie_join.text_sets([text], hasher)))
        return int(s[0]), int(trie_join.mix(s ^ trie_join._SEED).min())

    def texts(seed):
        word = lambda n: [f"{seed}w{r.randrange(10**9)}" for _ in range(n)]
        r = random.Random(seed)
        passage = word(91)
        y = word(16) + passage
        # the others hold the passage's end, which puts it last in the order
        return [" ".join(t) for t in (word(13) + passage, y[:-6], y, word(1) + y, *(word(40) + passage[-10:] for _ in range(3)))]

    def apart(seed):
        """The first round joins the three and leaves the set of 100 alone."""
        x, *ys = map(least, texts(seed)[:4])
        return all(x[0] != y[0] and x[1] != y[1] for y in ys) and all(y[0] == ys[1][0] or y[1] == ys[1][1] for y in ys)

    docs = list(enumerate(texts(next(filter(apart, range(2000))))))
    got = sorted(map(tuple, trie_join.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()), key=repr)
    assert [row[1] for row in got[:4]] == [100, 97, 103, 104]
    assert got == brute_components(docs)


def test_first_round_cuts_copies_with_equal_minima(spark, monkeypatch):
    """300 near copies with both minima in common meet in blocks of about TRIE_SETS sets, and are one component."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    copies = [" ".join(base + [f"e{i}"]) for i in range(900)]
    hasher = trie_join.WordHasher(trie_join.space_separated())
    met = {}
    for text, s in zip(copies, trie_join.text_sets(copies, hasher)):
        met.setdefault((s[0], trie_join.mix(s ^ trie_join._SEED).min()), []).append(text)
    docs = list(enumerate(max(met.values(), key=len)[:300]))
    assert len(docs) == 300
    largest = []
    links = trie_join.links_in_groups

    def noted(members):
        largest.append(members.groupBy("group").count().agg(F.max("count")).first()[0])
        return links(members)

    monkeypatch.setattr(trie_join, "TRIE_SETS", 16)
    monkeypatch.setattr(trie_join, "links_in_groups", noted)
    got = trie_join.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(docs)
    assert largest[0] <= 3 * 16


def test_shingles_are_counted_before_they_move(spark, monkeypatch):
    """A line that all rows hold reaches no task row by row, neither to be counted nor with its sets."""
    r = random.Random(8)
    line = [f"w{i}" for i in range(30)]
    texts = [" ".join([f"e{r.randrange(10**6)}" for _ in range(4)] + line) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    read = []
    frame = type(docs)

    def noted(self, run, schema, **rest):
        if "bucket" in self.columns and schema.startswith("shingle"):
            rows = self.collect()
            sizes = {}
            for row in rows:
                sizes[row["bucket"]] = sizes.get(row["bucket"], 0) + len(row[1]) // (8 if "sets" in self.columns else 5)
            read.append(sizes)
        return plain(self, run, schema, **rest)

    plain = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", noted)
    monkeypatch.setattr(trie_join, "BUCKET", 1 << 9)
    total = 30 * 400
    held = [tuple(row) for row in trie_join.prefix_shingles(docs, total).collect()]
    assert len(held) == len(set(held)) and len(read) == 2
    # 12,000 shingles, of which 26 are in all rows
    assert sum(read[0].values()) < 6000
    assert max(read[1].values()) < 400


def test_shared_shingles_piece_by_piece():
    r = np.random.default_rng(2)
    tokens, ids = r.integers(0, 60, 300).astype(np.uint64), r.integers(0, 5, 300)
    pairs, got = trie_join.Shared(), set()
    for a in range(0, 300, 7):
        got |= set(zip(*(x.tolist() for x in pairs.add(tokens[a : a + 7], ids[a : a + 7]))))
    every = set(zip(tokens.tolist(), ids.tolist()))
    assert got == {(t, i) for t, i in every if len({j for u, j in every if u == t}) > 1}


def test_least_common_is_the_least_of_the_range(spark):
    sizes = [(n, low, high) for n in (1, 4, 7, 28, 99, 100, 101) for low in range(-(-3 * n // 4), 4 * n // 3 + 1) for high in range(low, 4 * n // 3 + 1)]
    need = lambda n, m: -(-3 * (n + m) // 7) - -(-3 * max(n, m) // 4) + 1
    least = trie_join.least_common(*map(F.col, ("n", "low", "high")))
    for n, low, high, got in spark.createDataFrame(sizes, "n bigint, low bigint, high bigint").select("*", least).collect():
        assert got == min(need(n, m) for m in range(low, high + 1)), (n, low, high)


def test_trie_finds_the_forest_of_all_links():
    r = random.Random(9)
    for _ in range(60):
        base = [r.sample(range(60), 30) for _ in range(3)]
        sets = [np.unique(np.array([x for x in r.choice(base) if r.random() < 0.9] + [r.randrange(1000)], dtype=np.uint64)) for _ in range(25)]
        parent = list(range(25))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
        want = {(i, j) for i in range(25) for j in range(25) if find(i) == find(j)}
        parent = list(range(25))
        for i, j in trie_join.group_links(sets):
            assert find(i) != find(j)
            parent[find(i)] = find(j)
        assert want == {(i, j) for i in range(25) for j in range(25) if find(i) == find(j)}


def test_one_of_each(odd_docs):
    kept = trie_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 17]


def test_one_of_each_by_row_and_component(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    a, b, c = text("a"), text("b"), text("c")
    rows = [
        (1, a), (None, a), (None, a + " x"), (None, b), (None, b + " x"), (None, b.upper()), (None, ""), (None, None),
        (3, c), (5, c + " x"), (5, text("d")), (5, text("d").upper()), (6, text("d") + " y"), (7, ""), (7, " "),
    ]
    kept = [tuple(row) for row in trie_join.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    named = [(doc, (text or "").lower().split(" ")[0][:1]) for doc, text in kept]
    assert sorted(named, key=repr) == sorted(
        [(1, "a"), (None, "b"), (None, ""), (None, ""), (3, "c"), (5, "d"), (7, ""), (7, "")], key=repr
    )
