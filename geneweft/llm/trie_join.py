"""N-gram Jaccard join with prefix trees, exact at every size.

Documents are sets of word shingles; two link when ``100 * |x & y| >= 75 * |x | y|``. Equal sets are one set. Links are
found in two rounds, and only until every component is connected:

1. Sets with the same smallest shingle under one of two hash orders meet in a group. In a group the shingles are put
   in one order, frequent ones first, and the sets are stored in a trie. Each set walks down the trie carrying the
   overlap of the path so far, shared by all sets below; a branch ends where the overlap plus what can still come is
   too little, or where all sets below are in the walker's component already.
2. The rest must share a shingle among the first ``n - ceil(0.75 n) + 1`` of both sets in one global order, rare
   shingles first. All these prefix shingles are grouped. Where sets of different components meet, the sets of the
   smaller component are matched with the larger one as a whole; those that share enough prefix shingles with it to
   reach the threshold at best walk through the tries of its sets. Where a prefix shingle joins a crowd of components,
   all sets of the crowds that hang together are compared in tries, block against block.

The global order is by hash, with shingles that many documents hold moved to the end, the most frequent last. They are
counted over all documents by the upper 40 bits of their hashes. Which shingles are moved only changes the cost: any
order finds the same links. Shingles, and sets, are told apart by 64-bit hashes alone.

Defined cases: texts without words and null texts have an empty set and are linked with nothing; a text under five
words has one shingle, all its words; repeated rows and repeated ids are in one component; a null id takes part and is
never the smallest; a component of null ids alone has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from geneweft.llm.registry import stored
from geneweft.llm.textblocks import WordHasher, blocks, mix, shingles, space_separated

WORDS = 5
NUM, DEN = 75, 100
#: Shingles of this many documents are ordered last; so many of them, the most frequent, are known to all tasks (16 bytes each).
FREQUENT, FREQUENT_KNOWN = 16, 1_000_000
#: Bytes of a shingle's hash by which it is counted.
COUNTED_BYTES = 5
#: Bits of the filter that keeps most unwanted sets out of a shuffle; 16 MB whatever the corpus.
FILTER_BITS = 1 << 27
#: Sets that meet in one trie, and prefix shingles that meet in one task.
TRIE_SETS = 2048
BUCKET = 1 << 20
#: Bytes of texts or shingles that a task turns into Python objects at once.
SLICE_BYTES = 1 << 19
#: Components beyond which a prefix shingle's sets meet in tries at once instead of pair by pair.
CROWD = 64
_SEED = np.uint64(0x632BE59BD9B4E019)


def needed(x: int, y) -> np.ndarray:
    """Least overlap of sets of sizes x and y that link."""
    return -((-NUM * (x + y)) // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -((-NUM * n) // DEN) + 1


def text_sets(texts, hasher: WordHasher) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text."""
    for _, held in blocks(texts):
        words, offsets = hasher(held)
        runs = shingles(words, WORDS)
        for a, b in zip(offsets, offsets[1:]):
            yield np.unique(runs[a : b - WORDS + 1] if b - a >= WORDS else shingles(words[a:b], WORDS))


def set_id(s: np.ndarray) -> int:
    """A 64-bit digest that stands for the set."""
    return int(mix(s).sum(dtype=np.uint64).view(np.int64))


def in_slices(df: DataFrame, run, schema: str, wide: str) -> DataFrame:
    """``run`` over frames that hold about ``SLICE_BYTES`` of column ``wide``, or one longer row.

    Spark bounds its batches in rows; only slices of them become Python objects.
    """
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(wide)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
                yield batch.slice(start, end - start).to_pandas()
                start = end

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(go, schema)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, set, least1, least2: one pass over the texts. ``set`` names the set, ``least1`` and ``least2`` are its
    smallest shingle in two orders."""
    columns = ["doc_id", "n", "set", "least1", "least2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(space_separated())
        for batch in batches:
            rows = []
            for doc, s in zip(batch["doc_id"], text_sets(batch["text"], hasher)):
                least = (int(s[0].view(np.int64)), int(mix(s ^ _SEED).min().view(np.int64))) if len(s) else (None, None)
                rows.append((doc and int(doc), len(s), set_id(s), *least))
            yield pd.DataFrame({c: pd.array([r[i] for r in rows], dtype="Int64") for i, c in enumerate(columns)})

    # ids travel as text, which keeps null and large ones whole in pandas
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return in_slices(rows, run, "doc_id bigint, n bigint, set bigint, least1 bigint, least2 bigint", "text")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, shingles (packed, sorted) for the sets named by ``wanted`` (set), and for a few others.

    A filter with one bit per named set goes to all tasks. It has a fixed size, so a large corpus only lets more of the
    other sets pass; they meet nothing in the joins that follow.
    """
    spread = F.pmod(F.shiftrightunsigned("set", 6), F.lit(FILTER_BITS // 64))
    marks = wanted.groupBy(spread.alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(set & 63 as int))")).alias("bits"))
    marks = marks.toPandas()
    places = marks["place"].to_numpy(np.int64)
    order = np.argsort(places)
    known = docs.sparkSession.sparkContext.broadcast((places[order], marks["bits"].to_numpy(np.int64)[order].view(np.uint64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(space_separated())
        places, bits = known.value
        for batch in batches:
            made = [(set_id(s), s) for s in text_sets(batch["text"], hasher)]
            ids = np.array([one for one, _ in made], dtype=np.int64).view(np.uint64)
            place = ((ids >> np.uint64(6)) % np.uint64(FILTER_BITS // 64)).astype(np.int64)
            at = np.minimum(np.searchsorted(places, place), len(places) - 1)
            kept = (places[at] == place) & ((bits[at] >> (ids & np.uint64(63))) & np.uint64(1)).astype(bool) if len(places) else np.zeros(len(made), bool)
            named = {made[i][0]: made[i][1].tobytes() for i in np.flatnonzero(kept)}
            yield pd.DataFrame({"set": np.array(list(named), dtype=np.int64), "shingles": list(named.values())})

    return in_slices(docs.select("text"), run, "set bigint, shingles binary", "text").dropDuplicates(["set"])


class Trie:
    """Sets of small integers in ascending order; a node holds a run of members and the bounds of what is below."""

    __slots__ = ("run", "depth", "below", "ends", "shortest", "longest", "one")

    def __init__(self, run, depth, shortest, longest, one):
        self.run, self.depth, self.below, self.ends = run, depth, {}, []
        self.shortest, self.longest = shortest, longest
        self.one = one  # a set whose component holds all sets below, or None


def group_links(
    sets: list[np.ndarray], first: list[int] | None = None, guests: list[bool] | None = None
) -> list[tuple[int, int]]:
    """Links among ``sets`` that join all sets connected by any links among them (a spanning forest).

    ``first``: component labels known before; sets of one label are joined from the start. With ``guests``
    only links between a guest and another set count: guests walk, and only the others are stored.
    """
    lengths = [len(s) for s in sets]
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(values), dtype=np.int64)
    order[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    ranked = [np.sort(x) for x in np.split(order[inverse], np.cumsum(lengths)[:-1])]
    parent = list(range(len(sets)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if first is not None:
        seen: dict[int, int] = {}
        for i, label in enumerate(first):
            parent[i] = seen.setdefault(label, i)
    held, links = np.zeros(len(values), dtype=bool), []
    root = None

    def walk(i: int, x: np.ndarray) -> None:
        n = len(x)
        stack = [(root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.one is not None and find(node.one) == find(i):
                continue
            if node.longest * DEN < NUM * n or node.shortest * NUM > DEN * n:
                continue
            overlap += int(np.count_nonzero(held[node.run]))
            last = node.run[-1] if len(node.run) else -1
            left = n - int(np.searchsorted(x, last, side="right"))
            if overlap + min(left, node.longest - node.depth) < needed(n, max(node.shortest, -(-NUM * n // DEN))):
                continue
            for j in node.ends:
                if overlap >= needed(n, len(ranked[j])) and find(i) != find(j):
                    parent[find(i)] = find(j)
                    links.append((i, j))
            # the branch that the walker would take itself comes first
            near = x[n - left] if left else None
            stack.extend((child, overlap) for token, child in node.below.items() if token != near)
            if near in node.below:
                stack.append((node.below[near], overlap))

    def put(i: int, x: np.ndarray) -> None:
        node, at, n = root, 0, len(x)
        while True:
            node.shortest, node.longest = min(node.shortest, n), max(node.longest, n)
            if node.one is not None and find(node.one) != find(i):
                node.one = None
            if at == n:
                node.ends.append(i)
                return
            child = node.below.get(x[at])
            if child is None:
                child = Trie(x[at:], n, n, n, i)
                child.ends.append(i)
                node.below[x[at]] = child
                return
            size = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:size] != x[at : at + size])
            same = int(differ[0]) if len(differ) else size
            if same < len(child.run):
                upper = Trie(child.run[:same], at + same, child.shortest, child.longest, child.one)
                upper.below[child.run[same]] = child
                child.run = child.run[same:]
                node.below[x[at]] = upper
                child = upper
            node, at = child, at + same

    apart = guests is not None and any(guests) and not all(guests)
    crowd = Counter(first) if first is not None else {}
    # the largest known component is stored before anything walks
    rank = (lambda i: (-crowd[first[i]], first[i])) if first is not None else (lambda i: ())
    for i in sorted(range(len(sets)), key=lambda i: (apart and guests[i], *rank(i), lengths[i])):
        x = ranked[i]
        if root is None:
            root = Trie(x[:0], 0, lengths[i], lengths[i], i)
        if not apart or guests[i]:
            held[x] = True
            walk(i, x)
            held[x] = False
        if not apart or not guests[i]:
            put(i, x)
    return links


def links_in_groups(members: DataFrame) -> DataFrame:
    """a, b: links between sets of one group. ``members``: group, set, shingles, label (known component), guest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(ids, sets, labels, guests):
            found = group_links(sets, labels, guests) if len(ids) > 1 else []
            return [(ids[i], ids[j]) for i, j in found]

        current, ids, sets, labels, guests = None, [], [], [], []
        for batch in batches:
            out = []
            for group, one, packed, label, guest in zip(*(batch[c] for c in ("group", "set", "shingles", "label", "guest"))):
                if group != current:
                    out += close(ids, sets, labels, guests)
                    current, ids, sets, labels, guests = group, [], [], [], []
                ids.append(one)
                sets.append(np.frombuffer(packed, dtype=np.uint64))
                labels.append(label)
                guests.append(guest)
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")
        yield pd.DataFrame(close(ids, sets, labels, guests), columns=["a", "b"]).astype("int64")

    ordered = members.select("group", "set", "shingles", "label", "guest").repartition("group").sortWithinPartitions("group")
    return in_slices(ordered, run, "a bigint, b bigint", "shingles")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component for every node of ``links`` (a, b).

    Every round takes the smallest label among a node and its neighbours, then the label of that label.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "join-links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "join-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        step = stored(
            step.join(jump, F.col("label") == F.col("at"), "left").select("node", "old", F.least("label", "far").alias("label")), "join-labels"
        )
        labels = step.select("node", "label")
        if not step.where("old <> label").limit(1).count():
            return labels


def first_round(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among sets that share a smallest shingle. ``sets``: set, n, least1, least2."""
    groups = None
    for mine, other in (("least1", "least2"), ("least2", "least1")):
        sizes = sets.groupBy(F.col(mine).alias("least")).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        # a large group is split by the other order, which keeps similar sets together
        part = F.pmod(F.xxhash64(other), F.ceil(F.col("size") / TRIE_SETS))
        met = sets.join(sizes, F.col(mine) == F.col("least")).select("set", F.xxhash64(F.lit(mine), "least", part).alias("part"))
        # what is still large is cut into blocks, different ones in each order, so that the blocks of one overlap those of
        # the other; what remains apart is left to the second round
        large = met.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / TRIE_SETS).alias("blocks")).where("blocks > 1")
        block = F.coalesce(F.pmod(F.xxhash64(F.lit(mine), "set"), F.col("blocks")), F.lit(0))
        met = met.join(large, "part", "left").select("set", F.xxhash64("part", block).alias("group"))
        groups = met if groups is None else groups.union(met)
    groups = stored(groups, "join-groups")
    return links_in_groups(groups.join(sets_of(docs, groups), "set").withColumn("label", F.col("set")).withColumn("guest", F.lit(False)))


def dealt(bucket: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row per bucket: bucket, and every column packed in bytes."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    split = lambda x: [part.tobytes() for part in np.split(x[order], cuts[1:])]
    return pd.DataFrame({"bucket": bucket[order][cuts], **{k: split(v) for k, v in columns.items()}})


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(tokens) % np.uint64(buckets)).astype(np.int64)


def by_bucket(made: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over the rows that :func:`dealt` made, those of one bucket behind each other in one task."""
    return made.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


def pieces(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, columns) of sorted rows, joined until the first column has BUCKET * 8 bytes; a large bucket comes in several."""
    current, held, size = None, [], 0
    for batch in batches:
        for bucket, *row in zip(batch["bucket"], *(batch[c] for c in columns)):
            if held and (bucket != current or size > BUCKET * 8):
                yield current, [b"".join(c) for c in zip(*held)]
                held, size = [], 0
            current = bucket
            held.append(row)
            size += len(row[0])
    if held:
        yield current, [b"".join(c) for c in zip(*held)]


def cut(tokens: np.ndarray) -> np.ndarray:
    """The upper bits by which shingles are counted, the others zero."""
    return tokens & ~np.uint64((1 << 8 * (8 - COUNTED_BYTES)) - 1)


def frequent_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(cut shingles in order, rank of each: the more frequent, the higher); ``total``: number of shingles of all sets.

    Copies and common shingles are counted where they are read, and the counts of a bucket are added up piece by piece, so
    a task holds the different shingles of a bucket and not their rows.
    """
    buckets = max(1, math.ceil(total / BUCKET))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(space_separated())
        held, size = [], 0
        for batch in batches:
            for s in text_sets(batch["text"], hasher):
                held.append(s)
                size += len(s)
                if size > BUCKET:
                    yield packed(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield packed(np.concatenate(held))

    def packed(tokens: np.ndarray) -> pd.DataFrame:
        values, counts = np.unique(cut(tokens), return_counts=True)
        upper = values.view(np.uint8).reshape(-1, 8)[:, 8 - COUNTED_BYTES :]
        return dealt(bucket_of(values, buckets), upper=upper, counts=counts.astype(np.uint32))

    def often(values: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"shingle": values[counts >= FREQUENT].view(np.int64), "n": counts[counts >= FREQUENT]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        last, (values, counts) = None, none
        for bucket, (upper, more) in pieces(batches, "upper", "counts"):
            if bucket != last:
                yield often(values, counts)
                last, (values, counts) = bucket, none
            upper = np.frombuffer(upper, dtype=np.uint8).reshape(-1, COUNTED_BYTES)
            whole = np.zeros((len(upper), 8), dtype=np.uint8)
            whole[:, 8 - COUNTED_BYTES :] = upper
            values, at = np.unique(np.concatenate([values, whole.view(np.uint64).ravel()]), return_inverse=True)
            more = np.concatenate([counts, np.frombuffer(more, dtype=np.uint32).astype(np.int64)])
            counts = np.bincount(at, weights=more, minlength=len(values)).astype(np.int64)
        yield often(values, counts)

    made = in_slices(docs.select("text"), emit, "bucket bigint, upper binary, counts binary", "text")
    counted = by_bucket(made, count, "shingle bigint, n bigint")
    top = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT_KNOWN).toPandas()
    values = top["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    by_value = np.argsort(values)
    return values[by_value], (len(values) - by_value).astype(np.int64)


class Shared:
    """The (shingle, set) pairs of a bucket whose shingle is in several sets, piece by piece.

    Of every shingle the first set is held back until another one comes, so what is held is one set per shingle.
    """

    def __init__(self):
        self.tokens, self.first = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.told = np.zeros(0, dtype=bool)

    def add(self, tokens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new, at = np.unique(tokens, return_index=True)
        fresh = ~np.isin(new, self.tokens, assume_unique=True)
        every = np.concatenate([self.tokens, new[fresh]])
        order = np.argsort(every, kind="stable")
        self.tokens = every[order]
        self.first = np.concatenate([self.first, ids[at[fresh]]])[order]
        self.told = np.concatenate([self.told, np.zeros(np.count_nonzero(fresh), dtype=bool)])[order]
        at = np.searchsorted(self.tokens, tokens)
        other = ids != self.first[at]
        several = np.zeros(len(self.tokens), dtype=bool)
        several[at[other]] = True
        several &= ~self.told
        self.told |= several
        return np.concatenate([self.tokens[several], tokens[other]]), np.concatenate([self.first[several], ids[other]])


def prefix_shingles(docs: DataFrame, total: int) -> DataFrame:
    """shingle, set for every prefix shingle that at least two different sets hold, and for every frequent one.

    The frequent ones are dealt by set, so that no task gets all sets of a shingle.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, total))
    buckets = max(1, math.ceil(total * (DEN - NUM) / DEN / BUCKET))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher(space_separated())
        values, ranks = known.value
        met, held, size = set(), [], 0

        def packed() -> pd.DataFrame:
            tokens, often = (np.concatenate([row[i] for row in held]) for i in (0, 2))
            ids = np.repeat(np.array([row[1] for row in held], dtype=np.int64), [len(row[0]) for row in held])
            bucket = np.where(often, buckets + bucket_of(ids.view(np.uint64), buckets), bucket_of(tokens, buckets))
            return dealt(bucket, tokens=tokens, sets=ids)

        for batch in batches:
            for s in text_sets(batch["text"], hasher):
                one = set_id(s)
                if not len(s) or one in met:
                    continue
                met.add(one)
                keep = prefix_length(len(s))
                often = np.zeros(len(s), dtype=bool)
                if len(values):
                    at = np.minimum(np.searchsorted(values, cut(s)), len(values) - 1)
                    late = values[at] == cut(s)
                    if late.any():
                        s = np.concatenate([s[~late], s[late][np.argsort(ranks[at[late]], kind="stable")]])
                        often[np.count_nonzero(~late) :] = True
                held.append((s[:keep], one, often[:keep]))
                size += keep
                if size > BUCKET:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, bucket_pairs = None, None
        for bucket, (tokens, ids) in pieces(batches, "tokens", "sets"):
            tokens, ids = np.frombuffer(tokens, dtype=np.uint64), np.frombuffer(ids, dtype=np.int64)
            order = np.lexsort((ids, tokens))
            tokens, ids = tokens[order], ids[order]
            new = np.ones(len(tokens), dtype=bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])
            tokens, ids = tokens[new], ids[new]
            if bucket < buckets:
                if bucket != last:
                    last, bucket_pairs = bucket, Shared()
                tokens, ids = bucket_pairs.add(tokens, ids)
            yield pd.DataFrame({"shingle": tokens.view(np.int64), "set": ids})

    made = in_slices(docs.select("text"), emit, "bucket bigint, tokens binary, sets binary", "text")
    return by_bucket(made, shared, "shingle bigint, set bigint").dropDuplicates(["shingle", "set"])


def enough_common(n, m):
    """Prefix shingles that sets of sizes n and m must share to link.

    Behind the prefix that ends first in the order lie at most that set's other shingles.
    """
    rest = lambda c: c - (c - F.ceil(c * NUM / DEN) + 1)
    return F.ceil((n + m) * NUM / (NUM + DEN)) - F.greatest(rest(n), rest(m))


def least_common(n, low, high):
    """The least of :func:`enough_common` over the sizes from ``low`` to ``high``.

    It rises up to equal sizes. Behind them it falls in steps: d sizes before the end it is less than at the end by at
    most ceil(3d / 7) - floor(3d / 4), which is 1 for d = 1 and never above 0 for other d.
    """
    return F.least(*[enough_common(n, m) for m in (low, F.greatest(low, high - 1), high)])


def crowd_members(crowded: DataFrame) -> DataFrame:
    """set, guest, group: sets that share crowded shingles (shingle, set, label), each block of them against each other."""
    hubs = crowded.groupBy("shingle").agg(F.min("label").alias("a"))
    links = crowded.select("shingle", F.col("label").alias("b")).join(hubs, "shingle").where("a <> b").select("a", "b").distinct()
    clusters = components(links).select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    sets = stored(crowded.select("set", "label").distinct().join(clusters, "label").select("set", "cluster"), "join-clustered")
    sizes = sets.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TRIE_SETS).cast("int").alias("parts"))
    own = sets.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = F.xxhash64(F.lit("crowd"), "cluster", F.least("part", "other"), F.greatest("part", "other"))
    return met.select("set", (F.col("part") > F.col("other")).alias("guest"), group.alias("group"))


def second_round(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components that the first round left apart. ``nodes``: set, n, label, size (sets of the label)."""
    total = nodes.agg(F.sum("n")).first()[0] or 0
    held = stored(prefix_shingles(docs, total), "join-prefixes").join(nodes, "set")
    mixed = held.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    mine = held.join(mixed, "shingle")
    crowds = mine.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("shingle").agg(F.count(F.lit(1)).alias("labels"))
    crowds = stored(crowds.where(F.col("labels") > CROWD), "join-crowds")
    crowded = stored(mine.join(crowds, "shingle").select("shingle", "set", "label"), "join-crowded")
    mine = mine.join(crowds, "shingle", "left_anti")
    theirs = mine.groupBy("shingle", F.col("label").alias("into"), F.col("size").alias("into_size")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    # the smaller component comes to the larger one; only sizes that may link meet
    n, least, most = F.col("n"), F.ceil(F.col("n") * NUM / DEN), F.floor(F.col("n") * DEN / NUM)
    met = mine.join(theirs, "shingle").where(
        (F.struct("into_size", "into") > F.struct("size", "label")) & (F.col("high") >= least) & (F.col("low") <= most)
    )
    met = met.groupBy("set", "n", "into", "into_size").agg(F.count(F.lit(1)).alias("common"), F.min("low").alias("low"), F.max("high").alias("high"))
    wanted = least_common(n, F.greatest("low", least), F.least("high", most))
    pairs = stored(met.where(F.col("common") >= wanted).select("set", "into", "into_size"), "join-pairs")
    parts = lambda size: F.ceil(size / TRIE_SETS).cast("int")
    hubs = pairs.groupBy("into", "into_size").agg(F.count(F.lit(1)).alias("guests"))
    hubs = hubs.select("into", parts(F.col("into_size")).alias("rows"), parts(F.col("guests")).alias("columns"))
    place = lambda count: F.pmod(F.xxhash64("set"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    hosts = nodes.select("set", F.col("label").alias("into")).join(hubs, "into").select("set", "into", place("rows").alias("row"), every("columns").alias("column"))
    guests = pairs.select("set", "into").join(hubs, "into").select("set", "into", every("rows").alias("row"), place("columns").alias("column"))
    both = hosts.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    both = both.select("set", "guest", F.xxhash64("into", "row", "column").alias("group"))
    members = stored(both.unionByName(crowd_members(crowded)), "join-members")
    return links_in_groups(members.join(sets_of(docs, members), "set").join(nodes.select("set", "label"), "set"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n, set, label (of the component, null for an empty set) of every row of ``docs`` (doc_id, text)."""
    rows = stored(describe(docs), "join-described")
    sets = rows.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("least1").alias("least1"), F.first("least2").alias("least2"))
    sets = stored(sets, "join-distinct")
    near = stored(first_round(sets, docs), "join-first")
    joined = components(near)
    sizes = joined.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    known = stored(joined.join(sizes, "label").select(F.col("node").alias("set"), "label", "size"), "join-known")
    nodes = sets.select("set", "n").join(known, "set", "left").select(
        "set", "n", F.coalesce("label", "set").alias("label"), F.coalesce("size", F.lit(1)).alias("size")
    )
    links = near.union(second_round(stored(nodes, "join-nodes"), docs))
    named = rows.select("doc_id", "n", "set").join(components(links).withColumnRenamed("node", "set"), "set", "left").select(
        "doc_id", "n", "set", F.when(F.col("n") > 0, F.coalesce("label", "set")).alias("label")
    )
    return stored(named, "join-labelled")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    named = labelled(docs)
    smallest = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")).alias("component_id")
    )


@F.pandas_udf(T.LongType())
def set_of_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The digest of a text's set, null for an empty set."""
    hasher = WordHasher(space_separated())
    for batch in texts:
        yield pd.Series([set_id(s) if len(s) else None for s in text_sets(batch, hasher)], dtype="Int64")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, and of its smallest set where the id repeats.

    A row with an empty set is alone. Rows that repeat it stand once.
    """
    named = labelled(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set")).alias("first")
    keepers = named.where("n > 0").groupBy("label").agg(first).select(F.col("first.doc_id").alias("_keeper"), F.col("first.set").alias("_kept"))
    empty = named.where("n = 0").select(F.col("doc_id").alias("_keeper"), F.lit(None).cast("bigint").alias("_kept")).distinct()
    keepers = stored(keepers.unionByName(empty), "join-keepers")
    # an id of one row names it; few ids repeat or are null, and only their texts are hashed to tell the rows apart
    repeated = stored(named.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"), "join-repeated")
    alone = keepers.where("_keeper is not null").join(repeated, F.col("_keeper") == F.col("_id"), "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # hashing the ids spares a sort of all texts
    once = docs.join(alone.hint("shuffle_hash"), F.col("doc_id") == F.col("_keeper"), "left_semi").select(*columns)
    again = docs.join(repeated, F.col("doc_id") == F.col("_id"), "left_semi").unionByName(docs.where("doc_id is null")).withColumn("_set", set_of_text("text"))
    again = again.join(keepers, F.col("doc_id").eqNullSafe(F.col("_keeper")) & F.col("_set").eqNullSafe(F.col("_kept")), "left_semi")
    # texts of one set may differ in case and spaces; those of empty sets are different documents
    apart = F.when(F.col("_set").isNull(), F.col("text"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_set", apart).orderBy("text"))
    return once.unionByName(again.withColumn("_nth", nth).where("_nth = 1").select(*columns))
