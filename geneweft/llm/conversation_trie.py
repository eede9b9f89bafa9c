"""Prefix trie of conversations with a splitter skeleton.

A conversation is a path of turn digests, so that paths sort by their bytes and all conversations under a node lie next to
each other. Splitters drawn from the paths cut this order into shards. A node that is no prefix of a splitter has all
its conversations in one shard: the shard, sorted, finishes it while walking from path to path. The prefixes of the splitters
form a small trie, the skeleton, which is broadcast; shards send partial aggregates of its nodes, which are added up and
rolled up from the leaves. A splitter is a path with a conversation id, so that equal paths too go to several shards; the ids of
conversations that end at a skeleton node travel in pieces of joined text and are digested in order.

The skeleton is bounded: where the splitters' prefixes have more than ``SKELETON`` nodes, every second splitter is left out,
which changes the load of the shards and no result. A conversation is one row, so its turns meet in one task, as digests of
16 bytes; texts do not move.

Defined cases: turns go by turn number, nulls first, ties by role and digest of the text; null role or text is empty;
repeated rows stay; rows without a conversation id belong to no conversation and are left out; a conversation without turns
after rebuilding ends at the root; an empty table has no node, not even the root; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geneweft.llm.registry import stored

DIGEST = 16
#: Bounds on what the driver sees of the paths and on the broadcast skeleton.
SAMPLE_BYTES, SAMPLE_TURNS, SKELETON = 1 << 25, 1024, 200_000
ENDS_CHARS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def turn_digest(role: Column, text: Column) -> Column:
    """The first 128 bits of SHA-256 over role and text, in hex."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, block, turns: array of (digest, words) in order; conversations of a block of 20 ids lie together."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), (F.col("conv_id") - F.col("conv_id") % 20).cast("long").alias("block"),
        F.struct(
            F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"),
            turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("t"),
    )
    # both this grouping and the join with the block's first conversation keep the partitioning by block
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(n, "block").groupBy("block", "conv_id").agg(
        F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"], t["words"])).alias("turns")
    )


def rebuilt(convs: DataFrame) -> DataFrame:
    """``convs`` with the first h turns of the block's first conversation and their own turns after their first h."""
    heads = convs.where("conv_id = block").select(F.col("block").alias("_block"), F.slice("turns", 1, 3).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return convs.join(heads, F.col("block") == F.col("_block"), "left").select("conv_id", F.concat(head, own).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """conv_id, path (digests one after another), words of every turn."""
    return convs.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"),
        F.transform("turns", lambda t: t["words"]).alias("words"),
    )


class Skeleton:
    """The trie of the splitters' paths; node 0 is the root and a parent comes before its children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.children, self.parents, self.depths = {}, [None], [0]
        for path, _ in splitters:
            node = 0
            for i in range(0, len(path), DIGEST):
                step = node, path[i : i + DIGEST]
                if step not in self.children:
                    self.children[step] = len(self.parents)
                    self.parents.append(node)
                    self.depths.append(i // DIGEST + 1)
                node = self.children[step]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect.bisect_right(self.splitters, (path, conv_id))


def skeleton(pathed: DataFrame, shards: int, bound: int = SKELETON) -> Skeleton:
    """Splitters for ``shards`` shards from a sample of bounded size, chosen by a hash of the id."""
    longest = pathed.agg(F.max(F.least(F.length("path"), F.lit(SAMPLE_TURNS * DIGEST)))).first()[0] or DIGEST
    few = min(20 * shards, max(shards, SAMPLE_BYTES // longest))
    cut = F.substring("path", 1, SAMPLE_TURNS * DIGEST).alias("path")
    sample = pathed.select(cut, "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(few).collect()
    sample = sorted((bytes(p), c) for p, c in sample)
    splitters = [sample[len(sample) * k // shards] for k in range(1, shards)] if len(sample) >= shards else sample
    splitters = sorted(set(splitters))
    made = Skeleton(splitters)
    while len(made.parents) > bound and len(splitters) > 1:
        splitters = splitters[1::2]
        made = Skeleton(splitters)
    return made


class Node:
    __slots__ = ("conv_id", "n_convs", "n_children", "n_leaves", "saved", "words", "ends", "waiting")

    def __init__(self, words: int):
        self.conv_id, self.n_convs, self.n_children, self.n_leaves, self.saved = None, 0, 0, 0, 0
        self.words, self.ends, self.waiting = words, None, []

    def take(self, conv_id: int, n_convs: int) -> None:
        self.n_convs += n_convs
        if self.conv_id is None or conv_id < self.conv_id:
            self.conv_id = conv_id


PARTS = (
    "node int, parent_node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string, words bigint, shard int, piece int, ends string"
)
COLUMNS = [f.split()[0] for f in PARTS.split(", ")]
NONE = hashlib.sha256(b"").hexdigest()


class Walk:
    """Goes through the sorted conversations of one shard; ``rows`` fills with finished nodes and pieces of ends.

    A finished node waits for its parent, whose smallest member it names; a child of a skeleton node names that node.
    """

    def __init__(self, known: Skeleton, shard: int, ends_chars: int):
        self.known, self.shard, self.ends_chars, self.rows = known, shard, ends_chars, []
        self.last, self.chain, self.open = [], [0], []
        self.parts: dict[int, Node] = {}
        self.ends: dict[int, list[str]] = {}
        self.size, self.pieces = 0, 0

    def close(self) -> None:
        """Finish the deepest open node."""
        node, depth = self.open.pop(), len(self.chain) - 1 + len(self.open) + 1
        saved = node.saved + (node.n_convs - 1) * node.words
        leaves = node.n_leaves if node.n_children else 1
        for row in node.waiting:
            self.rows.append((*row[:4], node.conv_id, *row[5:]))
        top = not self.open
        parent = self.part(self.chain[-1], depth - 1) if top else self.open[-1]
        parent.take(node.conv_id, node.n_convs)
        parent.n_children += 1
        parent.n_leaves += leaves
        parent.saved += saved
        ends = NONE if node.ends is None else node.ends.hexdigest()
        row = (None, self.chain[-1] if top else None, node.conv_id, depth, None, node.n_convs, node.n_children, leaves, saved, ends, None, self.shard, None, None)
        (self.rows if top else parent.waiting).append(row)

    def part(self, node: int, depth: int) -> Node:
        if node not in self.parts:
            self.parts[node] = Node(self.words[depth - 1] if depth else 0)
        return self.parts[node]

    def flush(self) -> None:
        """Send the pieces of ends; they are numbered in the order of the ids."""
        for node, texts in self.ends.items():
            self.rows.append((node, *[None] * 10, self.shard, self.pieces, ",".join(texts)))
        self.ends, self.size, self.pieces = {}, 0, self.pieces + 1

    def add(self, path: bytes, conv_id: int, words: list[int]) -> None:
        turns = [path[i : i + DIGEST] for i in range(0, len(path), DIGEST)]
        same = 0
        for a, b in zip(self.last, turns):
            if a != b:
                break
            same += 1
        while self.open and len(self.chain) - 1 + len(self.open) > same:
            self.close()
        del self.chain[same + 1 :]
        self.last, self.words = turns, words
        if not self.open:
            while (step := (self.chain[-1], turns[len(self.chain) - 1] if len(self.chain) <= len(turns) else None)) in self.known.children:
                self.chain.append(self.known.children[step])
                self.part(self.chain[-1], len(self.chain) - 1)
        for depth in range(len(self.chain) - 1 + len(self.open), len(turns)):
            self.open.append(Node(words[depth]))
        if self.open:
            node, text = self.open[-1], str(conv_id)
            if node.ends is None:
                node.ends = hashlib.sha256(text.encode())
            else:
                node.ends.update(b"," + text.encode())
        else:
            node, text = self.part(self.chain[-1], len(turns)), str(conv_id)
            self.ends.setdefault(self.chain[-1], []).append(text)
            self.size += len(text)
            if self.size > self.ends_chars:
                self.flush()
        node.take(conv_id, 1)

    def finish(self) -> None:
        while self.open:
            self.close()
        self.flush()
        for node, p in self.parts.items():
            self.rows.append((node, None, p.conv_id, None, None, p.n_convs, p.n_children, p.n_leaves, p.saved, None, p.words, self.shard, None, None))
        self.parts = {}


def walked(pathed: DataFrame, known: Skeleton, shards: int, ends_chars: int) -> DataFrame:
    """Stored parts of the trie: finished nodes (with a depth), partial aggregates of skeleton nodes, pieces of their ends."""
    shared = pathed.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv_id: pd.Series) -> pd.Series:
        return pd.Series([shared.value.shard(p, c) for p, c in zip(path, conv_id)], dtype="int32")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = None
        for batch in batches:
            for shard, path, conv_id, words in zip(batch["shard"].tolist(), batch["path"], batch["conv_id"].tolist(), batch["words"]):
                if walk is None:
                    walk = Walk(shared.value, shard, ends_chars)
                walk.add(path, conv_id, words)
                if len(walk.rows) >= 5000:
                    yield framed(walk)
        if walk is not None:
            walk.finish()
            yield framed(walk)

    def framed(walk: Walk) -> pd.DataFrame:
        out, walk.rows = pd.DataFrame(walk.rows, columns=COLUMNS, dtype=object), []
        return out

    dealt = pathed.withColumn("shard", shard_of("path", "conv_id")).repartitionById(shards, F.col("shard"))
    return stored(dealt.sortWithinPartitions("path", "conv_id").mapInPandas(run, PARTS), "trie-parts")


def rolled_up(partial: list, known: Skeleton) -> list[tuple]:
    """Skeleton nodes from their partial aggregates: every node takes over what its children hold, the deepest first."""
    size = len(known.parents)
    nodes = [Node(0) for _ in range(size)]
    for node, conv_id, n_convs, n_children, n_leaves, saved, words in partial:
        one = nodes[node]
        one.n_children, one.n_leaves, one.saved, one.words = n_children, n_leaves, saved, words
        if conv_id is not None:
            one.take(conv_id, n_convs)
    for node in range(size - 1, -1, -1):
        one, parent = nodes[node], known.parents[node]
        if not one.n_convs:
            continue
        if not one.n_children:
            one.n_leaves = 1
        one.saved += (one.n_convs - 1) * one.words
        if parent is not None:
            above = nodes[parent]
            above.take(one.conv_id, one.n_convs)
            above.n_children += 1
            above.n_leaves += one.n_leaves
            above.saved += one.saved
    return [
        (k, one.conv_id, known.depths[k], None if k == 0 else nodes[known.parents[k]].conv_id, one.n_convs, one.n_children, one.n_leaves, one.saved)
        for k, one in enumerate(nodes) if one.n_convs
    ]


def digested_ends(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256 of the skeleton nodes at which conversations end; pieces pass through in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for batch in batches:
            done = []
            for node, text in zip(batch["node"].tolist(), batch["ends"]):
                if node != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = node, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(at, digest.hexdigest())], columns=["node", "ends_sha256"])

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(n, "node").sortWithinPartitions("node", "shard", "piece").mapInPandas(run, "node int, ends_sha256 string")


def trie(pathed: DataFrame, shards: int | None = None, ends_chars: int = ENDS_CHARS) -> DataFrame:
    """One row per node of the trie over ``pathed`` (conv_id, path, words), see :func:`paths`."""
    spark = pathed.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pathed = stored(pathed, "trie-paths")
    known = skeleton(pathed, shards)
    parts = walked(pathed, known, shards, ends_chars)
    partial = parts.where("node IS NOT NULL AND ends IS NULL").groupBy("node").agg(
        F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("words")
    )
    # at most SKELETON rows
    rows = rolled_up([tuple(r) for r in partial.collect()], known)
    schema = "node int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"
    upper = spark.createDataFrame(rows, schema)
    named = F.broadcast(upper.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("_above")))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    lower = parts.where("depth IS NOT NULL").join(named, "parent_node", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    ends = digested_ends(parts.where("ends IS NOT NULL").select("node", "shard", "piece", "ends"))
    upper = upper.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    return lower.select(*out).unionByName(upper.select(*out))


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text)."""
    return trie(paths(rebuilt(conversations(rows))))
