"""Document fingerprints from statistically improbable byte windows.

Every window of 64 bytes has an entropy; how many windows of the corpus share its level says how improbable it is. In
each run of 64 neighbouring windows the most improbable one, the leftmost of equals, gets a vote, and windows with
``VOTES`` votes or more are a document's features. Their hashes go into a chain of Bloom filters of 2,048 bits, a new
filter after each ``PER_FILTER`` distinct features. Two chains are compared by the overlap of their filters beyond
chance: every filter of the shorter chain takes its best partner in the other.

Defined cases: a null text is empty; an empty text has an empty chain; a text without a usable window (under 64 bytes,
or without variety) has one feature, the whole text; two empty chains are alike (1.0), one empty chain is like nothing
(0.0); equal texts have equal fingerprints. Documents go by descending id, null ids last, equal ids by text; the one
after the last is the first, which may be the document itself. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geneweft.llm.textblocks import BLOCK_BYTES, blocks, mix

WINDOW, RUN, VOTES = 64, 64, 16
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
LEVELS = 1001
#: Windows under this level repeat one byte or two and say nothing.
PLAIN = 100
TILE = 1 << 17
_SCALE = 1 << 16
_STEP = np.round(_SCALE * np.diff(np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 2)]))).astype(np.int64)


def neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, how many of the 63 bytes before and of the 63 after it are equal to it."""
    before, after = np.zeros(len(x), dtype=np.uint8), np.zeros(len(x), dtype=np.uint8)
    for start in range(0, len(x), TILE):
        stop = min(len(x), start + TILE)
        for gap in range(1, min(WINDOW, len(x))):
            low = max(start, gap)
            if low >= stop:
                break
            same = (x[low:stop] == x[low - gap : stop - gap]).view(np.uint8)
            before[low:stop] += same
            after[low - gap : stop - gap] += same
    return before, after


def window_levels(x: np.ndarray) -> np.ndarray:
    """Entropy level, 0 to 1000, of the window that starts at each byte; the last 63 starts have none."""
    before, after = neighbours(x)
    # sum of c log c over a window that grows from nothing and then slides: what enters adds, what leaves takes away
    change = _STEP[before]
    change[: WINDOW - 1] = 0
    first = np.bincount(x[: WINDOW - 1], minlength=256)
    start = int(sum(_STEP[:c].sum() for c in first))
    change[WINDOW:] -= _STEP[after[: len(x) - WINDOW]]
    total = start + np.cumsum(change)[WINDOW - 1 :]
    entropy = _SCALE * WINDOW * 6 - total
    return np.clip(entropy * (LEVELS - 1) // (_SCALE * WINDOW * 6), 0, LEVELS - 1)


def laid_out(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte and number of windows of every text); texts lie so far apart that no run sees two of them."""
    sizes = np.array([len(b) for b in held])
    starts = RUN + np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    data = np.frombuffer(b"\0" * RUN + b"".join(held) + b"\0" * (RUN + WINDOW), dtype=np.uint8)
    return data, starts, np.maximum(sizes - WINDOW + 1, 0)


def usable(levels: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(levels) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + windows, -1)
    return np.cumsum(inside[:-1]).astype(bool) & (levels >= PLAIN)


def level_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of the corpus have each level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for _, held in blocks(batch["text"]):
                data, starts, windows = laid_out(held)
                levels = window_levels(data)
                counts += np.bincount(levels[usable(levels, starts, windows)], minlength=LEVELS)
        yield pd.DataFrame({"level": np.arange(LEVELS), "n": counts})

    found = docs.select("text").mapInPandas(run, "level int, n bigint").groupBy("level").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(LEVELS, dtype=np.int64)
    counts[found["level"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def ranks(counts: np.ndarray) -> np.ndarray:
    """Place of every level from the rarest to the most common."""
    place = np.empty(LEVELS, dtype=np.int32)
    place[np.argsort(counts, kind="stable")] = np.arange(LEVELS, dtype=np.int32)
    return place


def chains(held: list[bytes], rank: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(number of features, filters as rows of 64-bit words) of every text."""
    data, starts, windows = laid_out(held)
    levels = window_levels(data)
    good = usable(levels, starts, windows)
    bits = int(len(levels)).bit_length()
    kind = np.int32 if bits + 10 <= 31 else np.int64
    key = np.where(good, rank[levels].astype(kind) << kind(bits), np.iinfo(kind).max >> bits << bits) | np.arange(len(levels), dtype=kind)
    least = key
    width = 1
    while width < RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    votes = np.bincount(least & kind((1 << bits) - 1), minlength=len(levels))
    chosen = np.flatnonzero((votes >= VOTES) & good)
    parts = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[chosen].view(np.uint64) if len(chosen) else np.zeros((0, 8), np.uint64)
    with np.errstate(over="ignore"):
        hashes = np.zeros(len(chosen), dtype=np.uint64)
        for column in parts.T:
            hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + column)
    cuts = np.searchsorted(chosen, np.append(starts, len(levels)))
    out = []
    for i, raw in enumerate(held):
        own = hashes[cuts[i] : cuts[i + 1]]
        if len(own) > 1:
            own = own[np.sort(np.unique(own, return_index=True)[1])]
        elif not len(own) and raw:
            own = np.frombuffer(hashlib.sha256(raw).digest()[:8], dtype="<u8")
        filters = np.zeros((-(-len(own) // PER_FILTER), FILTER_BITS), dtype=bool)
        row = np.arange(len(own)) // PER_FILTER
        for k in range(HASHES):
            filters[row, (own >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
        out.append((len(own), np.packbits(filters, axis=1).view(np.uint64)))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: overlap of the filters beyond chance, each of the shorter chain with its best partner."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    best = np.zeros(len(a))
    step = max(1, (1 << 18) // len(b))
    for i in range(0, len(a), step):
        shared = np.bitwise_count(a[i : i + step, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
        fewer = np.minimum(na[i : i + step, None], nb[None, :])
        chance = na[i : i + step, None] * nb[None, :] / FILTER_BITS
        floor = chance + 0.3 * (fewer - chance)
        score = np.where(fewer > floor, (shared - floor) / np.maximum(fewer - floor, 1e-9), shared == fewer)
        best[i : i + step] = np.clip(score, 0, 1).max(axis=1)
    return float((best * na).sum() / na.sum())


def written(chain: tuple[int, np.ndarray]) -> str:
    """The fingerprint as text: number of features and the filters."""
    return f"{chain[0]}:{base64.b64encode(chain[1].tobytes()).decode()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    count, _, packed = fingerprint.partition(":")
    return int(count), np.frombuffer(base64.b64decode(packed), dtype=np.uint64).reshape(-1, FILTER_BITS // 64)


def fingerprints(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id, fingerprint of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [written(c) for _, held in blocks(batch["text"]) for c in chains(held, shared.value)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fingerprint": made})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, fingerprint string")


def with_following(docs: DataFrame) -> DataFrame:
    """bucket, extra, doc_id, text: documents dealt by id, and in each bucket one extra copy of the row after its last.

    Buckets are ranges of ids found by quantiles; only the ids and one id per bucket reach the driver.
    """
    spark = docs.sparkSession
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    found = ids.approxQuantile("id", [i / wanted for i in range(1, wanted)], 0.25 / wanted) if wanted > 1 else []
    splits = [-float("inf"), *(sorted(set(found)) or [0.0]), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="id", outputCol="range", handleInvalid="keep")

    def dealt(df: DataFrame) -> DataFrame:
        last = len(splits) - 1
        place = F.when(F.col("doc_id").isNull(), last).otherwise(last - 1 - F.col("range"))
        return bucketizer.transform(df.withColumn("id", F.col("doc_id").cast("double"))).withColumn("bucket", place.cast("int"))

    tops = sorted((r["bucket"], r["top"]) for r in dealt(docs.select("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    follows = [(tops[(i + 1) % len(tops)][1], bucket) for i, (bucket, _) in enumerate(tops)]
    # one row per bucket
    extra = F.broadcast(spark.createDataFrame(follows, "top bigint, into int").groupBy("top").agg(F.collect_list("into").alias("into")))
    rows = dealt(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).join(extra, F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own = F.array(F.struct(F.col("bucket"), F.lit(0).alias("extra")))
    more = F.transform(F.coalesce("into", F.array().cast("array<int>")), lambda b: F.struct(b.alias("bucket"), F.lit(1).alias("extra")))
    return rows.select(F.explode(F.concat(own, more)).alias("at"), "doc_id", "text").select("at.bucket", "at.extra", "doc_id", "text")


def compare_edited(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A text is edited by putting the head of the next document in place of its second half.
    """
    shared = docs.sparkSession.sparkContext.broadcast(rank)
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def finished(rows: list[tuple]) -> pd.DataFrame:
        """``rows``: (bucket, extra, doc_id, text); each but the last is finished where the next is of its bucket."""
        rank = shared.value
        made = [c for _, held in blocks([r[3] for r in rows]) for c in chains(held, rank)]
        todo = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        edited = []
        for i in todo:
            text, after = rows[i][3], rows[i + 1][3]
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        new = [c for _, held in blocks(edited) for c in chains(held, rank)]
        out = [
            (rows[i][2], len(rows[i][3]), hashlib.sha256(e.encode()).hexdigest(), written(made[i]), written(c),
             likeness(made[i][1], c[1]), likeness(made[i][1], made[i + 1][1]))
            for i, e, c in zip(todo, edited, new)
        ]
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])
        return frame.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for bucket, extra, doc, text in zip(batch["bucket"], batch["extra"], batch["doc_id"], batch["text"]):
                text = text or ""
                rows.append((bucket, extra, None if pd.isna(doc) else int(doc), text))
                size += len(text)
                if size > BLOCK_BYTES:
                    yield finished(rows)
                    rows, size = rows[-1:], len(text)
        if rows:
            yield finished(rows)

    order = ["bucket", "extra", F.col("doc_id").desc_nulls_last(), "text"]
    return with_following(docs).repartition("bucket").sortWithinPartitions(*order).mapInPandas(run, schema)
