"""Embedding, exact nearest neighbours and size-limited context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geneweft.config import COMPONENT_WORDS
from geneweft.functions.values import contains_any
from geneweft.operators.components import missing_documents, with_ids
from geneweft.session import stored

BLANK = " \n\r\t"
WORD = re.compile(r"\S+", re.ASCII)
RESULT = "query_id string, part_id string, distance double"
# Distances are compared at this resolution; ties go to the smaller id.
DECIMALS = 9
# Largest side of one block pair.
BLOCK_ROWS = 4096
# Numbers in the largest table of distances or of vectors that a task holds on its way.
STEP_NUMBERS = 1 << 20
# Bounds of the pivots, which the driver holds and every task gets.
CELLS, PIVOT_NUMBERS = 4096, 1 << 22


# --- embedding ---------------------------------------------------------------------------


def embed(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], text: str = "document", batch: int = 64) -> DataFrame:
    """Add ``embedding`` by calling ``fn`` on at most ``batch`` texts at a time, inside the tasks.

    No more than ``batch`` texts at a time are Python objects; the others stay in their Arrow batch.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                piece = whole.slice(start, batch)
                vectors = [np.asarray(v, dtype=np.float32) for v in fn(piece.column(text).to_pylist())]
                made = pa.array(vectors, pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*piece.columns, made], names=[*piece.schema.names, "embedding"])

    return df.mapInArrow(run, schema)


def hashing_embedder(dim: int = 64, cached_words: int = 1 << 16) -> Callable[[list[str]], list[np.ndarray]]:
    """An embedder that counts words by hash bucket: deterministic, needs no service, for tests and offline use."""
    known: dict[str, int] = {}

    def bucket(word: str) -> int:
        found = known.get(word)
        if found is None:
            if len(known) >= cached_words:
                known.clear()
            found = known[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim
        return found

    def counts(text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        return np.bincount(np.fromiter(map(bucket, words), dtype=np.int64, count=len(words)), minlength=dim)

    return lambda texts: [counts(t) for t in texts]


def hash_embed(df: DataFrame, text: str = "document", dim: int = 64) -> DataFrame:
    """Add the hashed word counts of a text as its embedding."""
    return embed(df, hashing_embedder(dim), text)


def build_index(new: DataFrame, index: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows to append to an index: only documents it lacks are embedded."""
    return embedder(missing_documents(with_ids(new), index))


# --- nearest neighbours ------------------------------------------------------------------


def _distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    dots = queries @ vectors.T
    q2 = np.einsum("ij,ij->i", queries, queries)
    v2 = np.einsum("ij,ij->i", vectors, vectors)
    if metric == "l2sq":
        return np.round(np.maximum(q2[:, None] + v2[None, :] - 2.0 * dots, 0.0), DECIMALS)
    norms = np.sqrt(q2)[:, None] * np.sqrt(v2)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.round(np.where(norms > 0, 1.0 - dots / norms, 1.0), DECIMALS)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64)


def _k_smallest(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k smallest entries of every row, ties by column, without sorting whole rows."""
    if dist.shape[1] > k:
        bound = np.partition(dist, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(dist <= bound[:, None])
    else:
        rows, cols = (a.ravel() for a in np.indices(dist.shape))
    order = np.lexsort((cols, dist[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], cols[place < k]


def _nearest(qids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str) -> pd.DataFrame:
    """The k nearest of one block of vectors for every query, ties by id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    out = []
    step = max(1, 2_000_000 // max(1, len(ids)))
    for start in range(0, len(qids), step):
        dist = _distances(queries[start : start + step], vectors, metric)
        rows, cols = _k_smallest(dist, k)
        out.append(
            pd.DataFrame({"query_id": qids[start + rows], "part_id": ids[cols], "distance": dist[rows, cols]})
        )
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "part_id": [], "distance": []})


def _rank(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "part_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class CellIndex:
    """Index rows clustered by cell, and the cells.

    rows: (cell, block, part_id, embedding), a block holding about :data:`BLOCK_ROWS` rows; cells: (cell, pivot,
    radius, n, blocks), at most :data:`CELLS` rows. A row's cell is that of the nearest pivot, and the radius is
    the largest distance of a row from its pivot, both in the space in which the metric is a length.
    """

    rows: DataFrame
    cells: DataFrame
    metric: str

    def write(self, path: str) -> None:
        self.rows.write.parquet(f"{path}/rows")
        self.cells.withColumn("metric", F.lit(self.metric)).write.parquet(f"{path}/cells")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> CellIndex:
        cells = spark.read.parquet(f"{path}/cells")
        found = cells.select("metric").limit(1).collect()
        return cls(spark.read.parquet(f"{path}/rows"), cells.drop("metric"), found[0]["metric"] if found else "l2sq")


def _placed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Vectors where the metric is a length: as they are, or of length one for the cosine; zero stays zero."""
    if metric == "l2sq":
        return vectors
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` from all rows of ``b``."""
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def cell_index(index: DataFrame, metric: str = "l2sq", cells: int | None = None) -> CellIndex:
    """Cluster (part_id, embedding) by cells around pivots that a hash of the id draws from the rows.

    Without ``cells`` there are about as many cells as rows in a cell, at most :data:`CELLS` and
    :data:`PIVOT_NUMBERS` numbers in all pivots together; only the pivots pass through the driver. Under the cosine, zero
    vectors have a cell of their own. Rows without a vector are left out.
    """
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = index.select(F.col("part_id").cast("string").alias("part_id"), "embedding").where("embedding is not null")
    size, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    wanted = min(cells or max(1, int(size**0.5)), CELLS, max(1, PIVOT_NUMBERS // (dim or 1)))
    drawn = rows.select("embedding").orderBy(F.xxhash64("part_id"), "part_id").limit(wanted).collect()
    pivots = _placed(np.array([r["embedding"] for r in drawn], dtype=np.float64).reshape(len(drawn), dim or 0), metric)
    shared = index.sparkSession.sparkContext.broadcast(pivots)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            step = max(1, STEP_NUMBERS // len(shared.value))
            for start in range(0, len(frame), step):
                part = frame.iloc[start : start + step]
                vectors = _placed(_matrix(part["embedding"]), metric)
                far = _lengths(vectors, shared.value)
                cell = far.argmin(axis=1)
                away = np.linalg.norm(vectors - shared.value[cell], axis=1)
                if metric == "cosine":
                    zero = ~vectors.any(axis=1)
                    cell, away = np.where(zero, -1, cell), np.where(zero, 0.0, away)
                yield part.assign(cell=cell.astype(np.int32), away=away)

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    assigned = stored(rows.mapInPandas(assign, schema), "assigned")
    sizes = stored(assigned.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")), "cell-sizes")
    at = index.sparkSession.createDataFrame(
        [(-1, [0.0] * (dim or 0)), *((c, p.tolist()) for c, p in enumerate(pivots))], "cell int, pivot array<double>"
    )
    # at most CELLS rows and one on the right
    known = sizes.join(F.broadcast(at), "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    block = F.pmod(F.xxhash64("part_id"), F.col("blocks").cast("long")).cast("int")
    clustered = assigned.drop("away").join(F.broadcast(known.select("cell", "blocks")), "cell").withColumn("block", block)
    clustered = clustered.select("cell", "block", "part_id", "embedding").repartitionByRange("cell", "block").sortWithinPartitions("cell", "block")
    return CellIndex(stored(clustered, "cells"), known.select("cell", "pivot", "radius", "n", "blocks"), metric)


def _visits(queries: DataFrame, index: CellIndex, k: int, reach: bool) -> DataFrame:
    """(query_id, embedding, cell) of the cells to be read for every query.

    First the nearest cells that hold k rows together; then, with ``reach`` (the query's k-th distance so far, infinite
    where it has fewer), the others that the triangle inequality does not rule out.
    """
    metric = index.metric
    cells = index.cells.orderBy("cell").collect()  # at most CELLS rows and one
    pivots = np.array([r["pivot"] for r in cells], dtype=np.float64)
    numbers, radius, n = np.array([r["cell"] for r in cells]), np.array([r["radius"] for r in cells]), np.array([r["n"] for r in cells])
    shared = queries.sparkSession.sparkContext.broadcast((pivots, numbers, radius, n))

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, numbers, radius, n = shared.value
        for frame in frames:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                vectors = _placed(_matrix(part["embedding"]), metric)
                far = _lengths(vectors, pivots)
                order = far.argsort(axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                first = np.zeros(far.shape, dtype=bool)
                np.put_along_axis(first, order, before < k, axis=1)
                chosen = first
                if reach:
                    # the squared length is the metric, or twice the cosine distance; the margin covers rounding
                    bound = part["reach"].to_numpy(dtype=np.float64) * (1 if metric == "l2sq" else 2)
                    nearest = far - radius[None, :]
                    chosen = ~first & (nearest * (1 - 1e-6) - 1e-6 <= np.sqrt(bound)[:, None])
                    if metric == "cosine":
                        chosen |= ~first & ((numbers == -1)[None, :] | ~vectors.any(axis=1)[:, None])
                rows, cols = np.nonzero(chosen)
                ids, embeddings = part["query_id"].to_numpy(), part["embedding"].to_numpy()
                # every visit carries its vector, so that a query of many cells is many times as large as its row
                step = max(1, STEP_NUMBERS // max(1, vectors.shape[1]))
                for at in range(0, len(rows), step):
                    r, c = rows[at : at + step], cols[at : at + step]
                    yield pd.DataFrame({"query_id": ids[r], "embedding": embeddings[r], "cell": numbers[c].astype(np.int32)})

    return queries.mapInPandas(visit, "query_id string, embedding array<double>, cell int")


def _meet(visits: DataFrame, index: CellIndex, k: int, n_q: int) -> DataFrame:
    """The k best of every (query, block of a visited cell); blocks go only where a query asks for them."""
    blocks = F.broadcast(index.cells.select("cell", "blocks"))
    left = visits.join(blocks, "cell").select(
        "query_id", "embedding", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("part"),
    )
    asked_for = left.select("cell", "block", F.col("part").alias("asking")).distinct()
    right = index.rows.join(asked_for, ["cell", "block"])
    metric = index.metric

    def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "part_id": [], "distance": []})
        return _nearest(q["query_id"].to_numpy(), _matrix(q["embedding"]), v["part_id"].to_numpy(), _matrix(v["embedding"]), k, metric)

    return left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "asking")).applyInPandas(pair, RESULT)


def _block_pairs(queries: DataFrame, index: DataFrame, k: int, metric: str, n_q: int, n_i: int) -> DataFrame:
    """Both sides cut into blocks of bounded size; each pair of blocks is one group that returns only its k best."""
    q_block = F.pmod(F.xxhash64("query_id"), F.lit(n_q))
    i_block = F.pmod(F.xxhash64("part_id"), F.lit(n_i))
    left = queries.withColumn("qb", q_block).withColumn("ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_i - 1).cast("long"))))
    right = index.withColumn("ib", i_block).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def pair(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "part_id": [], "distance": []})
        return _nearest(
            q["query_id"].to_numpy(), _matrix(q["embedding"]), v["part_id"].to_numpy(), _matrix(v["embedding"]), k, metric
        )

    return left.groupBy("qb", "ib").cogroup(right.groupBy("qb", "ib")).applyInPandas(pair, RESULT)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias(key), "embedding").where("embedding is not null")


def knn_join(
    queries: DataFrame, index: DataFrame | CellIndex, k: int = 5, metric: str = "l2sq", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The k nearest index rows of every query, exact: (query_id, part_id, distance, rank).

    queries: (query_id, embedding). Queries and rows meet in blocks of bounded size, at every number of queries, and a
    pair of blocks returns no more than k rows per query. A plain index (part_id, embedding) is read as a whole. A stored
    :class:`CellIndex`, whose metric counts, is pruned, see :func:`pruned_join`.
    """
    if isinstance(index, CellIndex):
        return pruned_join(queries, index, k)
    if metric not in ("l2sq", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    q, i = stored(_keyed(queries, "query_id"), "queries"), _keyed(index, "part_id")
    n_q, n_i = -(-q.count() // block_rows), -(-i.count() // block_rows)
    if k <= 0 or not n_q or not n_i:
        return queries.sparkSession.createDataFrame([], RESULT + ", rank int")
    return _rank(_block_pairs(q, i, k, metric, n_q, n_i), k)


def pruned_join(queries: DataFrame, index: CellIndex, k: int = 5) -> DataFrame:
    """As :func:`knn_join`, reading only the cells that can hold one of the k nearest.

    A query first meets its nearest cells; its k-th distance there rules out every cell whose pivot is farther away
    than that distance and the cell's radius together.
    """
    q = stored(_keyed(queries, "query_id").withColumn("embedding", F.col("embedding").cast("array<double>")), "queries")
    n_q = -(-q.count() // BLOCK_ROWS)
    if k <= 0 or not n_q or not index.cells.limit(1).count():
        return queries.sparkSession.createDataFrame([], RESULT + ", rank int")
    near = stored(_rank(_meet(_visits(q, index, k, False), index, k, n_q), k), "near")
    further = _meet(_visits(_reached(q, near, k), index, k, True), index, k, n_q)
    return _rank(near.drop("rank").unionByName(further), k)


def _reached(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Queries with their k-th distance so far, infinite where there are fewer rows."""
    reach = found.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("distance").alias("reach"))
    joined = queries.distinct().join(reach, F.col("query_id") == F.col("_q"), "left")
    return joined.select("query_id", "embedding", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))


def cells_read(queries: DataFrame, index: CellIndex, k: int = 5) -> DataFrame:
    """query_id, first, further, cells: how many cells a search reads for every query, out of how many."""
    q = _keyed(queries, "query_id").withColumn("embedding", F.col("embedding").cast("array<double>"))
    reached = _reached(q, pruned_join(queries, index, k), k)
    count = lambda visits, name: visits.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    first, further = count(_visits(q.distinct(), index, k, False), "first"), count(_visits(reached, index, k, True), "further")
    total = F.lit(index.cells.count()).alias("cells")
    return first.join(further, "query_id", "left").select("query_id", "first", F.coalesce("further", F.lit(0)).alias("further"), total)


def asked(queries: DataFrame) -> DataFrame:
    """Queries that are not blank, where they carry their text."""
    if "text" not in queries.columns:
        return queries
    return queries.where(F.trim(F.col("text"), F.lit(BLANK)) != "")


def search(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    metric: str = "l2sq",
    exclude: tuple[str, object] | None = None,
) -> DataFrame:
    """k nearest documents of every non-blank query; ``exclude`` is a (column, value) left out before the search."""
    if exclude is not None:
        index = exclude_experiment(index, exclude[1], exclude[0])
    return knn_join(asked(queries), index, k, metric)


def exclude_experiment(df: DataFrame, experiment: object, column: str = "experiment_id") -> DataFrame:
    """Rows of other experiments, and rows without one; applied before any top-k."""
    return df.where(~F.col(column).eqNullSafe(F.lit(experiment)))


# --- context -----------------------------------------------------------------------------


def keyword_filter(
    df: DataFrame,
    key: str = "query_id",
    text: str = "text",
    words: tuple[str, ...] = COMPONENT_WORDS,
    few_per_query: bool = False,
) -> DataFrame:
    """Texts with any of the words; a query for which none is left keeps all its texts.

    The queries with a hit are found by an aggregation that shrinks before its shuffle, and
    only rows without a hit are joined against them. Where a query has few rows, as after a
    top-k search, ``few_per_query`` looks at them in one window and reads the input once.
    """
    flagged = df.withColumn("_hit", F.coalesce(contains_any(F.col(text), words), F.lit(False)))
    if few_per_query:
        any_hit = F.max("_hit").over(Window.partitionBy(key))
        return flagged.withColumn("_any", any_hit).where("_hit or not _any").drop("_hit", "_any")
    hits = flagged.where("_hit")
    answered = hits.select(key).distinct()
    rest = flagged.where("not _hit").join(answered, key, "left_anti")
    return hits.unionByName(rest).drop("_hit")


def dedup_ordered(df: DataFrame, key: str = "query_id", text: str = "text", rank: str = "rank") -> DataFrame:
    """First occurrence of every text per query, by rank; copies collapse before the shuffle."""
    return df.groupBy(key, text).agg(F.min(rank).alias(rank))


def budget(
    df: DataFrame,
    key: str = "query_id",
    text: str = "text",
    rank: str = "rank",
    max_items: int = 8,
    max_chars: int = 2400,
) -> DataFrame:
    """The first items whose lines ("- " and the item, one newline between) fit the character budget.

    The item limit comes first, so the running length is over ``max_items`` rows per query.
    """
    order = Window.partitionBy(key).orderBy(rank)
    length = F.length(F.col(text)) + 3
    running = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return (
        df.withColumn("_item", F.row_number().over(order))
        .where(F.col("_item") <= max_items)
        .withColumn("_chars", running)
        .where(F.col("_chars") <= max_chars)
        .withColumnsRenamed({"_item": "item", "_chars": "chars"})
    )


NO_RESULTS = "ERROR: no component was found"


def join_lines(kept: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """One context per query out of the few rows the budget leaves."""
    lines = F.array_sort(F.collect_list(F.struct("item", F.concat(F.lit("- "), F.col(text)).alias("line"))))
    return kept.groupBy(key).agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("context"))


def compact_context(
    results: DataFrame, max_items: int = 8, max_chars: int = 2400, few_per_query: bool = False
) -> DataFrame:
    """Filter, dedupe and fit search results (query_id, rank, text) into one context per query."""
    trimmed = results.withColumn("text", F.trim(F.col("text"), F.lit(BLANK))).where("text != ''")
    filtered = keyword_filter(trimmed, few_per_query=few_per_query)
    kept = budget(dedup_ordered(filtered), max_items=max_items, max_chars=max_chars)
    return join_lines(kept)


def retrieve_context(
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    metric: str = "l2sq",
    max_items: int = 8,
    max_chars: int = 2400,
) -> DataFrame:
    """Search, filter, dedupe and budget: one context per query, an error text where nothing is left.

    queries: (query_id, embedding[, text]); index: (part_id, document, embedding).
    """
    found = search(queries, index, k, metric)
    documents = index.select(F.col("part_id").cast("string").alias("part_id"), F.col("document").alias("text"))
    texts = documents.join(found, "part_id")
    contexts = compact_context(texts, max_items, max_chars, few_per_query=True)
    wanted = queries.select(F.col("query_id").cast("string").alias("query_id")).distinct()
    return wanted.join(contexts, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_RESULTS)))
