"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector is scaled to length one, rotated by a random orthogonal matrix and stored as the signs of its coordinates,
packed into bits, with two scalars: what turns the code's inner product with a rotated query into an unbiased estimate,
and how far the estimate may be off. Queries meet all codes block by block. In a block the best estimates are computed
exactly first; every vector whose estimate plus error bound reaches the k-th of those is then computed exactly too.

Defined cases: vectors that are null, empty or zero, or hold a null or a number that is not finite, and rows without an id
take no part; a query meets all other rows of its vector's length, each length having codes of its own; rows that share an
id are rows of their own, and only those that repeat the vector too stand once; equal scores go to the smaller id; a
query with fewer candidates than k gets them all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geneweft.llm.registry import stored

#: Width of the error bound in standard deviations of the estimate.
WIDTH = 2.5
ROWS, QUERIES, FIRST = 8192, 1024, 64


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@functools.lru_cache(maxsize=4)
def rotation(size: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def codes(vectors: np.ndarray, turn: np.ndarray, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, scale of the estimate, error bound for a query of length one) of every vector."""
    size = vectors.shape[1]
    length = np.linalg.norm(vectors, axis=1)
    turned = vectors @ turn.T / length[:, None]
    kept = np.abs(turned).sum(axis=1) / math.sqrt(size)
    error = length * np.sqrt(np.maximum(0.0, 1 - kept**2)) / kept * width / math.sqrt(max(1, size - 1))
    return np.packbits(turned > 0, axis=1), length / kept / math.sqrt(size), error


def index(vectors: DataFrame) -> DataFrame:
    """vec_id, size, code, scale, error, vector (packed doubles) of every row of ``vectors`` (vec_id, embedding)."""
    columns = ["vec_id", "size", "code", "scale", "error", "vector"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, rows in batch.groupby(batch["embedding"].map(len)):
                x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
                bits, scale, error = codes(x, rotation(size))
                made = (rows["vec_id"].to_numpy(), size, [b.tobytes() for b in bits], scale, error, [v.tobytes() for v in x])
                yield pd.DataFrame(dict(zip(columns, made)))

    return vectors.select("vec_id", "embedding").mapInPandas(
        run, "vec_id bigint, size int, code binary, scale double, error double, vector binary"
    )


def block_search(queries: np.ndarray, keys: np.ndarray, rows: dict, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions, scores): at least the k best rows of a block for each query, ties at the k-th included.

    ``rows``: keys (a query is not its own neighbour), ids, signs (of the codes, one or minus one), scale, error, vectors.
    """
    estimate = (queries @ turn.T).astype(np.float32) @ rows["signs"].T
    estimate *= rows["scale"].astype(np.float32)
    lengths = np.linalg.norm(queries, axis=1)
    for i, query in enumerate(queries):
        guess = estimate[i]
        other = rows["keys"] != keys[i]
        guess[~other] = -np.inf
        exact = lambda at: (rows["vectors"][at] * query).sum(axis=1)  # noqa: B023, E731
        if np.count_nonzero(other) > k:
            first = np.argpartition(guess, -min(FIRST, len(guess)))[-min(FIRST, len(guess)) :]
            first = first[other[first]]
            known = np.sort(exact(first))
            least = known[-k] if len(known) >= k else -np.inf
            at = np.flatnonzero(guess + lengths[i] * rows["error"] >= least)
        else:
            at = np.flatnonzero(other)
        scores = exact(at)
        if len(at) > k:
            cut = np.partition(scores, -k)[-k]
            at, scores = at[scores >= cut], scores[scores >= cut]
            best = np.lexsort((rows["ids"][at], -scores))[:k]
            at, scores = at[best], scores[best]
        yield i, at, scores


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every row where ``is_query`` holds, the ``k`` largest inner products."""
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    whole = good.dropDuplicates(["vec_id", "embedding"])
    rows = stored(index(whole).withColumn("key", F.monotonically_increasing_id()), "neighbour-codes")
    asked = rows.where(is_query)
    # vectors meet those of their own length, in blocks
    counts = rows.groupBy("size").agg(F.count(F.lit(1)).alias("rows")).join(asked.groupBy("size").agg(F.count(F.lit(1)).alias("asked")), "size")
    parts = lambda count, most: F.ceil(F.col(count) / most).cast("int").alias
    sizes = stored(counts.select("size", parts("rows", ROWS)("blocks"), parts("asked", QUERIES)("chunks")), "neighbour-sizes")
    part = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = rows.join(sizes, "size").withColumn("block", part("blocks")).withColumn("chunk", every("chunks"))
    ask = asked.join(sizes, "size").withColumn("chunk", part("chunks")).withColumn("block", every("blocks"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            size = int(right["size"].iloc[0])
            vectors_of = lambda frame: np.frombuffer(b"".join(frame["vector"]), dtype=np.float64).reshape(len(frame), -1)
            bits = np.unpackbits(np.frombuffer(b"".join(right["code"]), dtype=np.uint8).reshape(len(right), -1), axis=1, count=size)
            block = {
                "keys": right["key"].to_numpy(), "ids": right["vec_id"].to_numpy(), "signs": bits.astype(np.float32) * 2 - 1,
                "scale": right["scale"].to_numpy(), "error": right["error"].to_numpy(), "vectors": vectors_of(right),
            }
            keys, ids = left["key"].to_numpy(), left["vec_id"].to_numpy()
            for i, at, scores in block_search(vectors_of(left), keys, block, rotation(size), k):
                out["query"].append(np.full(len(at), keys[i]))
                out["query_id"].append(np.full(len(at), ids[i]))
                out["vec_id"].append(block["ids"][at])
                out["score"].append(scores)
        kinds = {"query": np.int64, "query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, kinds[c]) for c, v in out.items()})

    pair, keep = ["size", "block", "chunk"], ["size", "block", "chunk", "key", "vec_id", "vector"]
    # names of its own for the left side, as both come from the same rows
    found = ask.select(*keep).toDF(*keep).groupBy(*pair).cogroup(data.select(*keep, "code", "scale", "error").groupBy(*pair)).applyInPandas(
        run, "query bigint, query_id bigint, vec_id bigint, score double"
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
