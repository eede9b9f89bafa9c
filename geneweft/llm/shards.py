"""Sharding by vector bin packing.

Rows of equal text are a group with three sizes: bytes, words and rows. A group goes where the dot product of its sizes
with what is left of a bin's capacity is largest, each size measured as a share of its total; that bin is the one whose
squared load grows least, so bytes, words and rows are balanced jointly.

Packing runs in two steps of the same rule. Groups are dealt into ``BUCKETS`` buckets by their digest, and every bucket packs
its groups, largest first, into ``BUNDLES`` bundles in one pass over sorted rows. The bundles, a number that does not grow
with the data, are then packed into the shards. A group with more than 1/``PIECES`` of any total is cut into pieces of about that
size first, so that no group is larger than a shard can take; the pieces are placed like groups.

Defined cases: a null text counts as an empty one, has size 1 and forms a group with the empty texts; repeated rows and
repeated or null ids are rows of their own; ties go to the lower shard; an empty table gives an empty result; other columns are
kept, and those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geneweft.llm.registry import stored
from geneweft.operators.skew import index_points

BUCKETS, BUNDLES, PIECES = 512, 32, 1024
WORD = r"[^\x20\x09-\x0D]+"
SIZES = ["size", "words", "rows"]


class Packer:
    """Bins of equal capacity; sizes and capacities are shares of the totals."""

    def __init__(self, capacity: np.ndarray, bins: int):
        self.left = np.tile(capacity, (bins, 1))

    def place(self, sizes: np.ndarray) -> int:
        at = int(np.argmax(self.left @ sizes))
        self.left[at] -= sizes
        return at


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with size (UTF-8 bytes and one), words and text_crc32 of the text, and the digest of its group."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "size": (F.octet_length(text) + 1).cast("long"), "words": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")), "_group": F.unhex(F.sha2(text, 256)),
    })


def pieces(rows: DataFrame, totals) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the piece of their group, one row of sizes per piece).

    Groups are summed before they move; the few that are too large are cut by the number of the stored row.
    """
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")), "shard-groups")
    share = F.greatest(*[F.col(c) / F.lit(max(1, totals[c])) for c in SIZES])
    large = groups.withColumn("_ways", F.ceil(share * PIECES).cast("int")).where("_ways > 1 AND rows > 1")
    # at most 3 * PIECES groups hold more than 1 / PIECES of a total
    ways = F.broadcast(large.select("_group", "_ways"))
    piece = F.when(F.col("_ways").isNotNull(), F.pmod(F.xxhash64("_at"), F.col("_ways"))).otherwise(F.lit(0)).cast("int")
    rows = rows.join(ways, "_group", "left").withColumn("_piece", piece).drop("_ways")
    cut = rows.join(ways, "_group", "left_semi").groupBy("_group", "_piece").agg(
        F.sum("size").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")
    )
    small = groups.join(ways, "_group", "left_anti").withColumn("_piece", F.lit(0))
    return rows, small.unionByName(cut)


def bundles(units: DataFrame, totals) -> DataFrame:
    """``units`` (_group, _piece, sizes) with bucket and bundle."""
    scale = np.array([1 / max(1, totals[c]) for c in SIZES])
    units = stored(units.withColumn("_bucket", F.pmod(F.xxhash64("_group", "_piece"), F.lit(BUCKETS)).cast("int")), "shard-units")
    # BUCKETS rows at most
    held = {r["_bucket"]: np.array([r[c] for c in SIZES]) * scale for r in units.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in SIZES]).collect()}
    weight = sum(F.col(c) * F.lit(float(s)) for c, s in zip(SIZES, scale))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, packer = None, None
        for batch in batches:
            placed, sizes = [], batch[SIZES].to_numpy() * scale
            for bucket, one in zip(batch["_bucket"].tolist(), sizes):
                if bucket != at:
                    at, packer = bucket, Packer(held[bucket] / BUNDLES, BUNDLES)
                placed.append(packer.place(one))
            yield batch.assign(_bundle=np.array(placed, dtype="int32"))

    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = units.repartition(min(n, BUCKETS), "_bucket").sortWithinPartitions("_bucket", weight.desc(), "_group", "_piece")
    return stored(ordered.mapInPandas(run, f"{units._jdf.schema().toDDL()}, _bundle int"), "shard-bundles")


def shard_of_bundles(bundled: DataFrame, totals, shards: int) -> list[tuple[int, int, int]]:
    """(bucket, bundle, shard): at most BUCKETS * BUNDLES bundles, packed largest first."""
    scale = np.array([1 / max(1, totals[c]) for c in SIZES])
    rows = bundled.groupBy("_bucket", "_bundle").agg(*[F.sum(c).alias(c) for c in SIZES]).collect()
    packer = Packer(np.array([totals[c] for c in SIZES]) * scale / shards, shards)
    sized = sorted(((np.array([r[c] for c in SIZES]) * scale, r["_bucket"], r["_bundle"]) for r in rows), key=lambda x: (-x[0].sum(), x[1], x[2]))
    return [(bucket, bundle, packer.place(one)) for one, bucket, bundle in sized]


def shard(rows: DataFrame, shards: int = 16) -> DataFrame:
    """``rows`` (see :func:`measured`) with shard (from 0) and slot (gapless from 0 inside a shard)."""
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("shard", "slot", "_group", "words")]
    rows = stored(rows.select(*kept, "words", "_group", F.monotonically_increasing_id().alias("_at")), "shard-rows")
    totals = rows.agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows")).first().asDict()
    totals = {k: v or 0 for k, v in totals.items()}
    rows, units = pieces(rows, totals)
    bundled = bundles(units, totals)
    placed = F.broadcast(spark.createDataFrame(shard_of_bundles(bundled, totals, shards), "_bucket int, _bundle int, shard int"))
    where = bundled.join(placed, ["_bucket", "_bundle"]).select("_group", "_piece", "shard")
    placed_rows = rows.join(where, ["_group", "_piece"]).select(*kept, "_at", "shard")
    return index_points(placed_rows, ["shard"], ["_at"], seq="slot", length=None).select(*kept, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows by slot in files of bounded size."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
