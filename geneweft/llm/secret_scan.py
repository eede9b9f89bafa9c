"""Secret scans with an incremental ledger of blobs.

A text is addressed by the SHA-256 of its content, so all copies and all earlier versions of a document are one blob.
The ledger stores which (blob, rule version) pairs were scanned and what they held. A scan takes the distinct blobs,
drops the pairs that the ledger knows, runs the remaining rules once per blob, appends to the ledger, and joins the
findings back to every document that holds the blob. A rule's version is a digest of its pattern and its limits; a
changed rule is scanned again, the others are not.

Defined cases: a null text is an empty one; repeated rows share a blob and each get its findings; an empty table gives
an empty result and an empty ledger; other columns are kept by :func:`redacted` and not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geneweft.session import scratch_path

#: Fixed values: (kind, pattern, group whose length counts, least length, lower-case strings of which a match holds one).
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
     ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    ("hex", r"[0-9a-f]+", 0, 24, ()),
)
MASK = "[SECRET]"


def rule_version(rule) -> str:
    return rule[0] + "@" + hashlib.sha256(repr(rule[1:4]).encode()).hexdigest()[:16]


def compiled(rule):
    """A function from a text and its lower case to spans."""
    kind, pattern, group, least, hints = rule
    if group == 0 and pattern.endswith("]+"):
        # one class to the end: a match that is long enough is the same one with its least length demanded
        lead = len(pattern[: pattern.index("[")])
        finder = re.compile(f"{pattern[:-1]}{{{least - lead},}}")
        spans = lambda text: [m.span() for m in finder.finditer(text)]
    else:
        finder = re.compile(pattern)
        spans = lambda text: [m.span() for m in finder.finditer(text) if len(m[group]) >= least]
    return lambda text, low: spans(text) if not hints or any(h in low for h in hints) else []


FOUND = "array<struct<version:string,kind:string,start:bigint,end:bigint>>"


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blob, versions, found: the spans of the asked rule versions in every blob (blob, text, versions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(rule_version(r), r[0], compiled(r)) for r in rules]
        for batch in batches:
            found = []
            for text, versions in zip(batch.column("text"), batch.column("versions")):
                text = text.as_py() or ""
                low, asked = text.lower(), set(versions.as_py())
                found.append([
                    {"version": v, "kind": kind, "start": a, "end": b}
                    for v, kind, find in finders if v in asked for a, b in find(text, low)
                ])
            row = pa.struct([("version", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("versions"), pa.array(found, pa.list_(row))], names=["blob", "versions", "found"]
            )

    return blobs.select("blob", "text", "versions").mapInArrow(run, f"blob binary, versions array<string>, found {FOUND}")


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark, ledger: str) -> DataFrame:
    """blob, versions, found as appended so far; empty before the first scan."""
    schema = f"blob binary, versions array<string>, found {FOUND}"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """blob, found for every blob of ``docs`` that holds a secret under ``rules``; the ledger learns what was new.

    Without a ledger a fresh one is begun in the shared scratch folder.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    current = F.array(*[F.lit(rule_version(r)) for r in rules])
    blobs = docs.select(blob_id(F.col("text")).alias("blob"), "text").dropDuplicates(["blob"])
    seen = read_ledger(spark, ledger).select(F.col("blob").alias("known"), F.explode("versions").alias("version"))
    seen = seen.groupBy("known").agg(F.collect_set("version").alias("seen"))
    todo = (
        blobs.join(seen, F.col("blob") == F.col("known"), "left")
        .select("blob", "text", F.array_except(current, F.coalesce("seen", F.array().cast("array<string>"))).alias("versions"))
        .where(F.size("versions") > 0)
    )
    scan_blobs(todo, rules).write.mode("append").parquet(ledger)
    wanted = F.filter("found", lambda x: F.array_contains(current, x["version"]))
    held = docs.select(blob_id(F.col("text")).alias("blob")).distinct()
    return (
        read_ledger(spark, ledger).select("blob", wanted.alias("found")).where(F.size("found") > 0)
        .join(held, "blob", "left_semi")
        .groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    )


def ordered_spans(found: Column, rules=RULES) -> Column:
    """Spans by start, then by kind in the order of the rules."""
    place = lambda kind: F.array_position(F.array(*[F.lit(r[0]) for r in rules]), kind)
    return F.array_sort(F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), place(x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind")
    )))


def findings(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """doc_id, spans (array of start, place, end, kind) for every row of ``docs``."""
    found = scan(docs, ledger, rules).select("blob", ordered_spans(F.col("found"), rules).alias("spans"))
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,place:bigint,end:bigint,kind:string>>")
    return paths.join(found, "blob", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redacted(docs: DataFrame, ledger: str | None = None, rules=RULES, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret replaced by ``mask`` and n_chars brought up to date where it is a column."""
    found = scan(docs, ledger, rules).select(F.col("blob").alias("_blob"), ordered_spans(F.col("found"), rules).alias("_spans"))
    # overlapping spans become one: a span starts a new piece if it starts after all ends so far
    merged = F.aggregate(
        "_spans", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(
                    F.try_element_at(acc, F.lit(-1))["start"].alias("start"),
                    F.greatest(F.try_element_at(acc, F.lit(-1))["end"], x["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    text = F.col("text")
    joined = docs.withColumn("_key", blob_id(text)).join(found, F.col("_key") == F.col("_blob"), "left").withColumn("_cut", merged)
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_cut", lambda x: x["end"]))
    starts = F.concat(F.transform("_cut", lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(ends, starts, lambda e, s: F.substr(text, (e + 1).cast("int"), (s - e).cast("int")))
    joined = joined.withColumn("text", F.when(F.col("_cut").isNull(), text).otherwise(F.array_join(kept, mask)))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])
