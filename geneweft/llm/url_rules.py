"""URL filters: fixed host and path rules, and association rules mined from what those rules label.

Urls that a fixed rule decides are labelled examples. FP-growth mines combinations of url tokens (host labels, path
segments, query keys) that go with ``block``; rules are kept by support and confidence and dropped where leaving out
one token gives a rule at least as sure. The rest of the urls meet the kept rules through an inverted index: a rule is
listed under its rarest token only, and a url is blocked when it holds all tokens of a rule.

Defined cases: a url that is null or lacks ``://`` has empty host and path and no tokens, so no rule fits and it is
allowed; repeated urls share a verdict; without labelled urls nothing is mined; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (verdict, host, path) of the fixed rules; the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.9
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PATTERN, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATTERN, 2), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fixed rule that fits, or null. ``rules`` is a short list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: ``h:`` host labels, ``p:`` path segments, ``q:`` keys of the query."""
    named = lambda kind, parts: F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(F.lit(kind), F.lower(t)))
    query = F.regexp_extract(F.regexp_extract(url, PATTERN, 3), r"^\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda t: F.substring_index(t, "=", 1))
    return F.coalesce(
        F.array_distinct(F.concat(named("h:", F.split(host(url), r"\.")), named("p:", F.split(path(url), "/")), named("q:", keys))),
        F.array().cast("array<string>"),
    )


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """tokens array<string>, confidence, support, key: pruned rules for ``block``, each with its rarest token as key.

    ``labelled`` has tokens and verdict, one row per example.
    """
    label = F.concat(F.lit("verdict:"), F.col("verdict"))
    examples = labelled.where(F.size("tokens") > 0).select(F.concat("tokens", F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(examples)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit("verdict:block"))).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support"
    )
    shorter = rules.where(F.size("tokens") > 1).select(
        "tokens", "confidence", F.explode("tokens").alias("out")
    ).select(F.col("tokens").alias("full"), F.col("confidence").alias("sure"), F.array_except("tokens", F.array("out")).alias("tokens"))
    weaker = rules.join(shorter, "tokens").where(F.col("confidence") >= F.col("sure")).select(F.col("full").alias("tokens")).distinct()
    kept = rules.join(weaker, "tokens", "left_anti")
    singles = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    listed = kept.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(singles, "token")
    rarest = Window.partitionBy("tokens").orderBy("freq", "token")
    return listed.withColumn("nth", F.row_number().over(rarest)).where("nth = 1").select("tokens", "confidence", "support", F.col("token").alias("key"))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls (url, tokens given) that hold all tokens of some rule."""
    index = rules.select("key", F.col("tokens").alias("needed"))
    return (
        urls.select("url", "tokens", F.explode("tokens").alias("key")).join(index, "key")
        .where(F.size(F.array_except("needed", "tokens")) == 0).select("url").distinct()
    )


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, url, host, path, rule, verdict of every page."""
    seen = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    seen = seen.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    labelled = seen.where(F.col("fixed").isNotNull()).select(tokens(F.col("url")).alias("tokens"), F.col("fixed.verdict").alias("verdict"))
    mined = mine_rules(labelled, min_support, min_confidence)
    open_urls = seen.where(F.col("fixed").isNull() & F.col("url").isNotNull()).select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    hits = matches(open_urls, mined).select("url", F.lit("block").alias("mined"))
    return seen.join(hits, "url", "left").select(
        "page_id", "url", "host", "path", F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), F.col("mined"), F.lit("allow")).alias("verdict"),
    )
