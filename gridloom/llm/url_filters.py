"""Operator 7: URL rules by host suffix and path prefix, looked up through hashes.

Each URL is expanded into expressions: every suffix of its host with as many labels as some rule's host has, with every
prefix of its path whose length some rule's path has; no other can be a rule, so a URL costs its length and a part for each rule size. Rules and expressions meet in an equi-join on a short prefix of their SHA-256; full digests then
confirm, and the longest rule that fits wins (host and path together; at equal length the longer host).

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; repeated pages are judged
alike, one output row for each; rules that are null are ignored, repeated rules count once (a block wins over an allow
of the same rule); an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule tables of at most this many rows are broadcast (about 200 bytes each); larger ones are joined by shuffle.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased. Path: from there up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def labels_of(host: Column) -> Column:
    """Number of parts between dots; 1 at least."""
    return F.char_length(host) - F.char_length(F.translate(host, ".", "")) + 1


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a rule table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", prefix_bits: int = 32) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spread = F.conv(F.substring("digest", 1, prefix_bits // 4), 16, 10).cast("long")
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    known = known.select(
        "host", "path", F.when(F.col("blocks"), "block").otherwise("allow").alias("said"), F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest")
    ).withColumn("short", spread)
    lengths = sorted(r[0] for r in known.select(F.char_length("path")).distinct().collect())  # bounded by the longest path
    depths = sorted(r[0] for r in known.select(labels_of(F.col("host"))).distinct().collect())  # and by the longest host
    few = known.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    table = known.select(F.col("short").alias("r_short"), F.col("digest").alias("r_digest"), F.concat("host", "path").alias("rule"), "said", F.struct((F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size")).alias("precedence"))

    host, path = host_and_path(F.col(url_col))
    deep = F.filter(F.array(*[F.lit(n) for n in depths]).cast("array<int>"), lambda n: n <= labels_of(F.col("host")))
    suffixes = F.transform(deep, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("path"))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda n: F.concat(h, F.lit("\n"), F.substring(F.col("path"), F.lit(1), n)))))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # A null expression stays with its page, so that a page without candidates has a row as well.
    asked = rows.withColumn("asked", F.explode(F.concat(F.array(F.lit(None).cast("string")), expressions)))
    asked = asked.withColumn("digest", F.sha2("asked", 256)).withColumn("short", F.coalesce(spread, -F.col("row") - 1))
    side = F.broadcast(table) if few else table
    met = asked.join(side, F.col("short") == F.col("r_short"), "left").where(F.col("asked").isNull() | (F.col("digest") == F.col("r_digest")))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max_by(F.struct("rule", "said"), F.when(F.col("rule").isNotNull(), F.col("precedence"))).alias("won"))
    return best.select("page_id", "host", "path", "won.rule", F.coalesce("won.said", F.lit(default)).alias("verdict"))
