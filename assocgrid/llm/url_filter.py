"""URL rules by host suffix and path prefix.

Each distinct (host, path) is expanded into the expressions ``suffix of the host + prefix of the
path`` that some rule could have: suffixes with as many labels as a rule's host has, prefixes as
long as a rule's path is. Expressions meet the rules in an equi-join on the first 32 bits of their
digest; the full digest confirms a match, and the longest rule decides (of equal ones, blocking).
Hosts and paths without a rule get the default verdict.

Null URLs and URLs without ``://`` have an empty host and path; repeated rows each get their row;
empty tables of pages give no rows, an empty table of rules the default everywhere; further columns
are ignored. Rules with a null host or path never fit. Equal rules count once, blocking first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def with_rules(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for ``pages(page_id, url)`` under ``rules(host, path, verdict)``."""
    rest = after_scheme(F.col("url").cast("string"))
    split = pages.select(F.col("page_id").alias("page_id"), host(rest).alias("host"), path(rest).alias("path"))

    listed = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v")).filter(F.col("_h").isNotNull() & F.col("_p").isNotNull())
    listed = listed.groupBy("_h", "_p").agg(F.max("_v").alias("_v"))  # "block" sorts behind "allow"
    listed = listed.select(F.concat("_h", "_p").alias("_rule"), "_v", digest(F.concat_ws("\n", "_h", "_p")).alias("_full"), F.size(F.split("_h", r"\.")).alias("_labels"), F.length("_p").alias("_long"))
    # distinct small integers, bounded by the longest possible URL
    shape = listed.agg(F.sort_array(F.collect_set("_labels")).alias("labels"), F.sort_array(F.collect_set("_long")).alias("long")).first()
    hashed = listed.select("_rule", "_v", "_full", F.substring("_full", 1, PREFIX_DIGITS).alias("_short"))

    distinct = split.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    counts = F.filter(F.array(*[F.lit(n) for n in shape["labels"]]).cast("array<int>"), lambda n: n <= F.size(labels))
    suffixes = F.transform(counts, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    lengths = F.filter(F.array(*[F.lit(n) for n in shape["long"]]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = distinct.withColumn("_suffix", F.explode(suffixes)).withColumn("_prefix", F.explode(prefixes))
    tried = tried.withColumn("_digest", digest(F.concat_ws("\n", "_suffix", "_prefix")))
    met = tried.join(hashed, F.substring("_digest", 1, PREFIX_DIGITS) == F.col("_short")).filter(F.col("_digest") == F.col("_full"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("_rule").alias("n"), F.col("_v").alias("v"), F.col("_rule").alias("r"))).alias("_best"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("_best.r").alias("rule"), F.col("_best.v").alias("_verdict"))
    joined = split.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))
