"""URL filters by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or a text without '://'."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", prefix_hex: int = 8, default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule (host and path of the rule, or null), verdict.

    rules(host, path, action): a rule fits its host and all subdomains of it when the path starts with the rule's
    path; the longest host + path wins (then the longer host, then 'block'). Each url is expanded into the host
    suffixes and path prefixes whose label counts and lengths occur among the rules; the first prefix_hex digits of
    their SHA-256 meet the rules' in an equi-join, and the full digests confirm a match. Only the distinct label
    counts and path lengths are read by the driver, which the length of a host and path bounds. Whether the rules
    are broadcast is left to Spark's own size threshold.

    Null urls and urls without '://' have an empty host and path and get the default verdict; repeated rows stay
    repeated; further columns of pages are ignored; empty pages or rules give no rows or default verdicts.
    """
    r = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action").where("rule_host <> ''")
    digest = F.sha2(F.concat("rule_host", "rule_path"), 256)
    table = r.select("action", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_len"), digest.alias("full"), F.substring(digest, 1, prefix_hex).alias("short"))
    shapes = r.select((F.length("rule_host") - F.length(F.replace("rule_host", F.lit("."), F.lit(""))) + 1).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), host.alias("host"), path.alias("path"))
    expressions = [
        F.when(F.length("path") >= s["chars"], F.concat(F.substring_index("host", ".", -s["labels"]), F.substring("path", 1, s["chars"])))
        for s in sorted(shapes)
    ]
    each = rows.withColumn("expr", F.explode_outer(F.array_distinct(F.array_compact(F.array(*expressions))) if expressions else F.array().cast("array<string>")))
    each = each.withColumn("digest", F.sha2("expr", 256)).withColumn("short", F.substring("digest", 1, prefix_hex))
    met = each.join(table, "short", "left").withColumn("fits", F.coalesce(F.col("digest") == F.col("full"), F.lit(False)))
    best = F.max(F.when(F.col("fits"), F.struct(F.length("rule").alias("n"), "host_len", F.when(F.col("action") == "block", 1).otherwise(0).alias("b"), "rule", "action"))).alias("best")
    return (
        met.groupBy("_row", id_col, "host", "path").agg(best)
        .select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    )
