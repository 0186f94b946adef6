"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence.

Native: DataFrame and SQL functions only.

A rule (host, path, verdict) fits a url whose host is the rule's host or a subdomain of it
and whose path starts with the rule's path. A url expands into every host suffix (whole
labels) times every path prefix that ends in a slash (and the empty one); a rule's key is
its host and its path up to the last slash. Both sides are joined on the first 32 bits of
the key's SHA-256; the full digest and the rule's whole path are then confirmed. Of the
rules that fit the longest wins (host and path together, then the longer host, then block).

Scale: no url is expanded deeper than the rules are. The join is salted by the row (rules
repeated once per salt), so a host or suffix that a third of all urls share is spread;
where the rules are small Spark broadcasts them by their size. Rows are keyed by (id, url)
when the best rule is picked, after partial aggregation.

Defined results: no "://" or a null url gives an empty host and path, no rule and the
default verdict; rules with a null or empty host fit nothing, a null path is the empty one;
repeated rows are judged alike; urls are read whole at any length; an empty table gives no rows,
an empty rule table the default verdict for all; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a DataFrame."""
    rows = F.array(*(F.struct(*(F.lit(v).cast("string").alias(n) for n, v in zip(("host", "path", "verdict"), r))) for r in rules))
    return spark.range(1).select(F.inline(rows)) if rules else spark.range(0).selectExpr(
        "string(id) host", "string(id) path", "string(id) verdict")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Array of host suffixes (up to ``labels`` labels) times slash-ended path prefixes (up to ``slashes``)."""
    names, steps = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(max(labels, 1)))),
                           lambda k: F.array_join(F.slice(names, -k, k), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(slashes))),
                           lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.when(k > 0, "/").otherwise("")))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
               salts: int = 16) -> DataFrame:
    """(id, url, host, path, rule, verdict) for every row of ``df``."""
    r = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"),
                     F.col("verdict").alias("r_verdict")).where(F.col("r_host") != "")
    r = r.withColumn("digest", F.sha2(F.concat("r_host", F.regexp_extract("r_path", r"(?s)^(.*/)", 1)), 256))
    depth = r.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.size(F.split("r_path", "/")) - 1)).first()
    r = r.withColumn("prefix", _prefix(F.col("digest"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    asked = (parts.where(F.col("host") != "")
             .withColumn("text", F.explode(expressions(F.col("host"), F.col("path"), depth[0] or 1, depth[1] or 0)))
             .withColumn("asked", F.sha2("text", 256))
             .select("id", "url", "path", "asked", _prefix(F.col("asked")).alias("prefix"),
                     F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int").alias("salt")))
    fits = asked.join(r, ["prefix", "salt"]).where((F.col("asked") == F.col("digest")) & F.startswith("path", "r_path"))
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy(F.col("id").alias("b_id"), F.col("url").alias("b_url")).agg(F.max_by(
        F.struct(rule.alias("rule"), F.col("r_verdict").alias("verdict")),
        F.struct(F.length(rule), F.length("r_host"), F.col("r_verdict") == "block", "r_verdict")).alias("best"))
    j = parts.join(best, parts["id"].eqNullSafe(best["b_id"]) & parts["url"].eqNullSafe(best["b_url"]), "left")
    return j.select("id", "url", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
