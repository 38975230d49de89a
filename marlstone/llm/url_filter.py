"""URL filters by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's.
Reversing the labels of a host ("www.example.com" -> "com.example.www.") turns "this host and all
subdomains" into a prefix, so a rule owns one interval of the sorted key space. Rules of the same
number of labels own disjoint intervals and deeper ones nest in shallower ones, so the stack of rules
active at a key has one slot for each depth: the last rule of that depth that the sweep has passed,
valid while the key still starts with the rule's key.

The sweep is one sort inside each bucket. Urls are dealt over buckets by a hash of the url and row id,
so a site with a third of all rows spreads over all buckets; the rules, whose number is checked, are
repeated in each bucket. No url meets another url, and no row is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import ascii_lower, table

#: (action, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DEFAULT_VERDICT = "allow"
BUCKETS = 1024
#: Rule rows are repeated in each bucket; beyond this many, fewer buckets are used, never fewer rules.
MAX_REPEATED = 50_000_000


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot: a prefix of the key is a parent domain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
                default: str = DEFAULT_VERDICT, buckets: int = BUCKETS) -> DataFrame:
    """One row for each page: id, host, path, rule (host and path of the longest that fits, else null), verdict.

    The longest rule is that with the longest host, then the longest path. Null urls and urls without
    `://` have an empty host and path, fit no rule and get the default verdict. Repeated rows stay
    repeated; columns besides id and url are neither read nor returned. An empty table gives no rows.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.xxhash64("id", "url").alias("h"))
    depths = sorted({len(h.split(".")) for _, h, _ in rules})
    if not depths:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    buckets = max(1, min(buckets, MAX_REPEATED // len(rules)))
    starts = (spark.createDataFrame(rules, "action string, rule_host string, rule_path string")
              .withColumn("key", host_key(F.col("rule_host"))).groupBy("key")
              .agg(F.collect_set(F.struct(F.length("rule_path").alias("size"), "rule_path", F.concat("rule_host", "rule_path").alias("rule"), "action")).alias("paths"))
              .select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "key", F.lit(0).alias("kind"),
                      F.struct(F.col("key").alias("key"), "paths").alias("start"), F.size(F.split("key", r"\.")).alias("labels")))
    events = urls.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"),
                         "id", "host", "path").unionByName(starts, allowMissingColumns=True)
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rules without a dot have "com." as key: two pieces when split at dots
    stack = [F.last(F.when(F.col("labels") == d + 1, F.col("start")), ignorenulls=True).over(sweep).alias(f"at{d}") for d in depths]
    swept = events.select("kind", "key", "id", "host", "path", *stack).where("kind = 1")
    slots = []
    for d in reversed(depths):  # the deepest slot that fits wins
        slot = F.col(f"at{d}")
        fits = F.filter(slot["paths"], lambda p: F.col("path").startswith(p["rule_path"]))
        slots.append(F.when(F.col("key").startswith(slot["key"]) & (F.col("host") != ""), F.array_max(fits)))
    best = F.coalesce(*slots)
    return swept.withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
       (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h) DESC, length(p) DESC LIMIT 1) AS rule,
       coalesce((SELECT action FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h) DESC, length(p) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
