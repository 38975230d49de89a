"""Lines that repeat over the pages of one site (menus, notices, footers), by site-relative frequency.

For each host, the number of pages that contain a line is divided by the number of the host's pages;
lines beyond a ratio are boilerplate and go. Counting groups by (host, hash of the line) after a
partial aggregation, so neither a hot host nor a hot line meets in one task. A host has at most
(mean number of lines) / ratio boilerplate lines, so the list of them is short; it is joined to the
pages by host, broadcast only if its written size is below a bound, and by (host, salt) beyond. Of that
list a page first takes what it has itself, by hashing, and then tells its lines by those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Written, doc_columns, table

RATIO = 0.1
MIN_PAGES = 5
#: Bytes of the written boilerplate list up to which it is broadcast.
BROADCAST_BYTES = 4 << 20
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_key(line: Column) -> Column:
    """96 bits of two hashes; the line itself isn't shuffled. Counts are told apart by both, a host's listed lines by the first."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate_lines(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_a, line_b, n_pages, host_pages) of the lines in more than `ratio` of the host's pages and at least `min_pages` of them.

    A line counts once for a page; lines of white space only never count. A null host is a host of its own.
    """
    pages = pages.select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != ""), _line_key))).alias("k"))
    counts = lines.groupBy("host", F.col("k.a").alias("line_a"), F.col("k.b").alias("line_b")).agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    # by host and a part of the line's hash, as a host may have most lines
    counts = counts.withColumn("part", F.pmod("line_a", F.lit(SALTS)))
    totals = totals.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = counts.join(totals, counts["host"].eqNullSafe(totals["host"]) & (counts["part"] == totals["part"])).drop(totals["host"]).drop("part")
    return joined.where(F.col("n_pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The input with the text's boilerplate lines removed; `ld_lines` and `ld_dropped` count lines before and lines dropped.

    Every row stays, also one that loses all lines (its text is then empty). A null text stays null with
    0 lines. Other lines keep their order, repeats and bytes. Other columns pass through, whatever their
    names, except ld_lines and ld_dropped, which are replaced.
    """
    pages = pages.drop("ld_lines", "ld_dropped")
    names = pages.columns
    found = Written(boilerplate_lines(pages, host_col, text_col, ratio, min_pages).groupBy("host").agg(F.collect_set("line_a").alias("bad")), "boilerplate")
    # the row's own columns stay in a struct, apart from those of this operator
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text, host = F.col("row")[text_col], F.col("row")[host_col]
    if found.bytes() <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(found.df), host.eqNullSafe(F.col("host")), "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        rules = found.df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(rules, host.eqNullSafe(F.col("host")) & (F.col("salt") == F.col("part")), "left")
    lines = _lines(text)
    mine = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), "bad")
    joined = joined.withColumn("bad", F.when(F.col("bad").isNotNull(), mine))
    keep = F.when(F.coalesce(F.size("bad"), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("bad", F.xxhash64(x))))
    joined = joined.withColumn("keep", keep)
    kept_text = F.when(text.isNotNull(), F.array_join("keep", "\n"))
    return joined.select(*[(kept_text if c == text_col else F.col("row")[c]).alias(c) for c in names],
                         F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("ld_lines"), (F.size(lines) - F.size("keep")).cast("long").alias("ld_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(doc_columns(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.col("text").alias("kept_text"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    return doc_columns(drop_boilerplate(doc_columns(docs)).withColumn("n_chars", F.length("text").cast("long")))


def oracle(docs: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
s AS (SELECT source, count(*) AS n FROM d GROUP BY source),
l AS (SELECT DISTINCT rid, source, unnest(ls) AS line FROM d),
bad AS (SELECT l.source, l.line FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
        WHERE trim(translate(l.line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) <> ''
        GROUP BY l.source, l.line HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * any_value(s.n)),
b AS (SELECT source, list(line) AS lines FROM bad GROUP BY source),
k AS (SELECT d.*, CASE WHEN b.lines IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(b.lines, x)) END AS keep
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END AS n_lines, len(ls) - len(keep) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN array_to_string(keep, chr(10)) END AS kept_text FROM k
"""


ORACLE = oracle()
