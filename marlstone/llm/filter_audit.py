"""Filter interaction audit: what each of several filters removes, alone and after the others.

Each document gets a mask, a bit for each filter that it fails. Masks are counted by part, with and
without the labels, and the counts of every order of the filters follow from a part's vector of counts
alone: a document is removed at a step iff it fails that filter and none before it.

The filter of exact copies needs the whole table. Texts are routed by fingerprint: a task keeps, for each
xxhash, the chain of different texts that have it, each in full with its minimum id, and emits the ids
that aren't the minimum. Before anything is shuffled each block of the input does the same with its own
rows, so of a text that a third of all rows have, a block sends one row; its other rows are known to
fail there. A block is bounded in bytes, and so a task's memory by its share of the distinct texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import count, permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of different texts that a block keeps before it sends them on.
BLOCK_BYTES = 32 << 20
#: Bytes of all texts for each task that texts are routed to; a task keeps its share of the different ones.
TASK_BYTES = 64 << 20
#: Label classes that are counted beside each mask: all, quality = 1, toxic = 1.
CLASSES = 3

_UPPER, _SPECIAL = bytes(range(65, 91)), b"#$%&*|"


def text_mask(text: bytes) -> int:
    """The bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()  # of bytes: splits at \x20 and \x09-\x0D
    points = len(text.decode("utf-8", "replace"))
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * upper > 5 * points, any(c in text for c in _SPECIAL))
    return sum(bool(x) << k for k, x in enumerate(fails))


class Chains:
    """By fingerprint, the texts that have it: of each its full bytes, mask, minimum id, and how many rows of that id each part has."""

    def __init__(self) -> None:
        self.by: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, mask: int | None, doc_id: object, parts: dict[str, int]) -> list[tuple]:
        """Rows (doc_id, part, mask, n) that are now known to have a text of a smaller id."""
        chain = self.by.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                known, least, own = entry[1:]
                if doc_id == least:  # the same id again isn't a smaller one
                    for part, n in parts.items():
                        own[part] = own.get(part, 0) + n
                    return []
                if doc_id < least:
                    entry[2:] = doc_id, dict(parts)
                    doc_id, parts = least, own
                return [(doc_id, part, known | COPY, n) for part, n in parts.items()]
        chain.append([text, text_mask(text) if mask is None else mask, doc_id, dict(parts)])
        self.bytes += len(text) + 500
        return []

    def rest(self) -> Iterator[tuple[int, tuple]]:
        for key, chain in self.by.items():
            for entry in chain:
                yield key, tuple(entry)


def _blocks(rows: Iterable) -> Iterator[tuple[int, tuple]]:
    """Rows (doc_id, text, part) of a partition -> (fingerprint, (text, mask, id, parts)) to be routed, and (number, (None, row)) of rows that are settled."""
    chains, number = Chains(), count()
    for doc_id, text, part in rows:
        text = (text or "").encode("utf-8", "replace")
        settled = [(None, part, text_mask(text), 1)] if doc_id is None else chains.add(xxhash.xxh3_64_intdigest(text), text, None, doc_id, {part: 1})
        for row in settled:
            yield next(number), (None, row)
        if chains.bytes > BLOCK_BYTES:
            yield from chains.rest()
            chains = Chains()
    yield from chains.rest()


def _settle(pairs: Iterable) -> Iterator[tuple]:
    """Rows (doc_id, part, mask, n) of a task's texts: those of ids that aren't the minimum as soon as that is known."""
    chains = Chains()
    for key, value in pairs:
        if value[0] is None:
            yield value[1]
        else:
            yield from chains.add(key, *value)
    for _, (_, mask, doc_id, parts) in chains.rest():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n) of the rows of `docs` (doc_id, text, source; no other column is read); n counts rows that are equal in all three.

    A null text is an empty one, a null source is the part ''. Rows that repeat an id with the same text
    aren't copies of each other; rows without an id are copies of none and none is a copy of theirs.
    """
    rows = docs.select("doc_id", "text", F.coalesce("source", F.lit("")).alias("part")).rdd
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    settled = rows.mapPartitions(_blocks).partitionBy(n).mapPartitions(_settle)
    return spark.createDataFrame(settled, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, n long")


@lru_cache(maxsize=1)
def _steps() -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(order, step, filter) of each step of each order, and for each the masks (0 or 1) that are kept after it, removed by it, redundant in it."""
    every = np.arange(1 << len(FILTERS))
    names, rows = [], []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order):
            fails, gone = (every >> k & 1).astype(bool), (every & before) > 0
            names.append(("".join(FILTERS[x] for x in order), step + 1, k))
            rows.append((~gone & ~fails, ~gone & fails, gone & fails))
            before |= 1 << k
    return names, np.array(rows, np.int64)


def report(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """The rows of a part from its documents by label class and mask."""
    names, by = _steps()
    everyone, good, toxic = vector
    kept, removed, redundant = (by @ everyone).T
    good_lost, toxic_lost = by[:, 1] @ good, by[:, 1] @ toxic
    shapley = np.zeros(len(FILTERS), np.int64)
    np.add.at(shapley, [f for _, _, f in names], removed)
    for k, (order, step, f) in enumerate(names):
        yield part, order, step, int(kept[k]), int(removed[k]), int(redundant[k]), int(everyone[1 << f]), int(good_lost[k]), int(toxic_lost[k]), int(shapley[f])


def _counted(vector: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs (doc_id, text, source), labels (doc_id, quality, toxic); other columns aren't read. Nulls are as
    in `masks`; a document with several label rows is good or toxic if any of them says so, one without a
    label is neither. An empty table has no part and gives no rows. All counts are exact longs.
    """
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("int").alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int").alias("toxic"))
    found = masks(docs)
    rows = found.join(told, found["doc_id"] == told["label_id"], "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = rows.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda row: _counted(np.zeros((CLASSES, 1 << len(FILTERS)), np.int64), row), _counted, lambda a, b: a + b)
    out = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda x: report(*x)), out)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
told AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT t, min(doc_id) AS least FROM words GROUP BY t),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
    + 16 * CAST(coalesce(words.doc_id > least, false) AS INT) AS mask
  FROM words JOIN firsts USING (t) LEFT JOIN told ON words.doc_id = told.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM masked GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
each AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (mask & (own + before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(g) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM (SELECT part, mask, n, g, x, filter_order, step, CAST(own AS INT) AS own, CAST(before AS INT) AS before FROM counts, steps) GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM each
"""
