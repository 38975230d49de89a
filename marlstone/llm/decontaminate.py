"""Benchmark decontamination by a distributed positional inverted index.

The training text is cut into blocks of documents. Each block stores the postings of its tokens: for
each term of the benchmark, the sorted positions where it occurs (terms that no benchmark item has can
be in no match and only take up a position). Every benchmark window then starts from the list of its
rarest term in the block, and is intersected with the offset-adjusted lists of its other terms, from
rare to frequent, all windows of a step at once. What survives all steps is an exact phrase match.
Proximity matches (all terms within a span, in any order) use the same lists; `benchmark_matches` returns
both kinds with their places. The postings of a block are used where they are made and aren't stored.

Blocks are made where the data lies: nothing is shuffled, no document meets another, and a block's
memory is bounded by its size. The benchmark is cut into parts of a bounded number of words; each part
is sent to the executors once, and their findings are combined in each block, so neither side has to be small.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import doc_columns, table, tidy, with_text

WINDOW = 13
#: Share of a document's words in matches from which it counts as contaminated: 1 / SHARE.
SHARE = 20
#: Bytes of text in a block, and words of the benchmark in a part.
BLOCK_BYTES = 24 << 20
PART_WORDS = 4_000_000
#: Bytes of text in a block of the pipeline's stage, whose workers share an executor with what earlier stages left.
STAGE_BLOCK_BYTES = 1 << 20

_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_KEEP).split()


@dataclass(frozen=True)
class Part:
    """Windows of equal items merged: `terms` and `sizes` by distinct window, and the items that have each."""
    vocabulary: dict[bytes, int]
    terms: np.ndarray  # windows x WINDOW, padded with -1
    sizes: np.ndarray
    items: list[tuple[str, ...]]


def make_part(rows: list[tuple[str, list[bytes]]], size: int = WINDOW) -> Part:
    """rows: (item id as text, words)."""
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, ws in rows:
        ids = [vocabulary.setdefault(w, len(vocabulary)) for w in ws]
        for k in range(max(1, len(ids) - size + 1) if ids else 0):
            found.setdefault(tuple(ids[k:k + size]), set()).add(item)
    terms = np.full((len(found), size), -1, np.int32)
    for k, window in enumerate(found):
        terms[k, :len(window)] = window
    return Part(vocabulary, terms, (terms >= 0).sum(1).astype(np.int64), [tuple(sorted(x)) for x in found.values()])


class Index:
    """Postings of a block: positions by term, over all its documents one after the other with gaps between them."""

    def __init__(self, documents: list[list[bytes]], part: Part, gap: int = WINDOW):
        get, lookup = part.vocabulary.get, []
        self.starts = np.zeros(len(documents) + 1, np.int64)
        for k, ws in enumerate(documents):
            lookup.append(np.fromiter((get(w, -1) for w in ws), np.int32, len(ws)))
            lookup.append(np.full(gap, -1, np.int32))
            self.starts[k + 1] = self.starts[k] + len(ws) + gap
        stream = np.concatenate(lookup) if lookup else np.zeros(0, np.int32)
        at = np.flatnonzero(stream >= 0)
        order = np.argsort(stream[at], kind="stable")
        self.positions = at[order]
        self.edges = np.searchsorted(stream[at][order], np.arange(len(part.vocabulary) + 1))
        self.lengths = np.diff(self.edges)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.edges[term]:self.edges[term + 1]]

    def contains(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position is in its term's list, by a binary search within the list."""
        low, high = self.edges[terms], self.edges[terms + 1]
        end = high
        while True:
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) >> 1
            right = np.zeros(len(low), bool)
            right[open_] = self.positions[middle[open_]] < positions[open_]
            low, high = np.where(right, middle + 1, low), np.where(open_ & ~right, middle, high)
        out = low < end
        out[out] = self.positions[low[out]] == positions[out]
        return out

    def phrases(self, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of every exact occurrence of a window."""
        if not len(part.terms) or not len(self.positions):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        counts = np.where(part.terms >= 0, self.lengths[part.terms], np.iinfo(np.int64).max)
        live = np.flatnonzero((np.where(part.terms >= 0, counts, 1) > 0).all(1))
        rank = np.argsort(counts[live], axis=1, kind="stable")
        first = rank[:, 0]
        sizes = counts[live, first]
        begin = self.edges[part.terms[live, first]]
        row = np.repeat(np.arange(len(live)), sizes)
        where = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(row)) if len(row) else np.zeros(0, np.int64)
        start = self.positions[where] - first[row]
        for step in range(1, part.terms.shape[1]):
            offset = rank[row, step]
            term = part.terms[live[row], offset]
            ok = term < 0
            ok[~ok] = self.contains(term[~ok], start[~ok] + offset[~ok])
            row, start = row[ok], start[ok]
        return live[row], start

    def near(self, part: Part, span: int) -> list[tuple[int, int]]:
        """(window, document) where all terms of a window lie within `span` words, in any order."""
        return list(dict.fromkeys((w, d) for w, d, _ in self.near_at(part, span)))

    def near_at(self, part: Part, span: int) -> list[tuple[int, int, int]]:
        """(window, document, place in it) of each word from which on `span` words have all terms of a window, the word being one of them; found around its rarest term.

        Gaps between documents have to be `span` - 1 words at least.
        """
        out = []
        for w in range(len(part.terms)):
            terms = np.unique(part.terms[w][part.terms[w] >= 0])
            terms = terms[np.argsort(self.lengths[terms], kind="stable")]
            lists = [self.postings(t) for t in terms]
            if any(not len(x) for x in lists):
                continue
            hit = set()
            for p in lists[0]:
                around = [x[np.searchsorted(x, p - span + 1):np.searchsorted(x, p + span)] for x in lists]
                if any(not len(x) for x in around):
                    continue
                for begin in np.unique(np.concatenate(around)):
                    if begin <= p < begin + span and all(((x >= begin) & (x < begin + span)).any() for x in around):
                        hit.add(int(begin))
            for begin in sorted(hit):
                d = int(np.searchsorted(self.starts, begin, "right")) - 1
                out.append((w, d, begin - int(self.starts[d])))
        return out


def benchmark_parts(benchmark: DataFrame, part_words: int = PART_WORDS, id_col: str = "item_id", text_col: str = "text") -> list[Part]:
    """The benchmark, read once by the driver in a stream, in parts of about `part_words` words."""
    parts, rows, held = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).orderBy("i", "t").toLocalIterator():
        ws = words(bytes(row["t"]) if row["t"] is not None else None)
        if not ws:
            continue
        rows.append((row["i"] if row["i"] is not None else "", ws))
        held += len(ws)
        if held >= part_words:
            parts.append(make_part(rows))
            rows, held = [], 0
    return [*parts, make_part(rows)] if rows or not parts else parts


def _matches(documents: list[list[bytes]], parts: list[Part]) -> list[tuple[int, set[str]]]:
    """For each document, the number of words in any occurrence of a window, and the items whose windows occur."""
    lengths = [len(d) for d in documents]
    starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64) + WINDOW)])
    edge = np.zeros(int(starts[-1]) + 1, np.int32)
    items: list[set[str]] = [set() for _ in documents]
    for part in parts:
        window, at = Index(documents, part).phrases(part)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + part.sizes[window], -1)
        doc = np.searchsorted(starts, at, "right") - 1
        for d, w in set(zip(doc.tolist(), window.tolist())):
            items[d].update(part.items[w])
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return [(int(covered[starts[k] + n] - covered[starts[k]]), items[k]) for k, n in enumerate(lengths)]


FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def match_benchmark(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns in `keep` and FIELDS for every row.

    A window is WINDOW consecutive words of an item, or all words of a shorter one. Null and empty
    texts have no words and are not contaminated; items without words have no windows; items of equal
    id count once. Repeated rows stay repeated.
    """
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(p) for p in benchmark_parts(benchmark)]
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(FIELDS).fields])
    given, text = with_text(docs, keep, text_col, "c_text")

    def results(documents: list[list[bytes]]) -> list[pa.Array]:
        found = _matches(documents, [p.value for p in parts])
        lengths = [len(d) for d in documents]
        return [pa.array(lengths, pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([len(i) for _, i in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, i in found], pa.string()),
                pa.array([hit > 0 and SHARE * hit >= n for n, (hit, _) in zip(lengths, found)], pa.bool_())]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary())
            begin = 0
            while begin < batch.num_rows:
                block, size = [], 0
                while begin + len(block) < batch.num_rows and size < block_bytes:
                    read = texts[begin + len(block)].as_py()
                    size += len(read or b"")
                    block.append(words(read))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begin, len(block)) for c in keep), *results(block)], schema.names)
                begin += len(block)

    return given.mapInArrow(run, schema)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, span: int = 2 * WINDOW, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns in `keep`, item, start and kind: one row for each match of an item's windows in a row's text.

    `start` counts words from 0. Kind `phrase` is an exact occurrence of a window, `near` a word from
    which on `span` words have all terms of a window in any order, the word being one of them; a phrase
    not longer than the span is a near match too. Windows, nulls and repeats are as in `match_benchmark`.
    """
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(p) for p in benchmark_parts(benchmark)]
    schema = StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL("item string, start long, kind string").fields])

    def results(documents: list[list[bytes]]) -> list[tuple[int, str, int, str]]:
        found = set()
        for part in (p.value for p in parts):
            index = Index(documents, part, max(WINDOW, span))
            window, at = index.phrases(part)
            doc = np.searchsorted(index.starts, at, "right") - 1
            matches = [(w, d, s, "phrase") for w, d, s in zip(window.tolist(), doc.tolist(), (at - index.starts[doc]).tolist())]
            matches += [(w, d, s, "near") for w, d, s in index.near_at(part, span)]
            found.update((d, item, s, kind) for w, d, s, kind in matches for item in part.items[w])
        return sorted(found)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("c_text").cast(pa.binary())
            begin = 0
            while begin < batch.num_rows:
                block, size = [], 0
                while begin + len(block) < batch.num_rows and size < block_bytes:
                    text = texts[begin + len(block)].as_py()
                    size += len(text or b"")
                    block.append(words(text))
                rows = results(block)
                at = pa.array([begin + r[0] for r in rows], pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), *(pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.string()), (2, pa.int64()), (3, pa.string())))], schema.names)
                begin += len(block)

    return docs.select(*keep, F.col(text_col).alias("c_text")).mapInArrow(run, schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    docs = doc_columns(docs)
    return doc_columns(match_benchmark(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), block_bytes=STAGE_BLOCK_BYTES).where("not contaminated"))


def oracle(docs: str = "documents") -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({low}, {word}) AS w FROM {docs}),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({low}, {word}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(list_slice(w, k, k + least(len(w), {WINDOW}) - 1), ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT rid, k, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM m)) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


ORACLE = oracle()
