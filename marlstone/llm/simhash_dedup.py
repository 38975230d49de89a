"""Near-duplicates by SimHash: fingerprints, candidates by pigeonring filtering, links, components.

Two fingerprints of 64 bits link if they differ in at most MAX_BITS. Cut into SEGMENTS pieces on a ring, the
differences of such a pair have a start from which every chain of consecutive pieces stays within its
proportional budget: l pieces differ in at most l * MAX_BITS / SEGMENTS bits. With 5 pieces and 4 bits
the budgets are 0, 1, 2, 3, 4. So a pair agrees in a whole piece and in all but one bit of the next one,
which is a key of 25 or 26 bits: each fingerprint stands under its own keys, and as a probe under those in
which one of its set bits of the second piece is cleared. Of two fingerprints that differ in that bit
one has it set, so they meet once. Longer chains prune what meets before the full count of bits.

Equal fingerprints are one node. Within a key a breadth-first walk gives a spanning forest of the links there:
at most one edge for each row, however many links a group of near copies has. A key's rows are
8 bytes each and only different fingerprints count, so a hot text is one node and a crowd of near
copies, which differ in bits all over the ring, spreads over the keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Written, table, tidy
from marlstone.llm.components import connected_components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
SEGMENTS = 5
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16

SIZES = tuple(64 // SEGMENTS + (k < 64 % SEGMENTS) for k in range(SEGMENTS))
_STARTS = (0, *accumulate(SIZES[:-1]))
_U = np.uint64


def fingerprint(text: bytes | None) -> int:
    """Bit b is set if it is in over half of the shingles' hashes; 0 without words."""
    words = (text or b"").lower().split()  # of bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return 0
    whole, size = b" ".join(words), min(len(words), SHINGLE)
    ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    n, digest = len(words) - size + 1, xxhash.xxh64_intdigest
    h = np.fromiter((digest(whole[s:e], SEED) for s, e in zip(starts, ends[size - 1:])), _U, n)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for k in range(0, n, AT_ONCE):
        ones += np.unpackbits(h[k:k + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _rotated(f: np.ndarray, segment: int) -> np.ndarray:
    """The bits from `segment` on, in ring order."""
    at = _STARTS[segment]
    return f if not at else (f >> _U(at)) | (f << _U(64 - at))


def ring_keys(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, whether it is a probe) of all fingerprints: own keys, and those with a set bit of the second piece cleared."""
    keys, of, probes = [], [], []
    for segment in range(SEGMENTS):
        first, second = SIZES[segment], SIZES[(segment + 1) % SEGMENTS]
        own = (_rotated(f, segment) & _U((1 << first + second) - 1)) | _U(segment << 26)
        keys.append(own)
        of.append(f)
        probes.append(np.zeros(len(f), bool))
        for bit in range(first, first + second):
            set_ = (own >> _U(bit) & _U(1)).astype(bool)
            keys.append(own[set_] ^ _U(1 << bit))
            of.append(f[set_])
            probes.append(np.ones(int(set_.sum()), bool))
    return np.concatenate(keys), np.concatenate(of), np.concatenate(probes)


def _chains_hold(x: np.ndarray, segment: int) -> np.ndarray:
    """Whether differences x, rotated to `segment`, stay within the budgets of all chains of three pieces or more; the last chain is the whole ring."""
    left = np.arange(len(x))
    for length in range(3, SEGMENTS + 1):
        bits = sum(SIZES[(segment + k) % SEGMENTS] for k in range(length))
        left = left[np.bitwise_count(x[left] & _U((1 << bits) - 1)) <= length * MAX_BITS // SEGMENTS]
    out = np.zeros(len(x), bool)
    out[left] = True
    return out


def forest(f: np.ndarray, probe: np.ndarray, segment: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) edges of a spanning forest of the links between rows of one key, of which one at least isn't a probe."""
    f = _rotated(f, segment)
    rest = np.argsort(probe, kind="stable")  # those under their own key first
    while len(rest) > 1 and not probe[rest[0]]:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for u in queue.pop():
                ok = _chains_hold(f[rest] ^ f[u], segment)
                if probe[u]:
                    ok &= ~probe[rest]
                if ok.any():
                    yield u, rest[ok]
                    queue.append(rest[ok])
                    rest = rest[~ok]


def links(keys: np.ndarray, f: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of rows sorted by key, all rows of a key being there."""
    edge = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1, append=keys[-1:] + 1))
    size, own = np.diff(edge), np.add.reduceat(~probe, edge[:-1]) if len(keys) else np.zeros(0)
    a, b = [], []
    # two rows under a key, the most frequent case, at once
    two = edge[:-1][(size == 2) & (own > 0)]
    for segment in range(SEGMENTS):
        at = two[keys[two] >> 26 == segment]
        at = at[_chains_hold(_rotated(f[at] ^ f[at + 1], segment), segment)]
        a.append(f[at])
        b.append(f[at + 1])
    for k in np.flatnonzero((size > 2) & (own > 0)):
        low, high = edge[k], edge[k + 1]
        for u, found in forest(f[low:high], probe[low:high], int(keys[low] >> 26)):
            a.append(np.full(len(found), f[low + u]))
            b.append(f[low + found])
    return np.concatenate(a), np.concatenate(b)


@tidy
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())], _U)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, f, probe = ring_keys(batch.column("fp").to_numpy().view(_U))
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(f.view(np.int64)), pa.array(probe)], ["key", "fp", "probe"])


@tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> edges (a, b); a key that goes on in the next batch waits for it."""
    def edges(k: np.ndarray, f: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        a, b = links(k, f, p)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k, f, p = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(_U), batch.column("probe").to_numpy(zero_copy_only=False)
        if held and k[-1] == held[0][0][0]:
            held.append((k, f, p))
            continue
        last = int(np.searchsorted(k, k[-1]))
        held.append((k[:last], f[:last], p[:last]))
        yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held = [(k[last:], f[last:], p[last:])]
    if held:
        yield edges(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns aren't read): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most MAX_BITS bits. Null, empty and
    blank texts have the fingerprint zero, which links like any other. Rows with a null doc_id take part;
    among themselves their component_id is null. A repeated row stays repeated. An empty table gives no rows.
    """
    rows = Written(docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long"), "fingerprints")
    nodes = Written(rows.df.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    keyed = nodes.df.select("fp").mapInArrow(_keys, "key int, fp long, probe boolean").repartition("key").sortWithinPartitions("key")
    edges = Written(keyed.mapInArrow(_linked, "a long, b long"), "edges")
    found = connected_components(edges.df)
    edges.drop()
    rooted = nodes.df.join(found.df.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = Written(rooted, "rooted")
    least = rooted.df.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = Written(rooted.df.join(least, "root").select("fp", "component_id"), "named")
    for w in (nodes, found, rooted):
        w.drop()
    return rows.df.join(named.df, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
