"""Collocation mining: phrases of two to five words, scored by how much oftener they occur than their parts would together.

Level k of the search holds the phrases of k words that occur often enough. By the Apriori rule such a phrase
starts and ends with one of level k - 1, so its key is exact in 64 bits: the slot of its first k - 1 words at the
level below, and the slot of its last word. Each level takes three steps over the corpus, which is kept as
blocks of slots that shrink as fewer words stand in any phrase of the level:

1. Every occurrence whose two parts are in the level below gives its key. Keys of a task, each with its count
   up to the threshold, are dealt by hash; those that reach the threshold are the candidates.
2. Candidates get a minimal perfect hash (levels of bits; a slot is the rank of a bit), with their keys
   stored by slot, so that any other key is told from them for certain. Words are keys of level 1: the 64-bit
   hash of language and word, once it is shown that no two words of the corpus share one (else it is salted anew).
3. Tasks look their blocks up, count slots with bincount, and the arrays are added in a tree, by chunks of slots.

The tables of the levels then give each phrase the counts of both sides of every cut, read by slot. What grows
with the corpus is only ever shuffled, counted or written; a perfect hash is sent to the executors in parts of
at most PART keys, one pass over the blocks for each part, so its size there is bounded at any scale.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import Written, table, tidy

LEAST = 100
LONGEST = 5
TOP = 2000
#: Keys of a perfect hash that is sent to the executors as one.
PART = 4_000_000
#: Words of a block of the corpus, and keys that a task holds before it sends them on.
BLOCK_WORDS = 1 << 17
HELD_KEYS = 1 << 20
#: Words of all languages together that a task holds with their hashes, or with their counts.
HELD_WORDS = 1 << 17
#: Slots of a chunk of counts, and chunks that a task holds.
CHUNK = 1 << 14
HELD_CHUNKS = 256
#: Groups of tasks whose counts are added first.
BRANCHES = 32
#: Parts that a language is ranked in first, so that none is sorted in one task.
RANK_PARTS = 32

#: A-Z lower-cased, every separator of pieces made one.
_TABLE = bytes(46 if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_FOUND = "s1 binary, prior binary, found binary"


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, with b"." for each separator of pieces, which no word contains."""
    return (text or b"").translate(_TABLE).replace(b".", b" . ").split()  # splits at \x20 and \x09; \x0A-\x0D are gone


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _share(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(keys + _U(0x9E3779B97F4A7C15)) % _U(parts)).astype(np.int32)


class PerfectHash:
    """A minimal perfect hash of different 64-bit keys, and the keys by slot.

    Keys are thrown at two bits each; where exactly one falls it is at home, the others go on to a
    smaller level. A key's slot is the number of set bits before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.bases, self.sizes, words = [], [], []
        rest, base = keys, 0
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = self._places(rest, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(_U))
            self.bases.append(base)
            self.sizes.append(size)
            base += size // 64
            rest = rest[~alone[at]]
        self.bits = np.concatenate(words) if words else np.zeros(0, _U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)[:-1]]) if words else np.zeros(0, np.int64)
        self.keys = np.zeros(len(keys), _U)
        if len(keys):
            self.keys[self._slots(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(keys ^ _U((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) % _U(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (base, size) in enumerate(zip(self.bases, self.sizes, strict=True)):
            at = self._places(keys[left], level, size)
            word, bit = self.bits[base + (at >> 6)], (at & 63).astype(_U)
            home = (word >> bit & _U(1)).astype(bool)
            out[left[home]] = (self.before[base + (at >> 6)] + np.bitwise_count(word & ((_U(1) << bit) - _U(1))))[home]
            left = left[~home]
            if not len(left):
                break
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for any that isn't a key."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slots = self._slots(keys)
        slots[self.keys[slots] != keys] = -1
        return slots


def phrase_keys(s1: np.ndarray, prior: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of every occurrence of k words whose first and last k - 1 are in level k - 1."""
    at = np.flatnonzero((prior[:-1] >= 0) & (prior[1:] >= 0)) if len(prior) else np.zeros(0, np.int64)
    return at, (prior[at].astype(_U) << _U(32)) | s1[at + k - 1].astype(_U)


def compact(s1: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that stand in a phrase of level k, with a gap of -1 where others were."""
    rise = np.zeros(len(s1) + 1, np.int64)
    at = np.flatnonzero(found >= 0)
    np.add.at(rise, at, 1)
    np.add.at(rise, at + k, -1)
    covered = np.cumsum(rise[:-1]) > 0
    keep = covered | np.concatenate([[False], covered[:-1]])
    return np.where(covered, s1, -1)[keep], found[keep]


def _arrays(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[pa.Buffer, ...]]:
    """The binary values of each row, without copies."""
    for row in zip(*(batch.column(c) for c in names), strict=True):
        yield tuple(x.as_buffer() for x in row)


def _ints(value: pa.Buffer, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(value, kind)


def _batch(*columns: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


@tidy
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n), a word perhaps several times."""
    counts: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        while counts:
            lang, c = counts.popitem()
            c.pop(b".", None)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(c)), pa.array(c.keys(), pa.binary()), pa.array(c.values(), pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            counts.setdefault(lang, Counter()).update(tokens(text.as_py()))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield from rows()
    yield from rows()


def _encoded(salt: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) -> blocks: the keys of level 1 one after the other, 0 between pieces."""
    class Hashes(dict):
        def __init__(self, lang: str):
            self.start = f"{salt}{lang}\t".encode()
            self[b"."] = 0

        def __missing__(self, word: bytes) -> int:
            self[word] = h = xxhash.xxh64_intdigest(self.start + word, 42)
            return h

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict[str, Hashes] = {}
        held, n = [], 0

        def block() -> pa.RecordBatch:
            return _batch([np.concatenate(held).tobytes()], [b""], [b""], names=["s1", "prior", "found"], kinds=[pa.binary()] * 3)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                h = hashes.get(lang) or hashes.setdefault(lang, Hashes(lang))
                ws = tokens(text.as_py())
                if sum(map(len, hashes.values())) > HELD_WORDS:
                    hashes.clear()
                    h = hashes[lang] = Hashes(lang)
                held.append(np.fromiter(map(h.__getitem__, ws), _U, len(ws)))
                held.append(np.zeros(1, _U))
                n += len(ws)
                if n >= BLOCK_WORDS:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    return run


def _chained(*steps: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Steps one after the other in one Python worker; each mapInArrow has a worker of its own for every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduce(lambda rows, step: step(rows), steps, batches)

    return run


def _looked_up(k: int, of, share: int, shares: int, offset: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (s1, prior, found): found gets the slots of those keys that the broadcast part `of` has; after the last part the block becomes one of level k."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: PerfectHash = of.value
        for batch in batches:
            for s1, prior, found in _arrays(batch, "s1", "prior", "found"):
                if k == 1:
                    keys = _ints(s1, _U)
                    at = np.flatnonzero(keys)
                    keys, size = keys[at], len(keys)
                else:
                    own = _ints(s1)
                    at, keys = phrase_keys(own, _ints(prior), k)
                    size = len(own)
                slots = _ints(found).copy() if found.size else np.full(size, -1, np.int32)
                mine = np.arange(len(keys)) if shares == 1 else np.flatnonzero(_share(keys, shares) == share)
                got = part.lookup(keys[mine])
                slots[at[mine][got >= 0]] = got[got >= 0] + offset
                if share < shares - 1:
                    out = (s1.to_pybytes(), prior.to_pybytes(), slots.tobytes())
                else:
                    words, slots = compact(slots if k == 1 else own, slots, k)
                    if not len(slots):
                        continue
                    out = (words.tobytes(), slots.tobytes(), b"")
                yield _batch(*([x] for x in out), names=["s1", "prior", "found"], kinds=[pa.binary()] * 3)

    return run


def _merged(keys: list[np.ndarray], counts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Different keys with their counts added, up to `least`."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[edge], np.minimum(np.add.reduceat(c.astype(np.int64), edge), least).astype(np.int32)


def _dealt(k: int, least: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of level k - 1 -> (shard, keys, counts) of the keys of level k."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            keys = np.concatenate(held)
            keys.sort()
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[edge], np.minimum(np.diff(edge, append=len(keys)), least).astype(np.int32)
            shard = _share(keys, shards)
            order = np.argsort(shard, kind="stable")
            edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
            parts = np.split(order, edge[1:])
            return _batch(shard[order][edge].tolist(), [keys[p].tobytes() for p in parts], [counts[p].tobytes() for p in parts], names=["shard", "keys", "counts"], kinds=[pa.int32(), pa.binary(), pa.binary()])

        for batch in batches:
            for s1, prior in _arrays(batch, "s1", "prior"):
                keys = phrase_keys(_ints(s1), _ints(prior), k)[1]
                if len(keys):
                    held.append(keys)
                    n += len(keys)
                if n >= HELD_KEYS:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()

    return run


def _survivors(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(keys, counts), all rows of a key being there -> the keys that reach the threshold."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, n = [], [], 0
        for batch in batches:
            for a, b in _arrays(batch, "keys", "counts"):
                keys.append(_ints(a, _U))
                counts.append(_ints(b))
                n += len(keys[-1])
                if n > 2 * max(4 * HELD_KEYS, len(keys[0])):
                    a, b = _merged(keys, counts, least)
                    keys, counts, n = [a], [b], len(a)
        if keys:
            a, b = _merged(keys, counts, least)
            yield pa.RecordBatch.from_arrays([pa.array(a[b >= least].view(np.int64))], ["key"])

    return run


def _with_share(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_share(batch.column("key").to_numpy().view(_U), parts)), batch.column("key")], ["part", "key"])

    return run


def _built(part: pa.Table) -> pa.Table:
    made = PerfectHash(np.ascontiguousarray(part.column("key").to_numpy()).view(_U))
    return pa.table({"part": pa.array([part.column("part")[0].as_py()], pa.int32()), "n": pa.array([len(made.keys)], pa.int64()), "hash": pa.array([pickle.dumps(made)], pa.binary())})


def _slot_keys(offsets: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in zip(batch.column("part").to_pylist(), batch.column("hash"), strict=True):
                keys = pickle.loads(made.as_py()).keys.view(np.int64)  # noqa: S301  written by `_built`
                for k in range(0, len(keys), 1 << 16):
                    own = keys[k:k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(own)) + offsets[part]), pa.array(own)], ["slot", "key"])

    return run


def _binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a level -> (chunk, counts): arrays of the counts of CHUNK slots."""
    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        for prior, in _arrays(batch, "prior"):
            slots = np.sort(_ints(prior))
            slots = slots[np.searchsorted(slots, 0):].astype(np.int64)
            edges = np.flatnonzero(np.diff(slots // CHUNK, prepend=-1))
            for own in np.split(slots, edges[1:]) if len(slots) else ():
                c = int(own[0] // CHUNK)
                counted = np.bincount(own - c * CHUNK, minlength=CHUNK)
                chunks[c] = chunks[c] + counted if c in chunks else counted
            if len(chunks) > HELD_CHUNKS:
                yield _chunk_rows(chunks)
                chunks = {}
    if chunks:
        yield _chunk_rows(chunks)


def _chunk_rows(chunks: dict[int, np.ndarray]) -> pa.RecordBatch:
    return _batch(list(chunks), [x.astype(np.int64).tobytes() for x in chunks.values()], names=["chunk", "counts"], kinds=[pa.int64(), pa.binary()])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, (counts,) in zip(batch.column("chunk").to_pylist(), _arrays(batch, "counts"), strict=True):
            chunks[c] = chunks[c] + _ints(counts, np.int64) if c in chunks else _ints(counts, np.int64)
    if chunks:
        yield _chunk_rows(chunks)


def _chunk_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c, (counts,) in zip(batch.column("chunk").to_pylist(), _arrays(batch, "counts"), strict=True):
            a = _ints(counts, np.int64)
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array(at + c * CHUNK), pa.array(a[at])], ["slot", "f"])


class _Search:
    """The levels of a corpus (lang, text)."""

    def __init__(self, docs: DataFrame, least: int):
        self.docs, self.least, self.spark = docs, least, docs.sparkSession
        counted = docs.mapInArrow(_count_words, "lang string, word binary, n long")
        self.words = Written(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).select("lang", F.col("word").cast("string").alias("word"), "n"), "words")
        self.langs = Written(self.words.df.groupBy("lang").agg(F.sum("n").alias("total")), "langs")
        total = self.langs.df.agg(F.sum("total")).first()[0] or 0
        self.shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * HELD_KEYS)))
        self.salt, tried = "", 0
        while True:
            n, different, zero = self.words.df.agg(F.count("*"), F.count_distinct(self.word_key()), F.max(self.word_key() == 0)).first()
            if n == different and not zero:
                break
            tried += 1
            self.salt = f"{tried} "

    def word_key(self) -> Column:
        return F.xxhash64(F.concat(F.lit(self.salt), "lang", F.lit("\t"), "word"))

    def hashed(self, keys: DataFrame) -> tuple[Written, list[int]]:
        """(part, n, hash) of different keys, and the first slot of each part."""
        keys = Written(keys, "keys")
        parts = max(1, -(-keys.df.count() // PART))
        made = Written(keys.df.mapInArrow(_with_share(parts), "part int, key long").groupBy("part").applyInArrow(_built, "part int, n long, hash binary"), "hashes")
        keys.drop()
        sizes = dict(made.df.select("part", "n").collect())  # a row for PART keys
        offsets = np.concatenate([[0], np.cumsum([sizes.get(k, 0) for k in range(parts)])]).tolist()
        if offsets[-1] >= 1 << 31:
            raise ValueError("a level has more than 2^31 phrases")
        return made, offsets

    def blocks(self, k: int, before: DataFrame, made: Written, offsets: list[int], *steps: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Written:
        """The corpus at level k, a pass for each part of its hash; `steps` make blocks of `before`."""
        parts, now = len(offsets) - 1, None
        for share in range(parts):
            row = made.df.where(F.col("part") == share).select("hash").first()
            of = self.spark.sparkContext.broadcast(pickle.loads(row[0]) if row else PerfectHash(np.zeros(0, _U)))  # noqa: S301
            look = _looked_up(k, of, share, parts, offsets[share])
            after = Written(now.df.mapInArrow(look, _FOUND) if now else before.mapInArrow(_chained(*steps, look), _FOUND), "blocks")
            if now:
                now.drop()
            now = after
            of.destroy()
        return now

    def counts(self, blocks: Written) -> DataFrame:
        """(slot, f), arrays being added by groups of tasks first."""
        binned = blocks.df.mapInArrow(_binned, "chunk long, counts binary").withColumn("branch", F.spark_partition_id() % BRANCHES)
        some = binned.repartition("chunk", "branch").drop("branch").mapInArrow(_added, "chunk long, counts binary")
        return some.repartition("chunk").mapInArrow(_chained(_added, _chunk_slots), "slot long, f long")

    def keys_of(self, made: Written, offsets: list[int]) -> DataFrame:
        return made.df.select("part", "hash").mapInArrow(_slot_keys(offsets), "slot long, key long")

    def levels(self) -> list[Written]:
        """Of each level (slot, f, lang, phrase, p, w, sfx, firsts, rests): firsts and rests have the counts on both sides of every cut, sfx the slot of the phrase without its first word."""
        frequent = self.words.df.where(F.col("n") >= self.least).withColumn("key", self.word_key())
        made, offsets = self.hashed(frequent.select("key"))
        one = self.keys_of(made, offsets).join(frequent, "key").select("slot", F.col("n").alias("f"), "lang", F.col("word").alias("phrase"))
        none = F.array().cast("array<long>")
        out = [Written(one.select("*", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("w"), F.lit(None).cast("long").alias("sfx"), none.alias("firsts"), none.alias("rests")), "level")]
        blocks = self.blocks(1, self.docs, made, offsets, _encoded(self.salt))
        made.drop()
        for k in range(2, LONGEST + 1):
            dealt = blocks.df.mapInArrow(_dealt(k, self.least, self.shards), "shard int, keys binary, counts binary")
            made, offsets = self.hashed(dealt.repartition(self.shards, "shard").mapInArrow(_survivors(self.least), "key long"))
            if not offsets[-1]:
                made.drop()
                break
            after = self.blocks(k, blocks.df, made, offsets)
            blocks.drop()
            blocks = after
            out.append(Written(self.level(k, out, self.counts(blocks).join(self.keys_of(made, offsets), "slot")), "level"))
            made.drop()
        blocks.drop()
        return out

    def level(self, k: int, levels: list[Written], rows: DataFrame) -> DataFrame:
        rows = rows.select("slot", "f", F.shiftrightunsigned("key", 32).alias("p"), F.col("key").bitwiseAND((1 << 32) - 1).alias("w"))
        first = levels[-1].df.select(F.col("slot").alias("p"), "lang", F.col("phrase").alias("head"), F.col("f").alias("head_f"), F.col("firsts").alias("head_firsts"), F.coalesce("sfx", F.lit(-1)).alias("head_sfx"))
        word = levels[0].df.select(F.col("slot").alias("w"), F.col("phrase").alias("last"))
        rows = rows.join(first, "p").join(word, "w")
        rest = levels[-1].df.select(F.col("slot").alias("sfx"), F.col("f").alias("rest_f"), F.col("rests").alias("rest_rests"), F.col("p").alias("rest_p"), F.col("w").alias("rest_w"))
        rows = rows.join(rest, F.col("sfx") == F.col("w") if k == 2 else (F.col("rest_p") == F.col("head_sfx")) & (F.col("rest_w") == F.col("w")))
        return rows.select("slot", "f", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "p", "w", "sfx", F.concat("head_firsts", F.array("head_f")).alias("firsts"), F.concat(F.array("rest_f"), "rest_rests").alias("rests"))


def _product(a: Column, b: Column) -> Column:
    """Exact beyond 64 bits."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score, as the module says.

    docs (lang, text; other columns aren't read). A null text has no words, a null language is `und`; repeated
    rows count as often as they stand there; an empty table gives no rows. Scores that tie go by a, then by
    the bytes of the phrase, so ranks are the same for any partitioning.
    """
    search = _Search(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), least)
    levels, found = search.levels(), None
    for k, level in enumerate(levels[1:], 1):
        rows = level.df
        if k + 1 < len(levels):  # a longer one as frequent as it is stands for it; then so does one that is longer by a word
            longer = levels[k + 1].df
            most = longer.select(F.col("p").alias("slot"), F.col("f").alias("g")).unionByName(longer.select(F.col("sfx").alias("slot"), F.col("f").alias("g"))).groupBy("slot").agg(F.max("g").alias("g"))
            rows = rows.join(most, "slot", "left").where("g is null or g < f")
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), F.arrays_zip("firsts", "rests").alias("cuts"))
        found = rows if found is None else found.unionByName(rows)
    spark = docs.sparkSession
    if found is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    # the totals of few languages, or of many by a shuffle
    joined = found.join(search.langs.df.withColumnRenamed("total", "n"), "lang")
    scored = joined.withColumn("above", _product(1000 * F.col("a"), F.col("n")))
    cut = F.array_min(F.transform("cuts", lambda c, i: F.struct(F.call_function("div", F.col("above"), _product(c["firsts"], c["rests"])).alias("score"), i.alias("k"), c["firsts"].alias("l"), c["rests"].alias("r"))))
    scored = scored.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, doc_id, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM ws GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, n, i, l.f AS l, r.f AS r, CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM cand) c JOIN totals USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:i], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[i + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS g FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.g >= 100 * b.a)
QUALIFY rank <= 2000
"""
