"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

Texts are cut by the tokenizer's pattern where they lie, in blocks of documents; a block becomes one
row that holds its distinct words with the ranks of their neighbouring bytes, and for each document the sequence of its words by number. Spark
then folds the ranked merges over the byte array of each distinct word: an `aggregate` merges the
best-ranked neighbours, leftmost first, until none is left. The rank map is a literal: two arrays
addressed by the key of a pair of tokens (cuckoo hashing), as a lookup in a map literal would be
linear. Document ids are then strung together from those of the words. Decoding maps ids to their byte
pieces by a literal array and concatenates them (as Latin-1 strings, one character a byte, since Spark
joins arrays of strings only). Memory is bounded by a block, and nothing is shuffled.

Words that are one token need no fold, and the words of a bounded sample of texts are folded once
beforehand, as most words of a block are among them. The fold copies its arrays at each merge, so words
beyond WORD_BYTES are encoded by the same merges with a heap instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.llm.common import give_back, table, tidy

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text in a block; longest word that the fold takes.
BLOCK_CHARS = 8 << 20
#: Characters of text in a block of the pipeline's stage, whose workers share an executor with what earlier stages left.
STAGE_BLOCK_CHARS = 2 << 20
WORD_BYTES = 256
NO_RANK = 65535
#: Bits of a state that are a token's id.
ID = 0xFFFF
#: About how many texts, and of what length at most, give the words that are folded beforehand; so what is broadcast is bounded.
COMMON_TEXTS, COMMON_CHARS = 12_000, 16_000
#: Entry of the rank map where no pair is.
VACANT = 1 << 49
#: Documents strung together at a time.
STRUNG = 256
LATIN = "ISO-8859-1"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(bytes([k]) not in ranks for k in range(256)):
        raise ValueError("a byte has no rank")
    return ranks


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Ranks of joined pairs of tokens by cuckoo hashing: (a << 16 | b) << 16 | rank, in the first table at its key (the entry without the rank) modulo the table's odd size or in the second at its."""
    keys = {ranks[p[:k]] << 16 | ranks[p[k:]]: r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}
    size = 9 * len(keys) // 8 | 1  # loads below a half
    while True:
        tables = [[VACANT] * size, [VACANT] * (size + 2)]
        for entry in (k << 16 | r for k, r in keys.items()):
            for kick in range(500):
                t = tables[kick & 1]
                at = (entry & ~NO_RANK) % len(t)
                t[at], entry = entry, t[at]
                if entry == VACANT:
                    break
            else:
                break
        else:
            return tuple(tables)
        size += 10


class RankMap:
    """The literal rank map as a column, to be bound to a lambda variable: struct of the two tables."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NO_RANK:
            raise ValueError("ids of more than 16 bits don't fit the pair table")
        first, second = pair_table(ranks)
        self.sizes = len(first), len(second)
        self.literal = F.from_json(F.lit(json.dumps([first, second])), "array<array<bigint>>")

    def pair(self, tables: Column, a: Column, b: Column) -> Column:
        """The rank of two neighbouring tokens joined, or NO_RANK; b may be null.

        An entry XOR the key leaves the rank if the entry is the key's, and more than any rank if not.
        """
        entries = lambda key: [tables[t][key % F.lit(size)].bitwiseXOR(key) for t, size in enumerate(self.sizes)]
        return _let(F.shiftleft(a, 32).bitwiseOR(F.shiftleft(b, 16)), lambda key: F.least(*entries(key), F.lit(NO_RANK).cast("bigint")))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a fold over nothing. (An element of `transform` would have the type of the whole body derived anew for each row.)"""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def byte_states(data: bytes, ends: np.ndarray, ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """What `encode_word` starts from, for words given as their bytes one after the other: ids by byte, ranks of joined bytes by pair of bytes."""
    b = np.frombuffer(data, np.uint8)
    rank = np.full(len(b), NO_RANK, np.int64)
    rank[:-1] = pairs[b[:-1], b[1:]]
    rank[ends[1:] - 1] = NO_RANK
    return rank << 40 | (np.arange(len(b)) - np.repeat(ends[:-1], np.diff(ends))) << 16 | ids[b]


def byte_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    return np.array([[ranks.get(bytes([a, b]), NO_RANK) for b in range(256)] for a in range(256)], np.int64)


def encode_word(ranks: RankMap, tables: Column, word: Column) -> Column:
    """array<bigint> whose lower 16 bits are the token ids of a word given as the states of its single bytes (`byte_states`).

    The state is one number for each token: the rank of its join with the next << 40 | its first
    byte's place << 16 | its id. The least of them is the next merge, leftmost among equal ranks.
    """
    wide = lambda n: F.lit(n).cast("bigint")
    token = lambda e: e.bitwiseAND(wide(ID))
    ranked = lambda a, b: F.shiftleft(ranks.pair(tables, a, b), 40)
    none = F.array().cast("array<bigint>")

    def merge(s: Column, least: Column, k: Column) -> Column:
        """Joins the tokens k and k + 1 (from 1); the id of the joined token is its rank."""
        best, before = F.shiftright(least, 40), F.get(s, k - 2)
        joined = ranked(best, token(F.get(s, k + 1))).bitwiseOR(least.bitwiseAND(wide(0xFFFFFF0000))).bitwiseOR(best)
        left = F.when(k > 1, F.array(ranked(token(before), best).bitwiseOR(before.bitwiseAND(wide(0xFFFFFFFFFF))), joined)).otherwise(F.array(joined))
        return F.concat(F.when(k > 2, F.slice(s, 1, k - 2)).otherwise(none), left, F.slice(s, k + 2, F.size(s)))

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s), lambda least: F.when(least >= wide(NO_RANK << 40), s).otherwise(_let(F.array_position(s, least).cast("int"), lambda k: merge(s, least, k))))

    return F.aggregate(F.sequence(F.lit(2), F.size(word)), word, step)


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of array<int>; null for null. Ids beyond the vocabulary have no bytes."""
    by_id = {rank: piece.decode("latin-1") for piece, rank in ranks.items()}
    pieces = F.from_json(F.lit(json.dumps([by_id.get(k) for k in range(max(by_id) + 1)])), "array<string>")
    joined = _let(pieces, lambda p: F.array_join(F.transform(ids, lambda i: F.get(p, i)), ""))
    return F.encode(joined, LATIN)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap, in n log n steps."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k:k + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, k, stop = heapq.heappop(heap)
        j = after[k] if alive[k] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[k], after[k] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = k
            if (r := ranks.get(word[k:end[after[j]]])) is not None:
                heapq.heappush(heap, (r, k, end[after[j]]))
        if before[k] >= 0 and (r := ranks.get(word[before[k]:stop])) is not None:
            heapq.heappush(heap, (r, before[k], stop))
    return [ranks[word[k:end[k]]] for k in range(n) if alive[k]]


class Known:
    """The ids of words that are known beforehand, those folded for it and after them one for each token, all in one array."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = max(ranks.values()) + 1
        self.ids, self.edges = np.arange(self.vocabulary, dtype=np.int32), np.arange(self.vocabulary + 1, dtype=np.int64)

    def put(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """`ids` are those of the folded words one after the other."""
        self.ids = np.concatenate([ids.astype(np.int32), self.ids])
        self.edges = np.concatenate([[0], np.cumsum(np.concatenate([sizes, np.ones(self.vocabulary, np.int64)]))])


class _Numbers(dict):
    """Numbers of a block's words in order of appearance."""

    def __init__(self):
        self.short, self.long = [], []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k

    def settle(self, ranks: dict[bytes, int], known: Words, vocabulary: int) -> np.ndarray:
        """By number so far the final one, from 0 for the words to be folded; known words get -1 - their number there, those of one token and then those beyond WORD_BYTES go on from these."""
        words = [word.encode() for word in self]
        self.clear()
        base, out = len(known.hashes), -1 - known.find(words)
        for k in np.flatnonzero(out == 0).tolist():
            data = words[k]
            if (rank := ranks.get(data)) is not None:
                out[k] = -1 - base - rank
            elif len(data) > WORD_BYTES:
                self.long.append(merge_long(data, ranks))
                out[k] = -base - vocabulary - len(self.long)
            else:
                self.short.append(data)
                out[k] = len(self.short) - 1
        return out

    def states(self, ids: np.ndarray, pairs: np.ndarray) -> pa.Array:
        """The words to be folded, as arrays of the states of their bytes."""
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.short), np.int32, len(self.short)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(byte_states(b"".join(self.short), ends, ids, pairs), pa.int64()))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_BLOCK = pa.schema([("rows", pa.binary()), ("words", pa.list_(pa.list_(pa.int64()))), ("long", pa.list_(pa.list_(pa.int32()))), ("numbers", pa.binary()), ("lengths", pa.binary())])


_BLOCK_FIELDS = "rows binary, words array<array<bigint>>, long array<array<int>>, numbers binary, lengths binary"


def _blocks(docs: DataFrame, shared, words: Words, pattern: str, keep: list[str], block_chars: int) -> DataFrame:
    """One row for each block of documents: the kept columns, the words to be folded, the ids of long words, and the documents' words by number."""
    # white space as Unicode has it, not as Python
    given = docs.sparkSession.sparkContext.broadcast(words)
    cut = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(cut)
        by_byte, pairs = np.array([shared.value[bytes([k])] for k in range(256)], np.int64), byte_pairs(shared.value)
        vocabulary = max(shared.value.values()) + 1
        for batch in batches:
            texts, begin = batch.column("b_text"), 0
            while begin < batch.num_rows:
                numbers, sequences, lengths, size = _Numbers(), [], [], 0
                while begin + len(lengths) < batch.num_rows and size < block_chars:
                    text = texts[begin + len(lengths)].as_py() or ""
                    size += len(text)
                    found = (m.group() for m in compiled.finditer(text)) if len(text) > 1 << 20 else compiled.findall(text)
                    sequences.append(np.fromiter(map(numbers.__getitem__, found), np.int32))
                    lengths.append(len(sequences[-1]))
                rows = batch.select(keep).slice(begin, len(lengths))
                sequences = numbers.settle(shared.value, given.value, vocabulary)[np.concatenate(sequences)]
                short = numbers.states(by_byte, pairs)
                out = pa.RecordBatch.from_arrays([pa.array([_ipc(rows)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), short), pa.array([numbers.long], pa.list_(pa.list_(pa.int32()))),
                                                  pa.array([sequences.tobytes()], pa.binary()), pa.array([np.array(lengths, np.int32).tobytes()], pa.binary())], schema=_BLOCK)
                begin += len(lengths)
                del numbers, sequences, short
                yield out
        # workers stay for later stages, which don't need the words; another partition loads them again
        if getattr(given, "_path", None):
            vars(given).pop("_value", None)

    return docs.mapInArrow(run, _BLOCK_FIELDS)


class Words:
    """Different words by rising hash, their bytes one after the other; a worker looks them up by the hashes, which take far less memory than a dict of strings."""

    def __init__(self, data: bytes, ends: np.ndarray, hashes: np.ndarray):
        self.data, self.ends, self.hashes = data, ends, hashes

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if it isn't among these."""
        out = np.full(len(words), -1, np.int32)
        if len(words) and len(self.hashes):
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = np.flatnonzero(self.hashes[at] == hashes)
            at = at[same]
            for k, n, a, b in zip(same.tolist(), at.tolist(), self.ends[at].tolist(), self.ends[at + 1].tolist(), strict=True):
                if self.data[a:b] == words[k]:
                    out[k] = n
        return out

    def numbers(self) -> dict[str, int]:
        ends = self.ends.tolist()
        return {self.data[a:b].decode(): k for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))}


NO_WORDS = Words(b"", np.zeros(1, np.int32), np.zeros(0, np.uint64))
_PACKED_FIELDS = "hashes binary, data binary, sizes binary, ids binary, counts binary"


def _packed(byte_of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(words, coded) of blocks -> the words' hashes, bytes and lengths and their ids and numbers of ids, each as the bytes of one array."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, coded in zip(batch.column("words"), batch.column("coded"), strict=True):
                if len(words):
                    ends, edges = (x.values.offsets.to_numpy() for x in (words, coded))
                    data = byte_of[words.values.flatten().to_numpy() & ID].tobytes()
                    ends = ends - ends[0]
                    hashes = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.uint64, len(words))
                    parts = hashes, data, np.diff(ends).astype(np.int32), (coded.values.flatten().to_numpy() & ID).astype(np.uint16), np.diff(edges).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in parts], ["hashes", "data", "sizes", "ids", "counts"])

    return run


def known_words(docs: DataFrame, ranks: dict[bytes, int], folded: Column, shared, pattern: str, text_col: str = "text") -> tuple[Words, Known]:
    """The words of about COMMON_TEXTS different texts, chosen by their hash, with the ids that Spark folds; it only saves folding them in each block.

    Copies share a hash, so texts are made distinct, map-side first; a group of copies counts once in what reaches the driver.
    There words stay bytes in arrays. Of words that several blocks have, and of such as share a hash, one is kept; a block folds the other itself.
    """
    out = Known(ranks)
    share = min(1.0, COMMON_TEXTS / max(1, docs.count()))
    few = docs.select(F.col(text_col).alias("b_text")).where(F.length("b_text") <= COMMON_CHARS).where(F.pmod(F.xxhash64("b_text"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).distinct()
    byte_of = np.zeros(out.vocabulary, np.uint8)
    for k in range(256):
        byte_of[ranks[bytes([k])]] = k
    coded = _blocks(few, shared, NO_WORDS, pattern, [], BLOCK_CHARS).select("words", folded.alias("coded"))
    got = coded.mapInArrow(_packed(byte_of), _PACKED_FIELDS).toArrow()
    if not len(got):
        return NO_WORDS, out
    hashes, data, sizes, ids, counts = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in got[c]]) for c, kind in (("hashes", np.uint64), ("data", np.uint8), ("sizes", np.int32), ("ids", np.uint16), ("counts", np.int32)))
    hashes, kept = np.unique(hashes, return_index=True)
    starts = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    data, ends = _strung(data, starts(sizes), kept)
    out.put(_strung(ids, starts(counts), kept)[0], counts[kept])
    words = Words(data.tobytes(), ends, hashes)
    del got, hashes, data, sizes, ids, counts
    give_back()
    return words, out


def _strung(ids: np.ndarray, edges: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words `numbers` one after the other, and where each begins; `ids` from edges[k] to edges[k + 1] are those of word k."""
    first, size = edges[numbers], edges[numbers + 1] - edges[numbers]
    ends = np.concatenate([[0], np.cumsum(size)])
    return ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])], ends


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns in `keep`, token_ids array<int> and ids_sha256 for every row; null and empty texts have no tokens.

    Each match of the pattern is encoded by itself, without special tokens. ids_sha256 is of the ids as
    little-endian unsigned 32-bit integers. Repeated rows stay repeated; other columns aren't read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary file's size
    kept = docs.select(*keep).schema
    ranked = RankMap(ranks)
    folded = _let(ranked.literal, lambda tables: F.transform("words", lambda w: encode_word(ranked, tables, w)))
    words, ids_known = known_words(docs, ranks, folded, shared, pattern, text_col)
    known = spark.sparkContext.broadcast(ids_known)

    @tidy
    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                numbers, lengths = (np.frombuffer(batch.column(c)[k].as_py(), np.int32) for c in ("numbers", "lengths"))
                flat, edges, total = [known.value.ids], [known.value.edges], known.value.edges[-1]
                for part in (batch.column("long")[k].values, batch.column("coded")[k].values):
                    offsets = part.offsets.to_numpy().astype(np.int64) if len(part) else np.zeros(1, np.int64)
                    flat.append((part.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False) & ID).astype(np.int32))
                    edges.append(offsets[1:] - offsets[0] + total)
                    total += offsets[-1] - offsets[0]
                folded_from = sum(map(len, edges[:-1])) - 1
                ids_of, edges = np.concatenate(flat), np.concatenate(edges)
                rows = pa.ipc.open_stream(batch.column("rows")[k].as_py()).read_all().combine_chunks().to_batches()[0]
                places = np.concatenate([[0], np.cumsum(lengths)])
                for begin in range(0, len(lengths), STRUNG):
                    end = min(begin + STRUNG, len(lengths))
                    here = numbers[places[begin]:places[end]].astype(np.int64)
                    ids, ends = _strung(ids_of, edges, np.where(here >= 0, here + folded_from, -1 - here))
                    offsets = ends[places[begin:end + 1] - places[begin]]
                    digests = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
                    yield pa.RecordBatch.from_arrays([*rows.slice(begin, end - begin).columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(digests)], [*keep, "token_ids", "ids_sha256"])

    cut_up = _blocks(docs.select(*keep, F.col(text_col).alias("b_text")), shared, words, pattern, list(keep), block_chars)
    coded = cut_up.select("rows", "long", "numbers", "lengths", folded.alias("coded"))
    out = StructType([*kept.fields, *StructType.fromDDL("token_ids array<int>, ids_sha256 string").fields])
    return coded.mapInArrow(strung, out)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns in `keep`, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to) for every row."""
    ranks = load_ranks(ranks_path)
    coded = encode_documents(docs, ranks, pattern, keep, block_chars=block_chars)
    return coded.select(*keep, F.size("token_ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(decode_ids(F.col("token_ids"), ranks), 256).alias("decoded_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: what op7 returns, for the documents that are left."""
    import public_tokenizers

    return round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, block_chars=STAGE_BLOCK_CHARS)
