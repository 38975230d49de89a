"""Token counts by a finite-state transducer compiled from a byte-fallback BPE vocabulary.

The encoding of a prefix is known from its last token and the encoding before it, and a token may
follow another iff the two together are encoded as just these two. So after each character the
transducer has to remember the longest suffix that a piece may still continue, and for each position
in that suffix the last token there and the token count relative to the end. That is finite; the
transition by a character carries the number of tokens that it adds (it may be negative: "th" is one
token where "t", "h" would be two).

States and transitions are compiled when first met and kept, up to a bound beyond which the tables are
cleared and compiled anew. No piece reaches over the start of a run of spaces or a character outside
the vocabulary; there the transducer is back in its start state, whatever came before. A text is cut
into chunks of characters, whatever their content. The map of a chunk from start states to end states
and counts is: run up to the first such place, and a constant after it. Maps compose associatively, and
a scan composes those of a text's chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table, tidy

MODEL = "piece_bpe_32k.model"
MAX_TOKENS = 4096
CHUNK = 4096
#: Bounds of the compiled tables in one Python worker; reaching one clears them and changes no result.
MAX_STATES, MAX_WORDS, MAX_PAIRS, MAX_ENDS, WORD_CHARS = 300_000, 400_000, 1_000_000, 200_000, 64
NEVER = 1 << 62
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The (number, value) pairs of a protocol-buffer message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = {1: (8, i), 5: (4, i)}.get(key & 7) or varint(i)
            value, i = data[i:i + n], i + n
        yield key >> 3, value


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by falling priority; pieces of equal score share a rank and merge from the left."""
    ranks: dict[str, int]
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import struct

        pieces, spec, trainer = [], {}, {}
        for number, value in _fields(Path(path).read_bytes()):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        kinds = [kind for _, _, kind in pieces]
        if trainer.get(3) != 2 or kinds.count(6) != 256 or 4 in kinds or spec.get(1) != b"identity" or spec.get(4, 1):
            raise ValueError("only BPE models with byte fallback, no normalisation and no user-defined pieces can be compiled")
        scores = {s: k for k, s in enumerate(sorted({s for _, s, kind in pieces if kind == 1}, reverse=True))}
        return cls({p: scores[s] for p, s, kind in pieces if kind == 1}, bool(spec.get(3, 1)))


class State(dict):
    """Transitions compiled so far: character -> (next state, tokens added)."""

    __slots__ = ("counts", "last", "machine", "suffix")

    def __init__(self, machine: Transducer, suffix: str, last: tuple, counts: tuple):
        self.machine, self.suffix, self.last, self.counts = machine, suffix, last, counts

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.machine.compile(self, char)
        return found


class _Words(dict):
    """Counts of the words met so far, each run from the start state."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.run(self.machine.start, word)[1]
        if len(word) <= WORD_CHARS:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any start state: run `head`, then, if there is a `tail`, be in its state having added its count."""
    head: str
    tail: tuple[State, int] | None


class Transducer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.ranks = vocabulary, vocabulary.ranks
        self.prefixes = {p[:k] for p in self.ranks for k in range(1, len(p) + 1)}
        self.single = {p for p in self.ranks if len(p) == 1}
        if any(c not in self.single for p in self.ranks for c in p) or any(SPACE in p.lstrip(SPACE) for p in self.ranks):
            raise ValueError("a piece has a character that is no piece, or a space after another character")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.grown: dict[str, tuple[tuple, tuple] | None] = {}
        self.ends: dict[str, tuple[tuple, int]] = {}
        others = "".join(sorted(self.single - {SPACE}))
        self.sync = re.compile(f"(?<=[^{SPACE}]){SPACE}|[^{re.escape(others)}{SPACE}]", re.DOTALL)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.words = _Words(self)
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(self, "", (None,), (0,))

    def merge(self, text: str) -> list[str]:
        """The encoding by definition: the best-ranked neighbours merge first, from the left."""
        parts = list(text)
        while True:
            best = min(((self.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def growth(self, token: str) -> tuple[tuple, tuple] | None:
        """How a token comes about alone: (rank of the next merge, last part until then), and the same with the first part; None if its encoding isn't itself."""
        if token not in self.grown:
            parts, left, right = list(token), [], []
            while len(parts) > 1:
                rank, k = min(((self.ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.ranks), default=(NEVER, 0))
                if rank == NEVER:
                    break
                left.append((rank, parts[-1]))
                right.append((rank, parts[0]))
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            self.grown[token] = ((*left, (NEVER, token)), (*right, (NEVER, token))) if len(parts) == 1 else None
        return self.grown[token]

    def follows(self, a: str, b: str) -> bool:
        """Whether a and b, each its own encoding, stay apart in that of a + b: no merge over their border comes up while both grow."""
        if (a, b) in self.pairs:
            return self.pairs[a, b]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        left, right, rank_of = self.growth(a)[0], self.growth(b)[1], self.ranks.get
        i = j = 0
        while True:
            (next_left, x), (next_right, y) = left[i], right[j]
            over = rank_of(x + y, NEVER)
            if over < next_left and over <= next_right:
                break
            if next_left <= next_right:
                if next_left == NEVER:
                    break
                i += 1
            else:
                j += 1
        apart = self.pairs[a, b] = over == NEVER
        return apart

    def endings(self, text: str) -> tuple[tuple, int]:
        """(size, token) of the tokens that may end here, longest first, and how much of the text a piece may still continue."""
        if text not in self.ends:
            if len(self.ends) >= MAX_ENDS:
                self.ends.clear()
            tokens = tuple((size, text[-size:]) for size in range(len(text), 0, -1) if text[-size:] in self.ranks and self.growth(text[-size:]))
            self.ends[text] = tokens, next(k for k in range(len(text), -1, -1) if k == 0 or text[-k:] in self.prefixes)
        return self.ends[text]

    def compile(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.single:
            return self.start, len(char.encode())
        if char == SPACE and state.suffix and state.suffix[-1] != SPACE:
            return self.start[char]
        text, last, counts, pairs = state.suffix + char, state.last, state.counts, self.pairs
        tokens, keep = self.endings(text)
        for size, token in tokens:  # the longest that agrees with the token before it
            before = last[-size]
            if before is None or (pairs[before, token] if (before, token) in pairs else self.follows(before, token)):
                break
        else:
            raise AssertionError(f"no encoding of {text!r}")
        added = counts[-size] + 1
        suffix = text[len(text) - keep:]
        key = (suffix, (*last[len(last) - keep:], token), (*(c - added for c in counts[len(counts) - keep:]), 0))
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, *key)
        return found, added

    def run(self, state: State, text: str) -> tuple[State, int]:
        n = 0
        for char in text:
            state, added = state[char]
            n += added
        return state, n

    def chunk_map(self, chunk: str) -> ChunkMap:
        """By the first place where the state is known whatever came before."""
        found = self.sync.search(chunk)
        if not found:
            return ChunkMap(chunk, None)
        words = self.word.findall(chunk, found.start())
        state, n = self.run(self.start, words[-1])
        return ChunkMap(chunk[:found.start()], (state, n + sum(map(self.words.__getitem__, words[:-1]))))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.tail)
        state, n = self.run(a.tail[0], b.head)
        return ChunkMap(a.head, (b.tail[0], a.tail[1] + n + b.tail[1]) if b.tail else (state, a.tail[1] + n))

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan in rounds of doubling distance; those of a round are independent of each other."""
        step = 1
        while step < len(maps):
            maps = [self.compose(maps[k - step], m) if k >= step else m for k, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str) -> int:
        """The number of tokens of a whole text."""
        if not text:
            return 0
        if len(self.states) > MAX_STATES:
            self.clear()
        text = (SPACE if self.vocabulary.dummy_prefix else "") + text.replace(" ", SPACE)
        whole = self.scan([self.chunk_map(text[k:k + CHUNK]) for k in range(0, len(text), CHUNK)])[-1]
        return self.run(self.start, whole.head)[1] + (whole.tail[1] if whole.tail else 0)


_MACHINES: dict[str, Transducer] = {}


def _machine(model_path: str, vocabulary) -> Transducer:
    """The worker's transducer, kept with what it has compiled for later tasks."""
    return _MACHINES.get(model_path) or _MACHINES.setdefault(model_path, Transducer(vocabulary.value))


def count_tokens(docs: DataFrame, model_path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_bytes (UTF-8), n_tokens, over_limit. Null texts count as empty; other columns aren't read."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary.load(model_path))  # a vocabulary file's size
    out = docs.select(id_col).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model_path, vocabulary)
        for batch in batches:
            texts = batch.column("t_text")
            counts = [machine.count(t.as_py() or "") for t in texts]
            sizes = [0 if n is None else n for n in pc.binary_length(texts).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > max_tokens for n in counts], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, F.col(text_col).alias("t_text")).mapInArrow(run, out)


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
