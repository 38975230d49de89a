"""The filter audit, SimHash near-duplicates and collocations against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string"


def clashing(df, names):
    return df.withColumns({c: F.lit("x") for c in names})


# Filter audit.

def audited(rows, labels):
    """The report by walking every order over every document."""
    parts, told = {}, {}
    for i, q, t in labels:
        g, x = told.get(i, (0, 0))
        told[i] = (max(g, int(q == 1)), max(x, int(t == 1)))
    for i, text, _, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in rows)}
        parts.setdefault(source or "", []).append((fails, *(told.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part, docs in parts.items():
        removed_in_all = Counter()
        for order in permutations("ABCDE"):
            live = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in live if d[0][f]]
                live = [d for d in live if not d[0][f]]
                removed_in_all[f] += len(gone)
                out[part, "".join(order), step] = [len(live), len(gone), sum(d[0][f] for d in docs) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_in_all[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(rng):
    say = lambda n, size: " ".join(rng.choice(["w", "W", "é", "日"]) + str(rng.randrange(size)) for _ in range(n))
    texts = [None, "", " \t\n", "one", "a | b", "x" * 200_000, "\x1c\x85 \x00", say(40_000, 9000), *(say(rng.randrange(30, 80), rng.choice([20, 5000])) for _ in range(60))]
    rows = [(k, t, "en", rng.choice(["s1", "s2", None, ""])) for k, t in enumerate(texts)]
    rows += [(1000 + k, rng.choice(texts[8:14]), None, "s1") for k in range(60)]
    return rows + [(3, "one", "en", "s1"), (3, "one", "en", "s1"), (None, "one", "en", "s2"), (None, texts[9], None, None), (2000, "", None, "s2")]


def test_audit_equals_walking_every_order(spark, monkeypatch):
    from marlstone.llm import filter_audit

    rng = random.Random(3)
    rows = audit_rows(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, *_ in rows if rng.random() < 0.6] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, DOCS), ["part", "mask", "n", "label_id", "good", "toxic", "quality"]).repartition(7)
    told = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ["good", "text", "source"])
    for block in (filter_audit.BLOCK_BYTES, 2000):  # blocks that hold all rows, and a few
        monkeypatch.setattr(filter_audit, "BLOCK_BYTES", block)
        got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, told).collect()}
        assert got == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), told).count() == 0
    none = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, told.limit(0)).collect()}
    assert none == audited(rows, [])


def test_chains_keep_texts_of_one_fingerprint_apart():
    from marlstone.llm.filter_audit import COPY, Chains

    chains = Chains()
    assert chains.add(7, b"a", None, 5, {"p": 1}) == [] and chains.add(7, b"b", None, 4, {"p": 1}) == []
    assert chains.add(7, b"a", None, 3, {"q": 2}) == [(5, "p", COPY | 1, 1)]
    assert chains.add(7, b"a", None, 3, {"q": 1}) == []
    assert chains.add(7, b"b", None, 9, {"r": 1}) == [(9, "r", COPY | 1, 1)]
    assert sorted(e[0:1] + e[2:] for _, e in chains.rest()) == [(b"a", 3, {"q": 3}), (b"b", 4, {"p": 1})]


# SimHash.

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(f, least=4):
    """The smallest index that each fingerprint reaches."""
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= least
    for a, b in np.argwhere(np.triu(near, 1)):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(f))]


def test_ring_chains_find_every_component():
    from marlstone.llm import simhash_dedup as s

    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    crowd = []
    for x in f[:15]:
        for _ in range(120):
            y = int(x)
            for b in rng.integers(0, 64, rng.integers(0, 10)):
                y ^= 1 << int(b)
            crowd.append(y)
    f = np.unique(np.concatenate([f, np.array(crowd, np.uint64), np.array([0, 1, 15, 31, (1 << 64) - 1], np.uint64)]))
    keys, of, probe = s.ring_keys(f)
    order = np.argsort(keys, kind="stable")
    a, b = s.links(keys[order].astype(np.int32), of[order], probe[order])
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) < len(keys)
    at, parent = {int(x): k for k, x in enumerate(f)}, list(range(len(f)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(at[x]), find(at[y])
        parent[max(x, y)] = min(x, y)
    assert [find(k) for k in range(len(f))] == roots(f)


@pytest.mark.parametrize("size", [1, 3, 4, 5, 70])
def test_fingerprints_are_majorities_of_hashes(size):
    from marlstone.llm.simhash_dedup import fingerprint

    rng = random.Random(size)
    for _ in range(20):
        text = rng.choice([" ", "\n", "\t "]).join(rng.choice(["Ab", "é", "x\x85y", "日本", "C\x1c"]) + str(rng.randrange(9)) for _ in range(size))
        assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_simhash_components_equal_brute_force(spark):
    from marlstone.llm.simhash_dedup import near_duplicates

    rng = random.Random(9)
    say = lambda n: [f"W{rng.randrange(400)}" for _ in range(n)]
    texts = [None, "", " \n", "one", "One", "a b c", "a b c d", "x" * 100_000, " ".join(say(30_000))]
    for _ in range(25):
        base = say(300)
        texts.append(" ".join(base))
        for _ in range(8):
            other = list(base)
            for _ in range(rng.randrange(1, 5)):
                other[rng.randrange(300)] = "changed"
            texts.append(" ".join(other))
    rows = [(k, t) for k, t in enumerate(texts)] + [(7000, texts[9]), (7000, texts[9]), (None, texts[9]), (None, "alone here")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ["fp", "key", "root", "node", "rep", "probe"])
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect())
    f = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    root = roots(f)
    least = {}
    for (i, _), k in zip(rows, root, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    assert got == Counter((i, f"{int(x):016x}", least.get(k)) for (i, _), x, k in zip(rows, f, root, strict=True))
    assert len({k for k in root}) < len(texts) - 60
    assert near_duplicates(docs.limit(0)).count() == 0


# Collocations.

def plain_collocations(rows, least, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i:i + m] for p, a in held.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * f[p[i:i + m]]}
        rows_ = []
        for p, a in held.items():
            if p not in covered:
                score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def corpus(rng):
    phrases = [" ".join(rng.choice(["An", "der", "é", "日", "x", "y"]) + str(rng.randrange(4)) for _ in range(rng.randrange(2, 8))) for _ in range(30)]
    rows = [(rng.choice(["en", "de", None]), " ".join(rng.choice(phrases) + rng.choice(["", ".", ",", "\n", "\x0b", " ?", "\x1c", "\t"]) for _ in range(rng.randrange(1, 40)))) for _ in range(150)]
    rows += [("en", None), (None, ""), (None, " . , \n"), ("fr", "only words here"), ("en", "tie one tie one " * 3000), ("en", rows[0][1]), ("en", rows[0][1])]
    return rows


def test_collocations_equal_brute_force(spark, monkeypatch):
    from marlstone.llm import phrases

    rows = corpus(random.Random(11))
    docs = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(6), ["n", "f", "slot", "word", "key", "total", "a", "rank", "p"])
    assert sorted(tuple(r) for r in phrases.collocations(docs, least=12).collect()) == plain_collocations(rows, 12, phrases.TOP)
    # several parts of a hash, small chunks and blocks, short ranks
    for name, value in (("PART", 40), ("CHUNK", 8), ("HELD_CHUNKS", 2), ("HELD_KEYS", 50), ("BLOCK_WORDS", 20), ("RANK_PARTS", 3)):
        monkeypatch.setattr(phrases, name, value)
    assert sorted(tuple(r) for r in phrases.collocations(docs.limit(1000), least=30, top=7).collect()) == plain_collocations(rows, 30, 7)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b. c")], "lang string, text string"), least=1).count() == 1


def test_perfect_hash_is_minimal_and_tells_strangers():
    from marlstone.llm.phrases import PerfectHash

    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    made = PerfectHash(keys[::2])
    assert sorted(made.lookup(keys[::2])) == list(range(len(keys[::2]))) and (made.lookup(keys[1::2]) == -1).all()
    assert (made.keys[made.lookup(keys[::2])] == keys[::2]).all()
    assert (PerfectHash(keys[:0]).lookup(keys[:5]) == -1).all()
    assert PerfectHash(np.array([0], np.uint64)).lookup(np.array([0, 1], np.uint64)).tolist() == [0, -1]


def test_products_beyond_64_bits_are_exact(spark):
    from marlstone.llm.phrases import _product

    a, n, left, right = 9_000_000_000_000, 20_000_000_000_000, 10_000_000_000_001, 9_999_999_999_999
    got = spark.range(1).select(F.call_function("div", _product(F.lit(1000 * a), F.lit(n)), _product(F.lit(left), F.lit(right)))).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_words_held_by_a_task_are_bounded_over_all_languages():
    import tracemalloc

    import pyarrow as pa

    from marlstone.llm import phrases

    rows = [(f"l{k % 20}", " ".join(f"w{j}x{k}" for j in range(3000))) for k in range(200)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text])], ["lang", "text"]) for lang, text in rows])
    for step in (phrases._encoded(""), phrases._count_words):
        tracemalloc.start()
        for _ in step(batches()):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30e6  # 600,000 words
