"""Each operator against brute force, a library or an exact round trip, with nulls, empty and long texts, repeats and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=lambda k: "s", extra=False):
    rows = [(k, t, "en", source(k), len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    # names that the operators use themselves
    return df.withColumns({c: F.lit("x") for c in ("n", "fp", "key", "score", "kept", "tk", "host", "ld_bad2", "rows", "words")}) if extra else df


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts():
    return [None, "", " ", "\n\n", "one", "a b c d", "a b c d", "é ß 日本 😀", "x" * 5000, "\x00\x1c\x85", "word " * 3000]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Quality.

def test_quality_learns_from_positives_and_unlabelled_text(spark):
    from marlstone.llm import quality

    rng = random.Random(1)
    good = [prose(rng, 60) + "." for _ in range(300)]
    bad = ["SPAM!! " * rng.randrange(20, 60) for _ in range(120)]
    docs = documents(spark, good + bad + odd_texts(), extra=True)
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 420, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert len(rows) == 420 + len(odd_texts())
    assert np.mean([rows[k].predicted == (k < 300) for k in range(1, 420, 2)]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert quality.score_documents(empty(spark), model).count() == 0
    nothing = quality.train(empty(spark), labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, nothing).collect()} == {quality.DEFAULT_PRIOR}


def test_risk_gradient_matches_differences():
    from marlstone.llm.quality import risk_gradient

    zp, zu = np.array([0.3, -1.0]), np.array([2.0, 1.5, -0.2])
    _, gp, gu = risk_gradient(zp, zu, 0.4)
    for z, g, k in ((zp, gp, 0), (zu, gu, 1)):
        for i in range(len(z)):
            up, down = z.copy(), z.copy()
            up[i] += 1e-6
            down[i] -= 1e-6
            a, b = (risk_gradient(x, zu, 0.4)[0] if k == 0 else risk_gradient(zp, x, 0.4)[0] for x in (up, down))
            assert abs((a - b) / 2e-6 - g[i]) < 1e-5


# Licences.

def test_license_scan_finds_lines_runs_and_whole_texts(spark):
    from marlstone.llm import license_scan as ls

    mit = next(t for n, t in ls.TEMPLATES if n == "mit" and len(t) > 100)
    wrapped = mit.replace(", ", ",\n")
    texts = ["prose\nReleased under the MIT License.\nmore", "intro of a file\n" + wrapped + "\ncode follows here", "Released under the BSD Licence", *odd_texts()]
    docs = documents(spark, texts, extra=True)
    got = {r.doc_id: r for r in ls.scan_licenses(docs).collect()}
    assert (got[0].license, got[0].n_matches) == ("mit", 1) and got[1].license == "mit" and got[2].license is None
    assert len(got) == len(texts) and all(r.n_matches == 0 for k, r in got.items() if k > 2)
    spans = {(r.doc_id, r.first_line) for r in ls.license_spans(docs).collect()}
    assert spans == {(0, 1), (1, 1)}
    assert ls.scan_licenses(empty(spark)).count() == 0


def test_license_bounds_drop_no_match():
    from marlstone.llm import license_scan as ls

    rng, known = random.Random(2), ls.Templates(ls.TEMPLATES)
    for _, text in ls.TEMPLATES:
        for _ in range(20):
            ws = [w for w in ls.words(text.encode()) if rng.random() > 0.05]
            unit = ls.bigrams(ws)
            brute = max(2 * len(unit & s) / (len(unit) + len(s)) for s in (ls.bigrams(ls.words(t.encode())) for _, t in ls.TEMPLATES)) if unit else 0
            found = known.best(unit)
            assert (found[0] if found else 0) == (brute if brute >= ls.THRESHOLD else 0)


def test_license_scan_finds_neighbouring_texts():
    from marlstone.llm import license_scan as ls

    rng, known = random.Random(3), ls.Templates(ls.TEMPLATES)
    full = [(n, t) for n, t in ls.TEMPLATES if len(ls.words(t.encode())) > 40]

    def wrap(text):
        ws, out = text.split(), []
        while ws:
            n = rng.randrange(6, 14)
            out.append(" ".join(ws[:n]))
            ws = ws[n:]
        return out

    for a, x in full:
        for b, y in full:
            if {a, b} == {"bsd-2-clause", "bsd-3-clause"}:  # one contains most of the other
                continue
            for gap in ([], ["", ""]):
                got = {name for _, _, name, dice in known.scan("\n".join(["prose before it", *wrap(x), *gap, *wrap(y), "and after it"]).encode()) if dice >= ls.THRESHOLD}
                assert {a, b} <= got, (a, b, got)
    # windows are those of brute force
    for _ in range(6):
        lines = [w for _ in range(2) for w in wrap(" ".join(w for w in rng.choice(full)[1].split() if rng.random() > 0.02))]
        lines.insert(rng.randrange(len(lines)), "")
        lines += [lines[0]] * 3
        units = [ls.words(w.encode()) for w in lines]
        every = [(-h[0], j - i, i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if (h := known.best(ls.bigrams([w for ws in units[i:j + 1] for w in ws])))]
        taken = []
        for _, _, i, j in sorted(every):
            if all(j < p or q < i for p, q in taken):
                taken.append((i, j))
        assert known._windows(units, 0, len(lines) - 1) == sorted(taken) and taken
    # a long text of few distinct bigrams is compared as a whole
    mit = next(t for n, t in full if n == "mit")
    assert known.scan("\n".join([mit] * 300).encode()) != [] and {x[2] for x in known.scan("\n".join(("filler " * 3 + mit).split() * 100).encode())} == {"mit"}


# Near duplicates.

def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def test_near_duplicates_equal_brute_force(spark):
    from marlstone.llm import near_dedup

    rng, texts = random.Random(3), []
    for _ in range(12):
        base = prose(rng, rng.randrange(30, 200)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [prose(rng, 50) for _ in range(20)] + odd_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts, extra=True)).collect()}
    assert got == brute_components(texts)


def matrix_components(texts):
    """brute_components by the matrix of all intersections."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    number = {}
    ones = np.zeros((len(sets), sum(map(len, sets))), np.float32)
    for k, s in enumerate(sets):
        ones[k, [number.setdefault(e, len(number)) for e in s]] = 1
    ones = ones[:, :len(number)]
    common, n = ones @ ones.T, ones.sum(1)
    root = np.arange(len(sets))
    link = (100 * common >= 75 * (n[:, None] + n - common)) & (n[:, None] > 0) & (n > 0)
    while True:
        least = np.where(link, root, len(sets)).min(1)
        after = np.minimum(root, least)
        if (after == root).all():
            return {k: (int(n[k]), int(root[k])) for k in range(len(sets))}
        root = after


def crowd(rng, n):
    """Copies of one text around the threshold, longer and shorter ones, chains of copies of copies, and texts that share a passage only."""
    base, texts = prose(rng, 150).split(), []
    for k in range(n):
        copy = list(rng.choice(texts).split() if k % 5 == 4 else base)
        for _ in range(rng.randrange(0, 10)):
            at = rng.randrange(len(copy))
            copy[at:at + 1] = [[f"z{rng.randrange(10**6)}"], [], [copy[at], f"y{rng.randrange(300)}"]][0 if k % 3 else rng.randrange(3)]
        texts.append(" ".join(copy))
    passage = prose(rng, 60)
    return texts + [f"{prose(rng, rng.randrange(20, 90))} {passage} {prose(rng, rng.randrange(5, 60))}" for _ in range(n // 2)] + [passage]


def test_crowded_bands_equal_brute_force(spark, monkeypatch):
    from marlstone.llm import near_dedup

    texts = crowd(random.Random(11), 1000)
    want = matrix_components(texts)
    made = []
    monkeypatch.setattr(near_dedup._Job, "verified", lambda self, pairs, run=near_dedup._Job.verified: made.append(pairs.df.count()) or run(self, pairs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == want
    singles = sum(k == c for k, (_, c) in want.items())
    assert 300 < singles < len(texts) and max(made) < 12 * len(texts)  # far from the 500,000 pairs of the copies


def test_crowded_bands_join_few_of_their_elements(spark, monkeypatch):
    from marlstone.llm import near_dedup

    made = {}

    class Counted(near_dedup.Written):
        def __init__(self, df, label):
            super().__init__(df, label)
            if label in ("told", "rare", "prefixes"):
                size = next((F.size(c) for c in ("elements", "found") if c in self.df.columns), F.lit(1))
                made[label] = made.get(label, 0) + (self.df.agg(F.sum(size)).first()[0] or 0)

    monkeypatch.setattr(near_dedup, "Written", Counted)
    texts = crowd(random.Random(12), 400)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(spark, texts)).collect()}
    assert got == matrix_components(texts)
    assert 10_000 < made["told"] and made.get("rare", 0) + made["prefixes"] < made["told"] / 2


def test_near_duplicates_with_null_ids_repeats_and_nothing(spark):
    from marlstone.llm import near_dedup

    rows = [(None, "a b c d e f", "", "", 0), (5, "a b c d e f", "", "", 0), (5, "a b c d e f", "", "", 0), (7, "x", "", "", 0), (None, "y", "", "", 0)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (5, 5, True), (7, 7, True), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_sketch_fills_and_estimates():
    from marlstone.llm.near_dedup import T, sketch

    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60, 3000):
        assert sketch(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))).max() < np.iinfo(np.uint64).max
    common, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (800, 100, 100))
    same = (sketch(np.concatenate([common, a])) == sketch(np.concatenate([common, b]))).sum() / T
    assert abs(same - 0.8) < 0.15


# Urls.

def test_url_filter_equals_a_scan_of_all_rules(spark):
    from marlstone.llm import url_filter as uf

    rng = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.net", "example.net", "x.org", "community.org", "EXAMPLE.com", "xexample.com", ""]
    paths = ["", "/", "/en/", "/en/7", "/en/712?x#y", "/de/8", "/de/9", "/es/1", "?q=/en/", "#/en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)] + [None, "", "no scheme/en/", "://", "http://a://b/en/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.filter_urls(pages, uf.RULES).collect()}
    for k, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h), len(p), h + p, a) for a, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[k] == (host, path, *((max(fits)[2], max(fits)[3]) if fits else (None, "allow"))), u
    assert uf.filter_urls(pages.limit(0), uf.RULES).count() == 0 and uf.filter_urls(pages, []).count() == len(urls)


# Lines.

def test_line_dedup_drops_lines_by_site(spark, monkeypatch):
    from marlstone.llm import line_dedup as ld

    texts = [f"menu\nbody {k}\n\n" + ("rare" if k < 3 else "x") for k in range(30)] + [None, "", "menu"]
    docs = documents(spark, texts, source=lambda k: None if k % 2 else "a", extra=True)
    for bound in (ld.BROADCAST_BYTES, -1):
        monkeypatch.setattr(ld, "BROADCAST_BYTES", bound)
        got = {r.doc_id: r for r in ld.drop_boilerplate(docs).collect()}
        assert len(got) == len(texts)
        assert got[0].text == "body 0\n\nrare" and got[9].text == "body 9\n" and got[9].ld_dropped == 2
        assert got[30].text is None and got[31].text == "" and got[32].text == ""
    assert ld.drop_boilerplate(empty(spark)).count() == 0


# Tokens.

ALPHABET = ["a", "b", "the", "ing", "th", " ", "  ", "\n", "\t", "é", "▁", "😀", "\x00", "<s>", "日", "本", "1", "2024", "//", "--", "ß"]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    from marlstone.llm import token_count as tc

    rng = random.Random(6)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(800)] + ["the quick" * 2000 + " " * 9000 + "x" * 9999, *odd_texts()]
    path = public_tokenizers.path(tc.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in tc.count_tokens(documents(spark, texts, extra=True), path).collect()}
    assert [got[k].n_tokens for k in range(len(texts))] == [len(library.encode(t or "")) for t in texts]
    assert [got[k].n_bytes for k in range(len(texts))] == [len((t or "").encode()) for t in texts]


def test_chunk_maps_compose_to_the_whole():
    from marlstone.llm import token_count as tc

    machine, rng = tc.Transducer(tc.Vocabulary.load(public_tokenizers.path(tc.MODEL))), random.Random(7)
    for _ in range(50):
        text = "".join(rng.choice(ALPHABET) for _ in range(80)).replace(" ", tc.SPACE)
        size = rng.randrange(1, 9)
        maps = [machine.chunk_map(text[k:k + size]) for k in range(0, len(text), size)]
        for k, m in enumerate(machine.scan(maps)):
            state, n = machine.run(machine.start, m.head)
            n += m.tail[1] if m.tail else 0
            assert n == machine.run(machine.start, text[:(k + 1) * size])[1]


def test_byte_bpe_equals_the_library_and_round_trips(spark):
    import tiktoken

    from marlstone.llm import byte_bpe as bb

    rng = random.Random(8)
    texts = ["".join(rng.choice([*ALPHABET, "'s", "’", "٣", "½", "\x1c", "　"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["ab" * 4000, *odd_texts()]
    path = public_tokenizers.path(bb.RANKS)
    ranks = bb.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, texts, extra=True)
    got = {r.doc_id: r for r in bb.round_trip(docs, path, public_tokenizers.PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bb.round_trip(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_folds_copies_once_beforehand(spark, monkeypatch):
    from marlstone.llm import byte_bpe as bb

    seen, blocks = [], bb._blocks
    monkeypatch.setattr(bb, "_blocks", lambda docs, *rest: (seen.append(docs.count()), blocks(docs, *rest))[1])
    path = public_tokenizers.path(bb.RANKS)
    got = bb.round_trip(documents(spark, ["thereto qwxz"] * 300 + ["another text"]), path, public_tokenizers.PATTERN).collect()
    assert seen == [2, 301] and len(got) == 301 and len({r.ids_sha256 for r in got}) == 2


def test_byte_bpe_sends_bytes_of_known_words_to_the_driver(spark, monkeypatch):
    from pyspark.sql import functions as F

    from marlstone.llm import byte_bpe as bb

    ranks, taken = bb.load_ranks(public_tokenizers.path(bb.RANKS)), []
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "toArrow", lambda self, run=frame.toArrow: (taken.append(run(self)), taken[-1])[1])
    rng, ranked = random.Random(9), bb.RankMap(ranks)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(200)) for _ in range(40)]
    folded = bb._let(ranked.literal, lambda tables: F.transform("words", lambda w: bb.encode_word(ranked, tables, w)))
    words, known = bb.known_words(documents(spark, texts + texts[:20]), ranks, folded, spark.sparkContext.broadcast(ranks), public_tokenizers.PATTERN)
    numbers = words.numbers() if hasattr(words, "numbers") else {w: k for k, w in enumerate(words)}
    assert sum(t.nbytes for t in taken) < 45 * len(numbers) and len(numbers) > 5000
    for word, k in random.Random(1).sample(sorted(numbers.items()), 300):
        assert known.ids[known.edges[k]:known.edges[k + 1]].tolist() == bb.merge_long(word.encode(), ranks)


# Media.

@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    from marlstone.llm import tiff

    rng = np.random.default_rng(9)
    for order in "<>":
        for kind in (np.uint8, np.uint16):
            pages = [rng.integers(0, 200, shape).astype(kind) for shape in ((70, 64, 1), (1, 1, 3), (33, 100, 3))]
            got = list(tiff.read_pages(tiff.write_tiff(pages, compression, predictor, 16, tile, order)))
            assert [p.pixels for p in got] == [p.tobytes() for p in pages]


def test_tiff_pages_and_digests(spark):
    import zlib

    from marlstone.llm import tiff

    file = tiff.write_tiff([np.ones((4, 4), np.uint8), np.zeros((2, 2), np.uint8)])
    files = spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"II")), (4, bytearray(file[:-8])), (5, bytearray(b""))], "id long, data binary")
    rows = [(r.id, r.page, r.error is None) for r in tiff.tiff_pages(files, "id", "data").collect()]
    assert rows[:2] == [(1, 0, True), (1, 1, True)] and {r[0] for r in rows if not r[2]} == {3, 4, 5}
    for t in odd_texts():
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 if data else 64)
        n, size, sha, crc, *_ = tiff._digests(data)
        assert (n, size, sha, crc) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


# Decontamination.

def test_decontamination_equals_brute_force(spark):
    from marlstone.llm import decontaminate as dc

    rng = random.Random(10)
    items = [prose(rng, n, 40) for n in (13, 20, 5, 1, 30)] + ["", None]
    texts = []
    for _ in range(40):
        ws = prose(rng, rng.randrange(5, 120), 40).split()
        item = (rng.choice(items[:5])).split()
        at = rng.randrange(len(ws))
        texts.append(" ".join([*ws[:at], *item[rng.randrange(3):], *ws[at:]]).upper())
    texts += odd_texts()
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.match_benchmark(documents(spark, texts, extra=True), bench, block_bytes=2000).collect()}
    windows = {}
    for k, t in enumerate(items):
        ws = dc.words((t or "").encode())
        for i in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[i:i + 13]), set()).add(str(k))
    for k, t in enumerate(texts):
        ws, hit, found = dc.words((t or "").encode()), set(), set()
        for w, names in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= names
        r = got[k]
        assert (r.n_words, r.n_hit, r.n_items) == (len(ws), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(ws))
    assert dc.match_benchmark(empty(spark), bench).count() == 0
    assert dc.match_benchmark(documents(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity_matches():
    from marlstone.llm import decontaminate as dc

    part = dc.make_part([("1", [b"a", b"b", b"c"])])
    index = dc.Index([[b"c", b"x", b"a", b"b"], [b"a", b"x", b"x", b"b", b"c"], [b"a", b"b"]], part)
    assert index.near(part, 4) == [(0, 0)] and index.near(part, 5) == [(0, 0), (0, 1)]


# Pages.

def test_html_extraction(spark):
    from marlstone.llm import wrapper_html as wh

    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li>Menu</ul></nav><article><h1>Head &amp; more {k}</h1><p>one <b>t</b>wo<br>three<p>four {k}</p><div class='comments'><p>no</p></div></article><aside>no</aside><footer>no</footer></body></html>"
    pages = [("http://a.com/" + str(k), page.replace("{k}", str(k))) for k in range(6)]
    pages += [("http://b.com/1", "<div class=ad>x</div><p>plain"), (None, None), ("x", ""), ("http://a.com/9", "<div>" * 3000 + "deep"), ("http://c.com", "a < b <c"), ("http://a.com/1", "<p title='")]
    df = spark.createDataFrame([(k, u, h, "w") for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, w_key string")
    for bound in (wh.BROADCAST_BYTES, -1):
        wh.BROADCAST_BYTES, kept = bound, wh.BROADCAST_BYTES
        got = {r.page_id: r.text for r in wh.extract_main_text(df).collect()}
        wh.BROADCAST_BYTES = kept
        assert [got[k] for k in range(6)] == [f"Head & more {k}\none two three\nfour {k}" for k in range(6)]
        assert (got[6], got[7], got[8], got[9]) == ("plain", "", "", "deep") and len(got) == len(pages)
    assert wh.extract_main_text(df.limit(0)).count() == 0


def test_wrappers_generalise():
    from marlstone.llm import wrapper_html as wh

    a, b = (wh.infer(wh.parse(h)) for h in ("<h1>x</h1><p>1<p>2", "<p>3<div>d</div>"))
    w = wh.align(a, b)
    assert [(i[3], i[1], i[2]) for i in w] == [("h1", 1, 0), ("p", 0, 1), ("div", 1, 0)]
    group = wh.infer(wh.parse("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"))
    assert [i[0] for i in group] == ["g"] and [x[3] for x in group[0][2]] == ["h2", "p"]
    many = wh.align([["e", 0, 0, f"x{k}", 0, []] for k in range(200)], [["e", 0, 0, f"y{k}", 0, []] for k in range(200)])
    assert len(many) == 400 and all(i[1] for i in many)


def test_wrappers_match_what_they_are_made_of():
    from functools import reduce

    from marlstone.llm import wrapper_html as wh

    def expression(items):
        return "".join(f"(?:(?:{expression(i[2]) if i[0] == 'g' else '#' if i[0] == 't' else i[3]}){'+' if i[0] == 'g' or i[0] == 'e' and i[2] else ''}){'?' if i[1] else ''}" for i in items)

    def longest(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(12)
    for _ in range(200):
        pages = ["".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))]
        wrapper = reduce(wh.align, [wh.fold([["e", 0, 0, x, 0, []] for x in page]) for page in pages])
        assert all(re.fullmatch(expression(wrapper), page) for page in pages), (pages, expression(wrapper))
        a, b = list(pages[0]), list(pages[-1][::-1])
        places = wh.common(a, b)
        assert len(places) == longest(a, b) and all(a[i] == b[j] for i, j in places) and places == sorted(set(places)) and len({j for _, j in places}) == len(places)


def test_html_words_and_depth(spark):
    from marlstone.llm import wrapper_html as wh

    article = "<article><p class='ad-hoc'>one</p><p id='side-effects'>two</p><p class='form-factor lead'>three</p><p class='top ad-slot'>no</p><p class='siteHeader'>no</p><p>four</p></article>"
    deep = "<div>" * 3000 + "<nav>MENU</nav><form>FORM</form><p>text</p>" + "</div>" * 3000
    menu = "<div>" * 3000 + "<article><p>inside</p><ul class=menu><li>no</ul></article>" + "</div>" * 3000 + "outside"
    df = spark.createDataFrame([(k, "http://a.com", h) for k, h in enumerate((article, deep, menu, "<b>" * 9000 + "x", "<li>" * 5000))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wh.extract_main_text(df).collect()}
    assert got == {0: "one\ntwo\nthree\nfour", 1: "text", 2: "inside", 3: "x", 4: ""}


def test_template_texts_are_a_share_of_different_pages(spark):
    from marlstone.llm import wrapper_html as wh

    copies = [("http://a.com", "<h1>One</h1><p>the only page</p>")] * 12
    cells = [("http://b.com", "<h1>Two</h1><table><tr>" + "<td>0</td>" * 12 + "</tr></table>")]
    few = [("http://c.com", f"<h1>Page {k}</h1><div>All the same</div><p>text {k}</p>") for k in range(3)]
    half = [("http://d.com", f"<h1>Page {k}</h1>" + "<div>Sometimes</div>" * (k < 2) + f"<p>text {k}</p>") for k in range(4)] + [("http://d.com", "<h1>Page 0</h1><div>Sometimes</div><p>text 0</p>")] * 20
    long = [("http://e.com", f"<h1>Page {k}</h1><div>{'notice ' * 60}</div><p>text {k}</p>") for k in range(300)]
    pages = [*copies, *cells, *few, *half, *long]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wh.extract_main_text(df).collect()}
    assert all(got[k] == "One\nthe only page" for k in range(12)) and got[12] == "\n".join(["Two", *["0"] * 12])
    assert [got[13 + k] for k in range(3)] == [f"Page {k}\ntext {k}" for k in range(3)]
    assert [got[16 + k] for k in range(4)] == ["Page 0\nSometimes\ntext 0", "Page 1\nSometimes\ntext 1", "Page 2\ntext 2", "Page 3\ntext 3"] and got[39] == got[16]
    assert [got[40 + k] for k in range(300)] == [f"Page {k}\ntext {k}" for k in range(300)]


def test_templates_are_counted_over_every_page_of_a_host(spark):
    from marlstone.llm import wrapper_html as wh

    n = 600
    share = lambda k, mark: f"<div>{mark}</div>" * k
    pages = [("http://a.com", f"<h1>Page {k}</h1>{share(k < n // 2, 'Half')}<h2>part</h2>{share(k <= n // 2, 'More')}<p>text {k}</p>") for k in range(n)]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in wh.extract_main_text(df).collect()}
    # exactly half isn't more than half, and one page more is; "part" stands on all
    assert all(got[k] == f"Page {k}\n" + "Half\n" * (k < n // 2) + f"text {k}" for k in range(n))


def test_wrappers_choose_the_slots_of_articles(spark):
    from marlstone.llm import wrapper_html as wh

    page = "<body><article><h1>Head {k}</h1><div>Buy our tea</div><section><p>body {k}<p>all say so</section><span>Read <b>on</b></span></article><div>outside</div></body>"
    pages = [("http://a.com", page.replace("{k}", str(k))) for k in range(5)] + [("http://b.com", page.replace("{k}", "x"))] * 3
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wh.extract_main_text(df).collect()}
    assert [got[k] for k in range(5)] == [f"Head {k}\nbody {k}\nall say so" for k in range(5)]
    assert got[5] == got[6] == got[7] == "Head x\nBuy our tea\nbody x\nall say so\nRead on"


def test_articles_are_never_lost(spark):
    from marlstone.llm import wrapper_html as wh

    same = [("http://a.com", f"<nav>m{k}</nav><article><h1>Same title</h1><p>Same body.</p></article>") for k in range(9)]
    near = [("http://b.com", f"<main><div>{k} May</div><h1>Title</h1><div>{'the same text ' * 30}</div><div>{'and this one ' * 20}</div></main><div>menu</div>") for k in range(9)]
    plain = [("http://c.com", f"<div class=nav>{k}</div><div>Only text here</div>") for k in range(9)]
    menus = [("http://d.com", f"<div>Start</div><div>{'body ' * 5}{k}</div><div>Imprint</div>") for k in range(9)]
    advert = [("http://e.com", f"<article><h2>Ingredients</h2><div>{'text ' * 20}{k}</div><div>Subscribe to our channel today</div><div>{k} {'more ' * 20}</div></article>") for k in range(4)]
    pages = same + near + plain + menus + advert
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    got = [r.text for r in wh.extract_main_text(df).orderBy("page_id").collect()]
    assert got[:9] == ["Same title\nSame body."] * 9
    assert got[9:18] == [f"{k} May\nTitle\n{('the same text ' * 30).strip()}\n{('and this one ' * 20).strip()}" for k in range(9)]
    assert got[18:27] == ["Only text here"] * 9
    assert got[27:36] == [f"{'body ' * 5}{k}" for k in range(9)]
    assert got[36:] == [f"Ingredients\n{'text ' * 20}{k}\n{k} {('more ' * 20).strip()}" for k in range(4)]


def test_wide_pages_align_in_bounded_time():
    import time

    from marlstone.llm import wrapper_html as wh

    rng = random.Random(3)
    wide = ["".join(f"<{t}>text {rng.randrange(50)}</{t}>" for t in (rng.choice(["p", "h2", "ul", "pre", "h3"]) for _ in range(20_000))) for _ in range(3)]
    began = time.time()
    found: list = [[], []]
    for html in wide:
        found = wh.add_page(found, html)
    settled = wh.Level(wh.settle(found[1], found[0]))
    texts = [wh.extract(wh.parse(html), settled) for html in wide]
    assert time.time() - began < 20
    # what goes is only what other pages have too, and never all
    for html, text in zip(wide, texts):
        plain = wh.extract(wh.parse(html)).split("\n")
        assert text and set(text.split("\n")) <= set(plain)


# Places of benchmark items.

def test_benchmark_matches_give_phrases_and_proximity(spark):
    from marlstone.llm import decontaminate as dc

    rng = random.Random(5)
    words = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    items = {"1": words(dc.WINDOW + 2, 400), "2": ["q", "r", "s"], "3": ["q", "r", "s"], "4": []}
    texts = [words(30, 400) + items["1"] + words(10, 400), ["x", "s", "y", "r", "z", "q", "u", "q", "r", "s"], ["q"], ["r", "s"], items["1"][::-1], [], words(40, 6) + ["q", "s", "s", "r"]]
    docs = documents(spark, [" ".join(t) for t in texts] + [None])
    benchmark = spark.createDataFrame([(int(k), " ".join(v)) for k, v in items.items()], "item_id long, text string")
    for span in (5, 2 * dc.WINDOW):
        want = set()
        for item, ws in items.items():
            for k in range(max(1, len(ws) - dc.WINDOW + 1) if ws else 0):
                window = ws[k:k + dc.WINDOW]
                for d, t in enumerate(texts):
                    want |= {(d, item, s, "phrase") for s in range(len(t)) if t[s:s + len(window)] == window}
                    want |= {(d, item, s, "near") for s in range(len(t)) if t[s] in window and set(window) <= set(t[s:s + span])}
        for bound in (dc.BLOCK_BYTES, 1):
            got = [tuple(r) for r in dc.benchmark_matches(docs, benchmark, span, block_bytes=bound).collect()]
            assert sorted(got) == sorted(want) and {k for *_, k in want} == {"phrase", "near"}
    assert dc.benchmark_matches(empty(spark), benchmark).count() == 0


def test_byte_bpe_rank_map_is_small_and_whole():
    import public_tokenizers
    from marlstone.llm import byte_bpe as bb

    ranks = bb.load_ranks(public_tokenizers.path(bb.RANKS))
    first, second = bb.pair_table(ranks)
    pairs = {ranks[p[:k]] << 32 | ranks[p[k:]] << 16: r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}
    assert all(min(first[k % len(first)] ^ k, second[k % len(second)] ^ k) == r for k, r in pairs.items())
    assert len(first) + len(second) < 2.5 * len(pairs)  # each task reads it anew


def test_near_dedup_leaves_no_words_in_workers():
    import pyarrow as pa
    from marlstone.llm import near_dedup

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "tk": [1], "text": ["one two three four five six"]})
    assert sum(b.num_rows for b in near_dedup._signatures(iter([batch]))) == 1 and not near_dedup._HASHES
    assert sum(b.num_rows for b in near_dedup._sets(iter([batch]))) == 1 and not near_dedup._HASHES


def test_texts_go_to_python_once(spark, monkeypatch):
    from marlstone.llm import decontaminate as dc
    from marlstone.llm import quality
    from marlstone.llm.common import DOC_COLUMNS

    sent, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *rest, run=frame.mapInArrow: (sent.append(tuple(self.columns)), run(self, *rest))[1])
    docs = documents(spark, ["one two three", None, "four " * 30])
    benchmark = spark.createDataFrame([("b", "two three")], "item_id string, text string")
    found = dc.match_benchmark(docs, benchmark, keep=DOC_COLUMNS).orderBy("doc_id").collect()
    scored = quality.score_documents(docs, quality.Classifier(0.5), keep=DOC_COLUMNS).orderBy("doc_id").collect()
    assert sent == [DOC_COLUMNS] * 2
    assert [(r.text, r.n_hit) for r in found] == [("one two three", 2), (None, 0), ("four " * 30, 0)] and [r.text for r in scored] == [r.text for r in found]


def test_byte_bpe_finds_known_words_without_a_dict():
    import tracemalloc

    import xxhash
    from marlstone.llm import byte_bpe as bb

    given = sorted((f"{k}word{k * k}".encode() for k in range(50_000)), key=xxhash.xxh64_intdigest)
    ends = np.concatenate([[0], np.cumsum([len(w) for w in given])])
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in given], np.uint64)
    words = bb.Words(b"".join(given), ends, hashes)
    tracemalloc.start()
    assert words.find([given[7], b"", b"none", given[49_999], given[0]]).tolist() == [7, -1, -1, 49_999, 0]
    assert tracemalloc.get_traced_memory()[1] < 100_000  # a dict of them takes 7 MB
    tracemalloc.stop()
    assert bb.NO_WORDS.find([b"a"]).tolist() == [-1] and words.find([]).tolist() == []
    other = bb.Words(b"ab", np.array([0, 2]), np.array([xxhash.xxh64_intdigest(b"cd")], np.uint64))  # another word of that hash
    assert other.find([b"cd", b"ab"]).tolist() == [-1, -1]


def test_near_dedup_counts_are_a_row_for_each_range(spark):
    import pyarrow as pa
    from marlstone.llm import near_dedup as nd

    rng = np.random.default_rng(5)
    centres, sets = [b"c" * 16, b"d" * 16], [rng.integers(-1 << 63, 1 << 63, n) for n in (60_000, 0, 3, 60_000)]
    sets[3][:50_000] = sets[0][:50_000]
    rows = [(centres[k % 2 if k < 3 else 0], s) for k, s in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.list_(pa.int64()))], ["c", "elements"])
    want = np.zeros(nd.BUCKETS, np.int64)
    for c, s in rows:
        np.add.at(want, nd._buckets(c, s.view(np.uint64)), 1)
    made = list(nd._counted(iter([batch, batch])))
    assert sum(b.num_rows for b in made) <= nd.RANGES and sum(b.num_rows for b in nd._added(iter([*made, *made]))) <= nd.RANGES
    df = spark.createDataFrame([(c, s.tolist()) for c, s in rows] * 3, "c binary, elements array<long>").repartition(5)
    assert (nd._frequencies(df).value == 3 * want).all() and not nd._frequencies(df.limit(0)).value.any()
