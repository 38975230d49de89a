import pytest
from pyspark.sql import functions as F

from marlstone.functions import answers, probability, text


def column(spark, values, function, kind="string"):
    rows = [(k, v) for k, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"k int, x {kind}").orderBy("k").select(function(F.col("x"))).collect()]


def test_normalize_answer_rule_by_rule(spark):
    rules = {
        "spaces and signs without meaning": {r"  $ 48 $ ": "48", r"6\,250\!\;": "6250", "8\n+ 1": "8+1", r"a\ b": "ab", r"75 \%": "75", r"\$ 2.40": "2.4", r"\displaystyle 9": "9", r"\left[ 2, 5 \right)": "[2,5)", r"\leftarrow": "arrow"},
        "degrees and units": {r"45^ { \circ }": "45", r"60^\circ": "60", "30°": "30", r"15\degree": "15", r"31 \text{ square feet}": "31", r"8\mathrm{m}^{3}": "8", r"x \text{ cm}": "xcm", r"\frac{9}{4}\mbox{ kg}": r"\frac{9}{4}"},
        "words": {r"\textbf{Tuesday}": "tuesday", r"\textit{Even}": "even", "(E)": "e", "Odd": "odd", "x1": "x1"},
        "assignments": {"n = 11": "11", "y=x=2": "y=x=2", "ab = 3": "ab=3"},
        "thousands": {"-27,500.50": "-27500.5", "2{,}048": "2048", "12,34": "12,34", "1,000,00": "1,000,00"},
        "roots and fractions": {r"\sqrt5": r"\sqrt{5}", r"\frac38": r"\frac{3}{8}", r"\frac3{8}": r"\frac{3}{8}", r"\frac{11}8": r"\frac{11}{8}", r"\tfrac79": r"\frac{7}{9}", "-11/8": r"-\frac{11}{8}", "1/2/3": "1/2/3"},
        "numbers": {"00120": "120", "3.": "3", "6.250": "6.25", ".75": "0.75", "-0": "0", "2.5e2": "250", "4E-2": "0.04", "7e88": "7e88", "1.2.3": "1.2.3"},
        "boxes": {r"\boxed{ \dfrac{5}{6} }": r"\frac{5}{6}", r"\fbox 31 or so": "31", r"\boxed{1} and \boxed{ 2 }": "2", r"\boxed{\{\{\{\{\{4\}\}\}\}\}}": r"\{\{\{\{\{4\}\}\}\}\}", r"\boxed{{{{{{6}}}}}}": "{{{{{6}}}}}", r"\boxed{": r"\boxed{"},
    }
    cases = [(k, v) for rule in rules.values() for k, v in rule.items()] + [(None, ""), ("", ""), ("   ", "")]
    got = column(spark, [k for k, _ in cases], text.normalize_answer)
    assert [(k, g) for (k, _), g in zip(cases, got)] == cases


def test_normal_forms_are_stable_and_ignore_dressing(spark):
    import random

    rng = random.Random(3)
    plain = [str(rng.randrange(-10**6, 10**6)) for _ in range(20)] + [rf"\frac{{{rng.randrange(1, 99)}}}{{{rng.randrange(1, 99)}}}" for _ in range(20)] + [rf"\sqrt{{{rng.randrange(2, 99)}}}" for _ in range(10)]
    dressed = [rng.choice(["${}$", " {} ", r"\boxed{{{}}}", "x = {}", "{}.", r"{}\%", r"\displaystyle {}"]).format(x) for x in plain]
    assert column(spark, plain, text.normalize_answer) == plain and column(spark, dressed, text.normalize_answer) == plain


def test_extract_answer(spark):
    inner = "31"
    for _ in range(9):
        inner = "{" + inner + "}"
    cases = [("A box, \\boxed{17}, then prose", "17"), ("\\boxed{3} is wrong, so \\fbox{4}", "4"), ("\\boxed{8} and an empty one \\boxed{  }", "8"), ("\\boxed{2 + \\boxed{ 6 }}", "6"), ("\\boxed\t9, as said", "9,"), ("$\\boxed 7$", "7"),
             ("\\boxed{" + inner + "}", inner), ("\\boxed{\\{a\\}", None), ("a \\boxes{5}", None), ("FINAL ANSWER is: **21.**\nnext line", "21"), ("final answer 1. final  answer = $y$", "y"), ("The final\nanswer:\n 33", "33"), ("final answer:", None), ("the answer is 6", None), (None, None), ("", None)]
    assert column(spark, [a for a, _ in cases], answers.extract_answer) == [b for _, b in cases]


def test_is_equivalent(spark):
    same = [("1.25", r"\frac{5}{4}"), (r"\frac{\sqrt8}{2}", r"\sqrt{2}"), (r"\frac{3\pi}{6}", r"\pi/2"), (r"6 \times 10^{2}", "600"), (r"4 \cdot 10^{-2}", "0.04"), ("2^5", "32"), ("(7, -1)", "(7,-1.0)"), ("[0, 4]", "[0,4]"), (r"\{5,2,2\}", r"\{2,5,2\}"), ("8, 3", "3,8"),
            ("Sunday", r"\text{sunday}"), ("(B)", "b"), (r"\begin{bmatrix}2&0\\0&1\end{bmatrix}", r"\begin{bmatrix} 2 & 0 \\ 0 & 1.0 \end{bmatrix}"), ("12%", "12"), ("a = 9", "9"), (r"(2, \infty)", r"(2,\infty)")]
    other = [("(0,4)", "[0,4)"), ("(7,-1)", "(-1,7)"), ("5", "-5"), (r"\{2,5\}", r"\{2,5,2\}"), ("2", "2, 2"), (r"\frac{2}{3}", "0.6667"), (r"\begin{bmatrix}2&0\end{bmatrix}", r"\begin{bmatrix}2\\0\end{bmatrix}"), ("cat", "dog"), ("1/0", "1"), (None, None), ("", ""), (None, "1"), ("1", None)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(same + other)], "k int, a string, b string")
    got = [r[0] for r in df.orderBy("k").select(answers.is_equivalent(F.col("a"), F.col("b"))).collect()]
    assert got == [True] * len(same) + [False] * len(other)


@pytest.mark.parametrize("steps", [["Let n be odd."], ["Two lines\nof one step", "third"], ["", "between blank ones", ""], ["Step", "Step 2 without a colon"], ["# a heading", "*stars*"], ["As in Step 9: we add.", "done"]])
def test_split_inverts_format(spark, steps):
    df = spark.createDataFrame([(steps,)], "s array<string>")
    assert df.select(answers.split_steps(text.format_steps(F.col("s")))).first()[0] == steps


def test_split_cases():
    assert answers.steps_in("**Step 1:** a\n\n**Step 2**: b\n\n## Step 3: c") == ["a", "b", "c"]
    assert answers.steps_in("Step 3: x\nStep 4: y", 3) == ["x", "y"]
    assert answers.steps_in("Step 1: a\nStep 3: still a\n\nStep 2: b") == ["a\nStep 3: still a", "b"]
    assert answers.steps_in("just text") == ["just text"] and answers.steps_in("  ") == [] and answers.steps_in("Intro.\n\nStep 1: a") == ["Intro.", "a"]


def test_steps_and_tokens(spark):
    cases = [("Step 3: Let  x = 2.", "let x = 2"), ("  step 12) Compute\n\tthe sum ", "compute the sum"), ("STEP 1. Factor;", "factor"), ("   ", "")]
    assert column(spark, [a for a, _ in cases], text.normalize_step) == [b for _, b in cases]
    cuts = [(" a short step", "a short step"), (" a\nStep 4: leaked", "a"), (" a\n\n**Step 4:** leaked", "a"), (" mentions Step 4: inline", "mentions Step 4: inline")]
    assert column(spark, [a for a, _ in cuts], text.truncate_next_step) == [b for _, b in cuts]
    assert column(spark, ["▁Yes.", " (A)"], text.clean_token) == ["yes", "(a"]
    assert column(spark, [["a" * 10] * 50], lambda c: F.size(text.truncate_state(F.lit("p" * 100), c, 100)), "array<string>")[0] < 50
    assert column(spark, [["x", "\\boxed{1}", "y"]], lambda c: text.new_steps(c, F.lit(0), 20), "array<string>") == [["x", "\\boxed{1}"]]


def test_shards_are_the_hash_modulo(spark):
    import hashlib

    ids = [f"p{k}" for k in range(20)]
    for n in (3, 4, 7):
        assert column(spark, ids, lambda c, n=n: text.shard_of(c, n)) == [int(hashlib.sha256(i.encode()).hexdigest(), 16) % n for i in ids]


def test_probabilities(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    arr = lambda *x: F.array(*[F.lit(v).cast("double") for v in x])
    assert one(probability.renormalize(arr(None, None))) == [0.5, 0.5] and one(probability.renormalize(arr(0, 0))) == [0.5, 0.5]
    assert one(probability.prior_floor(arr(1, 0), 0.5)) == [0.75, 0.25]
    assert one(probability.merge_priors(arr(0.5, 0.25, 0.25), F.array(F.lit(0), F.lit(-1), F.lit(0)), F.lit(1))) == [1.0]
    assert one(probability.unshuffle(arr(10, 20, 30), F.array(F.lit(2), F.lit(0), F.lit(1)))) == [20, 30, 10]
    assert one(probability.least_step_score(arr(), F.lit(0))) == 0.5
    with pytest.raises(Exception, match="not a score"):
        one(probability.least_step_score(arr(1), F.lit(2)))


def test_whole_texts_are_normalised_and_deduplicated(spark, tmp_path):
    import hashlib

    from marlstone.plans import queries as q

    lines = ["Step 1: Add  the two.", "b c", "", "d e f", "g", "add the two", "h i j k l m n o p q", "B  C;", "h i j k l m n o p q r", "G.", "s"]
    texts = ["\n".join(lines), "\n".join(lines[::-1]), "one", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = {"Step 1: Add  the two.": "add the two", "B  C;": "b c", "G.": "g"}

    def brute(ls):
        kept, mapping = [], []
        for n in (norm.get(x, x) for x in ls):
            at = next((k for k, m in enumerate(kept) if m == n or len(set(m.split()) & set(n.split())) >= 0.9 * len(set(m.split()) | set(n.split()))), None)
            mapping.append(-1 if not n else at if at is not None else len(kept))
            if n and at is None:
                kept.append(n)
        return mapping

    got = {r.doc_id: r.mapping for r in q.queries()["greedy_dedupe"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else ",".join(map(str, brute(t.split("\n")))) for k, t in enumerate(texts)}
    assert got[0] == "0,1,-1,2,3,0,4,1,4,3,5"
    digests = {(r.doc_id, r.p): r.digest for r in q.queries()["normalize_step"](spark, str(tmp_path)).collect()}
    assert digests == {(k, p): hashlib.md5(norm.get(x, x).encode()).hexdigest() for k, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n"), 1)}
    pairs = {(r.doc_id, r.p): r.similarity for r in q.queries()["jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert len(pairs) == 20 and pairs[(0, 8)] == 0 and pairs[(1, 9)] == 0


def test_whole_text_queries_equal_their_sql(spark):
    import duckdb

    from marlstone.plans import queries as q

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    for name in ("normalize_step", "jaccard_pairs"):
        got = sorted(tuple(r) for r in q.queries()[name](spark, d).collect())
        assert got == sorted(con.sql(q.oracle_sql()[name]).fetchall()) and len(got) > 500, name
