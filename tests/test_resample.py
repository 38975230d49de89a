"""Draws with replacement: exact counts, the same for any partitioning, and statistics equal to those of rows copied as often as they are drawn."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.operators import analysis, resample, stats

B = 60


@settings(max_examples=25, deadline=None)
@given(n=st.integers(1, 6000), seed=st.integers(0, 9), data=st.data())
def test_counts_add_up_and_ranks_can_be_asked_for_alone(n, seed, data):
    whole = resample.counts_of(np.arange(n), n, 20, seed)
    assert whole.shape == (n, 20) and (whole.sum(0) == n).all() and (whole >= 0).all()
    some = np.unique(data.draw(st.lists(st.integers(0, n - 1), min_size=1, max_size=8)))
    assert (resample.counts_of(some, n, 20, seed) == whole[some]).all()


def counts_by_definition(n, draws, seed):
    """A hash at a time, as the SQL has it."""
    def mix(x):
        x = (x ^ x >> 16) * resample.FINAL[0] & 0xFFFFFFFF
        x = (x ^ x >> 13) * resample.FINAL[1] & 0xFFFFFFFF
        return x ^ x >> 16

    s, d, a, z = resample.MIX
    out = np.zeros((n, draws), int)
    for b in range(draws):
        open_ = [(0, n, n)]
        while open_:
            lo, hi, c = open_.pop()
            if hi - lo == 1:
                out[lo, b] = c
                continue
            key, mid = mix(seed * s + b * d + lo * a + hi * z & 0xFFFFFFFF), (lo + hi) // 2
            left = sum(mix(key + j * s & 0xFFFFFFFF) * (hi - lo) < (mid - lo) << 32 for j in range(c))
            open_ += [(lo, mid, left), (mid, hi, c - left)]
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 100, 2049, 5000])
def test_counts_are_those_of_hashes_at_any_size(n):
    want = counts_by_definition(n, 3, 5)
    assert (resample.counts_of(np.arange(n), n, 3, 5) == want).all()
    counts = resample._Counts(3, 5)
    for ranks in (np.arange(n // 2), np.arange(n // 2, n), np.arange(0, n, 7)):  # from splits that are kept
        assert (counts(ranks, n)[0] == want[ranks]).all()


def test_long_counts_in_several_blocks(monkeypatch):
    want = resample.counts_of(np.arange(700), 700, 4)
    monkeypatch.setattr(resample, "STEPS", 30)
    monkeypatch.setattr(resample, "BLOCK", 64)
    assert (resample.counts_of(np.arange(700), 700, 4) == want).all()


def test_cutoff_split_takes_no_digits_of_other_sets_for_years(spark):
    rows = [("m", "2001", "math500", True), ("m", "aime-2025-1", "aime", True), ("m", "3", "aime2019", False), ("m", "1950", "aime2024", True), ("m", "x", "aime", True)]
    df = spark.createDataFrame([(*r, None) for r in rows], "method string, problem_id string, source string, correct boolean, error string")
    assert {(r.after_cutoff, r.n, r.accuracy) for r in analysis.cutoff_split(df, 2024, n_boot=20).collect()} == {(True, 2, 1.0), (False, 1, 0.0)}


@pytest.mark.parametrize("n", [2, 4, 37, 5000])
def test_counts_are_multinomial(n):
    counts = resample.counts_of(np.arange(n), n, 400)
    assert abs(counts.var() - (1 - 1 / n)) < 0.05 and np.abs(counts.mean(1) - 1).max() < 0.35
    assert (counts == 0).mean() == pytest.approx((1 - 1 / n) ** n, abs=0.02)
    assert not (counts == resample.counts_of(np.arange(n), n, 400, seed=1)).all()


def rows_of(rng, clusters=9, n=160):
    return [(rng.choice(["g", "h", None]), f"p{rng.randrange(clusters)}", rng.choice([0.0, 0.05, 0.31, 0.34, 0.34, 0.72, 1.0]), rng.random() > 0.5, round(rng.random(), 3)) for _ in range(n)] + [("one", "p1", 0.5, True, 0.2), ("one", "p1", 0.4, False, 0.9)]


def drawn(rows, n_boot, seed=0):
    """(group, draw) -> the rows of the draw, copied."""
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        clusters = sorted({r[1] for r in own})
        counts = resample.counts_of(np.arange(len(clusters)), len(clusters), n_boot, seed)
        for b in range(n_boot):
            out[g, b] = [r for r in own for _ in range(counts[clusters.index(r[1]), b])]
    return out


def plain_auroc(rows):
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    return np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]) if pos and neg else None


def plain_ece(rows):
    gaps = {}
    for r in rows:
        k = min(9, int(r[2] * 10))
        gaps[k] = gaps.get(k, 0) + r[2] - r[4]
    return sum(map(abs, gaps.values())) / len(rows)


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9), k


@pytest.mark.parametrize("parts", [1, 7])
def test_statistics_of_draws_equal_those_of_copied_rows(spark, parts):
    rows = rows_of(random.Random(4))
    df = spark.createDataFrame(rows, "grp string, problem_id string, score double, label boolean, soft double").repartition(parts)
    copies = drawn(rows, B)
    got = stats.cluster_bootstrap(df, "problem_id", ["grp"], n_boot=B).collect()
    by = {(r.grp, r.b): r for r in got}
    assert len(got) == 4 * B
    same({k: r.auroc for k, r in by.items()}, {k: plain_auroc(v) for k, v in copies.items()})
    same({k: r.ece for k, r in by.items()}, {k: plain_ece(v) for k, v in copies.items()})
    same({k: r.brier for k, r in by.items()}, {k: np.mean([(r[2] - r[4]) ** 2 for r in v]) for k, v in copies.items()})
    for q in (0.5, 0.1, 0.95):
        found = {(r.grp, r.b): r.value for r in resample.bootstrap_quantile(df, "soft", q, ["grp"], "problem_id", n_boot=B).collect()}
        same(found, {k: float(np.quantile([r[4] for r in v], q)) for k, v in copies.items()})
    # a metric of the user's own: the correlation of score and soft label
    x, y = F.col("score"), F.col("soft")
    sums = {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    corr = F.try_divide(F.expr("n * xy - x * y"), F.sqrt(F.expr("(n * xx - x * x) * (n * yy - y * y)")))
    found = {(r.grp, r.b): r.value for r in resample.bootstrap(df, sums, corr, ["grp"], "problem_id", n_boot=B).collect()}
    same(found, {k: float(np.corrcoef([r[2] for r in v], [r[4] for r in v])[0, 1]) for k, v in copies.items()})


@pytest.mark.parametrize("few", [0, 5])
def test_quantiles_by_ranges_of_values(spark, monkeypatch, few):
    rng = random.Random(6)
    rows = rows_of(rng, 40, 200) + [("ties", f"p{k}", 0.5, True, 0.25 if k % 3 else rng.random()) for k in range(90)]
    df = spark.createDataFrame(rows, "grp string, problem_id string, score double, label boolean, soft double").repartition(3)
    monkeypatch.setattr(resample, "FEW_ROWS", few)
    copies = drawn(rows, B)
    for q in (0.5, 0.0, 0.93, 1.0):
        found = {(r.grp, r.b): r.value for r in resample.bootstrap_quantile(df, "soft", q, ["grp"], "problem_id", n_boot=B).collect()}
        same(found, {k: float(np.quantile([r[4] for r in v], q)) for k, v in copies.items()})


def test_null_group_and_all_draws_of_few_problems(spark):
    df = spark.createDataFrame([("a", "p", True)] + [("b", f"p{k}", k % 2 == 0) for k in range(4)] + [(None, "p", False)], "m string, problem_id string, correct boolean")
    means = stats.bootstrap_means(df, "correct", ["m"], "problem_id").groupBy("m").count().collect()
    assert {r.m: r["count"] for r in means} == {"a": 1000, "b": 1000, None: 1000}
    assert stats.bootstrap_means(df.limit(0), "correct", ["m"], "problem_id").count() == 0
    assert resample.auroc(df.limit(0).withColumn("score", F.lit(0.5)), ["m"], label="correct").count() == 0


def test_intervals_hold_the_mean_and_follow_the_seed(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"p{k}", bool(x)) for k, x in enumerate(rng.random(300) < 0.6)], "problem_id string, correct boolean").cache()
    one, again, other = (stats.accuracy_interval(df.withColumn("g", F.lit(1)).repartition(n), ["g"], seed=s).first() for n, s in ((2, 7), (5, 7), (2, 8)))
    assert one.lo <= one.accuracy <= one.hi and one.hi - one.lo < 0.15
    assert (one.lo, one.hi) == (again.lo, again.hi) != (other.lo, other.hi)


def test_paired_differences(spark):
    rows = [("m", f"p{k:03}", k < 60, k < 40) for k in range(100)] + [("same", f"p{k:03}", k < 60, k < 60) for k in range(100)]
    got = {r.m: r for r in stats.paired_difference(spark.createDataFrame(rows, "m string, problem_id string, a boolean, b boolean"), ["m"]).collect()}
    assert got["m"].diff == pytest.approx(0.2) and 0 < got["m"].lo <= 0.2 <= got["m"].hi and got["m"].p_value < 0.05
    assert (got["same"].diff, got["same"].lo, got["same"].hi, got["same"].p_value) == (0, 0, 0, 1)


def test_clusters_widen_intervals(spark):
    rng = np.random.default_rng(4)
    rows = [(1, f"p{k}", f"p{k}-{j}", bool(x > 0.5 + 0.01 * j)) for k, x in enumerate(rng.random(30)) for j in range(8)]
    df = spark.createDataFrame(rows, "g int, problem_id string, row_id string, correct boolean").cache()
    wide, narrow = (stats.accuracy_interval(df, ["g"], cluster=c).first() for c in ("problem_id", "row_id"))
    assert wide.hi - wide.lo > 1.5 * (narrow.hi - narrow.lo)


def test_auroc_over_stretches(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(40) / 40, rng.random() > 0.4) for _ in range(3000)] + [("only", 0.3, True)]
    df = spark.createDataFrame(rows, "g string, score double, label boolean").repartition(9)
    same({r.g: r.auroc for r in resample.auroc(df, ["g"]).collect()}, {g: plain_auroc([(g, 0, s, y) for h, s, y in rows if h == g]) for g in ("a", "b", "only")})
    whole = resample.auroc(df, [])
    assert whole.first().auroc == pytest.approx(plain_auroc([(0, 0, s, y) for _, s, y in rows]))
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and "hashpartitioning(part" in plan  # the scores in stretches; only one row of each meets the others


def test_main_table_refuses_different_problems(spark):
    rows = [("sc", "p1", True, 10), ("sc", "p2", False, 10), ("tz", "p1", True, 20), ("tz", "p3", True, 20)]
    df = spark.createDataFrame([(*r, None) for r in rows], "method string, problem_id string, correct boolean, compute_tokens long, error string")
    with pytest.raises(ValueError, match="different problems"):
        analysis.main_table(df)
    assert {r.method_id: r.vs for r in analysis.main_table(df, common=True, n_boot=50).collect()} == {"sc": None, "tz": "sc"}
    both = df.where("problem_id = 'p1'").unionByName(df.where("problem_id = 'p2'")).unionByName(df.where("problem_id = 'p2'").withColumn("method", F.lit("tz")))
    assert analysis.main_table(both, n_boot=50).count() == 2
