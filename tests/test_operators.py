import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import analysis, budget, candidates, rows, sampling, stats, tree, votes


def test_latest_success_and_merge(spark):
    df = spark.createDataFrame([("p", "m", 1, None, 1), ("p", "m", 2, "bad", 2), ("p", "m", 3, "", 3), ("q", "m", 1, "x", 4), ("q", "m", 2, "y", 5)], "problem_id string, method string, seq int, error string, v int")
    assert sorted(r.v for r in rows.latest_success(df).collect()) == [3, 5]
    merged = rows.merge_runs([df, df.withColumn("v", F.col("v") + 10)])
    assert [r.v for r in merged.collect()] == [13, 15]
    mixed = df.withColumn("protocol_hash", F.col("seq").cast("string"))
    with pytest.raises(ValueError, match="several protocols"):
        rows.merge_runs([mixed.where("problem_id = 'p'"), mixed.where("problem_id = 'q'")])
    assert rows.resume(df, df.where("problem_id = 'q'"), ("problem_id",), retry_errors=True).count() == 5
    assert rows.resume(df, df.where("problem_id = 'q'"), ("problem_id",)).count() == 3
    whole = spark.range(50).select(F.col("id").cast("string").alias("problem_id"))
    assert sum(rows.in_shard(whole, k, 3).count() for k in range(3)) == 50


def test_specs():
    assert rows.parse_method("sc:4/8") == {"name": "sc", "n": 4, "m": 8} and rows.parse_method("tz") == {"name": "tz"} and rows.parse_shard("1/3") == (1, 3)
    for bad in ("sc", "tz:3", "sc:8/4", "nope", "bon:x"):
        with pytest.raises(ValueError):
            rows.parse_method(bad)
    with pytest.raises(ValueError):
        rows.parse_shard("3/3")


def test_calibration(spark):
    df = spark.createDataFrame([(s, lab, soft) for s, lab, soft in zip([.9, .8, .2, .1, .5, .5], [1, 1, 0, 0, 1, 0], [1., .8, 0., .1, .5, .5])], "score double, label int, soft double")
    pairs = [(p, q) for p in (.9, .8, .5) for q in (.2, .1, .5)]
    assert stats.auroc(df, []).first()[0] == pytest.approx(sum((p > q) + (p == q) / 2 for p, q in pairs) / 9)
    assert stats.auroc(df.where("label = 1"), []).first()[0] is None
    assert stats.ece(spark.createDataFrame([(.95, 0.), (.15, .15)], "score double, soft double"), []).first()[0] == pytest.approx(0.475)
    table = stats.reliability(spark.createDataFrame([(.05, 0.), (.05, 1.), (.95, 1.)], "score double, soft double")).orderBy("bin").collect()
    assert [r.n for r in table] == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1] and table[1].mean_score is None
    depths = stats.by_depth(spark.createDataFrame([(d,) for d in (1, 2, 3, 7, 12, 15)], "depth int"), {"least": F.min("depth")})
    assert {r.bucket: r.n for r in depths.collect()} == {"1-2": 2, "3-5": 1, "6-9": 1, "10+": 2}


def test_bootstrap_is_the_same_for_any_partitioning(spark):
    df = spark.range(40).select(F.lit("g").alias("g"), "id", (F.col("id") % 3 == 0).alias("correct"))
    a, b = (stats.accuracy_interval(df.repartition(n), ["g"], "id", n_boot=60).first() for n in (1, 8))
    assert a == b and a.lo < a.accuracy < a.hi
    pairs = df.select("g", "id", F.lit(True).alias("a"), F.lit(False).alias("b"))
    d = stats.paired_difference(pairs, ["g"], "id", 50).first()
    assert (d["diff"], d.lo, d.hi, d.p_value, d.n) == (1.0, 1.0, 1.0, 0.0, 40)


def test_votes(spark):
    s = spark.createDataFrame([("p", i, a, t, x) for i, (a, t, x) in enumerate(zip(["4", "5", "5", None, "4"], [10, 20, 30, 40, 50], [.1, .8, .5, .8, .2]))], "problem_id string, i int, answer string, tokens long, score double").withColumn("usd", F.lit(0.5))
    got = {r["size"]: (r.answer, r.tokens) for r in votes.majority_curve(s, [1, 3, 5]).collect()}
    assert got == {1: ("4", 10), 3: ("5", 60), 5: ("4", 150)}
    assert {r["size"]: r.answer for r in votes.best_of_curve(s, [1, 3, 5]).collect()} == {1: "4", 3: "5", 5: "5"}
    assert votes.expand_curves(s, [1, 3, 5, 8]).count() == 6
    assert [x for _, x in sorted((r.o, r.x) for r in spark.createDataFrame([("b",), ("ab",), ("a",)], "x string").select("x", votes.smaller_first(F.col("x")).alias("o")).collect())] == ["b", "ab", "a"]


def test_samples(spark):
    p = spark.createDataFrame([(f"p{k}", [1, 2, 3, 4, None][k % 5] if k % 7 else 1) for k in range(100)], "id string, level int")
    for n in (1, 20, 33, 100, 500):
        assert sampling.stratified_sample(p, n, 0).count() == min(n, 100)
    a, b = ({r.id for r in sampling.hash_sample(p.repartition(k), 10, 3).collect()} for k in (1, 5))
    assert a == b and len(a) == 10
    n = spark.range(0, 60).select(F.col("id").cast("int").alias("n"))
    for r in n.select("n", sampling.prefix_lengths(F.col("n"), 8).alias("x")).collect():
        want = list(range(1, r.n + 1)) if r.n <= 8 else sorted(set(np.round(np.linspace(1, r.n, 8)).astype(int).tolist()))
        assert r.x == want


def test_greedy_candidates(spark):
    def mapping(texts, jaccard=0.9):
        return spark.createDataFrame([(texts,)], "c array<string>").select(candidates.greedy_mapping(F.col("c"), jaccard)).first()[0]

    assert mapping(["x = 2", "Step 4: X =  2.", "y = 3", "x = 2"]) == [0, 0, 1, 0] and mapping(["", "x = 1", "Step 2:   "]) == [-1, 0, -1]
    base = " ".join(f"w{i}" for i in range(19))
    near, far = base + " extra", " ".join(f"w{i}" for i in range(9)) + " other"
    assert mapping([base, near, far]) == [0, 0, 1] and mapping([base, near, far], None) == [0, 1, 2]


def test_budgets(spark):
    c = spark.createDataFrame([("r", k, float(t), u) for k, (t, u) in enumerate([(0, 3.), (0, 3.), (1, 3.), (10, 3.)])], "run string, seq int, at double, usd double")
    assert [r.start for r in budget.rate_limit(c, 2.0, ["run"], ["seq"]).orderBy("seq").collect()] == [0, 2, 4, 10]
    assert budget.spend_cap(c, 5.0, ["run"], ["seq"]).count() == 2
    assert [r.admitted for r in budget.admit(c, 6.0, ["run"], ["seq"], "usd").orderBy("seq").collect()] == [True, True, False, False]
    assert spark.range(1).select(budget.admit_each(F.array(F.lit(3.0), F.lit(9.0), F.lit(2.0)), 6.0)).first()[0] == [True, False, True]
    with pytest.raises(ValueError):
        budget.confirm_cost(2, 1, False)


def test_nearest_and_paired(spark):
    t = spark.createDataFrame([("a", 100.0), ("b", 9.0)], "method_id string, tokens double")
    base = spark.createDataFrame([("x", 10.0), ("y", 90.0), ("z", 0.0)], "method_id string, tokens double")
    assert {r.method_id: r.nearest for r in analysis.nearest_by_compute(t, base).collect()} == {"a": "y", "b": "x"}


def test_stored_samples_methods_and_runs(spark, tmp_path):
    from marlstone.operators import experiments as ex

    drawn = [("p1", 0, "3", 0.1, 5), ("p1", 1, "4", 0.9, 6), ("p1", 2, "3", 0.2, 7), ("p2", 0, None, 0.5, 1), ("p2", 1, "x", 0.4, 1), ("p3", 0, "3", 0.3, 2), ("p9", 0, "3", 0.3, 2)]
    samples = spark.createDataFrame(drawn, "problem_id string, i int, answer string, score double, tokens long")
    problems = spark.createDataFrame([("p1", "q", "3"), ("p2", "q", "x"), ("p3", "q", "3"), ("p4", "q", "3")], "problem_id string, question string, answer string")
    g = ex.stored_generator(samples)
    got = {r.problem_id: r for r in ex.run_method(ex.vote_method(g, 2), problems).collect()}
    assert (got["p1"].answer, got["p1"].correct, got["p1"].compute_tokens) == ("3", True, 11) and got["p2"].answer == "x" and got["p2"].correct
    assert [got[p].error for p in ("p3", "p4")] == ["1 stored samples, fewer than 2", "0 stored samples, fewer than 2"] and not got["p3"].correct
    best = {r.problem_id: r.answer for r in ex.run_method(ex.best_method(g, ex.stored_judge, 2), problems).collect()}
    assert best == {"p1": "4", "p2": None, "p3": None, "p4": None}
    made, skipped = ex.build_methods(["cot", "sc:2", "tz"], g, None)
    assert [m.method_id for m in made] == ["cot", "sc[n=2]"] and set(skipped) == {"tz"}
    path = str(tmp_path / "rows")
    rows_, why = ex.run_methods(made, problems, path, token_cap=3, blocks=3)
    assert why and rows_.count() < 8
    rows_, why = ex.run_methods(made, problems, path, blocks=3)
    assert why is None and rows_.count() == 8 and rows_.groupBy("problem_id", "method_id").count().where("count > 1").count() == 0
    again, _ = ex.run_methods(made, problems, path, blocks=3)
    assert sorted(r.seq for r in again.collect()) == sorted(r.seq for r in rows_.collect())
    with pytest.raises(ValueError, match="twice"):
        ex.run_methods(made, problems.unionByName(problems), path)


def test_scores_and_pilot_runs(spark):
    from marlstone.operators import experiments as ex

    scores = spark.createDataFrame([("a", 0.0, None), ("b", 1.0, None), ("c", 1.5, None), ("d", float("nan"), None), ("e", None, None), ("f", 0.5, "down")], "id string, score double, error string")
    got = {r.id: (r.score, r.error) for r in ex.checked_scores(scores).collect()}
    assert got == {"a": (0.0, None), "b": (1.0, None), "c": (None, "not a score: 1.5"), "d": (None, "not a score: NaN"), "e": (None, "not a score: null"), "f": (0.5, "down")}
    runs = [spark.createDataFrame(r, "prefix_id string, seq int, error string, v string") for r in ([("a", 1, None, "s1"), ("b", 1, "bad", "s1"), ("c", 1, None, "s1"), ("c", 2, None, "s1 later")], [("a", 1, None, "s2"), ("b", 1, None, "s2")], [("a", 9, "bad", "d"), ("d", 1, "bad", "d")])]
    assert {r.prefix_id: r.v for r in ex.merge_pilot(runs[2], runs[:2], ("prefix_id",)).collect()} == {"a": "s2", "b": "s2", "c": "s1 later", "d": "d"}
    smoke = spark.createDataFrame([(True, 10, 0.004), (False, 10, 0.004)], "correct boolean, calls long, usd double")
    assert ex.smoke_summary(smoke).first().passed and not ex.smoke_summary(smoke.unionByName(smoke)).first().passed and not ex.smoke_summary(smoke.limit(0)).first().passed


def test_sources(spark, tmp_path):
    from marlstone.sources import tables as st

    path = tmp_path / "rows.jsonl"
    path.write_text('{"problem_id": "a", "method": "m", "seq": 1, "correct": true}\n\n{"problem_id": "b", "method": "m", "seq": 2}\n{"problem_id": "c", "meth')
    assert st.read_jsonl(spark, str(path)).count() == 2 and st.read_jsonl(spark, str(tmp_path / "none")).count() == 0
    assert st.load_runs(spark, [str(path), str(path)]).count() == 2
    cache = st.Cache(spark, str(tmp_path / "cache"))
    new = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("l", "3", 3)], "key string, value string, seq int")
    assert cache.add(new) == 2 and cache.add(new) == 0 and {r.value for r in cache.read().collect()} == {"1", "3"}
    aime = spark.createDataFrame([(1, "p", 5, None), (16, "q", 6, None), (3, "r", 7, "x/2024_AIME_II_Problems")], "idx int, problem string, answer int, url string")
    assert [r.id for r in st.aime(aime, 2024).collect()] == ["aime2024/I-01", "aime2024/II-01", "aime2024/II-03"]
    assert "n/a" in st.markdown([{"a": float("nan")}], ["a"])


def test_streams(spark, tmp_path):
    from marlstone.streaming import results

    df = spark.createDataFrame([("p", "m", 1, None, True, "2024-01-01 00:00:00"), ("p", "m", 2, "bad", False, "2024-01-01 00:10:00"), ("q", "m", 3, None, False, "2024-01-01 02:10:00")], "problem_id string, method string, seq int, error string, correct boolean, ts string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = results.latest_success_stream(stream).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.seq for r in spark.table("latest").collect()) == [1, 3]
    q = results.append_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = results.windowed_accuracy(stream).writeStream.format("memory").queryName("acc").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("acc").collect()) == [1, 2]


def test_votes_over_all_samples(spark):
    import duckdb

    from marlstone.operators import votes
    from marlstone.plans import queries as q

    rows = [("p", k, a, s, 1, 0.0) for k, (a, s) in enumerate([("1", 0.2), ("1", 0.1), ("2", 0.3), (None, 0.1), ("3", 0.2), ("2", 0.1), ("2", 0.9), ("4", 0.9)])] + [("q", 0, None, 0.5, 1, 0.0)]
    df = spark.createDataFrame(rows, "problem_id string, i int, answer string, score double, tokens int, usd double")
    assert {(r.problem_id, r.answer, r.votes, r.tokens) for r in votes.majority_vote(df).collect()} == {("p", "2", 3, 8), ("q", None, 0, 1)}
    assert {(r.problem_id, r.answer, r.score, r.tokens) for r in votes.best_of(df).collect()} == {("p", "2", 0.9, 8), ("q", None, 0.5, 1)}
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "part", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    for name in ("majority_vote", "best_of_n", "vote_curve", "bon_curve"):
        got = {tuple(str(x) for x in r) for r in q.queries()[name](spark, d).collect()}
        assert got == {tuple(str(x) for x in r) for r in con.sql(q.oracle_sql()[name]).fetchall()} and got, name
