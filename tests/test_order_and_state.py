"""Admission in order, option orders, sketches, order of files, and streams that are cut and started again, each against a plain loop or a batch."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import probability
from marlstone.operators import budget, stats
from marlstone.sources import tables
from marlstone.streaming import results


def admitted(estimates, cap):
    held, out = 0.0, []
    for x in estimates:
        out.append(held + x <= cap)
        held += x if out[-1] else 0
    return out


def test_folds_skip_what_cannot_fit():
    rng = random.Random(1)
    for _ in range(200):
        estimates = [float(rng.choice([0, 1, 2, 5, 40])) for _ in range(rng.randrange(40))]
        cap = rng.choice([0, 3, 20, 100])
        got, held = budget.fold_admissions(np.array(estimates), 0.0, cap)
        assert got.tolist() == admitted(estimates, cap) and held == sum(x for x, a in zip(estimates, got) if a)


def test_admission_over_many_stretches(spark):
    rng = random.Random(2)
    rows = [("long", k, float(rng.choice([1, 2, 3, 50, 400]))) for k in range(4000)] + [(f"r{k % 50}", k, float(rng.randrange(30))) for k in range(2000)] + [("none", 1, 5000.0), (None, 1, 3.0), (None, 2, 3000.0), (None, 3, 1.0)]
    df = spark.createDataFrame(rows, "run string, seq long, estimate double").withColumn("held", F.lit("x")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.run, r.seq): r.admitted for r in budget.admit_in_order(df, 2000.0, ["run"], ["seq"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for run in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == run)
        want |= {(run, r[1]): a for r, a in zip(own, admitted([r[2] for r in own], 2000.0))}
    assert got == want and budget.admit_in_order(df.limit(0), 1.0, ["run"], ["seq"]).count() == 0
    with pytest.raises(Exception, match="missing or negative"):
        budget.admit_in_order(df.withColumn("estimate", F.lit(-1.0)), 1.0, ["run"], ["seq"]).count()


def plain_order(state, n):
    s, order = int(hashlib.sha256(state.encode()).hexdigest()[:16], 16), list(range(n))
    for i in range(n - 1, 0, -1):
        s = (s * 6364136223846793005 + 1) % 2**64
        j = s % (i + 1)
        order[i], order[j] = order[j], order[i]
    return order


def test_option_orders_equal_a_plain_shuffle(spark):
    df = spark.range(10_000).select(F.concat(F.lit("state é "), F.col("id").cast("string")).alias("state"), (F.col("id") % 9).cast("int").alias("n"))
    got = df.select("state", "n", probability.option_order(F.col("state"), F.col("n")).alias("o")).collect()
    assert all(r.o == plain_order(r.state, r.n) for r in got) and len(got) == 10_000
    values = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda x: x * 10)
    order = probability.option_order(F.col("state"), F.lit(7))
    back = df.select(probability.unshuffle(F.transform(order, lambda k: F.get(values, k)), order).alias("v")).distinct().collect()
    assert [r.v for r in back] == [[0, 10, 20, 30, 40, 50, 60]]
    assert spark.range(1).select(probability.option_order(F.lit(None).cast("string"), F.lit(3)).alias("o")).first().o is None


def test_sketches_keep_their_rank_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 100 > 0, (F.xxhash64("id") % 10_000).cast("double")).alias("v"))
    worst = stats.rank_errors(df, "v", [0.01, 0.25, 0.5, 0.9, 0.99], ["g"]).agg(F.max("error"), F.count("*")).first()
    assert worst[0] <= stats.RANK_ERROR and worst[1] == 15
    one = stats.sketched_quantiles(spark.createDataFrame([(1, 5.0), (1, None), (2, None)], "g int, v double"), "v", [0.5], ["g"]).collect()
    assert [(r.g, r.n, r.q) for r in one] == [(1, 1, [5.0])]


def test_rows_as_they_stand_in_files(spark, tmp_path):
    folder = tmp_path / "sets"
    folder.mkdir()
    rng, want = random.Random(3), []
    for name in ("a.jsonl", "b.jsonl"):
        rows = [{"id": f"{name}-{rng.randrange(10**9)}", "question": "q" * rng.randrange(200), "source": rng.choice(["math500", "aime2024", "aime2025"]), "level": rng.choice([1, 5, None])} for _ in range(400)]
        want += rows
        (folder / name).write_text("\n".join([*map(json.dumps, rows), "", "no json", "  "]))
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = tables.in_file_order(spark, str(folder))
            assert [r.id for r in df.orderBy("place").collect()] == [x["id"] for x in want]
            assert [r.id for r in tables.problem_set(df, "aime", 30).orderBy("place").collect()] == [x["id"] for x in want if x["source"].startswith("aime")][:30]
            assert tables.problem_set(df, "aime2025", levels=(5,)).count() == sum(x["source"] == "aime2025" and x["level"] == 5 for x in want)
            seen = [r.source for r in tables.first_seen(df, ["source"], "place", n=F.count("*")).orderBy("seen").collect()]
            assert seen == list(dict.fromkeys(x["source"] for x in want))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="no problem set"):
        tables.problem_set(df, "gsm")
    assert tables.in_file_order(spark, str(tmp_path / "absent")).count() == 0


@pytest.fixture
def state_store(spark):
    for key, value in results.STATE_STORE.items():
        spark.conf.set(key, value)
    yield
    for key in results.STATE_STORE:
        spark.conf.unset(key)


ROWS = "problem_id string, method string, seq long, error string, correct boolean"


def test_latest_success_over_restarts(spark, tmp_path, state_store):
    from marlstone.operators.rows import latest_success

    rng = random.Random(5)
    rows = [(f"p{rng.randrange(12)}", rng.choice("ab"), k, rng.choice([None, None, "", "down"]), rng.random() > 0.5) for k in range(150)]
    rng.shuffle(rows)
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k in range(3):  # the stream ends after each part and goes on from its checkpoint
        spark.createDataFrame(rows[50 * k:50 * k + 50], ROWS).coalesce(1).write.mode("append").parquet(source)
        results.upserts(results.latest_success_state(spark.readStream.schema(ROWS).parquet(source)), out, at).awaitTermination()
    told = spark.read.parquet(out)
    last = told.groupBy("problem_id", "method").agg(F.max_by(F.struct("seq", "error", "correct"), "batch").alias("r")).select("problem_id", "method", "r.*")
    want = latest_success(spark.createDataFrame(rows, ROWS))
    assert sorted(map(tuple, last.collect()), key=str) == sorted(((r.problem_id, r.method, r.seq, r.error, r.correct) for r in want.collect()), key=str)
    assert told.select("batch").distinct().count() == 3 and told.count() < 150


def test_ledger_stops_at_its_cap_over_restarts(spark, tmp_path, state_store):
    rows = [(run, k, usd) for run, usd in (("a", 0.5), ("b", 0.25), ("c", 9.0)) for k in range(12)]
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == k], "run string, seq long, usd double").coalesce(1).write.mode("append").parquet(source)
        results.upserts(results.running_ledger(spark.readStream.schema("run string, seq long, usd double").parquet(source), 2.25), out, at).awaitTermination()
    got = {(r.run, r.seq): (r.spent, r.charged) for r in spark.read.parquet(out).collect()}
    for run in "abc":
        spent = 0.0
        for r in (r for r in rows if r[0] == run):
            charged = spent <= 2.25
            spent += r[2] if charged else 0
            assert got[run, r[1]] == (spent, charged)


def test_resumed_stream_leaves_out_what_is_done(spark, tmp_path):
    spark.createDataFrame([("p1", "m", 1, None, True), ("p2", "m", 1, "down", False)], ROWS).write.parquet(str(tmp_path / "done"))
    spark.createDataFrame([(f"p{k}",) for k in range(4)], "problem_id string").write.parquet(str(tmp_path / "in"))
    done = spark.read.parquet(str(tmp_path / "done"))
    for retry, want in ((False, {"p0", "p3"}), (True, {"p0", "p2", "p3"})):
        stream = spark.readStream.schema("problem_id string").parquet(str(tmp_path / "in"))
        results.append_table(results.resume_stream(stream, done, ("problem_id",), retry), str(tmp_path / f"out{retry}"), str(tmp_path / f"at{retry}")).awaitTermination()
        assert {r.problem_id for r in spark.read.parquet(str(tmp_path / f"out{retry}")).collect()} == want
