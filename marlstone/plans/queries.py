"""The engine's own queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import algebra, answers, probability, text
from marlstone.operators import analysis, budget, candidates, experiments, resample, rows, sampling, stats, tree, votes
from marlstone.plans import bindings as b
from marlstone.sources import reports
from marlstone.sources.shared import Written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
BOOT = stats.N_BOOT


def _query(sql: str | None = None):
    def register(f):
        name = f.__name__.rstrip("_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql.replace("WITH ", "WITH RECURSIVE ", 1) if "boot_rank" in sql and "RECURSIVE" not in sql else sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def latest(spark: SparkSession, d: str) -> DataFrame:
    return rows.latest_success(b.result_rows(spark, d))


# Rows: dedupe, merge, resume, shards.

@_query(f"WITH {b.LATEST} SELECT problem_id, method, seq, error, correct, compute_tokens FROM latest")
def dedupe_latest_success(spark, d):
    return latest(spark, d).select("problem_id", "method", "seq", "error", "correct", "compute_tokens")


@_query(f"WITH {b.RESULT_ROWS}, u AS (SELECT *, 0 AS run_no FROM result_rows WHERE seq % 2 = 0 UNION ALL SELECT *, 1 FROM result_rows WHERE seq % 2 = 1) "
        "SELECT problem_id, method, seq, correct FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, method ORDER BY (coalesce(error, '') <> ''), run_no DESC, seq DESC) AS rn FROM u) WHERE rn = 1")
def merge_runs(spark, d):
    r = b.result_rows(spark, d)
    return rows.merge_runs([r.where("seq % 2 = 0"), r.where("seq % 2 = 1")], allow_mixed=True).select("problem_id", "method", "seq", "correct")


@_query(f"WITH {b.RESULT_ROWS} SELECT DISTINCT problem_id FROM result_rows a WHERE NOT EXISTS (SELECT 1 FROM result_rows z WHERE z.problem_id = a.problem_id AND z.method = 'purchase' AND z.seq % 3 = 0 AND coalesce(z.error, '') = '')")
def resume_todo(spark, d):
    r = b.result_rows(spark, d)
    return rows.resume(r.select("problem_id").distinct(), r.where("method = 'purchase' and seq % 3 = 0"), ("problem_id",), retry_errors=True)


@_query("SELECT c_name AS problem_id, CASE (('0x' || substr(sha256(c_name), 64, 1))::INT % 4) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS shard FROM customer")
def shard_assignment(spark, d):
    return b.table(spark, d, "customer").select(F.col("c_name").alias("problem_id"), text.shard_of(F.col("c_name"), 4).cast("int").alias("shard"))


@_query(f"WITH {b.RESULT_ROWS}, h AS (SELECT method || '[' || (k % 2) || ']' AS method_id, CASE WHEN k % 5 = 0 THEN 'configuration' ELSE protocol_hash || parity::VARCHAR END AS hash FROM result_rows) SELECT method_id, count(DISTINCT hash) AS n_protocols FROM h GROUP BY method_id HAVING count(DISTINCT hash) > 1")
def mixed_protocol_check(spark, d):
    r = b.result_rows(spark, d).withColumn("protocol_hash", F.when(F.col("k") % 5 != 0, F.concat("protocol_hash", F.col("parity").cast("string"))).otherwise(""))
    return rows.mixed_protocols(_variants(r, 2).withColumn("config_hash", F.lit("configuration")))


@_query(f"WITH {b.RESULT_ROWS} SELECT problem_id, count(*) AS n FROM result_rows GROUP BY problem_id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return rows.duplicate_ids(b.result_rows(spark, d))


@_query("WITH c AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity < 5), n AS (SELECT l_partkey AS key, l_suppkey AS value, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem WHERE l_quantity >= 45) "
        "SELECT key, value FROM n WHERE rn = 1 AND key NOT IN (SELECT key FROM c)")
def cache_import(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"))
    return rows.insert_if_absent(li.where("l_quantity < 5"), li.where("l_quantity >= 45")).select("key", "value")


@_query("WITH req AS (SELECT o_orderkey AS id, o_custkey AS key FROM orders), c AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0) SELECT id, req.key, value, value IS NOT NULL AS hit FROM req LEFT JOIN c ON req.key = c.key")
def cache_probe(spark, d):
    cache = b.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    req = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    return rows.probe(req, cache).select("id", "key", "value", F.col("value").isNotNull().alias("hit"))


@_query(f"WITH {b.RESULT_ROWS} SELECT DISTINCT CASE WHEN k % 3 = 0 THEN method ELSE method || '[k=' || (k % 3) || ',n=' || (k % 2) || ']' END AS method_id FROM result_rows")
def method_ids(spark, d):
    k = F.col("k")
    params = F.when(k % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("n"), (k % 2).cast("string"), F.lit("k"), (k % 3).cast("string")))
    return b.result_rows(spark, d).select(text.method_id(F.col("method"), params).alias("method_id")).distinct()


@_query(f"WITH {b.RESULT_ROWS}, s AS (SELECT DISTINCT method, problem_id FROM result_rows WHERE NOT (method = 'view' AND level = 2)), f AS (SELECT arg_min(method, seq) AS m FROM result_rows WHERE NOT (method = 'view' AND level = 2)), "
        "ref AS (SELECT problem_id FROM s, f WHERE method = m) SELECT method, count(*) - count(ref.problem_id) AS added, (SELECT count(*) FROM ref) - count(ref.problem_id) AS missing FROM s LEFT JOIN ref USING (problem_id) GROUP BY method")
def id_set_diff(spark, d):
    return rows.problem_set_differences(b.result_rows(spark, d).where("not (method = 'view' and level = 2)"))


# Analysis by method.

def _variants(r: DataFrame, n: int = 4) -> DataFrame:
    return r.withColumn("method_id", F.concat("method", F.lit("["), (F.col("k") % n).cast("string"), F.lit("]")))


_IDS = "ids AS (SELECT *, method || '[' || (k % 4) || ']' AS method_id, k % 7 / 8.0::DOUBLE AS wall_time, (5 + k)::BIGINT AS prompt_tokens, (k % 3)::BIGINT AS calls FROM latest)"


def _fields(r: DataFrame) -> DataFrame:
    return _variants(r).withColumn("wall_time", F.col("k") % 7 / 8.0).withColumn("prompt_tokens", (F.col("k") + 5).cast("long")).withColumn("calls", (F.col("k") % 3).cast("long"))


def _mix(x: str, y: str) -> str:
    """Columns y1, y2, y of the 32-bit finalizer of the column x."""
    a, c = resample.FINAL
    return f"((xor({x}, {x} >> 16) * {a}::UBIGINT) & 4294967295) AS {y}1, ((xor({y}1, {y}1 >> 13) * {c}::UBIGINT) & 4294967295) AS {y}2, xor({y}2, {y}2 >> 16) AS {y}"


def _draws(g: str, source: str = "vals", cluster: str = "problem_id", sums: str = "sum(w * x) / sum(w) AS mean", name: str = "means", by: str = "", seed: int = 0) -> str:
    """A row for each draw and group (and `by`), of `source` with the groups, the cluster and what the sums need; w is how often the draw has the row's cluster.

    A draw's n are split by ranks: of those that fall on lo..hi, each goes to the lower half if its hash is below that half's share.
    """
    s, b_, lo, hi = resample.MIX
    one = f"{g}, " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    return f"""{name}_r AS (SELECT *, max(boot_rank + 1) OVER ({part}) AS boot_n FROM (SELECT z.*, dense_rank() OVER ({part}ORDER BY {cluster}) - 1 AS boot_rank FROM {source} z)),
{name}_t(n, b, lo, hi, c) AS (
  SELECT n, b, 0::UBIGINT, n, n FROM (SELECT DISTINCT boot_n::UBIGINT AS n FROM {name}_r), (SELECT r.range::UBIGINT AS b FROM range({BOOT}) r)
  UNION ALL
  SELECT n, b, if(k = 0, lo, mid), if(k = 0, mid, hi), if(k = 0, l, c - l) FROM (
    SELECT n, b, lo, hi, c, (lo + hi) // 2 AS mid, (count(*) FILTER (u * (hi - lo) < ((((lo + hi) // 2) - lo) << 32)))::UBIGINT AS l FROM (
      SELECT n, b, lo, hi, c, ((key + j * {s}::UBIGINT) & 4294967295) AS v, {_mix('v', 'u')} FROM (
        SELECT n, b, lo, hi, c, unnest(range(c::BIGINT))::UBIGINT AS j, (({seed * s}::UBIGINT + b * {b_}::UBIGINT + lo * {lo}::UBIGINT + hi * {hi}::UBIGINT) & 4294967295) AS h, {_mix('h', 'key')} FROM {name}_t WHERE hi - lo > 1))
    GROUP BY n, b, lo, hi, c), (VALUES (0), (1)) q(k) WHERE if(k = 0, l, c - l) > 0),
{name} AS (SELECT {one}b{', ' + by if by else ''}, {sums} FROM (SELECT r.*, t.b::INT AS b, t.c::BIGINT AS w FROM {name}_r r JOIN {name}_t t ON t.n = r.boot_n AND t.lo = r.boot_rank AND t.hi = r.boot_rank + 1) GROUP BY ALL)"""


def _interval(x: str = "mean", lo: str = "lo", hi: str = "hi") -> str:
    return f"round(quantile_cont({x}, 0.025), 6) AS {lo}, round(quantile_cont({x}, 0.975), 6) AS {hi}"


_POINTS = "min(method) AS method, count(*) AS n, count(*) FILTER (coalesce(error, '') <> '') AS n_errors, round(avg(correct::INT), 6) AS accuracy, round(avg(compute_tokens), 6) AS mean_tokens, round(avg(wall_time), 6) AS mean_wall_time, round(sum(usd), 9) AS usd"
_CI = f"vals AS (SELECT method_id, problem_id, correct::INT AS x FROM ids), {_draws('method_id')}, ci AS (SELECT method_id, {_interval()} FROM means GROUP BY method_id)"


@_query(f"WITH {b.LATEST}, {_IDS}, {_CI} SELECT p.*, lo, hi FROM (SELECT method_id, {_POINTS} FROM ids GROUP BY method_id) p JOIN ci USING (method_id)")
def method_points(spark, d):
    return analysis.in_display_order(analysis.points_with_intervals(_fields(Written(latest(spark, d), "latest").df))).select("method_id", "method", "n", "n_errors", *r6("accuracy", "mean_tokens", "mean_wall_time"), F.round("usd", 9).alias("usd"), *r6("lo", "hi"))


@_query(f"WITH {b.LATEST}, {_IDS}, {_CI} SELECT ids.method_id, min(method) AS method, count(*) AS n, count(*) FILTER (coalesce(error, '') <> '') AS n_errors, round(avg(correct::INT), 6) AS accuracy, any_value(lo) AS lo, any_value(hi) AS hi, round(avg(compute_tokens), 6) AS mean_tokens, round(quantile_cont(compute_tokens, 0.5), 6) AS median_tokens, "
        "round(avg(prompt_tokens), 6) AS mean_prompt_tokens, sum(calls)::BIGINT AS calls_total, round(avg(calls), 6) AS calls_mean, round(sum(usd), 9) AS usd_total, round(avg(usd), 9) AS usd_mean, round(sum(wall_time), 6) AS wall_time_total, round(avg(wall_time), 6) AS wall_time_mean FROM ids JOIN ci USING (method_id) GROUP BY ids.method_id")
def summary(spark, d):
    out = analysis.summary(_fields(Written(latest(spark, d), "latest").df))
    return out.select("method_id", "method", "n", "n_errors", *r6("accuracy", "lo", "hi", "mean_tokens", "median_tokens", "mean_prompt_tokens"), F.col("calls_total").cast("long").alias("calls_total"), *r6("calls_mean"), *[F.round(c, 9).alias(c) for c in ("usd_total", "usd_mean")], *r6("wall_time_total", "wall_time_mean"))


def _by(key: str, name: str, where: str) -> str:
    vals = f"vals AS (SELECT method AS method_id, {key} AS {name}, problem_id, correct::INT AS x FROM latest WHERE {where})"
    exact = f"(SELECT method_id, {name}, count(*) AS n, avg(x) AS accuracy FROM vals GROUP BY ALL)"
    return f"{vals}, {_draws(f'method_id, {name}')} SELECT v.method_id, v.{name}, any_value(v.n) AS n, round(any_value(v.accuracy), 6) AS accuracy, {_interval()} FROM means JOIN {exact} v USING (method_id, {name}) GROUP BY v.method_id, v.{name}"


@_query(f"WITH {b.LATEST}, " + _by("level", "level", "source LIKE 'math%'"))
def accuracy_by_level(spark, d):
    return analysis.accuracy_by(analysis.math_only(latest(spark, d)), "level").select("method_id", "level", "n", *r6("accuracy", "lo", "hi"))


@_query(f"WITH {b.LATEST}, " + _by("regexp_extract(source, '(19|20)[0-9][0-9]')::INT >= 2024", "after_cutoff", "source LIKE 'aime%'"))
def cutoff_split(spark, d):
    return analysis.cutoff_split(latest(spark, d), 2024).select("method_id", "after_cutoff", "n", *r6("accuracy", "lo", "hi"))


@_query(f"WITH {b.LATEST}, g AS (SELECT method, method || '[' || (k % 4) || ']' AS method_id, avg(compute_tokens) AS t FROM latest GROUP BY ALL) SELECT method, method_id FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY t DESC, method_id DESC) AS rn FROM g) WHERE rn = 1")
def top_compute(spark, d):
    return analysis.top_compute(_variants(latest(spark, d)))


@_query(f"WITH {b.LATEST} SELECT (1 << (k % 4))::INT AS n_sims, round(avg(compute_tokens), 6) AS mean_tokens FROM latest WHERE method = 'click' GROUP BY 1")
def tokens_per_nsim(spark, d):
    return analysis.tokens_per(latest(spark, d).where("method = 'click'"), F.pow(F.lit(2), F.col("k") % 4).cast("int"), "n_sims").select("n_sims", *r6("mean_tokens"))


@_query(f"WITH {b.LATEST} SELECT method, count(*) AS n, count(*) FILTER (coalesce(error, '') <> '') AS n_errors, count(DISTINCT problem_id) AS n_problems FROM latest GROUP BY method")
def audit_counts(spark, d):
    return analysis.audit(latest(spark, d))


@_query(f"WITH {b.LATEST} SELECT method, count(*) AS n, round(avg(CASE WHEN k % 3 <> 0 THEN k END), 6) AS mean_nodes, max(CASE WHEN k % 3 <> 0 THEN k END) AS max_nodes, count(CASE WHEN k % 3 <> 0 THEN k END) AS with_stats FROM latest GROUP BY method")
def search_diagnostics(spark, d):
    r = latest(spark, d).withColumn("nodes", F.when(F.col("k") % 3 != 0, F.col("k")))
    return analysis.diagnostics(r, ["nodes"]).select("method", "n", *r6("mean_nodes"), "max_nodes", F.col("with_nodes").alias("with_stats"))


@_query(f"WITH {b.LATEST}, vals AS (SELECT method, problem_id, correct::INT AS x FROM latest), {_draws('method')} "
        f"SELECT means.method, any_value(a.n) AS n, round(any_value(a.accuracy), 6) AS accuracy, {_interval()} FROM means JOIN (SELECT method, count(*) AS n, avg(x) AS accuracy FROM vals GROUP BY method) a USING (method) GROUP BY means.method")
def bootstrap_accuracy_ci(spark, d):
    return stats.accuracy_interval(Written(latest(spark, d), "latest").df, ["method"]).select("method", "n", *r6("accuracy", "lo", "hi"))


@_query(f"WITH {b.LATEST}, vals AS (SELECT method, problem_id, compute_tokens::DOUBLE AS x FROM latest), {_draws('method', sums='list_concat_all AS mean').split('means AS (')[0].rstrip().rstrip(',')}, "
        f"copied AS (SELECT method, b, x, unnest(range(c::BIGINT)) FROM means_r r JOIN means_t t ON t.n = r.boot_n AND t.lo = r.boot_rank AND t.hi = r.boot_rank + 1), means AS (SELECT method, b, quantile_cont(x, 0.5) AS mean FROM copied GROUP BY ALL) "
        f"SELECT method, any_value(a.m) AS median, {_interval()} FROM means JOIN (SELECT method, round(quantile_cont(x, 0.5), 6) AS m FROM vals GROUP BY method) a USING (method) GROUP BY method")
def bootstrap_median(spark, d):
    r = Written(latest(spark, d), "latest").df
    ends = stats.percentile_interval(resample.bootstrap_quantile(r, "compute_tokens", 0.5, ["method"], "problem_id"), "value", ["method"])
    return r.groupBy("method").agg(F.percentile("compute_tokens", F.lit(0.5)).alias("median")).join(ends, "method").select("method", *r6("median", "lo", "hi"))


@_query(f"WITH {b.SCORED}, {_draws('variant', 'scored', sums='sum(w) AS n, sum(w * score) AS x, sum(w * soft) AS y, sum(w * score * score) AS xx, sum(w * soft * soft) AS yy, sum(w * score * soft) AS xy', name='sums')}, means AS (SELECT variant, (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) AS mean FROM sums) "
        f"SELECT variant, any_value(c) AS correlation, {_interval()} FROM means JOIN (SELECT variant, round(corr(score, soft), 6) AS c FROM scored GROUP BY variant) USING (variant) GROUP BY variant")
def bootstrap_correlation(spark, d):
    s = Written(b.scored(spark, d), "scored").df
    x, y = F.col("score"), F.col("soft")
    sums = {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    draws = resample.bootstrap(s, sums, F.try_divide(F.expr("n * xy - x * y"), F.sqrt(F.expr("(n * xx - x * x) * (n * yy - y * y)"))), ["variant"], "problem_id")
    return s.groupBy("variant").agg(F.corr("score", "soft").alias("correlation")).join(stats.percentile_interval(draws, "value", ["variant"]), "variant").select("variant", *r6("correlation", "lo", "hi"))


def _paired(g: str) -> str:
    return f"SELECT {g}, round(any_value(v.diff), 6) AS diff, {_interval()}, round(least(1, 2 * least(avg((mean <= 0)::INT), avg((mean >= 0)::INT))), 6) AS p_value, any_value(v.n) AS n FROM means JOIN (SELECT {g}, avg(x) AS diff, count(*) AS n FROM vals GROUP BY ALL) v USING ({g}) GROUP BY {g}"


@_query(f"WITH {b.LATEST}, vals AS (SELECT a.method, a.problem_id, a.correct::INT - z.correct::INT AS x FROM latest a JOIN latest z ON a.problem_id = z.problem_id AND z.method = 'click' WHERE a.method <> 'click'), {_draws('method')} {_paired('method')}")
def paired_diff(spark, d):
    pairs = analysis.paired(Written(latest(spark, d), "latest").df, "click")
    return stats.paired_difference(pairs, ["method"]).select("method", *r6("diff", "lo", "hi", "p_value"), "n")


_COST = "cost AS (SELECT method_id, method, avg(compute_tokens) AS t FROM ids GROUP BY ALL)"
_NEAREST = "near AS (SELECT a.method_id, arg_min(z.method_id, (abs(ln(a.t) - ln(z.t)), z.method_id)) AS nearest FROM cost a, cost z WHERE a.method <> 'click' AND z.method = 'click' GROUP BY a.method_id)"


@_query(f"WITH {b.LATEST}, {_IDS}, {_COST}, {_NEAREST} FROM near")
def nearest_by_compute(spark, d):
    cost = _variants(latest(spark, d)).groupBy("method_id", "method").agg(F.avg("compute_tokens").alias("tokens"))
    return analysis.nearest_by_compute(cost.where("method <> 'click'"), cost.where("method = 'click'"))


# A variant has other problems than one of `click`; the pairs are those that both have, as `common` asks.
@_query(f"""WITH {b.LATEST}, {_IDS}, {_COST}, {_NEAREST}, cvals AS (SELECT method_id, problem_id, correct::INT AS x FROM ids), {_draws('method_id', 'cvals', name='cmeans')}, ci AS (SELECT method_id, {_interval()} FROM cmeans GROUP BY method_id),
vals AS (SELECT near.method_id, a.problem_id, a.correct::INT - z.correct::INT AS x FROM near JOIN ids a ON a.method_id = near.method_id JOIN ids z ON z.method_id = near.nearest AND z.problem_id = a.problem_id), {_draws('method_id')}, pd AS ({_paired('method_id')})
SELECT p.*, ci.lo, ci.hi, CASE WHEN pd.method_id IS NOT NULL THEN near.nearest END AS vs, pd.diff, pd.lo AS diff_lo, pd.hi AS diff_hi, pd.p_value, CASE WHEN pd.method_id IS NOT NULL THEN round(c.t / cb.t, 6) END AS compute_ratio
FROM (SELECT method_id, {_POINTS} FROM ids GROUP BY method_id) p JOIN ci USING (method_id) JOIN cost c USING (method_id) LEFT JOIN near USING (method_id) LEFT JOIN cost cb ON cb.method_id = near.nearest LEFT JOIN pd ON pd.method_id = p.method_id""")
def main_table(spark, d):
    t = analysis.main_table(Written(_fields(latest(spark, d)), "latest").df, "click", common=True)
    return t.select("method_id", "method", "n", "n_errors", *r6("accuracy", "mean_tokens", "mean_wall_time"), F.round("usd", 9).alias("usd"), *r6("lo", "hi"), "vs", *r6("diff", "diff_lo", "diff_hi", "p_value", "compute_ratio"))


_PERCENT = "CASE WHEN {c} IS NULL THEN 'n/a' ELSE printf('%{s}.1f', round_even({c} * 100, 1)) END"


def _pct(c: str, s: str = "") -> str:
    return _PERCENT.format(c=c, s=s)


@_query(_SQL["main_table"].replace("SELECT p.*, ci.lo", ", mt AS (SELECT p.*, ci.lo", 1) + f""") SELECT method_id, n::VARCHAR AS n, {_pct('accuracy')} || '%' AS accuracy, printf('%.0f', round_even(mean_tokens, 0)) AS tokens, coalesce(vs, '') AS vs, CASE WHEN vs IS NULL THEN '' ELSE {_pct('diff', '+')} || ' pp' END AS difference, CASE WHEN vs IS NULL THEN '' ELSE printf('%.2fx', round_even(compute_ratio, 2)) END AS compute FROM mt""")
def main_table_text(spark, d):
    t = reports.main_table_text(main_table(spark, d))
    return t.select("method_id", "n", F.substring_index("accuracy", " ", 1).alias("accuracy"), "tokens", "vs", F.substring_index("difference", " [", 1).alias("difference"), "compute")


@_query(f"WITH {b.LATEST} SELECT problem_id, method, seq FROM latest WHERE coalesce(error, '') = '' ORDER BY sha256('7:' || problem_id || '|' || method), problem_id || '|' || method LIMIT 40")
def audit_sample(spark, d):
    return analysis.audit_sample(latest(spark, d), 40, 7).select("problem_id", "method", "seq")


@_query(f"WITH {b.TRACES}, t AS (SELECT n_steps % 3 = 0 AS ok FROM traces) SELECT count(*) AS n, CASE WHEN avg(ok::INT) NOT BETWEEN 0.4 AND 0.7 THEN 'accuracy ' || printf('%.3f', round_even(avg(ok::INT), 3)) || ' is not in [0.4, 0.7]' END AS warning FROM t")
def trace_sanity(spark, d):
    t = b.traces(spark, d).withColumn("trace_correct", F.col("n_steps") % 3 == 0).withColumn("final_answer", F.lit("x"))
    return analysis.trace_sanity(t).select("n", "warning")


# Calibration.

_AUC = """bys AS (SELECT {g}, score, sum(label::INT) AS pos, sum(1 - label::INT) AS neg FROM scored GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY {g} ORDER BY score) - neg AS below FROM bys),
auc AS (SELECT {g}, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) END AS auroc FROM cum GROUP BY ALL)"""
_ECE = "bins AS (SELECT {g}, least(9, greatest(0, floor(score * 10)::INT)) AS bin, count(*) AS c, abs(sum(score) - sum(soft)) AS gap FROM scored GROUP BY ALL), ec AS (SELECT {g}, sum(gap) / sum(c) AS ece FROM bins GROUP BY ALL)"
_PLAIN = "pl AS (SELECT {g}, count(*) AS n, count(DISTINCT problem_id) AS n_problems, avg(pow(score - soft, 2)) AS brier FROM scored GROUP BY ALL)"


def _metrics(g: str) -> str:
    return f"WITH {b.SCORED}, {_AUC.format(g=g)}, {_ECE.format(g=g)}, {_PLAIN.format(g=g)} SELECT {{k}}n, n_problems, round(auroc, 6) AS auroc, round(brier, 6) AS brier, round(ece, 6) AS ece FROM pl JOIN auc USING ({g}) JOIN ec USING ({g})"


@_query(_metrics("one").replace(b.SCORED, b.SCORED + ", all1 AS (SELECT *, 1 AS one FROM scored)").replace("FROM scored GROUP", "FROM all1 GROUP").format(k=""))
def judge_metrics(spark, d):
    return stats.judge_metrics(b.scored(spark, d), []).select("n", "n_problems", *r6("auroc", "brier", "ece"))


@_query(_metrics("variant").format(k="variant, "))
def prompt_sensitivity(spark, d):
    return stats.judge_metrics(b.scored(spark, d), ["variant"]).select("variant", "n", "n_problems", *r6("auroc", "brier", "ece"))


@_query(f"WITH {b.SCORED}, {_AUC.format(g='problem_id')} SELECT problem_id, round(auroc, 6) AS auroc FROM auc")
def auroc(spark, d):
    return stats.auroc(b.scored(spark, d), ["problem_id"]).select("problem_id", *r6("auroc"))


@_query(f"WITH {b.SCORED} SELECT problem_id, round(avg(pow(score - soft, 2)), 6) AS brier FROM scored GROUP BY problem_id")
def brier(spark, d):
    return b.scored(spark, d).groupBy("problem_id").agg(stats.brier().alias("brier")).select("problem_id", *r6("brier"))


@_query(f"WITH {b.SCORED}, {_ECE.format(g='problem_id')} SELECT problem_id, round(ece, 6) AS ece FROM ec")
def ece(spark, d):
    return stats.ece(b.scored(spark, d), ["problem_id"]).select("problem_id", *r6("ece"))


@_query(f"WITH {b.SCORED}, f AS (SELECT least(9, greatest(0, floor(score * 10)::INT)) AS bin, count(*) AS n, avg(score) AS s, avg(soft) AS l FROM scored GROUP BY 1) SELECT k::INT AS bin, round(k / 10, 6) AS lo, round((k + 1) / 10, 6) AS hi, coalesce(n, 0) AS n, round(s, 6) AS mean_score, round(l, 6) AS mean_label FROM range(10) r(k) LEFT JOIN f ON f.bin = r.k")
def reliability(spark, d):
    return stats.reliability(b.scored(spark, d)).select("bin", *r6("lo", "hi"), "n", *r6("mean_score", "mean_label"))


@_query(f"WITH {b.SCORED}, bk(bucket, lo, hi) AS (VALUES ('1-2', 1, 2), ('3-5', 3, 5), ('6-9', 6, 9), ('10+', 10, 1000000)) SELECT bucket, count(depth) AS n, round(avg(label::INT), 6) AS accuracy, round(avg(score), 6) AS mean_score FROM bk LEFT JOIN scored ON depth BETWEEN lo AND hi GROUP BY bucket")
def by_depth(spark, d):
    s = F.col("label").cast("double")
    return stats.by_depth(b.scored(spark, d), {"accuracy": F.avg(s), "mean_score": F.avg("score")}).select("bucket", "n", *r6("accuracy", "mean_score"))


@_query(f"WITH {b.SCORED} SELECT count(*) AS n, round(avg(label::INT), 6) AS hard_rate, round(avg(soft), 6) AS mean_soft, round(avg(terminal::INT), 6) AS terminal_share, count(*) FILTER (soft < 1e-9) AS h0, count(*) FILTER (soft >= 1e-9 AND soft < 0.25) AS h1, count(*) FILTER (soft >= 0.25 AND soft < 0.5) AS h2, count(*) FILTER (soft >= 0.5 AND soft < 0.75) AS h3, count(*) FILTER (soft >= 0.75 AND soft < 1 - 1e-9) AS h4, count(*) FILTER (soft >= 1 - 1e-9) AS h5 FROM scored")
def label_stats(spark, d):
    return stats.label_stats(b.scored(spark, d)).select("n", *r6("hard_rate", "mean_soft", "terminal_share"), *[f"h{k}" for k in range(6)])


@_query(f"WITH {b.TRACES}, t AS (SELECT *, CASE WHEN n_steps % 3 <> 0 THEN 'x' END AS a FROM traces) SELECT count(*) AS n, round(avg((n_steps % 2 = 0)::INT), 6) AS accuracy, count(*) FILTER (a IS NULL) AS no_answer, round(avg(n_steps), 6) AS mean_steps, round(avg((n_steps = 0)::INT), 6) AS zero_share, round(avg((n_steps = 1)::INT), 6) AS one_share FROM t")
def trace_stats(spark, d):
    t = b.traces(spark, d).withColumn("trace_correct", F.col("n_steps") % 2 == 0).withColumn("final_answer", F.when(F.col("n_steps") % 3 != 0, "x"))
    return stats.trace_stats(t).select("n", *r6("accuracy"), "no_answer", *r6("mean_steps", "zero_share", "one_share"))


@_query(f"WITH {b.SCORED}, {_AUC.format(g='problem_id')} SELECT problem_id, CASE WHEN auroc IS NULL THEN 'UNAVAILABLE' WHEN auroc >= 0.75 THEN 'GO' WHEN auroc >= 0.65 THEN 'PARTIAL' ELSE 'NO-GO' END AS verdict FROM auc")
def decision(spark, d):
    return stats.auroc(b.scored(spark, d), ["problem_id"]).select("problem_id", stats.decide(F.col("auroc")).alias("verdict"))


@_query(f"WITH {b.SCORED} SELECT (SELECT count(*) FROM scored) AS n_prefixes, (SELECT count(*) FROM scored WHERE depth <= 10) AS n_labelled, (SELECT count(*) FROM scored WHERE variant = 0) AS n_scored, round((SELECT count(*) FROM scored WHERE depth <= 10) / (SELECT count(*) FROM scored), 6) AS fraction, true AS incomplete")
def coverage(spark, d):
    s = b.scored(spark, d)
    return stats.coverage(s, s.where("depth <= 10"), s.where("variant = 0")).select("n_prefixes", "n_labelled", "n_scored", *r6("fraction"), "incomplete")


@_query(f"WITH {b.SCORED} SELECT round(sum(usd), 6) AS usd, sum(calls)::BIGINT AS calls, sum(hits)::BIGINT AS hits, round(sum(usd) / sum(calls), 9) AS usd_per_call, round(quantile_cont(latency, 0.5) FILTER (calls > 0), 6) AS p50, round(quantile_cont(latency, 0.95) FILTER (calls > 0), 6) AS p95 FROM scored")
def cost_latency(spark, d):
    return stats.cost_latency(b.scored(spark, d)).select(*r6("usd"), "calls", "hits", F.round("usd_per_call", 9).alias("usd_per_call"), *r6("p50", "p95"))


def _cluster(g: str) -> str:
    """Draws of whole problems: b, auroc, brier, ece by `g`."""
    k = f"{g}, " if g else ""
    sums = "sum(w * label::INT) AS pos, sum(w * (1 - label::INT)) AS neg, sum(w * pow(score - soft, 2)) AS err, sum(w) AS c, sum(w * (score - soft)) AS gap"
    return f"""{_draws(g, 'scored', sums=sums, name='bys0', by='score')}, cum0 AS (SELECT *, sum(neg) OVER (PARTITION BY {k}b ORDER BY score) - neg AS below FROM bys0),
m AS (SELECT {k}b, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)) END AS auroc, sum(err) / sum(c) AS brier FROM cum0 GROUP BY ALL),
me AS (SELECT {k}b, sum(abs(gap)) / sum(c) AS ece FROM (SELECT {k}b, least(9, greatest(0, floor(score * 10)::INT)) AS bin, sum(gap) AS gap, sum(c) AS c FROM bys0 GROUP BY ALL) GROUP BY ALL),
ends AS (SELECT {k}{_interval('auroc', 'auroc_lo', 'auroc_hi')}, {_interval('brier', 'brier_lo', 'brier_hi')}, {_interval('ece', 'ece_lo', 'ece_hi')} FROM m JOIN me USING ({k}b) GROUP BY ALL)"""


_ENDS = ("auroc_lo", "auroc_hi", "brier_lo", "brier_hi", "ece_lo", "ece_hi")


@_query(f"WITH {b.SCORED}, {_cluster('')} FROM ends")
def cluster_bootstrap(spark, d):
    return stats.interval_columns(stats.cluster_bootstrap(Written(b.scored(spark, d), "scored").df, "problem_id"), ("auroc", "brier", "ece")).select(*r6(*_ENDS))


def _report(g: str) -> str:
    return (f"WITH {b.SCORED}, {_AUC.format(g=g)}, {_ECE.format(g=g)}, {_PLAIN.format(g=g)}, {_cluster(g)}, ps AS (SELECT {g}, sum(label::INT) AS n_positive FROM scored GROUP BY ALL) SELECT {g}, n, n_problems, round(auroc, 6) AS auroc, round(brier, 6) AS brier, round(ece, 6) AS ece, {', '.join(_ENDS)}, n_positive::BIGINT AS n_positive, "
            "CASE WHEN auroc IS NULL THEN 'UNAVAILABLE' WHEN auroc >= 0.75 THEN 'GO' WHEN auroc >= 0.65 THEN 'PARTIAL' ELSE 'NO-GO' END AS verdict, concat_ws(',', CASE WHEN auroc_lo < 0.65 AND 0.65 <= auroc_hi THEN '0.65' END, CASE WHEN auroc_lo < 0.75 AND 0.75 <= auroc_hi THEN '0.75' END) AS open_thresholds, "
            f"CASE WHEN n_positive = n THEN 'all ' || n || ' scored prefixes are correct' WHEN n_positive = 0 THEN 'all ' || n || ' scored prefixes are incorrect' END AS reason FROM pl JOIN auc USING ({g}) JOIN ec USING ({g}) JOIN ends USING ({g}) JOIN ps USING ({g})")


@_query(_report("variant"))
def judge_report(spark, d):
    out = stats.judge_report(Written(b.scored(spark, d), "scored").df, ["variant"])
    return out.select("variant", "n", "n_problems", *r6("auroc", "brier", "ece"), *r6(*_ENDS), "n_positive", "verdict", "open_thresholds", "reason")


@_query(f"WITH {b.SCORED}, {_AUC.format(g='variant')} SELECT count(auroc) AS n_variants, round(min(auroc), 6) AS least, round(max(auroc), 6) AS largest, round(max(auroc) - min(auroc), 6) AS spread FROM auc")
def sensitivity_spread(spark, d):
    return stats.spread(stats.auroc(b.scored(spark, d), ["variant"])).select("n_variants", *r6("least", "largest", "spread"))


_BUCKETED = "bk(bucket, lo, hi) AS (VALUES ('1-2', 1, 2), ('3-5', 3, 5), ('6-9', 6, 9), ('10+', 10, 1000000)), sb AS (SELECT bucket, s.* FROM scored s JOIN bk ON depth BETWEEN lo AND hi)"


@_query(f"WITH {b.SCORED}, {_BUCKETED}, {_AUC.format(g='bucket').replace('FROM scored', 'FROM sb')}, {_ECE.format(g='bucket').replace('FROM scored', 'FROM sb')} SELECT bk.bucket, coalesce(n, 0) AS n, coalesce(p, 0)::BIGINT AS positives, round(auroc, 6) AS auroc, round(ece, 6) AS ece FROM bk LEFT JOIN (SELECT bucket, count(*) AS n, sum(label::INT) AS p FROM sb GROUP BY bucket) USING (bucket) LEFT JOIN auc USING (bucket) LEFT JOIN ec USING (bucket)")
def depth_metrics(spark, d):
    return stats.depth_metrics(b.scored(spark, d)).select("bucket", "n", "positives", *r6("auroc", "ece"))


# Prefixes and labels.

_PREFIX = f"""WITH {b.TRACES}, dep AS (SELECT problem_id, n_steps, unnest(CASE WHEN n_steps <= 4 THEN range(1, n_steps + 1) ELSE list_distinct(list_transform(range(0, 4), lambda i: CASE WHEN i = 3 THEN n_steps ELSE round_even(1 + i * ((n_steps - 1) / 3), 0)::INT END)) END)::INT AS depth FROM traces)"""


@_query(_PREFIX + " SELECT problem_id || '#' || depth AS prefix_id, problem_id, depth, round(depth / n_steps, 6) AS rel_depth, n_steps, depth = n_steps AS is_final FROM dep")
def prefixes(spark, d):
    return sampling.prefixes(b.traces(spark, d), 4).select("prefix_id", "problem_id", "depth", *r6("rel_depth"), "n_steps", "is_final")


@_query(_PREFIX + " SELECT problem_id || '#' || depth AS prefix_id, depth, md5(array_to_string(list_slice(steps, 1, depth), '|')) AS digest FROM dep JOIN traces USING (problem_id)")
def prefix_steps(spark, d):
    t = b.traces(spark, d)
    return sampling.prefix_steps(sampling.prefixes(t, 4), t).select("prefix_id", "depth", F.md5(F.array_join("steps", "|")).alias("digest"))


@_query(f"WITH {b.SAMPLES} SELECT problem_id, count(*) AS n_samples, count(*) FILTER (answer = 'A') AS n_correct, round(count(*) FILTER (answer = 'A') / count(*), 6) AS soft, count(*) FILTER (answer = 'A') > 0 AS hard FROM samples GROUP BY problem_id")
def mc_labels(spark, d):
    return analysis.completion_labels(b.samples(spark, d).withColumn("right", F.col("answer") == "A")).select("problem_id", "n_samples", "n_correct", *r6("soft"), "hard")


@_query(f"WITH {b.SCORED} SELECT l.prefix_id, l.label, s.score FROM scored l JOIN scored s ON l.prefix_id = s.prefix_id WHERE l.depth <= 10 AND s.variant < 2")
def join_scores(spark, d):
    s = b.scored(spark, d).withColumn("seq", F.lit(0))
    return analysis.join_scores(s.where("depth <= 10").select("prefix_id", "label"), s.where("variant < 2").select("prefix_id", "score", "seq")).select("prefix_id", "label", "score")


# Votes.

_SIZES = [1, 3, 5]
_TAKEN = f"WITH {b.SAMPLES}, tk AS (SELECT * FROM samples, (VALUES (1), (3), (5)) s(size) WHERE i < size)"
_VOTE = _TAKEN + """, g AS (SELECT problem_id, size, lower(answer) AS norm, count(*) AS votes, min(i) AS f, arg_min(answer, i) AS answer FROM tk WHERE answer IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, size ORDER BY votes DESC, f) AS rn FROM g) WHERE rn = 1), c AS (SELECT problem_id, size, sum(tokens)::BIGINT AS tokens, max(score) AS m FROM tk GROUP BY ALL)"""
_BEST = "bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, size ORDER BY score DESC, i) AS rn FROM tk) WHERE rn = 1)"


@_query(_VOTE + " SELECT c.problem_id, c.size, w.answer, coalesce(votes, 0) AS votes, c.tokens FROM c LEFT JOIN w ON c.problem_id = w.problem_id AND c.size = w.size")
def vote_curve(spark, d):
    return votes.majority_curve(b.samples(spark, d), _SIZES).select("problem_id", "size", "answer", "votes", "tokens")


@_query(f"""WITH {b.SAMPLES}, g AS (SELECT problem_id, lower(answer) AS norm, count(*) AS votes, min(i) AS f, arg_min(answer, i) AS answer FROM samples WHERE answer IS NOT NULL GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, f) AS rn FROM g) WHERE rn = 1)
SELECT p.problem_id, w.answer, coalesce(votes, 0) AS votes FROM (SELECT DISTINCT problem_id FROM samples) p LEFT JOIN w ON p.problem_id = w.problem_id""")
def majority_vote(spark, d):
    return votes.majority_vote(b.samples(spark, d)).select("problem_id", "answer", "votes")


@_query(_VOTE + ", " + _BEST + " SELECT problem_id, size, bo.answer, bo.score, c.tokens FROM bo JOIN c USING (problem_id, size)")
def bon_curve(spark, d):
    return votes.best_of_curve(b.samples(spark, d), _SIZES).select("problem_id", "size", "answer", "score", "tokens")


@_query(f"WITH {b.SAMPLES} SELECT problem_id, answer, score FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, i) AS rn FROM samples) WHERE rn = 1")
def best_of_n(spark, d):
    return votes.best_of(b.samples(spark, d)).select("problem_id", "answer", "score")


@_query(_VOTE + ", " + _BEST + """, h AS (SELECT problem_id, count(*) AS have, sum(usd) AS u FROM samples GROUP BY problem_id)
SELECT problem_id, 'sc' AS method, c.size AS n, w.answer, c.tokens, 0.0::DOUBLE AS usd FROM c JOIN h USING (problem_id) LEFT JOIN w USING (problem_id, size) WHERE c.size <= have
UNION ALL SELECT problem_id, 'bon', size, bo.answer, c.tokens, round(u * size / have, 12) FROM bo JOIN c USING (problem_id, size) JOIN h USING (problem_id) WHERE size <= have""")
def expand_curves(spark, d):
    return votes.expand_curves(b.samples(spark, d), _SIZES).select("problem_id", "method", "n", "answer", "tokens", F.round("usd", 12).alias("usd"))


@_query(f"""WITH {b.TREE}, g AS (SELECT tree_id, lower(regexp_replace(final_answer, '\\s+', '', 'g')) AS norm, sum(N * value) AS score, sum(N)::BIGINT AS visits FROM tree WHERE terminal GROUP BY ALL)
SELECT tree_id, norm, round(score, 4) AS score, visits FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY score DESC, visits DESC, norm) AS rn FROM g) WHERE rn = 1""")
def value_vote(spark, d):
    norm = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    t = b.tree(spark, d).withColumn("node_id", F.regexp_extract("node_id", r"(\d+)", 1).cast("long"))
    return votes.value_vote(t, norm).select("tree_id", norm(F.col("answer")).alias("norm"), F.round("score", 4).alias("score"), "visits")


# Samples of problems.

@_query(f"WITH {b.PROBLEMS} SELECT id, coalesce(level, -1) AS level FROM problems ORDER BY sha256('0:' || id), id LIMIT 50")
def hash_sample(spark, d):
    return sampling.hash_sample(b.problems(spark, d), 50, 0).select("id", F.coalesce("level", F.lit(-1)).alias("level"))


@_query(f"""WITH {b.PROBLEMS}, s AS (SELECT coalesce(level, -1) AS k, count(*) AS c FROM problems GROUP BY 1), q AS (SELECT k, c, sum(c) OVER () AS t, (200 * c) // sum(c) OVER () AS base, (200 * c) % sum(c) OVER () AS rest FROM s),
z AS (SELECT k, CASE WHEN t <= 200 THEN c ELSE base + (row_number() OVER (ORDER BY rest DESC, k) <= 200 - sum(base) OVER ())::INT END AS quota FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(level, -1) ORDER BY sha256('1:' || id), id) AS p FROM problems) SELECT id, coalesce(level, -1) AS level FROM r JOIN z ON coalesce(level, -1) = k WHERE p <= quota""")
def stratified_sample(spark, d):
    return sampling.stratified_sample(b.problems(spark, d), 200, 1).select("id", F.coalesce("level", F.lit(-1)).alias("level"))


# Texts.

_WS = r"'[ \t\n\r]+'"
_NSTEP = rf"trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(x), '^\s*step\s*\d+\s*[:.)]\s*', ''), {_WS}, ' ', 'g')), '[.;,]+$', ''))"
_LINES = "lines AS (SELECT doc_id, p::INT AS p, ls[p] AS x FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


def _lines(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("c"))


@_query(f"WITH {_LINES} SELECT doc_id, p, md5({_NSTEP}) AS digest FROM lines")
def normalize_step(spark, d):
    return _lines(spark, d).select("doc_id", F.posexplode("c").alias("p", "x")).select("doc_id", (F.col("p") + 1).alias("p"), F.md5(text.normalize_step(F.col("x"))).alias("digest"))


@_query(f"""WITH {_LINES}, t AS (SELECT doc_id, p, list_distinct(list_filter(string_split_regex({_NSTEP}, {_WS}), lambda w: w <> '')) AS k FROM lines)
SELECT a.doc_id, a.p, round(CASE WHEN len(a.k) + len(z.k) = 0 THEN 1.0 ELSE len(list_intersect(a.k, z.k)) / (len(a.k) + len(z.k) - len(list_intersect(a.k, z.k)))::DOUBLE END, 6) AS similarity FROM t a JOIN t z ON a.doc_id = z.doc_id AND z.p = a.p + 1""")
def jaccard_pairs(spark, d):
    """Each line with the next one."""
    forms = _lines(spark, d).select("doc_id", F.transform("c", lambda x: text.tokens(text.normalize_step(x))).alias("t"))
    pairs = F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("x"), F.slice("t", 2, F.size("t") - 1).alias("y"))
    f = forms.where(F.size("t") >= 2).select("doc_id", F.posexplode(pairs).alias("p", "pair"))
    return f.select("doc_id", (F.col("p") + 1).alias("p"), F.round(text.jaccard_of(F.col("pair.x"), F.col("pair.y")), 6).alias("similarity"))


# A fold over all lines of a text; a recursive query in SQL takes too long on whole texts, so a test holds it against brute force.
@_query()
def greedy_dedupe(spark, d):
    return _lines(spark, d).select("doc_id", F.array_join(candidates.greedy_mapping(F.col("c")), ",").alias("mapping"))


@_query("WITH t AS (SELECT conv_id, list(text ORDER BY turn, text) AS s FROM conversations GROUP BY conv_id) SELECT conv_id::VARCHAR AS problem_id, md5(array_to_string(list_transform(s, lambda x, i: 'Step ' || i || ': ' || regexp_replace(x, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10)), '')) AS digest FROM t")
def format_steps(spark, d):
    return b.traces(spark, d).select("problem_id", F.md5(text.format_steps(F.col("steps"))).alias("digest"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' mentions Step 4: here' END AS kept FROM part")
def truncate_next_step(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit("\n\n**Step 4:** leaked"))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" mentions Step 4: here")))
    return b.table(spark, d, "part").select("p_partkey", text.truncate_next_step(raw).alias("kept"))


@_query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '\\frac{' || p_size || '}{7}' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN (p_size * 1000)::VARCHAR WHEN 3 THEN lower(p_brand[1:5]) WHEN 4 THEN p_size || '.5' ELSE '\\sqrt{' || p_size % 10 || '}' END AS norm FROM part")
def normalize_answer(spark, d):
    size = F.col("p_size").cast("string")
    raw = (F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("$"), size, F.lit("/7$"))).when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("x = "), size, F.lit(" \\text{ cm}")))
           .when(F.col("p_partkey") % 6 == 2, F.concat(size, F.lit(",000."))).when(F.col("p_partkey") % 6 == 3, F.concat(F.lit("\\text{"), F.substring("p_brand", 1, 5), F.lit("}")))
           .when(F.col("p_partkey") % 6 == 4, F.concat(F.lit("0"), size, F.lit(".50"))).otherwise(F.concat(F.lit("\\sqrt"), (F.col("p_size") % 10).cast("string"))))
    return b.table(spark, d, "part").select("p_partkey", text.normalize_answer(raw).alias("norm"))


@_query("SELECT p_partkey, (length(p_name) + 3) // 4 AS tokens, greatest(1, length(p_name) // 4) AS tokens_floor, left(p_name, 5) || '...' AS short FROM part WHERE length(p_name) > 8")
def token_estimates(spark, d):
    c = F.col("p_name")
    return b.table(spark, d, "part").where(F.length(c) > 8).select("p_partkey", text.approx_tokens(c).alias("tokens"), text.approx_tokens_floor(c).alias("tokens_floor"), text.preview(c, 5).alias("short"))


@_query("SELECT c_custkey, (('0x' || substr(sha256('7:' || (c_custkey % 3) || ':' || c_name), 1, 8))::BIGINT & 2147483647) AS seed FROM customer")
def request_seeds(spark, d):
    return b.table(spark, d, "customer").select("c_custkey", text.request_seed(F.lit(7), F.col("c_custkey") % 3, F.col("c_name")).alias("seed"))


@_query("SELECT p_partkey, p_size::VARCHAR AS answer FROM part")
def extract_answer(spark, d):
    return b.table(spark, d, "part").select("p_partkey", answers.extract_answer(F.concat(F.lit("First \\boxed{0}. "), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" so \\boxed{"), F.col("p_size").cast("string"), F.lit("}."))).otherwise(F.concat(F.lit(" \\boxed{\\boxed {"), F.col("p_size").cast("string"), F.lit("}}"))))).alias("answer"))


@_query("SELECT conv_id::VARCHAR AS problem_id, count(*)::INT AS n, true AS same FROM conversations GROUP BY conv_id")
def split_steps(spark, d):
    t = b.traces(spark, d)
    clean = F.transform("steps", text.strip)
    return t.select("problem_id", clean.alias("clean"), answers.split_steps(text.format_steps(F.col("steps"))).alias("got")).select("problem_id", F.size("got").alias("n"), (F.col("got") == F.col("clean")).alias("same"))


@_query("SELECT p_partkey, p_partkey % 3 <> 2 AS same FROM part")
def is_equivalent(spark, d):
    size = F.col("p_size").cast("string")
    gold = F.concat(F.lit("\\frac{"), size, F.lit("}{2}"))
    pred = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_size") / 2).cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("/2"))).otherwise(F.concat(size, F.lit("/2, 1")))
    return b.table(spark, d, "part").select("p_partkey", answers.is_equivalent(pred, gold).alias("same"))


# Of the ten kinds the first six are equal, the next three aren't, and the last is no expression.
@_query("SELECT p_partkey, CASE WHEN p_partkey % 10 < 6 THEN true WHEN p_partkey % 10 < 9 THEN false END AS equal, p_partkey % 10 < 6 AS same FROM part")
def expression_equality(spark, d):
    p = b.table(spark, d, "part").withColumn("k", F.col("p_size").cast("string")).withColumn("j", (F.col("p_partkey") % 7 + 2).cast("string"))
    pairs = [("(x+@k)^2", "x^2 + 2*@k x+@k^2"), ("\\frac{x^2-@k^2}{x-@k}", "@k+x"), ("(a+b)^@j(a-b)^@j", "(a^2-b^2)^@j"), ("@k x - @j y = 3", "6 = 2*@k x - 2*@j y"), ("\\sqrt{x+@k}/2", "0.5\\sqrt{@k+x}"), ("x^{-@j}\\cdot x^@j y", "y"),
             ("(x+@k)^2", "x^2+@k^2"), ("x^@j", "@j x"), ("@k x+y", "@k y+x + 1"), ("x^@j^^", "x^@j")]
    kind = F.col("p_partkey") % 10

    def filled(side: int):
        forms = F.get(F.array(*[F.lit(pair[side]) for pair in pairs]), kind.cast("int"))
        return F.replace(F.replace(forms, F.lit("@k"), F.col("k")), F.lit("@j"), F.col("j"))

    return p.select("p_partkey", algebra.expressions_equal(filled(0), filled(1)).alias("equal"), answers.is_equivalent(filled(0), filled(1)).alias("same"))


# Prompts and views of texts.

_EDGE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STATE = f"'PROBLEM:' || chr(10) || problem_id || chr(10) || chr(10) || 'SOLUTION SO FAR:' || chr(10) || array_to_string(list_transform(steps, lambda x, i: 'Step ' || i || ': ' || trim(x, {_EDGE}) || chr(10) || chr(10)), '')"


@_query(f"WITH {b.TRACES} SELECT problem_id, md5(rtrim({_STATE}, {_EDGE})) AS state, array_to_string(list_transform(steps[1:26], lambda x, i: chr((64 + i)::INT) || '. ' || length(x)), chr(10)) AS options, 'Solve: ' || problem_id AS prompt, "
        "sha256('{\"model\":\"m' || n_steps % 2 || '\",\"prompt_version\":\"v1\",\"request\":{\"questions\":\"q' || n_steps || '\",\"state\":\"' || problem_id || '\"}}') AS key FROM traces")
def judge_prompts(spark, d):
    t = b.traces(spark, d)
    options = F.transform(F.slice("steps", 1, 26), lambda x: F.concat(F.lit(" "), F.length(x).cast("string"), F.lit("\n")))
    n = F.col("n_steps")
    key = text.cache_key(F.col("problem_id"), F.concat(F.lit("q"), n.cast("string")), F.concat(F.lit("m"), (n % 2).cast("string")), F.lit("v1"))
    return t.select("problem_id", F.md5(text.judge_state(F.col("problem_id"), F.col("steps"))).alias("state"), text.lettered_options(options).alias("options"), text.fill_prompt("Solve: {problem}", F.col("problem_id")).alias("prompt"), key.alias("key"))


# Four characters a token; the first step stays, and as many of the last as fit.
@_query(f"""WITH {b.TRACES}, t AS (SELECT problem_id, n_steps, length(steps[1]) AS first, list_transform(steps, lambda x: length(x)) AS sizes, 4 * 150 AS lim FROM traces),
k AS (SELECT *, lim - length(problem_id) - first - 200 AS room, list_reverse(sizes[2:]) AS back FROM t),
c AS (SELECT *, coalesce(len(list_filter(range(1, len(back) + 1), lambda i: list_sum(back[1:i]) <= room)), 0) AS kept FROM k)
SELECT problem_id, (CASE WHEN n_steps <= 2 OR length(problem_id) + list_sum(sizes) <= lim OR n_steps - 1 - kept <= 0 THEN n_steps ELSE kept + 2 END)::INT AS n_shown, NOT (n_steps <= 2 OR length(problem_id) + list_sum(sizes) <= lim OR n_steps - 1 - kept <= 0) AS truncated FROM c""")
def truncated_states(spark, d):
    shown = b.traces(spark, d).withColumn("shown", text.truncate_state(F.col("problem_id"), F.col("steps"), 150))
    return shown.select("problem_id", F.size("shown").alias("n_shown"), F.coalesce(F.get("shown", F.lit(1)).rlike(r"^\[\.\.\. \d+ steps omitted \.\.\.\]$"), F.lit(False)).alias("truncated"))


@_query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')) AS escaped FROM pages")
def escaped_pages(spark, d):
    return b.table(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped"))


@_query(r"SELECT doc_id, contains(t, '\boxed{') OR contains(lower(t), 'final answer') AS ends_search, regexp_matches(t, '\\(fbox|boxed)([^A-Za-z]|$)') OR regexp_matches(lower(t), 'final\s+answer') AS states_answer FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' \boxed 5' WHEN 1 THEN ' \boxed{5}' WHEN 2 THEN ' Final  answer: 5' WHEN 3 THEN ' final answer 5' ELSE ' \boxedfive' END AS t FROM documents)")
def answer_predicates(spark, d):
    """Of documents that end in different forms of an answer: whether a search ends there, and whether an answer is stated."""
    ends = F.get(F.array(*[F.lit(x) for x in (" \\boxed 5", " \\boxed{5}", " Final  answer: 5", " final answer 5", " \\boxedfive")]), (F.col("doc_id") % 5).cast("int"))
    t = F.concat("text", ends)
    return b.table(spark, d, "documents").select("doc_id", text.is_final_step(t).alias("ends_search"), text.has_final_answer(t).alias("states_answer"))


@_query("SELECT p_partkey, p_size = p_partkey % 50 AS agree FROM part")
def answers_agree(spark, d):
    p = b.table(spark, d, "part")
    return p.select("p_partkey", text.answers_agree(F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(".0$")), F.concat(F.lit("x = "), (F.col("p_partkey") % 50).cast("string"))).alias("agree"))


@_query(f"WITH {b.SCORED} SELECT prefix_id, variant FROM scored WHERE problem_id IN (SELECT source FROM documents GROUP BY source HAVING max(n_chars) > 20000)")
def prefixes_of_problems(spark, d):
    some = b.table(spark, d, "documents").groupBy(F.col("source").alias("problem_id")).agg(F.max("n_chars").alias("m")).where("m > 20000")
    return experiments.prefixes_of_problems(b.scored(spark, d).select("prefix_id", "variant"), some)


@_query(f"WITH {b.SCORED} SELECT prefix_id, 0::BIGINT AS n_samples, label::BIGINT AS n_correct, label::DOUBLE AS soft, label AS hard, 'terminal' AS label_source FROM scored WHERE terminal")
def terminal_labels(spark, d):
    return analysis.terminal_labels(b.scored(spark, d).where("terminal"), F.col("label"))


@_query(f"WITH {b.RESULT_ROWS}, price(method, usd) AS (VALUES ('click', 0.042), ('view', 0.0), ('purchase', 1.5)) SELECT seq, round(compute_tokens * coalesce(price.usd, 0.3) / 1e6, 12) AS usd FROM result_rows LEFT JOIN price USING (method)")
def usd_by_route(spark, d):
    """Dollars by the price of each route; routes without one of their own have 0.3 a million tokens."""
    price = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (("click", 0.042), ("view", 0.0), ("purchase", 1.5)) for x in pair]), F.col("method")), F.lit(0.3))
    return b.result_rows(spark, d).select("seq", F.round(probability.usd(F.col("compute_tokens"), price), 12).alias("usd"))


# Trees.

_Q = "CASE WHEN N + virtual_loss = 0 THEN 0 ELSE W / (N + virtual_loss) END"
_PUCT = f"WITH RECURSIVE {b.TREE}, sc AS (SELECT c.tree_id, c.parent_id, c.node_id, c.child_pos, c.prior, c.N, c.W, c.terminal, c.W / c.N + 1.5 * c.prior * sqrt(greatest(1, p.N)) / (1 + c.N) AS score FROM tree c JOIN tree p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id)"


@_query(_PUCT + " SELECT tree_id, node_id, round(score, 6) AS score FROM sc")
def puct_scores(spark, d):
    return tree.scored_children(b.tree(spark, d)).select("tree_id", "node_id", *r6("score"))


@_query(_PUCT + " SELECT tree_id, parent_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY score DESC, prior DESC, child_pos) AS rn FROM sc) WHERE rn = 1")
def puct_select(spark, d):
    return tree.select_children(b.tree(spark, d))


@_query(_PUCT + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY N DESC, W / N DESC, prior DESC, child_pos) AS rn FROM sc) WHERE rn = 1),
path AS (SELECT tree_id, 0 AS depth, node_id, terminal FROM tree WHERE parent_id IS NULL UNION ALL SELECT p.tree_id, p.depth + 1, s.node_id, s.terminal FROM path p JOIN best s ON s.tree_id = p.tree_id AND s.parent_id = p.node_id WHERE NOT p.terminal)
SELECT tree_id, depth, node_id FROM path""")
def most_visited_path(spark, d):
    return tree.most_visited_path(Written(b.tree(spark, d), "tree").df)


@_query(_PUCT + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY score DESC, prior DESC, child_pos) AS rn FROM sc) WHERE rn = 1),
path AS (SELECT tree_id, 0 AS depth, node_id, terminal FROM tree WHERE parent_id IS NULL UNION ALL SELECT p.tree_id, p.depth + 1, s.node_id, s.terminal FROM path p JOIN best s ON s.tree_id = p.tree_id AND s.parent_id = p.node_id WHERE NOT p.terminal)
SELECT tree_id, depth, node_id FROM path""")
def selection_path(spark, d):
    return tree.selection_path(Written(b.tree(spark, d), "tree").df)


@_query(f"WITH {b.TREE} SELECT tree_id, count(*) AS n_nodes, count(*) FILTER (terminal) AS n_terminals, max(depth)::INT AS max_depth FROM tree GROUP BY tree_id")
def tree_counts(spark, d):
    return tree.tree_counts(b.tree(spark, d))


@_query(f"""WITH RECURSIVE {b.TREE}, w AS (SELECT tree_id, node_id, [0] AS place FROM tree WHERE parent_id IS NULL UNION ALL SELECT c.tree_id, c.node_id, list_append(w.place, c.child_pos) FROM w JOIN tree c ON c.tree_id = w.tree_id AND c.parent_id = w.node_id)
SELECT tree_id, node_id, (row_number() OVER (PARTITION BY tree_id ORDER BY place) - 1)::INT AS pre FROM w""")
def preorder(spark, d):
    return tree.preorder(b.tree(spark, d))


@_query(f"WITH {b.TREE} SELECT tree_id, node_id, final_answer, N, round(value, 4) AS value FROM tree WHERE terminal")
def terminal_leaves(spark, d):
    return tree.terminal_leaves(b.tree(spark, d)).withColumn("value", F.round("value", 4))


@_query(f"""WITH {b.TREE}, t AS MATERIALIZED (SELECT tree_id, node_id, parent_id, N, W, value, terminal FROM tree), l AS (SELECT tree_id, node_id, parent_id, value FROM t WHERE terminal AND value > 0.5),
c AS (SELECT l.tree_id, l.node_id AS n3, l.parent_id AS n2, t.parent_id AS n1, l.value FROM l JOIN t ON t.tree_id = l.tree_id AND t.node_id = l.parent_id),
p AS (SELECT c.*, t.parent_id AS n0 FROM c JOIN t ON t.tree_id = c.tree_id AND t.node_id = c.n1),
a AS (SELECT tree_id, node_id, count(*) AS dn, sum(value) AS dw FROM (SELECT tree_id, unnest([n0, n1, n2, n3]) AS node_id, value FROM p) GROUP BY ALL)
SELECT tree_id, node_id, N + coalesce(dn, 0) AS N, round(W + coalesce(dw, 0), 4) AS W FROM t LEFT JOIN a USING (tree_id, node_id)""")
def backup(spark, d):
    """A simulation for each leaf of a value above 0.5, along its whole path."""
    t = Written(b.tree(spark, d), "tree").df
    return tree.backup(t, t.where("terminal and value > 0.5").select("tree_id", "node_id", "value")).select("tree_id", "node_id", "N", F.round("W", 4).alias("W"))


@_query(f"""WITH {b.TREE}, t AS MATERIALIZED (SELECT tree_id, node_id, parent_id, depth, N FROM tree), h3 AS (SELECT c.tree_id, c.node_id, c.parent_id, true AS hid, false AS top FROM t c WHERE depth = 3),
h2 AS (SELECT tree_id, node_id, parent_id, N < 12 AS own FROM t WHERE depth = 2), h1 AS (SELECT tree_id, node_id, N < 12 AS own FROM t WHERE depth = 1),
j AS (SELECT c.tree_id, c.node_id, c.own OR p.own AS hid, c.own AND NOT p.own AS top, 1 + (SELECT count(*) FROM t z WHERE z.tree_id = c.tree_id AND z.parent_id = c.node_id) AS size FROM h2 c JOIN h1 p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id),
a AS (SELECT tree_id, hid, top, size FROM j UNION ALL SELECT h1.tree_id, own, own, 1 + (SELECT sum(size) FROM j JOIN t z ON z.tree_id = j.tree_id AND z.node_id = j.node_id WHERE z.tree_id = h1.tree_id AND z.parent_id = h1.node_id) FROM h1 UNION ALL SELECT tree_id, false, false, 0 FROM t WHERE depth = 0
  UNION ALL SELECT h3.tree_id, true, NOT j.hid, 1 FROM h3 JOIN j ON j.tree_id = h3.tree_id AND j.node_id = h3.parent_id)
SELECT tree_id, count(*) FILTER (NOT hid) AS n_shown, count(*) FILTER (hid) AS n_hidden, count(*) FILTER (top) AS hidden_children, coalesce(max(size) FILTER (top), 0)::BIGINT AS largest_hidden FROM a GROUP BY tree_id""")
def tree_view(spark, d):
    """Down to depth 2, nodes of 12 visits or more."""
    return tree.view_counts(Written(b.tree(spark, d), "tree").df, max_depth=2, min_visits=12)


@_query(f"WITH {b.TREE} SELECT tree_id, child_pos, depth, step, N, round(prior, 6) AS prior, round(value, 6) AS value, terminal, final_answer FROM tree")
def tree_round_trip(spark, d):
    """The trees as nested JSON in pieces, as a tree may be larger than a task, and flattened again; child_pos of roots is 0 either way."""
    nodes = tree.flatten(tree.nest(Written(b.tree(spark, d), "tree").df, tree.PIECE))
    return nodes.select("tree_id", "child_pos", "depth", "step", "N", *r6("prior", "value"), "terminal", "final_answer")


# Probabilities.

_P3 = "[p_size / 50.0::DOUBLE, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_size % 7) / 10.0::DOUBLE END, (p_partkey % 3) / 5.0::DOUBLE]"


def _priors():
    return F.array(F.col("p_size") / 50.0, F.when(F.col("p_partkey") % 4 != 0, (F.col("p_size") % 7) / 10.0), (F.col("p_partkey") % 3) / 5.0)


def _spread(df: DataFrame, values, keys=("p_partkey",)) -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias("k", "p")).withColumn("p", F.round("p", 6))


_RENORM = f"WITH f AS (SELECT p_partkey, list_transform({_P3}, lambda p: coalesce(p, 0.001::DOUBLE)) AS q FROM part), n AS (SELECT p_partkey, list_transform(q, lambda p: p / list_sum(q)) AS q FROM f)"


@_query(_RENORM + " SELECT p_partkey, (i - 1)::INT AS k, round(q[i], 6) AS p FROM n, range(1, 4) r(i)")
def renormalize(spark, d):
    return _spread(b.table(spark, d, "part"), probability.renormalize(_priors()))


@_query(_RENORM + " SELECT p_partkey, (i - 1)::INT AS k, round(0.9 * q[i] + 0.1 / 3, 6) AS p FROM n, range(1, 4) r(i)")
def prior_floor(spark, d):
    return _spread(b.table(spark, d, "part"), probability.prior_floor(probability.renormalize(_priors()), 0.1))


@_query(_RENORM + " SELECT p_partkey, i::INT AS k, round((CASE WHEN i = 0 THEN q[1] + q[3] ELSE q[2] END), 6) AS p FROM n, range(0, 2) r(i)")
def merge_priors(spark, d):
    mapping = F.array(F.lit(0), F.lit(1), F.lit(0))
    return _spread(b.table(spark, d, "part"), probability.merge_priors(probability.renormalize(_priors()), mapping, F.lit(2)))


@_query("SELECT c_custkey, round((exp(-c_nationkey / 10.0::DOUBLE) + exp(-2.0::DOUBLE)) / (exp(-c_nationkey / 10.0::DOUBLE) + exp(-2.0::DOUBLE) + exp(-1.0::DOUBLE)), 6) AS p FROM customer")
def yes_probability(spark, d):
    lp = F.create_map(F.lit("▁Yes"), -F.col("c_nationkey") / 10.0, F.lit(" yes."), F.lit(-2.0), F.lit("No"), F.lit(-1.0), F.lit("maybe"), F.lit(-0.1))
    return b.table(spark, d, "customer").select("c_custkey", F.round(probability.yes_probability(lp), 6).alias("p"))


@_query("WITH m AS (SELECT c_custkey, exp(-c_nationkey / 10.0::DOUBLE) AS a, exp(-1.0::DOUBLE) AS z FROM customer) SELECT c_custkey, i::INT AS k, round(CASE i WHEN 0 THEN a WHEN 1 THEN z ELSE 0.001 END / (a + z + 0.001), 6) AS p FROM m, range(3) r(i)")
def letter_priors(spark, d):
    lp = F.create_map(F.lit("▁A"), -F.col("c_nationkey") / 10.0, F.lit("B)"), F.lit(-1.0), F.lit("maybe"), F.lit(-0.1))
    return _spread(b.table(spark, d, "customer"), probability.letter_priors(lp, F.lit(3)), ("c_custkey",))


@_query(f"WITH {b.SAMPLES} SELECT problem_id, min(score) AS value FROM samples GROUP BY problem_id")
def prm_min(spark, d):
    s = b.samples(spark, d).groupBy("problem_id").agg(F.collect_list("score").alias("scores"))
    return s.select("problem_id", probability.least_step_score(F.col("scores"), F.size("scores")).alias("value"))


# Budgets.

@_query(f"WITH {b.CALLS}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY us, seq) - 1 AS rn FROM calls) SELECT seq, round(max(sec - rn * 900.0) OVER (PARTITION BY run ORDER BY us, seq) + rn * 900.0, 3) AS start FROM n")
def rate_limit_schedule(spark, d):
    return budget.rate_limit(b.calls(spark, d), 900.0, ["run"], ["us", "seq"], at="sec").select("seq", F.round("start", 3).alias("start"))


@_query(f"WITH {b.CALLS}, n AS (SELECT seq, run, usd, sum((usd * 10000)::BIGINT) OVER (PARTITION BY run ORDER BY us, seq) AS c, (usd * 10000)::BIGINT AS u FROM calls) SELECT seq, run, u::BIGINT AS units FROM n WHERE c - u <= 200000")
def spend_cap(spark, d):
    c = b.calls(spark, d).withColumn("units", F.round(F.col("usd") * 10000).cast("long"))
    return budget.spend_cap(c, 200000, ["run"], ["us", "seq"], usd="units").select("seq", "run", "units")


@_query(f"WITH {b.CALLS}, n AS (SELECT seq, sum(estimate) OVER (PARTITION BY run ORDER BY us, seq) AS c FROM calls) SELECT seq, c <= 5000 AS admitted FROM n")
def budget_admission(spark, d):
    return budget.admit(b.calls(spark, d), 5000, ["run"], ["us", "seq"]).select("seq", "admitted")


@_query(f"WITH {b.CALLS} SELECT run, round(count(*) * 2000 * 0.042 / 1e6, 9) AS judge_usd, round((sum(estimate) * 0.09 + sum(k) * 0.3) / 1e6, 9) AS generator_usd FROM calls GROUP BY run")
def cost_estimate(spark, d):
    c = b.calls(spark, d).groupBy("run").agg(F.count("*").alias("n"), F.sum("estimate").alias("p"), F.sum("k").alias("c"))
    return c.select("run", F.round(budget.judge_cost(F.col("n")), 9).alias("judge_usd"), F.round(budget.generator_cost(F.col("p"), F.col("c")), 9).alias("generator_usd"))


# Search.

@_query(f"""WITH RECURSIVE {b.CALLS}, o AS (SELECT seq, run, estimate, row_number() OVER (PARTITION BY run ORDER BY us, seq) AS rn FROM calls),
f(run, rn, seq, held, admitted) AS (SELECT DISTINCT run, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, false FROM o UNION ALL SELECT o.run, o.rn, o.seq, f.held + CASE WHEN f.held + o.estimate <= 5000 THEN o.estimate ELSE 0 END, f.held + o.estimate <= 5000 FROM f JOIN o ON o.run = f.run AND o.rn = f.rn + 1)
SELECT seq, admitted FROM f WHERE rn > 0""")
def admit_in_order(spark, d):
    """A rejected call reserves nothing, so smaller ones after it may still fit."""
    return budget.admit_in_order(b.calls(spark, d), 5000.0, ["run"], ["us", "seq"]).select("seq", "admitted")


def _swap(i: int) -> str:
    m, c, _ = probability.ORDER_BY
    return f"(s{i + 1} * {m}::UHUGEINT + {c}) % 18446744073709551616::UHUGEINT AS s{i}, (s{i} % {i + 1})::INT AS j{i}, list_transform(range(4), lambda k: CASE WHEN k = {i} THEN p{i + 1}[j{i} + 1] WHEN k = j{i} THEN p{i + 1}[{i + 1}] ELSE p{i + 1}[k + 1] END) AS p{i}"


@_query(f"SELECT p_partkey, array_to_string(p1, ',') AS shown, true AS restored FROM (SELECT p_partkey, ('0x' || substr(sha256(p_name), 1, 16))::UBIGINT::UHUGEINT AS s4, [0, 1, 2, 3] AS p4, {_swap(3)}, {_swap(2)}, {_swap(1)} FROM part)")
def option_order(spark, d):
    """Four options of each part in the order of its name's digest, and back."""
    p = b.table(spark, d, "part").withColumn("order", probability.option_order(F.col("p_name"), F.lit(4)))
    own = F.array(*[F.concat("p_name", F.lit(x)) for x in "abcd"])
    shown = F.transform("order", lambda k: F.get(own, k))
    return p.select("p_partkey", F.array_join("order", ",").alias("shown"), (probability.unshuffle(shown, F.col("order")) == own).alias("restored"))


@_query(f"WITH {b.SCORED} SELECT variant, q AS share, true AS within FROM (SELECT DISTINCT variant FROM scored), (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS q)")
def sketched_quantiles(spark, d):
    """Ranks of sketched latencies are within the stated error of those asked for."""
    return stats.rank_errors(b.scored(spark, d), "latency", [0.05, 0.5, 0.95], ["variant"]).select("variant", "share", (F.col("error") <= stats.RANK_ERROR).alias("within"))


# Methods over problems, from stored samples: orders are problems, their lines samples.

_STORED = f"""WITH {b.SAMPLES}, toyp AS (SELECT o_orderkey AS problem_id, CASE WHEN o_custkey % 2 = 0 THEN 'A' ELSE 'R' END AS gold FROM orders), hv AS (SELECT problem_id, count(*) AS have FROM samples GROUP BY problem_id)"""


def _stored_problems(spark, d) -> DataFrame:
    o = b.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("problem_id"), F.concat(F.lit("Order of "), F.col("o_custkey").cast("string")).alias("question"), F.when(F.col("o_custkey") % 2 == 0, "A").otherwise("R").alias("answer"))


def _stored(spark, d):
    return experiments.stored_generator(b.samples(spark, d))


def _run(spark, d, method) -> DataFrame:
    return experiments.run_method(method, _stored_problems(spark, d)).select("problem_id", "method_id", "answer", "correct", "error", "compute_tokens")


def _row_sql(method_id: str, n: int, tail: str, where: str = "true") -> str:
    short = f"coalesce(have, 0) < {n}"
    return _STORED + tail + f""" SELECT p.problem_id, '{method_id}' AS method_id, CASE WHEN NOT ({short}) THEN o.answer END AS answer, NOT ({short}) AND coalesce(o.answer = p.gold, false) AS correct,
CASE WHEN {short} THEN coalesce(have, 0) || ' stored samples, fewer than {n}' END AS error, CASE WHEN {short} THEN 0 ELSE o.tokens END::BIGINT AS compute_tokens FROM toyp p LEFT JOIN hv USING (problem_id) LEFT JOIN o USING (problem_id) WHERE {where}"""


def _vote_sql(n: int) -> str:
    return f", v AS (SELECT problem_id, answer, count(*) AS votes, min(i) AS f FROM samples WHERE i < {n} AND answer IS NOT NULL GROUP BY ALL), w AS (SELECT problem_id, answer FROM v QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, f) = 1), o AS (SELECT problem_id, any_value(w.answer) AS answer, sum(tokens) AS tokens FROM samples LEFT JOIN w USING (problem_id) WHERE i < {n} GROUP BY problem_id)"


def _best_sql(n: int) -> str:
    return f", o AS (SELECT problem_id, answer, sum(tokens) OVER (PARTITION BY problem_id) AS tokens FROM samples WHERE i < {n} QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, i) = 1)"


@_query(_row_sql("cot", 1, ", o AS (SELECT problem_id, answer, tokens FROM samples WHERE i = 0)"))
def cot_method(spark, d):
    return _run(spark, d, experiments.greedy_method(_stored(spark, d)))


@_query(_row_sql("sc[n=3]", 3, _vote_sql(3)))
def sc_method(spark, d):
    return _run(spark, d, experiments.vote_method(_stored(spark, d), 3))


@_query(_row_sql("bon[n=3]", 3, _best_sql(3)))
def bon_method(spark, d):
    return _run(spark, d, experiments.best_method(_stored(spark, d), experiments.stored_judge, 3))


@_query(_row_sql("sc[n=3]", 3, _vote_sql(3), "('0x' || substr(sha256(problem_id::VARCHAR), 64, 1))::INT % 2 = 1 AND (problem_id % 3 <> 0 OR coalesce(have, 0) < 3)"))
def run_method(spark, d):
    """Shard 1 of 2, after a run over each third problem, with errors to be tried again."""
    method, p = experiments.vote_method(_stored(spark, d), 3), _stored_problems(spark, d)
    p = p.withColumn("problem_id", F.col("problem_id").cast("string"))
    before = experiments.run_method(method, p.where("problem_id % 3 = 0"))
    return experiments.run_method(method, p, before, (1, 2), retry_errors=True).select(F.col("problem_id").cast("long").alias("problem_id"), "method_id", "answer", "correct", "error", "compute_tokens")


@_query(_STORED + """, g AS (SELECT s.problem_id, s.i, z.size, answer, tokens, score FROM samples s JOIN hv USING (problem_id), (VALUES (1), (2), (3)) z(size) WHERE i < z.size AND have >= 3),
sc AS (SELECT problem_id, size, answer FROM (SELECT problem_id, size, answer, count(*) AS votes, min(i) AS f FROM g WHERE answer IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY problem_id, size ORDER BY votes DESC, f) = 1),
bo AS (SELECT problem_id, size, answer FROM g QUALIFY row_number() OVER (PARTITION BY problem_id, size ORDER BY score DESC, i) = 1), t AS (SELECT problem_id, size, sum(tokens)::BIGINT AS tokens FROM g GROUP BY ALL)
SELECT problem_id, 'sc[n=' || size || ']' AS method_id, answer, coalesce(answer = gold, false) AS correct, tokens AS compute_tokens, 'sc[n=3]' AS derived_from, 1.0::DOUBLE AS usd FROM t LEFT JOIN sc USING (problem_id, size) JOIN toyp USING (problem_id)
UNION ALL SELECT problem_id, 'bon[n=' || size || ']', answer, coalesce(answer = gold, false), tokens, 'bon[n=3]', round(size / 3.0::DOUBLE, 6) FROM bo JOIN t USING (problem_id, size) JOIN toyp USING (problem_id)
UNION ALL SELECT problem_id, m, NULL, false, 0, NULL, 1.0 FROM toyp LEFT JOIN hv USING (problem_id), (VALUES ('sc[n=3]'), ('bon[n=3]')) v(m) WHERE coalesce(have, 0) < 3
UNION ALL SELECT problem_id, 'cot', s.answer, coalesce(s.answer = gold, false), coalesce(tokens, 0), NULL, 1.0 FROM toyp LEFT JOIN (SELECT * FROM samples WHERE i = 0) s USING (problem_id)""")
def expand_sampled_rows(spark, d):
    p, g = _stored_problems(spark, d), _stored(spark, d)
    runs = [experiments.run_method(m, p) for m in (experiments.vote_method(g, 3), experiments.best_method(g, experiments.stored_judge, 3), experiments.greedy_method(g))]
    r = Written(runs[0].unionByName(runs[1]).unionByName(runs[2]).withColumn("usd", F.lit(1.0)), "runs").df
    return votes.expand_rows(r, [1, 2, 3], answers.is_equivalent).select("problem_id", "method_id", "answer", "correct", F.col("compute_tokens").cast("long").alias("compute_tokens"), "derived_from", F.round("usd", 6).alias("usd"))


# A conversation is a solution whose answer, in a box, is how many turns it has.
_SOLVED = f"WITH {b.TRACES}, sol AS (SELECT problem_id, n_steps, n_steps::VARCHAR AS final_answer, (n_steps + n_steps % 3 % 2)::VARCHAR AS gold FROM traces)"


def _solutions(spark, d) -> tuple[DataFrame, DataFrame]:
    t = b.traces(spark, d)
    n = F.col("n_steps").cast("string")
    told = F.concat(F.regexp_replace(text.format_steps(F.col("steps")), r"\s+$", ""), F.lit(" \\boxed{"), n, F.lit("}"))
    problems_ = t.select("problem_id", (F.col("n_steps") + F.col("n_steps") % 3 % 2).cast("string").alias("answer"))
    return t.select("problem_id", F.lit(0).alias("i"), told.alias("solution"), F.lit(None).cast("string").alias("error")), problems_


@_query(_SOLVED + " SELECT problem_id, n_steps, final_answer, final_answer = gold AS trace_correct FROM sol")
def pilot_traces(spark, d):
    return experiments.pilot_traces(*_solutions(spark, d)).select("problem_id", "n_steps", "final_answer", "trace_correct")


@_query(_SOLVED + """, pre AS (SELECT problem_id, n_steps, gold, unnest(range(1, n_steps + 1))::INT AS depth FROM sol), left_ AS (SELECT problem_id, depth, count(*) AS n, count(*) FILTER (length(c.text) % 10 < 5) AS k FROM pre JOIN conversations c ON c.conv_id::VARCHAR = problem_id AND c.turn >= depth GROUP BY ALL)
SELECT problem_id || '#' || depth AS prefix_id, CASE WHEN depth = n_steps THEN 0 ELSE n END::BIGINT AS n_samples, CASE WHEN depth = n_steps THEN (n_steps::VARCHAR = gold)::INT ELSE k END::BIGINT AS n_correct, CASE WHEN depth = n_steps THEN 'terminal' ELSE 'completions' END AS label_source FROM pre LEFT JOIN left_ USING (problem_id, depth) WHERE depth = n_steps OR n IS NOT NULL""")
def pilot_labels(spark, d):
    """Prefixes of each solution; the turns from the prefix on stand in as its completions, right where their length ends in a digit below 5."""
    solutions, problems_ = _solutions(spark, d)
    t = experiments.pilot_traces(solutions, problems_)
    prefixes_ = sampling.prefix_steps(sampling.prefixes(t, 1 << 20), t)
    turns = b.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("problem_id"), "turn", (F.length("text") % 10 < 5).alias("good"), F.length("text").cast("long").alias("tokens"))
    completions = prefixes_.select("prefix_id", "problem_id", "depth").join(turns, "problem_id").where("turn >= depth").join(problems_, "problem_id").select("prefix_id", F.when(F.col("good"), F.col("answer")).otherwise("none").alias("answer"), "tokens")
    return experiments.pilot_labels(prefixes_, completions, problems_).select("prefix_id", "n_samples", "n_correct", "label_source")


@_query(f"WITH {b.SCORED} SELECT prefix_id, CASE WHEN latency BETWEEN 0 AND 1 THEN latency END AS score, CASE WHEN NOT latency BETWEEN 0 AND 1 THEN 'not a score' END AS error FROM scored")
def checked_scores(spark, d):
    found = experiments.checked_scores(b.scored(spark, d).select("prefix_id", F.col("latency").alias("score")))
    return found.select("prefix_id", "score", F.substring("error", 1, 11).alias("error"))


@_query(f"WITH {b.RESULT_ROWS}, u AS (SELECT problem_id, seq, error, CASE WHEN k % 3 = 2 THEN 2 ELSE k % 3 END AS run_no FROM result_rows) SELECT problem_id, seq, error, run_no AS run FROM u QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY (coalesce(error, '') <> ''), run_no DESC, seq DESC) = 1")
def merge_pilot(spark, d):
    """Three runs by a third of the rows each, the last of which is the destination."""
    r = b.result_rows(spark, d).withColumn("run", F.col("k") % 3).select("problem_id", "seq", "error", "run")
    return experiments.merge_pilot(r.where("run = 2"), [r.where("run = 0"), r.where("run = 1")], ("problem_id",))


@_query(f"WITH {b.SCORED} SELECT count(*) FILTER (label) AS solved, sum(calls)::BIGINT AS calls, round(sum(usd), 6) AS usd, count(*) FILTER (label) >= 1 AND sum(calls) <= 20 AND sum(usd) <= 0.01 AS passed FROM scored")
def smoke_summary(spark, d):
    return experiments.smoke_summary(b.scored(spark, d).withColumnRenamed("label", "correct")).select("solved", "calls", *r6("usd"), "passed")


@_query("SELECT o_custkey AS problem_id, count(*) FILTER (o_orderkey % 3 = 0) AS generator_calls, coalesce(sum(o_orderkey % 50) FILTER (o_orderkey % 3 = 0), 0)::BIGINT AS prompt_tokens, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0) AS judge_calls, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0) AS judge_cache_hits, "
        "coalesce(sum(o_orderkey % 50) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0), 0)::BIGINT AS judge_tokens, sum(o_orderkey % 5)::BIGINT AS expansions, max(o_orderkey % 17) AS max_depth FROM orders GROUP BY o_custkey")
def ledger(spark, d):
    o = F.col("o_orderkey")
    calls = b.table(spark, d, "orders").select(F.col("o_custkey").alias("problem_id"), F.when(o % 3 == 0, "generator").otherwise("judge").alias("kind"), (o % 4 == 0).alias("cache_hit"), (o % 50).cast("long").alias("prompt_tokens"), F.lit(8).cast("long").alias("completion_tokens"), F.lit(0.5).alias("usd"), (o % 5).alias("expansions"), (o % 17).alias("depth"))
    return experiments.ledger(calls).select("problem_id", "generator_calls", "prompt_tokens", "judge_calls", "judge_cache_hits", "judge_tokens", "expansions", "max_depth")
