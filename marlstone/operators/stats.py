"""Accuracy, bootstrap intervals and calibration. NULL is the undefined value: NaN would spread through averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.probability import bin_index
from marlstone.operators import resample

#: Inclusive depth buckets.
BUCKETS = [(1, 2), (3, 5), (6, 9), (10, None)]
N_BOOT, ALPHA, N_BINS = resample.N_BOOT, 0.05, 10
GO, PARTIAL = 0.75, 0.65


def bucket_label(lo: int, hi: int | None) -> str:
    return f"{lo}+" if hi is None else f"{lo}-{hi}"


def accuracy(correct: Column) -> Column:
    return F.avg(correct.cast("double"))


def bootstrap_means(values: DataFrame, value: str, groups: list[str], cluster: str, n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """(groups, b, mean) of each draw of clusters with replacement, as many as there are."""
    x = F.col(value).cast("double")
    return resample.bootstrap(values.where(x.isNotNull()), {"x": x, "n": F.lit(1)}, F.col("x") / F.col("n"), groups, cluster, n_boot, seed, "mean")


def percentile_interval(draws: DataFrame, value: str, groups: list[str], alpha: float = ALPHA) -> DataFrame:
    """(groups, lo, hi) by linear interpolation, undefined draws left out."""
    at = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.where(F.col(value).isNotNull()).groupBy(*groups).agg(at.alias("p")).select(*groups, F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def _side_by_side(keys: list[str], *tables: DataFrame) -> DataFrame:
    """The columns of tables that have a row for each key, null keys included."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.groupBy(*keys).agg(*[F.max(c).alias(c) for c in out.columns if c not in keys])


def accuracy_interval(rows: DataFrame, groups: list[str], cluster: str = "problem_id", value: str = "correct", n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """(groups, n, accuracy, lo, hi)."""
    exact = rows.groupBy(*groups).agg(F.count("*").alias("n"), accuracy(F.col(value)).alias("accuracy"))
    return _side_by_side(groups, exact, percentile_interval(bootstrap_means(rows, value, groups, cluster, n_boot, seed), "mean", groups))


def paired_difference(pairs: DataFrame, groups: list[str], cluster: str = "problem_id", n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """(groups, diff, lo, hi, p_value, n) of columns a and b of the same problems."""
    d = pairs.withColumn("d", F.col("a").cast("double") - F.col("b").cast("double"))
    means = bootstrap_means(d, "d", groups, cluster, n_boot, seed)
    at = F.percentile("mean", F.array(F.lit(ALPHA / 2), F.lit(1 - ALPHA / 2)))
    ends = means.groupBy(*groups).agg(at.alias("p"), F.avg((F.col("mean") <= 0).cast("double")).alias("below"), F.avg((F.col("mean") >= 0).cast("double")).alias("above"))
    exact = d.groupBy(*groups).agg(F.avg("d").alias("diff"), F.count("*").alias("n"))
    return exact.join(ends, groups).select(*groups, "diff", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p_value"), "n")


auroc = resample.auroc


def brier(score: str = "score", soft: str = "soft") -> Column:
    return F.avg(F.pow(F.col(score) - F.col(soft), 2))


def ece(rows: DataFrame, groups: list[str], score: str = "score", soft: str = "soft", n_bins: int = N_BINS) -> DataFrame:
    """(groups, ece): mean gap between score and label over equal-width bins, by their sizes."""
    bins = rows.groupBy(*groups, bin_index(F.col(score), n_bins).alias("bin")).agg(F.count("*").alias("c"), F.abs(F.sum(F.col(score)) - F.sum(F.col(soft))).alias("gap"))
    return bins.groupBy(*groups).agg((F.sum("gap") / F.sum("c")).alias("ece"))


def reliability(rows: DataFrame, score: str = "score", soft: str = "soft", n_bins: int = N_BINS) -> DataFrame:
    """(bin, lo, hi, n, mean_score, mean_label) for all bins, also empty ones."""
    spark = rows.sparkSession
    found = rows.groupBy(bin_index(F.col(score), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(soft).alias("mean_label"))
    return spark.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").select(
        "bin", (F.col("bin") / n_bins).alias("lo"), ((F.col("bin") + 1) / n_bins).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "mean_label")


def bucket_of(depth: Column, buckets: list[tuple[int, int | None]] = BUCKETS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in buckets:
        out = F.when((depth >= lo) & (depth <= hi if hi is not None else F.lit(True)), bucket_label(lo, hi)).otherwise(out)
    return out


def by_depth(rows: DataFrame, aggregates: dict[str, Column], buckets: list[tuple[int, int | None]] = BUCKETS, depth: str = "depth") -> DataFrame:
    """(bucket, n, aggregates) for all buckets, also empty ones; depths outside of them count nowhere."""
    labels = rows.sparkSession.createDataFrame([(bucket_label(*b),) for b in buckets], "bucket string")
    found = rows.withColumn("bucket", bucket_of(F.col(depth), buckets)).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    return labels.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cluster_bootstrap(rows: DataFrame, cluster: str, groups: list[str] | tuple[str, ...] = (), n_boot: int = N_BOOT, seed: int = 0, score: str = "score", label: str = "label", soft: str = "soft", n_bins: int = N_BINS) -> DataFrame:
    """(groups, b, auroc, brier, ece) of draws of whole clusters; a cluster drawn twice weighs twice instead of being copied. Brier and ECE are functions of sums; AUROC goes by the scores in order, sorted once for all draws."""
    gap = F.col(score) - F.col(soft)
    sums = {"c": F.lit(1), "err": gap * gap} | {f"g{k}": F.when(bin_index(F.col(score), n_bins) == k, gap) for k in range(n_bins)}
    gaps = [F.abs(f"g{k}") for k in range(n_bins)]
    both = resample.draw_sums(rows, sums, groups, cluster, n_boot, seed).select(*groups, "b", (F.col("err") / F.col("c")).alias("brier"), (sum(gaps[1:], gaps[0]) / F.col("c")).alias("ece"))
    return _side_by_side([*groups, "b"], resample.bootstrap_auroc(rows, groups, cluster, score, label, n_boot, seed), both)


def interval_columns(draws_: DataFrame, names: tuple[str, ...], groups: list[str] | tuple[str, ...] = (), alpha: float = ALPHA) -> DataFrame:
    """(groups, x_lo, x_hi for each name) of the draws, undefined ones left out."""
    ends = draws_.groupBy(*groups).agg(*[F.percentile(n, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias(n) for n in names])
    return ends.select(*groups, *[F.col(n)[k].alias(f"{n}_{end}") for n in names for k, end in enumerate(("lo", "hi"))])


def judge_metrics(rows: DataFrame, groups: list[str], cluster: str = "problem_id") -> DataFrame:
    """(groups, n, n_problems, auroc, brier, ece) of columns score, label, soft."""
    plain = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.countDistinct(cluster).alias("n_problems"), brier().alias("brier"))
    return plain.join(auroc(rows, groups), groups).join(ece(rows, groups), groups) if groups else plain.crossJoin(auroc(rows, groups)).crossJoin(ece(rows, groups))


def judge_report(rows: DataFrame, groups: list[str], cluster: str = "problem_id", n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """`judge_metrics` with intervals of each by draws of whole clusters, the verdict, the thresholds its interval leaves open, and why there is none where all labels are alike."""
    ends = interval_columns(cluster_bootstrap(rows, cluster, groups, n_boot, seed), ("auroc", "brier", "ece"), groups)
    positive = F.sum((F.col("label").cast("double") > 0.5).cast("long"))
    classes = rows.groupBy(*groups).agg(positive.alias("n_positive"))
    metrics = judge_metrics(rows, groups, cluster)
    out = metrics.join(ends, groups).join(classes, groups) if groups else metrics.crossJoin(ends).crossJoin(classes)
    return out.withColumn("verdict", decide(F.col("auroc"))).withColumn("open_thresholds", straddles(F.col("auroc_lo"), F.col("auroc_hi"))).withColumn("reason", one_class(F.col("n_positive"), F.col("n")))


def depth_metrics(rows: DataFrame, buckets: list[tuple[int, int | None]] = BUCKETS) -> DataFrame:
    """(bucket, n, positives, auroc, ece) for all depth buckets, also empty ones."""
    found = rows.withColumn("bucket", bucket_of(F.col("depth"), buckets)).where("bucket is not null")
    positive = F.sum((F.col("label").cast("double") > 0.5).cast("long"))
    return by_depth(rows, {"positives": positive}, buckets).withColumn("positives", F.coalesce("positives", F.lit(0))).join(auroc(found, ["bucket"]), "bucket", "left").join(ece(found, ["bucket"]), "bucket", "left")


def one_class(n_positive: Column, n: Column) -> Column:
    """Why AUROC is undefined, or null where it isn't."""
    which = F.when(n_positive == n, "correct").when(n_positive == 0, "incorrect")
    return F.when(n > 0, F.concat(F.lit("all "), n.cast("string"), F.lit(" scored prefixes are "), which))


def spread(rows: DataFrame, metric: str = "auroc") -> DataFrame:
    """One row: the number of variants with the metric, its least, its largest and their difference."""
    return rows.agg(F.count(metric).alias("n_variants"), F.min(metric).alias("least"), F.max(metric).alias("largest"), (F.max(metric) - F.min(metric)).alias("spread"))


def label_stats(rows: DataFrame) -> DataFrame:
    """One row: n, share of hard positives, mean soft label, share of terminal labels, and six bins of the soft label (0, up to 1/4, 1/2, 3/4, below 1, 1)."""
    s = F.col("soft")
    edges = [0.0, 1e-9, 0.25, 0.5, 0.75, 1 - 1e-9]
    bins = [F.count_if((s >= lo) & ((s < hi) if hi is not None else F.lit(True))).alias(f"h{k}") for k, (lo, hi) in enumerate(zip(edges, [*edges[1:], None]))]
    return rows.agg(F.count("*").alias("n"), accuracy(F.col("label")).alias("hard_rate"), F.avg(s).alias("mean_soft"), accuracy(F.col("terminal")).alias("terminal_share"), *bins)


def trace_stats(traces: DataFrame) -> DataFrame:
    n = F.col("n_steps")
    return traces.agg(F.count("*").alias("n"), accuracy(F.col("trace_correct")).alias("accuracy"), F.count_if(F.col("final_answer").isNull()).alias("no_answer"), F.avg(n).alias("mean_steps"), accuracy(n == 0).alias("zero_share"), accuracy(n == 1).alias("one_share"))


def decide(auroc_: Column) -> Column:
    return F.when(auroc_.isNull(), "UNAVAILABLE").when(auroc_ >= GO, "GO").when(auroc_ >= PARTIAL, "PARTIAL").otherwise("NO-GO")


def straddles(lo: Column, hi: Column) -> Column:
    """The thresholds that the interval leaves open, as text."""
    return F.array_join(F.transform(F.filter(F.array(F.lit(PARTIAL), F.lit(GO)), lambda t: (lo < t) & (t <= hi)), lambda t: t.cast("string")), ",")


def cost_latency(rows: DataFrame) -> DataFrame:
    """One row: usd, calls, cache hits, usd a call (0 without calls), latency at the median and the 95th percentile of paid rows, or of all rows where none is paid."""
    paid = F.when(F.col("calls") > 0, F.col("latency"))
    at = lambda p: F.coalesce(F.percentile(paid, F.lit(p)), F.percentile("latency", F.lit(p)))
    return rows.agg(F.sum("usd").alias("usd"), F.sum("calls").alias("calls"), F.sum("hits").alias("hits"), F.coalesce(F.try_divide(F.sum("usd"), F.sum("calls")), F.lit(0.0)).alias("usd_per_call"), at(0.5).alias("p50"), at(0.95).alias("p95"))


#: Size of quantile sketches, and the rank error they keep to (of the normalised rank, with 99% confidence).
SKETCH_K, RANK_ERROR = 400, 0.0075


def sketched_quantiles(rows: DataFrame, value: str, shares: list[float], groups: list[str] | tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """(groups, n, q: array of the quantiles) by KLL sketches, which are of bounded size and merge, so that a group of any size needs no state that grows with its values; a quantile's rank is off by about RANK_ERROR. Groups without a value have none."""
    sketch = rows.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    return sketch.where("n > 0").select(*groups, "n", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(x)) for x in shares]).alias("q"))


def rank_errors(rows: DataFrame, value: str, shares: list[float], groups: list[str] | tuple[str, ...] = (), k: int = SKETCH_K) -> DataFrame:
    """(groups, share, error): how far the rank of a sketched quantile is from what was asked for; a value that is repeated has a range of ranks."""
    told = sketched_quantiles(rows, value, shares, groups, k).select(*groups, "n", F.posexplode("q").alias("at", "q"))
    asked = rows.where(F.col(value).isNotNull()).select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col(value).cast("double").alias("v"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    counted = asked.join(F.broadcast(told), same).groupBy(*groups, "at").agg(F.max("n").alias("n"), F.count_if(F.col("v") < F.col("q")).alias("below"), F.count_if(F.col("v") <= F.col("q")).alias("upto"))
    share = F.get(F.array(*[F.lit(x) for x in shares]), F.col("at"))
    return counted.select(*groups, share.alias("share"), F.greatest(F.lit(0.0), F.col("below") / F.col("n") - share, share - F.col("upto") / F.col("n")).alias("error"))


def coverage(prefixes: DataFrame, labels: DataFrame, scores: DataFrame) -> DataFrame:
    n = lambda df, name: df.select("prefix_id").distinct().agg(F.count("*").alias(name))
    out = n(prefixes, "n_prefixes").crossJoin(n(labels, "n_labelled")).crossJoin(n(scores, "n_scored"))
    return out.withColumn("fraction", F.try_divide("n_labelled", "n_prefixes")).withColumn("incomplete", (F.col("n_labelled") < F.col("n_prefixes")) | (F.col("n_scored") < F.col("n_prefixes")))
