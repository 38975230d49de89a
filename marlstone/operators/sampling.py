"""Deterministic samples by hashes, and prefixes of solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_hash(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def hash_sample(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """The n rows of the smallest hashes, whatever the order and the partitions of the input; a top-n, not a sort of all rows."""
    return rows.orderBy(sample_hash(F.col(key), seed), key).limit(n)


def stratified_sample(rows: DataFrame, n: int, seed: int, key: str = "id", stratum: str = "level") -> DataFrame:
    """n rows over the strata in proportion, by largest remainders; ties go to smaller strata numbers. A null stratum is a stratum before all others.

    All rows where there are no more than n. Quotas come from one count for each stratum.
    """
    level = F.coalesce(F.col(stratum), F.lit(-1))
    sizes = rows.groupBy(level.alias("stratum_key")).agg(F.count("*").alias("size"))
    everything = Window.partitionBy(F.lit(0))  # one row for each stratum
    quotas = (sizes.withColumn("total", F.sum("size").over(everything))
              .withColumn("base", F.floor(F.lit(n) * F.col("size") / F.col("total"))).withColumn("rest", F.lit(n) * F.col("size") % F.col("total"))
              .withColumn("place", F.row_number().over(everything.orderBy(F.desc("rest"), "stratum_key")))
              .withColumn("left", F.lit(n) - F.sum("base").over(everything))
              .select("stratum_key", F.when(F.col("total") <= n, F.col("size")).otherwise(F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("quota")))
    ranked = rows.withColumn("stratum_key", level).withColumn("place", F.row_number().over(Window.partitionBy("stratum_key").orderBy(sample_hash(F.col(key), seed), key)))
    return ranked.join(F.broadcast(quotas), "stratum_key").where("place <= quota").drop("place", "quota", "stratum_key")


def prefix_lengths(n: Column, cap: int) -> Column:
    """All lengths from 1 to n if there are no more than `cap`, else `cap` of them evenly spaced from 1 to n, halves rounded to even."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.when(i == cap - 1, n).otherwise(F.bround(1 + i * ((n - 1) / F.lit(max(cap - 1, 1)))).cast("int")))
    every = F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.when(n <= cap, every).otherwise(F.array_sort(F.array_distinct(spaced)))


def prefixes(traces: DataFrame, cap: int = 8) -> DataFrame:
    """(prefix_id, problem_id, depth, rel_depth, n_steps, is_final) of each chosen prefix; a trace without steps has none."""
    n = F.col("n_steps").cast("int")
    depth = traces.select("problem_id", n.alias("n_steps")).select("problem_id", "n_steps", F.explode(prefix_lengths(F.col("n_steps"), cap)).alias("depth"))
    return depth.select(F.concat("problem_id", F.lit("#"), F.col("depth").cast("string")).alias("prefix_id"), "problem_id", "depth", (F.col("depth") / F.col("n_steps")).alias("rel_depth"), "n_steps", (F.col("depth") == F.col("n_steps")).alias("is_final"))


def prefix_steps(prefixes_: DataFrame, traces: DataFrame) -> DataFrame:
    return prefixes_.join(traces.select("problem_id", "steps"), "problem_id").withColumn("steps", F.slice("steps", 1, F.col("depth")))
