"""Result rows: one for each (problem, method) attempt. `seq` is the order of arrival, which a DataFrame doesn't keep by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import shard_of


def failed(error: Column) -> Column:
    """Whether an error text says so; null and empty mean success."""
    return F.coalesce(error, F.lit("")) != ""


def compute_tokens(rows: DataFrame) -> Column:
    """The compute axis: compute_tokens, else completion tokens, else 0."""
    have = [F.col(c) for c in ("compute_tokens", "completion_tokens") if c in rows.columns]
    return F.coalesce(*have, F.lit(0))


def latest_success(rows: DataFrame, keys: tuple[str, ...] = ("problem_id", "method"), error: str = "error", seq: str = "seq") -> DataFrame:
    """One row for each key: the last success, or the last error where there is no success.

    An aggregate with map-side combining rather than a window, so a key with many rows never meets in one task.
    """
    whole = F.struct(*rows.columns)
    best = rows.groupBy(*keys).agg(F.max_by(whole, F.struct((~failed(F.col(error))).alias("ok"), F.col(seq).alias("seq"))).alias("best"))
    return best.select("best.*")


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """Bag union by column name, with `run_no` for the order of the runs."""
    tagged = [r.withColumn("run_no", F.lit(k)) for k, r in enumerate(runs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def merge_runs(runs: list[DataFrame], keys: tuple[str, ...] = ("problem_id", "method"), allow_mixed: bool = False) -> DataFrame:
    """Union, then latest success with later runs winning; a method with several protocol hashes is an error unless allowed."""
    merged = latest_success(union_runs(runs).withColumn("arrival", F.struct("run_no", "seq")), keys, seq="arrival").drop("arrival", "run_no")
    if not allow_mixed and "protocol_hash" in merged.columns:
        bad = mixed_protocols(merged).limit(1).collect()
        if bad:
            raise ValueError(f"method {bad[0][0]} was run under several protocols")
    return merged.orderBy("method", "problem_id")


def mixed_protocols(rows: DataFrame) -> DataFrame:
    """(method_id, n_protocols) of method ids (methods where there is none) with more than one protocol hash, else configuration hash, else ''; an empty hash is a missing one."""
    have = [F.when(F.col(c) != "", F.col(c)) for c in ("protocol_hash", "config_hash") if c in rows.columns]
    ids = [F.col(c) for c in ("method_id", "method") if c in rows.columns]
    return rows.groupBy(F.coalesce(*ids).alias("method_id")).agg(F.countDistinct(F.coalesce(*have, F.lit(""))).alias("n_protocols")).where("n_protocols > 1")


def resume(items: DataFrame, done: DataFrame, keys: tuple[str, ...], retry_errors: bool = False) -> DataFrame:
    """The items without a finished row; errors count as finished unless they are to be retried."""
    finished = done.where(~failed(F.col("error"))) if retry_errors else done
    return items.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def in_shard(rows: DataFrame, index: int, count: int, key: str = "problem_id") -> DataFrame:
    if not 0 <= index < count:
        raise ValueError(f"shard {index}/{count} doesn't exist")
    return rows.where(shard_of(F.col(key), count) == index)


def parse_shard(spec: str) -> tuple[int, int]:
    index, _, count = spec.partition("/")
    if not index.isdigit() or not count.isdigit() or int(index) >= int(count):
        raise ValueError(f"{spec!r} isn't a shard i/n with i < n")
    return int(index), int(count)


def parse_method(spec: str, sampled: frozenset[str] = frozenset(("sc", "bon")), known: frozenset[str] = frozenset(("tz", "tz_self", "tz_prm", "cot", "c31b", "sc", "bon"))) -> dict:
    """`name[:N[/M]]` to a name with its numbers of samples."""
    name, _, numbers = spec.partition(":")
    if name not in known:
        raise ValueError(f"{name!r} is no method")
    if (name in sampled) != bool(numbers):
        raise ValueError(f"{name!r} {'needs' if name in sampled else 'takes no'} number of samples")
    if not numbers:
        return {"name": name}
    n, _, m = numbers.partition("/")
    if not n.isdigit() or m and not m.isdigit() or int(n) < 1 or m and int(m) < int(n):
        raise ValueError(f"{spec!r} has no valid number of samples")
    return {"name": name, "n": int(n), "m": int(m or n)}


def redact(problems: DataFrame) -> DataFrame:
    return problems.withColumn("answer", F.lit(""))


def duplicate_ids(rows: DataFrame, key: str = "problem_id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def problem_set_differences(rows: DataFrame) -> DataFrame:
    """(method, added, missing): how each method's problems differ from those of the method that came first."""
    sets = rows.select("method", "problem_id").distinct()
    first = rows.groupBy("method").agg(F.min("seq").alias("seq")).agg(F.min_by("method", "seq").alias("first"))
    reference = sets.join(F.broadcast(first), F.col("method") == F.col("first"), "left_semi").select("problem_id", F.lit(1).alias("in_first"))
    counts = sets.join(reference, "problem_id", "left").groupBy("method").agg(F.count("*").alias("n"), F.count("in_first").alias("common"))
    size = reference.agg(F.count("*").alias("size"))
    return counts.crossJoin(F.broadcast(size)).select("method", (F.col("n") - F.col("common")).alias("added"), (F.col("size") - F.col("common")).alias("missing"))


def insert_if_absent(cache: DataFrame, new: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Rows of `new` whose key the cache doesn't have, the first of each key."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), seq).alias("row")).select("row.*")
    return first.join(cache.select(key).distinct(), key, "left_anti")


def probe(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The requests with the cached `value`, null on a miss."""
    return requests.join(cache.select(key, "value"), key, "left")
