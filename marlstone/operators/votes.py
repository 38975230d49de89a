"""Votes over sampled solutions, and curves over the number of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import normalize_answer


def _sizes(samples: DataFrame, sizes: list[int]) -> DataFrame:
    """Each sample once for each size that takes it."""
    return samples.withColumn("size", F.explode(F.array(*[F.lit(n) for n in sizes]))).where("i < size")


def majority_curve(samples: DataFrame, sizes: list[int], keys: tuple[str, ...] = ("problem_id",), norm=normalize_answer) -> DataFrame:
    """(keys, size, answer, votes, tokens): the vote of the first `size` samples and what they cost, for sizes that have a sample.

    Answers are grouped by their normal form, null and blank ones don't vote; most votes win, then the
    answer that came first, whose own spelling is returned. Each sample is normalised and counted once
    for all sizes: its group comes first at the same sample in each size that has the group.
    """
    in_size = [F.col("i") < n for n in sizes]
    groups = samples.groupBy(*keys, norm(F.col("answer")).alias("norm")).agg(F.min("i").alias("first"), F.min_by("answer", "i").alias("answer"), F.array(*[F.count_if(c) for c in in_size]).alias("votes"),
                                                                             F.array(*[F.sum(F.when(c, F.col("tokens"))) for c in in_size]).alias("tokens"))
    best = lambda k: F.max_by(F.struct("answer", F.col("votes")[k].alias("votes")), F.when((F.col("norm") != "") & (F.col("votes")[k] > 0), F.struct(F.col("votes")[k], -F.col("first"))))
    every = [F.struct(F.lit(n).alias("size"), best(k).alias("won"), F.sum(F.col("tokens")[k]).alias("tokens"), F.sum(F.col("votes")[k]).alias("taken")) for k, n in enumerate(sizes)]
    sized = groups.groupBy(*keys).agg(F.array(*every).alias("sizes")).select(*keys, F.explode("sizes").alias("s")).where("s.taken > 0")
    return sized.select(*keys, "s.size", "s.won.answer", F.coalesce("s.won.votes", F.lit(0)).alias("votes"), "s.tokens")


def majority_vote(samples: DataFrame, keys: tuple[str, ...] = ("problem_id",), norm=normalize_answer) -> DataFrame:
    """(keys, answer, votes, tokens): as `majority_curve`, over all samples."""
    groups = samples.groupBy(*keys, norm(F.col("answer")).alias("norm")).agg(F.count("*").alias("votes"), F.min("i").alias("first"), F.min_by("answer", "i").alias("answer"), F.sum("tokens").alias("tokens"))
    won = F.max_by(F.struct("answer", "votes"), F.when(F.col("norm") != "", F.struct("votes", -F.col("first"))))
    return groups.groupBy(*keys).agg(won.alias("w"), F.sum("tokens").alias("tokens")).select(*keys, "w.answer", F.coalesce("w.votes", F.lit(0)).alias("votes"), "tokens")


def best_of_curve(samples: DataFrame, sizes: list[int], keys: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """(keys, size, answer, score, tokens): the answer (null perhaps) of the best-scored of the first `size` samples, the earliest among equals."""
    return best_of(_sizes(samples, sizes), (*keys, "size"))


def best_of(samples: DataFrame, keys: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """(keys, answer, score, tokens): as `best_of_curve`, over all samples."""
    best = F.max_by(F.struct("answer", "score"), F.struct("score", -F.col("i")))
    return samples.groupBy(*keys).agg(best.alias("b"), F.sum("tokens").alias("tokens")).select(*keys, "b.answer", "b.score", "tokens")


def expand_curves(samples: DataFrame, sizes: list[int], keys: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """(keys, method, n, answer, tokens, usd): a row for each size not beyond the number of samples; the cost in dollars is shared out by n / number of samples."""
    count = samples.groupBy(*keys).agg(F.count("*").alias("have"), F.sum("usd").alias("all_usd"))
    both = majority_curve(samples, sizes, keys).select(*keys, "size", F.lit("sc").alias("method"), "answer", "tokens").unionByName(best_of_curve(samples, sizes, keys).select(*keys, "size", F.lit("bon").alias("method"), "answer", "tokens"))
    return both.join(count, list(keys)).where("size <= have").select(*keys, "method", F.col("size").alias("n"), "answer", "tokens", F.when(F.col("method") == "bon", F.col("all_usd") * F.col("size") / F.col("have")).otherwise(F.lit(0.0)).alias("usd"))


def expand_rows(rows: DataFrame, sizes: list[int], grade) -> DataFrame:
    """Result rows with each sampled one replaced by a row for each size not beyond its samples; other rows, and those with an error, pass through.

    Needs method, answer, gold, correct, error, compute_tokens, usd and `samples` (array of structs answer, score,
    tokens in order, null for other methods). Derived rows have method_id `method[n=size]`, `derived_from` (the row's
    own method_id) and no samples, are graded anew by grade(answer, gold), and share out the dollars of `bon` by size.
    """
    from marlstone.operators.analysis import with_method_id
    from marlstone.operators.rows import failed

    rows = with_method_id(rows)
    sampled = F.col("method").isin("sc", "bon") & F.col("samples").isNotNull() & ~failed(F.col("error"))
    rest = rows.where(~F.coalesce(sampled, F.lit(False))).withColumn("derived_from", F.lit(None).cast("string")).drop("samples")
    keys = ("problem_id", "method_id")
    one = rows.where(sampled).select(*keys, "method", F.size("samples").alias("have"), F.posexplode("samples").alias("i", "s")).select(*keys, "method", "have", "i", "s.answer", "s.score", "s.tokens")
    taken = one.where(f"have >= {min(sizes)}")
    curve = majority_curve(taken.where("method = 'sc'"), sizes, keys).drop("votes").unionByName(best_of_curve(taken.where("method = 'bon'"), sizes, keys).drop("score"))
    curve = curve.select(*keys, "size", F.col("answer").alias("new_answer"), F.col("tokens").alias("new_tokens"))
    made = rows.where(sampled).join(curve, list(keys)).where(F.col("size") <= F.size("samples")).withColumn("derived_from", F.col("method_id"))
    made = made.withColumn("answer", F.col("new_answer")).withColumn("compute_tokens", F.col("new_tokens")).withColumn("correct", grade(F.col("answer"), F.col("gold")))
    made = made.withColumn("usd", F.when(F.col("method") == "bon", F.col("usd") * F.col("size") / F.size("samples")).otherwise(F.col("usd"))).withColumn("method_id", F.concat("method", F.lit("[n="), F.col("size").cast("string"), F.lit("]")))
    return rest.unionByName(made.select(*rest.columns))


def value_vote(leaves: DataFrame, norm=normalize_answer) -> DataFrame:
    """(tree_id, answer, score, visits, node_id): of terminal leaves with an answer, a value and visits.

    Groups by normal form are scored by the sum of N * value; then more visits, then the smaller form.
    The answer is that of the group's leaf with the most N * value, the first in preorder among equals.
    """
    used = leaves.where("terminal and final_answer is not null and value is not null and N > 0").withColumn("norm", norm(F.col("final_answer"))).withColumn("mass", F.col("N") * F.col("value"))
    groups = used.groupBy("tree_id", "norm").agg(F.sum("mass").alias("score"), F.sum("N").alias("visits"), F.max_by(F.struct("final_answer", "node_id"), F.struct("mass", -F.col("node_id"))).alias("leaf"))
    ordered = F.struct("score", "visits", smaller_first(F.col("norm")))
    return groups.groupBy("tree_id").agg(F.max_by(F.struct("leaf", "score", "visits"), ordered).alias("w")).select("tree_id", F.col("w.leaf.final_answer").alias("answer"), "w.score", "w.visits", F.col("w.leaf.node_id").alias("node_id"))


def smaller_first(c: Column) -> Column:
    """An order in which smaller strings are larger: code points negated, with an end mark above all of them."""
    return F.concat(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: -F.ascii(x)), F.array(F.lit(1)))
