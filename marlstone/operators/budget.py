"""Rate limits, budgets and estimates over calls in order. Callers give `groups` (a run) so that a schedule is a window within a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import Written


def _w(groups: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rate_limit(calls: DataFrame, interval: float, groups: list[str], order: list[str], at: str = "at") -> DataFrame:
    """`start`: each call as soon as it comes, but `interval` after the last; closed form of a recurrence by a running maximum."""
    w = _w(groups, order)
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    return calls.withColumn("place", place).withColumn("start", F.max(F.col(at) - F.col("place") * interval).over(w) + F.col("place") * interval)


def spend_cap(calls: DataFrame, cap: float, groups: list[str], order: list[str], usd: str = "usd") -> DataFrame:
    """Calls up to and with the first that takes the sum beyond the cap, with `spent`."""
    total = F.sum(usd).over(_w(groups, order))
    return calls.withColumn("spent", total).where(F.col("spent") - F.col(usd) <= cap)


def admit(calls: DataFrame, cap: float, groups: list[str], order: list[str], estimate: str = "estimate") -> DataFrame:
    """`admitted`: whether a call came before the first whose estimate would take the reserved sum beyond the cap; that one stops the run."""
    total = F.sum(estimate).over(_w(groups, order))
    return calls.withColumn("reserved", total).withColumn("admitted", ~F.max(F.col("reserved") > cap).over(_w(groups, order)))


def admit_each(estimates: Column, cap: float) -> Column:
    """For an array of estimates in order: whether each is admitted, where a rejected call reserves nothing."""
    start = F.struct(F.lit(0.0).alias("held"), F.array().cast("array<boolean>").alias("out"))
    def step(s: Column, x: Column) -> Column:
        fits = s["held"] + x <= cap
        return F.struct(F.when(fits, s["held"] + x).otherwise(s["held"]).alias("held"), F.array_append(s["out"], fits).alias("out"))
    return F.aggregate(estimates, start, step)["out"]


def fold_admissions(estimates: np.ndarray, held: float, cap: float) -> tuple[np.ndarray, float]:
    """(whether each is admitted, what is held in the end) where a call that doesn't fit reserves nothing and the next may fit.

    Goes from one rejection to the next; what is larger than all the room that is left is skipped at once.
    """
    admitted, at = np.zeros(len(estimates), bool), 0
    left = np.arange(len(estimates))
    while len(left):
        left = left[at:][estimates[left[at:]] <= cap - held]  # room only shrinks
        total = held + np.cumsum(estimates[left])
        fit = int(np.searchsorted(total > cap, True))
        admitted[left[:fit]] = True
        held = float(total[fit - 1]) if fit else held
        at = fit + 1
    return admitted, held


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """(run, stretch, rows) of rows that are sorted by both."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = [batch.column(c).dictionary_encode().indices.to_numpy() for c in ("budget_run", "budget_part")] if batch.num_rows else []
        edges = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1 if keys else []
        for begin, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            piece = batch.slice(begin, end - begin)
            if not piece.num_rows:
                continue
            if held and any(held[-1].column(c)[0] != piece.column(c)[0] for c in ("budget_run", "budget_part")):
                yield held[0].column("budget_run")[0].as_py(), held[0].column("budget_part")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield held[0].column("budget_run")[0].as_py(), held[0].column("budget_part")[0].as_py(), pa.Table.from_batches(held)


def admit_in_order(calls: DataFrame, cap: float, groups: list[str], order: list[str], estimate: str = "estimate") -> DataFrame:
    """The calls with `admitted`: each run's calls in order, each admitted if what is held with it doesn't pass the cap; a rejected one reserves nothing. Negative and missing estimates are errors.

    Calls are dealt by range, so a run of many calls is a sequence of stretches in several tasks. Only what is held before a stretch
    depends on those before it. Where the sum of a stretch still fits it is added without looking inside, and where not even its least
    estimate fits nothing is; only other stretches are folded, the next one of every run in the same job. What meets on the driver is
    a row for each stretch of a run that has several, so about two for each task.
    """
    key = F.to_json(F.struct(*groups)) if groups else F.lit("{}")
    e = F.col(estimate).cast("double")
    sound = F.when((e >= 0) & ~F.isnan(e), e).otherwise(F.raise_error(F.lit("an estimate is missing or negative")).cast("double"))
    placed = Written(calls.withColumn("budget_run", key).withColumn("budget_estimate", sound).repartitionByRange("budget_run", *order).withColumn("budget_part", F.spark_partition_id()), "placed")
    stretches = placed.df.groupBy("budget_run", "budget_part").agg(F.sum("budget_estimate").alias("total"), F.min("budget_estimate").alias("least"))
    long = Written(stretches.join(stretches.groupBy("budget_run").count().where("count > 1").drop("count"), "budget_run"), "stretches")
    waiting: dict[str, list] = {}
    for r in long.df.orderBy("budget_run", "budget_part").collect():
        waiting.setdefault(r.budget_run, []).append((r.budget_part, r.total, r.least))
    spark, held, before = calls.sparkSession, dict.fromkeys(waiting, 0.0), {}
    whole = lambda df: df.repartition("budget_part", "budget_run").sortWithinPartitions("budget_run", "budget_part", *order)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, part, rows in _runs(batches):
            after = fold_admissions(rows.column("budget_estimate").to_numpy(), rows.column("budget_held")[0].as_py(), cap)[1]
            yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([part], pa.int32()), pa.array([after])], ["budget_run", "budget_part", "held"])

    while waiting:
        for run in list(waiting):
            while waiting[run]:
                part, total, least = waiting[run][0]
                before[run, part] = held[run]
                if held[run] + total <= cap:
                    held[run] += total
                elif held[run] + least <= cap:
                    break
                waiting[run].pop(0)
            if not waiting[run]:
                del waiting[run]
        if waiting:
            asked = spark.createDataFrame([(run, parts[0][0], held[run]) for run, parts in waiting.items()], "budget_run string, budget_part int, budget_held double")
            for r in whole(placed.df.select("budget_run", "budget_part", "budget_estimate", *order).join(F.broadcast(asked), ["budget_run", "budget_part"])).mapInArrow(folded, "budget_run string, budget_part int, held double").collect():
                held[r.budget_run] = r.held
                waiting[r.budget_run].pop(0)
                if not waiting[r.budget_run]:
                    del waiting[r.budget_run]
    known = spark.createDataFrame([(run, part, x) for (run, part), x in before.items()], "budget_run string, budget_part int, budget_held double")
    rows = placed.df.join(F.broadcast(known), ["budget_run", "budget_part"], "left").withColumn("budget_held", F.coalesce("budget_held", F.lit(0.0)))
    names = calls.columns
    out = calls.schema.add("admitted", "boolean")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows_ in _runs(batches):
            admitted = fold_admissions(rows_.column("budget_estimate").to_numpy(), rows_.column("budget_held")[0].as_py(), cap)[0]
            yield from rows_.select(names).append_column("admitted", pa.array(admitted)).to_batches()

    return whole(rows).mapInArrow(told, out)


def judge_cost(n_calls: Column, price: float = 0.042, tokens_per_call: int = 2000) -> Column:
    return n_calls * tokens_per_call * price / 1e6


def generator_cost(prompt_tokens: Column, completion_tokens: Column, price_in: float = 0.09, price_out: float = 0.30) -> Column:
    return (prompt_tokens * price_in + completion_tokens * price_out) / 1e6


def confirm_cost(estimate: float, threshold: float, confirmed: bool) -> None:
    if estimate > threshold and not confirmed:
        raise ValueError(f"an estimate of ${estimate:.2f} is above ${threshold:.2f} and not confirmed")
