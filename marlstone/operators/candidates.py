"""Greedy de-duplication of candidate steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import jaccard_of, normalize_step, tokens


def greedy_mapping(candidates: Column, jaccard_min: float | None = 0.9) -> Column:
    """For each candidate in order, the number of the first earlier unique one that it equals (by normal form, or by token similarity), or its own new number; -1 if blank.

    A merged candidate never represents others, so this is a fold and no transitive closure.
    """
    forms = F.transform(candidates, lambda c: F.struct(normalize_step(c).alias("norm"), tokens(normalize_step(c)).alias("toks")))
    start = F.struct(F.array().cast("array<struct<norm:string,toks:array<string>>>").alias("kept"), F.array().cast("array<int>").alias("mapping"))

    def step(s: Column, x: Column) -> Column:
        def alike(k: Column) -> Column:
            if jaccard_min is None:
                return k["norm"] == x["norm"]
            # sets of too different sizes aren't compared
            m, n = F.size(k["toks"]), F.size(x["toks"])
            return F.when(F.try_divide(F.least(m, n), F.greatest(m, n)) >= jaccard_min, (k["norm"] == x["norm"]) | (jaccard_of(k["toks"], x["toks"]) >= jaccard_min)).otherwise(False)

        at = F.array_position(F.transform(s["kept"], alike), True).cast("int")
        return (F.when(x["norm"] == "", F.struct(s["kept"].alias("kept"), F.array_append(s["mapping"], F.lit(-1)).alias("mapping")))
                .when(at > 0, F.struct(s["kept"].alias("kept"), F.array_append(s["mapping"], at - 1).alias("mapping")))
                .otherwise(F.struct(F.array_append(s["kept"], x).alias("kept"), F.array_append(s["mapping"], F.size(s["kept"])).alias("mapping"))))

    return F.aggregate(forms, start, step)["mapping"]
