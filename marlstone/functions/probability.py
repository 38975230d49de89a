"""Column functions over priors, values and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probability of an option that a judge left out.
MISSING = 1e-3


def q_value(visits: Column, total: Column) -> Column:
    return F.when(visits == 0, F.lit(0.0)).otherwise(total / visits)


def q_effective(visits: Column, total: Column, virtual_loss: Column, unvisited: float = 0.0) -> Column:
    n = visits + virtual_loss
    return F.when(n == 0, F.lit(unvisited)).otherwise(F.try_divide(total, n))


def puct_score(q: Column, prior: Column, parent_n: Column, child_n: Column, c: float = 1.5) -> Column:
    return q + F.lit(c) * prior * F.sqrt(F.greatest(F.lit(1), parent_n)) / (1 + child_n)


def prior_floor(priors: Column, floor: float) -> Column:
    """(1 - floor) p + floor / k."""
    return priors if floor <= 0 else F.transform(priors, lambda p: (1 - floor) * p + F.lit(floor) / F.size(priors))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _uniform(c: Column) -> Column:
    return F.transform(c, lambda _: F.lit(1.0) / F.size(c))


def renormalize(probabilities: Column) -> Column:
    """To a sum of 1, nulls counting MISSING; uniform where all are null or the sum isn't positive."""
    filled = F.transform(probabilities, lambda p: F.coalesce(p.cast("double"), F.lit(MISSING)))
    empty = F.forall(probabilities, lambda p: p.isNull())
    return F.when(empty | (_sum(filled) <= 0), _uniform(probabilities)).otherwise(F.transform(filled, lambda p: p / _sum(filled)))


def merge_priors(priors: Column, mapping: Column, n_unique: Column) -> Column:
    """Sums of the priors by the slot that each candidate was merged into (-1: none), to a sum of 1; uniform where nothing is left. Lengths that differ are an error."""
    pairs = F.arrays_zip(priors.alias("p"), mapping.alias("m"))
    sums = F.transform(F.sequence(F.lit(0), n_unique - 1), lambda k: F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.when(x["m"] == k, x["p"]).otherwise(0.0)))
    out = F.when(_sum(sums) > 0, F.transform(sums, lambda x: x / _sum(sums))).otherwise(_uniform(sums))
    out = F.when(n_unique > 0, out).otherwise(F.array().cast("array<double>"))
    return F.when(F.size(priors) == F.size(mapping), out).otherwise(F.raise_error(F.lit("priors and mapping differ in length")))


def choice_priors(probabilities: Column, n: Column) -> Column:
    """A judge's map `c0`, `c1`, ... as an array; one candidate alone gets 1; no distribution at all is an error."""
    looked_up = renormalize(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.try_element_at(probabilities, F.concat(F.lit("c"), i.cast("string")))))
    return F.when(n == 1, F.array(F.lit(1.0))).when(probabilities.isNotNull(), looked_up).otherwise(F.raise_error(F.lit("the judge gave no distribution")))


# Multiplier, increment and modulus of the generator that orders options.
ORDER_BY = (6364136223846793005, 1, 1 << 64)


def option_order(state: Column, n: Column) -> Column:
    """The order in which n options are shown for a judge's state: array<int>, order[i] the option at place i; a Fisher-Yates shuffle by a 64-bit congruential generator seeded by the state's SHA-256, so the same for the same text anywhere.

    Products pass 64 bits; they are taken by halves of the generator's state, exactly, in decimals. Null for a null state, empty without options.
    """
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    multiplier, increment, modulus = ORDER_BY
    half = wide(1 << 32)

    def following(s: Column) -> Column:
        low, high = (s % half).cast("decimal(10,0)"), F.floor(s / half).cast("decimal(10,0)")
        by = F.lit(str(multiplier)).cast("decimal(19,0)")
        upper = ((high * by) % half).cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)")
        return (((low * by).cast("decimal(38,0)") + upper.cast("decimal(38,0)") + wide(increment)) % wide(modulus)).cast("decimal(38,0)")

    def swapped(acc: Column, i: Column) -> Column:
        s = following(acc["s"])
        return F.struct(s.alias("s"), F.get(F.transform(F.array((s % (i + 1)).cast("int")), lambda j: F.transform(acc["order"], lambda x, k: F.when(k == i, F.get(acc["order"], j)).when(k == j, F.get(acc["order"], i)).otherwise(x))), F.lit(0)).alias("order"))

    seed = F.conv(F.substring(F.sha2(state, 256), 1, 16), 16, 10).cast("decimal(38,0)")
    start = F.struct(seed.alias("s"), F.sequence(F.lit(0), n - 1).cast("array<int>").alias("order"))
    order = F.when(n <= 1, F.slice(F.array(F.lit(0)), 1, n)).otherwise(F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), start, swapped)["order"])
    return F.when(state.isNotNull(), order)


def unshuffle(values: Column, order: Column) -> Column:
    """order[i] is the candidate shown at place i; the values in the candidates' own order."""
    return F.transform(F.sequence(F.lit(1), F.size(values)), lambda k: F.get(values, (F.array_position(order, k - 1) - 1).cast("int")))


def yes_probability(logprobs: Column) -> Column:
    """p(yes) / (p(yes) + p(no)) from a map of token log-probabilities; null without either."""
    from marlstone.functions.text import clean_token

    entries = F.map_entries(logprobs)
    mass = lambda word: F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.when(clean_token(e["key"]) == word, F.exp(e["value"])).otherwise(0.0))
    return F.try_divide(mass("yes"), mass("yes") + mass("no"))


def letter_priors(logprobs: Column, n: Column) -> Column:
    from marlstone.functions.text import clean_token

    entries = F.map_entries(logprobs)

    def mass(k: Column) -> Column:
        of = F.filter(entries, lambda e: clean_token(e["key"]) == F.lower(F.char(k + 65)))
        return F.when(F.size(of) > 0, F.aggregate(of, F.lit(0.0), lambda s, e: s + F.exp(e["value"])))

    return renormalize(F.transform(F.sequence(F.lit(0), n - 1), mass))


def least_step_score(scores: Column, n_steps: Column, root_value: float = 0.5) -> Column:
    """A process reward model's value: the least score of a step; the root's value without steps; another number of scores than of steps is an error."""
    return F.when(n_steps == 0, F.lit(root_value)).when(F.size(scores) == n_steps, F.array_min(scores)).otherwise(F.raise_error(F.lit("not a score for each step")))


def usd(tokens: Column, price_per_million: Column | float) -> Column:
    return tokens * (price_per_million if isinstance(price_per_million, Column) else F.lit(price_per_million)) / 1e6


def log_distance(a: Column, b: Column) -> Column:
    return F.abs(F.ln(a) - F.ln(b))


def bin_index(p: Column, n_bins: int = 10) -> Column:
    """The equal-width bin of a probability; 1 belongs to the last bin, what is outside to the nearest."""
    return F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor(p * n_bins).cast("int")))
