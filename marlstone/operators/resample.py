"""Draws with replacement over distributed rows: how often each draw takes each cluster, and statistics of all draws at once.

A draw of n out of n clusters is a vector of multinomial counts. It is made from the top: of the c times
that a draw falls on ranks lo..hi, those that fall on the lower half are a binomial count from a hash of
(seed, draw, lo, hi). So a task finds the counts of its own ranks alone, the same ones for any partitioning,
each draw's counts add up to n, and no table of indices exists. All draws of a cluster are one array.

Statistics of a draw that are functions of sums (means, ratios, calibration, moments) are sums of arrays, combined in
each task before they meet. AUROC sorts the rows once, not once a draw: rows are dealt by range, a task adds up its own
stretch, and what lies before it is an offset for each draw. Quantiles count ranges of values, then the values of the
ranges that matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources.shared import Written

N_BOOT = 1000
#: Multipliers of seed, draw, lo and hi, and the finalizer of 32-bit hashes (fixed values).
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
FINAL = (0x85EBCA6B, 0xC2B2AE35)
#: Counts up to which the hashes of many counts are made step by step together; of a greater one they are made by themselves.
STEPS = 2048
#: Numbers that a step takes at once, so that they stay in the cache.
BLOCK = 1 << 15
#: Numbers of a counts matrix that are made at once.
AT_ONCE = 1 << 21

_U32, _U64 = np.uint32, np.uint64


def _mix(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """The 32-bit finalizer of x, in its place."""
    spare = np.empty_like(x) if spare is None else spare
    for shift, factor in ((16, FINAL[0]), (13, FINAL[1]), (16, None)):
        np.bitwise_xor(x, np.right_shift(x, _U32(shift), out=spare), out=x)
        if factor:
            np.multiply(x, _U32(factor), out=x)
    return x


def _hits(key: np.ndarray, share: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of the hashes of (key, 0), (key, 1), ... (key, counts - 1) are below the share; all flat."""
    out = np.zeros(len(counts), np.int64)
    x, spare, below = np.empty(BLOCK, _U32), np.empty(BLOCK, _U32), np.empty(BLOCK, bool)
    places = np.arange(BLOCK, dtype=_U32) * _U32(MIX[0])
    for k in np.flatnonzero(counts > STEPS):
        for begin in range(0, int(counts[k]), BLOCK):
            m = min(BLOCK, int(counts[k]) - begin)
            np.add(places[:m], _U32((int(key[k]) + begin * MIX[0]) & 0xFFFFFFFF), out=x[:m])
            out[k] += np.count_nonzero(np.less(_mix(x[:m], spare[:m]), share[k], out=below[:m]))
    few = np.flatnonzero((counts > 0) & (counts <= STEPS))
    for begin in range(0, len(few), BLOCK):
        # greatest counts first, so those that go on are always the first ones
        at = few[begin:begin + BLOCK]
        at = at[np.argsort((STEPS - counts[at]).astype(np.uint16), kind="stable")]
        keys, shares = key[at], share[at]
        going = len(at) - np.cumsum(np.bincount(counts[at]))
        found, some = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint8)
        for j in range(len(going) - 1):
            m = going[j]
            np.add(keys[:m], _U32(j * MIX[0] & 0xFFFFFFFF), out=x[:m])
            np.less(_mix(x[:m], spare[:m]), shares[:m], out=below[:m])
            some[:m] += below[:m].view(np.uint8)
            if j % 255 == 254:
                found += some
                some[:] = 0
        out[at] = found + some
    return out


def _lower(counts: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    """Of counts (nodes x draws), how many fall on lo..mid of lo..hi: one for each hash whose product with hi - lo is below (mid - lo) << 32."""
    nodes, draws = counts.shape
    key = seed * MIX[0] + np.arange(draws, dtype=_U64) * _U64(MIX[1])
    key = _mix((key[None, :] + (lo.astype(_U64) * _U64(MIX[2]))[:, None] + (hi.astype(_U64) * _U64(MIX[3]))[:, None]).astype(_U32)).ravel()
    width = (hi - lo).astype(_U64)
    share = ((((mid - lo).astype(_U64) << _U64(32)) + width - _U64(1)) // width).astype(_U32)
    return _hits(key, np.repeat(share, draws), counts.ravel()).reshape(nodes, draws)


def counts_of(ranks: np.ndarray, n: int, n_boot: int = N_BOOT, seed: int = 0, top: dict | None = None) -> np.ndarray:
    """How often each draw of n out of n takes each of the sorted, different ranks (ranks x draws).

    `top` holds the splits of the widest ranges for other ranks of the same n, at most about 4,096 of them.
    """
    wide = max(STEPS, n >> 11)
    lo, hi, counts = np.zeros(1, np.int64), np.full(1, n, np.int64), np.full((1, n_boot), n, np.int64)
    while (hi - lo > 1).any():
        open_ = hi - lo > 1
        a, z, c = lo[open_], hi[open_], counts[open_]
        mid = (a + z) // 2
        left = _kept_lower(c, a, mid, z, seed, wide, top) if top is not None else _lower(c, a, mid, z, seed)
        los, his, cs = np.concatenate([lo[~open_], a, mid]), np.concatenate([hi[~open_], mid, z]), np.concatenate([counts[~open_], left, c - left])
        wanted = np.searchsorted(ranks, los) < np.searchsorted(ranks, his)
        order = np.argsort(los[wanted], kind="stable")
        lo, hi, counts = los[wanted][order], his[wanted][order], cs[wanted][order]
    return counts


def _kept_lower(counts: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, seed: int, wide: int, top: dict) -> np.ndarray:
    """_lower, with the splits of ranges of more than `wide` ranks kept in `top`."""
    places = list(zip(lo.tolist(), hi.tolist()))
    new = np.array([p not in top for p in places])
    left = np.empty_like(counts)
    left[new] = _lower(counts[new], lo[new], mid[new], hi[new], seed)
    for k, p in enumerate(places):
        if not new[k]:
            left[k] = top[p]
        elif p[1] - p[0] > wide:
            top[p] = left[k].astype(np.int32 if counts[k].max() < 1 << 31 else np.int64)
    return left


class _Counts:
    """Counts by cluster; those asked for last are kept, and the widest splits of the last n."""

    def __init__(self, n_boot: int, seed: int):
        self.n_boot, self.seed, self.last, self.n, self.top = n_boot, seed, None, None, {}

    def __call__(self, ranks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts of the different ranks, place of each rank in them)."""
        different, at = np.unique(ranks, return_inverse=True)
        asked = (n, different.tobytes())
        if self.last is None or self.last[0] != asked:
            if self.n != n:
                self.n, self.top = n, {}
            self.last = asked, counts_of(different, n, self.n_boot, self.seed, self.top).astype(np.float64)
        return self.last[1], at


def _key(groups: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{g}`") for g in groups])) if groups else F.lit("{}")


def _groups_of(df: DataFrame, like: DataFrame, groups: list[str]) -> DataFrame:
    """Gives the groups back from `boot_key`."""
    if not groups:
        return df.drop("boot_key")
    schema = ", ".join(f"`{g}` {like.schema[g].dataType.simpleString()}" for g in groups)
    rest = [F.col(c) for c in df.columns if c != "boot_key"]
    return df.withColumn("boot_group", F.from_json("boot_key", schema)).select(*[F.col(f"boot_group.`{g}`").alias(g) for g in groups], *rest)


def ranked(rows: DataFrame, groups: list[str], cluster: str) -> DataFrame:
    """Rows of different (groups, cluster) with boot_key, boot_rank (from 0 by cluster in each group) and boot_n (of the group).

    Rows are sorted by range; a rank is the place in its stretch after the sizes of the stretches before.
    """
    at = F.shiftrightunsigned("boot_at", 33).alias("boot_part")
    placed = Written(rows.withColumn("boot_key", _key(groups)).repartitionByRange("boot_key", cluster).sortWithinPartitions("boot_key", cluster).withColumn("boot_at", F.monotonically_increasing_id()), "ranked")
    stretch = placed.df.groupBy("boot_key", at).agg(F.count("*").alias("boot_c"), F.min("boot_at").alias("boot_first"))
    w = Window.partitionBy("boot_key")
    before = F.coalesce(F.sum("boot_c").over(w.orderBy("boot_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stretch.select("boot_key", "boot_part", "boot_first", before.alias("boot_before"), F.sum("boot_c").over(w).alias("boot_n"))
    return placed.df.withColumn("boot_part", at).join(offsets, ["boot_key", "boot_part"]).withColumn("boot_rank", F.col("boot_before") + F.col("boot_at") - F.col("boot_first")).drop("boot_part", "boot_first", "boot_before", "boot_at")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """(key, n, places) of each group in a batch."""
    keys = batch.column("boot_key").dictionary_encode()
    codes, n = keys.indices.to_numpy(), batch.column("boot_n").to_numpy()
    order = np.argsort(codes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield keys.dictionary[int(codes[places[0]])].as_py(), int(n[places[0]]), places


def _summed(names: list[str], n_boot: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = _Counts(n_boot, seed), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = batch.column("boot_rank").to_numpy()
            values = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.float64)
            for key, n, places in _runs(batch):
                places = places[np.argsort(ranks[places], kind="stable")]
                for k in range(0, len(places), max(1, AT_ONCE // n_boot)):
                    some = places[k:k + max(1, AT_ONCE // n_boot)]
                    weights, at = counts(ranks[some], n)
                    by_rank = np.zeros((len(weights), len(names)))
                    np.add.at(by_rank, at, values[some])
                    sums[key] = sums.get(key, 0) + by_rank.T @ weights
        for key, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * n_boot), pa.array(np.arange(n_boot, dtype=np.int32)), *map(pa.array, x)], ["boot_key", "b", *names])

    return run


def draw_sums(rows: DataFrame, sums: dict[str, Column], groups: list[str] | tuple[str, ...], cluster: str, n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """(groups, b, sums): the sum of each named expression over the rows of each draw; rows of a cluster go together. Draws are numbered from 0 and none is missing."""
    groups = list(groups)
    own = rows.groupBy(*groups, cluster).agg(*[F.coalesce(F.sum(c.cast("double")), F.lit(0.0)).alias(k) for k, c in sums.items()])
    names = list(sums)
    found = ranked(own, groups, cluster).select("boot_key", "boot_n", "boot_rank", *names).mapInArrow(_summed(names, n_boot, seed), "boot_key string, b int, " + ", ".join(f"`{k}` double" for k in names))
    return _groups_of(found.groupBy("boot_key", "b").agg(*[F.sum(k).alias(k) for k in names]), rows, groups)


def bootstrap(rows: DataFrame, sums: dict[str, Column], statistic: Column, groups: list[str] | tuple[str, ...], cluster: str, n_boot: int = N_BOOT, seed: int = 0, name: str = "value") -> DataFrame:
    """(groups, b, value) of any statistic that is an expression of sums over the rows of a draw: means, ratios, moments, correlations, calibration errors."""
    return draw_sums(rows, sums, groups, cluster, n_boot, seed).select(*groups, "b", statistic.alias(name))


def _in_order(rows: DataFrame, groups: list[str], cluster: str, by: str, kept: list[str], order: str = "boot_by") -> DataFrame:
    """The rows with the rank of their cluster and `by` as boot_by, dealt and sorted by (group, order)."""
    clusters = ranked(rows.select(*groups, cluster).distinct(), groups, cluster).select(F.col("boot_key").alias("k"), F.col(cluster).alias("boot_cluster"), "boot_rank", "boot_n")
    keyed = rows.withColumn("boot_key", _key(groups))
    both = keyed.join(clusters, (F.col("boot_key") == F.col("k")) & F.col(cluster).eqNullSafe(F.col("boot_cluster")))
    return both.select("boot_key", "boot_n", "boot_rank", F.col(by).cast("double").alias("boot_by"), *kept).repartitionByRange("boot_key", order).sortWithinPartitions("boot_key", order)


def _stretches(batches: Iterator[pa.RecordBatch], columns: list[str], n_boot: int, seed: int) -> Iterator[tuple[str, float, np.ndarray]]:
    """(key, value, weighted sums of the columns (columns x draws)) of each different value in order."""
    counts, held = _Counts(n_boot, seed), None
    for batch in batches:
        if not batch.num_rows:
            continue
        by, ranks = batch.column("boot_by").to_numpy(), batch.column("boot_rank").to_numpy()
        values = np.column_stack([batch.column(c).to_numpy() for c in columns]).astype(np.float64)
        for key, n, places in _runs(batch):
            for k in range(0, len(places), max(1, AT_ONCE // n_boot)):
                some = places[k:k + max(1, AT_ONCE // n_boot)]
                weights, at = counts(ranks[some], n)
                edges = np.flatnonzero(np.diff(by[some], prepend=np.nan) != 0)
                for low, high in zip(edges, [*edges[1:], len(some)], strict=True):
                    x = values[some[low:high]].T @ weights[at[low:high]]
                    value = float(by[some[low]])
                    if held and held[0] == key and held[1] == value:
                        held = (key, value, held[2] + x)
                    else:
                        if held:
                            yield held
                        held = (key, value, x)
    if held:
        yield held


def _areas(n_boot: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found = TaskContext.get().partitionId(), {}
        for key, _, (pos, neg) in _stretches(batches, ["p", "q"], n_boot, seed):
            x = found.setdefault(key, np.zeros((3, n_boot)))
            x[2] += pos * (x[1] + neg / 2)
            x[0] += pos
            x[1] += neg
        for key, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * n_boot), pa.array(np.full(n_boot, part, np.int32)), pa.array(np.arange(n_boot, dtype=np.int32)), *map(pa.array, x)], ["boot_key", "part", "b", "pos", "neg", "area"])

    return run


def bootstrap_auroc(rows: DataFrame, groups: list[str] | tuple[str, ...], cluster: str, score: str = "score", label: str = "label", n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """(groups, b, auroc) of draws of whole clusters; null where a draw has one class only."""
    groups = list(groups)
    positive = (F.col(label).cast("double") > 0.5).cast("long")
    own = rows.groupBy(*groups, cluster, F.col(score).alias("boot_score")).agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("q"))
    areas = _in_order(own, groups, cluster, "boot_score", ["p", "q"]).mapInArrow(_areas(n_boot, seed), "boot_key string, part int, b int, pos double, neg double, area double")
    return _groups_of(_whole_area(areas, ["boot_key", "b"]), rows, groups)


def _whole_area(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC from the stretches (part, pos, neg, area) of sorted scores: a stretch also beats all negatives of those before it."""
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    area = F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(w), F.lit(0.0))
    return stretches.withColumn("area", area).groupBy(*keys).agg(F.try_divide(F.sum("area"), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def auroc(rows: DataFrame, groups: list[str] | tuple[str, ...], score: str = "score", label: str = "label") -> DataFrame:
    """(groups, auroc): positives are labels above 0.5, ties count half, null where one class is missing.

    Rows collapse to distinct scores, which are dealt by range; each stretch is summed in its own window.
    """
    groups = list(groups)
    positive = (F.col(label).cast("double") > 0.5).cast("long")
    by_score = rows.groupBy(*groups, F.col(score).alias("boot_score")).agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")).withColumn("boot_key", _key(groups))
    dealt = by_score.repartitionByRange("boot_key", "boot_score").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("boot_key", "part").orderBy("boot_score").rowsBetween(Window.unboundedPreceding, -1)
    area = F.col("pos") * (F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.col("neg") / 2)
    stretches = dealt.withColumn("area", area).groupBy("boot_key", "part").agg(F.sum("pos").alias("pos"), F.sum("neg").cast("double").alias("neg"), F.sum("area").alias("area"))
    return _groups_of(_whole_area(stretches, ["boot_key"]), rows, groups)


#: Rows of a group up to which its values aren't told apart by ranges; shares of the rows, from the quantile asked for, at which the ranges end.
FEW_ROWS = 1024
DISTANCES = [4.0 ** -k for k in range(1, 13)]


def _range_totals(n_boot: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by rank -> (boot_key, boot_range, b, c): how many rows of a range of values each draw has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, found = _Counts(n_boot, seed), None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for at, x in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([held] * n_boot), pa.array(np.full(n_boot, at, np.int32)), pa.array(np.arange(n_boot, dtype=np.int32)), pa.array(x)], ["boot_key", "boot_range", "b", "c"])

        for batch in batches:
            ranges, copies = batch.column("boot_range").to_numpy(), batch.column("c").to_numpy().astype(np.float64)
            for key, some, weights, at in _weighted(batch, counts):
                if key != held:
                    yield from out()
                    held, found = key, {}
                for r in np.unique(ranges[some]).tolist():
                    own = ranges[some] == r
                    found[r] = found.get(r, 0) + (copies[some][own] @ weights[at[own]]).astype(np.int64)
        yield from out()

    return run


def _weighted(batch: pa.RecordBatch, counts: _Counts) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, places in the batch, counts of their different clusters, place of each in them), by stretches of ranks."""
    if batch.num_rows:
        ranks, step = batch.column("boot_rank").to_numpy(), max(1, AT_ONCE // counts.n_boot)
        for key, n, places in _runs(batch):
            places = places[np.argsort(ranks[places], kind="stable")]
            for k in range(0, len(places), step):
                yield key, places[k:k + step], *counts(ranks[places[k:k + step]], n)


def _value_weights(n_boot: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by rank -> (boot_key, boot_range, boot_by, w): how many rows of a value each draw has, as 64-bit integers; values of a batch are added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(n_boot, seed)
        for batch in batches:
            ranges, values, copies = (batch.column(c).to_numpy() for c in ("boot_range", "boot_by", "c"))
            for key, some, weights, at in _weighted(batch, counts):
                order = np.lexsort((values[some], ranges[some]))
                some, at = some[order], at[order]
                x = (weights[at] * copies[some, None]).astype(np.int64)
                first = np.flatnonzero((np.diff(values[some], prepend=np.nan) != 0) | (np.diff(ranges[some], prepend=-1) != 0))
                x = np.add.reduceat(x, first, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(first)), pa.array(ranges[some[first]], pa.int32()), pa.array(values[some[first]]), pa.array([y.tobytes() for y in x], pa.binary())], ["boot_key", "boot_range", "boot_by", "w"])

    return run


def _order_statistics(q: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranges of values in order, each after a row of what lies before it -> (boot_key, b, value): the shares of the order statistics that lie in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = total = None
        for batch in batches:
            for key, value, w, before, of in zip(*(batch.column(c) for c in ("boot_key", "boot_by", "w", "boot_before", "boot_total")), strict=True):
                if before.is_valid:
                    low, total = before.values.to_numpy(), of.values.to_numpy()
                    at = (total - 1) * q
                    first = np.floor(at)
                    continue
                high = low + np.frombuffer(w.as_py(), np.int64)
                for end, share in ((first, 1 - (at - first)), (first + 1, at - first)):
                    b = np.flatnonzero((low <= end) & (end < high) & (share > 0))
                    if len(b):
                        yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(b)), pa.array(b.astype(np.int32)), pa.array(share[b] * value.as_py())], ["boot_key", "b", "value"])
                low = high

    return run


def bootstrap_quantile(rows: DataFrame, value: str, q: float, groups: list[str] | tuple[str, ...], cluster: str, n_boot: int = N_BOOT, seed: int = 0) -> DataFrame:
    """(groups, b, value): the quantile q by linear interpolation of each draw of whole clusters; rows without the value are left out.

    Rows lie by clusters, so that counts are made once for neighbouring ranks. A first pass counts a draw's rows in
    ranges of values, narrow ones about the quantile; a second one has the values of those ranges in which an
    order statistic of any draw lies, about the square root of the rows. Where the ranges end changes no result.
    """
    groups = list(groups)
    own = rows.where(F.col(value).isNotNull()).groupBy(*groups, cluster, F.col(value).alias("boot_value")).agg(F.count("*").alias("c"))
    by_rank = Written(_in_order(own, groups, cluster, "boot_value", ["c"], "boot_rank"), "by_rank")
    shares = sorted({min(1.0, max(0.0, q + side * x)) for x in DISTANCES for side in (-1, 1)})
    ends = by_rank.df.groupBy(F.col("boot_key").alias("k")).agg(F.count("*").alias("boot_rows"), F.percentile_approx("boot_by", shares, 1_000_000).alias("boot_ends")).where(F.col("boot_rows") > FEW_ROWS).drop("boot_rows")
    ranged = by_rank.df.join(F.broadcast(ends), F.col("boot_key") == F.col("k"), "left").withColumn("boot_range", F.coalesce(F.size(F.filter("boot_ends", lambda x: x < F.col("boot_by"))), F.lit(0)))
    ranged = Written(ranged.select("boot_key", "boot_n", "boot_rank", "boot_by", "c", F.when(F.col("boot_ends").isNull(), 0).otherwise(F.col("boot_range")).alias("boot_range")), "ranged").df
    totals = ranged.mapInArrow(_range_totals(n_boot, seed), "boot_key string, boot_range int, b int, c long")
    totals = totals.groupBy("boot_key", "boot_range", "b").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("boot_key", "b")
    before = F.coalesce(F.sum("c").over(w.orderBy("boot_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.floor((F.col("n") - 1) * F.lit(float(q)))
    within = lambda at: (at >= F.col("x")) & (at < F.col("x") + F.col("c"))
    each = totals.select("boot_key", "boot_range", "b", "c", before.alias("x"), F.sum("c").over(w).alias("n")).withColumn("has", within(first) | within(first + 1))
    in_draw_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("b", c))), lambda y: y[c])
    told = each.groupBy("boot_key", "boot_range").agg(F.max("has").alias("has"), in_draw_order("x").alias("boot_before"), in_draw_order("n").alias("boot_total")).where("has").drop("has")
    told = Written(told, "told").df
    asked = ranged.join(told.select("boot_key", "boot_range"), ["boot_key", "boot_range"], "left_semi").select("boot_key", "boot_n", "boot_rank", "boot_by", "c", "boot_range")
    weights = asked.mapInArrow(_value_weights(n_boot, seed), "boot_key string, boot_range int, boot_by double, w binary")
    both = weights.unionByName(told.withColumn("boot_by", F.lit(None).cast("double")), allowMissingColumns=True).repartition("boot_key", "boot_range").sortWithinPartitions("boot_key", "boot_range", "boot_by")  # nulls first
    found = both.select("boot_key", "boot_by", "w", "boot_before", "boot_total").mapInArrow(_order_statistics(q), "boot_key string, b int, value double")
    return _groups_of(found.groupBy("boot_key", "b").agg(F.sum("value").alias("value")), rows, groups)
