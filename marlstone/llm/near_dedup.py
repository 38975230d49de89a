"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Sketching throws a set's elements into T bins in rounds: in round i < T each element picks its bin by a
hash of that round; in round T + b every element goes to bin b. A bin keeps its least (round, hash)
value, and rounds end once all bins are full, so every coordinate fills after at most 2T rounds and a
set of more than T log T elements needs about one pass, not T as with plain MinHash, with the same
concentration of the estimate. Two coordinates are equal with the sets' Jaccard similarity.

Documents of equal shingle sets are one class, so copies cost one row each. The classes that share a
band are not paired with each other at first. Each band has a centre, the class that meets most others
over all its bands, as the source of many copies does where copies differ more from each other; a class
is paired with the few centres that it shares most bands with. Pairs whose
sketches agree in too few coordinates to be similar by any likely chance go; the others are verified on
their full shingle sets. Verified links give components. Where a band's classes lie in several
components after that, pairs of classes from different components remain. In bands of a few classes
they are listed. In crowded bands the classes x of a centre c are written as what they lack of it (A) and
add to it (B). x is linked to c iff w(x) = 4|A| + 3|B| <= |c|, and x to y iff the two share at least
(w(x) + w(y) - |c|) / 7 elements of A and B; as one of a remaining pair isn't linked to c, that is more than
w(y) / 7 of the other's. So the two meet in a short prefix of these elements by rising frequency, of which
copies changed in different places share nothing, and a join over the prefixes finds every linked pair
without listing the others. Frequencies are counted by buckets of a bounded table that every task gets, so
elements outside the prefixes are never joined. Classes that share less than half with the centre are joined
by prefixes of their full sets, with each other and with those that aren't linked to the centre. So no link that banding can see is lost, and no group is paired with itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Written, doc_columns, table, tidy
from marlstone.llm.components import connected_components

SHINGLE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
T = BANDS * ROWS
#: Equal coordinates (of T, by 8 bits each) from which a pair is verified; at similarity 0.75 there are 96, and fewer than these come 4.7 standard deviations below.
MIN_EQUAL = 73
#: Centres that a class is verified against at first; what they leave in several components is verified pair by pair.
CENTRES = 3
#: Classes of a band up to which its remaining pairs are listed; beyond it they are found by prefixes, with the same links.
FEW = 32
#: Members of a centre that meet one copy of the centre's set.
SHARE_OF_CENTRE = 2000
#: Buckets by which the elements of crowded bands are counted; a power of two.
BUCKETS = 1 << 18
#: Ranges of buckets in which the counts of tasks are added; a power of two.
RANGES = 64
#: Bytes of a written key list up to which it is broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20

_rng = np.random.default_rng(20_240_607)
_SEEDS = _rng.integers(1, 1 << 63, 2 * T, dtype=np.uint64)
_MULTIPLY = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LENGTH = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64)
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
_ROW = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHashes()


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of SHINGLE words, A-Z lower-cased; of all its words where they are fewer; none without words."""
    words = (text or b"").lower().split()  # of bytes: lower-cases A-Z, splits at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(len(h), SHINGLE)
    size = len(h) - n + 1
    total = np.full(size, _LENGTH[n - 1], np.uint64)
    for k in range(n):
        total += h[k:k + size] * _MULTIPLY[k]
    return np.unique(_mix(total))


def sketch(elements: np.ndarray) -> np.ndarray:
    """T coordinates of a set that isn't empty."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    done = 0
    while done < 2 * T:
        rounds = np.arange(done, min(done + max(1, 2 * T // len(elements)), T if done < T else 2 * T), dtype=np.uint64)
        g = _mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        bins = g & _U(T - 1) if done < T else np.broadcast_to((rounds - _U(T))[:, None], g.shape)
        np.minimum.at(out, bins.ravel().astype(np.intp), ((g >> _U(9)) | (rounds[:, None] << _U(55))).ravel())
        done += len(rounds)
        if out.max() < np.iinfo(np.uint64).max:
            break
    return out


def bands(coordinates: np.ndarray) -> np.ndarray:
    return _mix((coordinates.reshape(BANDS, ROWS) * _ROW).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


@tidy
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, sizes, coarse, keys = [], [], [], []
        for text in batch.column("text").cast(pa.binary()):
            s = shingles(text.as_py())
            sizes.append(len(s))
            if len(s):
                c = sketch(s)
                marks.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                coarse.append((_mix(c) & _U(255)).astype(np.uint8).view(np.int8))
                keys.append(bands(c))
            else:
                marks.append(None)
                coarse.append(None)
                keys.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(coarse, pa.list_(pa.int8())), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "tk", "fp", "n", "sketch", "bands"])
    _HASHES.clear()  # workers stay for later stages


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["fp", "elements"])
    _HASHES.clear()


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _small(w: Written) -> DataFrame:
    """Broadcast if its written size is below the bound."""
    return F.broadcast(w.df) if w.bytes() <= BROADCAST_BYTES else w.df


class _Job:
    """The classes of a table and their verified links."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.rows = Written(self.docs.withColumn("tk", _text_key(F.col("text"))).mapInArrow(_signatures, f"doc_id {kind}, tk long, fp binary, n long, sketch array<byte>, bands array<long>"), "signatures")
        # of a class: its smallest id with the key of that row's text
        self.classes = Written(self.rows.df.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min_by("tk", F.col("doc_id")).alias("tk0"), F.min("tk").alias("tk1"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
                               .withColumn("tk", F.coalesce("tk0", "tk1")).drop("tk0", "tk1"), "classes")

    def band_rows(self) -> DataFrame:
        return self.classes.df.select("fp", F.explode("bands").alias("key"))

    def alike(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those whose sizes and sketches allow the similarity."""
        c = self.classes.df
        side = lambda k: c.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"))).select("a", "b")

    def sets(self, ids: DataFrame) -> Written:
        """(fp, elements) of the classes `ids` (fp); of each class one text is read."""
        wanted = Written(self.classes.df.join(ids.distinct(), "fp", "left_semi").select("rep", "tk").distinct(), "wanted")
        picked = self.docs.withColumn("tk", _text_key(F.col("text"))).alias("d").join(_small(wanted).alias("w"), (F.col("d.tk") == F.col("w.tk")) & F.col("d.doc_id").eqNullSafe(F.col("w.rep")), "left_semi")
        read = Written(picked.select("text").mapInArrow(_sets, "fp binary, elements array<long>"), "sets")
        if read.df.count() > wanted.df.count():  # repeated rows
            once = Written(read.df.groupBy("fp").agg(F.first("elements").alias("elements")), "sets")
            read.drop()
            read = once
        wanted.drop()
        return read

    def verified(self, pairs: Written) -> Written:
        """The pairs (a, b) that are linked by their full sets; only classes in a pair are read into sets."""
        sets = self.sets(pairs.df.select(F.col("a").alias("fp")).unionByName(pairs.df.select(F.col("b").alias("fp"))))
        side = lambda k: sets.df.select(F.col("fp").alias(k), F.col("elements").alias(f"e{k}"))
        both = pairs.df.join(side("b"), "b").join(side("a"), "a")
        common = F.size(F.array_intersect("ea", "eb"))
        linked = both.withColumn("common", common).where(100 * F.col("common") >= PERCENT * (F.size("ea") + F.size("eb") - F.col("common"))).select("a", "b")
        out = Written(linked, "linked")
        sets.drop()
        return out

    def met_in_prefixes(self, groups: Written) -> tuple[Written, Written]:
        """Of groups (c, x, root), x a class of the centre c: links (a, b) between classes and centres, and pairs (a, b) of different roots that hold every other linked pair of a group."""
        sets = self.sets(groups.df.select(F.col("x").alias("fp")).unionByName(groups.df.select(F.col("c").alias("fp"))))
        shares = groups.df.groupBy("c").agg(F.ceil(F.count("*") / SHARE_OF_CENTRE).cast("int").alias("shares"))
        centre = sets.df.withColumnRenamed("fp", "c").join(shares, "c").select("c", F.col("elements").alias("ec"), F.explode(F.sequence(F.lit(1), "shares")).alias("share"))
        member = groups.df.join(shares, "c").withColumn("share", F.pmod(F.xxhash64("x"), "shares").cast("int") + 1).drop("shares").join(sets.df.withColumnRenamed("fp", "x"), "x")
        lacks, adds = F.array_except("ec", "elements"), F.array_except("elements", "ec")
        near = 2 * (F.size("ec") - F.col("a")) >= F.size("ec") + F.col("b")
        told = (member.join(centre, ["c", "share"]).withColumn("lacks", lacks).withColumn("adds", adds).withColumn("a", F.size("lacks")).withColumn("b", F.size("adds"))
                .withColumn("w", 4 * F.col("a") + 3 * F.col("b")).withColumn("nc", F.size("ec")).withColumn("near", near)
                .select("c", "x", "root", "w", "nc", "near", F.size("elements").alias("n"), F.when(F.col("near"), F.concat("lacks", "adds")).alias("delta"), "elements"))
        told = Written(told, "told")
        links = Written(told.df.where("w <= nc and x <> c").select(F.greatest("x", "c").alias("a"), F.least("x", "c").alias("b")).distinct(), "linked")
        # near the centre: by what a class lacks and adds; those linked to it are in one component and needn't meet each other
        near = told.df.where("near").select("c", "x", "root", "w", "nc", F.size("delta").alias("n"), F.col("delta").alias("elements"))
        apart, held = near.where("w > nc"), near.where("w <= nc")
        own = F.floor(F.col("w") / 7) + 1
        against_linked = F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("nc")) / 7))
        of_apart, of_held = _frequencies(apart), _frequencies(held)
        found = [Written(_prefix(rows, F.col("n") - t + 1, of_apart, other, least), "prefixes")
                 for rows, t, other, least in ((apart, own, of_apart, 2), (held, own, of_apart, 1), (apart, against_linked, of_held, 1))]
        # far from it: by the full sets; by the triangle inequality no class that is linked to the centre is linked to one that shares less than half with it
        far = told.df.where("not near").select("c").distinct()
        whole = told.df.where("not near or w > nc").join(far, "c", "left_semi").select("c", "x", "root", "near", "n", "elements")
        of_far = _frequencies(whole.where("not near"))
        for side in ("not near", "near"):
            found.append(Written(_prefix(whole.where(side), F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1, of_far, of_far, 1), "prefixes"))
        loose, held, against, outer, inner = (w.df for w in found)
        met = [_meet(loose, loose, F.col("p.x") < F.col("q.x")), _meet(held, against, F.lit(True)), _meet(outer, outer, F.col("p.x") < F.col("q.x")), _meet(outer, inner, F.lit(True))]
        pairs = Written(reduce(DataFrame.unionByName, met).distinct(), "pairs")
        for w in (sets, told, *found):
            w.drop()
        return links, pairs

    def components(self) -> Written:
        shared = Written(self.band_rows().groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "shared")
        members = Written(self.band_rows().join(shared.df, "key").select("key", F.col("fp").alias("a"), "members"), "members")
        # the class that meets most others is the likeliest source of the copies in its bands
        weights = Written(members.df.groupBy("a").agg(F.sum("members").alias("weight")), "weights")
        centres = Written(members.df.join(weights.df, "a").groupBy("key").agg(F.max(F.struct("weight", F.col("a").alias("b"))).alias("centre")), "centres")
        # a class meets at most BANDS centres; those that it shares most bands with are the most similar
        met = members.df.join(centres.df, "key").select("a", "centre.b", "centre.weight").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("bands"), F.max("weight").alias("weight"))
        ranked = met.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("bands", "weight", "b")), asc=False).alias("met"))
        nearest = ranked.select("a", F.explode(F.slice("met", 1, CENTRES)).alias("c")).select("a", "c.b")
        star = Written(self.alike(nearest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "star")
        links = self.verified(star)
        found = connected_components(links.df)
        # bands whose classes lie in several components
        m = members.df.select("key", "a", "members").join(found.df.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        m = Written(m, "members")
        split = Written(m.df.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("members").alias("members")).where("low <> high").select("key", "members"), "split")
        if split.df.limit(1).count():
            c = self.classes.df.select(F.col("fp").alias("a"), "n", "sketch")
            rest = Written(m.df.drop("members").join(split.df.where(F.col("members") <= FEW), "key", "left_semi").join(c, "a"), "rest")
            x, y = rest.df.alias("x"), rest.df.alias("y")
            few = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _may_link(F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch")))
            few = few.select(F.greatest("x.a", "y.a").alias("a"), F.least("x.a", "y.a").alias("b")).distinct()
            crowded = m.df.drop("members").join(split.df.where(F.col("members") > FEW), "key", "left_semi").join(centres.df.select("key", F.col("centre.b").alias("c")), "key")
            groups = Written(crowded.select("c", F.col("a").alias("x"), "root").distinct(), "groups")
            direct, met = self.met_in_prefixes(groups)
            pairs = few.unionByName(self.alike(met.df)).distinct()
            more = Written(pairs.join(star.df, ["a", "b"], "left_anti"), "more")
            extra = self.verified(more)
            joined = connected_components(links.df.unionByName(extra.df).unionByName(direct.df))
            found.drop()
            found = joined
            for w in (rest, groups, direct, met, more, extra):
                w.drop()
        for w in (shared, weights, centres, members, star, links, m, split):
            w.drop()
        return found


def _buckets(centre: bytes, elements: np.ndarray) -> np.ndarray:
    return (_mix(elements ^ np.frombuffer(centre, np.uint64, 1)) & _U(BUCKETS - 1)).astype(np.intp)


def _elements(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column("elements")[k].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _by_range(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(range, bucket, n) of counts by bucket: a row for each range of buckets that has any."""
    bucket = np.flatnonzero(counts)
    each, first = np.unique(bucket // (BUCKETS // RANGES), return_index=True)
    ends = pa.array([*first, len(bucket)], pa.int32())
    yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts[bucket], pa.int64()))], ["range", "bucket", "n"])


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task, whatever the number of its elements at most RANGES rows."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for k, c in enumerate(batch.column("c")):
            np.add.at(counts, _buckets(c.as_py(), _elements(batch, k)), 1)
    yield from _by_range(counts)


@tidy
def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        np.add.at(counts, batch.column("bucket").flatten().to_numpy(), batch.column("n").flatten().to_numpy())
    yield from _by_range(counts)


def _frequencies(rows: DataFrame) -> Broadcast:
    """How many of the rows (c, elements) have an element, by buckets of (c, element): at least its number, more where elements share a bucket.

    A task adds up its elements, then the counts of a range of buckets are added over all tasks. At most BUCKETS counts reach the driver.
    """
    fields = "range int, bucket array<int>, n array<long>"
    got = rows.select("c", "elements").mapInArrow(_counted, fields).repartition("range").mapInArrow(_added, fields).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in zip(got["bucket"].chunks, got["n"].chunks, strict=True):
        out[bucket.flatten().to_numpy()] = n.flatten().to_numpy()
    return rows.sparkSession.sparkContext.broadcast(out)


def _prefix(rows: DataFrame, length: Column, order: Broadcast, other: Broadcast, least: int) -> DataFrame:
    """(c, x, root, e) of the first `length` elements of each row, rising by `order`, less those that fewer than `least` rows of `other` have.

    Any order of elements will do that is the same in all rows of a centre, so rough frequencies lose nothing.
    """
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.zeros(0, np.uint64)]
            for k, (c, n) in enumerate(zip(batch.column("c"), batch.column("length"), strict=True)):
                e = _elements(batch, k)
                bucket = _buckets(c.as_py(), e)
                at = np.lexsort((e, order.value[bucket]))[:max(0, n.as_py())]
                first.append(e[at[other.value[bucket[at]] >= least]])
            row = pa.array(np.repeat(np.arange(batch.num_rows), [len(e) for e in first[1:]]), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in ("c", "x", "root")), pa.array(np.concatenate(first).view(np.int64))], ["c", "x", "root", "e"])

    return rows.select("c", "x", "root", "elements", length.cast("int").alias("length")).mapInArrow(run, "c binary, x binary, root binary, e long")


def _meet(p: DataFrame, q: DataFrame, condition: Column) -> DataFrame:
    """Pairs (a, b) of different roots that have an element of a centre in both."""
    both = p.alias("p").join(q.alias("q"), (F.col("p.c") == F.col("q.c")) & (F.col("p.e") == F.col("q.e")) & (F.col("p.root") != F.col("q.root")) & condition)
    return both.select(F.greatest("p.x", "q.x").alias("a"), F.least("p.x", "q.x").alias("b"))


def _may_link(n1: Column, n2: Column, s1: Column, s2: Column) -> Column:
    sizes = 100 * F.least(n1, n2) >= PERCENT * F.greatest(n1, n2)
    equal = F.aggregate(F.zip_with(s1, s2, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda acc, v: acc + v)
    return F.when(sizes, equal >= MIN_EQUAL).otherwise(False)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text; other columns aren't read): doc_id, tk (a key of the text), n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links, kept whether the row has it. Null and
    empty texts and texts without words have no shingles and are a component of their own. Rows with a
    null doc_id take part; alone or among themselves their component_id is null and they are kept. A
    row repeated with its id stays repeated. An empty table gives no rows.
    """
    job = _Job(docs)
    found = job.components()
    roots = job.classes.df.select("fp", "rep").join(found.df.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = Written(roots, "roots")
    least = Written(roots.df.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = Written(roots.df.join(least.df, "root").select("fp", "component_id"), "named")
    for w in (found, roots, least, job.classes):
        w.drop()
    rows = job.rows.df.select("doc_id", "tk", "fp", "n").join(named.df, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "tk", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("tk")


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id."""
    docs = doc_columns(docs)
    gone = Written(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("tk").alias("gone_tk")).distinct(), "gone")
    return docs.join(_small(gone), docs["doc_id"].eqNullSafe(F.col("gone_id")) & (_text_key(docs["text"]) == F.col("gone_tk")), "left_anti")
