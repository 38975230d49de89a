"""Sources and sinks: JSON lines of result rows, problem sets, stored samples, a key-value cache, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.functions.answers import extract_answer
from marlstone.functions.text import parse_level
from marlstone.operators.rows import failed, insert_if_absent, latest_success, union_runs

RESULT_SCHEMA = "problem_id string, method string, seq long, error string, correct boolean, answer string, gold string, level int, source string, subject string, params map<string,string>, compute_tokens long, completion_tokens long, usd double, wall_time double, protocol_hash string, config_hash string, timestamp string, raw string"
PROBLEM_SCHEMA = "id string, question string, answer string, source string, level int, subject string"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Rows of JSON lines; blank and unreadable lines are left out, a missing file has no rows."""
    kinds = StructType.fromDDL(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], kinds)
    parsed = F.from_json("value", StructType.fromDDL(schema + ", _corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).where("trim(value) <> ''").select(parsed.alias("r"))
    return rows.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def in_file_order(spark: SparkSession, path: str, schema: str = PROBLEM_SCHEMA) -> DataFrame:
    """Rows of JSON lines with `place`, which sorts them as they stand: by file, by the split of the file, and by place in the split.

    A split is read by one task from its first line on, so nothing is counted or sorted to know the order, and the
    first rows by `place` are the same for any number of splits and tasks. Blank and unreadable lines are left out.
    """
    kinds = StructType.fromDDL(schema)
    if not exists(spark, path):
        return spark.createDataFrame([], StructType([*kinds.fields]).add("place", StructType.fromDDL("file string, split long, line long")))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    parsed = F.from_json("value", StructType.fromDDL(schema + ", _corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = spark.read.text(path).select("value", place.alias("place")).where("trim(value) <> ''").select(parsed.alias("r"), "place")
    return rows.where("r._corrupt_record is null").select("r.*", "place").drop("_corrupt_record")


def problem_set(problems: DataFrame, name: str, n: int | None = None, levels: tuple[int, ...] | None = None, order: str = "place") -> DataFrame:
    """The problems of a set by its name: `math500`, `aime`, `aime2024` or `all`, of the levels asked for; the first n as they stand. An unknown name is an error."""
    source = F.col("source")
    known = {"all": F.lit(True), "math500": source == "math500", "math_train": source == "math_train", "aime": source.startswith("aime")}
    if name not in known and not (name.startswith("aime") and name[4:].isdigit()):
        raise ValueError(f"{name!r} is no problem set")
    out = problems.where(known.get(name, source == name))
    out = out.where(F.col("level").isin(*levels)) if levels is not None else out
    return out if n is None else out.orderBy(order).limit(n)


def first_seen(rows: DataFrame, keys: list[str], order: str, **aggregates) -> DataFrame:
    """Groups with their aggregates and `seen`, the least `order` of their rows: sorted by it, groups stand as they first came."""
    return rows.groupBy(*keys).agg(*[c.alias(k) for k, c in aggregates.items()], F.min(order).alias("seen"))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def load_runs(spark: SparkSession, paths: list[str], schema: str = RESULT_SCHEMA) -> DataFrame:
    """Runs of several folders, the last success of each problem and method, later folders winning."""
    both = union_runs([read_jsonl(spark, p, schema) for p in paths])
    return latest_success(both.withColumn("arrival", F.struct("run_no", "seq")), seq="arrival").drop("arrival", "run_no")


def successes(rows: DataFrame, order: str) -> DataFrame:
    return rows.where(~failed(F.col("error"))).orderBy(order)


def math500(rows: DataFrame) -> DataFrame:
    """From columns problem, answer, subject, level, unique_id."""
    return rows.select(F.concat(F.lit("math500/"), F.regexp_replace("unique_id", r"\.json$", "")).alias("id"), F.col("problem").alias("question"), "answer", F.lit("math500").alias("source"), parse_level(F.col("level")).alias("level"), "subject")


def math_train(rows: DataFrame, subject: str) -> DataFrame:
    """From columns problem, solution, level, type; rows whose solution has no answer go."""
    out = rows.select(F.concat(F.lit(f"math_train/{subject}/"), F.substring(F.sha1("problem"), 1, 12)).alias("id"), F.col("problem").alias("question"), extract_answer(F.col("solution")).alias("answer"), F.lit("math_train").alias("source"), parse_level(F.col("level")).alias("level"), F.coalesce("type", F.lit(subject)).alias("subject"))
    return out.where("answer is not null")


def aime(rows: DataFrame, year: int) -> DataFrame:
    """From columns idx, problem, answer and, if there is one, url, which names the exam; else numbers beyond 15 are the second exam's."""
    idx = F.col("idx").cast("int")
    exam = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"AIME_(I{1,2})(?![A-Za-z])", 1) if "url" in rows.columns else F.lit("")
    second = idx > 15
    name = F.when(exam != "", exam).when(second, "II").otherwise("I")
    number = F.when(second, idx - 15).otherwise(idx)
    return rows.select(F.format_string(f"aime{year}/%s-%02d", name, number).alias("id"), F.col("problem").alias("question"), F.col("answer").cast("string").alias("answer"), F.lit(f"aime{year}").alias("source"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("subject")).orderBy("id")


def released_after(problems: DataFrame, releases: DataFrame, cutoff: str) -> DataFrame:
    """`post_cutoff`: whether the exam's date in the small table (source, released) is after the cutoff; null where it isn't known."""
    return problems.join(F.broadcast(releases), "source", "left").withColumn("post_cutoff", F.col("released") > F.lit(cutoff).cast("date")).drop("released")


def stored_samples(rows: DataFrame) -> DataFrame:
    """(problem_id, i, solution, answer, tokens) of rows with parallel arrays solutions, answers, completion_tokens and no error."""
    zipped = F.arrays_zip("solutions", "answers", "completion_tokens")
    return rows.where(~failed(F.col("error")) & (F.size("answers") > 0)).select("problem_id", F.posexplode(zipped).alias("i", "s")).select("problem_id", "i", F.col("s.solutions").alias("solution"), F.col("s.answers").alias("answer"), F.col("s.completion_tokens").alias("tokens"))


class Cache:
    """A key-value table in Parquet. Import adds the keys that are absent and tells how many."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], "key string, value string")

    def add(self, new: DataFrame) -> int:
        fresh = insert_if_absent(self.read(), new).select("key", "value")
        before = self.read().count()
        fresh.write.mode("append").parquet(self.path)
        return self.read().count() - before


def write_scores(scores: DataFrame, path: str) -> None:
    """One folder for each judge and variant, which a reader's filters prune."""
    scores.write.mode("append").partitionBy("judge", "variant").parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def markdown(rows: list, columns: list[str]) -> str:
    """A table of collected rows: small numbers with three places, large ones with one, undefined ones `n/a`."""
    def cell(x: object) -> str:
        if x is None:
            return ""
        if isinstance(x, float):
            return "n/a" if x != x else f"{x:.3f}" if abs(x) < 10 else f"{x:,.1f}"
        return str(x)

    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows)])
