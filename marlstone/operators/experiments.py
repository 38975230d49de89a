"""Methods run over problems: generators and judges as functions of DataFrames, methods, resumable runs, pilot stages.

A generator gives sampled solutions, a judge scores of solutions; both map a DataFrame to a DataFrame,
so a run is one plan over all problems. A model is called by whoever gives such a function; here are those
that serve what is stored: samples of an earlier run, and the scores that came with them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import answers, text
from marlstone.operators import rows as result_rows
from marlstone.operators import votes
from marlstone.sources import tables
from marlstone.sources.shared import Written

Generator = Callable[[DataFrame, int, float], DataFrame]  # problems, samples, temperature -> problem_id, i, solution, answer, tokens, error; a score if there is one
Judge = Callable[[DataFrame], DataFrame]  # samples -> the samples with a score


def stored_generator(samples: DataFrame) -> Generator:
    """Serves the first n of stored samples (problem_id, i, answer, tokens; solution and score if there are any).

    A problem with fewer than n fails, as a vote of fewer would be another method; one without any does, too.
    """
    more = [c for c in ("solution", "score") if c in samples.columns]

    def generate(problems: DataFrame, n: int, temperature: float) -> DataFrame:
        wanted = samples.where(F.col("i").between(0, n - 1)).select("problem_id", "i", "answer", "tokens", *more)
        have = wanted.groupBy("problem_id").agg(F.count_distinct("i").alias("have"))
        todo = problems.select("problem_id").join(have, "problem_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
        short = todo.where(F.col("have") < n).select("problem_id", F.lit(0).alias("i"), F.concat(F.col("have").cast("string"), F.lit(f" stored samples, fewer than {n}")).alias("error"))
        full = todo.where(F.col("have") >= n).drop("have").join(wanted, "problem_id").withColumn("error", F.lit(None).cast("string"))
        return full.unionByName(short, allowMissingColumns=True).withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))

    return generate


def stored_judge(samples: DataFrame) -> DataFrame:
    """Samples that come with their scores."""
    return samples.withColumn("score", F.col("score").cast("double"))


@dataclass(frozen=True)
class Method:
    """solve: problems (problem_id, question) -> (problem_id, answer, compute_tokens, error, samples), a row for each problem."""
    name: str
    params: dict[str, str] = field(default_factory=dict)
    solve: Callable[[DataFrame], DataFrame] | None = None

    @property
    def method_id(self) -> str:
        return self.name + (f"[{','.join(f'{k}={v}' for k, v in sorted(self.params.items()))}]" if self.params else "")


_NO_SAMPLES = "array<struct<answer:string,score:double,tokens:bigint>>"


def _with_samples(drawn: DataFrame) -> DataFrame:
    """(problem_id, samples, error) of scored samples: all of a problem in order, and its first error."""
    whole = F.transform(F.array_sort(F.collect_list(F.struct("i", "answer", "score", "tokens"))), lambda x: F.struct(x["answer"].alias("answer"), x["score"].alias("score"), x["tokens"].alias("tokens")))
    return drawn.groupBy("problem_id").agg(whole.alias("samples"), F.min("error").alias("error"))


def greedy_method(generate: Generator, name: str = "cot") -> Method:
    """One solution at temperature 0."""
    def solve(problems: DataFrame) -> DataFrame:
        return generate(problems, 1, 0.0).select("problem_id", "answer", F.col("tokens").alias("compute_tokens"), "error", F.lit(None).cast(_NO_SAMPLES).alias("samples"))

    return Method(name, {}, solve)


def vote_method(generate: Generator, n: int, m: int | None = None, temperature: float = 0.7) -> Method:
    """m samples, of which the first n vote and are paid for; all are kept, so that other sizes can be read off them."""
    def solve(problems: DataFrame) -> DataFrame:
        drawn = generate(problems, m or n, temperature).withColumn("score", F.lit(None).cast("double"))
        vote = votes.majority_curve(drawn, [n]).select("problem_id", "answer", F.col("tokens").alias("compute_tokens"))
        return vote.join(_with_samples(drawn), "problem_id")

    return Method("sc", {"n": str(n)}, solve)


def best_method(generate: Generator, judge: Judge, n: int, m: int | None = None, temperature: float = 0.7) -> Method:
    """m samples, all scored; the best of the first n, the earliest among equals."""
    def solve(problems: DataFrame) -> DataFrame:
        drawn = judge(generate(problems, m or n, temperature))
        best = votes.best_of_curve(drawn, [n]).select("problem_id", "answer", F.col("tokens").alias("compute_tokens"))
        return best.join(_with_samples(drawn), "problem_id")

    return Method("bon", {"n": str(n)}, solve)


def build_methods(specs: list[str], generate: Generator | None, judge: Judge | None) -> tuple[list[Method], dict[str, str]]:
    """Methods of specs like `cot` and `sc:4/16`, and for those that can't be run the reason; an unknown one is an error."""
    made, skipped = [], {}
    for spec in specs:
        found = result_rows.parse_method(spec)
        name = found["name"]
        if name not in ("cot", "sc", "bon"):
            skipped[spec] = f"no backend for {name}"
        elif generate is None:
            skipped[spec] = "no generator"
        elif name == "bon" and judge is None:
            skipped[spec] = "no judge"
        else:
            made.append(greedy_method(generate) if name == "cot" else vote_method(generate, found["n"], found["m"]) if name == "sc" else best_method(generate, judge, found["n"], found["m"]))
    return made, skipped


def run_method(method: Method, problems: DataFrame, done: DataFrame | None = None, shard: tuple[int, int] | None = None, retry_errors: bool = False, grade: Callable[[Column, Column], Column] = answers.is_equivalent) -> DataFrame:
    """Result rows of the problems (problem_id, question, answer) of a shard that `done` has no row of this method for.

    The method doesn't see the right answers. A problem that it fails on, or gives no row for, has an error
    and counts as wrong; the others go on. With retry_errors, rows of `done` with an error don't count.
    """
    todo = problems if shard is None else result_rows.in_shard(problems, *shard)
    if done is not None:
        ids = F.coalesce(*[F.col(c) for c in ("method_id", "method") if c in done.columns])
        todo = result_rows.resume(todo, done.where(ids == method.method_id), ("problem_id",), retry_errors)
    solved = method.solve(result_rows.redact(todo))
    out = todo.select("problem_id", F.col("answer").alias("gold")).join(solved, "problem_id", "left")
    missing = F.when(F.col("compute_tokens").isNull() & F.col("error").isNull(), "no result")
    error = F.coalesce("error", missing)
    params = F.create_map(*[F.lit(x) for pair in sorted(method.params.items()) for x in pair]) if method.params else F.create_map().cast("map<string,string>")
    return out.select("problem_id", F.lit(method.name).alias("method"), F.lit(method.method_id).alias("method_id"), params.alias("params"), "gold", F.when(error.isNull(), F.col("answer")).alias("answer"),
                      (error.isNull() & F.coalesce(grade(F.col("answer"), F.col("gold")), F.lit(False))).alias("correct"), error.alias("error"), F.coalesce("compute_tokens", F.lit(0)).cast("long").alias("compute_tokens"), "samples")


def run_methods(methods: list[Method], problems: DataFrame, path: str, shard: tuple[int, int] | None = None, retry_errors: bool = False, token_cap: int | None = None, blocks: int = 8) -> tuple[DataFrame, str | None]:
    """Runs the methods one after another, each over `blocks` parts of the problems by hash, appends the rows of a part to the JSON lines at `path` when it is done, and gives the last success of each (problem, method), and why the run stopped if it did.

    Rows that are there already aren't run again. The run stops after the part that takes the tokens spent beyond
    the cap, those of earlier runs included; so a cap is exceeded by one part at most. `seq` numbers the parts written.
    """
    spark = problems.sparkSession
    if problems.groupBy("problem_id").count().where("count > 1").limit(1).count():
        raise ValueError("a problem id occurs twice")
    seq, spent = tables.read_jsonl(spark, path, ROW_FIELDS).agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.sum("compute_tokens"), F.lit(0))).first()
    stopped = None
    for method, block in ((m, k) for m in methods for k in range(blocks)):
        if token_cap is not None and spent > token_cap:
            stopped = f"{spent} tokens spent, of {token_cap}"
            break
        seq += 1
        part = problems.where(F.pmod(F.xxhash64("problem_id"), F.lit(blocks)) == block)
        new = Written(run_method(method, part, tables.read_jsonl(spark, path, ROW_FIELDS), shard, retry_errors).withColumn("seq", F.lit(seq).cast("long")), "rows")
        spent += new.df.agg(F.coalesce(F.sum("compute_tokens"), F.lit(0))).first()[0]
        tables.append_jsonl(new.df, path)
        new.drop()
    return result_rows.latest_success(tables.read_jsonl(spark, path, ROW_FIELDS), ("problem_id", "method_id")), stopped


ROW_FIELDS = f"seq long, problem_id string, method string, method_id string, params map<string,string>, gold string, answer string, correct boolean, error string, compute_tokens long, samples {_NO_SAMPLES}"


# Pilot stages.

def pilot_traces(samples: DataFrame, problems: DataFrame) -> DataFrame:
    """Each problem's first sample as a trace: its steps, their number, the answer it states and whether that is right."""
    first = samples.where("i = 0").join(problems.select("problem_id", F.col("answer").alias("gold")), "problem_id")
    told = first.withColumn("steps", answers.split_steps(F.col("solution"))).withColumn("final_answer", answers.extract_answer(F.col("solution")))
    return told.select("problem_id", "steps", F.size("steps").alias("n_steps"), "final_answer", answers.is_equivalent(F.col("final_answer"), F.col("gold")).alias("trace_correct"), "error")


def pilot_labels(prefixes: DataFrame, completions: DataFrame, gold: DataFrame) -> DataFrame:
    """Labels of prefixes (prefix_id, problem_id, steps): of those that state an answer by it, of the others by their completions (prefix_id, answer)."""
    from marlstone.operators.analysis import completion_labels, terminal_labels

    known = prefixes.join(gold.select("problem_id", F.col("answer").alias("gold")), "problem_id").withColumn("last", F.element_at("steps", -1))
    states = text.has_final_answer(F.col("last"))
    terminal = terminal_labels(known.where(states), answers.is_equivalent(answers.extract_answer(F.col("last")), F.col("gold")))
    graded = known.where(~states).select("prefix_id", "gold").join(completions, "prefix_id", "left").withColumn("right", answers.is_equivalent(F.col("answer"), F.col("gold")))
    sampled = completion_labels(graded.where("answer is not null or tokens is not null").withColumnRenamed("prefix_id", "problem_id")).withColumnRenamed("problem_id", "prefix_id").withColumn("label_source", F.lit("completions"))
    return terminal.unionByName(sampled)


def checked_scores(rows: DataFrame, score: str = "score") -> DataFrame:
    """The rows with a null score and an `error` where a score is missing, undefined or outside [0, 1]; an error that a row has stays."""
    x = F.col(score).cast("double")
    good = F.coalesce(x.between(0, 1) & ~F.isnan(x), F.lit(False))
    told = F.concat(F.lit("not a score: "), F.coalesce(F.col(score).cast("string"), F.lit("null")))
    before = [F.col("error")] if "error" in rows.columns else []
    return rows.withColumn("error", F.coalesce(*before, F.when(~good, told))).withColumn(score, F.when(good, x))


def merge_pilot(destination: DataFrame, sources: list[DataFrame], keys: tuple[str, ...], seq: str = "seq") -> DataFrame:
    """One row for each key of all runs: the last success, else the last error. Sources count in their order and the destination last; within a run the larger `seq` is later."""
    return result_rows.latest_success(result_rows.union_runs([*sources, destination]).withColumn("arrival", F.struct("run_no", seq)), keys, seq="arrival").drop("arrival", "run_no")


def prefixes_of_problems(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """The rows whose prefix (`problem#depth`) is of one of the problems."""
    owner = F.regexp_extract("prefix_id", r"^(.*)#", 1)
    return rows.join(problems.select(F.col("problem_id").alias("owner")).distinct(), owner == F.col("owner"), "left_semi")


def ledger(calls: DataFrame, groups: tuple[str, ...] = ("problem_id",)) -> DataFrame:
    """What calls cost by group: generator calls, tokens and dollars, judge calls, cache hits, tokens and dollars, and what searches did: expansions and terminal leaves in sum, depth at most. A hit costs nothing but a count."""
    told = lambda c: F.col(c) if c in calls.columns else F.lit(None)
    generator, judge = F.col("kind") == "generator", F.col("kind") == "judge"
    paid = judge & ~F.coalesce("cache_hit", F.lit(False))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    return calls.groupBy(*groups).agg(F.count_if(generator).alias("generator_calls"), total(generator, "prompt_tokens").alias("prompt_tokens"), total(generator, "completion_tokens").alias("completion_tokens"), total(generator, "usd").alias("generator_usd"),
                                      F.count_if(paid).alias("judge_calls"), F.count_if(judge & F.coalesce("cache_hit", F.lit(False))).alias("judge_cache_hits"), total(paid, "prompt_tokens").alias("judge_tokens"), total(paid, "usd").alias("judge_usd"),
                                      F.coalesce(F.sum(told("expansions")), F.lit(0)).alias("expansions"), F.coalesce(F.sum(told("terminal_leaves")), F.lit(0)).alias("terminal_leaves"), F.coalesce(F.max(told("depth")), F.lit(0)).alias("max_depth"))


#: What a smoke run has to show: problems solved at least, judge calls and dollars at most.
SMOKE_SOLVED, SMOKE_CALLS, SMOKE_USD = 1, 20, 0.01


def smoke_summary(rows: DataFrame) -> DataFrame:
    """One row of rows (correct, calls, usd): solved, calls, usd and whether the run passed."""
    out = rows.agg(F.count_if("correct").alias("solved"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    return out.withColumn("passed", (F.col("solved") >= SMOKE_SOLVED) & (F.col("calls") <= SMOKE_CALLS) & (F.col("usd") <= SMOKE_USD))
