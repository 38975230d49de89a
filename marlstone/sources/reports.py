"""Runs and their reports as folders: merged rows with where they come from, and the tables of a study.

A run's folder has `rows.jsonl` (JSON lines, any number of part files), `provenance` (a line for each
configuration it was run under) and, once summed up, `summary.csv`. Rows stay distributed; tables of a row
for each method are small and go to one file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import analysis
from marlstone.operators.rows import merge_runs
from marlstone.sources import tables
from marlstone.sources.shared import Written

ROWS, PROVENANCE, SUMMARY = "rows.jsonl", "provenance", "summary.csv"
PROVENANCE_SCHEMA = "seq long, run string, config_hash string, protocol_hash string, git_commit string, config string"


class ConfigError(ValueError):
    pass


def _value(text: str) -> object:
    """A value as JSON has it, else the text itself; `null`, `true` and numbers are what they say."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def merged_config(base: dict, top: dict) -> dict:
    """`top` over `base`, sections merged in turn."""
    out = dict(base)
    for key, value in top.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged_config(out[key], value) if both else value
    return out


def configure(defaults: dict, *layers: dict, overrides: tuple[str, ...] = (), variant: str | None = None, environment: dict[str, str] | None = None) -> dict:
    """A configuration: layers over the defaults, then the overrides `a.b=value` of a variant in its `variants`, then those given; at last `${NAME}` and `${NAME:-default}` in texts are filled in."""
    out = defaults
    for layer in layers:
        out = merged_config(out, layer)
    if variant is not None:
        if variant not in out.get("variants", {}):
            raise ConfigError(f"no variant {variant!r}, but {sorted(out.get('variants', {}))}")
        overrides = (*out["variants"][variant], *overrides)
    for given in overrides:
        path, equals, text = given.partition("=")
        if not equals:
            raise ConfigError(f"{given!r} isn't of the form a.b=value")
        *sections, last = path.strip().split(".")
        top: dict = {last: _value(text)}
        for section in reversed(sections):
            top = {section: top}
        at = out
        for section in sections:
            at = at.get(section, {})
            if not isinstance(at, dict):
                raise ConfigError(f"{section!r} in {path!r} is no section")
        out = merged_config(out, top)
    return _filled(out, os.environ if environment is None else environment)


def _filled(value: object, environment) -> object:
    if isinstance(value, dict):
        return {k: _filled(v, environment) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, environment) for v in value]

    def fill(place: re.Match) -> str:
        name, given, default = place[1].partition(":-")
        if environment.get(name):
            return environment[name]
        if not given:
            raise ConfigError(f"{name} isn't set in the environment")
        return default

    return re.sub(r"\$\{([A-Za-z_]\w*(?::-[^}]*)?)\}", fill, value) if isinstance(value, str) else value


def config_hash(config: dict, without: tuple[str, ...] = ()) -> str:
    """16 hex digits of a configuration, whatever the order of its keys; fields named in `without` (`a.b`) don't count, as those that say only how a run is carried out."""
    kept = json.loads(json.dumps(config))
    for path in without:
        *sections, last = path.split(".")
        at = kept
        for section in sections:
            at = at.get(section, {})
        at.pop(last, None)
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read_jsonl(spark, f"{folder}/{PROVENANCE}", PROVENANCE_SCHEMA)


def record_run(spark: SparkSession, folder: str, config: dict, git_commit: str = "unknown", run_only: tuple[str, ...] = ()) -> bool:
    """Adds a line on how a run is carried out, and tells whether it is resumed under another configuration; the earlier lines stay. The same configuration and commit again add nothing."""
    last = provenance(spark, folder).orderBy(F.col("seq").desc()).first()
    own = config_hash(config)
    changed = last is not None and last.config_hash != own
    if last is None or changed or last.git_commit != git_commit:
        name = folder.rstrip("/").rpartition("/")[2]
        row = ((last.seq if last else 0) + 1, name, own, config_hash(config, run_only), git_commit, json.dumps(config, sort_keys=True))
        tables.append_jsonl(spark.createDataFrame([row], PROVENANCE_SCHEMA).coalesce(1), f"{folder}/{PROVENANCE}")
    return changed


def merge_folders(spark: SparkSession, sources: list[str], folder: str, allow_mixed: bool = False, schema: str = tables.RESULT_SCHEMA, n_boot: int | None = None) -> DataFrame:
    """Merges runs into a new folder and gives its summary: the rows, last success of each problem and method with later sources winning, sorted; the sources' provenance, `unknown` where one has none; the summary. A method under several protocols is an error, before anything is written."""
    if tables.exists(spark, f"{folder}/{ROWS}"):
        raise ValueError(f"{folder} has rows already")
    merged = Written(merge_runs([tables.read_jsonl(spark, f"{s}/{ROWS}", schema) for s in sources], allow_mixed=allow_mixed), "merged")
    told = None
    for k, source in enumerate(sources):
        name = source.rstrip("/").rpartition("/")[2]
        one = spark.createDataFrame([(name, k)], "run string, source_no int")
        lines = one.join(provenance(spark, source).drop("run"), how="left").withColumn("git_commit", F.coalesce("git_commit", F.lit("unknown")))
        told = lines if told is None else told.unionByName(lines)
    merged.df.orderBy("method", "problem_id").write.json(f"{folder}/{ROWS}")
    told.coalesce(1).orderBy("source_no", "seq").withColumn("seq", F.row_number().over(Window.orderBy("source_no", "seq")).cast("long")).select(*[c.split()[0] for c in PROVENANCE_SCHEMA.split(", ")]).write.json(f"{folder}/{PROVENANCE}")
    summary = Written(analysis.summary(merged.df, **({} if n_boot is None else {"n_boot": n_boot})), "summary")
    tables.write_summary(analysis.in_display_order(summary.df), f"{folder}/{SUMMARY}")
    merged.drop()
    return summary.df


def percent(c: Column, signed: bool = False, places: int = 1) -> Column:
    """A share as text; undefined ones are `n/a`."""
    return F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%{'+' if signed else ''}.{places}f", F.bround(c * 100, places)))


def main_table_text(table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The main table for reading: accuracy in percent with its interval, tokens, the difference in points with its interval and p, and the ratio of compute; empty where there is no baseline. Columns of the table in `keep` come along as they are."""
    given = lambda c: F.when(F.col("vs").isNotNull(), c).otherwise("")
    span = lambda lo, hi, signed: F.concat(F.lit("["), percent(F.col(lo), signed), F.lit(", "), percent(F.col(hi), signed), F.lit("]"))
    return table.select(*keep, "method_id", F.col("n").cast("string").alias("n"), F.concat(percent(F.col("accuracy")), F.lit("% "), span("lo", "hi", False)).alias("accuracy"), F.format_string("%.0f", F.bround("mean_tokens", 0)).alias("tokens"), F.coalesce("vs", F.lit("")).alias("vs"),
                        given(F.concat(percent(F.col("diff"), True), F.lit(" pp "), span("diff_lo", "diff_hi", True))).alias("difference"), given(F.format_string("%.3f", F.bround("p_value", 3))).alias("p"), given(F.format_string("%.2fx", F.bround("compute_ratio", 2))).alias("compute"))


def markdown_lines(table: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """(line): columns of a table as Markdown, header first, rows by `order`. For tables of a row for each method or the like: they are sorted in one task."""
    head = table.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))], "place int, line string")
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    body = table.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    return head.unionByName(body).coalesce(1).sortWithinPartitions("place").select("line")


def write_report(rows: DataFrame, folder: str, baseline: str = "sc", common: bool = False, more: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> list[str]:
    """The tables of a study in Parquet, one folder each, and the main table as Markdown; gives their names. `more` adds tables of one's own, functions of the rows."""
    kept = Written(rows, "rows")
    made: dict[str, DataFrame] = {"summary": analysis.summary(kept.df), "main_table": analysis.main_table(kept.df, baseline, common=common), "by_level": analysis.accuracy_by(analysis.math_only(kept.df), "level"),
                                  "top_compute": analysis.top_compute(analysis.with_method_id(kept.df)), "audit": analysis.audit(kept.df)}
    for name, build in (more or {}).items():
        made[name] = build(kept.df)
    for name, table in made.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    main = kept.spark.read.parquet(f"{folder}/main_table")
    text = main_table_text(main, ("method", "mean_tokens"))
    lines = markdown_lines(text, [c for c in text.columns if c not in ("method", "mean_tokens")], [analysis.method_rank(F.col("method")), F.col("method"), F.col("mean_tokens"), F.col("method_id")])
    lines.write.mode("overwrite").text(f"{folder}/main_table.md")
    kept.drop()
    return sorted(made)

