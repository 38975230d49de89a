"""A training corpus from `documents`: quality, line dedup, near-dedup, decontamination, tokenization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.byte_bpe import stage_byte_bpe
from marlstone.llm.common import Written, doc_columns, drop_after, table
from marlstone.llm.decontaminate import stage_decontaminate
from marlstone.llm.line_dedup import stage_line_dedup
from marlstone.llm.near_dedup import stage_near_dedup
from marlstone.llm.quality import stage_quality

#: (name, function of (spark, docs, sf_dir)); each result is written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("byte_bpe", stage_byte_bpe),
]
#: The classifier, the near-duplicate components and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = doc_columns(table(spark, sf_dir, "documents")), []
    for name, stage in STAGES[:-1]:
        mark = len(Written.left)
        after = Written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_after(mark, after)
        for w in before:
            w.drop()
        docs, before = after.df, [after]
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
