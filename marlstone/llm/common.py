"""What the operators share: tables, written intermediate results, and small column helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.shared import Written, drop_after, shared_dir  # noqa: F401

#: The columns of `documents`, which every filtering stage returns.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_columns(docs: DataFrame) -> DataFrame:
    return docs.select(*DOC_COLUMNS)


def with_text(docs: DataFrame, keep: tuple[str, ...], text_col: str, name: str) -> tuple[DataFrame, str]:
    """The columns in `keep` with the text, and the text's name there: `name`, or its own if it is in `keep`, so that a text goes to Python once."""
    if text_col in keep:
        return docs.select(*keep), text_col
    return docs.select(*keep, F.col(text_col).alias(name)), name


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def give_back() -> None:
    """Gives memory that Python has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives memory back to the system after a partition, as Python workers stay for later stages."""
    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped
