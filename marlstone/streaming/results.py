"""Result rows as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from marlstone.operators.rows import failed


def latest_success_stream(rows: DataFrame, keys: tuple[str, ...] = ("problem_id", "method"), seq: str = "seq") -> DataFrame:
    """The last success, else the last error, of each key so far (update or complete mode)."""
    best = F.max_by(F.struct(*rows.columns), F.struct((~failed(F.col("error"))).alias("ok"), F.col(seq).alias("seq")))
    return rows.groupBy(*keys).agg(best.alias("best")).select("best.*")


def windowed_accuracy(rows: DataFrame, at: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Accuracy by method and window of event time; rows later than the watermark are left out."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, size), "method").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy")).select(F.col("window.start").alias("start"), "method", "n", "accuracy")


def append_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to a Parquet table once; a restart goes on where the checkpoint stands."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


#: The state store that keyed state needs; to be set on the session before a stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Latest(StatefulProcessor):
    """Keeps the last success, else the last error, of a key and gives it again whenever it changes."""

    def __init__(self, schema: StructType):
        self.schema, self.names = schema, schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        def rank(row: dict) -> tuple:
            return not row["error"], row["seq"]

        before = self.best.get()
        best = dict(zip(self.names, before, strict=True)) if before is not None else None
        changed = False
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for row in frame.to_dict("records"):
                if best is None or rank(row) > rank(best):
                    best, changed = row, True
        if changed:
            self.best.update(tuple(best[c] for c in self.names))
            yield pd.DataFrame([best], columns=self.names)

    def close(self) -> None:
        pass


def latest_success_state(rows: DataFrame, keys: tuple[str, ...] = ("problem_id", "method")) -> DataFrame:
    """The last success, else the last error, of each key (by `seq`, with `error`), given again whenever it changes. State is one row for each key, whatever the number of its attempts; a row that comes late or twice changes nothing."""
    return rows.groupBy(*keys).transformWithStateInPandas(_Latest(rows.schema), rows.schema, "Update", "None")


class _Ledger(StatefulProcessor):
    """Keeps what a run has spent and whether it has stopped."""

    def __init__(self, names: list[str], cap: float):
        self.names, self.cap = names, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent double, stopped boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        spent, stopped = self.spent.get() or (0.0, False)
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        total = spent + frame["usd"].cumsum()
        # a call is charged once it has been made, so the first beyond the cap still counts
        taken = (total.shift(fill_value=spent) <= self.cap) & (not stopped)
        frame = frame.assign(spent=total, charged=taken)[[*self.names, "spent", "charged"]]
        frame.loc[~taken, "spent"] = total[taken].iloc[-1] if taken.any() else spent
        if taken.any():
            spent = float(total[taken].iloc[-1])
        self.spent.update((spent, bool(stopped or spent > self.cap)))
        yield frame

    def close(self) -> None:
        pass


def running_ledger(calls: DataFrame, cap: float, run: str = "run") -> DataFrame:
    """Calls (seq, usd; no null among usd) as they come with what their run has `spent`, and whether each is `charged`: those after the one that took the sum beyond the cap aren't. Within a batch calls go by `seq`, batches as they come."""
    out = StructType([*calls.schema.fields]).add("spent", "double").add("charged", "boolean")
    return calls.groupBy(run).transformWithStateInPandas(_Ledger(calls.columns, cap), out, "Update", "None")


def resume_stream(items: DataFrame, done: DataFrame, keys: tuple[str, ...], retry_errors: bool = False) -> DataFrame:
    """The streamed items without a finished row in the table `done`, which is read anew for each batch."""
    finished = done.where(~failed(F.col("error"))) if retry_errors else done
    return items.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def upserts(rows: DataFrame, path: str, checkpoint: str, once: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Writes each batch of updates to a folder of its own, named by the batch, so that a batch that is run again after a failure replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        (once(batch, number) if once else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08}")

    return rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
