"""Streaming state: conversation memory, feedback weights, progress and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Memory(StatefulProcessor):
    """The last `cap` turns of each conversation, as list state; gives the whole memory after each batch."""

    def __init__(self, cap: int = 12):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.turns.get()) if self.turns.exists() else []
        for b in rows:
            kept += list(b[["turn", "role", "text"]].sort_values("turn").itertuples(index=False, name=None))
        kept = sorted(((int(t), str(r), str(x)) for t, r, x in kept), key=lambda x: x[0])[-self.cap :]
        self.turns.put(kept)
        yield pd.DataFrame([(key[0], k + 1, *t) for k, t in enumerate(kept)], columns=["conv_id", "position", "turn", "role", "text"])

    def close(self) -> None:
        pass


MEMORY = "conv_id long, position long, turn long, role string, text string"


def conversation_memory(turns: DataFrame, cap: int = 12) -> DataFrame:
    """Streaming turns (conv_id, turn, role, text) to each conversation's memory; needs the RocksDB state store, update mode."""
    return turns.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=Memory(cap), outputStructType=MEMORY, outputMode="Update", timeMode="None")


def feedback_weights(feedback: DataFrame) -> DataFrame:
    """Running boost of each source; update mode."""
    d = F.when(F.col("rating") == "thumbs_up", 0.12).otherwise(-0.15)
    return feedback.select(F.explode("citations").alias("source_file"), d.alias("d")).groupBy("source_file").agg(F.round(F.sum("d"), 3).alias("boost"))


def progress(events: DataFrame) -> DataFrame:
    """Latest record of each session; update mode."""
    return events.groupBy("session_id").agg(F.max_by(F.struct("stage", "current", "total"), "updated_at").alias("p"), F.max("updated_at").alias("updated_at")).select("session_id", "p.*", "updated_at")


def ingest(files: DataFrame, into: str, parse: Callable[[DataFrame], DataFrame], checkpoint: str):
    """New files of a stream parsed to chunks and appended as a version per batch; a batch that is run again writes the same version."""

    def batch(df: DataFrame, n: int) -> None:
        parse(df).write.mode("overwrite").parquet(f"{into}/batch={n}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def words_of(answer: DataFrame, text: str = "text") -> DataFrame:
    """A finished answer as token events in order."""
    return answer.select(*[c for c in answer.columns if c != text], F.posexplode(F.split(text, " ")).alias("position", "token"))


class Sessions(StatefulProcessor):
    """Sessions that live a fixed time from their creation: a timer ends each, and its state goes with it."""

    def __init__(self, hours: float):
        self.ttl = int(hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "expires_ms long")

    def _out(self, key, status: str, ends: int, at: int) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]], "status": [status], "expires_ms": [ends], "at_ms": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = self.ends.get()[0] if self.ends.exists() else None
        events = sorted((int(at.value // 1_000_000), str(event)) for b in rows for at, event in zip(b["at"], b["event"], strict=True))
        for at, event in events:
            if ends is not None and at > ends:  # the end was reached between two events of one batch
                yield self._out(key, "expired", ends, ends)
                ends = self._close(ends)
            if event == "create" and ends is None:
                ends = at + self.ttl
                self.ends.update((ends,))
                self.handle.registerTimer(ends + 1)
                yield self._out(key, "active", ends, at)
            elif event == "delete" and ends is not None:
                yield self._out(key, "deleted", ends, at)
                ends = self._close(ends)

    def _close(self, ends: int) -> None:
        self.handle.deleteTimer(ends + 1)
        self.ends.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ends.exists():
            ends = self.ends.get()[0]
            self.ends.clear()
            yield self._out(key, "expired", ends, ends)

    def close(self) -> None:
        pass


def session_life(events: DataFrame, hours: float = 3.0, late: str = "0 seconds") -> DataFrame:
    """Streaming events (session_id, event: create or delete, at) to (session_id, status: active, deleted or expired, expires_ms, at_ms); append mode, RocksDB state store.

    A session ends `hours` after it was created, when the watermark has passed that moment, even if no event of its own
    comes; creating one that is alive changes nothing, and other events only move the time on.
    """
    marked = events.withWatermark("at", late)
    return marked.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Sessions(hours), outputStructType="session_id string, status string, expires_ms long, at_ms long", outputMode="Append", timeMode="EventTime")
