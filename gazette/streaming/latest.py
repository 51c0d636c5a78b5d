"""Keep-latest in a stream: keyed state that emits a better row, and how many rows its key has had."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Latest(StatefulProcessor):
    """State of a key: its best row so far, its number of rows and its first position. It is forgotten `forget_ms` after its
    last row, if that is given: each row moves the timer."""

    def __init__(self, keys: list[str], rest: list[str], state: T.StructType, published: str, pos: str, forget_ms: int | None):
        self.keys, self.rest, self.schema, self.published, self.pos, self.forget_ms = keys, rest, state, published, pos, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def _order(self, row) -> tuple:
        at = row[self.published]
        return (at is not None, at, -row[self.pos]) if at is not None else (False, -row[self.pos])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best, n, first = None, 0, None
        if self.held.exists():
            *values, n, first = self.held.get()
            best = dict(zip(self.rest, values, strict=True))
        for row in rows:
            row = {c: row[c] for c in self.rest}
            best = row if best is None or self._order(row) > self._order(best) else best
            first = row[self.pos] if first is None else min(first, row[self.pos])
            n += 1
        self.held.update((*(best[c] for c in self.rest), n, first))
        if self.forget_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        yield Row(**dict(zip(self.keys, key, strict=True)), **best, duplicate_count=n, first_pos=first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def keep_latest(stream: DataFrame, keys: list[str], published: str, pos: str, forget_ms: int | None = None) -> DataFrame:
    """The columns of operators.dedupe.keep_latest as a stream in update mode: each micro-batch gives, for every key that it has rows
    of, the latest row so far (null times last, then the earlier position), duplicate_count and first_pos. A key's last row is
    what keep_latest gives for all its rows, in whatever order and batches they came.

    Null keys are keys. Sets the session's state store to RocksDB, which this state needs. With forget_ms a key's state goes so
    long after its last row, by the clock; a later row then begins anew.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    # Times go through Python as numbers, which mean the same in any zone.
    timed = {f.name: f.dataType for f in stream.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) and f.name not in keys}
    coded = stream.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in timed}) if timed else stream
    rest = [c for c in coded.columns if c not in keys]
    counts = [T.StructField("duplicate_count", T.LongType()), T.StructField("first_pos", coded.schema[pos].dataType)]
    state = T.StructType([T.StructField(c, coded.schema[c].dataType) for c in rest] + counts)
    out = T.StructType([T.StructField(c, coded.schema[c].dataType) for c in [*keys, *rest]] + counts)
    processor = _Latest(keys, rest, state, published, pos, forget_ms)
    told = coded.groupBy(*[F.col(k) for k in keys]).transformWithState(processor, out, "Update", "None" if forget_ms is None else "ProcessingTime")
    return told.withColumns({c: F.timestamp_micros(c).cast(kind) for c, kind in timed.items()}) if timed else told
