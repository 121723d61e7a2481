"""Entries with a life: what is kept of a key leaves a fixed time after it was made, by the clock of the machines."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Minutes that the progress of a scan and its results are kept.
PROGRESS_MINUTES, RESULT_MINUTES = 30, 60

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, as timers and lives ask for."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Entries(StatefulProcessor):
    """One entry for each key: when it was made and how many rows it had since.

    A timer, set when the entry is made and never moved, ends it; the state's own
    time to live, twice as long, only sweeps up what a lost timer would leave.
    """

    def __init__(self, life_ms: int):
        self.life_ms = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "made long, rows long", 2 * self.life_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, n = timerValues.getCurrentProcessingTimeInMs(), sum(1 for _ in rows)
        event, made, before = "updated", now, 0
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and held[0] + self.life_ms > now:
            made, before = held[0], held[1]
        else:
            # one whose timer is late ends here, so that no entry outlives its time
            if held is not None:
                yield self._row(key, "ended", held[0], held[1])
                self.handle.deleteTimer(held[0] + self.life_ms)
            event = "made"
            self.handle.registerTimer(now + self.life_ms)
        self.entry.update((made, before + n))
        yield self._row(key, event, made, before + n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        held = self.entry.get() if self.entry.exists() else None
        if held is not None and held[0] + self.life_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
            yield self._row(key, "ended", held[0], held[1])

    def close(self) -> None:
        """Nothing to close."""

    def _row(self, key, event: str, made: int, rows: int) -> Row:
        return Row(key=str(key[0]), event=event, made=datetime.fromtimestamp(made / 1000, timezone.utc), rows=rows)


def entries(stream: DataFrame, key: str, life_minutes: float = PROGRESS_MINUTES) -> DataFrame:
    """Rows (key, event, made, rows) of a stream: an entry is ``made`` by a key's first row, ``updated`` by later ones, and ``ended`` ``life_minutes`` after it was made; then the key may have a new one.

    Rows that a batch brings for one key count together. State is as large as
    the keys of the last ``life_minutes``. A null key has no entry. Start the
    stream within :func:`rocksdb_state`.
    """
    rows = stream.where(stream[key].isNotNull()).select(key)
    processor = Entries(int(life_minutes * 60_000))
    return rows.groupBy(key).transformWithState(processor, "key string, event string, made timestamp, rows long", "update", "processingTime")
