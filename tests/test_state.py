"""Entries that leave by the clock: the processor with a clock of the test's own, and a stream with a short life."""

import time
from types import SimpleNamespace

from defectloom.streaming import state as T


class Held:
    """A value state and timers, kept in memory."""

    def __init__(self):
        self.value, self.timers, self.ttl = None, set(), None

    def getValueState(self, name, schema, ttl):  # noqa: N802
        self.ttl = ttl
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v), clear=lambda: setattr(self, "value", None))

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def run(minutes, steps):
    """Steps are (minute, rows); the events as (minute, event, rows), with timers fired in between."""
    held, out = Held(), []
    p = T.Entries(int(minutes * 60_000))
    p.init(held)
    for minute, n in steps:
        now = int(minute * 60_000)
        for at in sorted(t for t in held.timers if t <= now):
            held.timers.discard(at)
            out += [(at / 60_000, r["event"], r["rows"]) for r in p.handleExpiredTimer(("k",), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))]
        if n:
            out += [(minute, r["event"], r["rows"]) for r in p.handleInputRows(("k",), iter(range(n)), SimpleNamespace(getCurrentProcessingTimeInMs=lambda now=now: now))]
    return out, held


def test_entries_leave_after_thirty_and_sixty_minutes():
    for life in (T.PROGRESS_MINUTES, T.RESULT_MINUTES):
        out, held = run(life, [(0, 2), (life - 1, 1), (life - 0.001, 0), (life, 0), (life + 5, 4), (2 * life, 0), (2 * life + 5, 0), (9 * life, 0)])
        assert out == [(0, "made", 2), (life - 1, "updated", 3), (life, "ended", 3), (life + 5, "made", 4), (2 * life + 5, "ended", 4)]
        assert held.value is None and not held.timers and held.ttl == 2 * life * 60_000


def test_a_late_timer_does_not_keep_an_entry():
    held, p = Held(), T.Entries(1000)
    p.init(held)
    at = lambda ms: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)
    assert [r["event"] for r in p.handleInputRows(("k",), iter([1]), at(0))] == ["made"]
    assert [r["event"] for r in p.handleInputRows(("k",), iter([1]), at(1000))] == ["ended", "made"] and held.timers == {2000}
    assert list(p.handleExpiredTimer(("k",), None, SimpleNamespace(getExpiryTimeInMs=lambda: 1000))) == []  # the old one's


def test_a_stream_of_entries(spark, tmp_path):
    source, work = f"{tmp_path}/in", f"file://{tmp_path}/work"
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "scan string")
    rows.write.parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with T.rocksdb_state(spark):
        stream = T.entries(spark.readStream.schema("scan string").parquet(source), "scan", life_minutes=0.1)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{work}/offsets").foreachBatch(lambda b, _: b.write.mode("append").parquet(f"{work}/out")).trigger(processingTime="1 second").start()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    def told(until, seconds=60):
        """What the stream wrote, once it is enough; it never rests, as timers may be due at any time."""
        end, found = time.time() + seconds, []
        while time.time() < end and not until(found):
            time.sleep(1)
            assert query.isActive
            if (tmp_path / "work/out").exists():
                found = [tuple(r) for r in spark.read.schema("key string, event string, made timestamp, rows long").parquet(f"{work}/out").select("key", "event", "rows").collect()]
        return found

    try:
        assert sorted(told(lambda x: len(x) >= 4)) == [("a", "ended", 2), ("a", "made", 2), ("b", "ended", 1), ("b", "made", 1)]
        rows.where("scan = 'a'").write.mode("append").parquet(source)
        assert told(lambda x: len(x) >= 5).count(("a", "made", 2)) == 2
    finally:
        query.stop()
