"""Stored results: fresh ones are read, stale ones and those of other inputs are computed again."""

from datetime import datetime, timedelta, timezone

from defectloom.sources.results import Results


def test_results_are_read_while_they_are_fresh(spark, tmp_path):
    data, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/results"
    spark.range(5).write.parquet(data)
    runs = []

    def compute():
        runs.append(1)
        return spark.read.parquet(data).selectExpr("count(*) AS n", "null AS nothing").selectExpr("n", "cast(nothing AS string) AS nothing")

    store = Results(spark, folder)
    t = datetime(2025, 1, 1, tzinfo=timezone.utc)

    def ask(seconds, question="files", **parameters):
        return store.read(question, parameters, [data], compute, now=t + timedelta(seconds=seconds)).first()["n"]

    assert [ask(0), ask(299), len(runs)] == [5, 5, 1]
    assert [ask(301), ask(600), len(runs)] == [5, 5, 2]  # after five minutes it is computed again
    assert [ask(602), len(runs)] == [5, 3]
    ask(602, tier="high")
    ask(602, question="overview")
    assert len(runs) == 5
    ask(663, question="overview")
    assert len(runs) == 6  # a minute
    spark.range(2).write.mode("append").parquet(data)
    assert [ask(610), ask(611), len(runs)] == [7, 7, 7]  # other files, at once
    # another process finds what is stored
    assert Results(spark, folder).read("files", {}, [data], compute, now=t + timedelta(seconds=620)).first()["n"] == 7 and len(runs) == 7
    assert {(r["question"], r["parameters"]) for r in store.entries().collect()} == {("files", "{}"), ("files", '{"tier": "high"}'), ("overview", "{}")}


def test_what_is_not_whole_is_not_read(spark, tmp_path):
    data, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/results"
    spark.range(3).write.parquet(data)
    store, t = Results(spark, folder), datetime(2025, 1, 1, tzinfo=timezone.utc)

    def fails():
        raise ValueError("no result")

    try:
        store.read("files", {}, [data], fails, now=t)
    except ValueError:
        pass
    place = store._place("files", {}, store.fingerprint([data]))
    spark.range(9).write.parquet(f"{place}/data-half")  # a writer that was lost before its note
    assert store.read("files", {}, [data], lambda: spark.read.parquet(data), now=t).count() == 3
    held = store.read("files", {}, [data], fails, now=t)
    again = store.read("files", {}, [data], lambda: spark.range(1), life_seconds=0, now=t + timedelta(seconds=1))
    assert (held.count(), again.count()) == (3, 1)  # a reader of the former result keeps it
    assert store.sweep(now=t + timedelta(seconds=2)) == 2 and again.count() == 1
    assert store.sweep(now=t + timedelta(hours=1)) == 1 and store.entries().count() == 0
    assert Results(spark, f"file://{tmp_path}/none").sweep() == 0
