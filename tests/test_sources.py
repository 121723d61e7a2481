"""Git, source trees, caches, models and streams on small made-up inputs."""

import subprocess

import pytest
from pyspark.sql import functions as F

from defectloom.ml import models as ML
from defectloom.operators import history as H
from defectloom.sources import caches as C
from defectloom.sources import git_log, source_tree
from defectloom.streaming import incremental as S


def git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    git(path, "init", "-q")
    for i, text in enumerate(["def f(x):\n    return x\n", "def f(x):\n    if x:\n        return 1\n    return x\n"]):
        (path / "a.py").write_text(text)
        (path / f"b{i}.txt").write_text("x")
        git(path, "add", "-A")
        git(path, "commit", "-qm", ["first", "Fix crash"][i])
    return path


def test_git_log(spark, repo):
    spark.dataSource.register(git_log.GitLog)
    df = spark.read.format("git_log").option("repos", str(repo)).load()
    rows = df.orderBy("seq", "new_path").collect()
    assert [(r["seq"], r["new_path"], r["added"], r["deleted"]) for r in rows] == [(0, "a.py", 2, 0), (0, "b0.txt", 1, 0), (1, "a.py", 3, 1) if rows[2]["deleted"] else (1, "a.py", 2, 0), (1, "b1.txt", 1, 0)]
    assert {r["author"] for r in rows} == {"Ann"} and rows[2]["msg"] == "Fix crash"
    cf = df.withColumnsRenamed({"new_path": "file"}).withColumn("is_fix", F.lit(0))
    assert {r["file"]: r["commits"] for r in H.file_churn(cf).collect()} == {"a.py": 2, "b0.txt": 1, "b1.txt": 1}
    assert df.sparkSession.read.format("git_log").option("repos", str(repo)).option("since", rows[0]["commit_id"]).load().count() == 2
    assert git_log.head_hash(str(repo)) == rows[2]["commit_id"]


def test_git_blame(spark, repo):
    (repo / "a.py").write_text("def f(x):\n    if x:\n        return 2\n    return x\n")
    git(repo, "commit", "-qam", "Fix again")
    spark.dataSource.register(git_log.GitBlame)
    rows = spark.read.format("git_blame").option("repos", str(repo)).option("fixes", git_log.head_hash(str(repo))).load().collect()
    assert [(r["path"], r["intro"]) for r in rows] == [("a.py", git_log.run_git(str(repo), "rev-parse", "HEAD^").strip())]


def test_source_tree(spark, tmp_path):
    for name, text in {"app/a.py": "def f(a, b):\n    for x in a:\n        if x and b:\n            return x\n", "tests/t.py": "x", "_p.py": "x", "n.md": "x", "web/b.js": "function g(a) { if (a) { return 1 } }\n"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    root = f"file://{tmp_path}"
    assert sorted(r["rel_path"] for r in source_tree.scan_source_tree(spark, root).collect()) == ["app/a.py", "web/b.js"]
    got = {r["path"]: r for r in source_tree.scan_static_metrics(spark, root).collect()}
    a, b = got["app/a.py"], got["web/b.js"]
    assert (a["loc"], a["functions"], a["max_complexity"], a["avg_params"], a["max_nesting_depth"]) == (4, 1, 4, 2.0, 2)
    assert (b["language"], b["functions"], b["top_functions"][0]["name"], b["max_complexity"]) == ("js", 1, "g", 2)
    assert source_tree.nesting_depth("def f(:") == 0 and source_tree.nesting_depth("") == 0


def test_caches(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    for head in ("h1", "h2"):
        C.write_cache(spark.createDataFrame([(head, 1)], "x string, n int"), folder, repo="r", head_hash=head)
    assert C.read_cache(spark, folder, repo="r", head_hash="h2").collect()[0]["x"] == "h2"
    assert C.read_cache(spark, folder, repo="r", head_hash="stale").count() == 0
    C.write_cache(spark.createDataFrame([("new", 1)], "x string, n int"), folder, repo="r", head_hash="h1")
    assert sorted(r["x"] for r in spark.read.parquet(folder).collect()) == ["h2", "new"]
    rows = spark.createDataFrame([("r", 1)], "repo string, n int")
    for fmt in ("csv", "json", "parquet"):
        C.write_labelled(rows, f"{folder}-{fmt}", fmt)
        assert spark.read.format(fmt).load(f"{folder}-{fmt}").count() >= 1
    with pytest.raises(ValueError):
        C.write_labelled(rows, folder, "xml")


def test_models(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i % 3}", i, int(i % 5 == 0), float(i % 5 == 0) + i % 7 / 10, float(i % 4)) for i in range(90)], "repo string, file long, buggy int, a double, b double").cache()
    model = ML.fit(df, ["a", "b"])
    scored = ML.score(model, df, ["a", "b"], F.col("file") == 0)
    assert scored.where("file = 0").first()["risk"] == 0 and scored.where("buggy = 1 AND file > 0").agg(F.min("risk")).first()[0] > scored.where("buggy = 0").agg(F.avg("risk")).first()[0]
    folds = ML.leave_one_out(df, ["a", "b"]).collect()
    assert len(folds) == 3 and all(r["roc_auc"] > 0.9 for r in folds)
    assert ML.calibrate(scored)(scored).where("calibrated < 0 OR calibrated > 1").count() == 0
    from defectloom.operators.metrics import training_stats

    version = C.save_model(spark, model, f"file://{tmp_path}/m", training_stats(df, ["a", "b"]), ["a", "b"], "v1")
    loaded, stats, row = C.load_model(spark, f"file://{tmp_path}/m")
    assert version == row["version"] and stats.count() == 2
    again = ML.score(loaded, df, ["a", "b"])
    assert again.join(scored.select("file", F.col("risk").alias("r")), "file").where("file > 0 AND abs(risk - r) > 1e-9").count() == 0
    assert ML.rebalance(df.where("buggy = 0 OR file < 10")).count() < df.count()


def test_streams_take_only_what_is_new(spark, tmp_path):
    source, work = f"{tmp_path}/in", f"file://{tmp_path}/work"
    rows = spark.createDataFrame([(i % 4, i % 2) for i in range(8)], "event_id long, user_id long").withColumn("ts", F.current_timestamp())
    rows.write.parquet(source)
    assert S.drain(S.new_commits(S.commit_stream(spark, source)), work).count() == 4
    rows.withColumn("event_id", F.col("event_id") + 2).write.mode("append").parquet(source)
    assert S.drain(S.new_commits(S.commit_stream(spark, source)), work).count() == 6
    told = []
    listener = S.Progress(told.append)
    spark.streams.addListener(listener)
    S.drain(S.recent_commits(S.commit_stream(spark, source)), f"{work}2")
    spark.streams.removeListener(listener)
