"""Hot keys and deep inputs: what one value, name or commit holds must not meet in one task, and results stay those of a plain version."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.functions import text as X
from defectloom.operators import history as H
from defectloom.operators import labels as L
from defectloom.operators import metrics as M
from defectloom.operators import ranking as R
from defectloom.sources import clones, source_tree


def test_running_sums_where_half_the_rows_have_one_risk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0.0 if i % 2 else float(rng.random()), int(i % 7 == 0)) for i in range(6000)] + [(9001, None, 1), (9002, 2.0, 1)]
    df = spark.createDataFrame(rows, "file long, risk double, buggy int")
    expect, found = {}, 0
    for pos, (file, _, bug) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1):
        found += bug
        expect[file] = (pos, found)
    for most in (1_000_000, 300):
        out = R.running_by_risk(df, {"found": F.col("buggy")}, most_rows=most)
        assert {r["file"]: (r["position"], r["found"]) for r in out.collect()} == expect
    cuts = R._cuts(df, "risk", "file", 1024, 300)
    sizes = Counter()
    points = {r["_b"]: [c for block in r["cuts"] for c in block] for r in cuts.collect()}
    for file, risk, _ in rows:
        if risk == 0.0:
            sizes[sum((c["r"], c["t"]) <= (0.0, file) for c in points[1024])] += 1
    assert max(sizes.values()) < 900 and sum(sizes.values()) == 3000


def test_percentiles_closed_in(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(0, 3, 3000), np.full(2000, 0.5), [1e12, -5.0]])
    df = spark.createDataFrame([(float(v), "g" if i % 3 else "h") for i, v in enumerate(values)] + [(None, "g")], "v double, k string")
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    for most in (10, 10**6):
        assert np.allclose(R.exact_percentiles(df, "v", points, most, bands=16).first()["p"], np.quantile(values, points), rtol=1e-12)
    got = {r["k"]: r["value"] for r in M.group_percentile(df, "v", 0.9, ["k"]).collect()}
    assert got == pytest.approx({k: np.quantile([v for i, v in enumerate(values) if ("g" if i % 3 else "h") == k], 0.9) for k in "gh"})
    stats = [{r["feature"]: r.asDict() for r in M.training_stats(df, ["v"], most).collect()}["v"] for most in (10, 10**6)]
    assert all(stats[0][c] == pytest.approx(stats[1][c]) for c in ("mean", "std", "median", "p99", "p01"))


def plain_match(files, labels):
    def clean(p):
        for x in ("src/", "lib/", "app/"):
            p = p.replace(x, "")
        return "/".join(p.split("/")[-2:])

    def dirs(p):
        return set(p.rpartition("/")[0].split("/"))

    out = {}
    for i, p in files:
        ends = "/".join(p.split("/")[-2:]) if "/" in p else None
        for stage, hits in ((1, [k for k in labels if k == p]), (2, [k for k in labels if clean(k) == clean(p)]), (3, [k for k in labels if ends and k.endswith(ends)]), (5, [k for k in labels if k.rpartition("/")[2] == p.rpartition("/")[2]])):
            if hits:
                out[i] = stage, min(hits, key=lambda k: (-len(dirs(p) & dirs(k)) if stage == 5 else 0, len(k), k))  # noqa: B023
                break
        else:
            out[i] = 0, None
    return out


def test_label_match_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    parts = ["src", "lib", "webapp", "core", "ui", "a", "b"]
    path = lambda: "/".join([*rng.choice(parts, int(rng.integers(0, 4))), str(rng.choice(["x.py", "y.py", "index.js"]))])
    files = [(i, path()) for i in range(150)] + [(150, "webapp/a.py")]
    labels = sorted({path() for _ in range(40)} | {"weba.py"})
    f = spark.createDataFrame([("r", i, p) for i, p in files], "repo string, file long, norm_path string")
    k = spark.createDataFrame([("r", p, 1.0, 2) for p in labels], "repo string, norm_path string, confidence double, bug_count long")
    got = {r["file"]: (r["stage"], r["matched"]) for r in L.label_match(f, k).collect()}
    assert got == plain_match(files, labels) and got[150] == (2, "weba.py")


def test_one_file_name_in_ten_thousand_directories(spark):
    n = 10_000
    f = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("file"), F.concat(F.lit("src/d"), "id", F.lit("/index.js")).alias("norm_path"))
    k = spark.range(0, 2 * n, 2).select(F.lit("r").alias("repo"), F.concat(F.lit("src/d"), "id", F.lit("/index.js")).alias("norm_path"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("bug_count"))
    got = {r["stage"]: r["n"] for r in L.label_match(f, k).groupBy("stage").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: n // 2, 5: n // 2}


@pytest.mark.parametrize("few", [0, 1, 3, 64])
def test_nearest_labels_with_common_and_rare_directories(spark, few, monkeypatch):
    rng = np.random.default_rng(few)
    parts = ["src", "lib", "core", "ui", *(f"d{i}" for i in range(25))]
    weight = np.array([8.0, 5, 3, 2, *[0.5] * 25])

    def path():
        return "/".join([*rng.choice(parts, int(rng.integers(0, 6)), p=weight / weight.sum()), str(rng.choice(["x.py", "y.py"]))])

    files, labels = [(i, path()) for i in range(250)], sorted({path() for _ in range(90)})
    f = spark.createDataFrame([("r", i, p) for i, p in files], "repo string, file long, norm_path string")
    k = spark.createDataFrame([("r", p, 1.0, 2) for p in labels], "repo string, norm_path string, confidence double, bug_count long")
    nearest = L._nearest
    monkeypatch.setattr(L, "_nearest", lambda a, b, c: nearest(a, b, c, few))
    assert {r["file"]: (r["stage"], r["matched"]) for r in L.label_match(f, k).collect()} == plain_match(files, labels)


def test_one_label_elsewhere_costs_nothing(spark):
    import time

    n, path = 4000, lambda a: F.concat(F.lit(a), "id", F.lit("/index.js"))
    f = spark.range(n).select(F.lit("r").alias("repo"), F.col("id").alias("file"), path("src/d").alias("norm_path"))
    k = spark.range(n).select(F.lit("r").alias("repo"), path("src/e").alias("norm_path"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("bug_count"))
    other = spark.createDataFrame([("r", "web/x/index.js", 1.0, 1)], k.schema)
    seconds = []
    for labels in (k, k, k.unionByName(other)):  # the first run warms up
        began = time.perf_counter()
        got = L.label_match(f, labels).groupBy("stage", "matched").count().collect()
        seconds.append(time.perf_counter() - began)
        assert [(r["stage"], r["matched"], r["count"]) for r in got] == [(5, "src/e0/index.js", n)]
    assert seconds[2] < 2 * seconds[1] + 2


def test_one_commit_of_a_hundred_thousand_files(spark):
    vast = spark.range(100_000).select(F.lit("r").alias("repo"), F.lit(1).alias("commit_id"), F.col("id").alias("file"))
    small = spark.createDataFrame([("r", 2, 7), ("r", 2, 8), ("r", 3, 7), ("r", 3, 8), ("r", 4, 9)], "repo string, commit_id int, file long")
    assert {(r["src"], r["dst"]): r["n"] for r in H.co_change(vast.unionByName(small)).collect()} == {(7, 8): 2, (8, 7): 2}


def test_keywords_are_found_in_one_pass(spark):
    words = ["null", "null pointer", "memory leak", "leak", "c++", "pointer"]
    texts = ["A Null pointer here", "annulled", "memory leaks", "memory leak!", "c++ and null", "nullpointer", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: set(r["w"]) for r in df.select("i", X.keywords_in(F.lower(F.coalesce("t", F.lit(""))), words).alias("w")).collect()}
    assert got == {0: {"null", "null pointer", "pointer"}, 1: set(), 2: set(), 3: {"memory leak", "leak"}, 4: {"c++", "null"}, 5: set(), 6: set(), 7: set()}
    kinds = {"memory": ("null pointer", "memory leak"), "other": ("null", "leak", "c++", "pointer")}
    assert [r["b"] for r in df.orderBy("i").select(X.bug_type(F.col("t"), kinds).alias("b")).collect()] == ["memory", None, None, "memory", "other", None, None, None]


def test_sources_that_the_parser_gives_up_on():
    assert source_tree.nesting_depth("-" * 20_000 + "1") == 0 and source_tree.measure("a.py", "-" * 20_000 + "1")["functions"] == 0
    deep = "function a() {" * 3000 + "}" * 3000
    assert source_tree.measure("a.js", deep)["functions"] == 3000
    js = "function f(a, b) { if (a) { return 1 }\n}\nfunction g() { return '{' }\n"
    top = source_tree.measure("a.js", js)
    assert (top["functions"], top["max_complexity"], top["max_function_length"], top["avg_params"]) == (2, 2, 2, 1.0)


def test_trees_are_written_within_their_folder(spark, tmp_path):
    ok = spark.createDataFrame([("a/b.py", "x = 1\n"), ("c.js", None)], "path string, content string")
    assert source_tree.write_tree(ok, f"file://{tmp_path}/t") == 2 and (tmp_path / "t/a/b.py").read_text() == "x = 1\n"
    for bad in ("../x.py", "/etc/x.py", "a/../../x.py"):
        with pytest.raises(Exception, match="not a path within the tree"):
            source_tree.write_tree(spark.createDataFrame([(bad, "")], "path string, content string"), f"file://{tmp_path}/t")


def test_clones(spark, tmp_path):
    addresses = {"https://github.com/a/b.git": "ok", "http://github.com/a/b": "scheme", "https://evil.example/a/b": "host", "https://github.com/a/../b": "traversal", "https://github.com/a": "name", "git@github.com:a/b": "scheme", None: "scheme", "https://github.com@evil.example/a/b": "host"}
    df = spark.createDataFrame([(a,) for a in addresses], "a string")
    assert {r["a"]: r["v"] for r in df.select("a", clones.remote_verdict(F.col("a")).alias("v")).collect()} == addresses
    (tmp_path / "here/.git").mkdir(parents=True)
    assert clones.clone_or_local(str(tmp_path / "here"), str(tmp_path)) == (tmp_path / "here").resolve()
    for bad in ("http://github.com/a/b", "https://evil.example/a/b", "https://github.com/../b", "https://github.com/a/b/c", "nowhere"):
        with pytest.raises(ValueError, match="cloned"):
            clones.clone_or_local(bad, str(tmp_path))


def test_work_folders_are_cleared_together(spark):
    from defectloom import session as SE

    folder = SE.application_folder(spark)
    assert spark.sparkContext.applicationId in folder and SE.work_folder(spark).startswith(folder) and SE.work_folder(spark) != SE.work_folder(spark)
    kept = SE.stored(spark.range(3))
    assert kept.count() == 3
    SE.clean(spark)
    assert not (Path(folder.removeprefix("file://"))).exists() and SE.stored(spark.range(2)).count() == 2


def test_tasks_of_pairs_stay_small(spark, monkeypatch):
    from defectloom import session as SE

    rng = np.random.default_rng(8)
    rows = sorted({("r", c, int(f), c) for c in range(600) for f in rng.integers(0, 80, int(rng.integers(1, 9)))})
    cf = spark.createDataFrame(rows, "repo string, commit_id long, file long, t long").withColumn("commit_time", F.timestamp_seconds("t"))
    expect = Counter((a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2])
    plain = {strict: sorted(H.coupling(cf, strict_order=strict).collect()) for strict in (False, True)}
    monkeypatch.setattr(SE, "UNCOUNTED_BYTES", 0)
    monkeypatch.setattr(SE, "ROWS_A_TASK", 100)
    got = H.co_change(cf).withColumn("part", F.spark_partition_id()).collect()
    assert {(r["src"], r["dst"]): r["n"] for r in got} == expect
    assert max(Counter(r["part"] for r in got).values()) < 4 * 2 * 100 < len(got) / 4
    assert {strict: sorted(H.coupling(cf, strict_order=strict).collect()) for strict in (False, True)} == plain


def test_co_change_counts_orders_of_any_size(spark):
    import __spark_entry__

    d = "/root/testdata/sf0.001"
    kept = [{r[0] for r in spark.read.parquet(f"{d}/{t}.parquet").select(k).collect()} for t, k in (("orders", "o_orderkey"), ("part", "p_partkey"))]
    parts = {}
    for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        if r[0] in kept[0] and r[1] in kept[1]:
            parts.setdefault(r[0], set()).add(r[1])
    assert max(map(len, parts.values())) > 6
    expect = Counter((a, b) for files in parts.values() for a in files for b in files if a != b)
    got = __spark_entry__.queries()["co_change"](spark, d).collect()
    assert {(r["repo"], r["src"], r["dst"]): r["n"] for r in got} == {("all", *k): n for k, n in expect.items()} and len(got) == len(expect)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_co_change_of_vast_commits_by_blocks(spark, monkeypatch, kind):
    from defectloom import session as SE

    sizes = {1: 1, 2: 2, 3: 7, 4: 8, 5: 9, 6: 40, 7: 90}
    rows = [(repo, c, c // 2 + i) for repo in "rs" for c, n in sizes.items() for i in range(n)]
    cf = spark.createDataFrame(rows + rows[:50], "repo string, commit_id long, file long").withColumn("file", F.col("file").cast(kind))
    expect = Counter((a[0], a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[2] != b[2])
    if kind == "string":
        expect = {(r, str(a), str(b)): n for (r, a, b), n in expect.items()}
    monkeypatch.setattr(H, "BLOCK", 8)
    for task in (None, 100):
        if task:
            monkeypatch.setattr(SE, "UNCOUNTED_BYTES", 0)
            monkeypatch.setattr(SE, "ROWS_A_TASK", task)
        got = H.co_change(cf, 2, None).collect()
        assert {(r["repo"], r["src"], r["dst"]): r["n"] for r in got} == expect and len(got) == len(expect)
    # a task gathers pairs of blocks, never a whole commit
    sized = cf.distinct().withColumn("n", F.count("*").over(Window.partitionBy("repo", "commit_id")))
    met = H._blocks(sized, 1)[0].select(F.size("files").alias("x"), F.size("others").alias("y"), F.spark_partition_id().alias("part")).collect()
    assert max(max(r["x"], r["y"]) for r in met) < 3 * 8
    tasks = Counter()
    for r in met:
        tasks[r["part"]] += r["x"] * r["y"]
    assert max(tasks.values()) < sum(tasks.values()) / 10


@pytest.mark.parametrize("name", ["co_change", "coupling", "coupling_partner", "coupling_strict_order", "szz_inline", "file_churn"])
def test_commit_rows_dealt_by_number(spark, monkeypatch, name):
    import __spark_entry__
    from defectloom import session as SE

    run = lambda: __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    plain = Counter(run().collect())
    monkeypatch.setattr(SE, "UNCOUNTED_BYTES", 0)
    monkeypatch.setattr(SE, "ROWS_A_TASK", 500)
    df = run()
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert Counter(df.collect()) == plain
