"""Edge cases of operators on literal rows: ties, nulls, zero divisors, empty tables."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from defectloom.functions import paths as P
from defectloom.functions import text as X
from defectloom.operators import features as FT
from defectloom.operators import history as H
from defectloom.operators import labels as L
from defectloom.operators import metrics as M
from defectloom.operators import ranking as R
from defectloom.operators import risk as K

CF = "repo string, commit_id long, author string, commit_time timestamp, file long, added long, deleted long, is_fix int"
T0 = datetime(2024, 1, 1)


def commits(spark, rows):
    return spark.createDataFrame([("r", i, a, T0 + timedelta(days=t), f, 1, 0, fix) for i, a, t, f, fix in rows], CF)


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_commit_confidence(spark):
    said = column(spark, ["Fix null deref", "fix typo", "crash on start", "prefix handling", "specific fix", "", None, "\n Fix\nrefactor"], X.commit_confidence)
    assert said == [1.0, 0.0, 1.0, 0.7, 0.0, 0.0, 0.0, 0.7]


def test_issue_refs_and_types(spark):
    assert column(spark, ["fixes #12 and #3 #12", "closes https://github.com/a/b/issues/7", None], X.issue_refs) == [[3, 12], [7], None]
    words = {"one": ("leak", "memory"), "two": ("memory", "race"), "three": ("race",)}
    assert column(spark, ["memory", "race", "memoryless", "Memory race leak", None], lambda c: X.bug_type(c, words)) == ["one", "two", None, "one", None]


def test_paths(spark):
    assert column(spark, ["./Src\\A.py", "/x/", None], P.norm_path) == ["src/a.py", "x", ""]
    assert column(spark, ["src/app/a/b/c.py", "lib/x.py"], P.clean_path) == ["b/c.py", "x.py"]
    assert column(spark, ["a.py", "b.JSX", "c", ".py", "d.min.js"], P.file_language) == ["py", "jsx", None, None, "js"]
    assert column(spark, ["tests/y.py", "src/x.py", "scripts/z.py", "x.py", "src/test/a.py"], P.dir_class) == ["excluded", "core", "conditional", "other", "excluded"]
    assert column(spark, ["_x.py", "__init__.py", "test_a.py", "a.lock", "a.py", "LICENSE"], P.exclude_pattern) == [True, False, True, True, False, True]
    assert column(spark, ["a/test/b.py", "test/b.py", "latest.py", "x_mock.py", "a.spec.ts"], P.is_test_file) == [True, True, False, True, True]
    assert column(spark, ["https://h.com/o/r.git", "git@h.com:o/r.git", "x"], P.owner_repo) == ["o/r", "o/r", None]
    files = spark.createDataFrame([("/w/acme", "x.py"), ("/w/acme", "tests/y.py")], "repo string, path string")
    assert [r[0] for r in files.select(P.dir_class(F.concat_ws("/", "repo", "path"), F.lit("acme"))).collect()] == ["core", "excluded"]


def test_recent_windows(spark):
    got = H.recent_windows(commits(spark, [(i, "a", 100 - d, 1, 0) for i, d in enumerate((0, 13, 14, 29, 30, 89, 90))])).first()
    assert (got["commits_2w"], got["commits_1m"], got["commits_3m"]) == (2, 4, 6)


def test_ownership(spark):
    rows = [(i, "a", i, 1, 0) for i in range(4)] + [(10 + i, "a", i, 2, 0) for i in range(5)] + [(20, None, 0, 3, 0), (21, " ", 0, 3, 0)]
    got = {r["file"]: r for r in H.author_stats(commits(spark, rows)).collect()}
    assert (got[1]["ownership"], got[1]["low_history_flag"]) == (0.0, 1)
    assert (got[2]["ownership"], got[2]["low_history_flag"]) == (1.0, 0)
    assert got[3]["author_count"] == 1


def test_burst(spark):
    rows = [(1, "a", 0, 1, 0), (2, "a", 5, 1, 0)] + [(3 + i, "a", 0, 2, 0) for i in range(3)] + [(10 + i, "a", t, 3, 0) for i, t in enumerate((0, 0, 10))] + [(20 + i, "a", t, 4, 0) for i, t in enumerate((0, 10, 20))]
    got = {r["file"]: r for r in H.commit_burst(commits(spark, rows)).collect()}
    assert got[1]["commit_burst_score"] == 0 and got[2]["commit_burst_score"] == 0
    assert got[3]["commit_burst_score"] == 5 and got[3]["recent_commit_burst"] == 1
    assert got[4]["commit_burst_score"] == pytest.approx(math.log1p(10 / 10.00001)) and got[4]["recent_commit_burst"] == 0


def test_co_change_bounds_and_order(spark):
    sizes = {1: 1, 2: 2, 3: 30, 4: 31}
    cf = commits(spark, [(c, "a", 0, 100 * c + f, 0) for c, n in sizes.items() for f in range(n)])
    pairs = H.co_change(cf)
    assert pairs.count() == 2 + 30 * 29
    assert pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), "n"), ["src", "dst", "n"]).count() == pairs.count()
    # A seen before B, A newer than B; then the mirror case
    a = commits(spark, [(1, "x", 0, 1, 0), (2, "x", 1, 1, 0), (2, "x", 1, 2, 0), (3, "x", 5, 1, 0)])
    b = commits(spark, [(1, "x", 0, 2, 0), (2, "x", 1, 1, 0), (2, "x", 1, 2, 0), (3, "x", 5, 1, 0)])
    flag = lambda cf, strict: {r["file"]: r["coupled_recent_missing"] for r in H.coupling(cf, strict_order=strict).collect()}[1]
    assert (flag(a, True), flag(b, True), flag(a, False), flag(b, False)) == (1, 0, 1, 1)


def scores(spark, values, repo="r"):
    return spark.createDataFrame([(repo, i, float(v), 0) for i, v in enumerate(values)], "repo string, file long, risk double, buggy int")


def test_tiers(spark):
    for n, sizes in ((47, (5, 7, 12, 23)), (10, (1, 2, 2, 5)), (1, (1, 0, 0, 0))):
        tiers = [r["risk_tier"] for r in R.tier_by_repo_rank(scores(spark, range(n))).collect()]
        assert tuple(tiers.count(t) for t in ("CRITICAL", "HIGH", "MODERATE", "LOW")) == sizes
    same = R.tier_by_percentile(scores(spark, [0.5] * 6)).collect()
    assert {(r["risk_tier"], r["risky"]) for r in same} == {("CRITICAL", 1)}
    assert R.tier_by_percentile(scores(spark, [])).count() == 0


def test_running_by_risk_equals_a_plain_pass(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.random(300), 2).tolist() + [0.0, 1.0]
    got = R.running_by_risk(scores(spark, values), {"s": F.col("file")}, buckets=16).toPandas().sort_values("position")
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))
    assert got["file"].tolist() == order and got["s"].tolist() == np.cumsum(order).tolist() and got["position"].tolist() == list(range(1, len(values) + 1))


def test_budgets(spark):
    x = spark.createDataFrame([(i, 1.0 - i / 10, 10, 1.0 - i / 10) for i in range(10)], "file long, risk double, loc long, effort_priority double")
    assert R.within_budget(x, "loc", 0.25).count() == 3  # the row that crosses is in
    assert R.budgeted_topn(x, 5, None).count() == 5 and R.budgeted_topn(x, 5, 15).count() == 2


def test_histograms(spark):
    s = scores(spark, [0.0, 0.05, 1.0])
    bins = {v: {r["bin"]: r["files"] for r in M.risk_histogram(s, v).collect() if r["files"]} for v in ("right", "left", "clamped")}
    assert bins == {"right": {0: 1, 19: 1}, "left": {0: 2}, "clamped": {0: 1, 1: 1, 19: 1}}


def labelled(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    risk = np.round(rng.random(n), 2)
    return pd.DataFrame({"file": range(n), "risk": risk, "buggy": (rng.random(n) < risk).astype("int32")})


def test_metrics_equal_plain_versions(spark):
    p = labelled(spark)
    df = spark.createDataFrame(p)
    pos, neg = p[p.buggy == 1].risk.to_numpy(), p[p.buggy == 0].risk.to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, before = 0.0, 0.0
    for t in sorted(set(p.risk), reverse=True):
        at = p[p.risk >= t]
        recall = at.buggy.sum() / len(pos)
        ap, before = ap + (recall - before) * at.buggy.mean(), recall
    assert M.roc_auc(df).first()[0] == pytest.approx(auc) and M.pr_auc(df).first()[0] == pytest.approx(ap)
    r = M.recall_at_k_rank(df).first()
    top = p.sort_values(["risk", "file"], ascending=[False, True]).head(40)
    assert r["recall"] == pytest.approx(top.buggy.sum() / len(pos)) and r["recall"] <= r["theoretical_max"]
    t = p.risk.quantile(0.8)
    assert M.recall_at_k_threshold(df).first()["recall"] == pytest.approx(p[p.risk >= t].buggy.sum() / len(pos))
    ranks = R.average_rank(df.withColumn("g", F.lit(1)), ["g"], "risk", "x").toPandas().sort_values("file")["x"].to_numpy()
    assert ranks == pytest.approx(p.risk.rank(method="average", pct=True).to_numpy())


def test_metrics_without_defects(spark):
    s = scores(spark, [0.1, 0.9])
    assert M.pr_auc(s).first()[0] == 0 and M.roc_auc(s).first()[0] is None and M.recall_at_k_rank(s).first()["recall"] == 0
    assert M.recall_at_k_rank(scores(spark, [0.2] * 3)).first()["cut"] == 1


def change_set(spark, risks):
    return spark.createDataFrame([(1, i, 10, 1, 1.0, 0, float(r)) for i, r in enumerate(risks)], "commit_id long, file long, loc long, commits long, avg_complexity double, coupled_file_count long, risk double")


def test_commit_risk(spark):
    assert K.commit_risk(change_set(spark, [0.3])).first()["commit_risk"] == pytest.approx(0.3)
    low = K.commit_risk(change_set(spark, [0.4, 0.0, 0.0])).first()["commit_risk"]
    assert low == pytest.approx(0.6 * 0.4 + 0.4 * 0.4 / 3)
    assert K.commit_risk(change_set(spark, [0.9] + [0.0] * 9)).first()["commit_risk"] == pytest.approx(0.81)
    weights = [r["weight"] for r in K.commit_importance(change_set(spark, [0.1, 0.2])).collect()]
    assert sum(weights) == pytest.approx(1)


def test_effort(spark):
    rows = [(0.7, 500), (0.7, 501), (0.7, 2001), (0.29, 10), (0.4, 10), (0.8, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, risk double, loc long").withColumns(K.effort_metrics(F.col("risk"), F.col("loc"))).orderBy("i").collect()
    assert [r["effort_category"] for r in df] == ["HIGH_VALUE", "EFFICIENT", "EXPENSIVE", "LOW_PRIORITY", "MODERATE", "HIGH_VALUE"]
    assert df[5]["risk_per_loc"] == 0.8


def test_label_match(spark):
    files = spark.createDataFrame([("r", f, p) for f, p in enumerate(["a/b/c.py", "src/x/y.py", "d1/d2/z.py", "q/w.py"])], "repo string, file int, norm_path string")
    labels = spark.createDataFrame([("r", p, 1.0, 9) for p in ("a/b/c.py", "x/y.py", "d1/z.py", "e/z.py", "none.py")], "repo string, norm_path string, confidence double, bug_count long")
    got = {r["file"]: r for r in L.label_match(files, labels).collect()}
    assert [got[i]["stage"] for i in range(4)] == [1, 2, 5, 0]
    assert got[2]["matched"] == "d1/z.py" and got[0]["bug_score"] == 5.0
    assert (got[3]["buggy"], got[3]["confidence"], got[3]["source"]) == (0, 0.3, "clean")


def test_correlation_prune(spark):
    rng = np.random.default_rng(3)
    a = rng.random(100)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": 2 * a, "c": rng.random(100), "k": 1.0, "y": (a > 0.5).astype(int)}))
    assert FT.correlation_prune(df, ["a", "b", "c", "k"], "y") == ["a", "c"]
    assert FT.correlation_prune(df, ["a", "b", "c"], "y", keep=("b",)) == ["b", "c"]


def test_language_modes(spark):
    assert column(spark, ["py", "java", None, "python"], FT.language_id) == [10, 3, 10, 0]
    assert column(spark, ["py", "java", None], lambda c: FT.language_id(c, "name")) == [0, 3, 10]
    assert column(spark, [0, 179, 180, 365, 730, 9999], FT.age_bucket, "int") == [0, 0, 1, 2, 3, 3]
