"""Models, calibration and attribution against plain versions in numpy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectloom.ml import models as ML
from defectloom.operators import features as FT
from defectloom.operators import metrics as M

COLS = ["a", "b"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 2)) * [3, 0.5] + [10, -1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 10) + 2 * x[:, 1] + 3))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, y = data
    return spark.createDataFrame([(i, f"r{i % 4}", *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "file long, repo string, a double, b double, buggy int").cache()


def test_logistic_regression_is_at_its_optimum(table, data):
    """The gradient of the weighted, penalised loss is zero at the coefficients."""
    x, y = data
    model = ML.fit(table, COLS)
    w, c = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    p = 1 / (1 + np.exp(-(z @ w + c)))
    mean = np.average(z, axis=0, weights=weight)
    spread = (weight[:, None] * (z - mean) ** 2).sum(axis=0) / (weight.sum() - 1)
    gradient = (weight * (p - y)) @ z / weight.sum() + 0.01 * w * spread
    assert np.abs(gradient).max() < 2e-3 and abs((weight * (p - y)).sum() / weight.sum()) < 2e-3
    risks = {r["file"]: r["risk"] for r in ML.score(model, table, COLS).collect()}
    assert np.allclose([risks[i] for i in range(len(y))], p, atol=1e-9)
    values = {(r["file"], r["feature"]): r["value"] for r in ML.linear_attribution(model, table, COLS).collect()}
    assert np.allclose([[values[i, f] for f in COLS] for i in range(len(y))], z * w)


def test_isotonic_equals_pool_adjacent_violators(spark, data):
    x, y = data
    risk = np.round(1 / (1 + np.exp(-(x[:, 0] - 10))), 2)
    blocks = []  # of rising risk: sum, weight, risks
    for r in np.unique(risk):
        blocks.append([y[risk == r].sum(), (risk == r).sum(), [r]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, rs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + rs]
    expect = {r: s / n for s, n, rs in blocks for r in rs}
    df = spark.createDataFrame([(i, float(r), int(c)) for i, (r, c) in enumerate(zip(risk, y))], "file long, risk double, buggy int")
    got = ML.calibrate(df)(df).collect()
    assert all(g["calibrated"] == pytest.approx(expect[g["risk"]], abs=1e-9) for g in got)


def test_calibration_sees_only_the_holdout(table):
    rest, held = ML.holdout(table)
    assert rest.count() + held.count() == 400 and 58 <= held.count() <= 62 and not set(r["file"] for r in rest.collect()) & set(r["file"] for r in held.collect())
    rates = [x.agg(F.avg("buggy")).first()[0] for x in (rest, held)]
    assert abs(rates[0] - rates[1]) < 0.02
    model, calibrated = ML.fit_calibrated(table, COLS)
    out = calibrated(ML.score(model, table, COLS).select("file", "risk", "buggy"))
    assert out.where("calibrated < 0 OR calibrated > 1").count() == 0 and out.count() == 400


def test_occlusion_equals_a_loop(table, data):
    x, _ = data
    model, means = ML.fit(table, COLS, "rf", sizes=ML.QUICK_SIZES["rf"]), {"a": 10.0, "b": -1.0}
    part = table.where("file < 20")
    got = {(r["file"], r["feature"]): r["value"] for r in ML.occlusion_attribution(model, part, COLS, means).collect()}
    base = {r["file"]: r["risk"] for r in ML.score(model, part, COLS).collect()}
    for f in COLS:
        moved = {r["file"]: r["risk"] for r in ML.score(model, part.withColumn(f, F.lit(means[f])), COLS).collect()}
        assert all(got[i, f] == pytest.approx(base[i] - moved[i]) for i in range(20))
    top = {r["file"]: r["features"] for r in ML.counterfactual(ML.occlusion_attribution(model, part, COLS, means)).collect()}
    for i in range(20):
        expect = [f for v, f in sorted((-got[i, f], f) for f in COLS) if -v > 0.005]
        assert top.get(i, []) == expect


def test_explanations_take_the_largest_features(spark):
    attributions = spark.createDataFrame([(1, "a", -0.5), (1, "b", 0.2), (1, "c", 0.9), (2, "c", 0.1)], "file long, feature string, value double")
    risks = spark.createDataFrame([(1, 0.9), (2, 0.5)], "file long, risk double")
    got = {r["file"]: r["explanation"] for r in ML.explain_text(attributions, {"a": "A", "b": "B"}, risks, n=2).collect()}
    assert got == {1: "A | B", 2: "moderate overall risk"}


def test_folds_and_the_best_architecture(table):
    folds = ML.leave_one_out(table, COLS, ("lr", "rf"), sizes=ML.QUICK_SIZES)
    rows = folds.collect()
    assert {(r["repo"], r["model"]) for r in rows} == {(f"r{i}", k) for i in range(4) for k in ("lr", "rf")} and {r["n_test"] for r in rows} == {100}
    r = rows[0]
    test = ML.score(ML.fit(table.where(F.col("repo") != r["repo"]), COLS, r["model"], sizes=ML.QUICK_SIZES[r["model"]]), table.where(F.col("repo") == r["repo"]), COLS)
    assert M.pr_auc(test.select("file", "risk", "buggy")).first()[0] == pytest.approx(r["pr_auc"])
    assert r["composite"] == pytest.approx(0.4 * r["pr_auc"] + 0.4 * r["recall_20"] + 0.2 * r["f1"])
    means = {k: np.mean([x["composite"] for x in rows if x["model"] == k]) for k in ("lr", "rf")}
    best = {x["model"]: x for x in ML.best_architecture(folds).collect()}
    assert all(best[k]["composite"] == pytest.approx(means[k]) and best[k]["best"] == (means[k] == max(means.values())) for k in means)


def test_random_search_over_time(table):
    folds = ML.time_folds(table, "file", 3)
    for a, b in folds:
        assert a.agg(F.max("file")).first()[0] < b.agg(F.min("file")).first()[0]
    assert sum(b.count() for _, b in folds) + folds[0][0].count() == 400
    best, tried = ML.random_search(table, COLS, "lr", "file", 3, 3)
    rows = tried.collect()
    assert len(rows) == 3 and {r["folds"] for r in rows} == {3} and best == json.loads(max(rows, key=lambda r: r["pr_auc"])["setting"])


def test_sizes(table):
    assert ML.classifier("rf").getNumTrees() == 300 and ML.classifier("rf").getMaxDepth() == 8 and ML.classifier("gbt").getMaxIter() == 500
    sets = FT.feature_sets(table.withColumnsRenamed({"a": "loc", "b": "commits"}))
    assert len(sets) == 8 and sets["Static+Git"] == ["loc", "commits"] and sets["All-Combined"] == ["loc", "commits"]


def test_languages_are_split_as_sets(spark):
    rng = np.random.default_rng(9)
    words = [f"lang{i:02d}" for i in range(40)]
    bad = set(rng.choice(words, 20, replace=False).tolist())
    rows = [(i, w, float(rng.standard_normal()), int((w in bad) != (rng.random() < 0.05))) for i, w in enumerate(rng.choice(words, 1200).tolist())]
    df = spark.createDataFrame(rows, "file long, language string, a double, buggy int").cache()
    sizes = {"maxIter": 1, "maxDepth": 2}
    model = ML.fit(df, ["a"], "gbt", sizes=sizes, categorical=["language"])
    first = model.stages[-1].trees[0].toDebugString
    assert "in {" in first  # a set of languages, in one split
    auc = M.roc_auc(ML.score(model, df, ["a"]).select("file", "risk", "buggy")).first()[0]
    one_hot = df.withColumns({f"is_{w}": (F.col("language") == w).cast("double") for w in words})
    columns = ["a", *[f"is_{w}" for w in words]]
    other = M.roc_auc(ML.score(ML.fit(one_hot, columns, "gbt", sizes=sizes), one_hot, columns).select("file", "risk", "buggy")).first()[0]
    assert auc > 0.9 > other + 0.1
    new = spark.createDataFrame([(1, "never seen", 0.0), (2, None, 0.0), (3, sorted(bad)[0], 0.0)], "file long, language string, a double")
    scored = {r["file"]: r["risk"] for r in ML.score(model, new, ["a"]).collect()}
    assert set(scored) == {1, 2, 3} and scored[1] == scored[2] and ML.score(model, new, ["a"]).columns == ["file", "language", "a", "risk"]
    linear = ML.fit(df, ["a"], "lr", categorical=["language"])
    assert M.roc_auc(ML.score(linear, df, ["a"]).select("file", "risk", "buggy")).first()[0] > 0.9
    with pytest.raises(ValueError):
        ML.fit(df, ["a"], "rf", categorical=["language"], most_categories=10)


def test_stratified_split_and_class_report(spark):
    rows = [(i, ["x", "y", None][i % 3] if i < 90 else "rare", f"message {i}") for i in range(94)]
    df = spark.createDataFrame(rows, "commit_id long, bug_type string, msg string").repartition(5)
    rest, held = ML.stratified_split(df, "bug_type")
    counts = {r["bug_type"]: r["count"] for r in held.groupBy("bug_type").count().collect()}
    assert counts == {"x": 6, "y": 6, None: 6} and rest.count() + held.count() == 94 and held.columns == df.columns
    assert not {r[0] for r in rest.select("commit_id").collect()} & {r[0] for r in held.select("commit_id").collect()}
    said = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", "d")], "bug_type string, predicted string")
    got = {r["bug_type"]: (r["n"], r["precision"], r["recall"], r["f1"]) for r in ML.class_report(said).collect()}
    assert got["a"] == (3, 0.5, pytest.approx(1 / 3), pytest.approx(0.4)) and got["b"] == (2, pytest.approx(2 / 3), 1.0, pytest.approx(0.8)) and got["c"] == (1, 0.0, 0.0, 0.0) and got["d"] == (0, 0.0, 0.0, 0.0)
    assert ML.class_report(said).first()["macro_f1"] == pytest.approx(1.2 / 4)


def test_text_model_on_held_out_messages(spark):
    rng = np.random.default_rng(3)
    words = {"memory": ["leak", "heap", "alloc"], "ui": ["button", "layout", "color"]}
    rows = [(i, k, " ".join([*rng.choice(words[k], 3), *rng.choice(["the", "in", "module", "issue"], 4)])) for i, k in enumerate(rng.choice(["memory", "ui"], 200, p=[0.3, 0.7]).tolist())]
    rest, held = ML.stratified_split(spark.createDataFrame(rows, "commit_id long, bug_type string, msg string"), "bug_type")
    report = ML.class_report(ML.predicted_types(ML.text_model(rest), held)).collect()
    assert {r["bug_type"] for r in report} == {"memory", "ui"} and report[0]["macro_f1"] > 0.95 and sum(r["n"] for r in report) == held.count()
    unlabelled = ML.predicted_types(ML.text_model(rest), held.drop("bug_type"))
    assert unlabelled.count() == held.count()


def test_texts_are_searched_once_and_words_counted_exactly(spark):
    from defectloom.functions import text as X

    df = spark.createDataFrame([("null here", "a"), ("leak there leak", "b"), ("leak null zebra", "b")], "msg string, bug_type string")
    plan = df.select(X.bug_type(F.col("msg"), {"m": ("leak",), "o": ("null",)}).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    # of equal counts the smaller word is first
    assert ML.text_model(df, vocabulary=4).stages[5].vocabulary == ["leak", "null", "leak leak", "leak null"]


def test_sets_share_what_folds_need(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"r{i % 3}", i, int(a + 0.3 * b > 0.4), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "repo string, file long, buggy int, a double, b double")
    sets, sizes = {"A": ["a"], "AB": ["a", "b"]}, ML.QUICK_SIZES
    expect = {}
    for name, columns in sets.items():
        for repo in ("r0", "r1", "r2"):
            scored = ML.score(ML.fit(df.where(F.col("repo") != repo), columns, "lr", sizes=sizes["lr"]), df.where(F.col("repo") == repo), columns)
            m = ML.fold_metrics(scored.select(F.lit(repo).alias("repo"), F.lit("lr").alias("model"), "file", "risk", "buggy")).first()
            expect[name, repo] = m["f1"], m["pr_auc"], m["roc_auc"], m["composite"]
    scaled = []
    monkeypatch.setattr(ML, "scale", lambda *a, f=ML.scale: scaled.append(a[2]) or f(*a))
    got = {(r["feature_set"], r["repo"]): (r["f1"], r["pr_auc"], r["roc_auc"], r["composite"]) for r in ML.ablation(df, sets, ("lr",), sizes=sizes).collect()}
    assert scaled == [["a", "b"]] and got.keys() == expect.keys()
    assert all(np.allclose(got[k], expect[k], atol=1e-9) for k in got)
