"""Neighbours, ranks, synthetic rows and Tomek links against plain versions."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectloom.ml import neighbours as N
from defectloom.ml import resample as R

COLS = ["x0", "x1", "x2"]


def points(n, seed=1, copies=40, dim=3):
    rng = np.random.default_rng(seed)
    a = np.round(rng.standard_normal((n, dim)) * [1, 5, 0.2][:dim] + (rng.integers(0, 3, n) * 4)[:, None], 1)
    a[rng.choice(n, copies, replace=False)] = a[0]  # many copies of one vector
    return a


def plain_neighbours(a, ids, k):
    out = {}
    for i in range(len(a)):
        d = sum((a[:, c] - a[i, c]) ** 2 for c in range(a.shape[1]))
        best = sorted((float(d[j]), str(ids[j])) for j in range(len(a)) if j != i)[:k]
        out[ids[i]] = best
    return out


@pytest.mark.parametrize(("k", "rows"), [(5, 4096), (5, 32), (1, 16), (3, 7)])
def test_neighbours_equal_a_plain_version(spark, k, rows):
    a = points(400)
    ids = list(range(100, 500))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in zip(ids, a)], "file long, x0 double, x1 double, x2 double").repartition(5)
    got = {r["file"]: [(x["d"], x["id"]) for x in r["neighbours"]] for r in N.nearest_neighbours(df, COLS, k, rows=rows).collect()}
    assert got == plain_neighbours(a, ids, k)


def test_neighbours_of_few_rows_and_hot_vectors(spark):
    df = spark.createDataFrame([(1, 0.0, None, 0.0), (2, 0.0, 0.0, 0.0)], "file long, x0 double, x1 double, x2 double")
    got = {r["file"]: [x["id"] for x in r["neighbours"]] for r in N.nearest_neighbours(df, COLS, 5).collect()}
    assert got == {1: ["2"], 2: ["1"]}
    assert N.nearest_neighbours(df.limit(0), COLS, 5).count() == 0 and N.nearest_neighbours(df.limit(1), COLS, 5).first()["neighbours"] == []
    hot = spark.range(20_000).select(F.col("id").alias("file"), *[F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(0).cast("double").alias(c) for c in COLS])
    met = N.nearest_neighbours(hot, COLS, 3, rows=64)
    assert met.count() == 20_000 and met.where("exists(neighbours, x -> x.id = cast(file as string)) OR size(neighbours) <> 3").count() == 0
    zeros = met.where("file % 3 > 0 AND file > 10").selectExpr("transform(neighbours, x -> x.id) AS n").distinct().collect()
    assert [r["n"] for r in zeros] == [["0", "1", "10"]]


def test_hash_ranks(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(300)] + [(None, "b")], "file long, g string").repartition(4)
    got = {(r["g"], r["file"]): r["rank"] for r in N.hash_ranks(df, "file", ["g"]).collect()}
    for g in ("a", None):
        mine = sorted((i for i in range(300) if (i % 3 > 0) == (g == "a")), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert [got[g, i] for i in mine] == list(range(1, len(mine) + 1))
    assert got["b", None] == 1 and len(got) == 301


def plain_smote(rows, k, seed=42):
    """rows: (file, label, vector); the synthetic rows as (base, copy, vector)."""
    p = [r for r in rows if r[1] == 1]
    n = [r for r in rows if r[1] != 1]
    small, large = (p, n) if len(p) < len(n) else (n, p)
    if len(small) < 2 or len(small) == len(large):
        return [], None
    near = plain_neighbours(np.array([r[2] for r in small]), [r[0] for r in small], min(k, len(small) - 1))
    vector = {str(r[0]): r[2] for r in small}
    order = sorted(small, key=lambda r: hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest())
    each, more = divmod(len(large) - len(small), len(small))
    out = []
    for i, (base, label, x) in enumerate(order):
        for copy in range(1, each + (i < more) + 1):
            h = hashlib.md5(f"{seed}:{base}:{copy}".encode()).hexdigest()
            to = vector[near[base][int(h[:8], 16) % len(near[base])][1]]
            gap = int(h[8:16], 16) / 2**32
            out.append((base, copy, [a + gap * (b - a) for a, b in zip(x, to)]))
    return out, small[0][1]


@pytest.mark.parametrize("share", [0.2, 0.45, 0.8])
def test_smote_and_tomek_links(spark, share):
    a = points(260, seed=3, copies=6)
    rng = np.random.default_rng(int(share * 10))
    y = (rng.random(260) < share).astype(int)
    rows = [(i, int(c), [float(v) for v in x]) for i, (x, c) in enumerate(zip(a, y))]
    df = spark.createDataFrame([(i, c, *x, 0.5 + i % 2, "s") for i, c, x in rows], "file long, buggy int, x0 double, x1 double, x2 double, weight double, note string").repartition(3)
    made, value = plain_smote(rows, 5)
    out = R.smote(df, COLS, weight="weight").collect()
    got = {(r["base"], r["copy"]): [r[c] for c in COLS] for r in out if r["synthetic"]}
    assert got.keys() == {(b, c) for b, c, _ in made} and all(np.allclose(got[b, c], v) for b, c, v in made)
    assert len(set(Counter(r["buggy"] for r in out).values())) == 1
    assert all(r["file"] is None and r["note"] is None and r["buggy"] == value and r["weight"] == pytest.approx(1.0) for r in out if r["synthetic"])
    assert sum(not r["synthetic"] for r in out) == 260

    every = [(f"0:{i}", c, x) for i, c, x in rows] + [(f"1:{b}:{c}", value, v) for b, c, v in made]
    near = {i: n[0][1] for i, n in plain_neighbours(np.array([r[2] for r in every]), [r[0] for r in every], 1).items()}
    label = {i: c for i, c, _ in every}
    links = {i for i in near if near[near[i]] == i and label[i] != label[near[i]]}
    assert links
    kept = R.smote_tomek(df, COLS, weight="weight").withColumn("row", R.row_id()).collect()
    assert {r["row"] for r in kept} == set(label) - links and len(kept) == len(label) - len(links)
    told = spark.createDataFrame([(i, c, *x) for i, c, x in every], "row string, buggy int, x0 double, x1 double, x2 double")
    assert {(r["row"], r["other"]) for r in R.tomek_links(told, COLS, "row").collect()} == {(i, near[i]) for i in links}


def test_classes_too_small_stay_as_they_are(spark):
    rows = [(i, int(i == 0), float(i), 0.0, 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "file long, buggy int, x0 double, x1 double, x2 double")
    assert R.smote(df, COLS).where("synthetic").count() == 0 and R.smote_tomek(df, COLS).where("synthetic").count() == 0
    even = spark.createDataFrame([(i, i % 2, float(i * 7 % 5), 0.0, 0.0) for i in range(8)], "file long, buggy int, x0 double, x1 double, x2 double")
    assert R.smote(even, COLS).where("synthetic").count() == 0
    assert R.smote(even.limit(0), COLS).count() == 0
