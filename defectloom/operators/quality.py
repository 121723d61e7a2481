"""Checks of features and labels; each returns rows or one row, with a status where it judges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def variance_screen(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (feature, variance, missing, status): constant, low (< 1e-6), high (> 1e6), missing (> 10 %) or ok."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    per = long.groupBy("feature").agg(F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"), F.avg(F.col("x").isNull().cast("double")).alias("missing"))
    status = F.when(F.col("missing") > 0.1, "missing").when(F.col("variance") == 0, "constant").when(F.col("variance") < 1e-6, "low").when(F.col("variance") > 1e6, "high").otherwise("ok")
    return per.withColumn("status", status)


def leakage_screen(corr: DataFrame, label: str, words: tuple[str, ...] = ("bug", "fix", "label", "risk"), limit: float = 0.9) -> DataFrame:
    """Of rows (a, b, r) with the label: features whose name or correlation gives the label away."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("a").contains(w)
    return corr.where(F.col("b") == label).select(F.col("a").alias("feature"), F.coalesce("r", F.lit(0.0)).alias("r"), F.when(hit, "name").when(F.col("r") > limit, "correlation").otherwise("ok").alias("status"))


def class_dominance(df: DataFrame, column: str, limit: float = 0.9, smallest: int = 5) -> DataFrame:
    """Counts and shares of classes, those under ``smallest`` rows together as ``other``."""
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    merged = per.groupBy(F.when(F.col("c") < smallest, "other").otherwise(F.col(column)).alias("class")).agg(F.sum("c").cast("long").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row per class
    return merged.withColumn("share", share).withColumn("dominant", F.col("share") > limit)


def prevalence_status(df: DataFrame) -> DataFrame:
    """Share of defects of each repository, banded at 5, 17, 40 and 50 %."""
    per = df.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("buggy").cast("long").alias("bugs"))
    rate = F.col("bugs") / F.col("files")
    return per.withColumn("rate", rate).withColumn("status", F.when(F.col("rate") < 0.05, "too_low").when(F.col("rate") < 0.17, "low").when(F.col("rate") <= 0.40, "good").when(F.col("rate") <= 0.50, "high").otherwise("too_high"))


def confidence_bands(df: DataFrame, c: str = "confidence") -> DataFrame:
    return df.agg(F.count_if(F.col(c) >= 0.8).alias("high"), F.count_if((F.col(c) >= 0.5) & (F.col(c) < 0.8)).alias("medium"), F.count_if(F.col(c) < 0.5).alias("low"), F.avg(c).alias("mean"))


def source_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.avg("confidence").alias("mean_confidence"))


def multi_repo_summary(df: DataFrame) -> DataFrame:
    """Totals, and the mean share of defects over repositories that have any."""
    per = df.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("buggy").alias("bugs"))
    rate = F.col("bugs") / F.col("files")
    return per.agg(F.count(F.lit(1)).alias("repos"), F.sum("files").cast("long").alias("files"), F.sum("bugs").cast("long").alias("bugs"), F.avg(F.when(rate > 0, rate)).alias("mean_rate"))


def label_audit(matched: DataFrame) -> DataFrame:
    """Files matched at each stage of label matching and their share."""
    per = matched.groupBy("stage").agg(F.count(F.lit(1)).alias("files"))
    return per.withColumn("share", F.col("files") / F.sum("files").over(Window.partitionBy()))


def impute_median_mode(df: DataFrame, numeric: list[str], text: list[str], limit: float = 0.1) -> DataFrame:
    """Fills nulls of columns that miss more than ``limit`` of their values: medians, most frequent texts, or ``unknown``."""
    stats = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_m_{c}") for c in numeric + text], *[F.median(c).alias(f"_v_{c}") for c in numeric], *[F.mode(F.col(c), True).alias(f"_v_{c}") for c in text])
    x = df.crossJoin(F.broadcast(stats))
    fill = {c: F.when(F.col(f"_m_{c}") > limit, F.coalesce(F.col(c).cast("double"), F.col(f"_v_{c}"))).otherwise(F.col(c).cast("double")) for c in numeric}
    fill |= {c: F.when(F.col(f"_m_{c}") > limit, F.coalesce(F.col(c), F.col(f"_v_{c}"), F.lit("unknown"))).otherwise(F.col(c)) for c in text}
    return x.withColumns(fill).select(*df.columns)


def repo_rank_stats(df: DataFrame) -> DataFrame:
    per = df.where("repo IS NOT NULL").groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.min("risk").alias("min_risk"), F.max("risk").alias("max_risk"), F.avg("risk").alias("mean_risk"), F.coalesce(F.stddev_samp("risk"), F.lit(0.0)).alias("std_risk"))
    return per.withColumn("variance_of_means", F.var_pop("mean_risk").over(Window.partitionBy()))  # one row per repository


def large_repo_screen(df: DataFrame, n_features: int, missing: str = "language") -> DataFrame:
    """Rows (repo, check, value, status): more than 100 files, at least 10 features, 5 to 50 % defects, at most 10 % missing."""
    per = df.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.avg("buggy").alias("rate"), F.avg(F.col(missing).isNull().cast("double")).alias("missing"))
    checks = F.array(
        F.struct(F.lit("size").alias("check"), F.col("files").cast("double").alias("value"), (F.col("files") > 100).alias("ok")),
        F.struct(F.lit("features").alias("check"), F.lit(float(n_features)).alias("value"), F.lit(n_features >= 10).alias("ok")),
        F.struct(F.lit("bug_rate").alias("check"), F.col("rate").alias("value"), F.col("rate").between(0.05, 0.5).alias("ok")),
        F.struct(F.lit("missing").alias("check"), F.col("missing").alias("value"), (F.col("missing") <= 0.1).alias("ok")),
    )
    return per.select("repo", F.explode(checks).alias("c")).select("repo", F.col("c.check").alias("check"), F.col("c.value").alias("value"), F.when(F.col("c.ok"), "pass").otherwise("fail").alias("status"))


def fold_classes(folds: DataFrame) -> DataFrame:
    """Folds by share of defects (extreme below 5 or above 95 %) and score (poor f1 below 0.3)."""
    share = F.col("n_buggy") / F.col("n_test")
    return folds.withColumn("fold_class", F.when((share < 0.05) | (share > 0.95), "extreme").when(F.col("f1") < 0.3, "poor").otherwise("good"))


def temporal_leak_check(train: DataFrame, test: DataFrame, age: str = "file_age") -> DataFrame:
    """Whether the youngest training row is at least as old as the oldest test row."""
    return train.agg(F.min(age).alias("min_train_age")).crossJoin(test.agg(F.max(age).alias("max_test_age"))).withColumn("ok", F.col("min_train_age") >= F.col("max_test_age"))
