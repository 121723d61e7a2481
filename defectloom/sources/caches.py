"""Stored results: caches keyed by head or version, expiring caches, logs, exports and models."""

from __future__ import annotations

import json
import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cache(df: DataFrame, folder: str, **keys: str) -> None:
    """Replaces the partitions of the keys, such as repo and head, and leaves others."""
    keyed = df.withColumns({k: F.lit(v) for k, v in keys.items()})
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)


def write_heads(df: DataFrame, folder: str, keys: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows of, such as those of (repo, head), and leaves others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)


def read_heads(spark: SparkSession, folder: str, heads: DataFrame, schema: str | None = None) -> DataFrame:
    """The cached rows whose keys are in ``heads``, such as every repository at its current head; other partitions stay unread."""
    cached = (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    return cached.join(heads, heads.columns, "left_semi")


def read_cache(spark: SparkSession, folder: str, **keys: str) -> DataFrame:
    """The rows of exactly these keys; other partitions are pruned. No rows where the key is stale."""
    out = spark.read.parquet(folder)
    for k, v in keys.items():
        out = out.where(F.col(k).cast("string") == v)
    return out.drop(*keys)


def fresh(df: DataFrame, column: str, now, hours: float = 24) -> DataFrame:
    """Rows at most ``hours`` older than ``now``."""
    return df.where((F.unix_micros(F.col(column).cast("timestamp")) >= F.unix_micros(now) - int(hours * 3_600_000_000)))


def last_log_line(df: DataFrame, order: str = "timestamp") -> DataFrame:
    """The row with the latest ``order``."""
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def split_subjects(lines: DataFrame, column: str = "value", mark: str = "|") -> DataFrame:
    """``hash|subject`` lines, cut at the first mark; lines without one go."""
    at = F.instr(column, mark)
    return lines.where(at > 0).select(F.expr(f"substring({column}, 1, instr({column}, '{mark}') - 1)").alias("hash"), F.expr(f"substring({column}, instr({column}, '{mark}') + 1)").alias("subject"))


def write_labelled(df: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """One folder for each repository, as csv, json or parquet."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown format {fmt}")
    writer = df.write.mode("overwrite").partitionBy("repo")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_scan(rows: DataFrame, insights: DataFrame, document: DataFrame, folder: str) -> None:
    """A scan's exports: the table and its blocks as CSV, the document as JSON text, the files as JSON lines beside it."""
    write_csv(rows, f"{folder}/files_csv")
    insights.coalesce(1).sortWithinPartitions("section", "position").write.mode("overwrite").option("header", "true").csv(f"{folder}/insights_csv")
    write_json(rows, f"{folder}/detailed_files")
    document.coalesce(1).write.mode("overwrite").text(f"{folder}/document")


def write_benchmarks(full: DataFrame, reliable: DataFrame, folder: str) -> None:
    """One JSON document of two one-row summaries, of all folds and of the reliable ones, with the time."""
    one = full.select(F.struct(*full.columns).alias("full")).crossJoin(reliable.select(F.struct(*reliable.columns).alias("reliable")))
    one.withColumn("timestamp", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(folder)


def write_labels_json(labels: DataFrame, repo: str, folder: str) -> None:
    """Labels (path, is_buggy, confidence, source): a JSON summary with counts by source, and the labels as JSON lines beside it."""
    by = labels.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("source_breakdown"))
    total = labels.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("is_buggy")).alias("buggy_files"))
    total.crossJoin(by).select(F.lit(repo).alias("repo_path"), F.current_timestamp().alias("timestamp"), "total_files", "buggy_files", "source_breakdown").coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
    write_json(labels, f"{folder}/labels")


def clear_caches(spark: SparkSession, folders: list[str]) -> list[str]:
    """Deletes what lies in the cache folders, which stay, and returns the names of what went; folders that are not there are passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            for status in fs.listStatus(path):
                if fs.delete(status.getPath(), True):
                    gone.append(f"{path.getName()}/{status.getPath().getName()}")
    return sorted(gone)


def save_model(spark: SparkSession, model: PipelineModel, folder: str, stats: DataFrame, features: list[str], version: str | None = None) -> str:
    """Model, training statistics and a manifest under a version, and a line in the log; returns the version."""
    version = version or time.strftime("v%Y%m%d%H%M%S", time.gmtime())
    model.write().overwrite().save(f"{folder}/{version}/model")
    stats.write.mode("overwrite").parquet(f"{folder}/{version}/stats")
    line = json.dumps({"version": version, "features": features, "timestamp": time.time()})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{folder}/log")
    return version


def load_model(spark: SparkSession, folder: str, version: str | None = None) -> tuple[PipelineModel, DataFrame, dict]:
    """The given or the latest version: model, statistics, manifest."""
    log = spark.read.json(f"{folder}/log")
    row = last_log_line(log if version is None else log.where(F.col("version") == version)).first().asDict()
    return PipelineModel.load(f"{folder}/{row['version']}/model"), spark.read.parquet(f"{folder}/{row['version']}/stats"), row
