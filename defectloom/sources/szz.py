"""Defect labels from git repositories: fixes, the files they changed in earnest, and who wrote the lines they removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectloom.functions import paths as P
from defectloom.functions import text as T
from defectloom.operators import labels as L
from defectloom.session import stored
from defectloom.sources import git_log


def commit_rows(spark: SparkSession, repos: list[str], **options: str) -> DataFrame:
    """Every change of the repositories with diff and texts, and what the chain asks of its commit: confidence, age in days, number of files."""
    spark.dataSource.register(git_log.GitLog)
    reader = spark.read.format("git_log").options(repos=",".join(repos), diff="true", sources="true", **options)
    log = stored(reader.load())  # git is read once
    sizes = log.groupBy("repo", "commit_id").agg(F.count(F.lit(1)).alias("n_files"))
    newest = log.groupBy("repo").agg(F.max("commit_time").alias("_newest"))
    x = log.join(sizes, ["repo", "commit_id"]).join(newest, "repo")
    age = (F.unix_micros("_newest") - F.unix_micros("commit_time")) / 86_400_000_000
    return x.withColumns({"is_merge": F.lit(False), "confidence": T.commit_confidence(F.col("msg")), "age_days": age}).drop("_newest")


def szz_chain(rows: DataFrame, max_files: int = 20, window_days: float = 2555, min_confidence: float = 0.4, min_churn_ratio: float = 0.01) -> DataFrame:
    """The rows of :func:`commit_rows` with path and reason; only files that pass all else are blamed."""
    language = P.file_language(F.coalesce("old_path", "new_path"))
    real = L.substantive(F.col("added") + F.col("deleted"), F.col("source_before"), F.col("source_after"), language, F.length("diff") > 0, min_churn_ratio)
    bounds = {"max_files": max_files, "window_days": window_days, "min_confidence": min_confidence}
    judged = stored(L.szz_file_chain(rows, real, F.lit(True), **bounds))
    found = git_log.blame_lines(judged.where("reason = 'kept'")).select("repo", F.col("fix").alias("commit_id"), F.col("path").alias("old_path"), F.lit(True).alias("_blamed")).distinct()
    out = judged.join(found, ["repo", "commit_id", "old_path"], "left")
    reason = F.when((F.col("reason") == "kept") & F.col("_blamed").isNull(), "blame").otherwise(F.col("reason"))
    return out.withColumn("reason", reason).drop("_blamed")


def szz_from_git(spark: SparkSession, repos: list[str], **bounds: float) -> DataFrame:
    """Labels (repo, path, confidence, bug_count, messages) of the files that fixes changed."""
    kept = szz_chain(commit_rows(spark, repos), **bounds).where("reason = 'kept'")
    return L.szz_labels(kept, path="path")


def file_identities(changes: DataFrame) -> DataFrame:
    """``changes`` (repo, seq, old_path, new_path, change) with file_id: the path under which the file was last known, and the number of the commit that began its last life there.

    A path's life begins with the commit that adds the file or moves it there and ends with the one that
    deletes it or moves it away; a later file of the same path is another one. Lives that a move joins are
    one file. Chains of moves are followed by doubling, so a file that moved a
    thousand times takes ten rounds.
    """
    begins = changes.where(F.col("change").isin("A", "R", "C")).select("repo", F.col("new_path").alias("path"), F.col("seq").alias("begin")).distinct()
    changes = changes.withColumn("_path", F.coalesce("old_path", "new_path"))

    def life_of(rows: DataFrame, path: str, last: str, out: str) -> DataFrame:
        """The begin of the life that ``path`` has at the commit ``last`` (-1: before all commits that are known)."""
        b = begins.select("repo", F.col("path").alias(path), F.col("begin").alias("_b"))
        keyed = rows.withColumn("_row", F.monotonically_increasing_id())
        hits = keyed.select("repo", path, last, "_row").join(b, ["repo", path]).where(F.col("_b") <= F.col(last)).groupBy("_row").agg(F.max("_b").alias(out))
        return keyed.join(hits, "_row", "left").withColumn(out, F.coalesce(out, F.lit(-1).cast("long"))).drop("_row")

    # a move leads from the life that ends before it to the one that begins with it
    moves = changes.where("change = 'R'").select("repo", "seq", F.col("old_path").alias("a_path"), F.col("new_path").alias("b_path"), (F.col("seq") - 1).alias("_last"))
    steps = stored(life_of(stored(moves), "a_path", "_last", "a_begin").select("repo", "a_path", "a_begin", "b_path", F.col("seq").alias("b_begin")))
    while True:
        nxt = steps.select("repo", F.col("a_path").alias("b_path"), F.col("a_begin").alias("b_begin"), F.col("b_path").alias("c_path"), F.col("b_begin").alias("c_begin"))
        joined = steps.join(nxt, ["repo", "b_path", "b_begin"], "left")
        if joined.where(F.col("c_path").isNotNull()).isEmpty():
            break
        steps = stored(joined.select("repo", "a_path", "a_begin", F.coalesce("c_path", "b_path").alias("b_path"), F.coalesce("c_begin", "b_begin").alias("b_begin")))
    # an added or moved file is in the life that begins here, any other in the one it had
    at = changes.withColumns({"_p": F.when(F.col("change").isin("A", "R", "C"), F.col("new_path")).otherwise(F.col("_path")), "_s": F.col("seq")})
    placed = life_of(stored(at), "_p", "_s", "_begin")
    ends = steps.select("repo", F.col("a_path").alias("_p"), F.col("a_begin").alias("_begin"), "b_path", "b_begin")
    out = placed.join(ends, ["repo", "_p", "_begin"], "left")
    name = F.struct(F.coalesce("b_path", "_p").alias("path"), F.coalesce("b_begin", "_begin").alias("begin"))
    return out.withColumn("file_id", name).drop("_p", "_s", "_begin", "_path", "b_path", "b_begin")
