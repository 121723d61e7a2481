"""History of files: what a table of commit × file rows says about each file.

Input rows have repo, commit_id, author, commit_time, file, added, deleted and
is_fix, once for each commit and file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.functions.core import days
from defectloom.session import dealt, parts_of, stored, stored_parts

KEY = ["repo", "file"]


def anchors(cf: DataFrame) -> DataFrame:
    """The latest commit time of each repository, which stands for now."""
    return cf.groupBy("repo").agg(F.max("commit_time").alias("anchor"))


def aged(cf: DataFrame) -> DataFrame:
    """Commit rows with age_days before their repository's anchor; the anchors are few and join without a hint."""
    return cf.join(anchors(cf), "repo").withColumn("age_days", days(F.col("commit_time"), F.col("anchor")))


def file_churn(cf: DataFrame) -> DataFrame:
    return cf.groupBy(*KEY).agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"), F.max("added").alias("max_added"))


def author_stats(cf: DataFrame, min_commits: int = 5) -> DataFrame:
    """Authors, the largest author's share (0 below ``min_commits``) and the share of one-commit authors; a missing name is ``unknown``."""
    name = F.coalesce(F.nullif(F.trim(F.col("author").cast("string")), F.lit("")), F.lit("unknown"))
    each = cf.groupBy(*KEY, name.alias("author")).agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy(*KEY).agg(F.count(F.lit(1)).alias("author_count"), F.sum("n").alias("commits"), F.max("n").alias("top"), F.count_if(F.col("n") == 1).alias("minor"))
    enough = F.col("commits") >= min_commits
    return per.select(
        *KEY,
        "author_count",
        F.when(enough, F.col("top") / F.col("commits")).otherwise(F.lit(0.0)).alias("ownership"),
        F.when(enough, 0).otherwise(1).alias("low_history_flag"),
        (F.col("minor") / F.col("author_count")).alias("minor_contributor_ratio"),
    )


def first_last(cf: DataFrame) -> DataFrame:
    """First and last commit, file age and days since the last change; of commits at one time the smaller id is first."""
    seq = F.struct("commit_time", "commit_id")
    per = aged(cf).groupBy(*KEY).agg(F.min(seq).alias("a"), F.max(seq).alias("b"), F.max("anchor").alias("anchor"))
    return per.select(
        *KEY,
        F.col("a.commit_id").alias("first_commit"),
        F.col("b.commit_id").alias("last_commit"),
        days(F.col("a.commit_time"), F.col("anchor")).alias("file_age"),
        days(F.col("b.commit_time"), F.col("anchor")).alias("days_since_last_change"),
    )


def recent_windows(cf: DataFrame, cuts: dict[str, int] | None = None) -> DataFrame:
    cuts = cuts or {"commits_2w": 14, "commits_1m": 30, "commits_3m": 90}
    return aged(cf).groupBy(*KEY).agg(*[F.count_if(F.col("age_days") < n).alias(k) for k, n in cuts.items()])


def bug_fix_counts(cf: DataFrame) -> DataFrame:
    fix_age = F.when(F.col("is_fix") == 1, F.col("age_days"))
    return aged(cf).groupBy(*KEY).agg(F.sum("is_fix").cast("long").alias("bug_fixes"), F.coalesce(F.min(fix_age), F.lit(-1)).cast("long").alias("days_since_last_bug"))


def bug_memory(cf: DataFrame, decay: float = 0.0038) -> DataFrame:
    fixes = F.when((F.col("is_fix") == 1) & (F.col("age_days") >= 0), F.exp(-decay * F.col("age_days")))
    last = F.min(F.when(F.col("is_fix") == 1, F.col("age_days")))
    return aged(cf).groupBy(*KEY).agg(
        F.coalesce(F.sum(fixes), F.lit(0.0)).alias("temporal_bug_memory"),
        F.coalesce(1.0 / (last + 1), F.lit(0.0)).alias("bug_recency_score"),
        F.coalesce((last <= 30).cast("int"), F.lit(0)).alias("recent_bug_flag"),
    )


def commit_gaps(cf: DataFrame) -> DataFrame:
    """Whole days between consecutive commits of a file."""
    order = Window.partitionBy(*KEY).orderBy("commit_time", "commit_id")
    gap = days(F.lag("commit_time").over(order), F.col("commit_time"))
    return cf.withColumn("gap_days", gap).where(F.col("gap_days").isNotNull()).select(*KEY, "commit_id", "gap_days")


def gap_stats(cf: DataFrame) -> DataFrame:
    return commit_gaps(cf).groupBy(*KEY).agg(F.avg("gap_days").alias("avg_gap"), F.min("gap_days").alias("min_gap"))


def burst_columns(min_commits: int = 3) -> dict[str, Column]:
    """Burst measures of a row with commits, commits_1m, avg_gap and min_gap."""
    score = F.when((F.col("commits") >= min_commits) & (F.col("avg_gap") > 0), F.least(F.log1p(F.col("avg_gap") / (F.col("min_gap") + 1e-5)), F.lit(5.0))).otherwise(0.0)
    burst_ratio = F.col("commits_1m") / (F.col("commits") + 1)
    return {"commit_burst_score": score, "recent_commit_burst": (score > 3).cast("int"), "burst_ratio": burst_ratio, "burst_risk": score * burst_ratio}


def commit_burst(cf: DataFrame, min_commits: int = 3) -> DataFrame:
    """log1p of the mean gap over the least, capped at 5; 1 flags a score above 3."""
    counts = aged(cf).groupBy(*KEY).agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("age_days") < 30).alias("commits_1m"))
    burst = burst_columns(min_commits)
    return counts.join(gap_stats(cf), KEY, "left").select(*KEY, *[c.alias(k) for k, c in burst.items()])


#: So many files of a commit are a block; the pairs of a larger commit are those within its blocks and between any two of them.
BLOCK = 512


def co_change(cf: DataFrame, min_files: int = 2, max_files: int | None = 30) -> DataFrame:
    """Ordered pairs of files that a commit of ``min_files`` to ``max_files`` files changes, with the number of such commits.

    A bound on files is part of the measure and holds before pairs are made, so a
    commit makes at most ``max_files * (max_files - 1)`` pairs. With None every
    commit counts, however many files it has.
    """
    both = _pairs(*stored_parts(cf.select("repo", "commit_id", "file")), min_files, max_files)[0]
    return both.select("repo", "src", "dst", "n")


def _pairs(cf: DataFrame, n: int, min_files: int, max_files: int | None) -> tuple[DataFrame, int]:
    """The pairs of :func:`co_change` and the parts for them, from rows and the parts for these.

    Commits are dealt anew by the number of their pairs before these are made,
    and a pair is counted once for both its orders.
    """
    changed = dealt(cf.select("repo", "commit_id", "file"), n, "repo", "commit_id").distinct()
    # files are counted by an aggregate: a vast commit is never one task's buffer
    sizes = changed.groupBy("repo", "commit_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_files)
    if max_files is not None:
        sizes = sizes.where(F.col("n") <= max_files)
    if max_files is None or max_files > BLOCK:
        met, m = _blocks(changed.join(sizes, ["repo", "commit_id"]), n)
    else:
        met, m = _whole(changed.join(sizes, ["repo", "commit_id"], "left_semi"), n)
    src = met.select("repo", F.explode("files").alias("src"), "others", "apart")
    once = src.select("repo", "src", F.explode("others").alias("dst"), "apart").where("apart OR src < dst")
    once = once.select("repo", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    once = dealt(once, m, "repo", "src", "dst").groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return once.select("repo", F.explode(ways).alias("x"), "n").select("repo", "x.*", "n"), 2 * m


def _whole(changed: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The files of each commit as one list that meets itself, and the parts for the pairs."""
    small = changed.groupBy("repo", "commit_id").agg(F.collect_list("file").alias("files"))
    m = 0
    if n:
        small = stored(small)
        size = F.size("files").cast("long")
        m = max(n, parts_of(small.agg(F.sum(size * (size - 1) / 2).cast("long")).first()[0]))
    return dealt(small, m, "repo", "commit_id").select("repo", "files", F.col("files").alias("others"), F.lit(False).alias("apart")), m


def _blocks(sized: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Two blocks of a commit's files for each pair of its blocks, and the parts for the pairs; ``n`` in a row is its commit's files.

    A task gathers two blocks at a time, however many files a commit has. A
    commit of up to ``BLOCK`` files is one block, which meets itself.
    """
    m = 0
    if n:
        sized = stored(sized)
        m = max(n, parts_of(sized.agg(F.sum((F.col("n") - 1) / 2).cast("long")).first()[0]))
    blocks = F.ceil(F.col("n") / BLOCK)
    own = sized.withColumn("b", F.pmod(F.xxhash64("file"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    key = ["repo", "commit_id", "lo", "hi"]
    own = own.select("repo", "commit_id", "file", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") <= F.col("o")).alias("first"))
    # rows that lie together by commit would be grouped where they are, so that all blocks of a commit were one task's
    own = own.repartition(m, *key) if m else own.repartition(*key)
    first = F.col("first")
    pairs = own.groupBy(*key).agg(F.collect_list(F.when(first, F.col("file"))).alias("files"), F.collect_list(F.when(~first, F.col("file"))).alias("rest"))
    apart = F.col("lo") < F.col("hi")
    return pairs.select("repo", "files", F.when(apart, F.col("rest")).otherwise(F.col("files")).alias("others"), apart.alias("apart")), m


def coupling(cf: DataFrame, max_files: int = 30, strict_order: bool = False) -> DataFrame:
    """The partner most often changed with a file (of equals the smallest), strength, partners, and whether the file changed after it.

    ``strict_order`` also asks that the partner was first changed later.
    """
    cf, n = stored_parts(cf.select("repo", "commit_id", "commit_time", "file"))
    files = dealt(cf, n, *KEY).groupBy(*KEY).agg(F.count(F.lit(1)).alias("commits"), F.max("commit_time").alias("last"), F.min("commit_time").alias("first"))
    pairs, m = _pairs(cf, n, 2, max_files)
    # every pair is one row here, so that a file has at most a row for each other file
    best = dealt(pairs, m, "repo", "src").groupBy("repo", F.col("src").alias("file")).agg(F.max(F.struct("n", (-F.col("dst")).alias("neg"))).alias("top"), F.count(F.lit(1)).alias("partners"))
    partner = files.select(F.col("repo").alias("p_repo"), F.col("file").alias("p_file"), F.col("last").alias("p_last"), F.col("first").alias("p_first"))
    j = files.join(best, KEY, "left").withColumn("partner", -F.col("top.neg"))
    j = dealt(j, n, "repo", "partner").join(partner, (F.col("repo") == F.col("p_repo")) & (F.col("partner") == F.col("p_file")), "left")
    missing = F.col("last") > F.col("p_last")
    if strict_order:
        missing = missing & (F.col("p_first") > F.col("first"))
    strength = F.coalesce(F.col("top.n") / F.col("commits"), F.lit(0.0))
    flag = F.coalesce(missing.cast("int"), F.lit(0))
    return j.select(*KEY, "partner", strength.alias("max_coupling_strength"), F.coalesce("partners", F.lit(0)).cast("long").alias("coupled_file_count"), flag.alias("coupled_recent_missing"), (strength * flag).alias("coupling_risk"))


def file_history(cf: DataFrame) -> DataFrame:
    """Churn, first and last commit, recent counts, fixes and memory of them, in one pass and one exchange."""
    seq, fix = F.struct("commit_time", "commit_id"), F.col("is_fix") == 1
    age = F.col("age_days")
    last_fix = F.min(F.when(fix, age))
    x = aged(cf).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("commits"),
        F.sum("added").alias("lines_added"),
        F.sum("deleted").alias("lines_deleted"),
        F.max("added").alias("max_added"),
        F.min(seq)["commit_id"].alias("first_commit"),
        F.max(seq)["commit_id"].alias("last_commit"),
        F.max(age).alias("file_age"),
        F.min(age).alias("days_since_last_change"),
        F.count_if(age < 14).alias("commits_2w"),
        F.count_if(age < 30).alias("commits_1m"),
        F.count_if(age < 90).alias("commits_3m"),
        F.sum("is_fix").cast("long").alias("bug_fixes"),
        F.coalesce(last_fix, F.lit(-1)).cast("long").alias("days_since_last_bug"),
        F.coalesce(F.sum(F.when(fix & (age >= 0), F.exp(-0.0038 * age))), F.lit(0.0)).alias("temporal_bug_memory"),
        F.coalesce(1.0 / (last_fix + 1), F.lit(0.0)).alias("bug_recency_score"),
        F.coalesce((last_fix <= 30).cast("int"), F.lit(0)).alias("recent_bug_flag"),
    )
    return x


def history_features(cf: DataFrame, max_files: int = 30) -> DataFrame:
    """All of a file's history in one row: one pass for what one pass can tell, then authors, gaps and coupling by the same key.

    Commit rows are stored once in the shared folder, as seven branches read them.
    """
    cf = stored(cf.select("repo", "commit_id", "author", "commit_time", "file", "added", "deleted", "is_fix"))
    out = file_history(cf).join(author_stats(cf), KEY).join(gap_stats(cf), KEY, "left")
    out = out.withColumns(burst_columns()).drop("avg_gap", "min_gap")
    return out.join(coupling(cf, max_files), KEY)


def commit_counts_in(cf: DataFrame, width: str, step: str) -> DataFrame:
    """Commits of each file in sliding time windows, the batch twin of the streaming count."""
    return cf.groupBy("file", F.window("commit_time", width, step).alias("w")).agg(F.count(F.lit(1)).alias("commits")).select("file", F.col("w.start").alias("window_start"), "commits")
