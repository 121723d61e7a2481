"""Evaluation of scores against labels: rows have risk, buggy, file and what an operator names besides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.functions.core import ratio
from defectloom.operators.ranking import exact_percentiles, running_by_risk


def confusion_matrix(df: DataFrame, flag: Column, group: list[str] | None = None) -> DataFrame:
    b = F.col("buggy") == 1
    return df.groupBy(*(group or [])).agg(F.count_if(flag & b).alias("tp"), F.count_if(flag & ~b).alias("fp"), F.count_if(~flag & ~b).alias("tn"), F.count_if(~flag & b).alias("fn"))


def classification_metrics(df: DataFrame, flag: Column, group: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1, accuracy, and F1 weighted by class size; a zero divisor gives 0."""
    m = confusion_matrix(df, flag, group)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    f1 = ratio(2 * tp, 2 * tp + fp + fn)
    f0 = ratio(2 * tn, 2 * tn + fp + fn)
    n = tp + fp + tn + fn
    return m.select(*(group or []), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1"), ratio((tp + fn) * f1 + (tn + fp) * f0, n).alias("weighted_f1"), ratio(tp + tn, n).alias("accuracy"))


def recall_at_k_rank(df: DataFrame, share: float = 0.2, tie: str = "file") -> DataFrame:
    """Share of defects in the first max(1, floor(n * share)) rows by risk, with the most that is possible."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum("buggy").alias("bugs"))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
    x = running_by_risk(df, {}, tie=tie).crossJoin(F.broadcast(total))
    one = x.where(F.col("position") <= cut).agg(F.sum("buggy").alias("found"), F.max("bugs").alias("bugs"), F.max(cut).alias("cut"))
    return one.select(F.col("cut").cast("long").alias("cut"), F.col("found").cast("long").alias("found"), ratio(F.col("found"), F.col("bugs")).alias("recall"), ratio(F.least("cut", "bugs"), F.col("bugs")).alias("theoretical_max"))


def recall_at_k_threshold(df: DataFrame, q: float = 0.8, group: list[str] | None = None) -> DataFrame:
    """Share of defects with a risk at or above the q-quantile; ties at it count."""
    cut = group_percentile(df, "risk", q, group).withColumnRenamed("value", "threshold") if group else exact_percentiles(df, "risk", [q]).select(F.col("p")[0].alias("threshold"))
    x = df.join(cut, group) if group else df.crossJoin(F.broadcast(cut))
    per = x.groupBy(*(group or [])).agg(F.max("threshold").alias("threshold"), F.sum(F.when(F.col("risk") >= F.col("threshold"), F.col("buggy")).otherwise(0)).alias("found"), F.sum("buggy").alias("bugs"))
    return per.select(*(group or []), "threshold", ratio(F.col("found"), F.col("bugs")).alias("recall"))


def topk_eval(df: DataFrame, ks: tuple[int, ...] = (10, 5), tie: str = "file") -> DataFrame:
    """Recall and precision of the first k, one row for each k."""
    most = max(ks)
    total = df.agg(F.sum("buggy").alias("bugs"))
    top = df.orderBy(F.col("risk").desc(), F.col(tie).asc()).limit(most)  # a report of k rows
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.col("risk").desc(), F.col(tie).asc())))
    per = ranked.select("r", "buggy", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where("r <= k").groupBy("k").agg(F.sum("buggy").alias("found"), F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(total)).select("k", ratio(F.col("found"), F.col("bugs")).alias("recall"), ratio(F.col("found"), F.col("n")).alias("precision"))


def by_score(df: DataFrame, buckets: int = 1024) -> DataFrame:
    """One row per distinct risk with its counts and the counts at or above it."""
    per = df.groupBy("risk").agg(F.sum("buggy").cast("long").alias("pos"), (F.count(F.lit(1)) - F.sum("buggy")).cast("long").alias("neg"))
    return running_by_risk(per, {"tp": F.col("pos"), "fp": F.col("neg")}, tie="risk", buckets=buckets)


def pr_auc(df: DataFrame) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall it adds."""
    total = df.agg(F.sum("buggy").alias("bugs"))
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return by_score(df).agg(F.sum(step).alias("s")).crossJoin(F.broadcast(total)).select(ratio(F.col("s"), F.col("bugs")).alias("pr_auc"))


def roc_auc(df: DataFrame) -> DataFrame:
    """The chance that a defect scores above a clean row, ties half; null with one class only."""
    total = df.agg(F.sum("buggy").alias("p"), (F.count(F.lit(1)) - F.sum("buggy")).alias("n"))
    below = F.col("n") - F.col("fp")
    s = by_score(df).crossJoin(F.broadcast(total)).agg(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("s"), F.max("p").alias("p"), F.max("n").alias("n"))
    return s.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("s") / (F.col("p") * F.col("n"))).alias("roc_auc"))


def optimal_threshold(df: DataFrame) -> DataFrame:
    """The score at which F1 is largest, of equals the highest."""
    total = df.agg(F.sum("buggy").alias("bugs"))
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("bugs"))
    return by_score(df).crossJoin(F.broadcast(total)).select("risk", F.round(f1, 12).alias("f1")).agg(F.max(F.struct("f1", "risk")).alias("x")).select(F.col("x.risk").alias("threshold"), F.col("x.f1").alias("f1"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, calibration error over quantile bins, spread, range and the gap of the means."""
    edges = exact_percentiles(df, "risk", [i / bins for i in range(1, bins)]).withColumnRenamed("p", "e")
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda q: q < F.col("risk"))))
    per = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("p"), F.avg("buggy").alias("y"))
    ece = per.agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("ece"))
    one = df.agg(F.avg(F.pow(F.col("risk") - F.col("buggy"), F.lit(2))).alias("brier"), F.stddev_pop("risk").alias("std"), (F.max("risk") - F.min("risk")).alias("range"), F.abs(F.avg("risk") - F.avg("buggy")).alias("gap"))
    return one.crossJoin(F.broadcast(ece))


def group_percentile(df: DataFrame, column: str, q: float, group: list[str]) -> DataFrame:
    """Rows (group, value): the exact q-quantile of each group with linear interpolation.

    Equal values are added up before they are sorted, and a group's values pass
    a sort that can spill, not a map that must fit into memory.
    """
    per = df.where(F.col(column).isNotNull()).groupBy(*group, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*group)
    x = per.withColumns({"_last": F.sum("_k").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1, "_at": F.lit(float(q)) * (F.sum("_k").over(w) - 1)})

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("_last") - F.col("_k") < rank) & (rank <= F.col("_last")), F.col("_v")))

    both = x.groupBy(*group).agg(value(F.floor("_at")).alias("_a"), value(F.ceil("_at")).alias("_b"), F.max(F.col("_at") - F.floor("_at")).alias("_f"))
    return both.select(*group, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value"))


def training_stats(df: DataFrame, columns: list[str], most_values: int = 1_000_000) -> DataFrame:
    """Rows (feature, mean, std, median, p99, p01); the deviation divides by n. Beyond ``most_values`` rows the percentiles of each column are closed in one by one."""
    points = (0.5, 0.99, 0.01)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    aggs = [F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")]
    if df.limit(most_values + 1).count() <= most_values:
        per = long.groupBy("feature").agg(*aggs, F.percentile("x", F.array(*[F.lit(p) for p in points])).alias("q"))
    else:
        cuts = [exact_percentiles(df, c, points, most_values).select(F.lit(c).alias("feature"), F.col("p").alias("q")) for c in columns]
        q = cuts[0]
        for other in cuts[1:]:
            q = q.unionByName(other)
        per = long.groupBy("feature").agg(*aggs).join(q, "feature")
    return per.select("feature", "mean", "std", F.col("q")[0].alias("median"), F.col("q")[1].alias("p99"), F.col("q")[2].alias("p01"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """Means of folds (n_test, n_buggy, f1): plain, weighted by size for n >= 30, for n >= 20, and the reliable part."""
    big, honest = F.col("n_test") >= 30, F.col("n_test") >= 20
    share = F.col("n_buggy") / F.col("n_test")
    reliable = big & share.between(0.15, 0.75)
    ceiling = F.when(F.col("n_buggy") > 0, F.least(F.lit(1.0), F.greatest(F.lit(1), F.floor(F.col("n_test") * 0.2)) / F.col("n_buggy"))).otherwise(0.0)
    return folds.agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("f1").alias("mean_f1"),
        (F.sum(F.when(big, F.col("f1") * F.col("n_test"))) / F.sum(F.when(big, F.col("n_test")))).alias("weighted_f1"),
        F.avg(F.when(honest, F.col("f1"))).alias("honest_f1"),
        F.avg(ceiling).alias("mean_ceiling"),
        F.avg(F.when(reliable, F.col("f1"))).alias("reliable_f1"),
        F.count_if(reliable).alias("reliable_folds"),
    )


def feature_vote(votes: DataFrame, folds: int, share: float = 0.6) -> DataFrame:
    """Features chosen in at least max(2, floor(share * folds)) folds."""
    need = max(2, int(share * folds))
    return votes.groupBy("feature").agg(F.count_distinct("fold").alias("n")).where(F.col("n") >= need)


def model_avgs(results: DataFrame) -> DataFrame:
    """Averages of each model and its best project by f1, of equals the smaller name."""
    return results.groupBy("model").agg(F.avg("f1").alias("avg_f1"), F.count(F.lit(1)).alias("projects"), F.sum("n_test").cast("long").alias("total_files"), F.max("f1").alias("best_f1"), F.min(F.struct((-F.col("f1")).alias("k"), "repo"))["repo"].alias("best_project"))


def global_importance(long: DataFrame, n: int = 10) -> DataFrame:
    """Rows (feature, value) to the n features of largest mean size of attribution."""
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.col("importance").desc(), "feature").limit(n)


def risk_histogram(df: DataFrame, variant: str) -> DataFrame:
    """Counts of bins, empty ones too: ``right`` 20 bins (a, b], ``left`` 10 bins [a, b), ``clamped`` 20 bins with 1.0 in the last."""
    r = F.col("risk")
    n = 10 if variant == "left" else 20
    b = {"right": F.ceil(r * 20) - 1, "left": F.floor(r * 10), "clamped": F.least(F.floor(r * 20), F.lit(19))}[variant].cast("long")
    bins = df.sparkSession.range(n).withColumnRenamed("id", "bin")
    return bins.join(df.select(b.alias("bin")).where(F.col("bin").between(0, n - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("c")), "bin", "left").select("bin", F.coalesce("c", F.lit(0)).cast("long").alias("files"))


# The sets of features that conclusions compare, and the marks to be reached.
INDIVIDUAL_SETS, COMBINED_SETS = ("Static-only", "Git-only", "Developer-only"), ("Static+Git", "All-Combined")
PR_AUC_TARGET, MEANINGFUL_RANGE = 0.5, 0.1


def ablation_summary(folds: DataFrame, measures: tuple[str, ...] = ("weighted_f1", "pr_auc", "recall_20", "accuracy")) -> DataFrame:
    """Rows (model, feature_set, folds) with the mean of each measure over the folds."""
    return folds.groupBy("model", "feature_set").agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(m) for m in measures])


def ablation_conclusions(summary: DataFrame) -> DataFrame:
    """One row: the best single group of features and the best combination by average precision, and whether the combination is better, reaches the target, and sets differ.

    Ties go to the smaller model and set. A kind of set that is missing has null as its best, and nothing is then concluded.
    """

    def best(sets: tuple[str, ...]) -> Column:
        key = F.struct((-F.col("pr_auc")).alias("k"), "model", "feature_set")
        return F.min(F.when(F.col("feature_set").isin(*sets), key))

    x = summary.agg(best(INDIVIDUAL_SETS).alias("i"), best(COMBINED_SETS).alias("c"), (F.max("pr_auc") - F.min("pr_auc")).alias("range"))
    both = F.col("i").isNotNull() & F.col("c").isNotNull()
    said = lambda c: F.concat_ws(" ", F.col(f"{c}.model"), F.col(f"{c}.feature_set"))
    flag = lambda c: both & F.coalesce(c, F.lit(False))
    return x.select(
        F.when(F.col("i").isNotNull(), said("i")).alias("best_individual"),
        F.when(F.col("c").isNotNull(), said("c")).alias("best_combined"),
        (-F.col("i.k")).alias("individual_pr_auc"),
        (-F.col("c.k")).alias("combined_pr_auc"),
        flag(F.col("c.k") < F.col("i.k")).alias("combined_outperforms"),
        flag(-F.col("c.k") > PR_AUC_TARGET).alias("target_achieved"),
        flag(F.col("range") > MEANINGFUL_RANGE).alias("meaningful_differences"),
    )


def loc_baseline(df: DataFrame, share: float = 0.8) -> DataFrame:
    """One row (pr_auc, f1): files ranked by their lines, and flagged from the percentile ``share`` of lines on."""
    cut = df.agg(F.percentile("loc", share).alias("_cut"))
    flagged = df.crossJoin(F.broadcast(cut))  # one row
    flag, bug = F.col("loc") >= F.col("_cut"), F.col("buggy") == 1
    counts = flagged.agg(F.count_if(flag & bug).alias("tp"), F.count_if(flag & ~bug).alias("fp"), F.count_if(~flag & bug).alias("fn"))
    f1 = counts.select(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    return pr_auc(df.withColumn("risk", F.col("loc").cast("double"))).select("pr_auc").crossJoin(f1)
