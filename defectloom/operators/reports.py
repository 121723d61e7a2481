"""Reports: tiers, modules, indicators, recommendations, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.functions import paths as P
from defectloom.functions.core import ratio
from defectloom.operators.ranking import top_per_group
from defectloom.operators.risk import priority_score, risk_level_abs

ACTIONS = {"CRITICAL": "Review immediately", "HIGH": "Review this sprint", "MODERATE": "Monitor", "LOW": "No action"}


def tier_summary(df: DataFrame) -> DataFrame:
    """Per tier: files, share, mean risk, mean and total lines, what to do."""
    per = df.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("files"), F.avg("risk").alias("avg_risk"), F.avg("loc").alias("avg_loc"), F.sum("loc").cast("long").alias("total_loc"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    return per.crossJoin(F.broadcast(total)).select("risk_tier", "files", (100.0 * F.col("files") / F.col("_n")).alias("percent"), "avg_risk", "avg_loc", "total_loc", action[F.col("risk_tier")].alias("action"))


def repo_trend(df: DataFrame) -> DataFrame:
    return df.where("repo IS NOT NULL").groupBy("repo").agg(F.avg("risk").alias("avg_risk"), F.sum("buggy").cast("long").alias("bugs"))


def module_rollup(df: DataFrame, path: str = "path", n: int = 5, key: str = "file_id") -> DataFrame:
    """The n riskiest top-level directories by mean, with their three riskiest files; files in no directory are left out."""
    m = df.where(F.col(path).contains("/")).withColumn("module", F.split(path, "/")[0])
    per = m.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.avg("risk").alias("avg_risk"), F.sum("risk").alias("total_risk"))
    best = per.orderBy(F.round("avg_risk", 9).desc(), "module").limit(n)
    # only the reported modules' files are ranked, and three of each module gathered
    ranked = m.join(F.broadcast(best.select("module")), "module", "left_semi")
    three = top_per_group(ranked, ["module"], [F.col("risk").desc(), F.col(key)], 3, "_r")
    names = F.array_sort(F.collect_list(F.struct("_r", F.col(key).cast("string").alias("name"))))
    return best.join(three.groupBy("module").agg(F.array_join(F.transform(names, lambda x: x["name"]), ",").alias("top_files")), "module")


def quality_indicators(df: DataFrame) -> DataFrame:
    """One row of indicators and a score max(0, 100 - 50 * risk - 30 * high share - 2 * complexity)."""
    one = df.agg(
        F.count(F.lit(1)).alias("files"),
        F.avg("risk").alias("average_risk"),
        F.avg((F.col("risk") >= 0.6).cast("double")).alias("high_risk_ratio"),
        F.avg("avg_complexity").alias("average_complexity"),
        F.count_if(F.col("max_complexity") > 10).alias("high_complexity_files"),
        F.sum("commits").cast("long").alias("total_commits"),
        F.avg("commits").alias("average_commits"),
        F.sum(F.col("lines_added") + F.col("lines_deleted")).cast("long").alias("total_churn"),
        F.avg(F.col("lines_added") + F.col("lines_deleted")).alias("average_churn"),
    )

    def level(c: str, high: float, medium: float, names=("High", "Medium", "Low")) -> Column:
        return F.when(F.col(c) > high, names[0]).when(F.col(c) > medium, names[1]).otherwise(names[2])

    score = F.greatest(F.lit(0.0), 100 - F.col("average_risk") * 50 - F.col("high_risk_ratio") * 30 - F.col("average_complexity") * 2)
    return one.withColumns({"quality_score": score, "risk_level": level("high_risk_ratio", 0.3, 0.1), "complexity_level": level("average_complexity", 8, 4), "activity_level": level("average_commits", 20, 5), "stability_level": level("average_churn", 100, 20, ("Low", "Medium", "High"))})


def risk_distribution(df: DataFrame) -> DataFrame:
    """Counts and percentages of the four absolute bands."""
    level = risk_level_abs(F.col("risk"))
    per = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("files"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return per.crossJoin(F.broadcast(total)).select("level", "files", (100.0 * F.col("files") / F.col("_n")).alias("percent"))


def recommendations(df: DataFrame, key: str = "file") -> DataFrame:
    """Rows (priority, category, count, files) of the rules that hold; files are named smallest first."""
    churn = F.when(F.col("loc") > 0, (F.col("lines_added") + F.col("lines_deleted")) / F.col("loc")).otherwise(0.0)
    rules = [
        ("CRITICAL", "Immediate Action Required", F.col("risk") >= 0.8, 5, F.col("n") > 0),
        ("HIGH", "Code Quality Concern", F.col("risk") >= 0.6, 0, F.col("n") > F.col("total") * 0.3),
        ("MEDIUM", "Complexity Reduction", F.col("max_complexity") > 15, 3, F.col("n") > 0),
        ("MEDIUM", "Stability Issues", churn > 0.5, 3, F.col("n") > 0),
        ("LOW", "Architectural Review", F.col("coupling_risk") > 0.7, 3, F.col("n") > 0),
    ]
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counts = df.agg(*[F.count_if(test).alias(f"n{i}") for i, (_, _, test, _, _) in enumerate(rules)])
    out: DataFrame | None = None
    for i, (priority, category, test, k, holds) in enumerate(rules):
        first = df.where(test).orderBy(key).limit(k).agg(F.array_join(F.array_sort(F.collect_list(F.col(key))).cast("array<string>"), ",").alias("files")) if k else df.limit(1).agg(F.lit("").alias("files"))
        row = counts.select(F.col(f"n{i}").alias("n")).crossJoin(total).crossJoin(first).where(holds).select(F.lit(priority).alias("priority"), F.lit(category).alias("category"), F.col("n").alias("affected"), F.col("files"))
        out = row if out is None else out.unionByName(row)
    return out


def drop_rate(df: DataFrame, reason: str = "reason", kept: str = "kept") -> DataFrame:
    """Counts of each filter reason and the share dropped in all."""
    per = df.groupBy(reason).agg(F.count(F.lit(1)).alias("files"))
    total = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(reason) != kept).alias("_d"))
    return per.crossJoin(F.broadcast(total)).select(F.col(reason).alias("reason"), "files", ratio(F.col("_d"), F.col("_n")).alias("drop_rate"))


def filter_audit(df: DataFrame, path: str = "path", test=None, generated=None) -> DataFrame:
    """Included, test and generated files; tests are told first."""
    is_test = P.is_test_file(F.col(path)) if test is None else test
    is_made = P.is_generated_file(F.col(path)) if generated is None else generated
    return df.agg(F.count_if(~is_test & ~is_made).alias("included"), F.count_if(is_test).alias("excluded_test"), F.count_if(~is_test & is_made).alias("excluded_generated"))


def prediction_audit(df: DataFrame) -> DataFrame:
    """Least, largest and mean score, zeros, distinct scores, and whether they have collapsed."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.min("risk").alias("min_risk"), F.max("risk").alias("max_risk"), F.avg("risk").alias("mean_risk"), F.count_if(F.col("risk") == 0).alias("zeros"), F.count_distinct("risk").alias("distinct_scores"), F.count_distinct("repo").alias("repos"))
    return one.withColumn("collapsed", F.col("distinct_scores") <= 2)


def _rounded(c: Column, n: int) -> Column:
    """Rounded half up as a decimal, so that every engine gives the same digits."""
    return F.round(c.cast("decimal(28,9)"), n).cast("double")


def _percent(c: Column) -> Column:
    return F.concat(F.format_number(_rounded(c * 100, 1), 1), F.lit("%"))


def _tier(risk: Column) -> Column:
    return F.initcap(F.lower(risk_level_abs(risk)))


def _churn() -> Column:
    return F.when(F.col("loc") > 0, (F.col("lines_added") + F.col("lines_deleted")) / F.col("loc")).otherwise(0.0)


def scan_rows(df: DataFrame) -> DataFrame:
    """The 21 columns of the table export, one row for each file; a missing measure is 0 and a missing language ``unknown``."""
    x = df.fillna(0, [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float")])
    score = priority_score(F.col("risk"), _churn(), F.col("commits"), F.col("coupling_risk"))
    return x.select(
        F.coalesce(F.col("file").cast("string"), F.lit("")).alias("filename"),
        _rounded(F.col("risk"), 4).alias("risk_score"),
        _percent(F.col("risk")).alias("risk_percentage"),
        _tier(F.col("risk")).alias("risk_tier"),
        F.col("loc").alias("lines_of_code"),
        _rounded(F.col("avg_complexity"), 2).alias("avg_complexity"),
        "max_complexity",
        "functions",
        "commits",
        "lines_added",
        "lines_deleted",
        _rounded(_churn(), 3).alias("churn_ratio"),
        "days_since_last_change",
        "author_count",
        _rounded(F.col("minor_contributor_ratio"), 2).alias("minor_contributor_ratio"),
        _rounded(F.col("coupling_risk"), 2).alias("coupling_risk"),
        "max_coupling_strength",
        "coupled_file_count",
        F.coalesce("language", F.lit("unknown")).alias("language"),
        F.col("buggy").alias("buggy_label"),
        _rounded(score, 3).alias("priority_score"),
    )


def _bands(df: DataFrame) -> DataFrame:
    """One row: files, the files of the four absolute bands, the sum of risks."""
    r = F.col("risk")
    tests = {"critical": r >= 0.8, "high": (r >= 0.6) & (r < 0.8), "moderate": (r >= 0.4) & (r < 0.6), "low": r < 0.4}
    return df.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(t).alias(k) for k, t in tests.items()], F.sum("risk").alias("total_risk"))


def _riskiest(df: DataFrame, n: int) -> DataFrame:
    """The n rows of highest risk, of equals the smaller file, with their rank; n rows, so one task."""
    order = [F.col("risk").desc(), F.col("file").asc()]
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def scan_insights(df: DataFrame, repo: str, top: int = 10) -> DataFrame:
    """The blocks that follow the table in the export: rows (section, position, label, value, share, commits, lines)."""
    one = _bands(df)
    empty = F.lit("").alias

    def line(section: str, position: int, label: str, value: Column, share: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(position).alias("position"), F.lit(label).alias("label"), value.cast("string").alias("value"), share.alias("share"), empty("commits"), empty("lines"))

    lines = [line("SCAN INSIGHTS", 1, "Repository", F.lit(repo), F.lit("")), line("SCAN INSIGHTS", 2, "Total Files", F.col("files"), F.lit(""))]
    for i, (label, c) in enumerate((("Critical Files", "critical"), ("High Risk Files", "high"), ("Moderate Risk Files", "moderate"), ("Low Risk Files", "low"))):
        lines.append(line("RISK DISTRIBUTION", i + 1, label, F.col(c), F.when(F.col("files") > 0, _percent(F.col(c) / F.col("files"))).otherwise("")))
    head = one.select(F.explode(F.array(*lines)).alias("x")).select("x.*")
    best = _riskiest(df, top).select(
        F.lit(f"TOP {top} HIGH RISK FILES").alias("section"),
        F.col("rank").alias("position"),
        F.concat(F.lit("#"), F.col("rank").cast("string")).alias("label"),
        P.basename(F.col("file").cast("string")).alias("value"),
        _percent(F.col("risk")).alias("share"),
        F.concat(F.lit("Commits: "), F.col("commits").cast("string")).alias("commits"),
        F.concat(F.lit("LOC: "), F.col("loc").cast("string")).alias("lines"),
    )
    return head.unionByName(best)


def scan_document(df: DataFrame, repo: str, path: str = "path", top: int = 10, metrics: DataFrame | None = None) -> DataFrame:
    """One row with one JSON document of a scan: metadata, summary, insights (riskiest files and modules, recommendations, indicators), model metrics.

    Everything in it has a fixed size; the files themselves are rows of their
    own, see :func:`scan_rows`.
    """
    def share(c: str) -> Column:
        return F.struct(F.col(c).alias("count"), _rounded(100 * F.col(c) / F.col("files"), 1).alias("percentage"))

    bands = _bands(df).select(
        F.struct(
            F.col("files").alias("total_files"),
            F.struct(*[share(c).alias(c) for c in ("critical", "high", "moderate", "low")]).alias("risk_distribution"),
            _rounded(F.col("total_risk") / F.col("files"), 3).alias("average_risk_score"),
            _rounded(100 * (F.col("critical") + F.col("high")) / F.col("files"), 1).alias("high_risk_percentage"),
        ).alias("summary_metrics")
    )
    first = _riskiest(df, top)
    shown = ["risk_score", "risk_percentage", "risk_tier", "priority_score", "commits", F.col("lines_of_code").alias("loc"), "avg_complexity", "churn_ratio", "days_since_last_change", "coupling_risk", "language"]
    ranks = first.select(F.col("file").cast("string").alias("filename"), "rank", P.basename(F.col("file").cast("string")).alias("_base"))
    files = scan_rows(first).join(ranks, "filename").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("_base").alias("filename"), F.col("filename").alias("filepath"), *shown))).alias("f"))
    files = files.select(F.transform("f", lambda x: x.dropFields("rank")).alias("top_risk_files"))
    modules = module_rollup(df, path, 5, "file").agg(F.array_sort(F.collect_list(F.struct((-F.round("avg_risk", 9)).alias("order"), "module", F.col("files").alias("file_count"), _rounded(F.col("avg_risk"), 3).alias("average_risk"), _rounded(F.col("total_risk"), 3).alias("total_risk"), F.split("top_files", ",").alias("top_files")))).alias("m"))
    modules = modules.select(F.transform("m", lambda x: x.dropFields("order")).alias("riskiest_modules"))
    order = F.array_position(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), F.col("priority"))
    advice = recommendations(df).agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "priority", "category", "affected", "files"))).alias("a"))
    advice = advice.select(F.transform("a", lambda x: x.dropFields("order")).alias("recommendations"))
    quality = quality_indicators(df)
    quality = quality.select(F.struct(*quality.columns).alias("quality_indicators"))
    one = bands.crossJoin(files).crossJoin(modules).crossJoin(advice).crossJoin(quality)  # one row each
    model = F.struct(F.lit(None).cast("double").alias("pr_auc")) if metrics is None else F.struct(*metrics.columns)
    one = one if metrics is None else one.crossJoin(metrics)
    meta = F.struct(F.lit(repo).alias("repository"), F.lit("comprehensive_json").alias("export_format"))
    return one.select(F.to_json(F.struct(meta.alias("scan_metadata"), "summary_metrics", F.struct("top_risk_files", "riskiest_modules", "recommendations", "quality_indicators").alias("insights"), model.alias("model_metrics"))).alias("document"))
