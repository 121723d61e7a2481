"""Risk of files, commits and pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectloom.functions.core import clip
from defectloom.operators.ranking import top_per_group


def risk_level_abs(r: Column) -> Column:
    return F.when(r >= 0.8, "CRITICAL").when(r >= 0.6, "HIGH").when(r >= 0.4, "MODERATE").otherwise("LOW")


def risk_interpretation(r: Column) -> Column:
    return F.when(r >= 0.8, "Very High").when(r >= 0.6, "High").when(r >= 0.4, "Moderate").when(r >= 0.2, "Low").otherwise("Very Low")


def risk_text(r: Column, n: Column, least_samples: int = 10) -> Column:
    """What a risk means, with the Wilson interval of a share of ``n`` where there are more than ``least_samples``."""

    def percent(c: Column) -> Column:
        return F.format_string("%.1f%%", F.round(c * 100, 1))

    low, high = wilson(r, n)
    share = F.concat(percent(r), F.when(n > least_samples, F.concat(F.lit(" ("), percent(low), F.lit("-"), percent(high), F.lit(" range)"))).otherwise(""))
    said = lambda name, advice: F.concat(F.lit(f"{name} risk: "), share, F.lit(f" - {advice}"))
    # fixed values: the bands and their advice
    return (
        F.when(r >= 0.8, said("Critical", "Immediate review required"))
        .when(r >= 0.6, said("High", "Prioritize for review"))
        .when(r >= 0.4, said("Moderate", "Consider for review"))
        .when(r >= 0.2, said("Low", "Monitor if changes planned"))
        .otherwise(said("Minimal", "Low priority"))
    )


def recent(last_change: Column, now: Column, days: float | None) -> Column:
    """Whether a file changed within the last ``days``; all files do where that is None."""
    return F.lit(True) if days is None else F.unix_micros(last_change) >= F.unix_micros(now) - int(days * 86_400_000_000)


def severity_token(r: Column) -> Column:
    return F.when(r >= 0.7, "HIGH").when(r >= 0.4, "MEDIUM").otherwise("LOW")


def priority_score(risk: Column, churn_ratio: Column, commits: Column, coupling: Column) -> Column:
    one = F.lit(1.0)
    return 0.4 * risk + 0.3 * F.least(10 * churn_ratio, one) + 0.2 * F.least(commits / 50, one) + 0.1 * F.least(coupling, one)


def entropy(p: Column, ln2: float = 0.6931471805599453) -> Column:
    """Binary entropy in bits, 0 at both ends."""
    inside = (p > 0) & (p < 1)
    return F.when(inside, -(p * F.ln(p) + (1 - p) * F.ln(1 - p)) / F.lit(ln2)).otherwise(0.0)


def wilson(p: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """The Wilson interval of a share p of n."""
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return clip(mid - half, 0.0, 1.0), clip(mid + half, 0.0, 1.0)


def effort_metrics(risk: Column, loc: Column) -> dict[str, Column]:
    """Risk per line, priority by the root of the lines, and a category (rules in order; it sees the raw line count)."""
    at_least = F.greatest(loc, F.lit(1))
    per = risk / at_least
    category = F.when((risk >= 0.7) & (loc <= 500), "HIGH_VALUE").when((risk >= 0.5) & (per >= 0.001), "EFFICIENT").when((risk >= 0.7) & (loc > 2000), "EXPENSIVE").when(risk < 0.3, "LOW_PRIORITY").otherwise("MODERATE")
    return {"risk_per_loc": per, "effort_priority": risk / F.sqrt(at_least) * 1000, "effort_category": category}


def review_effort(loc: Column) -> Column:
    return F.when(loc <= 200, "Low").when(loc <= 1000, "Medium").otherwise("High")


def zscore_ood(x: Column, mean: Column, std: Column, p99: Column) -> Column:
    return (x > 3 * p99) | (F.when(std > 0, F.abs(x - mean) / std).otherwise(0.0) > 5)


def _scaled(c: Column, top: Column) -> Column:
    return 0.5 + 0.5 * F.when(top > 0, c / top).otherwise(c)


def commit_importance(cs: DataFrame, key: str = "commit_id") -> DataFrame:
    """Weights of a change set's files from size, churn, complexity and coupling, each against its largest, adding up to 1."""
    logs = {"loc": F.log1p("loc"), "commits": F.log1p("commits"), "avg_complexity": F.col("avg_complexity"), "coupled_file_count": F.log1p("coupled_file_count")}
    tops = cs.groupBy(key).agg(*[F.max(v).alias(f"_top_{k}") for k, v in logs.items()])
    raw = F.lit(1.0)
    for k, v in logs.items():
        raw = raw * _scaled(v, F.col(f"_top_{k}"))
    x = cs.join(tops, key).withColumn("_raw", raw)
    sums = x.groupBy(key).agg(F.sum("_raw").alias("_sum"))
    return x.join(sums, key).withColumn("weight", F.col("_raw") / F.col("_sum")).drop("_raw", "_sum", *[f"_top_{k}" for k in logs])


def commit_risk(cs: DataFrame, key: str = "commit_id", method: str = "hybrid") -> DataFrame:
    """Risk of change sets: the largest, the weighted mean, or 0.6 and 0.4 of both; raised to 0.9 of the largest above 0.4 where it is under 0.8 of that."""
    per = commit_importance(cs, key).groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.max("risk").alias("max_risk"), F.sum(F.col("risk") * F.col("weight")).alias("weighted_risk"), F.max(F.when(F.col("risk") > 0.4, F.col("risk"))).alias("_high"), F.count_if(F.col("risk") > 0.4).alias("high_risk_files"))
    base = {"max": F.col("max_risk"), "weighted_mean": F.col("weighted_risk")}.get(method, 0.6 * F.col("max_risk") + 0.4 * F.col("weighted_risk"))
    boosted = F.when(F.coalesce(base < 0.8 * F.col("_high"), F.lit(False)), F.greatest(base, 0.9 * F.col("_high"))).otherwise(base)
    return per.select(key, "files", "max_risk", "weighted_risk", "high_risk_files", boosted.alias("commit_risk"))


def commit_validation(risks: DataFrame) -> DataFrame:
    """Checks of a commit's risk against its files."""
    share = F.when(F.col("max_risk") > 0, F.col("commit_risk") / F.col("max_risk")).otherwise(0.0)
    issues = F.array_compact(F.array(F.when((F.col("max_risk") > 0.4) & (share < 0.5), F.lit("below_max")), F.when((F.col("high_risk_files") > 0) & (F.col("commit_risk") < 0.3), F.lit("ignores_high")), F.when((F.col("commit_risk") < 0) | (F.col("commit_risk") > 1), F.lit("range"))))
    return risks.withColumns({"ratio_to_max": share, "issues": F.array_join(issues, ","), "is_valid": F.size(issues) == 0})


def top_contributors(cs: DataFrame, k: int = 3, key: str = "commit_id") -> DataFrame:
    """The k riskiest files of each change set, in one line of text; only k rows of a set are gathered."""
    top = top_per_group(cs, [key], [F.col("risk").desc(), F.col("file").asc()], k, "_r")
    names = F.array_sort(F.collect_list(F.struct("_r", F.col("file").cast("string").alias("name"))))
    return top.groupBy(key).agg(F.array_join(F.transform(names, lambda x: x["name"]), " | ").alias("top_files"))


CODE_ENDINGS = (".py", ".js", ".ts", ".java", ".go", ".rb", ".php", ".cs", ".cpp", ".c", ".rs", ".swift")


def pr_file_risk(name: Column, additions: Column, deletions: Column, past_bug: Column, factors: dict[str, float] | None = None) -> Column:
    changes = additions + deletions
    r = F.least(0.1 + changes / 100 * 0.5, F.lit(0.9))
    kind = F.lit(1.0)
    for ending, f in (factors or {".py": 1.2, ".js": 1.1, ".ts": 1.1, ".java": 1.15}).items():
        kind = F.when(name.endswith(ending), F.lit(f)).otherwise(kind)
    low = F.lower(name)
    r = r * kind * F.when(past_bug, 1.3).otherwise(1.0) * F.when(low.contains("test") | low.contains("spec"), 0.7).otherwise(1.0)
    r = r * F.when(changes > 1000, 1.2).when(additions > deletions * 3, 1.1).otherwise(1.0)
    return F.least(r, F.lit(0.95))


def author_level(contributions: Column, commits: Column) -> Column:
    return F.when((contributions > 1000) & (commits > 50), "SENIOR").when((contributions > 100) & (commits > 10), "MEDIUM").when(commits > 0, "JUNIOR").otherwise("NEW")


def pr_risk(files: DataFrame, key: str = "pr") -> DataFrame:
    """Rows (pr, risk, level) to one risk for each pull request, by the author's level; to ten places, so that bands do not hang on the order of sums."""
    per = files.groupBy(key).agg(F.avg("risk").alias("_mean"), F.max("level").alias("level"), F.count_if(F.col("risk") > 0.7).alias("high_risk_files"))
    factor = F.when(F.col("level") == "SENIOR", 0.9).when(F.col("level") == "JUNIOR", 1.2).otherwise(1.0)
    risk = F.round(F.least(F.col("_mean"), F.lit(0.95)) * factor, 10)
    return per.select(key, "high_risk_files", risk.alias("pr_risk"), F.when(risk >= 0.8, "HIGH").when(risk >= 0.6, "MEDIUM").otherwise("LOW").alias("pr_level"))


def ood_confidence(df: DataFrame, stats: DataFrame, columns: list[str], supported: list[str], risk: str = "risk") -> DataFrame:
    """One row of confidence in a whole prediction.

    Factors: unsupported languages 0.5; columns of which over 30 % lie beyond
    median + 3 * (p99 - p01): 0.85 for three or more, 0.95 for one or two; over half
    the files with under five commits 0.85; under 25 files 0.95. Then 0.15
    times the mean entropy is taken off, and 0.1 is the least.
    """
    wide = stats.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("median") + 3 * (F.col("p99") - F.col("p01")))).alias(f"_lim_{c}") for c in columns])
    x = df.crossJoin(F.broadcast(wide))
    one = x.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("language").isin(*supported)).alias("unsupported"),
        F.count_if(F.col("commits") < 5).alias("sparse"),
        F.avg(entropy(F.col(risk))).alias("entropy"),
        *[F.count_if(F.col(c) > F.col(f"_lim_{c}")).alias(f"_out_{c}") for c in columns],
    )
    extreme = sum((F.when(F.col(f"_out_{c}") > 0.3 * F.col("n"), 1).otherwise(0) for c in columns), F.lit(0))
    score = F.when(F.col("unsupported") > 0, 0.5).otherwise(1.0) * F.when(F.col("sparse") > 0.5 * F.col("n"), 0.85).otherwise(1.0)
    score = score * F.when(extreme >= 3, 0.85).when(extreme >= 1, 0.95).otherwise(1.0) * F.when(F.col("n") < 25, 0.95).otherwise(1.0)
    final = F.greatest(score - 0.15 * F.col("entropy"), F.lit(0.1))
    return one.select("n", "unsupported", "sparse", extreme.alias("extreme_columns"), "entropy", final.alias("confidence_score"), F.when(final > 0.75, "HIGH").when(final > 0.55, "MEDIUM").otherwise("LOW").alias("confidence_level"), (final < 0.55).alias("out_of_distribution"))
