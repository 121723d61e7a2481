"""The feature row of a file from its static metrics and its history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectloom.functions.core import ratio
from defectloom.operators.ranking import top_per_group

# Results depend on these very numbers.
LANGUAGE_IDS = {"python": 0, "javascript": 1, "typescript": 2, "java": 3, "go": 4, "ruby": 5, "php": 6, "csharp": 7, "cpp": 8, "rust": 9, "other": 10}
COMPLEXITY_BASELINES = {"python": 3.5, "javascript": 3.8, "typescript": 3.8, "java": 5.5, "go": 4.0, "ruby": 3.5, "other": 4.0}
NAMES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java"}
MAX_AGE_DAYS = 3650


def _lookup(c: Column, table: dict, otherwise) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(otherwise))


def language_id(c: Column, mode: str = "extension", ids: dict[str, int] | None = None) -> Column:
    """``extension`` takes the language as it stands, so most are "other"; ``name`` maps extensions to names first."""
    name = _lookup(c, NAMES, "other") if mode == "name" else c
    return _lookup(name, ids or LANGUAGE_IDS, 10)


def complexity_vs_baseline(cx: Column, language: Column, baselines: dict[str, float] | None = None) -> Column:
    return cx / _lookup(language, baselines or COMPLEXITY_BASELINES, 4.0)


def age_bucket(age: Column) -> Column:
    a = F.least(age, F.lit(MAX_AGE_DAYS))
    return F.when(a < 180, 0).when(a < 365, 1).when(a < 730, 2).otherwise(3)


def experience_score(authors: Column) -> Column:
    """A file without history counts as one author's."""
    a = F.coalesce(authors, F.lit(1))
    return F.when(a == 1, 1.0).when(a <= 3, 0.7).otherwise(0.3)


def static_left_history(static: DataFrame, history: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """Static rows keep; history is 0 where a file has none."""
    return static.join(history, key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def build_features(j: DataFrame, baselines: dict[str, float] | None = None, ids: dict[str, int] | None = None) -> DataFrame:
    """Ratios of a joined row (loc, functions, avg_complexity, language; commits, lines_added, …); divisors are at least 1."""
    one = F.lit(1)
    commits, loc, fns = F.greatest("commits", one), F.greatest("loc", one), F.greatest("functions", one)
    churn = F.col("lines_added") + F.col("lines_deleted")
    since, age = F.least("days_since_last_change", F.lit(MAX_AGE_DAYS)), F.least("file_age", F.lit(MAX_AGE_DAYS))
    return j.withColumns(
        {
            "language_id": language_id(F.col("language"), ids=ids),
            "complexity_vs_baseline": complexity_vs_baseline(F.col("avg_complexity"), F.col("language"), baselines),
            "complexity_density": F.col("avg_complexity") / loc,
            "complexity_per_function": F.col("avg_complexity") / fns,
            "loc_per_function": F.col("loc") / fns,
            "recent_churn_ratio": F.col("commits_1m") / commits,
            "recent_activity_score": ratio(F.col("commits_2w"), F.col("commits_3m")),
            "instability_score": churn / loc,
            "avg_commit_size": churn / commits,
            "max_commit_ratio": ratio(F.col("max_added"), churn / commits),
            "file_age_bucket": age_bucket(F.col("file_age")),
            "recency_ratio": since / (age + 1),
            "churn_ratio": churn / loc,
            "author_entropy": F.col("minor_contributor_ratio"),
            "experience_score": experience_score(F.when(F.col("author_count") > 0, F.col("author_count"))),
        }
    )


def function_rollup(fns: DataFrame, key: list[str]) -> DataFrame:
    """Function rows (cx, length, params, nloc) to file metrics."""
    return fns.groupBy(*key).agg(F.avg("cx").alias("avg_complexity"), F.max("cx").alias("max_complexity"), F.count(F.lit(1)).alias("functions"), F.avg("params").alias("avg_params"), F.max("length").alias("max_function_length"), (F.sum("cx") / F.greatest(F.sum("length"), F.lit(1))).alias("complexity_density"))


def top_functions(fns: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The n most complex functions of each file, longer then smaller names first on ties; only n rows of a file are gathered."""
    top = top_per_group(fns, key, [F.col("cx").desc(), F.col("length").desc(), F.col("name").asc()], n, "_r")
    names = F.array_sort(F.collect_list(F.struct("_r", F.col("name").cast("string").alias("name"))))
    return top.groupBy(*key).agg(F.array_join(F.transform(names, lambda x: x["name"]), ",").alias("top_functions"))


# The groups of features that an ablation compares.
STATIC_FEATURES = ("loc", "avg_complexity", "max_complexity", "functions", "avg_params", "max_function_length", "complexity_vs_baseline", "complexity_density", "complexity_per_function", "loc_per_function")
GIT_FEATURES = ("commits", "lines_added", "lines_deleted", "max_added", "churn_ratio", "recent_churn_ratio", "recent_activity_score", "instability_score", "avg_commit_size", "max_commit_ratio")
DEVELOPER_FEATURES = ("author_count", "ownership", "low_history_flag", "minor_contributor_ratio", "author_entropy", "experience_score")
TEMPORAL_FEATURES = ("file_age_bucket", "days_since_last_change", "recency_ratio")
COUPLING_FEATURES = ("max_coupling_strength", "coupled_file_count", "coupled_recent_missing", "coupling_risk")
BURST_FEATURES = ("commit_burst_score", "recent_commit_burst", "burst_ratio", "burst_risk")


def feature_sets(df: DataFrame, exclude: Sequence[str] = ("buggy", "repo", "file", "confidence")) -> dict[str, list[str]]:
    """The eight sets of an ablation, each with the numeric features that ``df`` has."""
    have = numeric_features(df, exclude)
    sets = {name: [c for c in group if c in have] for name, group in (("Static-only", STATIC_FEATURES), ("Git-only", GIT_FEATURES), ("Developer-only", DEVELOPER_FEATURES), ("Temporal-only", TEMPORAL_FEATURES), ("Coupling-only", COUPLING_FEATURES), ("Burst-only", BURST_FEATURES))}
    return sets | {"Static+Git": sets["Static-only"] + sets["Git-only"], "All-Combined": have}


def numeric_features(df: DataFrame, exclude) -> list[str]:
    """Numeric columns that are not excluded, in order."""
    return [c for c, t in df.dtypes if c not in set(exclude) and t in ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint")]


def project_features(df: DataFrame, wanted: list[str], medians: dict[str, float] | None = None) -> DataFrame:
    """The wanted columns in order, missing ones and nulls as their median or 0."""
    medians = medians or {}
    return df.select(*[F.coalesce(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double"), F.lit(float(medians.get(c, 0.0)))).alias(c) for c in wanted])


def correlations(df: DataFrame, columns: list[str], label: str | None = None) -> DataFrame:
    """Rows (a, b, r) for each pair of columns, and with the label: |Pearson|, all in one pass; null on a constant column."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]] + ([(c, label) for c in columns] if label else [])

    def pearson(a: str, b: str) -> Column:
        # the built-in divides by zero where a column is constant
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        return F.abs(F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))))

    one = df.agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def correlation_prune(df: DataFrame, columns: list[str], label: str, limit: float = 0.97, keep: tuple[str, ...] = ()) -> list[str]:
    """Columns left after greedy pruning, left to right: of a pair above the limit the one less correlated with the label goes, the second on ties; constant columns go first.

    The matrix has one row per pair of columns, so the loop on the driver does not grow with the data.
    """
    r = {(x["a"], x["b"]): x["r"] for x in correlations(df, columns, label).collect()}
    spread = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    left = [c for c in columns if c in keep or (spread[c] or 0) > 1e-12]
    gone: set[str] = set()
    for i, a in enumerate(left):
        for b in left[i + 1 :]:
            if a in gone:
                break
            if b in gone or (r.get((a, b)) or 0) <= limit:
                continue
            drop = b if (r[a, label] or 0) >= (r[b, label] or 0) else a
            if drop in keep:
                drop = a if drop == b else b
            if drop not in keep:
                gone.add(drop)
    return [c for c in left if c not in gone]
