"""Cross-project risk models: scaling, selection, training, calibration, attribution."""

from __future__ import annotations

import itertools
import json
import random
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, OneHotEncoder, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.functions.core import ratio
from defectloom.ml.neighbours import hash_ranks
from defectloom.operators import metrics as M
from defectloom.session import stored, work_folder


def scale(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less the training mean over the training deviation (divided by n); constant columns are only shifted."""
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    x = df.crossJoin(F.broadcast(stats))
    return x.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def class_weights(df: DataFrame, label: str = "buggy") -> DataFrame:
    """Weights that give both classes the same sum; they stand in for synthetic rows of the smaller class."""
    stats = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    w = F.when(F.col(label) == 1, F.col("_n") / (2 * F.greatest("_p", F.lit(1)))).otherwise(F.col("_n") / (2 * F.greatest(F.col("_n") - F.col("_p"), F.lit(1))))
    return df.crossJoin(F.broadcast(stats)).withColumn("weight", w).drop("_n", "_p")


def rebalance(df: DataFrame, rate: float = 0.2, low: float = 0.15, high: float = 0.25, key: str = "file", seed: int = 42) -> DataFrame:
    """Where the share of defects is below ``low``, keeps the clean rows that come first by hash, for a share of ``rate``.

    Rows are kept by a hash threshold, so no sort of all rows is needed; the share
    is met in expectation. Between ``low`` and ``high``, and above, all stay.
    """
    stats = df.agg(F.count(F.lit(1)).alias("_n"), F.sum("buggy").alias("_p"))
    keep = F.when(F.col("_p") < low * F.col("_n"), F.col("_p") * (1 - rate) / rate / (F.col("_n") - F.col("_p"))).otherwise(1.0)
    # eight hexadecimal digits of the hash, below the threshold's
    least = F.lpad(F.lower(F.hex(F.floor(F.least(keep, F.lit(1.0)) * float((1 << 32) - 1)).cast("long"))), 8, "0")
    u = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8)
    return df.crossJoin(F.broadcast(stats)).where((F.col("buggy") == 1) | (F.col("_p") >= low * F.col("_n")) | (u < least)).drop("_n", "_p")


# The final sizes of the models.
FINAL_SIZES = {"lr": {"maxIter": 50, "regParam": 0.01}, "rf": {"numTrees": 300, "maxDepth": 8}, "gbt": {"maxIter": 500, "maxDepth": 6, "stepSize": 0.05}}
#: What a quick run takes; the registered queries do, as their tables are small.
QUICK_SIZES = {"lr": {"maxIter": 50, "regParam": 0.01}, "rf": {"numTrees": 40, "maxDepth": 6}, "gbt": {"maxIter": 20, "maxDepth": 4}}
#: The choices of a random search.
SEARCH = {"lr": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}, "rf": {"numTrees": [100, 200, 300], "maxDepth": [4, 6, 8], "minInstancesPerNode": [1, 2, 5]}, "gbt": {"maxIter": [50, 100, 200], "maxDepth": [3, 4, 6], "stepSize": [0.01, 0.05, 0.1]}}


def classifier(kind: str, seed: int = 42, sizes: dict | None = None, categories: int = 0):
    """The classifier of a kind; trees get as many bins as the largest categorical column has ``categories``."""
    common = {"featuresCol": "features", "labelCol": "buggy", "weightCol": "weight"} | (FINAL_SIZES[kind] if sizes is None else sizes)
    if kind == "lr":
        return LogisticRegression(**common)
    common |= {"maxBins": max(32, categories), "seed": seed}
    if kind == "rf":
        return RandomForestClassifier(**common)
    if kind == "gbt":
        return GBTClassifier(**common)
    raise ValueError(kind)


def fit(train: DataFrame, columns: list[str], kind: str = "lr", seed: int = 42, sizes: dict | None = None, categorical: Sequence[str] = (), most_categories: int = 1000) -> PipelineModel:
    """Assembler (with the scaler's statistics inside the pipeline) and classifier of the final sizes or the given ones; nulls count as 0.

    ``categorical`` columns are indexed, most frequent first; null and what was
    not seen in training share one index of their own. Trees split them as
    sets, a linear model takes a column for each. A column of more than
    ``most_categories`` is refused.
    """
    stats = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(categorical)]).first()
    scaled = ", ".join(f"(coalesce(cast({c} AS double), 0D) - {float(stats[f'm{i}'] or 0)!r}D) / {float(stats[f's{i}'] or 0) or 1.0!r}D AS z_{c}" for i, c in enumerate(columns))
    most = max((stats[f"n{i}"] for i in range(len(categorical))), default=-1) + 1
    if most > most_categories:
        raise ValueError(f"a categorical column has over {most_categories} values")
    stages: list = [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")]
    inputs = [f"z_{c}" for c in columns]
    if categorical:
        indexed = [f"i_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        if kind == "lr":
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=[f"o_{c}" for c in categorical], dropLast=True, handleInvalid="keep"))
        inputs += [f"o_{c}" if kind == "lr" else f"i_{c}" for c in categorical]
    stages += [VectorAssembler(inputCols=inputs, outputCol="features"), classifier(kind, seed, sizes, most)]
    return Pipeline(stages=stages).fit(class_weights(train))


def score(model: PipelineModel, df: DataFrame, columns: list[str], excluded: Column | None = None) -> DataFrame:
    """Adds risk, the model's probability; rows that ``excluded`` names get 0."""
    p = vector_to_array("probability")[1]
    out = model.transform(df).withColumn("risk", p if excluded is None else F.when(excluded, 0.0).otherwise(p))
    return out.drop("features", "rawPrediction", "probability", "prediction", *[f"z_{c}" for c in columns], *[x for x in out.columns if x not in df.columns and x[:2] in ("i_", "o_")])


def select_features(train: DataFrame, columns: list[str], core: tuple[str, ...] = (), least: int = 5, sizes: dict | None = None) -> list[str]:
    """Features at or above the median importance of a forest, and the core ones; the ten best if fewer than ``least``."""
    importances = fit(train, columns, "rf", sizes=sizes).stages[-1].featureImportances.toArray()
    order = sorted(zip(columns, importances), key=lambda x: (-x[1], x[0]))
    middle = sorted(importances)[len(importances) // 2]
    chosen = [c for c, v in order if v >= middle or c in core]
    return chosen if len(chosen) >= least else [c for c, _ in order[:10]]


def time_folds(df: DataFrame, time: str, folds: int = 5, key: str = "file") -> list[tuple[DataFrame, DataFrame]]:
    """Pairs (train, test) in time order: the first part against the second, the first two against the third, and so on.

    Times are cut at quantiles, so rows of one time stay together.
    """
    cuts = df.agg(F.percentile(F.unix_micros(F.col(time).cast("timestamp")) if dict(df.dtypes)[time].startswith(("timestamp", "date")) else F.col(time), F.array(*[F.lit(i / (folds + 1)) for i in range(1, folds + 1)]))).first()[0]
    t = F.unix_micros(F.col(time).cast("timestamp")) if dict(df.dtypes)[time].startswith(("timestamp", "date")) else F.col(time)
    edges = [*cuts, None]
    return [(df.where(t <= edges[i]), df.where((t > edges[i]) & (t <= edges[i + 1]) if edges[i + 1] is not None else t > edges[i])) for i in range(folds)]


def random_search(df: DataFrame, columns: list[str], kind: str, time: str, n: int = 8, folds: int = 5, seed: int = 42, choices: dict | None = None, threads: int = 4) -> tuple[dict, DataFrame]:
    """The best of ``n`` random settings by mean average precision over folds in time order, and rows (setting, folds, pr_auc) of all.

    Folds without both classes are passed over. Settings are drawn without
    repeats; ties go to the one drawn first.
    """
    choices = SEARCH[kind] if choices is None else choices
    every = [dict(zip(choices, x)) for x in itertools.product(*choices.values())]
    drawn = random.Random(seed).sample(every, min(n, len(every)))
    parts = [(a, b) for a, b in time_folds(df, time, folds) if all(x.select(F.count_distinct("buggy")).first()[0] == 2 for x in (a, b))]

    def one(setting: dict) -> list[float]:
        return [M.pr_auc(score(fit(a, columns, kind, seed, setting), b, columns).select("file", "risk", "buggy")).first()["pr_auc"] for a, b in parts]

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(one, drawn))
    means = [sum(x) / len(x) if x else 0.0 for x in found]
    best = drawn[max(range(len(drawn)), key=lambda i: (means[i], -i))]
    return best, df.sparkSession.createDataFrame([(json.dumps(s, sort_keys=True), len(x), m) for s, x, m in zip(drawn, found, means)], "setting string, folds long, pr_auc double")


def fold_metrics(scored: DataFrame, keys: Sequence[str] = ("repo", "model"), threshold: float = 0.5, share: float = 0.2, tie: str = "file") -> DataFrame:
    """Rows (keys, n_test, n_buggy, f1, pr_auc, roc_auc, recall_20, composite) of scored rows (keys, file, risk, buggy), all folds in one plan.

    Measures are those of the single-table operators; a fold's rows pass a sort
    that can spill.
    """
    keys = list(keys)
    by_rank = Window.partitionBy(*keys).orderBy(F.col("risk").desc(), F.col(tie).asc())
    whole = Window.partitionBy(*keys)
    cut = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) * F.lit(share)))
    ranked = scored.withColumn("_first", F.row_number().over(by_rank) <= cut)
    flag, bug = F.col("risk") >= threshold, F.col("buggy") == 1
    plain = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"), F.sum("buggy").cast("long").alias("n_buggy"), F.count_if(flag & bug).alias("_tp"), F.count_if(flag & ~bug).alias("_fp"), F.count_if(~flag & bug).alias("_fn"), F.count_if(F.col("_first") & bug).alias("_found")
    )
    down = Window.partitionBy(*keys).orderBy(F.col("risk").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = scored.groupBy(*keys, "risk").agg(F.sum("buggy").alias("pos"), (F.count(F.lit(1)) - F.sum("buggy")).alias("neg"))
    steps = steps.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "p": F.sum("pos").over(whole), "n": F.sum("neg").over(whole)})
    curves = steps.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_pr"), F.sum(F.col("pos") * ((F.col("n") - F.col("fp")) + F.col("neg") / 2.0)).alias("_roc"), F.max("n").alias("_neg"))
    x = plain.join(curves, keys)
    pr_auc, recall = ratio(F.col("_pr"), F.col("n_buggy")), ratio(F.col("_found"), F.col("n_buggy"))
    f1 = ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn"))
    roc = F.when((F.col("n_buggy") > 0) & (F.col("_neg") > 0), F.col("_roc") / (F.col("n_buggy") * F.col("_neg")))
    return x.select(*keys, "n_test", "n_buggy", f1.alias("f1"), pr_auc.alias("pr_auc"), roc.alias("roc_auc"), recall.alias("recall_20"), (0.4 * pr_auc + 0.4 * recall + 0.2 * f1).alias("composite"))


def leave_one_out(df: DataFrame, columns: list[str], kinds: tuple[str, ...] = ("lr",), **options) -> DataFrame:
    """Rows (repo, model, n_test, n_buggy, f1, pr_auc, roc_auc, recall_20, composite) of a fold for each repository and kind; options as in :func:`ablation`."""
    return ablation(df, {"": columns}, kinds, **options).drop("feature_set")


def ablation(df: DataFrame, sets: dict[str, list[str]], kinds: tuple[str, ...] = ("lr",), repo: str = "repo", least_train: int = 10, least_test: int = 5, threads: int = 8, sizes: dict[str, dict] | None = None) -> DataFrame:
    """The rows of :func:`leave_one_out` for each set of features, with its name as ``feature_set``.

    Folds with fewer rows than the least, or without a defect to learn from, are
    passed over. The loop is over repositories, a bounded list; all folds
    run side by side on the cluster, leave their scores in the shared
    folder, and are measured together.

    What folds share is made once: a set's vectors, scaled by all rows (the
    classifiers' fits do not depend on a column's place and scale, as
    the linear one standardises by its own training rows and trees go by order), and the
    counts, from which a fold's class weights follow.
    """
    spark, folder = df.sparkSession, work_folder(df.sparkSession)
    counts = {r[repo]: (r["n"], r["b"]) for r in df.groupBy(repo).agg(F.count(F.lit(1)).alias("n"), F.sum("buggy").alias("b")).collect()}
    total, bugs = sum(n for n, _ in counts.values()), sum(b for _, b in counts.values())
    schema = f"feature_set string, repo string, model string, file {dict(df.dtypes)['file']}, risk double, buggy int"
    spark.createDataFrame([], schema).write.parquet(folder)
    every = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    label = F.col("buggy").cast("double").alias("buggy", metadata={"ml_attr": {"type": "nominal", "vals": ["0", "1"], "name": "buggy"}})
    scaled = stored(scale(df, df, every).select(F.col(repo).alias("_repo"), "file", label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in every]))
    vectors = {k: stored(VectorAssembler(inputCols=columns, outputCol="features").transform(scaled).select("_repo", "file", "buggy", "features")) for k, columns in sets.items()}

    def fold(part: str, name: str, kind: str) -> None:
        n, b = counts[name]
        if total - n < least_train or n < least_test or bugs == b:
            return
        x, n, b = vectors[part], total - n, bugs - b
        weight = F.when(F.col("buggy") == 1, n / (2 * max(b, 1))).otherwise(n / (2 * max(n - b, 1)))
        model = classifier(kind, sizes=(sizes or {}).get(kind)).fit(x.where(F.col("_repo") != name).withColumn("weight", weight))
        risk = vector_to_array("probability")[1].alias("risk")
        scored = model.transform(x.where(F.col("_repo") == name)).select(F.lit(part).alias("feature_set"), F.lit(str(name)).alias("repo"), F.lit(kind).alias("model"), "file", risk, F.col("buggy").cast("int").alias("buggy"))
        scored.write.parquet(f"{folder}/{uuid.uuid4().hex}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(lambda x: fold(*x), [(part, name, kind) for part in sets for name in sorted(counts) for kind in kinds]))
    return fold_metrics(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder), ("repo", "model", "feature_set"))


def best_architecture(folds: DataFrame, least_test: int = 30) -> DataFrame:
    """Rows (model, folds, composite, avg_f1, best): mean composite over the folds of at least ``least_test`` files (of all where none is), the highest marked; ties go to the smaller name."""
    large = F.col("n_test") >= least_test
    any_large = folds.agg(F.coalesce(F.max(large), F.lit(False)).alias("_any"))
    per = folds.crossJoin(F.broadcast(any_large)).groupBy("model").agg(F.count_if(large | ~F.col("_any")).alias("folds"), F.avg(F.when(large | ~F.col("_any"), F.col("composite"))).alias("composite"), F.avg("f1").alias("avg_f1"))
    top = per.agg(F.min(F.struct((-F.col("composite")).alias("c"), "model"))["model"].alias("_best"))
    return per.crossJoin(F.broadcast(top)).select("model", "folds", "composite", "avg_f1", (F.col("model") == F.col("_best")).alias("best"))


def holdout(df: DataFrame, share: float = 0.15, key: str = "file", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(the rest, held out): ``share`` of the rows of each class, the first by a hash of the key."""
    x = df.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / float(1 << 53))
    cuts = M.group_percentile(x, "_u", share, ["buggy"]).select(F.col("buggy").alias("_class"), F.col("value").alias("_cut"))  # a row for each class
    x = x.join(F.broadcast(cuts), F.col("buggy") == F.col("_class"), "left")
    held = F.coalesce(F.col("_u") < F.col("_cut"), F.lit(False))
    return x.where(~held).select(*df.columns), x.where(held).select(*df.columns)


def fit_calibrated(df: DataFrame, columns: list[str], kind: str = "lr", share: float = 0.15, seed: int = 42, sizes: dict | None = None):
    """A model of all rows but a stratified holdout, and the calibrator fitted on the holdout, which the model has not seen."""
    rest, held = holdout(df, share, seed=seed)
    model = fit(rest, columns, kind, seed, sizes)
    return model, calibrate(score(model, held, columns).select("file", "risk", "buggy"))


def calibrate(scored: DataFrame, least_rows: int = 50, least_positive: int = 5):
    """A transformer of ``risk`` into ``calibrated``: isotonic with enough rows and defects, else logistic."""
    n = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("buggy").alias("p")).first()
    if n["n"] >= least_rows and (n["p"] or 0) >= least_positive:
        model = IsotonicRegression(featuresCol="risk", labelCol="buggy", predictionCol="calibrated").fit(scored.withColumn("buggy", F.col("buggy").cast("double")))
        return model.transform
    steps = Pipeline(stages=[VectorAssembler(inputCols=["risk"], outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol="buggy", probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r")]).fit(scored)
    return lambda df: steps.transform(df).withColumn("calibrated", vector_to_array("_p")[1]).drop("_v", "_p", "_y", "_r")


def linear_attribution(model: PipelineModel, df: DataFrame, columns: list[str], key: str = "file") -> DataFrame:
    """Rows (key, feature, value): coefficient times scaled value, exact for a linear model with independent features."""
    w = model.stages[-1].coefficients.toArray()
    z = model.stages[0].transform(df)
    return z.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(w[i])) * F.col(f"z_{c}")).alias("value")) for i, c in enumerate(columns)])).alias("x")).select(key, "x.*")


def occlusion_attribution(model: PipelineModel, df: DataFrame, columns: list[str], means: dict[str, float], key: str = "file") -> DataFrame:
    """Rows (key, feature, value): how much the risk falls when a feature takes its mean; for any model, in one pass of scoring."""
    many = df.withColumn("_f", F.explode(F.array(F.lit(""), *[F.lit(c) for c in columns])))
    changed = many.withColumns({c: F.when(F.col("_f") == c, F.lit(float(means[c]))).otherwise(F.col(c).cast("double")) for c in columns})
    risks = score(model, changed, columns).select(key, "_f", "risk")
    base = risks.where("_f = ''").select(key, F.col("risk").alias("base"))
    return risks.where("_f <> ''").join(base, key).select(key, F.col("_f").alias("feature"), (F.col("base") - F.col("risk")).alias("value"))


def counterfactual(attributions: DataFrame, least: float = 0.005, n: int = 3, key: str = "file") -> DataFrame:
    """The n features whose return to the mean lowers the risk most, if by more than ``least``."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "feature"))), 1, n)
    return attributions.where(F.col("value") > least).groupBy(key).agg(F.transform(top, lambda x: x["feature"]).alias("features"))


def explain_text(attributions: DataFrame, phrases: dict[str, str], risks: DataFrame, n: int = 3, first: int = 9, key: str = "file") -> DataFrame:
    """Up to n phrases of the ``first`` features by size of attribution, joined by " | "; by risk alone where none has a phrase."""
    said = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("value")).alias("v"), "feature"))), 1, first)
    words = F.slice(F.array_compact(F.transform(top, lambda x: F.try_element_at(said, x["feature"]))), 1, n)
    text = attributions.groupBy(key).agg(F.array_join(words, " | ").alias("t"))
    general = F.when(F.col("risk") >= 0.7, "high overall risk").when(F.col("risk") >= 0.4, "moderate overall risk").otherwise("low overall risk")
    return risks.join(text, key, "left").select(key, F.when(F.length("t") > 0, F.col("t")).otherwise(general).alias("explanation"))


def stratified_split(df: DataFrame, by: str, share: float = 0.2, key: str = "commit_id", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(the rest, held out): of every class exactly ``share`` of its rows, rounded down, the first in hash order; a null class is one."""
    ranked = stored(hash_ranks(df, key, [by], seed, "_rank"))
    sizes = ranked.groupBy(F.col(by).alias("_by")).agg(F.floor(F.count(F.lit(1)) * float(share)).alias("_held"))  # a row for each class
    x = ranked.join(F.broadcast(sizes), F.col(by).eqNullSafe(F.col("_by")))
    held = F.col("_rank") <= F.col("_held")
    return x.where(~held).select(*df.columns), x.where(held).select(*df.columns)


def class_report(predicted: DataFrame, label: str = "bug_type", said: str = "predicted") -> DataFrame:
    """Rows (label, n, precision, recall, f1, macro_f1) for each class that is a label or a prediction; a share of nothing is 0, and macro_f1 is the mean over the classes."""
    cells = predicted.groupBy(F.col(label).alias("_a"), F.col(said).alias("_b")).agg(F.count(F.lit(1)).alias("k"))  # classes by classes
    each = cells.select(F.explode(F.array(F.struct(F.col("_a").alias("c"), F.col("k").alias("n"), F.lit(0).cast("long").alias("p"), F.when(F.col("_a") == F.col("_b"), F.col("k")).otherwise(0).alias("hit")), F.struct(F.col("_b").alias("c"), F.lit(0).cast("long").alias("n"), F.col("k").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    sums = each.where(F.col("c").isNotNull()).groupBy(F.col("c").alias(label)).agg(*[F.sum(x).alias(x) for x in ("n", "p", "hit")])
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.select(label, "n", share(F.col("hit"), F.col("p")).alias("precision"), share(F.col("hit"), F.col("n")).alias("recall"), share(2 * F.col("hit"), F.col("n") + F.col("p")).alias("f1"))
    return out.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy()))  # a row for each class


def predicted_types(model: PipelineModel, messages: DataFrame) -> DataFrame:
    """``messages`` with the class that a :func:`text_model` predicts, by its name."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = PipelineModel(model.stages[1:]).transform(messages)  # without the stage that indexes labels
    return out.select(*messages.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def text_model(messages: DataFrame, text: str = "msg", label: str = "bug_type", vocabulary: int = 1000) -> PipelineModel:
    """Class of a message from weighted words and word pairs.

    Texts are cut into words twice, for the vocabulary and for their counts of it; these are stored,
    and weights and classes are learnt from them.
    """
    x, stages = messages, []
    words = [
        StringIndexer(inputCol=label, outputCol="buggy", handleInvalid="skip"),
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+"),
        StopWordsRemover(inputCol="_w", outputCol="_k"),
        NGram(n=2, inputCol="_k", outputCol="_n"),
        SQLTransformer(statement="SELECT *, concat(_k, _n) AS _t FROM __THIS__"),
    ]
    for stage in words:
        stages.append(stage.fit(x) if hasattr(stage, "fit") else stage)
        x = stages[-1].transform(x)
    # the most frequent ones, counted by an aggregate that can spill; CountVectorizer.fit keeps a map of objects for each text
    common = x.select(F.explode("_t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "w").limit(vocabulary)
    stages.append(CountVectorizerModel.from_vocabulary([r["w"] for r in common.collect()], inputCol="_t", outputCol="_c"))
    x = stages[-1].transform(x)
    counts = stored(x.select("buggy", "_c"))
    rest = Pipeline(stages=[IDF(inputCol="_c", outputCol="features"), LogisticRegression(featuresCol="features", labelCol="buggy", maxIter=20)]).fit(counts)
    return PipelineModel([*stages, *rest.stages])
