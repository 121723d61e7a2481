"""Models over labelled documents and stored results over events; most are checked by their rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectloom.functions import text as X
from defectloom.functions.core import r6
from defectloom.ml import models as ML
from defectloom.ml import resample as RS
from defectloom.ml import tree_attribution as TA
from defectloom.operators import features as FT
from defectloom.operators import history as H
from defectloom.plans.bindings import LABELLED, commit_files, labelled, messages, source_text, static_metrics, table
from defectloom.plans.predicates import _TYPES
from defectloom.plans.registry import ORACLE_SQL, query
from defectloom.session import stored
from defectloom.sources import caches as C

_LB = f"WITH {LABELLED}"
_COLS = ["loc", "functions", "avg_complexity", "max_complexity"]
_SIZES = ML.QUICK_SIZES


def _projects(spark, d):
    """The labelled documents, a project for each source; stored, as a model reads them many times."""
    return stored(labelled(spark, d).select("repo", "file", "buggy", *_COLS))


def _with_history(spark, d):
    """The labelled documents with the history of the part of the same number, in all groups of features."""
    cf = commit_files(spark, d)
    hist = H.history_features(cf).drop("repo")
    zero = [c for c in hist.columns if c != "file"]
    x = FT.build_features(FT.static_left_history(static_metrics(spark, d), hist, ["file"], zero))
    x = x.join(labelled(spark, d).select("file", "buggy"), "file")
    groups = (FT.STATIC_FEATURES, FT.GIT_FEATURES, FT.DEVELOPER_FEATURES, FT.TEMPORAL_FEATURES, FT.COUPLING_FEATURES, FT.BURST_FEATURES)
    return stored(x.select("repo", "file", "buggy", *[c for g in groups for c in g if c in x.columns]))


@query(f"{_LB}, s AS (SELECT avg(loc) AS m1, stddev_pop(loc) AS s1, avg(functions) AS m2, stddev_pop(functions) AS s2 FROM lb WHERE file % 2 = 0) SELECT file, round((loc - m1) / s1, 6) AS loc, round((functions - m2) / s2, 6) AS functions FROM lb, s WHERE file % 2 = 1")
def scale(spark, d):
    x = labelled(spark, d).select("file", "loc", "functions")
    return ML.scale(x.where("file % 2 = 0"), x.where("file % 2 = 1"), ["loc", "functions"]).withColumns({c: r6(F.col(c)) for c in ("loc", "functions")})


@query(f"{_LB}, c AS (SELECT count(*) AS n, sum(buggy) AS p FROM lb) SELECT file, round(CASE WHEN buggy = 1 THEN n / (2.0::DOUBLE * p) ELSE n / (2.0::DOUBLE * (n - p)) END, 6) AS weight FROM lb, c")
def resample(spark, d):
    return ML.class_weights(labelled(spark, d)).select("file", r6(F.col("weight")).alias("weight"))


_DIST = "pow(a.loc - b.loc, 2) + pow(a.functions - b.functions, 2) + pow(a.avg_complexity - b.avg_complexity, 2) + pow(a.max_complexity - b.max_complexity, 2)"
_BETWEEN = ", ".join(f"s.{c} + gap * (t.{c} - s.{c}) AS {c}" for c in _COLS)


@query(
    f"""{_LB}, x AS (SELECT file, buggy, {", ".join(f"{c}::DOUBLE AS {c}" for c in _COLS)} FROM lb),
    c AS (SELECT least(count(*) FILTER (WHERE buggy = 1), count(*) FILTER (WHERE buggy = 0)) AS few, greatest(count(*) FILTER (WHERE buggy = 1), count(*) FILTER (WHERE buggy = 0)) AS many,
          CASE WHEN count(*) FILTER (WHERE buggy = 1) <= count(*) FILTER (WHERE buggy = 0) THEN 1 ELSE 0 END AS value FROM x),
    small AS (SELECT x.*, row_number() OVER (ORDER BY md5('42:' || file)) AS rank FROM x, c WHERE buggy = value),
    pairs AS (SELECT a.file AS base, b.file AS other, row_number() OVER (PARTITION BY a.file ORDER BY {_DIST}, b.file::VARCHAR) AS r FROM small a JOIN small b ON a.file <> b.file),
    near AS (SELECT base, list(other ORDER BY r) AS ids FROM pairs, c WHERE r <= least(5, few - 1) GROUP BY base),
    copies AS (SELECT file AS base, unnest(range(1, ((many - few) // few + CASE WHEN rank <= (many - few) % few THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy FROM small, c WHERE few > 1),
    h AS (SELECT base, copy, md5('42:' || base || ':' || copy) AS h FROM copies),
    picked AS (SELECT h.base, copy, ids[('0x' || substr(h, 1, 8))::BIGINT % len(ids) + 1] AS other, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE AS gap FROM h JOIN near USING (base)),
    made AS (SELECT '1:' || picked.base || ':' || copy AS row, s.buggy, true AS synthetic, {_BETWEEN} FROM picked JOIN small s ON s.file = picked.base JOIN small t ON t.file = other),
    told AS (SELECT '0:' || file AS row, buggy, false AS synthetic, {", ".join(_COLS)} FROM x UNION ALL SELECT * FROM made),
    one AS (SELECT a.row, a.buggy, b.row AS other, b.buggy AS other_buggy, row_number() OVER (PARTITION BY a.row ORDER BY {_DIST}, b.row) AS r FROM told a JOIN told b ON a.row <> b.row),
    nearest AS (SELECT row, buggy, other, other_buggy FROM one WHERE r = 1),
    linked AS (SELECT a.row FROM nearest a JOIN nearest b ON a.other = b.row AND b.other = a.row WHERE a.buggy <> a.other_buggy)
    SELECT row, buggy, synthetic, {", ".join(f"round({c}, 6) AS {c}" for c in _COLS)} FROM told WHERE row NOT IN (SELECT row FROM linked)"""
)
def smote_tomek(spark, d):
    """Both classes equally large by synthetic rows between neighbours, then without Tomek links."""
    x = stored(labelled(spark, d).select("file", "buggy", *_COLS))
    out = RS.smote_tomek(x, _COLS).withColumn("row", RS.row_id())
    return out.select("row", "buggy", "synthetic", *[r6(F.col(c)).alias(c) for c in _COLS])


@query(f"{_LB}, c AS (SELECT count(*) AS n, sum(buggy) AS p FROM lb) SELECT file, buggy FROM lb, c WHERE buggy = 1 OR p >= 0.15 * n OR substr(md5('42:' || file), 1, 8) < printf('%08x', floor(least(p * (1 - 0.2::DOUBLE) / 0.2::DOUBLE / (n - p), 1.0) * 4294967295.0)::BIGINT)")
def rebalance_target_rate(spark, d):
    return ML.rebalance(labelled(spark, d)).select("file", "buggy")


@query()
def select_features(spark, d):
    return spark.createDataFrame([(c,) for c in ML.select_features(_projects(spark, d), _COLS, ("loc",), 2, _SIZES["rf"])], "feature string")


def _parted(spark, d):
    """The labelled files but a quarter of each class, and that quarter, which models score without having seen it."""
    return ML.stratified_split(_projects(spark, d), "buggy", 0.25, "file")


def _scored_by(kind):
    def f(spark, d):
        """Scores of the held-out files by a model of all others."""
        rest, held = _parted(spark, d)
        return ML.score(ML.fit(rest, _COLS, kind, sizes=_SIZES[kind]), held, _COLS, F.col("loc") <= 1).select("file", "buggy", "risk")

    return f


for _kind in ("lr", "rf", "gbt"):
    query(name=_kind)(_scored_by(_kind))


@query()
def score(spark, d):
    """Scores of the held-out files, those of a single line excluded."""
    rest, held = _parted(spark, d)
    return ML.score(ML.fit(rest, _COLS), held, _COLS, F.col("loc") <= 1).select("file", "risk")


#: Settings of the search that the registered query makes; the default ones are larger.
_SEARCH = {"numTrees": [10, 20, 40], "maxDepth": [4, 6, 8], "minInstancesPerNode": [1, 2, 5]}


@query()
def random_search(spark, d):
    """Average precision of random forests over folds in the order of ids, which stand for time."""
    return ML.random_search(_projects(spark, d), _COLS, "rf", "file", 6, 3, choices=_SEARCH)[1]


@query()
def lopo_cv(spark, d):
    """A fold for each source and architecture."""
    return ML.leave_one_out(_projects(spark, d), _COLS, ("lr", "rf"), sizes=_SIZES)


@query()
def best_architecture(spark, d):
    """The architecture whose folds are best."""
    return ML.best_architecture(ML.leave_one_out(_projects(spark, d), _COLS, ("lr", "rf"), sizes=_SIZES))


@query()
def ablation(spark, d):
    """Eight sets of features, two architectures, and a fold for each source with 25 labelled files, fewer than which a mean tells little."""
    x = _with_history(spark, d)
    return ML.ablation(x, FT.feature_sets(x), ("lr", "rf"), least_test=25, sizes=_SIZES)


@query()
def calibrate(spark, d):
    """Risks of all files, calibrated on a holdout that the model has not seen."""
    x = _projects(spark, d)
    model, calibrated = ML.fit_calibrated(x, _COLS, sizes=_SIZES["lr"])
    return calibrated(ML.score(model, x, _COLS).select("file", "risk")).select("file", "risk", "calibrated")


@query()
def shap(spark, d):
    x = _projects(spark, d)
    return ML.linear_attribution(ML.fit(x, _COLS), x, _COLS)


def _tree_shap(kind):
    def f(spark, d):
        """Shapley values of the tree model's features for every file, and the base to which they add up."""
        x = _projects(spark, d)
        return TA.tree_attribution(ML.fit(x, _COLS, kind, sizes=_SIZES[kind]), x, _COLS)

    return f


for _kind in ("rf", "gbt"):
    query(name=f"tree_shap_{_kind}")(_tree_shap(_kind))


@query()
def counterfactual(spark, d):
    x = _projects(spark, d)
    means = x.agg(*[F.avg(c).alias(c) for c in _COLS]).first().asDict()
    return ML.counterfactual(ML.occlusion_attribution(ML.fit(x, _COLS, "rf", sizes=_SIZES["rf"]), x, _COLS, means))


@query()
def explain_text(spark, d):
    x = _projects(spark, d)
    m = ML.fit(x, _COLS)
    phrases = {"loc": "many lines", "functions": "many functions", "avg_complexity": "complex on average", "max_complexity": "very complex part"}
    return ML.explain_text(ML.linear_attribution(m, x, _COLS), phrases, ML.score(m, x, _COLS).select("file", "risk"))


def _typed_messages(spark, d):
    """The messages that have a class by their words; stored, as a model reads them many times."""
    x = messages(spark, d).withColumn("bug_type", X.bug_type(F.col("msg"), _TYPES))
    return stored(x).where("bug_type IS NOT NULL")  # after storing: a filter before would search the texts once more


def _held_out_types(spark, d):
    rest, held = ML.stratified_split(_typed_messages(spark, d), "bug_type")
    return ML.predicted_types(ML.text_model(rest), held)


@query()
def bug_type_model(spark, d):
    """The classes of held-out messages, a fifth of each class, by a model of the others."""
    return _held_out_types(spark, d).select("commit_id", "bug_type", "predicted")


@query()
def bug_type_report(spark, d):
    """Precision, recall and F1 of each class on the held-out messages, and their mean."""
    return ML.class_report(_held_out_types(spark, d))


@query(f"WITH t AS (SELECT commit_id, bug_type FROM ({ORACLE_SQL['bug_type']}) WHERE bug_type IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY bug_type ORDER BY md5('42:' || commit_id)) AS rank, count(*) OVER (PARTITION BY bug_type) AS n FROM t) SELECT commit_id, bug_type FROM r WHERE rank <= floor(n * 0.2::DOUBLE)")
def text_holdout(spark, d):
    """A fifth of each class, exactly, in hash order."""
    return ML.stratified_split(_typed_messages(spark, d), "bug_type")[1].select("commit_id", "bug_type")


@query()
def gbt_categorical(spark, d):
    """Scores of all files by boosted trees that split their languages as sets."""
    x = stored(labelled(spark, d).select("repo", "file", "buggy", "language", *_COLS))
    return ML.score(ML.fit(x, _COLS, "gbt", sizes=_SIZES["gbt"], categorical=["language"]), x, _COLS).select("file", "risk")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def read_ttl_cache(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    return C.fresh(e.crossJoin(F.broadcast(now)), "ts", F.col("now")).select("event_id")


@query("SELECT event_id, event_type, value FROM events WHERE ts = (SELECT max(ts) FROM events) ORDER BY event_id LIMIT 1")
def read_training_log_last(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.struct("ts", (-F.col("event_id")).alias("neg")).alias("timestamp"))
    return C.last_log_line(e).select("event_id", "event_type", "value")


@query("SELECT substr(url, 1, instr(url, '/') - 1) AS hash, substr(url, instr(url, '/') + 1) AS subject FROM pages WHERE instr(url, '/') > 0")
def git_log_subjects(spark, d):
    return C.split_subjects(table(spark, d, "pages").select(F.col("url").alias("value")), "value", "/")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 2, 3) OR s_nationkey IS NULL ORDER BY s_suppkey LIMIT 20")
def list_repos(spark, d):
    """Repositories of the wanted or no language, the first twenty."""
    return table(spark, d, "supplier").where(F.col("s_nationkey").isin(1, 2, 3) | F.col("s_nationkey").isNull()).orderBy("s_suppkey").limit(20).select("s_suppkey")


@query("SELECT o_custkey AS author, least(count(*), 100) AS repo_commits FROM orders GROUP BY o_custkey")
def fetch_author_history(spark, d):
    """Commits of each author as far as one page of a hundred tells."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.least(F.count(F.lit(1)), F.lit(100).cast("long")).alias("repo_commits"))


@query("WITH x AS (SELECT doc_id, n_chars % 8 AS n, (doc_id + n_chars) % 9 AS d FROM documents) SELECT 'doc' || doc_id || '.py' AS path, 'py' AS language, n * (d + 2) AS loc, n AS functions, CASE WHEN n > 0 THEN d + 1 ELSE 0 END::DOUBLE AS avg_complexity, CASE WHEN n > 0 THEN d + 1 ELSE 0 END AS max_complexity, CASE WHEN n > 0 THEN d ELSE 0 END::INTEGER AS max_nesting_depth, least(n, 5) AS n_top FROM x")
def static_metrics_of_source(spark, d):
    """Static metrics of sources with functions and branches by the documents' numbers and lengths, and their texts as comments."""
    from defectloom.sources.source_tree import measured

    x = table(spark, d, "documents").withColumns({"_n": F.col("n_chars") % 8, "_d": (F.col("doc_id") + F.col("n_chars")) % 9})
    x = measured(x.select(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".py")).alias("path"), source_text(F.col("_n"), F.col("_d"), F.col("text")).alias("source")))
    return x.select("path", "language", "loc", "functions", "avg_complexity", "max_complexity", "max_nesting_depth", F.size("top_functions").cast("long").alias("n_top"))
