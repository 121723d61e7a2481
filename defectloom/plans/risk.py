"""Risk, ranking, evaluation, reports and checks over scored documents, and change sets over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectloom.functions.core import r6
from defectloom.operators import metrics as M
from defectloom.operators import quality as Q
from defectloom.operators import ranking as R
from defectloom.operators import reports as RP
from defectloom.operators import risk as K
from defectloom.plans.bindings import COMMIT_FILES, LABELLED, PART_FILES, PATHS, SCORED, commit_files, labelled, part_files, scored, table, url_paths
from defectloom.plans.registry import query
from defectloom.session import stored, work_folder
from defectloom.sources import caches as C

_SC, _LB, _CS, _PT = (f"WITH {x}" for x in (SCORED, LABELLED, PART_FILES, PATHS))


def _r(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


# ---- tiers and ranks

_LEVEL = "CASE WHEN risk >= 0.8 THEN 'CRITICAL' WHEN risk >= 0.6 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MODERATE' ELSE 'LOW' END"


@query(f"{_SC} SELECT file, {_LEVEL} AS level FROM sc")
def risk_level_abs(spark, d):
    return scored(spark, d).select("file", K.risk_level_abs(F.col("risk")).alias("level"))


_Z = "1.959964::DOUBLE"
_HALF = f"{_Z} * sqrt(risk * (1 - risk) / n + {_Z} * {_Z} / (4.0::DOUBLE * n * n)) / (1 + {_Z} * {_Z} / n)"
_MID = f"(risk + {_Z} * {_Z} / (2.0::DOUBLE * n)) / (1 + {_Z} * {_Z} / n)"
_PERCENT = "printf('%.1f%%', round({} * 100, 1))"
_BAND_SQL = "CASE WHEN risk >= 0.8 THEN 'Very High' WHEN risk >= 0.6 THEN 'High' WHEN risk >= 0.4 THEN 'Moderate' WHEN risk >= 0.2 THEN 'Low' ELSE 'Very Low' END AS band, CASE WHEN risk >= 0.7 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity"


@query(
    f"""{_SC}, x AS (SELECT *, loc::DOUBLE AS n FROM sc), y AS (SELECT *, {_PERCENT.format('risk')} || CASE WHEN n > 10 THEN ' (' || {_PERCENT.format(f'greatest(0.0::DOUBLE, {_MID} - {_HALF})')} || '-' || {_PERCENT.format(f'least(1.0::DOUBLE, {_MID} + {_HALF})')} || ' range)' ELSE '' END AS s FROM x)
    SELECT file, {_BAND_SQL}, CASE WHEN risk >= 0.8 THEN 'Critical risk: ' || s || ' - Immediate review required' WHEN risk >= 0.6 THEN 'High risk: ' || s || ' - Prioritize for review' WHEN risk >= 0.4 THEN 'Moderate risk: ' || s || ' - Consider for review'
      WHEN risk >= 0.2 THEN 'Low risk: ' || s || ' - Monitor if changes planned' ELSE 'Minimal risk: ' || s || ' - Low priority' END AS said FROM y"""
)
def risk_interpretation(spark, d):
    """The number of lines stands for the size of the sample."""
    r, n = F.col("risk"), F.col("loc").cast("double")
    return scored(spark, d).select("file", K.risk_interpretation(r).alias("band"), K.severity_token(r).alias("severity"), K.risk_text(r, n).alias("said"))


_LISTED = f"""WITH {COMMIT_FILES}, li AS (SELECT file, count(*) AS commits, sum(added + deleted) AS churn, max(commit_time) AS last, count(*) / (count(*) + 20.0::DOUBLE) AS risk FROM cf GROUP BY file),
  an AS (SELECT max(last) AS now FROM li), fl AS (SELECT *, floor((epoch_us(now) - epoch_us(last)) / 86400000000.0)::BIGINT AS days_since_last_change FROM li, an)"""


def _listed(spark, d):
    """Files with what a list shows of them; the share of commits stands for their risk, the last change of all for now."""
    from defectloom.functions.core import days

    x = commit_files(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.max("commit_time").alias("last"))
    x = x.withColumn("risk", F.col("commits") / (F.col("commits") + 20.0)).crossJoin(F.broadcast(x.agg(F.max("last").alias("now"))))
    return x.withColumn("days_since_last_change", days(F.col("last"), F.col("now")))


@query(f"{_LISTED} SELECT file FROM fl WHERE last >= now - INTERVAL 90 DAY AND contains(file::VARCHAR, '1') AND {_LEVEL} = 'HIGH'")
def ui_filters(spark, d):
    """Files changed within ninety days, with a 1 in their name, of one tier."""
    hit = K.recent(F.col("last"), F.col("now"), 90) & F.lower(F.col("file").cast("string")).contains("1") & (K.risk_level_abs(F.col("risk")) == "HIGH")
    return _listed(spark, d).where(hit).select("file")


@query(
    f"""{_LISTED}, ra AS (SELECT file, unnest(['risk', 'commits', 'churn', 'recency']) AS sort, unnest([row_number() OVER (ORDER BY risk DESC, file), row_number() OVER (ORDER BY commits DESC, file),
    row_number() OVER (ORDER BY churn DESC, file), row_number() OVER (ORDER BY days_since_last_change, file)])::INTEGER AS position FROM fl) SELECT sort, file, position FROM ra WHERE position <= 500"""
)
def ui_sort(spark, d):
    """The first page of the list in each of its orders."""
    x = stored(_listed(spark, d))
    out = None
    for by in R.SORTS:
        page = R.sorted_list(x, by).select(F.lit(by).alias("sort"), "file", "position")
        out = page if out is None else out.unionByName(page)
    return out


@query(f"{_SC} SELECT file, round(risk, 6) AS risk FROM sc ORDER BY sc.risk DESC, file LIMIT 10")
def topn_global(spark, d):
    return _r(scored(spark, d).orderBy(F.col("risk").desc(), "file").limit(10).select("file", "risk"), "risk")


@query(f"""{_SC}, w AS (SELECT repo, file, row_number() OVER (PARTITION BY repo ORDER BY risk DESC, file) AS rank, count(*) OVER (PARTITION BY repo) AS n FROM sc)
SELECT repo, file, rank::INTEGER AS rank, CASE WHEN rank <= ceil(0.1::DOUBLE * n) THEN 'CRITICAL' WHEN rank <= ceil(0.25::DOUBLE * n) THEN 'HIGH' WHEN rank <= ceil(0.5::DOUBLE * n) THEN 'MODERATE' ELSE 'LOW' END AS risk_tier, round(rank / n::DOUBLE, 6) AS risk_percentile FROM w""")
def tier_by_repo_rank(spark, d):
    return _r(R.tier_by_repo_rank(scored(spark, d)).select("repo", "file", "rank", "risk_tier", "risk_percentile"), "risk_percentile")


_PCT = "SELECT " + ", ".join(f"quantile_cont(risk, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM sc"


@query(f"{_SC}, p AS ({_PCT}) SELECT " + ", ".join(f"round(p{p}, 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM p")
def risk_percentiles(spark, d):
    return _r(R.risk_percentiles(scored(spark, d)), "p10", "p25", "p50", "p75", "p90")


_TIERED = f"{_SC}, p AS ({_PCT}), ti AS (SELECT sc.*, CASE WHEN risk >= p90 THEN 'CRITICAL' WHEN risk >= p75 THEN 'HIGH' WHEN risk >= p50 THEN 'MODERATE' ELSE 'LOW' END AS risk_tier, (risk >= p75)::INTEGER AS risky FROM sc, p)"


@query(f"{_TIERED} SELECT file, risk_tier, risky FROM ti")
def tier_by_percentile(spark, d):
    return R.tier_by_percentile(scored(spark, d)).select("file", "risk_tier", "risky")


@query(f"{_TIERED} SELECT risk_tier, count(*) AS files, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ti), 6) AS percent, round(avg(risk), 6) AS avg_risk, round(avg(loc), 6) AS avg_loc, sum(loc)::BIGINT AS total_loc, CASE risk_tier WHEN 'CRITICAL' THEN 'Review immediately' WHEN 'HIGH' THEN 'Review this sprint' WHEN 'MODERATE' THEN 'Monitor' ELSE 'No action' END AS action FROM ti GROUP BY risk_tier")
def tier_summary(spark, d):
    return _r(RP.tier_summary(R.tier_by_percentile(scored(spark, d))), "percent", "avg_risk", "avg_loc")


@query(f"{_SC}, w AS (SELECT repo, file, rank() OVER (PARTITION BY repo ORDER BY loc) AS r, count(*) OVER (PARTITION BY repo, loc) AS t, count(*) OVER (PARTITION BY repo) AS n FROM sc) SELECT repo, file, round((r + (t - 1) / 2.0::DOUBLE) / n, 6) AS pct_rank FROM w")
def pct_rank_avg(spark, d):
    return _r(R.average_rank(scored(spark, d), ["repo"], "loc", "pct_rank").select("repo", "file", "pct_rank"), "pct_rank")


_RUN = f"{_LB}, ru AS (SELECT *, sum(loc) OVER w AS run_loc, sum(buggy) OVER w AS run_bugs, row_number() OVER w AS pos, sum(loc) OVER () AS all_loc, sum(buggy) OVER () AS all_bugs, count(*) OVER () AS n FROM lb WINDOW w AS (ORDER BY risk DESC, file ROWS UNBOUNDED PRECEDING))"


@query(f"{_RUN} SELECT count(*) AS files, sum(loc)::BIGINT AS loc, round(sum(buggy) / max(all_bugs)::DOUBLE, 6) AS recall FROM ru WHERE run_loc - loc < 0.2 * all_loc")
def recall_at_loc_budget(spark, d):
    x = labelled(spark, d)
    bugs = x.agg(F.sum("buggy").alias("bugs"))
    return _r(R.within_budget(x, "loc", 0.2).agg(F.count(F.lit(1)).alias("files"), F.sum("loc").cast("long").alias("loc"), F.sum("buggy").alias("found")).crossJoin(bugs).select("files", "loc", (F.col("found") / F.col("bugs")).alias("recall")), "recall")


@query(f"{_RUN} SELECT file, round(pos / n::DOUBLE, 6) AS files_share, round(run_bugs / all_bugs::DOUBLE, 6) AS bugs_share FROM ru")
def cumulative_gain(spark, d):
    return _r(R.cumulative_gain(labelled(spark, d)).select("file", "files_share", "bugs_share"), "files_share", "bugs_share")


_EFFORT = """CASE WHEN risk >= 0.7 AND loc <= 500 THEN 'HIGH_VALUE' WHEN risk >= 0.5 AND risk / greatest(loc, 1) >= 0.001 THEN 'EFFICIENT' WHEN risk >= 0.7 AND loc > 2000 THEN 'EXPENSIVE' WHEN risk < 0.3 THEN 'LOW_PRIORITY' ELSE 'MODERATE' END"""
_EF = f"{_SC}, ef AS (SELECT file, repo, risk, loc, risk / greatest(loc, 1) AS risk_per_loc, risk / sqrt(greatest(loc, 1)) * 1000 AS effort_priority, {_EFFORT} AS effort_category, CASE WHEN loc <= 200 THEN 'Low' WHEN loc <= 1000 THEN 'Medium' ELSE 'High' END AS review_effort FROM sc)"


def _effort(spark, d):
    return scored(spark, d).withColumns(K.effort_metrics(F.col("risk"), F.col("loc"))).withColumn("review_effort", K.review_effort(F.col("loc")))


@query(f"{_EF} SELECT file, round(risk_per_loc, 6) AS risk_per_loc, round(effort_priority, 6) AS effort_priority, effort_category, review_effort FROM ef")
def effort_metrics(spark, d):
    return _r(_effort(spark, d).select("file", "risk_per_loc", "effort_priority", "effort_category", "review_effort"), "risk_per_loc", "effort_priority")


_TOPN = f"{_EF}, t AS (SELECT * FROM ef ORDER BY effort_priority DESC, file LIMIT 50), b AS (SELECT *, row_number() OVER w AS rank, sum(loc) OVER w AS cumulative_loc FROM t WINDOW w AS (ORDER BY effort_priority DESC, file ROWS UNBOUNDED PRECEDING))"


@query(f"{_TOPN} SELECT file, rank::INTEGER AS rank, cumulative_loc::BIGINT AS cumulative_loc, round(effort_priority, 6) AS effort_priority FROM b WHERE cumulative_loc - loc < 100")
def budgeted_topn(spark, d):
    return _r(R.budgeted_topn(_effort(spark, d), 50, 100).select("file", "rank", "cumulative_loc", "effort_priority"), "effort_priority")


@query(f"{_TOPN}, s AS (SELECT count(*) AS n, sum(loc)::BIGINT AS loc, sum(risk) AS risk FROM b WHERE cumulative_loc - loc < 100) SELECT n AS files_recommended, loc AS total_loc, round(risk, 6) AS total_risk_captured, round(CASE WHEN loc > 0 THEN risk / loc ELSE 0 END, 6) AS avg_risk_per_loc FROM s")
def budgeted_summary(spark, d):
    x = R.budgeted_topn(_effort(spark, d), 50, 100).agg(F.count(F.lit(1)).alias("files_recommended"), F.sum("loc").cast("long").alias("total_loc"), F.sum("risk").alias("total_risk_captured"))
    return _r(x.withColumn("avg_risk_per_loc", F.when(F.col("total_loc") > 0, F.col("total_risk_captured") / F.col("total_loc")).otherwise(0.0)), "total_risk_captured", "avg_risk_per_loc")


@query(f"{_SC}, s AS (SELECT count(*) AS n, avg((risk > 0.95 OR risk < 0.05)::INTEGER) AS crowd, stddev_pop(risk) AS sd FROM sc), w AS (SELECT sc.file, risk, n, crowd, sd, (n - row_number() OVER (ORDER BY risk DESC, file)) / greatest(n - 1, 1)::DOUBLE AS share FROM sc, s) SELECT file, round(CASE WHEN crowd > 0.3 THEN 0.15 + 0.8 * share WHEN sd < 0.08 THEN 0.7 * risk + 0.3 * share ELSE risk END, 6) AS spread_risk FROM w")
def rank_spread(spark, d):
    return _r(R.rank_spread(scored(spark, d)).select("file", "spread_risk"), "spread_risk")


@query(f"{_SC}, n AS (SELECT file, 0.5 + 0.1 * risk AS risk FROM sc) SELECT file, round(CASE WHEN (SELECT max(risk) - min(risk) FROM n) < 0.2 THEN 1 / (1 + exp(-10 * (risk - 0.5))) ELSE risk END, 6) AS expanded_risk FROM n")
def distribution_expand(spark, d):
    return _r(R.distribution_expand(scored(spark, d).select("file", (0.5 + 0.1 * F.col("risk")).alias("risk"))).select("file", "expanded_risk"), "expanded_risk")


_ORDERED = "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events"


@query(f"SELECT event_id, CASE WHEN r <= floor(0.7 * n) THEN 'train' ELSE 'test' END AS part FROM ({_ORDERED})")
def temporal_order(spark, d):
    return _event_positions(spark, d).select("event_id", F.when(F.col("position") <= F.floor(F.lit(0.7) * F.col("n")), "train").otherwise("test").alias("part"))


def _event_positions(spark, d):
    """Positions in time order: days are counted side by side, and only their totals meet."""
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select("event_id", "ts", F.to_date("ts").alias("day"))
    per = e.groupBy("day").agg(F.count(F.lit(1)).alias("k"))
    starts = per.select("day", F.coalesce(F.sum("k").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(Window.partitionBy()).alias("n"))
    x = e.join(starts, "day")
    return x.select("event_id", "n", (F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))).alias("position"))


@query(f"SELECT fold, count(*) FILTER (WHERE part <= fold) AS train_rows, count(*) FILTER (WHERE part = fold + 1) AS test_rows FROM (SELECT least(6, 1 + floor((r - 1) * 6 / n))::INTEGER AS part FROM ({_ORDERED})), (SELECT unnest(range(1, 6))::INTEGER AS fold) GROUP BY fold")
def time_series_folds(spark, d):
    part = F.least(F.lit(6), 1 + F.floor((F.col("position") - 1) * 6 / F.col("n"))).cast("int")
    counts = _event_positions(spark, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"))
    folds = counts.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return folds.groupBy("fold").agg(F.sum(F.when(F.col("part") <= F.col("fold"), F.col("k")).otherwise(0)).alias("train_rows"), F.sum(F.when(F.col("part") == F.col("fold") + 1, F.col("k")).otherwise(0)).alias("test_rows"))


@query(f"{_SC} SELECT file FROM sc ORDER BY md5('42:' || file::VARCHAR), file LIMIT 3")
def seeded_sample(spark, d):
    return R.seeded_sample(scored(spark, d), 3, 42).select("file")


@query(f"{_SC}, t AS (SELECT file FROM sc ORDER BY risk DESC, file LIMIT 10) SELECT file, 'top' AS part FROM t UNION ALL (SELECT file, 'random' AS part FROM sc WHERE file NOT IN (SELECT file FROM t) ORDER BY md5('7:' || file::VARCHAR), file LIMIT 10)")
def shap_sample(spark, d):
    return R.attribution_sample(scored(spark, d), 20, 7).select("file", "part")


# ---- evaluation

_FLAG = "risk >= 0.7"


@query(f"{_LB} SELECT count(*) FILTER (WHERE {_FLAG} AND buggy = 1) AS tp, count(*) FILTER (WHERE {_FLAG} AND buggy = 0) AS fp, count(*) FILTER (WHERE NOT {_FLAG} AND buggy = 0) AS tn, count(*) FILTER (WHERE NOT {_FLAG} AND buggy = 1) AS fn FROM lb")
def confusion_matrix(spark, d):
    return M.confusion_matrix(labelled(spark, d), F.col("risk") >= 0.7)


_CM = f"{_LB}, cm AS (SELECT repo, count(*) FILTER (WHERE {_FLAG} AND buggy = 1)::DOUBLE AS tp, count(*) FILTER (WHERE {_FLAG} AND buggy = 0)::DOUBLE AS fp, count(*) FILTER (WHERE NOT {_FLAG} AND buggy = 0)::DOUBLE AS tn, count(*) FILTER (WHERE NOT {_FLAG} AND buggy = 1)::DOUBLE AS fn FROM lb GROUP BY repo), mt AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0 FROM cm)"


@query(f"{_CM} SELECT repo, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(f1, 6) AS f1, round(((tp + fn) * f1 + (tn + fp) * f0) / (tp + fp + tn + fn), 6) AS weighted_f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM mt")
def classification_metrics(spark, d):
    return _r(M.classification_metrics(labelled(spark, d), F.col("risk") >= 0.7, ["repo"]), "precision", "recall", "f1", "weighted_f1", "accuracy")


@query(f"{_RUN}, k AS (SELECT greatest(1, floor(max(n) * 0.2::DOUBLE))::BIGINT AS cut FROM ru) SELECT cut, sum(buggy)::BIGINT AS found, round(sum(buggy) / max(all_bugs)::DOUBLE, 6) AS recall, round(least(cut, max(all_bugs)) / max(all_bugs)::DOUBLE, 6) AS theoretical_max FROM ru, k WHERE pos <= cut GROUP BY cut")
def recall_at_k_rank(spark, d):
    return _r(M.recall_at_k_rank(labelled(spark, d)), "recall", "theoretical_max")


@query(f"{_LB}, p AS (SELECT repo, quantile_cont(risk, 0.8) AS t FROM lb GROUP BY repo) SELECT lb.repo, round(max(t), 6) AS threshold, round(CASE WHEN sum(buggy) > 0 THEN sum(CASE WHEN risk >= t THEN buggy ELSE 0 END) / sum(buggy)::DOUBLE ELSE 0 END, 6) AS recall FROM lb JOIN p USING (repo) GROUP BY lb.repo")
def recall_at_k_threshold(spark, d):
    return _r(M.recall_at_k_threshold(labelled(spark, d), 0.8, ["repo"]), "threshold", "recall")


@query(f"{_RUN} SELECT k::INTEGER AS k, round(sum(buggy) / max(all_bugs)::DOUBLE, 6) AS recall, round(sum(buggy) / count(*)::DOUBLE, 6) AS precision FROM ru, (VALUES (10), (5)) v(k) WHERE pos <= k GROUP BY k")
def topk_eval(spark, d):
    return _r(M.topk_eval(labelled(spark, d)), "recall", "precision")


_CURVE = f"{_LB}, g AS (SELECT risk, sum(buggy)::DOUBLE AS pos, (count(*) - sum(buggy))::DOUBLE AS neg FROM lb GROUP BY risk), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY risk DESC ROWS UNBOUNDED PRECEDING))"


@query(f"{_CURVE} SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc FROM cu")
def pr_auc(spark, d):
    return _r(M.pr_auc(labelled(spark, d)), "pr_auc")


@query(f"{_CURVE} SELECT round(sum(pos * ((n - fp) + neg / 2)) / max(p * n), 6) AS roc_auc FROM cu")
def roc_auc(spark, d):
    return _r(M.roc_auc(labelled(spark, d)), "roc_auc")


@query(f"{_CURVE}, f AS (SELECT risk, round(CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END, 12) AS f1 FROM cu) SELECT round(risk, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.risk DESC LIMIT 1")
def optimal_threshold(spark, d):
    return _r(M.optimal_threshold(labelled(spark, d)), "threshold", "f1")


@query(f"{_LB}, e AS (SELECT quantile_cont(risk, [" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]) AS q FROM lb), b AS (SELECT len(list_filter(q, lambda v: v < risk)) AS bin, risk, buggy FROM lb, e), p AS (SELECT avg(risk) AS p, avg(buggy) AS y FROM b GROUP BY bin) SELECT round(avg((risk - buggy) ** 2), 6) AS brier, round(stddev_pop(risk), 6) AS std, round(max(risk) - min(risk), 6) AS range, round(abs(avg(risk) - avg(buggy)), 6) AS gap, round((SELECT avg(abs(y - p)) FROM p), 6) AS ece FROM lb")
def brier_ece(spark, d):
    return _r(M.calibration(labelled(spark, d)), "brier", "std", "range", "gap", "ece")


@query(f"{_CURVE.replace('risk, sum', 'loc AS risk, sum').replace('GROUP BY risk', 'GROUP BY loc')}, q AS (SELECT quantile_cont(loc, 0.8) AS cut FROM lb), k AS (SELECT count(*) FILTER (WHERE loc >= cut AND buggy = 1) AS tp, count(*) FILTER (WHERE loc >= cut AND buggy = 0) AS fp, count(*) FILTER (WHERE loc < cut AND buggy = 1) AS fn FROM lb, q) SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) AS pr_auc, (SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) FROM k) AS f1 FROM cu")
def loc_baseline(spark, d):
    """Average precision when files are ranked by their lines, and F1 of the fifth with the most."""
    return _r(M.loc_baseline(labelled(spark, d)), "pr_auc", "f1")


_FOLDS = f"{_CM}, fo AS (SELECT repo, (tp + fp + tn + fn)::BIGINT AS n_test, (tp + fn)::BIGINT AS n_buggy, f1 FROM mt)"


def _folds(spark, d):
    x = labelled(spark, d)
    m = M.confusion_matrix(x, F.col("risk") >= 0.7, ["repo"])
    from defectloom.functions.core import ratio

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return m.select("repo", (tp + fp + tn + fn).alias("n_test"), (tp + fn).alias("n_buggy"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(f"""{_FOLDS} SELECT count(*) AS folds, round(avg(f1), 6) AS mean_f1, round(sum(f1 * n_test) FILTER (WHERE n_test >= 30) / sum(n_test) FILTER (WHERE n_test >= 30), 6) AS weighted_f1, round(avg(f1) FILTER (WHERE n_test >= 20), 6) AS honest_f1,
 round(avg(CASE WHEN n_buggy > 0 THEN least(1.0::DOUBLE, greatest(1, floor(n_test * 0.2::DOUBLE)) / n_buggy) ELSE 0 END), 6) AS mean_ceiling, round(avg(f1) FILTER (WHERE n_test >= 30 AND n_buggy / n_test::DOUBLE BETWEEN 0.15 AND 0.75), 6) AS reliable_f1,
 count(*) FILTER (WHERE n_test >= 30 AND n_buggy / n_test::DOUBLE BETWEEN 0.15 AND 0.75) AS reliable_folds FROM fo""")
def fold_summary(spark, d):
    return _r(M.fold_summary(_folds(spark, d)), "mean_f1", "weighted_f1", "honest_f1", "mean_ceiling", "reliable_f1")


@query(f"{_FOLDS} SELECT repo, CASE WHEN n_buggy / n_test::DOUBLE < 0.05 OR n_buggy / n_test::DOUBLE > 0.95 THEN 'extreme' WHEN f1 < 0.3 THEN 'poor' ELSE 'good' END AS fold_class FROM fo")
def fold_classes(spark, d):
    return Q.fold_classes(_folds(spark, d)).select("repo", "fold_class")


@query(f"{_FOLDS}, m AS (SELECT CASE WHEN substr(repo, 4)::INTEGER % 2 = 0 THEN 'lr' ELSE 'rf' END AS model, * FROM fo) SELECT model, round(avg(f1), 6) AS avg_f1, count(*) AS projects, sum(n_test)::BIGINT AS total_files, round(max(f1), 6) AS best_f1, arg_min(repo, (-f1, repo)) AS best_project FROM m GROUP BY model")
def model_avgs(spark, d):
    x = _folds(spark, d).withColumn("model", F.when(F.substring("repo", 4, 9).cast("int") % 2 == 0, "lr").otherwise("rf"))
    return _r(M.model_avgs(x), "avg_f1", "best_f1")


@query("SELECT event_type AS feature, count(DISTINCT day(ts)) AS n FROM events GROUP BY event_type HAVING count(DISTINCT day(ts)) >= 18")
def feature_vote(spark, d):
    return M.feature_vote(table(spark, d, "events").select(F.col("event_type").alias("feature"), F.dayofmonth("ts").alias("fold")), 30)


@query("SELECT event_type AS feature, round(avg(abs(value - 50)), 6) AS importance FROM events GROUP BY event_type ORDER BY avg(abs(value - 50)) DESC LIMIT 10")
def global_importance(spark, d):
    return _r(M.global_importance(table(spark, d, "events").select(F.col("event_type").alias("feature"), (F.col("value") - 50).alias("value"))), "importance")


_SETS = "CASE substr(repo, 4)::INTEGER % 5 WHEN 0 THEN 'Static-only' WHEN 1 THEN 'Git-only' WHEN 2 THEN 'Developer-only' WHEN 3 THEN 'Static+Git' ELSE 'All-Combined' END"
_ABLATION = f"""{_CM}, fs AS (SELECT CASE WHEN substr(repo, 4)::INTEGER % 2 = 0 THEN 'lr' ELSE 'rf' END AS model, {_SETS} AS feature_set, ((tp + fn) * f1 + (tn + fp) * f0) / (tp + fp + tn + fn) AS weighted_f1,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr_auc, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall_20, (tp + tn) / (tp + fp + tn + fn) AS accuracy FROM mt),
  su AS (SELECT model, feature_set, count(*) AS folds, avg(weighted_f1) AS weighted_f1, avg(pr_auc) AS pr_auc, avg(recall_20) AS recall_20, avg(accuracy) AS accuracy FROM fs GROUP BY 1, 2)"""


def _ablation(spark, d):
    """The sources as folds of models and feature sets; precision and recall stand for the measures by rank, which `ablation` computes."""
    m = M.classification_metrics(labelled(spark, d), F.col("risk") >= 0.7, ["repo"])
    i = F.substring("repo", 4, 9).cast("int")
    names = F.array(*[F.lit(x) for x in (*M.INDIVIDUAL_SETS, *M.COMBINED_SETS)])
    return m.select(F.when(i % 2 == 0, "lr").otherwise("rf").alias("model"), F.get(names, i % 5).alias("feature_set"), "weighted_f1", F.col("precision").alias("pr_auc"), F.col("recall").alias("recall_20"), "accuracy")


@query(f"{_ABLATION} SELECT model, feature_set, folds, round(weighted_f1, 6) AS weighted_f1, round(pr_auc, 6) AS pr_auc, round(recall_20, 6) AS recall_20, round(accuracy, 6) AS accuracy FROM su")
def ablation_summary(spark, d):
    return _r(M.ablation_summary(_ablation(spark, d)), "weighted_f1", "pr_auc", "recall_20", "accuracy")


@query(
    f"""{_ABLATION}, i AS (SELECT * FROM su WHERE feature_set IN ('Static-only', 'Git-only', 'Developer-only') ORDER BY pr_auc DESC, model, feature_set LIMIT 1), c AS (SELECT * FROM su WHERE feature_set IN ('Static+Git', 'All-Combined') ORDER BY pr_auc DESC, model, feature_set LIMIT 1)
    SELECT i.model || ' ' || i.feature_set AS best_individual, c.model || ' ' || c.feature_set AS best_combined, round(i.pr_auc, 6) AS individual_pr_auc, round(c.pr_auc, 6) AS combined_pr_auc, c.pr_auc > i.pr_auc AS combined_outperforms, c.pr_auc > 0.5 AS target_achieved,
    (SELECT max(pr_auc) - min(pr_auc) > 0.1 FROM su) AS meaningful_differences FROM i, c"""
)
def ablation_conclusions(spark, d):
    """Whether combined features beat the best single group."""
    return _r(M.ablation_conclusions(M.ablation_summary(_ablation(spark, d))), "individual_pr_auc", "combined_pr_auc")


def _hist_sql(n: int, expr: str) -> str:
    return f"{_SC}, h AS (SELECT ({expr})::BIGINT AS bin, count(*) AS c FROM sc GROUP BY 1) SELECT b::BIGINT AS bin, coalesce(c, 0) AS files FROM (SELECT unnest(range({n})) AS b) LEFT JOIN h ON h.bin = b"


for _variant, _n, _expr in (("right", 20, "ceil(risk * 20) - 1"), ("left", 10, "floor(risk * 10)"), ("clamped", 20, "least(floor(risk * 20), 19)")):
    query(_hist_sql(_n, _expr), f"risk_histogram_{_variant}")(lambda spark, d, v=_variant: M.risk_histogram(scored(spark, d), v))


# ---- reports

@query(f"{_SC} SELECT repo, round(avg(risk), 6) AS avg_risk, sum(buggy)::BIGINT AS bugs FROM sc GROUP BY repo")
def repo_trend(spark, d):
    return _r(RP.repo_trend(scored(spark, d)), "avg_risk")


@query(f"{_SC} SELECT {_LEVEL} AS level, count(*) AS files, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM sc), 6) AS percent FROM sc GROUP BY 1")
def risk_distribution(spark, d):
    return _r(RP.risk_distribution(scored(spark, d)), "percent")


_MOD = f"{_PT}, m AS (SELECT file_id, string_split(path, '/')[1] AS module, length(path) / (length(path) + 20.0::DOUBLE) AS risk FROM pt WHERE contains(path, '/'))"


@query(f"""{_MOD}, b AS (SELECT module, count(*) AS files, avg(risk) AS a, sum(risk) AS t FROM m GROUP BY module ORDER BY round(avg(risk), 9) DESC, module LIMIT 5),
t AS (SELECT module, string_agg(file_id, ',' ORDER BY risk DESC, file_id) AS top_files FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY risk DESC, file_id) AS r FROM m) WHERE r <= 3 GROUP BY module)
SELECT module, files, round(a, 6) AS avg_risk, round(t, 6) AS total_risk, top_files FROM b JOIN t USING (module)""")
def module_rollup(spark, d):
    x = url_paths(spark, d).withColumn("risk", F.char_length("path") / (F.char_length("path") + 20.0))
    return _r(RP.module_rollup(x), "avg_risk", "total_risk")


_FULL = f"{_SC}, fu AS (SELECT *, (file % 60)::BIGINT AS commits, (file % 97)::BIGINT AS lines_added, (file % 13)::BIGINT AS lines_deleted, (file % 11) / 10.0::DOUBLE AS coupling_risk, (file % 300)::BIGINT AS days_since_last_change, (file % 5 + 1)::BIGINT AS author_count, (file % 4) / 4.0::DOUBLE AS minor_contributor_ratio, (file % 9) / 9.0::DOUBLE AS max_coupling_strength, (file % 8)::BIGINT AS coupled_file_count, repo || '/f' || file AS path FROM sc)"


def _full(spark, d):
    f = F.col("file")
    return scored(spark, d).withColumns({"commits": f % 60, "lines_added": f % 97, "lines_deleted": f % 13, "coupling_risk": (f % 11) / 10.0, "days_since_last_change": f % 300, "author_count": f % 5 + 1, "minor_contributor_ratio": (f % 4) / 4.0, "max_coupling_strength": (f % 9) / 9.0, "coupled_file_count": f % 8, "path": F.concat("repo", F.lit("/f"), f.cast("string"))})


@query(f"""{_FULL}, q AS (SELECT count(*) AS files, avg(risk) AS r, avg((risk >= 0.6)::INTEGER) AS h, avg(avg_complexity) AS c, count(*) FILTER (WHERE max_complexity > 10) AS hc, sum(commits)::BIGINT AS tc, avg(commits) AS ac, sum(lines_added + lines_deleted)::BIGINT AS tch, avg(lines_added + lines_deleted) AS ach FROM fu)
SELECT files, round(r, 6) AS average_risk, round(h, 6) AS high_risk_ratio, round(c, 6) AS average_complexity, hc AS high_complexity_files, tc AS total_commits, round(ac, 6) AS average_commits, tch AS total_churn, round(ach, 6) AS average_churn, round(greatest(0, 100 - r * 50 - h * 30 - c * 2), 6) AS quality_score,
 CASE WHEN h > 0.3 THEN 'High' WHEN h > 0.1 THEN 'Medium' ELSE 'Low' END AS risk_level, CASE WHEN c > 8 THEN 'High' WHEN c > 4 THEN 'Medium' ELSE 'Low' END AS complexity_level, CASE WHEN ac > 20 THEN 'High' WHEN ac > 5 THEN 'Medium' ELSE 'Low' END AS activity_level, CASE WHEN ach > 100 THEN 'Low' WHEN ach > 20 THEN 'Medium' ELSE 'High' END AS stability_level FROM q""")
def quality_indicators(spark, d):
    return _r(RP.quality_indicators(_full(spark, d)), "average_risk", "high_risk_ratio", "average_complexity", "average_commits", "average_churn", "quality_score")


def _rule(priority, category, test, k, holds):
    files = f"(SELECT coalesce(string_agg(file, ',' ORDER BY file), '') FROM (SELECT file FROM fu WHERE {test} ORDER BY file LIMIT {k}))" if k else "''"
    return f"SELECT '{priority}' AS priority, '{category}' AS category, count(*) FILTER (WHERE {test}) AS affected, {files} AS files FROM fu HAVING {holds}"


_CHURN = "CASE WHEN loc > 0 THEN (lines_added + lines_deleted) / loc::DOUBLE ELSE 0 END > 0.5"


@query(f"{_FULL} " + " UNION ALL ".join([
    _rule("CRITICAL", "Immediate Action Required", "risk >= 0.8", 5, "count(*) FILTER (WHERE risk >= 0.8) > 0"),
    _rule("HIGH", "Code Quality Concern", "risk >= 0.6", 0, "count(*) FILTER (WHERE risk >= 0.6) > count(*) * 0.3"),
    _rule("MEDIUM", "Complexity Reduction", "max_complexity > 15", 3, "count(*) FILTER (WHERE max_complexity > 15) > 0"),
    _rule("MEDIUM", "Stability Issues", _CHURN, 3, f"count(*) FILTER (WHERE {_CHURN}) > 0"),
    _rule("LOW", "Architectural Review", "coupling_risk > 0.7", 3, "count(*) FILTER (WHERE coupling_risk > 0.7) > 0"),
]))
def recommendations(spark, d):
    return RP.recommendations(_full(spark, d))


@query(f"{_FULL} SELECT file, round(0.4 * risk + 0.3 * least(10 * ((lines_added + lines_deleted) / loc::DOUBLE), 1) + 0.2 * least(commits / 50.0::DOUBLE, 1) + 0.1 * least(coupling_risk, 1), 6) AS priority_score FROM fu")
def priority_score(spark, d):
    return _r(_full(spark, d).select("file", K.priority_score(F.col("risk"), (F.col("lines_added") + F.col("lines_deleted")) / F.col("loc"), F.col("commits"), F.col("coupling_risk")).alias("priority_score")), "priority_score")


def _dec(c: str, n: int) -> str:
    return f"round(({c})::DECIMAL(28, 9), {n})::DOUBLE"


def _pct(c: str) -> str:
    return f"printf('%.1f%%', {_dec(f'({c}) * 100', 1)})"


_CH = "CASE WHEN loc > 0 THEN (lines_added + lines_deleted) / loc::DOUBLE ELSE 0 END"
_SCORE = f"(0.4 * risk + 0.3 * least(10 * ({_CH}), 1) + 0.2 * least(commits / 50.0::DOUBLE, 1) + 0.1 * least(coupling_risk, 1))"
_TIER = "CASE WHEN risk >= 0.8 THEN 'Critical' WHEN risk >= 0.6 THEN 'High' WHEN risk >= 0.4 THEN 'Moderate' ELSE 'Low' END"
_ROWS = f"""SELECT file::VARCHAR AS filename, {_dec('risk', 4)} AS risk_score, {_pct('risk')} AS risk_percentage, {_TIER} AS risk_tier, loc AS lines_of_code, {_dec('avg_complexity', 2)} AS avg_complexity, max_complexity, functions,
  commits, lines_added, lines_deleted, {_dec(_CH, 3)} AS churn_ratio, days_since_last_change, author_count, {_dec('minor_contributor_ratio', 2)} AS minor_contributor_ratio, {_dec('coupling_risk', 2)} AS coupling_risk,
  max_coupling_strength, coupled_file_count, coalesce(language, 'unknown') AS language, buggy AS buggy_label, {_dec(_SCORE, 3)} AS priority_score FROM fu"""


def _exported(spark, d):
    """Writes a scan's files, and gives their folder and the schema of the table."""
    folder, x = work_folder(spark), _full(spark, d)
    rows = RP.scan_rows(x)
    C.write_scan(rows, RP.scan_insights(x, "scan"), RP.scan_document(x, "scan", metrics=M.pr_auc(x)), folder)
    return folder, rows.schema


@query(f"{_FULL} {_ROWS}")
def export_scan_csv(spark, d):
    """The table of the CSV export, read back from its files: 21 columns for each file."""
    folder, schema = _exported(spark, d)
    return spark.read.option("header", "true").schema(schema).csv(f"{folder}/files_csv")


@query(f"{_FULL} {_ROWS}")
def export_scan_files(spark, d):
    """The files of the JSON export, read back from its lines."""
    folder, schema = _exported(spark, d)
    return spark.read.schema(schema).json(f"{folder}/detailed_files")


_COUNTS = "bc AS (SELECT count(*) AS n, count(*) FILTER (WHERE risk >= 0.8) AS c, count(*) FILTER (WHERE risk >= 0.6 AND risk < 0.8) AS h, count(*) FILTER (WHERE risk >= 0.4 AND risk < 0.6) AS m, count(*) FILTER (WHERE risk < 0.4) AS l, sum(risk) AS t FROM fu)"
_TOP10 = "tp AS (SELECT *, row_number() OVER (ORDER BY risk DESC, file)::INTEGER AS rank FROM (SELECT * FROM fu ORDER BY risk DESC, file LIMIT 10))"


@query(f"""{_FULL}, {_COUNTS}, {_TOP10}
SELECT 'SCAN INSIGHTS' AS section, 1 AS position, 'Repository' AS label, 'scan' AS value, '' AS share, '' AS commits, '' AS lines UNION ALL SELECT 'SCAN INSIGHTS', 2, 'Total Files', n::VARCHAR, '', '', '' FROM bc
""" + "".join(f" UNION ALL SELECT 'RISK DISTRIBUTION', {i}, '{label}', {c}::VARCHAR, {_pct(f'{c} / n::DOUBLE')}, '', '' FROM bc" for i, (label, c) in enumerate((("Critical Files", "c"), ("High Risk Files", "h"), ("Moderate Risk Files", "m"), ("Low Risk Files", "l")), 1)) + f"""
 UNION ALL SELECT 'TOP 10 HIGH RISK FILES', rank, '#' || rank, file::VARCHAR, {_pct('risk')}, 'Commits: ' || commits, 'LOC: ' || loc FROM tp""")
def export_scan_insights(spark, d):
    """The blocks after the CSV export's table, read back; empty cells come back as empty."""
    folder, _ = _exported(spark, d)
    x = spark.read.option("header", "true").schema("section string, position int, label string, value string, share string, commits string, lines string").csv(f"{folder}/insights_csv")
    return x.fillna("")


_MODULES = "md AS (SELECT repo AS module, count(*) AS k, avg(risk) AS a FROM fu GROUP BY repo ORDER BY round(avg(risk), 9) DESC, repo LIMIT 5)"


@query(f"""{_FULL}, {_COUNTS}, {_TOP10}, {_MODULES}, q AS (SELECT round(greatest(0, 100 - avg(risk) * 50 - avg((risk >= 0.6)::INTEGER) * 30 - avg(avg_complexity) * 2), 6) AS s FROM fu),
g AS (SELECT risk, sum(buggy)::DOUBLE AS pos, (count(*) - sum(buggy))::DOUBLE AS neg FROM fu GROUP BY risk), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM g WINDOW w AS (ORDER BY risk DESC ROWS UNBOUNDED PRECEDING))
SELECT 'scan' AS repository, n AS total_files, c AS critical, {_dec('100 * c / n::DOUBLE', 1)} AS critical_percentage, h AS high, m AS moderate, l AS low, {_dec('100 * l / n::DOUBLE', 1)} AS low_percentage,
 {_dec('t / n', 3)} AS average_risk_score, {_dec('100 * (c + h) / n::DOUBLE', 1)} AS high_risk_percentage, (SELECT string_agg(file, ',' ORDER BY rank) FROM tp) AS top_files, (SELECT string_agg({_TIER}, ',' ORDER BY rank) FROM tp) AS top_tiers,
 (SELECT round(sum({_dec(_SCORE, 3)}), 6) FROM tp) AS top_priority, (SELECT string_agg(module, ',' ORDER BY round(a, 9) DESC, module) FROM md) AS modules, (SELECT sum(k)::BIGINT FROM md) AS module_files,
 (SELECT count(*) FILTER (WHERE risk >= 0.8) > 0 FROM fu) AS advises_action, q.s AS quality_score, (SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) FROM cu) AS pr_auc FROM bc, q""")
def export_scan_json(spark, d):
    """The JSON document of a scan, read back and taken apart."""
    folder, _ = _exported(spark, d)
    doc = spark.read.text(f"{folder}/document").select(F.col("value").alias("doc"))

    def at(path: str, kind: str = "string"):
        return F.get_json_object("doc", f"$.{path}").cast(kind)

    def names(path: str, field: str):
        return F.transform(F.from_json(at(path), "array<map<string,string>>"), lambda x: x[field])

    share = "summary_metrics.risk_distribution"
    top, modules = "insights.top_risk_files", "insights.riskiest_modules"
    return doc.select(
        at("scan_metadata.repository").alias("repository"),
        at("summary_metrics.total_files", "long").alias("total_files"),
        at(f"{share}.critical.count", "long").alias("critical"),
        at(f"{share}.critical.percentage", "double").alias("critical_percentage"),
        *[at(f"{share}.{x}.count", "long").alias(x) for x in ("high", "moderate", "low")],
        at(f"{share}.low.percentage", "double").alias("low_percentage"),
        at("summary_metrics.average_risk_score", "double").alias("average_risk_score"),
        at("summary_metrics.high_risk_percentage", "double").alias("high_risk_percentage"),
        F.array_join(names(top, "filepath"), ",").alias("top_files"),
        F.array_join(names(top, "risk_tier"), ",").alias("top_tiers"),
        r6(F.aggregate(names(top, "priority_score"), F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("top_priority"),
        F.array_join(names(modules, "module"), ",").alias("modules"),
        F.aggregate(names(modules, "file_count"), F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("module_files"),
        F.array_contains(names("insights.recommendations", "priority"), "CRITICAL").alias("advises_action"),
        r6(at("insights.quality_indicators.quality_score", "double")).alias("quality_score"),
        r6(at("model_metrics.pr_auc", "double")).alias("pr_auc"),
    )


@query(f"{_PT}, t AS (SELECT contains(path, 'blog.') AS tst, contains(path, '/es/') AS gen FROM pt) SELECT count(*) FILTER (WHERE NOT tst AND NOT gen) AS included, count(*) FILTER (WHERE tst) AS excluded_test, count(*) FILTER (WHERE NOT tst AND gen) AS excluded_generated FROM t")
def filter_audit(spark, d):
    return RP.filter_audit(url_paths(spark, d), test=F.col("path").contains("blog."), generated=F.col("path").contains("/es/"))


@query(f"{_PT}, r AS (SELECT CASE WHEN contains(path, 'spam') THEN 'excluded' WHEN path LIKE '%.html' THEN 'pattern' ELSE 'kept' END AS reason FROM pt) SELECT reason, count(*) AS files, round((SELECT count(*) FILTER (WHERE reason <> 'kept') / count(*)::DOUBLE FROM r), 6) AS drop_rate FROM r GROUP BY reason")
def drop_rate(spark, d):
    c = F.col("path")
    return _r(RP.drop_rate(url_paths(spark, d).select(F.when(c.contains("spam"), "excluded").when(c.endswith(".html"), "pattern").otherwise("kept").alias("reason"))), "drop_rate")


@query(f"{_SC} SELECT count(*) AS n, round(min(risk), 6) AS min_risk, round(max(risk), 6) AS max_risk, round(avg(risk), 6) AS mean_risk, count(*) FILTER (WHERE risk = 0) AS zeros, count(DISTINCT risk) AS distinct_scores, count(DISTINCT repo) AS repos, count(DISTINCT risk) <= 2 AS collapsed FROM sc")
def prediction_audit(spark, d):
    return _r(RP.prediction_audit(scored(spark, d)), "min_risk", "max_risk", "mean_risk")


@query(f"{_CURVE}, s AS (SELECT count(*) AS files, sum(buggy)::BIGINT AS bugs, avg(risk) AS r FROM lb) SELECT files, bugs, round(r, 6) AS avg_risk, (SELECT round(sum(pos * ((n - fp) + neg / 2)) / max(p * n), 6) FROM cu) AS roc_auc, (SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) FROM cu) AS pr_auc FROM s")
def scan_metrics(spark, d):
    x = labelled(spark, d)
    one = x.agg(F.count(F.lit(1)).alias("files"), F.sum("buggy").cast("long").alias("bugs"), F.avg("risk").alias("avg_risk"))
    return _r(one.crossJoin(M.roc_auc(x)).crossJoin(M.pr_auc(x)), "avg_risk", "roc_auc", "pr_auc")


# ---- change sets

_MAXES = "m AS (SELECT commit_id, max(ln(1 + loc)) AS a, max(ln(1 + commits)) AS b, max(avg_complexity) AS c, max(ln(1 + coupled_file_count)) AS e FROM cs GROUP BY commit_id)"
_SCALE = "(0.5 + 0.5 * CASE WHEN {t} > 0 THEN {v} / {t} ELSE {v} END)"
_RAW = " * ".join(_SCALE.format(v=v, t=t) for v, t in (("ln(1 + loc)", "a"), ("ln(1 + commits)", "b"), ("avg_complexity", "c"), ("ln(1 + coupled_file_count)", "e")))
_WEIGHTS = f"{_CS}, {_MAXES}, rw AS (SELECT cs.*, {_RAW} AS raw FROM cs JOIN m USING (commit_id)), wt AS (SELECT *, raw / sum(raw) OVER (PARTITION BY commit_id) AS weight FROM rw)"


@query(f"{_WEIGHTS} SELECT commit_id, file, round(weight, 6) AS weight FROM wt")
def commit_importance(spark, d):
    return _r(K.commit_importance(part_files(spark, d)).select("commit_id", "file", "weight"), "weight")


_CRISK = f"{_WEIGHTS}, pc AS (SELECT commit_id, count(*) AS files, max(risk) AS mx, sum(risk * weight) AS wm, max(risk) FILTER (WHERE risk > 0.4) AS hi, count(*) FILTER (WHERE risk > 0.4) AS nh FROM wt GROUP BY commit_id), cr AS (SELECT *, 0.6 * mx + 0.4 * wm AS base FROM pc), rk AS (SELECT *, CASE WHEN coalesce(base < 0.8 * hi, false) THEN greatest(base, 0.9 * hi) ELSE base END AS commit_risk FROM cr)"


@query(f"{_CRISK} SELECT commit_id, files, round(mx, 6) AS max_risk, round(wm, 6) AS weighted_risk, nh AS high_risk_files, round(commit_risk, 6) AS commit_risk FROM rk")
def commit_risk(spark, d):
    return _r(K.commit_risk(part_files(spark, d)), "max_risk", "weighted_risk", "commit_risk")


@query(f"{_CRISK}, v AS (SELECT commit_id, CASE WHEN mx > 0 THEN commit_risk / mx ELSE 0 END AS q, mx, nh, commit_risk FROM rk) SELECT commit_id, round(q, 6) AS ratio_to_max, concat_ws(',', CASE WHEN mx > 0.4 AND q < 0.5 THEN 'below_max' END, CASE WHEN nh > 0 AND commit_risk < 0.3 THEN 'ignores_high' END, CASE WHEN commit_risk < 0 OR commit_risk > 1 THEN 'range' END) AS issues FROM v")
def commit_validation(spark, d):
    return _r(K.commit_validation(K.commit_risk(part_files(spark, d))).select("commit_id", "ratio_to_max", "issues"), "ratio_to_max")


@query(f"{_CS} SELECT commit_id, string_agg(file, ' | ' ORDER BY risk DESC, file) AS top_files FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY risk DESC, file) AS r FROM cs) WHERE r <= 3 GROUP BY commit_id")
def top_contributors(spark, d):
    return K.top_contributors(part_files(spark, d))


_PRF = """pf AS (SELECT l_orderkey AS pr, 'f' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '.py' WHEN l_partkey % 3 = 1 THEN '_test.js' ELSE '.go' END AS name, (l_quantity * 20)::BIGINT AS additions, l_linenumber::BIGINT * 10 AS deletions, l_partkey % 5 = 0 AS past FROM lineitem),
pr0 AS (SELECT *, additions + deletions AS ch FROM pf),
pr1 AS (SELECT *, least(least(0.1 + ch / 100.0::DOUBLE * 0.5, 0.9) * CASE WHEN ends_with(name, '.py') THEN 1.2 WHEN ends_with(name, '.js') THEN 1.1 ELSE 1 END * CASE WHEN past THEN 1.3 ELSE 1 END * CASE WHEN contains(name, 'test') OR contains(name, 'spec') THEN 0.7 ELSE 1 END
  * CASE WHEN ch > 1000 THEN 1.2 WHEN additions > deletions * 3 THEN 1.1 ELSE 1 END, 0.95) AS risk FROM pr0)"""


def _pr_files(spark, d):
    k = F.col("l_partkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 3 == 0, ".py").when(k % 3 == 1, "_test.js").otherwise(".go"))
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pr"), F.col("l_linenumber").alias("line"), name.alias("name"), (F.col("l_quantity") * 20).cast("long").alias("additions"), (F.col("l_linenumber").cast("long") * 10).alias("deletions"), (k % 5 == 0).alias("past"))
    return x.withColumn("risk", K.pr_file_risk(F.col("name"), F.col("additions"), F.col("deletions"), F.col("past")))


@query(f"WITH {_PRF} SELECT pr, name, additions, round(risk, 6) AS risk FROM pr1")
def pr_file_risk(spark, d):
    return _r(_pr_files(spark, d).select("pr", "name", "additions", "risk"), "risk")


_LEVELS = "CASE WHEN c_acctbal > 1000 AND n > 12 THEN 'SENIOR' WHEN c_acctbal > 100 AND n > 5 THEN 'MEDIUM' WHEN n > 0 THEN 'JUNIOR' ELSE 'NEW' END"


@query("SELECT c_custkey AS author, CASE WHEN c_acctbal > 1000 AND n > 50 THEN 'SENIOR' WHEN c_acctbal > 100 AND n > 10 THEN 'MEDIUM' WHEN n > 0 THEN 'JUNIOR' ELSE 'NEW' END AS level FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)")
def author_level(spark, d):
    return _authors(spark, d).select("author", "level")


def _authors(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("author"), "c_acctbal").join(n, "author", "left")
    return c.withColumn("level", K.author_level(F.col("c_acctbal"), F.coalesce("n", F.lit(0))))


@query(f"""WITH {_PRF}, au AS (SELECT c_custkey, CASE WHEN c_acctbal > 1000 AND n > 50 THEN 'SENIOR' WHEN c_acctbal > 100 AND n > 10 THEN 'MEDIUM' WHEN n > 0 THEN 'JUNIOR' ELSE 'NEW' END AS level FROM (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)),
g AS (SELECT pr, avg(risk) AS a, count(*) FILTER (WHERE risk > 0.7) AS h, max(level) AS level FROM pr1 JOIN orders ON pr = o_orderkey JOIN au ON c_custkey = o_custkey GROUP BY pr),
s AS (SELECT pr, h, round(least(a, 0.95) * CASE level WHEN 'SENIOR' THEN 0.9 WHEN 'JUNIOR' THEN 1.2 ELSE 1 END, 10) AS r FROM g)
SELECT pr, h AS high_risk_files, r AS pr_risk, CASE WHEN r >= 0.8 THEN 'HIGH' WHEN r >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS pr_level FROM s""")
def pr_risk(spark, d):
    by = table(spark, d, "orders").select(F.col("o_orderkey").alias("pr"), F.col("o_custkey").alias("author")).join(_authors(spark, d), "author").select("pr", "level")
    return K.pr_risk(_pr_files(spark, d).join(by, "pr"))


# ---- checks

@query(f"{_SC}, c AS (SELECT repo, count(*) AS c FROM sc WHERE language = 'es' GROUP BY repo), g AS (SELECT CASE WHEN c < 5 THEN 'other' ELSE repo END AS class, sum(c)::BIGINT AS n FROM c GROUP BY 1) SELECT class, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, n / sum(n) OVER ()::DOUBLE > 0.9 AS dominant FROM g")
def class_dominance(spark, d):
    return _r(Q.class_dominance(scored(spark, d).where("language = 'es'"), "repo"), "share")


@query(f"{_LB} SELECT repo, count(*) AS files, sum(buggy)::BIGINT AS bugs, round(avg(buggy), 6) AS rate, CASE WHEN avg(buggy) < 0.05 THEN 'too_low' WHEN avg(buggy) < 0.17 THEN 'low' WHEN avg(buggy) <= 0.4 THEN 'good' WHEN avg(buggy) <= 0.5 THEN 'high' ELSE 'too_high' END AS status FROM lb GROUP BY repo")
def prevalence_status(spark, d):
    return _r(Q.prevalence_status(labelled(spark, d)), "rate")


@query(f"{_LB}, p AS (SELECT repo, count(*) AS f, sum(buggy) AS b FROM lb GROUP BY repo) SELECT count(*) AS repos, sum(f)::BIGINT AS files, sum(b)::BIGINT AS bugs, round(avg(b / f::DOUBLE) FILTER (WHERE b > 0), 6) AS mean_rate FROM p")
def multi_repo_summary(spark, d):
    return _r(Q.multi_repo_summary(labelled(spark, d)), "mean_rate")


@query(f"{_SC}, p AS (SELECT repo, count(*) AS files, min(risk) AS a, max(risk) AS b, avg(risk) AS m, coalesce(stddev_samp(risk), 0) AS s FROM sc GROUP BY repo) SELECT repo, files, round(a, 6) AS min_risk, round(b, 6) AS max_risk, round(m, 6) AS mean_risk, round(s, 6) AS std_risk, round(var_pop(m) OVER (), 6) AS variance_of_means FROM p")
def repo_rank_stats(spark, d):
    return _r(Q.repo_rank_stats(scored(spark, d)), "min_risk", "max_risk", "mean_risk", "std_risk", "variance_of_means")


@query(f"""{_SC}, p AS (SELECT repo, count(*) AS f, avg(buggy) AS r, avg((language IS NULL)::INTEGER) AS m FROM sc GROUP BY repo)
SELECT repo, 'size' AS "check", f::DOUBLE AS value, CASE WHEN f > 100 THEN 'pass' ELSE 'fail' END AS status FROM p UNION ALL SELECT repo, 'features', 12.0::DOUBLE, 'pass' FROM p
UNION ALL SELECT repo, 'bug_rate', round(r, 6), CASE WHEN r BETWEEN 0.05 AND 0.5 THEN 'pass' ELSE 'fail' END FROM p UNION ALL SELECT repo, 'missing', round(m, 6), CASE WHEN m <= 0.1 THEN 'pass' ELSE 'fail' END FROM p""")
def large_repo_screen(spark, d):
    return _r(Q.large_repo_screen(scored(spark, d), 12), "value")


@query("SELECT min(datediff('day', ts, TIMESTAMP '2024-02-01')) FILTER (WHERE user_id % 2 = 0) AS min_train_age, max(datediff('day', ts, TIMESTAMP '2024-02-01')) FILTER (WHERE user_id % 2 = 1) AS max_test_age, min(datediff('day', ts, TIMESTAMP '2024-02-01')) FILTER (WHERE user_id % 2 = 0) >= max(datediff('day', ts, TIMESTAMP '2024-02-01')) FILTER (WHERE user_id % 2 = 1) AS ok FROM events")
def temporal_leak_check(spark, d):
    e = table(spark, d, "events").select("user_id", F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")).cast("long").alias("file_age"))
    return Q.temporal_leak_check(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"))


@query(f"{_SC} SELECT file, round(CASE WHEN risk > 0 AND risk < 1 THEN -(risk * ln(risk) + (1 - risk) * ln(1 - risk)) / 0.6931471805599453 ELSE 0 END, 6) AS entropy FROM sc")
def entropy(spark, d):
    return _r(scored(spark, d).select("file", K.entropy(F.col("risk")).alias("entropy")), "entropy")


@query(f"{_LB}, p AS (SELECT repo, avg(buggy) AS p, count(*)::DOUBLE AS n FROM lb GROUP BY repo), w AS (SELECT repo, (p + 3.841458641296 / (2 * n)) / (1 + 3.841458641296 / n) AS m, 1.959964::DOUBLE * sqrt(p * (1 - p) / n + 3.841458641296 / (4 * n * n)) / (1 + 3.841458641296 / n) AS h FROM p) SELECT repo, round(greatest(least(m - h, 1), 0), 6) AS low, round(greatest(least(m + h, 1), 0), 6) AS high FROM w")
def wilson_ci(spark, d):
    p = labelled(spark, d).groupBy("repo").agg(F.avg("buggy").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = K.wilson(F.col("p"), F.col("n"))
    return _r(p.select("repo", low.alias("low"), high.alias("high")), "low", "high")


@query(f"{_SC}, s AS (SELECT avg(loc) AS m, stddev_pop(loc) AS sd, quantile_cont(loc::DOUBLE, 0.99) AS p FROM sc) SELECT file, loc > 3 * p OR CASE WHEN sd > 0 THEN abs(loc - m) / sd ELSE 0 END > 5 AS is_outlier FROM sc, s")
def zscore_ood(spark, d):
    x = scored(spark, d)
    s = M.training_stats(x, ["loc"]).drop("feature")
    return x.crossJoin(F.broadcast(s)).select("file", K.zscore_ood(F.col("loc"), F.col("mean"), F.col("std"), F.col("p99")).alias("is_outlier"))


_OODC = ["loc", "functions", "avg_complexity"]


@query(f"""{_FULL}, l AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) + 3 * (quantile_cont({c}::DOUBLE, 0.99) - quantile_cont({c}::DOUBLE, 0.01)) AS l_{c}' for c in _OODC)} FROM fu),
o AS (SELECT count(*) AS n, count(*) FILTER (WHERE language NOT IN ('en', 'de', 'fr')) AS u, count(*) FILTER (WHERE commits < 5) AS s, avg(CASE WHEN risk > 0 AND risk < 1 THEN -(risk * ln(risk) + (1 - risk) * ln(1 - risk)) / 0.6931471805599453 ELSE 0 END) AS e,
  {', '.join(f'count(*) FILTER (WHERE {c} > l_{c}) AS o_{c}' for c in _OODC)} FROM fu, l),
x AS (SELECT *, {' + '.join(f'(o_{c} > 0.3 * n)::INTEGER' for c in _OODC)} AS ex FROM o),
y AS (SELECT *, greatest(CASE WHEN u > 0 THEN 0.5 ELSE 1 END * CASE WHEN s > 0.5 * n THEN 0.85 ELSE 1 END * CASE WHEN ex >= 3 THEN 0.85 WHEN ex >= 1 THEN 0.95 ELSE 1 END * CASE WHEN n < 25 THEN 0.95 ELSE 1 END - 0.15 * e, 0.1) AS f FROM x)
SELECT n, u AS unsupported, s AS sparse, ex AS extreme_columns, round(e, 6) AS entropy, round(f, 6) AS confidence_score, CASE WHEN f > 0.75 THEN 'HIGH' WHEN f > 0.55 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, f < 0.55 AS out_of_distribution FROM y""")
def ood_confidence(spark, d):
    x = _full(spark, d)
    return _r(K.ood_confidence(x, M.training_stats(x, _OODC), _OODC, ["en", "de", "fr"]), "entropy", "confidence_score")


@query(f"{_CS}, t AS (SELECT commit_id, count(*) AS n FROM cs GROUP BY 1) SELECT commit_id, n, n > 6 AS is_large FROM t")
def commit_changed_files(spark, d):
    return part_files(spark, d).groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).withColumn("is_large", F.col("n") > 6)
