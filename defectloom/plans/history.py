"""History operators over orders (commits) and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectloom.functions.core import r6
from defectloom.operators import history as H
from defectloom.plans.bindings import COMMIT_FILES, EVENT_COMMITS, commit_files, event_commits
from defectloom.plans.registry import query

_CF = f"WITH {COMMIT_FILES}"
_AGED = f"""{_CF}, anchors AS (SELECT repo, max(commit_time) AS anchor FROM cf GROUP BY repo),
ag AS (SELECT cf.*, anchor, floor((epoch_us(anchor) - epoch_us(commit_time)) / 86400000000.0)::BIGINT AS age_days FROM cf JOIN anchors USING (repo))
"""
_EV = _AGED.replace(COMMIT_FILES, EVENT_COMMITS)


def _rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


_CHURN = "SELECT repo, file, count(*) AS commits, sum(added)::BIGINT AS lines_added, sum(deleted)::BIGINT AS lines_deleted, max(added) AS max_added FROM cf GROUP BY repo, file"


@query(f"{_CF} {_CHURN}")
def file_churn(spark, d):
    return H.file_churn(commit_files(spark, d))


@query(f"""{_CF}, c AS ({_CHURN})
SELECT repo, file, commits, lines_added, rank FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY lines_added + lines_deleted DESC, file) AS rank FROM c) WHERE rank <= 20""")
def topn_per_repo(spark, d):
    from defectloom.operators.ranking import top_per_group

    churn = H.file_churn(commit_files(spark, d))
    return top_per_group(churn, ["repo"], [(F.col("lines_added") + F.col("lines_deleted")).desc(), F.col("file").asc()], 20).select("repo", "file", "commits", "lines_added", "rank")


_AUTHORS = """SELECT repo, file, count(*) AS author_count,
  round(CASE WHEN sum(n) >= 5 THEN max(n) / sum(n)::DOUBLE ELSE 0 END, 6) AS ownership,
  CASE WHEN sum(n) >= 5 THEN 0 ELSE 1 END AS low_history_flag,
  round(count(*) FILTER (WHERE n = 1) / count(*)::DOUBLE, 6) AS minor_contributor_ratio
FROM (SELECT repo, file, author, count(*) AS n FROM cf GROUP BY repo, file, author) GROUP BY repo, file"""


@query(f"{_CF} {_AUTHORS}")
def author_stats(spark, d):
    return _rounded(H.author_stats(commit_files(spark, d)), "ownership", "minor_contributor_ratio")


@query(f"WITH {EVENT_COMMITS} {_AUTHORS}")
def author_stats_events(spark, d):
    return _rounded(H.author_stats(event_commits(spark, d)), "ownership", "minor_contributor_ratio")


@query(f"{_CF} SELECT repo, max(commit_time) AS anchor FROM cf GROUP BY repo")
def repo_anchor_time(spark, d):
    return H.anchors(commit_files(spark, d)).withColumn("anchor", F.col("anchor").cast("timestamp_ntz"))


_FIRST_LAST = """SELECT repo, file, arg_min(commit_id, (commit_time, commit_id)) AS first_commit, arg_max(commit_id, (commit_time, commit_id)) AS last_commit,
  max(age_days) AS file_age, min(age_days) AS days_since_last_change FROM ag GROUP BY repo, file"""


@query(f"{_AGED} {_FIRST_LAST}")
def first_last(spark, d):
    return H.first_last(commit_files(spark, d))


_RECENT = """SELECT repo, file, count(*) FILTER (WHERE age_days < 14) AS commits_2w, count(*) FILTER (WHERE age_days < 30) AS commits_1m, count(*) FILTER (WHERE age_days < 90) AS commits_3m
FROM ag GROUP BY repo, file"""


@query(f"{_AGED} {_RECENT}")
def recent_windows(spark, d):
    return H.recent_windows(commit_files(spark, d))


@query(f"{_EV} {_RECENT}")
def recent_windows_events(spark, d):
    return H.recent_windows(event_commits(spark, d))


_FIXES = """SELECT repo, file, sum(is_fix)::BIGINT AS bug_fixes, coalesce(min(CASE WHEN is_fix = 1 THEN age_days END), -1)::BIGINT AS days_since_last_bug FROM ag GROUP BY repo, file"""


@query(f"{_AGED} {_FIXES}")
def bug_fix_counts(spark, d):
    return H.bug_fix_counts(commit_files(spark, d))


_MEMORY = """SELECT repo, file, round(coalesce(sum(exp(-0.0038 * age_days)) FILTER (WHERE is_fix = 1 AND age_days >= 0), 0), 6) AS temporal_bug_memory,
  round(coalesce(1.0::DOUBLE / (min(age_days) FILTER (WHERE is_fix = 1) + 1), 0), 6) AS bug_recency_score,
  coalesce((min(age_days) FILTER (WHERE is_fix = 1) <= 30)::INTEGER, 0) AS recent_bug_flag FROM ag GROUP BY repo, file"""


@query(f"{_AGED} {_MEMORY}")
def bug_memory(spark, d):
    return _rounded(H.bug_memory(commit_files(spark, d)), "temporal_bug_memory", "bug_recency_score")


@query(f"{_EV} {_MEMORY}")
def bug_memory_events(spark, d):
    return _rounded(H.bug_memory(event_commits(spark, d)), "temporal_bug_memory", "bug_recency_score")


_GAPS = """gaps AS (SELECT * FROM (SELECT repo, file, commit_id,
  floor((epoch_us(commit_time) - epoch_us(lag(commit_time) OVER (PARTITION BY repo, file ORDER BY commit_time, commit_id))) / 86400000000.0)::BIGINT AS gap_days FROM cf) WHERE gap_days IS NOT NULL)"""


@query(f"{_CF}, {_GAPS} SELECT * FROM gaps")
def commit_gaps(spark, d):
    return H.commit_gaps(commit_files(spark, d))


_BURST = f""", {_GAPS}, g AS (SELECT repo, file, avg(gap_days) AS a, min(gap_days) AS m FROM gaps GROUP BY repo, file),
c AS (SELECT repo, file, count(*) AS commits, count(*) FILTER (WHERE age_days < 30) AS c1 FROM ag GROUP BY repo, file),
b AS (SELECT repo, file, CASE WHEN commits >= 3 AND a > 0 THEN least(ln(1 + a / (m + 1e-5::DOUBLE)), 5) ELSE 0 END AS s, c1 / (commits + 1)::DOUBLE AS r FROM c LEFT JOIN g USING (repo, file))
SELECT repo, file, round(s, 6) AS commit_burst_score, (s > 3)::INTEGER AS recent_commit_burst, round(r, 6) AS burst_ratio, round(s * r, 6) AS burst_risk FROM b"""


@query(f"{_AGED}{_BURST}")
def commit_burst(spark, d):
    return _rounded(H.commit_burst(commit_files(spark, d)), "commit_burst_score", "burst_ratio", "burst_risk")


@query(f"{_EV}{_BURST}")
def commit_burst_events(spark, d):
    return _rounded(H.commit_burst(event_commits(spark, d)), "commit_burst_score", "burst_ratio", "burst_risk")


_PAIRS = """sized AS (SELECT repo, commit_id, file, count(*) OVER (PARTITION BY repo, commit_id) AS n FROM cf),
small AS (SELECT * FROM sized WHERE n BETWEEN 2 AND {cap}),
pairs AS (SELECT a.repo, a.file AS src, b.file AS dst, count(*) AS n FROM small a JOIN small b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.file <> b.file GROUP BY 1, 2, 3)"""

# an order mixes brands, so the whole order is the commit here and all parts are one repository
_ORDER_CF = f"""WITH {COMMIT_FILES.replace("cf AS", "cf0 AS")}, cf AS (SELECT 'all' AS repo, commit_id, author, commit_time, file, added, deleted, is_fix FROM cf0)"""


def _orders(spark, d):
    return commit_files(spark, d).withColumn("repo", F.lit("all"))


# every order counts here, whatever its number of parts
@query(f"{_ORDER_CF} SELECT a.repo, a.file AS src, b.file AS dst, count(*) AS n FROM cf a JOIN cf b ON a.repo = b.repo AND a.commit_id = b.commit_id AND a.file <> b.file GROUP BY 1, 2, 3")
def co_change(spark, d):
    return H.co_change(_orders(spark, d), 2, None)


_COUPLING = f"""{_ORDER_CF}, {_PAIRS.format(cap=30)},
f AS (SELECT repo, file, count(*) AS commits, max(commit_time) AS last, min(commit_time) AS first FROM cf GROUP BY repo, file),
best AS (SELECT repo, src AS file, arg_max(dst, (n, -dst)) AS partner, max(n) AS top, count(*) AS partners FROM pairs GROUP BY repo, src),
j AS (SELECT f.repo, f.file, partner, coalesce(top / f.commits::DOUBLE, 0) AS s, coalesce(partners, 0) AS k, coalesce((f.last > p.last EXTRA)::INTEGER, 0) AS flag
  FROM f LEFT JOIN best ON f.repo = best.repo AND f.file = best.file LEFT JOIN f p ON p.repo = f.repo AND p.file = partner)
SELECT repo, file, coalesce(partner, -1) AS partner, round(s, 6) AS max_coupling_strength, k AS coupled_file_count, flag AS coupled_recent_missing, round(s * flag, 6) AS coupling_risk FROM j"""


@query(_COUPLING.replace("EXTRA", ""))
def coupling(spark, d):
    return _rounded(H.coupling(_orders(spark, d)), "max_coupling_strength", "coupling_risk").fillna({"partner": -1})


@query(_COUPLING.replace("EXTRA", "AND p.first > f.first"))
def coupling_strict_order(spark, d):
    return _rounded(H.coupling(_orders(spark, d), strict_order=True), "max_coupling_strength", "coupling_risk").fillna({"partner": -1})


_PARTNER = f"""{_ORDER_CF}, {_PAIRS.format(cap=30)}, f AS (SELECT file, max(commit_time) AS last FROM cf GROUP BY file), best AS (SELECT src AS file, arg_max(dst, (n, -dst)) AS partner FROM pairs GROUP BY src)
SELECT 'all' AS repo, best.file, partner, f.last AS partner_last FROM best LEFT JOIN f ON f.file = partner"""


@query(_PARTNER)
def coupling_partner(spark, d):
    cf = _orders(spark, d)
    last = cf.groupBy("repo", F.col("file").alias("partner")).agg(F.max("commit_time").cast("timestamp_ntz").alias("partner_last"))
    return H.coupling(cf).where("partner IS NOT NULL").select("repo", "file", "partner").join(last, ["repo", "partner"], "left").select("repo", "file", "partner", "partner_last")


@query(f"""{_AGED.replace("cf AS", "cf AS")}, c AS ({_CHURN}), a AS ({_AUTHORS}), r AS ({_RECENT}), x AS ({_FIXES}), l AS ({_FIRST_LAST})
SELECT c.*, author_count, ownership, low_history_flag, minor_contributor_ratio, commits_2w, commits_1m, commits_3m, bug_fixes, days_since_last_bug, first_commit, last_commit, file_age, days_since_last_change
FROM c JOIN a USING (repo, file) JOIN r USING (repo, file) JOIN x USING (repo, file) JOIN l USING (repo, file)""")
def history_features(spark, d):
    out = H.history_features(commit_files(spark, d))
    keep = ["repo", "file", "commits", "lines_added", "lines_deleted", "max_added", "author_count", "ownership", "low_history_flag", "minor_contributor_ratio", "commits_2w", "commits_1m", "commits_3m", "bug_fixes", "days_since_last_bug", "first_commit", "last_commit", "file_age", "days_since_last_change"]
    return _rounded(out.select(*keep), "ownership", "minor_contributor_ratio")
