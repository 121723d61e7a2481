"""Labels, features, risk, metrics, reports, checks and set operations over the graded tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectloom.functions.core import r6
from defectloom.operators import features as FT
from defectloom.operators import history as H
from defectloom.operators import labels as L
from defectloom.operators import metrics as M
from defectloom.operators import quality as Q
from defectloom.operators import ranking as R
from defectloom.operators import reports as RP
from defectloom.plans.bindings import COMMIT_FILES, LABELLED, PATHS, SCORED, STATIC, commit_files, labelled, scored, static_metrics, table, url_paths
from defectloom.plans.registry import query

_SC, _LB, _ST, _PT, _CF = (f"WITH {x}" for x in (SCORED, LABELLED, STATIC, PATHS, COMMIT_FILES))


def _r(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


# ---- labels

_NORM = "trim(regexp_replace(lower(replace(coalesce(path, ''), '\\', '/')), '^(\\./|/)', ''), '/')"
_CLEAN = "array_to_string(string_split(replace(replace(replace({p}, 'src/', ''), 'lib/', ''), 'app/', ''), '/')[greatest(len(string_split(replace(replace(replace({p}, 'src/', ''), 'lib/', ''), 'app/', ''), '/')) - 1, 1):], '/')"
_BASE = "regexp_extract({p}, '[^/]*$')"


def _label_inputs(spark, d):
    from defectloom.functions import paths as P

    p = url_paths(spark, d).withColumn("norm_path", P.norm_path(F.col("path")))
    files = p.select(F.lit("web").alias("repo"), F.col("file_id").alias("file"), "norm_path")
    third = p.where(F.col("file_id") % 3 == 0)
    moved = F.when(F.col("file_id") % 2 == 0, F.col("norm_path")).otherwise(F.concat(F.lit("moved/"), F.col("norm_path")))
    labels = third.select(F.lit("web").alias("repo"), moved.alias("norm_path"), (F.col("file_id") % 7)).groupBy("repo", "norm_path").agg(F.max("(file_id % 7)").alias("k"))
    return files, labels.select("repo", "norm_path", F.when(F.col("k") > 3, 1.0).otherwise(0.7).alias("confidence"), (F.col("k") + 1).cast("long").alias("bug_count"))


_LABEL_IN = f"""{_PT}, fl AS (SELECT file_id AS file, {_NORM} AS norm_path FROM pt),
lbl AS (SELECT key, CASE WHEN k > 3 THEN 1.0::DOUBLE ELSE 0.7 END AS confidence, k + 1 AS bug_count
  FROM (SELECT CASE WHEN file % 2 = 0 THEN norm_path ELSE 'moved/' || norm_path END AS key, max(file % 7) AS k FROM fl WHERE file % 3 = 0 GROUP BY 1))"""


@query(f"""{_LABEL_IN}, f AS (SELECT *, {_CLEAN.format(p='norm_path')} AS clean, {_BASE.format(p='norm_path')} AS name, string_split(norm_path, '/') AS ps FROM fl),
k AS (SELECT *, {_CLEAN.format(p='key')} AS k_clean, {_BASE.format(p='key')} AS name FROM lbl),
j AS (SELECT f.file, key, confidence, bug_count, norm_path,
  CASE WHEN key = norm_path THEN 1 WHEN k_clean = clean THEN 2 WHEN len(ps) >= 2 AND ends_with(key, array_to_string(ps[-2:], '/')) THEN 3
       WHEN len(ps) >= 3 AND ends_with(key, array_to_string(ps[-3:], '/')) THEN 4 ELSE 5 END AS stage FROM f JOIN k ON f.name = k.name OR clean = k_clean),
o AS (SELECT *, CASE WHEN stage = 5 THEN -len(list_intersect(list_distinct(string_split(regexp_replace(norm_path, '/?[^/]*$', ''), '/')), list_distinct(string_split(regexp_replace(key, '/?[^/]*$', ''), '/')))) ELSE 0 END AS overlap FROM j),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY stage, overlap, length(key), key) AS r FROM o) WHERE r = 1)
SELECT 'web' AS repo, fl.file, coalesce(stage, 0) AS stage, key AS matched, CASE WHEN key IS NULL THEN 0 ELSE 1 END AS buggy, coalesce(confidence, 0.3) AS confidence,
  CASE WHEN key IS NULL THEN 'clean' ELSE 'szz' END AS source, round(CASE WHEN key IS NULL THEN 0 ELSE least(bug_count * confidence, 5.0) END, 6) AS bug_score FROM fl LEFT JOIN b ON fl.file = b.file""")
def label_match(spark, d):
    return _r(L.label_match(*_label_inputs(spark, d)), "bug_score")


@query(f"""{_LABEL_IN}, n AS (SELECT {_BASE.format(p='key')} AS name, arg_min(confidence, key) AS c2 FROM lbl GROUP BY 1)
SELECT 'web' AS repo, file, coalesce(confidence, c2) AS confidence, CASE WHEN confidence IS NOT NULL THEN 'exact' WHEN c2 IS NOT NULL THEN 'name' ELSE 'none' END AS matched_by
FROM fl LEFT JOIN lbl ON norm_path = key LEFT JOIN n ON n.name = {_BASE.format(p='norm_path')}""")
def szz_path_match(spark, d):
    return L.two_stage_match(*_label_inputs(spark, d))


@query(f"""{_LABEL_IN}, f AS (SELECT *, {_BASE.format(p='norm_path')} AS name FROM fl), s AS (SELECT norm_path, stage FROM (SELECT 1 AS norm_path, 1 AS stage)), j AS (
  SELECT file, CASE WHEN EXISTS (SELECT 1 FROM lbl WHERE key = norm_path) THEN 1 WHEN EXISTS (SELECT 1 FROM lbl WHERE {_BASE.format(p='key')} = f.name) THEN 2 ELSE 0 END AS hit FROM f)
SELECT hit AS stage, count(*) AS files, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM j GROUP BY hit""")
def label_audit(spark, d):
    m = L.two_stage_match(*_label_inputs(spark, d)).withColumn("stage", F.when(F.col("matched_by") == "exact", 1).when(F.col("matched_by") == "name", 2).otherwise(0))
    return _r(Q.label_audit(m), "share")


@query(f"""{_CF}, n AS (SELECT repo, commit_id, count(*) AS k FROM cf GROUP BY 1, 2)
SELECT cf.repo, file, max(c) AS confidence, count(*) AS bug_count FROM (SELECT *, CASE WHEN is_fix = 1 THEN CASE WHEN added > 25 THEN 1.0::DOUBLE ELSE 0.7 END ELSE 0 END AS c FROM cf) cf JOIN n USING (repo, commit_id) WHERE k <= 2 AND c > 0 GROUP BY cf.repo, file""")
def szz_inline(spark, d):
    cf = commit_files(spark, d).withColumn("confidence", F.when(F.col("is_fix") == 1, F.when(F.col("added") > 25, 1.0).otherwise(0.7)).otherwise(0.0))
    return L.szz_inline(cf, 2)


@query(f"""{_CF}, a AS (SELECT max(commit_time) AS m FROM cf), c AS (SELECT commit_id, count(*) AS n_files, max(is_fix) AS fix, sum(added) AS s, min(commit_time) AS t FROM cf GROUP BY commit_id),
x AS (SELECT CASE WHEN commit_id % 10 = 0 THEN 'merge' WHEN fix = 0 THEN 'not_fix' WHEN floor((epoch_us(m) - epoch_us(t)) / 86400000000.0) > 1500 THEN 'window' WHEN n_files > 6 THEN 'files' WHEN s <= 50 THEN 'confidence' ELSE 'kept' END AS reason FROM c, a)
SELECT reason, count(*) AS files, round((SELECT count(*) FILTER (WHERE reason <> 'kept') / count(*)::DOUBLE FROM x), 6) AS drop_rate FROM x GROUP BY reason""")
def szz_filter_chain(spark, d):
    cf = commit_files(spark, d)
    newest = cf.agg(F.max("commit_time").alias("m"))
    per = cf.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n_files"), F.max("is_fix").alias("fix"), F.sum("added").alias("s"), F.min("commit_time").alias("t")).crossJoin(F.broadcast(newest))
    from defectloom.functions.core import days

    x = per.select((F.col("commit_id") % 10 == 0).alias("is_merge"), F.when(F.col("fix") == 0, 0.0).when(F.col("s") > 50, 0.7).otherwise(0.3).alias("confidence"), days(F.col("t"), F.col("m")).alias("age_days"), "n_files")
    return _r(RP.drop_rate(L.szz_filter_chain(x, max_files=6, window_days=1500)), "drop_rate")


_MARKS = {"en": ("The", "Of"), "de": ("Der",)}
_CHAIN = """ch AS (SELECT doc_id AS commit_id, source AS repo, text, lang, doc_id % 13 = 0 AS is_merge, CASE doc_id % 7 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.3 WHEN 2 THEN 1.0 ELSE 0.7 END AS confidence,
    (doc_id % 400) * 7.5::DOUBLE AS age_days, doc_id % 23 AS n_files, doc_id % 9 AS changed,
    CASE doc_id % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'build/' WHEN 2 THEN '' ELSE 'Src/' END || lang || '/f' || doc_id % 50 || CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '_test.py' WHEN 2 THEN '.js' ELSE '.py' END AS new_path FROM documents),
  pa AS (SELECT *, lower(new_path) AS path, string_split(text, chr(10)) AS ls, lag(commit_id) OVER (PARTITION BY repo, new_path ORDER BY commit_id) AS intro FROM ch),
  re AS (SELECT *, len(list_filter(ls[:changed], lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
      AND NOT (lang = 'en' AND (starts_with(ltrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'The') OR starts_with(ltrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'Of')))
      AND NOT (lang = 'de' AND starts_with(ltrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'Der')))) AS code FROM pa),
  fi AS (SELECT *, CASE WHEN is_merge THEN 'merge' WHEN confidence <= 0 THEN 'not_fix' WHEN age_days > 2555 THEN 'window' WHEN n_files > 20 THEN 'files' WHEN confidence < 0.4 THEN 'confidence'
    WHEN starts_with(path, 'tests/') OR contains(path, '_test') THEN 'test' WHEN starts_with(path, 'build/') THEN 'generated' WHEN ends_with(path, '.md') THEN 'extension'
    WHEN NOT (changed >= 3 AND code >= CASE WHEN changed <= 5 THEN 1 ELSE 2 END AND changed / len(ls)::DOUBLE >= 0.3) THEN 'trivial' WHEN intro IS NULL THEN 'blame' ELSE 'kept' END AS reason FROM re)"""


def _file_chain(spark, d):
    """Documents as files that commits of known ages, sizes and confidences change; an earlier change of a file stands for who wrote its lines."""
    from pyspark.sql.window import Window

    i = F.col("doc_id")
    name = F.concat(F.when(i % 6 == 0, "tests/").when(i % 6 == 1, "build/").when(i % 6 == 2, "").otherwise("Src/"), F.col("lang"), F.lit("/f"), (i % 50).cast("string"), F.when(i % 5 == 0, ".md").when(i % 5 == 1, "_test.py").when(i % 5 == 2, ".js").otherwise(".py"))
    x = table(spark, d, "documents").select(
        i.alias("commit_id"),
        F.col("source").alias("repo"),
        "text",
        "lang",
        (i % 13 == 0).alias("is_merge"),
        F.when(i % 7 == 0, 0.0).when(i % 7 == 1, 0.3).when(i % 7 == 2, 1.0).otherwise(0.7).alias("confidence"),
        ((i % 400) * 7.5).alias("age_days"),
        (i % 23).alias("n_files"),
        (i % 9).alias("changed"),
        F.lit(None).cast("string").alias("old_path"),
        name.alias("new_path"),
    )
    x = x.withColumn("intro", F.lag("commit_id").over(Window.partitionBy("repo", "new_path").orderBy("commit_id")))
    real = L.substantive(F.col("changed"), F.col("text"), F.lit(None).cast("string"), F.col("lang"), min_churn_ratio=0.3, marks=_MARKS)
    return L.szz_file_chain(x, real, F.col("intro").isNotNull())


@query(f"WITH {_CHAIN} SELECT reason, count(*) AS files, round((SELECT count(*) FILTER (WHERE reason <> 'kept') / count(*)::DOUBLE FROM fi), 6) AS drop_rate FROM fi GROUP BY reason")
def szz_file_chain(spark, d):
    """Skip counts of the whole chain, of commits and of their files."""
    return _r(RP.drop_rate(_file_chain(spark, d)), "drop_rate")


@query(f"WITH {_CHAIN} SELECT repo, path, max(confidence) AS confidence, count(*) AS bug_count FROM fi WHERE reason = 'kept' GROUP BY repo, path")
def szz_chain_labels(spark, d):
    return L.szz_labels(_file_chain(spark, d).where("reason = 'kept'"), path="path")


def _two_sources(spark, d):
    labels = table(spark, d, "labels")
    szz = labels.where("quality = 0").select(F.col("doc_id").alias("path"), F.lit(0.7).alias("confidence"))
    issues = labels.where("toxic = 1").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 2 == 0, 0.9).otherwise(0.5).alias("confidence"))
    return szz, issues


_HYBRID = """hy AS (SELECT coalesce(s.doc_id, i.doc_id) AS path, true AS is_buggy, greatest(coalesce(sc, 0), coalesce(ic, 0)) AS confidence, CASE WHEN coalesce(ic, 0) > 0 THEN 'issue' ELSE 'szz' END AS source,
  coalesce(sc, 0) AS szz_confidence, coalesce(ic, 0) AS issue_confidence
FROM (SELECT doc_id, 0.7::DOUBLE AS sc FROM labels WHERE quality = 0) s FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS ic FROM labels WHERE toxic = 1) i ON s.doc_id = i.doc_id)"""


@query(f"WITH {_HYBRID} SELECT * FROM hy")
def hybrid_outer(spark, d):
    return L.hybrid_labels(*_two_sources(spark, d))


@query(f"WITH {_HYBRID} SELECT doc_id AS path, coalesce(is_buggy, false) AS is_buggy, coalesce(confidence, 0) AS confidence, coalesce(hy.source, 'none') AS source FROM documents LEFT JOIN hy ON doc_id = path")
def apply_labels(spark, d):
    return L.apply_labels(table(spark, d, "documents").select(F.col("doc_id").alias("path")), L.hybrid_labels(*_two_sources(spark, d)))


@query(f"WITH {_HYBRID} SELECT count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low, round(avg(confidence), 6) AS mean FROM hy")
def confidence_bands(spark, d):
    return _r(Q.confidence_bands(L.hybrid_labels(*_two_sources(spark, d))), "mean")


@query(f"WITH {_HYBRID} SELECT source, count(*) AS files, round(avg(confidence), 6) AS mean_confidence FROM hy GROUP BY source")
def source_breakdown(spark, d):
    return _r(Q.source_breakdown(L.hybrid_labels(*_two_sources(spark, d))), "mean_confidence")


@query(f"""{_PT}, ms AS (SELECT CASE WHEN file_id % 2 = 0 THEN path ELSE 'x/' || path END AS path, 'm' || file_id AS msg FROM pt WHERE file_id % 4 < 2), f AS (SELECT *, {_NORM} AS np FROM pt),
m AS (SELECT *, {_NORM} AS np FROM ms), a AS (SELECT path, min(msg) AS v FROM m GROUP BY 1), b AS (SELECT {_CLEAN.format(p='np')} AS c, min(msg) AS v FROM m GROUP BY 1), n AS (SELECT {_BASE.format(p='path')} AS c, min(msg) AS v FROM m GROUP BY 1)
SELECT file_id AS file, coalesce(a.v, b.v, CASE WHEN length({_BASE.format(p='f.path')}) > 6 THEN n.v END) AS msg FROM f LEFT JOIN a ON f.path = a.path LEFT JOIN b ON {_CLEAN.format(p='f.np')} = b.c LEFT JOIN n ON {_BASE.format(p='f.path')} = n.c""")
def message_match(spark, d):
    p = url_paths(spark, d)
    ms = p.where(F.col("file_id") % 4 < 2).select(F.when(F.col("file_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("x/"), F.col("path"))).alias("path"), F.concat(F.lit("m"), F.col("file_id").cast("string")).alias("msg"))
    return L.message_match(p.select(F.col("file_id").alias("file"), "path"), ms)


@query("SELECT count(*) AS total, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS matched, round(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) / count(*)::DOUBLE, 6) AS match_rate FROM (SELECT DISTINCT doc_id FROM documents)")
def match_rate(spark, d):
    return _r(L.match_rate(table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("path")), table(spark, d, "documents").select(F.col("doc_id").alias("path"))), "match_rate")


@query(f"{_PT}, b AS (SELECT file_id, path, path LIKE '%/en/%' AS en, {_BASE.format(p='path')} AS name FROM pt), s AS (SELECT name FROM b GROUP BY name HAVING count(DISTINCT en) > 1) SELECT file_id, s.name IS NOT NULL AS has_shared_filename FROM b LEFT JOIN s ON b.name = s.name")
def shared_filename(spark, d):
    return L.shared_filename(url_paths(spark, d).withColumn("repo", F.col("path").contains("/en/"))).select("file_id", "has_shared_filename")


@query(f"""{_PT}, x AS (SELECT file_id, CASE file_id % 3 WHEN 0 THEN 'a/' || file_id || '.py' WHEN 1 THEN 'a/test_' || (file_id - 1) || '.py' ELSE 'tests/' || (file_id - 2) || '_spec.py' END AS path FROM pt), p AS (SELECT path FROM x)
SELECT file_id, (starts_with(path, 'a/') AND NOT contains(path, 'test_') AND (('a/test_' || regexp_extract(path, '(\\d+)', 1) || '.py') IN (SELECT path FROM p) OR ('tests/' || regexp_extract(path, '(\\d+)', 1) || '_spec.py') IN (SELECT path FROM p))) AS has_test_file FROM x""")
def has_test_file(spark, d):
    i = F.col("file_id")
    s = lambda n: (i - n).cast("string")
    path = F.when(i % 3 == 0, F.concat(F.lit("a/"), s(0), F.lit(".py"))).when(i % 3 == 1, F.concat(F.lit("a/test_"), s(1), F.lit(".py"))).otherwise(F.concat(F.lit("tests/"), s(2), F.lit("_spec.py")))
    return L.has_test_file(url_paths(spark, d).select("file_id", path.alias("path"))).select("file_id", "has_test_file")


@query(f"{_PT}, t(term) AS (VALUES ('BLOG'), ('spam'), ('/en/7')) SELECT term, arg_min(path, file_id) AS path, min(file_id) AS file FROM pt JOIN t ON contains(lower(path), lower(term)) GROUP BY term")
def name_lookup_first(spark, d):
    terms = spark.createDataFrame([("BLOG",), ("spam",), ("/en/7",)], "term string")
    return L.name_lookup_first(url_paths(spark, d).withColumnRenamed("file_id", "file"), terms)


@query(f"{_SC}, x AS (SELECT repo, file, buggy, risk AS confidence, CASE WHEN risk > 0.6 THEN 1 ELSE 0 END AS b FROM sc), w AS (SELECT repo, file, confidence, b, count(*) OVER (PARTITION BY repo) AS n, sum(b) OVER (PARTITION BY repo) AS s, row_number() OVER (PARTITION BY repo ORDER BY b DESC, confidence DESC, file) AS r FROM x) SELECT repo, file, CASE WHEN s > 0.5 * n AND b = 1 AND r > floor(0.45 * n) THEN 0 ELSE b END AS adjusted_buggy, CASE WHEN s > 0.5 * n AND b = 1 AND r > floor(0.45 * n) THEN 'adjusted' WHEN b = 1 THEN 'szz' ELSE 'clean' END AS source FROM w")
def demote_lowest_confidence(spark, d):
    x = scored(spark, d).select("repo", "file", F.col("risk").alias("confidence"), (F.col("risk") > 0.6).cast("int").alias("buggy"))
    return R.demote_lowest_confidence(x).select("repo", "file", "adjusted_buggy", "source")


# ---- joins of sets

_ANTI = "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 1000)"


@query(_ANTI)
def lost_files_anti(spark, d):
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("n_chars > 1000").select("doc_id"), "doc_id", "left_anti")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def already_processed_anti(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id").join(e.where("event_type = 'error'").select("event_id"), "event_id", "left_anti")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def changed_semi(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")


@query(f"{_PT}, b AS (SELECT DISTINCT {_BASE.format(p='path')} AS name FROM pt WHERE file_id % 5 = 0) SELECT file_id, b.name IS NOT NULL AS known_buggy FROM pt LEFT JOIN b ON {_BASE.format(p='path')} = b.name")
def pr_known_buggy(spark, d):
    from defectloom.functions import paths as P

    p = url_paths(spark, d).withColumn("name", P.basename(F.col("path")))
    known = p.where(F.col("file_id") % 5 == 0).select("name").distinct().withColumn("k", F.lit(True))
    return p.join(known, "name", "left").select("file_id", F.coalesce("k", F.lit(False)).alias("known_buggy"))


@query("SELECT c.c_custkey, n.n_name, n.n_regionkey = 1 AS is_test FROM customer c JOIN nation n ON c_nationkey = n_nationkey")
def lopo_split(spark, d):
    """Leave one project (region) out: rows with the flag of the test part."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", (F.col("n_regionkey") == 1).alias("is_test"))


@query("SELECT doc_id, source AS repo, -1::BIGINT AS event_id FROM documents UNION ALL SELECT -1, 'events', event_id FROM events")
def union_repos(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.col("source").alias("repo"))
    return a.unionByName(table(spark, d, "events").select("event_id", F.lit("events").alias("repo")), allowMissingColumns=True).withColumns({c: F.coalesce(c, F.lit(-1).cast("long")) for c in ("doc_id", "event_id")})


def _keys(spark, d):
    return table(spark, d, "labels").select("doc_id"), table(spark, d, "documents").where("n_chars > 1000").select("doc_id")


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE n_chars > 1000")
def key_union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@query("SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE n_chars > 1000")
def key_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE n_chars > 1000")
def key_except(spark, d):
    a, b = _keys(spark, d)
    return a.subtract(b)


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").distinct()


# ---- features

_BASES = {"en": 60.0, "de": 80.0, "fr": 70.0}
_IDS = {"en": 0, "de": 1, "fr": 2}


def _joined(spark, d):
    cf = commit_files(spark, d)
    hist = H.file_history(cf).join(H.author_stats(cf), ["repo", "file"]).drop("repo")
    return FT.static_left_history(static_metrics(spark, d), hist, ["file"], ["commits", "lines_added", "lines_deleted", "max_added", "commits_2w", "commits_1m", "commits_3m", "author_count", "file_age", "days_since_last_change", "minor_contributor_ratio"])


_JOINED = f"""WITH {COMMIT_FILES}, {STATIC}, an AS (SELECT repo, max(commit_time) AS anchor FROM cf GROUP BY repo),
ag AS (SELECT cf.*, floor((epoch_us(anchor) - epoch_us(commit_time)) / 86400000000.0)::BIGINT AS age FROM cf JOIN an USING (repo)),
hi AS (SELECT file, count(*) AS commits, sum(added)::BIGINT AS lines_added, sum(deleted)::BIGINT AS lines_deleted, max(added) AS max_added, max(age) AS file_age, min(age) AS days_since_last_change,
  count(*) FILTER (WHERE age < 14) AS commits_2w, count(*) FILTER (WHERE age < 30) AS commits_1m, count(*) FILTER (WHERE age < 90) AS commits_3m FROM ag GROUP BY file),
au AS (SELECT file, count(*) AS author_count, count(*) FILTER (WHERE n = 1) / count(*)::DOUBLE AS minor FROM (SELECT file, author, count(*) AS n FROM cf GROUP BY 1, 2) GROUP BY file),
j AS (SELECT st.*, coalesce(commits, 0) AS commits, coalesce(lines_added, 0) AS lines_added, coalesce(lines_deleted, 0) AS lines_deleted, coalesce(max_added, 0) AS max_added, coalesce(file_age, 0) AS file_age,
  coalesce(days_since_last_change, 0) AS days_since, coalesce(commits_2w, 0) AS c2w, coalesce(commits_1m, 0) AS c1m, coalesce(commits_3m, 0) AS c3m, coalesce(author_count, 0) AS author_count, coalesce(minor, 0) AS minor
  FROM st LEFT JOIN hi ON st.file = hi.file LEFT JOIN au ON st.file = au.file)
"""


@query(f"{_JOINED} SELECT file, loc, commits, lines_added, file_age, author_count FROM j")
def static_left_git(spark, d):
    return _joined(spark, d).select("file", "loc", "commits", "lines_added", "file_age", "author_count")


@query(f"""{_JOINED} SELECT file, CASE language WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 10 END AS language_id,
 avg_complexity / CASE language WHEN 'en' THEN 60.0::DOUBLE WHEN 'de' THEN 80 WHEN 'fr' THEN 70 ELSE 4 END AS complexity_vs_baseline,
 avg_complexity / greatest(loc, 1) AS complexity_density, avg_complexity / greatest(functions, 1) AS complexity_per_function, loc / greatest(functions, 1)::DOUBLE AS loc_per_function,
 c1m / greatest(commits, 1)::DOUBLE AS recent_churn_ratio, CASE WHEN c3m > 0 THEN c2w / c3m::DOUBLE ELSE 0 END AS recent_activity_score,
 (lines_added + lines_deleted) / greatest(loc, 1)::DOUBLE AS instability_score, (lines_added + lines_deleted) / greatest(commits, 1)::DOUBLE AS avg_commit_size,
 CASE WHEN lines_added + lines_deleted > 0 THEN max_added / ((lines_added + lines_deleted) / greatest(commits, 1)::DOUBLE) ELSE 0 END AS max_commit_ratio,
 CASE WHEN least(file_age, 3650) < 180 THEN 0 WHEN least(file_age, 3650) < 365 THEN 1 WHEN least(file_age, 3650) < 730 THEN 2 ELSE 3 END AS file_age_bucket,
 least(days_since, 3650) / (least(file_age, 3650) + 1)::DOUBLE AS recency_ratio, (lines_added + lines_deleted) / greatest(loc, 1)::DOUBLE AS churn_ratio, minor AS author_entropy,
 CASE WHEN author_count <= 1 THEN 1.0::DOUBLE WHEN author_count <= 3 THEN 0.7 ELSE 0.3 END AS experience_score FROM j""")
def build_features(spark, d):
    f = ["complexity_vs_baseline", "complexity_density", "complexity_per_function", "loc_per_function", "recent_churn_ratio", "recent_activity_score", "instability_score", "avg_commit_size", "max_commit_ratio", "recency_ratio", "churn_ratio", "author_entropy"]
    # single divisions of whole numbers are the same in every engine, so nothing is rounded
    return FT.build_features(_joined(spark, d), _BASES, _IDS).select("file", "language_id", "file_age_bucket", "experience_score", *f)


@query(f"{_ST} SELECT repo, round(avg(max_complexity), 6) AS avg_complexity, max(max_complexity) AS max_complexity, count(*) AS functions, round(avg(functions), 6) AS avg_params, max(loc) AS max_function_length, round(sum(max_complexity) / greatest(sum(loc), 1)::DOUBLE, 6) AS complexity_density FROM st GROUP BY repo")
def function_rollup(spark, d):
    fns = static_metrics(spark, d).select("repo", F.col("max_complexity").alias("cx"), F.col("loc").alias("length"), F.col("functions").alias("params"))
    return _r(FT.function_rollup(fns, ["repo"]), "avg_complexity", "avg_params", "complexity_density")


@query(f"{_ST} SELECT repo, string_agg(file, ',' ORDER BY max_complexity DESC, loc DESC, file) AS top_functions FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY max_complexity DESC, loc DESC, file) AS r FROM st) WHERE r <= 5 GROUP BY repo")
def top_functions(spark, d):
    return FT.top_functions(static_metrics(spark, d).select("repo", F.col("max_complexity").alias("cx"), F.col("loc").alias("length"), F.col("file").alias("name")), ["repo"])


_COLS = ["loc", "functions", "avg_complexity", "max_complexity", "risk"]


@query(f"{_LB} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM lb" for a, b in [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]] + [(c, "buggy") for c in _COLS]))
def corr_matrix(spark, d):
    return _r(FT.correlations(labelled(spark, d), _COLS, "buggy"), "r")


@query(f"{_LB} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(coalesce(abs(corr({c}, buggy)), 0), 6) AS r, CASE WHEN '{c}' IN ('risk') THEN 'name' WHEN abs(corr({c}, buggy)) > 0.9 THEN 'correlation' ELSE 'ok' END AS status FROM lb" for c in _COLS))
def leakage_screen(spark, d):
    return _r(Q.leakage_screen(FT.correlations(labelled(spark, d), _COLS, "buggy"), "buggy"), "r")


_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]]


@query(f"""{_LB.replace('WITH', 'WITH RECURSIVE', 1)}, p AS ({' UNION ALL '.join(f"SELECT {k} AS k, '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r, coalesce(abs(corr({a}, buggy)), 0) AS ra, coalesce(abs(corr({b}, buggy)), 0) AS rb FROM lb" for k, (a, b) in enumerate(_PAIRS, 1))}),
s(k, gone) AS (SELECT 0, []::VARCHAR[] UNION ALL SELECT p.k, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) OR r <= 0.9 THEN gone WHEN ra >= rb THEN list_append(gone, b) ELSE list_append(gone, a) END FROM s JOIN p ON p.k = s.k + 1),
c AS (SELECT unnest({_COLS}) AS feature, unnest(range({len(_COLS)})) AS i)
SELECT (row_number() OVER (ORDER BY i) - 1)::INTEGER AS position, feature FROM c WHERE NOT list_contains((SELECT gone FROM s WHERE k = {len(_PAIRS)}), feature)""")
def correlation_prune(spark, d):
    left = FT.correlation_prune(labelled(spark, d), _COLS, "buggy", 0.9)
    return spark.createDataFrame([(i, c) for i, c in enumerate(left)], "position int, feature string")


@query(f"{_LB} SELECT coalesce(loc, 0)::DOUBLE AS loc, coalesce(functions, 0)::DOUBLE AS functions, 7.5::DOUBLE AS absent FROM lb")
def project_features(spark, d):
    return FT.project_features(labelled(spark, d), ["loc", "functions", "absent"], {"absent": 7.5})


@query(f"{_LB} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.99), 6) AS p99, round(quantile_cont({c}::DOUBLE, 0.01), 6) AS p01 FROM lb" for c in _COLS))
def training_stats(spark, d):
    return _r(M.training_stats(labelled(spark, d), _COLS), "mean", "std", "median", "p99", "p01")


@query(f"{_SC} SELECT repo, round(median(loc), 6) AS loc, round(median(avg_complexity), 6) AS avg_complexity FROM sc GROUP BY repo")
def repo_medians(spark, d):
    x = scored(spark, d)
    loc, complexity = (M.group_percentile(x, c, 0.5, ["repo"]).withColumnRenamed("value", c) for c in ("loc", "avg_complexity"))
    return _r(loc.join(complexity, "repo"), "loc", "avg_complexity")


@query(f"{_SC}, x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(var_samp({c}), 0) AS v, avg(({c} IS NULL)::INTEGER) AS m FROM sc" for c in [*_COLS, "quality"]) + ") SELECT feature, round(v, 4) AS variance, round(m, 6) AS missing, CASE WHEN m > 0.1 THEN 'missing' WHEN v = 0 THEN 'constant' WHEN v < 1e-6 THEN 'low' WHEN v > 1e6 THEN 'high' ELSE 'ok' END AS status FROM x")
def variance_screen(spark, d):
    return _r(Q.variance_screen(scored(spark, d), [*_COLS, "quality"]), "missing").withColumn("variance", F.round("variance", 4))


@query(f"{_SC}, s AS (SELECT avg((quality IS NULL)::INTEGER) AS m, median(quality) AS v FROM sc) SELECT file, CASE WHEN m > 0.1 THEN coalesce(quality, v) ELSE quality END::DOUBLE AS quality, coalesce(language, 'unknown') AS language FROM sc, s")
def impute_median_mode(spark, d):
    return Q.impute_median_mode(scored(spark, d).select("file", "quality", "language"), ["quality"], ["language"])
