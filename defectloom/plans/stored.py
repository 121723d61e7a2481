"""Sources and sinks: what is written comes back; fixture tables stand for remote services."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.functions import text as X
from defectloom.functions.core import days, r6
from defectloom.ml import models as ML
from defectloom.operators import features as FT
from defectloom.operators import labels as L
from defectloom.operators import metrics as M
from defectloom.operators import risk as K
from defectloom.plans.bindings import COMMIT_FILES, LABELLED, SCORED, commit_files, labelled, scored, source_text, table
from defectloom.plans.registry import query
from defectloom.session import work_folder
from defectloom.sources import caches as C
from defectloom.sources import clones as CL
from defectloom.sources import source_tree as T

_SC, _LB, _CF = (f"WITH {x}" for x in (SCORED, LABELLED, COMMIT_FILES))
_COLS = ["loc", "functions", "avg_complexity", "max_complexity"]


@query(f"{_SC} SELECT repo, file, buggy FROM sc")
def write_labelled(spark, d):
    folder = work_folder(spark)
    C.write_labelled(scored(spark, d).select("repo", "file", "buggy"), folder)
    return spark.read.schema("file long, buggy int, repo string").parquet(folder).select("repo", "file", "buggy")


@query(f"{_SC} SELECT file, round(risk, 6) AS risk, loc FROM sc")
def write_csv(spark, d):
    folder = work_folder(spark)
    C.write_csv(scored(spark, d).select("file", r6(F.col("risk")).alias("risk"), "loc"), folder)
    return spark.read.option("header", "true").schema("file long, risk double, loc long").csv(folder)


@query(f"{_SC} SELECT repo, count(*) AS files, sum(buggy)::BIGINT AS bugs FROM sc GROUP BY repo")
def save_validation_report(spark, d):
    folder = work_folder(spark)
    C.write_json(scored(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("buggy").alias("bugs")), folder)
    return spark.read.schema("repo string, files long, bugs long").json(folder)


@query(f"{_CF} SELECT repo, file, count(*) AS commits FROM cf GROUP BY repo, file")
def read_miner_cache(spark, d):
    """Aggregates of every repository at its current head; those of an older head are there and stay unread."""
    folder, per = work_folder(spark), commit_files(spark, d).groupBy("repo", "file").agg(F.count(F.lit(1)).alias("commits"))
    C.write_heads(per.select("file", F.lit(0).cast("long").alias("commits"), "repo", F.lit("old").alias("head")), folder, ["repo", "head"])
    C.write_heads(per.select("file", "commits", "repo", F.lit("now").alias("head")), folder, ["repo", "head"])
    heads = per.select("repo", F.lit("now").alias("head")).distinct()
    return C.read_heads(spark, folder, heads, "file long, commits long, repo string, head string").select("repo", "file", "commits")


@query("SELECT doc_id, toxic::INTEGER AS buggy FROM labels WHERE toxic = 1")
def read_szz_cache(spark, d):
    folder, labels = work_folder(spark), table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("buggy"))
    C.write_cache(labels.where("buggy = 0"), folder, cache_version="v15")
    C.write_cache(labels.where("buggy = 1"), folder, cache_version="v16")
    return C.read_cache(spark, folder, cache_version="v16")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def checkpoint_resume(spark, d):
    """Commits left after a stop: those whose hashes the saved state does not have."""
    folder, e = work_folder(spark), table(spark, d, "events").select("event_id")
    e.where("event_id % 3 = 0").write.parquet(folder)
    return e.join(spark.read.schema("event_id long").parquet(folder), "event_id", "left_anti")


@query()
def load_model(spark, d):
    """Scores of files that a model has not seen; it was saved with its statistics and read again by its version."""
    folder = work_folder(spark)
    x, held = ML.stratified_split(labelled(spark, d), "buggy", 0.25, "file")
    C.save_model(spark, ML.fit(x, _COLS), folder, M.training_stats(x, _COLS), _COLS, "v1")
    model, stats, _ = C.load_model(spark, folder)
    return ML.score(model, held, _COLS).select("file", "risk").crossJoin(stats.agg(F.count(F.lit(1)).alias("features")))


@query("SELECT o_orderkey AS commit_id, o_custkey AS author, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders WHERE o_orderkey % 10 <> 0")
def scan_commits(spark, d):
    """Commits without merges (every tenth order), numbered from the oldest; days are counted side by side."""
    o = table(spark, d, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("t"))
    o = o.withColumn("day", F.to_date("t"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = o.groupBy("day").agg(F.count(F.lit(1)).alias("k")).select("day", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    return o.join(starts, "day").select("commit_id", "author", (F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("t", "commit_id"))).alias("seq"))


_BLAME = "bl AS (SELECT repo, file, commit_id AS fix, n, added, lag(commit_id) OVER (PARTITION BY repo, file ORDER BY commit_time, commit_id) AS intro, is_fix FROM (SELECT *, count(*) OVER (PARTITION BY repo, commit_id) AS n FROM cf))"


def _blame(spark, d):
    """The commit before a fix in the same file stands for the one that wrote the lines."""
    before = Window.partitionBy("repo", "file").orderBy("commit_time", "commit_id")
    return commit_files(spark, d).withColumn("intro", F.lag("commit_id").over(before))


@query(f"{_CF}, {_BLAME} SELECT repo, file, fix, intro FROM bl WHERE is_fix = 1 AND intro IS NOT NULL")
def blame_lines(spark, d):
    return _blame(spark, d).where("is_fix = 1 AND intro IS NOT NULL").select("repo", "file", F.col("commit_id").alias("fix"), "intro")


@query(f"{_CF}, {_BLAME} SELECT repo, file, max(CASE WHEN added > 25 THEN 1.0::DOUBLE ELSE 0.7 END) AS confidence, count(*) AS bug_count FROM bl WHERE is_fix = 1 AND n <= 2 AND intro IS NOT NULL GROUP BY repo, file")
def szz_blame(spark, d):
    """Labels of fixes that pass the filters and whose lines have an earlier author."""
    cf = _blame(spark, d).withColumn("confidence", F.when(F.col("is_fix") == 1, F.when(F.col("added") > 25, 1.0).otherwise(0.7)).otherwise(0.0))
    sized = cf.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("repo", "commit_id"))).where("n <= 2 AND intro IS NOT NULL")
    return L.szz_inline(sized, 2)


@query("SELECT conv_id AS number, turn, contains(lower(coalesce(text, '')), 'tion') AS is_bug FROM conversations WHERE role = 'user'")
def fetch_issue(spark, d):
    issues = table(spark, d, "conversations").where("role = 'user'")
    return issues.select(F.col("conv_id").alias("number"), "turn", X.is_bug_issue(F.lit(None).cast("array<string>"), F.col("text"), F.lit(None).cast("string"), ("tion",)).alias("is_bug"))


@query("SELECT o_orderkey AS pr, o_orderstatus AS state, count(*) AS files, sum(l_quantity::BIGINT)::BIGINT AS additions FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def fetch_pr(spark, d):
    """Header and totals of each pull request."""
    files = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("additions"))
    return table(spark, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("pr"), F.col("o_orderstatus").alias("state"), "files", "additions")


@query("SELECT o_orderkey AS pr FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def list_prs(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("pr"))


@query("SELECT doc_id, ((doc_id + n_chars) % 9)::INTEGER AS depth FROM documents")
def nesting_depth(spark, d):
    """Depth of nesting of Python sources that hold the texts as comments after branches, as deeply nested as id and length say."""
    from defectloom.sources.source_tree import nesting_depth as depth

    @F.pandas_udf("int")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: depth(x or ""))

    source = source_text(F.lit(1), (F.col("doc_id") + F.col("n_chars")) % 9, F.col("text"))
    return table(spark, d, "documents").select("doc_id", f(source).alias("depth"))


_TREE = """tr AS (SELECT page_id, html, CASE page_id % 6 WHEN 0 THEN 'src/p' || page_id || '.py' WHEN 1 THEN 'tests/p' || page_id || '.py' WHEN 2 THEN 'web/p' || page_id || '.js' WHEN 3 THEN 'docs/p' || page_id || '.md' WHEN 4 THEN 'web/test_p' || page_id || '.ts' ELSE 'core/p' || page_id || '.css' END AS path FROM pages)"""
_SCANNED = "page_id % 6 IN (0, 2, 5)"


def _tree(spark, d, content=None):
    """Pages as files of a source tree, written by the executors; the folder. The content of a file is the page, or what ``content`` makes of its path."""
    i, folder = F.col("page_id"), work_folder(spark)
    n = i.cast("string")
    path = F.when(i % 6 == 0, F.concat(F.lit("src/p"), n, F.lit(".py"))).when(i % 6 == 1, F.concat(F.lit("tests/p"), n, F.lit(".py"))).when(i % 6 == 2, F.concat(F.lit("web/p"), n, F.lit(".js")))
    path = path.when(i % 6 == 3, F.concat(F.lit("docs/p"), n, F.lit(".md"))).when(i % 6 == 4, F.concat(F.lit("web/test_p"), n, F.lit(".ts"))).otherwise(F.concat(F.lit("core/p"), n, F.lit(".css")))
    T.write_tree(table(spark, d, "pages").withColumn("path", path).select("path", (F.col("html") if content is None else content(F.col("path"))).alias("content")).repartition(8), folder)
    return folder


@query(f"WITH {_TREE} SELECT path AS rel_path, strlen(coalesce(html, ''))::BIGINT AS length FROM tr WHERE {_SCANNED}")
def scan_source_tree(spark, d):
    """The files of a tree that pass the extension, directory and name filters."""
    return T.scan_source_tree(spark, _tree(spark, d)).select("rel_path", "length")


def _source(path):
    """Functions and branches by the page's number, and the page as comments; style sheets are the page."""
    functions, depth = F.col("page_id") % 5, F.col("page_id") % 7
    return F.when(path.endswith(".py"), source_text(functions, depth, F.col("html"))).when(path.endswith(".js"), source_text(functions, depth, F.col("html"), "js")).otherwise(F.col("html"))


@query(f"""WITH {_TREE}, l AS (SELECT page_id, path, page_id % 5 AS n, page_id % 7 AS d, unnest(string_split(replace(coalesce(html, ''), chr(13), ''), chr(10))) AS line FROM tr WHERE {_SCANNED}),
c AS (SELECT path, any_value(n) AS n, any_value(d) AS d, count(*) FILTER (WHERE trim(line, ' ' || chr(9)) <> '' AND NOT starts_with(ltrim(line, ' ' || chr(9)), '//')) AS lines FROM l GROUP BY path)
SELECT path, regexp_extract(path, '[a-z]+$') AS language, CASE regexp_extract(path, '[a-z]+$') WHEN 'py' THEN n * (d + 2) WHEN 'js' THEN n * (2 * d + 3) ELSE lines END AS loc, CASE WHEN ends_with(path, '.css') THEN 0 ELSE n END AS functions,
  CASE WHEN ends_with(path, '.css') OR n = 0 THEN 0 ELSE d + 1 END AS max_complexity, (CASE WHEN ends_with(path, '.py') AND n > 0 THEN d ELSE 0 END)::INTEGER AS max_nesting_depth FROM c""")
def scan_static_metrics(spark, d):
    """Lines, functions, complexity and nesting of the files of a tree."""
    return T.scan_static_metrics(spark, _tree(spark, d, _source)).select("path", "language", "loc", "functions", "max_complexity", "max_nesting_depth")


@query("""SELECT page_id, CASE WHEN NOT starts_with(lower(coalesce(url, '')), 'https://') THEN 'scheme' WHEN NOT regexp_extract(url, '^https://([^/:?#]*)', 1) IN ('example.com', 'shop.example.net', 'example.org') THEN 'host'
 WHEN list_contains(string_split(regexp_extract(url, '^https://[^/?#]*/([^?#]*)', 1), '/'), '..') THEN 'traversal' WHEN NOT regexp_matches(regexp_extract(url, '^https://[^/?#]*/([^?#]*)', 1), '^[A-Za-z0-9_][A-Za-z0-9_.-]*/[A-Za-z0-9_][A-Za-z0-9_.-]*/?$') THEN 'name' ELSE 'ok' END AS verdict FROM pages""")
def clone_or_local(spark, d):
    """Whether each address may be cloned, and if not, why."""
    return table(spark, d, "pages").select("page_id", CL.remote_verdict(F.col("url"), ("example.com", "shop.example.net", "example.org")).alias("verdict"))


@query("SELECT count(*) AS total_files, count(*) FILTER (WHERE toxic = 1) AS buggy_files, count(*) FILTER (WHERE toxic = 1) AS issue, count(*) FILTER (WHERE toxic <> 1) AS szz FROM labels WHERE quality = 0 OR toxic = 1")
def save_labels_json(spark, d):
    """The summary that stands before a JSON file of labels, read back."""
    folder, t = work_folder(spark), table(spark, d, "labels").where("quality = 0 OR toxic = 1")
    source = F.when(F.col("toxic") == 1, "issue").otherwise("szz")
    C.write_labels_json(t.select(F.col("doc_id").alias("path"), (F.col("toxic") == 1).alias("is_buggy"), F.lit(0.7).alias("confidence"), source.alias("source")), "web", folder)
    x = spark.read.schema("total_files long, buggy_files long, source_breakdown map<string,long>").json(f"{folder}/summary")
    by = {k: F.coalesce(F.try_element_at("source_breakdown", F.lit(k)), F.lit(0)).alias(k) for k in ("issue", "szz")}
    return x.select("total_files", "buggy_files", *by.values())


@query("SELECT doc_id AS path, toxic = 1 AS is_buggy, CASE WHEN toxic = 1 THEN 'issue' ELSE 'szz' END AS source FROM labels WHERE quality = 0 OR toxic = 1")
def save_label_json_rows(spark, d):
    """The labels of a JSON file of labels, read back."""
    folder, t = work_folder(spark), table(spark, d, "labels").where("quality = 0 OR toxic = 1")
    C.write_labels_json(t.select(F.col("doc_id").alias("path"), (F.col("toxic") == 1).alias("is_buggy"), F.lit(0.7).alias("confidence"), F.when(F.col("toxic") == 1, "issue").otherwise("szz").alias("source")), "web", folder)
    return spark.read.schema("path long, is_buggy boolean, source string").json(f"{folder}/labels")


_FOLDS = f"{_LB}, f AS (SELECT repo, count(*) AS n, sum(buggy) AS b, count(*) FILTER (WHERE risk >= 0.7 AND buggy = 1)::DOUBLE AS tp, count(*) FILTER (WHERE risk >= 0.7 AND buggy = 0)::DOUBLE AS fp, count(*) FILTER (WHERE risk < 0.7 AND buggy = 1)::DOUBLE AS fn FROM lb GROUP BY repo), g AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM f)"


@query(f"{_FOLDS} SELECT count(*) AS full_repos, round(avg(f1), 6) AS full_macro_f1, count(*) FILTER (WHERE n >= 20) AS reliable_repos, round(avg(f1) FILTER (WHERE n >= 20), 6) AS reliable_f1 FROM g")
def write_benchmarks(spark, d):
    """Summaries of all folds and of those with enough files, as one JSON document that is read back."""
    folder, x = work_folder(spark), labelled(spark, d)
    n = x.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    folds = M.classification_metrics(x, F.col("risk") >= 0.7, ["repo"]).join(n, "repo")
    C.write_benchmarks(folds.agg(F.count(F.lit(1)).alias("repos"), F.avg("f1").alias("macro_f1")), folds.where("n >= 20").agg(F.count(F.lit(1)).alias("repos"), F.avg("f1").alias("honest_f1")), folder)
    y = spark.read.schema("full struct<repos:long,macro_f1:double>, reliable struct<repos:long,honest_f1:double>").json(folder)
    return y.select(F.col("full.repos").alias("full_repos"), r6(F.col("full.macro_f1")).alias("full_macro_f1"), F.col("reliable.repos").alias("reliable_repos"), r6(F.col("reliable.honest_f1")).alias("reliable_f1"))


@query("SELECT DISTINCT name FROM (SELECT unnest(['miner/version=' || source, 'szz/version=' || lang]) AS name FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)")
def clear_caches(spark, d):
    """What clearing the caches deletes: a version for each source in one folder and for each language in the other; a folder that is not there is passed over."""
    folder, t = work_folder(spark), table(spark, d, "documents").select("source", "lang", "n_chars").where("source IS NOT NULL AND lang IS NOT NULL")
    for name, c in (("miner", "source"), ("szz", "lang")):
        t.select(F.col(c).alias("version"), "n_chars").write.partitionBy("version").parquet(f"{folder}/{name}")
    gone = C.clear_caches(spark, [f"{folder}/{x}" for x in ("miner", "szz", "none")])
    return spark.createDataFrame([(x,) for x in gone if "version=" in x], "name string")


_LB_STATS = f"{_LB}, st2 AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean FROM lb" for c in _COLS) + ")"


@query(f"{_LB_STATS} SELECT 'v2' AS version, 'loc,functions,avg_complexity,max_complexity' AS features, 2::BIGINT AS versions, feature, round(mean, 6) AS mean FROM st2")
def save_model(spark, d):
    """What is stored of a model: manifest and statistics of each feature, of the latest of two versions."""
    x, folder = labelled(spark, d), work_folder(spark)
    model = ML.fit(x, _COLS)
    for v in ("v1", "v2"):
        C.save_model(spark, model, folder, M.training_stats(x, _COLS), _COLS, v)
    _, stats, manifest = C.load_model(spark, folder)
    versions = spark.read.json(f"{folder}/log").select(F.count_distinct("version").alias("versions"))
    return stats.crossJoin(F.broadcast(versions)).select(F.lit(manifest["version"]).alias("version"), F.lit(",".join(manifest["features"])).alias("features"), "versions", "feature", r6(F.col("mean")).alias("mean"))


@query(f"{_LB} SELECT file, CASE WHEN loc <= 200 THEN 'Low' WHEN loc <= 1000 THEN 'Medium' ELSE 'High' END AS review_effort, CASE WHEN risk >= 0.7 THEN 'HIGH' WHEN risk >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM lb")
def review_effort(spark, d):
    return labelled(spark, d).select("file", K.review_effort(F.col("loc")).alias("review_effort"), K.severity_token(F.col("risk")).alias("severity"))


@query("""WITH a AS (SELECT o_orderkey, floor((epoch_us((SELECT max(o_orderdate) FROM orders)) - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS age FROM orders)
SELECT o_orderkey, CASE WHEN age < 180 THEN 0 WHEN age < 365 THEN 1 WHEN age < 730 THEN 2 ELSE 3 END AS bucket FROM a""")
def age_bucket(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    newest = o.agg(F.max("t").alias("m"))
    return o.crossJoin(F.broadcast(newest)).select("o_orderkey", FT.age_bucket(days(F.col("t"), F.col("m"))).alias("bucket"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 1.0::DOUBLE WHEN count(DISTINCT l_suppkey) <= 3 THEN 0.7 ELSE 0.3 END AS experience FROM lineitem GROUP BY l_orderkey")
def experience(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n")).select("l_orderkey", FT.experience_score(F.col("n")).alias("experience"))


@query(f"{_LB} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, buggy)), 6) AS r FROM lb" for c in _COLS))
def target_corr(spark, d):
    return FT.correlations(labelled(spark, d), _COLS, "buggy").where("b = 'buggy'").select(F.col("a").alias("feature"), r6(F.col("r")).alias("r"))


@query(f"{_SC} SELECT loc, functions, avg_complexity, max_complexity, risk, buggy, coalesce(quality, -1) AS quality FROM sc")
def drop_by_name_pattern(spark, d):
    """Without the columns whose names give a place away."""
    x = scored(spark, d).fillna({"quality": -1})
    return x.drop(*[c for c in x.columns if any(w in c for w in ("file", "path", "hash", "repo", "language"))])


@query("SELECT event_type AS language, event_id FROM events WHERE event_type IN ('click', 'view') OR event_type IS NULL")
def filter_language(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("click", "view") | F.col("event_type").isNull()).select(F.col("event_type").alias("language"), "event_id")
