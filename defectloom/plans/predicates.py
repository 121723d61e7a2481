"""Path, message and scalar functions over page addresses and document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectloom.functions import paths as P
from defectloom.functions import text as X
from defectloom.functions.core import r6
from defectloom.plans.bindings import PATHS, messages, table, url_paths
from defectloom.plans.registry import query

_PT = f"WITH {PATHS}"
_NAME = "array_extract(string_split(path, '/'), len(string_split(path, '/'))::BIGINT)"
_EXT = f"lower(regexp_extract({_NAME}, '[^.](\\.[^.]+)$', 1))"

# words that the invented prose and addresses have
_LANGS = {".html": "html", ".com": "site", ".net": "site", ".org": "site"}
_WORDS = {"high": ("tion", "heit"), "medium": ("ing", "que"), "ignore": ("ende", "blea")}


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"{_PT} SELECT file_id, CASE {_EXT} WHEN '.html' THEN 'html' WHEN '.com' THEN 'site' WHEN '.net' THEN 'site' WHEN '.org' THEN 'site' END AS language FROM pt")
def file_language(spark, d):
    return url_paths(spark, d).select("file_id", P.file_language(F.col("path"), _LANGS).alias("language"))


@query(f"{_PT} SELECT file_id FROM pt WHERE {_EXT} IN ('.html') AND {_EXT} NOT IN ('.md', '.txt')")
def ext_filter(spark, d):
    return url_paths(spark, d).where(P.ext_filter(F.col("path"), (".html",), (".md", ".txt"))).select("file_id")


_DIRS = {"excluded": ("fr",), "core": ("en",), "conditional": ("de",)}
_DIR_SQL = f"""CASE WHEN list_has_any(string_split(lower(path), '/'), {_list(_DIRS['excluded'])}) THEN 'excluded' WHEN list_has_any(string_split(lower(path), '/'), {_list(_DIRS['core'])}) THEN 'core'
  WHEN list_has_any(string_split(lower(path), '/'), {_list(_DIRS['conditional'])}) THEN 'conditional' ELSE 'other' END"""


def _dir(c):
    return P.dir_class(c, None, _DIRS["excluded"], _DIRS["core"], _DIRS["conditional"])


@query(f"{_PT} SELECT file_id, {_DIR_SQL} AS directory FROM pt")
def dir_class(spark, d):
    return url_paths(spark, d).select("file_id", _dir(F.col("path")).alias("directory"))


@query(f"{_PT} SELECT file_id, {_any('lower(path)', ('blog', 'shop', 'spam'))} AS important FROM pt")
def important_keyword(spark, d):
    return url_paths(spark, d).select("file_id", P.important_keyword(F.col("path"), ("blog", "shop", "spam")).alias("important"))


@query(f"{_PT} SELECT file_id, NOT list_has_any(string_split(lower(path), '/'), ['en']) AND list_has_any(string_split(lower(path), '/'), ['fr', 'de']) AS skipped FROM pt")
def skip_dir(spark, d):
    return url_paths(spark, d).select("file_id", P.skip_dir(F.col("path"), None, ("fr", "de"), ("en",)).alias("skipped"))


_EXCLUDE_SQL = f"""(starts_with({_NAME}, 'test_') OR ends_with({_NAME}, '_test.py') OR starts_with({_NAME}, 'spec_') OR ends_with({_NAME}, '_spec.py') OR starts_with({_NAME}, '_')
  OR {_any('lower(path)', ('node_modules', '__pycache__', '.venv', 'venv/', 'env/', 'coverage/', '__generated__'))} OR ends_with(path, '.min.js') OR ends_with(path, '.min.css') OR ends_with(path, '_pb2.py')
  OR ends_with(path, '.pb.go') OR ends_with(path, '.lock') OR ends_with(path, '.log'))"""


@query(f"{_PT} SELECT file_id, {_EXCLUDE_SQL} AS excluded FROM pt")
def exclude_pattern(spark, d):
    return url_paths(spark, d).select("file_id", P.exclude_pattern(F.col("path")).alias("excluded"))


_NORM = "trim(regexp_replace(lower(replace(coalesce(path, ''), '\\', '/')), '^(\\./|/)', ''), '/')"


@query(f"""{_PT} SELECT file_id, {_any(_NORM, ('/test/', '/tests/', '/spec/', '/testing/'))} OR regexp_matches({_NORM}, '^(test|tests|spec|testing)/') OR
  {_any(f"regexp_extract({_NORM}, '[^/]*$')", P.TEST_NAME_PARTS)} OR regexp_matches({_NORM}, '\\.(test|spec)\\.(js|ts)$') AS is_test FROM pt""")
def is_test_file(spark, d):
    return url_paths(spark, d).select("file_id", P.is_test_file(F.col("path")).alias("is_test"))


@query(f"{_PT} SELECT file_id, regexp_matches({_NORM}, '(^|/)(es|fr)/') AS is_generated FROM pt")
def is_generated_file(spark, d):
    return url_paths(spark, d).select("file_id", P.is_generated_file(F.col("path"), ("es", "fr")).alias("is_generated"))


_SIZED = f"""{_PT}, sz AS (SELECT file_id, path, length(path) % 60 AS loc, length(path) % 4 AS functions, count(*) OVER () AS total, {_DIR_SQL} AS directory, lower({_NAME}) AS name, lower(path) AS p FROM pt)"""
_ENTRY = "name IN ('index.js', 'main.py', 'app.py', 'package.json', 'setup.py')"
_TRIVIAL = f"""CASE WHEN {_ENTRY} OR {_any('p', P.FRAMEWORK_KEYWORDS)} THEN false WHEN (ends_with(path, '.json') OR ends_with(path, '.yaml') OR ends_with(path, '.yml')) AND functions = 0 THEN true
  WHEN loc <= 3 AND functions = 0 THEN true WHEN contains(p, 'example') THEN CASE WHEN loc >= 20 OR functions >= 2 THEN false WHEN contains(p, 'tutorial') AND loc >= 15 THEN false ELSE true END
  ELSE functions = 0 AND loc < 30 AND NOT {_any('p', P.IMPORTANT_KEYWORDS)} END"""
_MEANINGFUL = f"""(directory = 'core' OR ({_any('p', P.FRAMEWORK_KEYWORDS)} AND (functions >= 1 OR loc >= 10)) OR {_ENTRY} OR functions >= CASE WHEN total > 500 THEN 1 ELSE 2 END
  OR (loc >= CASE WHEN total > 500 THEN 10 ELSE 15 END AND functions >= 1) OR {_any('p', P.IMPORTANT_KEYWORDS)} OR (total <= 500 AND {_any('p', ('example', 'tutorial'))} AND (functions >= 1 OR loc >= 10))
  OR ({_any('p', P.APPLICATION_KEYWORDS)} AND (loc >= 5 OR functions >= 1)) OR loc >= 50)"""


def _sized(spark, d):
    x = url_paths(spark, d).withColumns({"loc": F.char_length("path") % 60, "functions": F.char_length("path") % 4})
    total = x.agg(F.count(F.lit(1)).alias("total"))
    return x.crossJoin(F.broadcast(total)).withColumn("directory", _dir(F.col("path")))


@query(f"{_SIZED} SELECT file_id, {_TRIVIAL} AS trivial FROM sz")
def trivial_file(spark, d):
    return _sized(spark, d).select("file_id", P.trivial_file(F.col("path"), F.col("loc"), F.col("functions")).alias("trivial"))


@query(f"{_SIZED} SELECT file_id, {_MEANINGFUL} AS meaningful FROM sz")
def meaningful_file(spark, d):
    return _sized(spark, d).select("file_id", P.meaningful_file(F.col("path"), F.col("loc"), F.col("functions"), F.col("total"), F.col("directory")).alias("meaningful"))


@query(f"""{_SIZED}, k AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT file_id, CASE WHEN k.doc_id IS NOT NULL THEN true WHEN NOT ({_EXT} IN ('.html', '.css', '.json', '.yaml', '.yml', '.py', '.js', '.jsx', '.ts', '.tsx', '.java')) THEN false
  WHEN list_has_any(string_split(lower(path), '/'), {_list(P.EXCLUDED_DIRS)}) THEN false WHEN list_has_any(string_split(lower(path), '/'), {_list(P.CORE_DIRS)}) THEN true
  WHEN {_TRIVIAL} THEN false ELSE {_MEANINGFUL.replace("directory = 'core' OR", "")} END AS included FROM sz LEFT JOIN k ON k.doc_id = sz.file_id""")
def include_file(spark, d):
    known = spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("file_id"), F.lit(True).alias("known"))
    x = _sized(spark, d).join(known, "file_id", "left")
    return x.select("file_id", P.include_file(F.col("path"), F.col("loc"), F.col("functions"), F.col("total"), F.col("known")).alias("included"))


@query(f"{_PT} SELECT file_id, {_NORM} AS norm_path FROM pt")
def norm_path(spark, d):
    return url_paths(spark, d).select("file_id", P.norm_path(F.col("path")).alias("norm_path"))


@query(f"""{_PT}, b AS (SELECT file_id, string_split(replace(replace(replace({_NORM}, 'src/', ''), 'lib/', ''), 'app/', ''), '/') AS parts FROM pt)
SELECT file_id, array_to_string(parts[greatest(len(parts) - 1, 1):], '/') AS clean_path FROM b""")
def clean_path(spark, d):
    return url_paths(spark, d).select("file_id", P.clean_path(F.col("path")).alias("clean_path"))


@query(f"""{_PT} SELECT file_id, {_NAME} AS basename, regexp_replace(path, '/?[^/]*$', '') AS dirname, {_EXT} AS extension,
  CASE WHEN regexp_matches({_NAME}, '[^.]\\.[^.]+$') THEN regexp_replace({_NAME}, '\\.[^.]+$', '') ELSE {_NAME} END AS stem FROM pt""")
def path_pieces(spark, d):
    c = F.col("path")
    return url_paths(spark, d).select("file_id", P.basename(c).alias("basename"), P.dirname(c).alias("dirname"), P.extension(c).alias("extension"), P.stem(c).alias("stem"))


@query(f"""{_PT}, n AS (SELECT a.file_id, b.file_id AS other, a.path AS x, b.path AS y FROM pt a JOIN pt b ON b.file_id = a.file_id + 1)
SELECT file_id, len(list_intersect(list_distinct(string_split(regexp_replace(x, '/?[^/]*$', ''), '/')), list_distinct(string_split(regexp_replace(y, '/?[^/]*$', ''), '/'))))::INTEGER AS similarity FROM n""")
def dir_similarity(spark, d):
    a = url_paths(spark, d)
    b = a.select((F.col("file_id") - 1).alias("file_id"), F.col("path").alias("other"))
    return a.join(b, "file_id").select("file_id", P.dir_similarity(F.col("path"), F.col("other")).alias("similarity"))


@query(f"""{_PT}, s AS (SELECT file_id, string_split(path, '/') AS parts FROM pt), q AS (SELECT file_id, parts, list_position(parts, 'en') AS pos FROM s)
SELECT file_id, CASE WHEN pos > 0 AND pos < len(parts) THEN parts[pos + 1] WHEN list_contains(parts, 'de') THEN 'de' ELSE 'unknown' END AS repo FROM q""")
def repo_from_path(spark, d):
    return url_paths(spark, d).select("file_id", P.repo_from_path(F.col("path"), ("de",), "en").alias("repo"))


@query("SELECT page_id AS file_id, nullif(regexp_extract(url, '^https?://[^/]+/([^/]+/[^/]+?)(\\.git)?/?$', 1), '') AS owner_repo FROM pages")
def remote_owner_repo(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("file_id"), P.owner_repo(F.col("url")).alias("owner_repo"))


_SUBJECT = "lower(string_split(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10))[1])"
_CONF = f"CASE WHEN {_any('s', _WORDS['ignore'])} THEN 0.0::DOUBLE WHEN {_any('s', _WORDS['high'])} THEN 1.0 WHEN {_any('s', _WORDS['medium'])} THEN 0.7 ELSE 0.0 END"
_MS = f"WITH ms AS (SELECT doc_id AS commit_id, {_SUBJECT} AS s, coalesce(text, '') AS text FROM documents)"


@query(f"{_MS} SELECT commit_id, s AS subject FROM ms")
def subject_line(spark, d):
    return messages(spark, d).select("commit_id", X.subject_line(F.col("msg")).alias("subject"))


@query(f"{_MS} SELECT commit_id, {_CONF} AS confidence FROM ms")
def commit_confidence(spark, d):
    return messages(spark, d).select("commit_id", X.commit_confidence(F.col("msg"), **_WORDS).alias("confidence"))


@query(f"{_MS} SELECT commit_id FROM ms WHERE {_CONF} > 0")
def is_bug_fix(spark, d):
    return messages(spark, d).where(X.is_bug_fix(F.col("msg"), **_WORDS)).select("commit_id")


@query(f"{_MS} SELECT commit_id, CASE WHEN contains(lower(text), 'schkeit') THEN 1.0::DOUBLE WHEN contains(lower(text), 'ciónue') THEN 0.75 WHEN contains(lower(text), 'eaux') THEN 0.4 ELSE 0.75 END AS weight FROM ms")
def alt_bug_fix(spark, d):
    return messages(spark, d).select("commit_id", X.weighted_bug_fix(F.col("msg"), ("schkeit",), ("ciónue",), ("eaux",)).alias("weight"))


@query("""SELECT doc_id AS commit_id, array_to_string(list_sort(list_distinct(list_concat([doc_id % 97, n_chars % 31], list_transform(regexp_extract_all(coalesce(text, ''), '#(\\d{1,9})', 1), lambda x: x::BIGINT)))), ',') AS refs FROM documents""")
def issue_refs(spark, d):
    """Documents as messages that name two issues, one of them twice, by numbers that follow from the document."""
    first = F.concat(F.lit("Fixes #"), F.col("doc_id") % 97)
    msg = F.concat(first, F.lit(", closes https://github.com/a/b/issues/"), F.col("n_chars") % 31, F.lit(" as well; "), first, F.lit(". "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("commit_id"), F.array_join(X.issue_refs(msg), ",").alias("refs"))


@query("SELECT conv_id, turn, role = 'user' OR contains(lower(coalesce(text, '')), 'tion') AS is_bug FROM conversations")
def is_bug_issue(spark, d):
    x = spark.read.parquet(f"{d}/conversations.parquet")
    return x.select("conv_id", "turn", X.is_bug_issue(F.array("role"), F.lit(""), F.col("text"), ("user", "tion")).alias("is_bug"))


_TYPES = {"alpha": ("the", "and"), "beta": ("der", "keit"), "gamma": ("que", "de la")}


def _type_sql() -> str:
    scores = {k: " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') THEN {len(w)} ELSE 0 END" for w in ws) for k, ws in _TYPES.items()}
    cols = ", ".join(f"{v} AS {k}" for k, v in scores.items())
    top = f"greatest({', '.join(_TYPES)})"
    pick = " ".join(f"WHEN {k} = {top} THEN '{k}'" for k in _TYPES)
    return f"WITH s AS (SELECT doc_id AS commit_id, {cols} FROM documents) SELECT commit_id, CASE WHEN {top} = 0 THEN NULL {pick} END AS bug_type FROM s"


@query(_type_sql())
def bug_type(spark, d):
    return messages(spark, d).select("commit_id", X.bug_type(F.col("msg"), _TYPES).alias("bug_type"))


@query("SELECT doc_id AS commit_id FROM documents WHERE length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) > 1")
def merge_filter(spark, d):
    """Texts of more than two lines stand for commits with several parents."""
    return messages(spark, d).where(F.size(F.split(F.coalesce(F.col("msg"), F.lit("")), "\n")) - 1 > 1).select("commit_id")


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH c AS (SELECT doc_id AS commit_id, doc_id % 12 AS n, lang, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE nullif(text, '') END AS b FROM documents),
l AS (SELECT *, string_split(b, chr(10)) AS ls FROM c),
m AS (SELECT *, coalesce(len(list_filter(ls[:n], lambda x: trim(x, {_WS}) <> '' AND NOT (lang = 'en' AND (starts_with(ltrim(x, {_WS}), 'The') OR starts_with(ltrim(x, {_WS}), 'An'))))), 0) AS code FROM l)
SELECT commit_id, CASE WHEN n = 0 THEN false WHEN b IS NULL THEN n >= 5 ELSE n >= 3 AND code >= CASE WHEN n <= 5 THEN 1 ELSE 2 END AND n / len(ls)::DOUBLE >= 0.5 END AS substantive FROM m""")
def substantive_change(spark, d):
    """Texts as files before a change of some lines; in one language, lines with certain words first are comments."""
    from defectloom.operators.labels import substantive

    i = F.col("doc_id")
    before = F.when(i % 17 != 0, F.col("text"))
    real = substantive(i % 12, before, F.lit(None).cast("string"), F.col("lang"), min_churn_ratio=0.5, marks={"en": ("The", "An")})
    return spark.read.parquet(f"{d}/documents.parquet").select(i.alias("commit_id"), real.alias("substantive"))


@query("SELECT page_id AS file_id, md5(url) AS cache_key, CASE WHEN length(url) > 45 THEN concat(substr(url, 1, 42), '...') ELSE url END AS short FROM pages")
def formatting(spark, d):
    x = spark.read.parquet(f"{d}/pages.parquet")
    return x.select(F.col("page_id").alias("file_id"), F.md5("url").alias("cache_key"), F.when(F.char_length("url") > 45, F.concat(F.substring("url", 1, 42), F.lit("..."))).otherwise(F.col("url")).alias("short"))


@query("SELECT doc_id AS commit_id, round(ln(1 + n_chars), 6) AS log1p, round(exp(-n_chars / 1000.0::DOUBLE), 6) AS decay, round(sqrt(n_chars), 6) AS root, ceil(n_chars / 7.0::DOUBLE)::BIGINT AS up, greatest(least(n_chars, 500), 100) AS clipped FROM documents")
def scalar_math(spark, d):
    n = F.col("n_chars")
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("commit_id"), r6(F.log1p(n)).alias("log1p"), r6(F.exp(-n / 1000)).alias("decay"), r6(F.sqrt(n)).alias("root"), F.ceil(n / 7).alias("up"), F.greatest(F.least(n, F.lit(500)), F.lit(100)).cast("long").alias("clipped"))
