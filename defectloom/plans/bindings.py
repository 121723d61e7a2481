"""Views of the graded tables in the shape of change history, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectloom.session import dealt, parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    """One row for each commit and file: orders are commits, parts files, brands repositories."""
    items = table(spark, d, "lineitem")
    n = parts(items)
    lines = (
        dealt(items, n, "l_orderkey")
        .groupBy("l_orderkey", "l_partkey")
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("added"), F.sum(F.col("l_linenumber").cast("long")).alias("deleted"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("is_fix"))
    )
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("timestamp").alias("commit_time"))
    files = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("repo"))
    changed = lines.join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = dealt(changed, n, "l_partkey").join(dealt(files, n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("repo", F.col("l_orderkey").alias("commit_id"), "author", "commit_time", F.col("l_partkey").alias("file"), "added", "deleted", "is_fix")


COMMIT_FILES = """cf AS (
  SELECT p_brand AS repo, l_orderkey AS commit_id, o_custkey AS author, o_orderdate::TIMESTAMP AS commit_time, l_partkey AS file, added, deleted, is_fix
  FROM (SELECT l_orderkey, l_partkey, sum(l_quantity::BIGINT)::BIGINT AS added, sum(l_linenumber)::BIGINT AS deleted, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS is_fix
        FROM lineitem GROUP BY l_orderkey, l_partkey)
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""


def event_commits(spark: SparkSession, d: str) -> DataFrame:
    """Events as commits: users are files, event types authors; gaps are below a day."""
    e = table(spark, d, "events")
    return e.select(F.lit("events").alias("repo"), F.col("event_id").alias("commit_id"), F.col("event_type").alias("author"), F.col("ts").cast("timestamp").alias("commit_time"), F.col("user_id").alias("file"), F.floor("value").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"), (F.col("event_type") == "error").cast("int").alias("is_fix"))


EVENT_COMMITS = """cf AS (
  SELECT 'events' AS repo, event_id AS commit_id, event_type AS author, ts::TIMESTAMP AS commit_time, user_id AS file, floor(value)::BIGINT AS added, 0::BIGINT AS deleted,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_fix
  FROM events
)"""


def static_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: lines, a complexity and sentence counts as functions."""
    t = F.coalesce(F.col("text"), F.lit(""))
    loc = (F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    functions = (F.char_length(t) - F.char_length(F.replace(t, F.lit("."), F.lit("")))).cast("long")
    rows = table(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("file"), F.col("lang").alias("language"), loc.alias("loc"), functions.alias("functions"), "n_chars")
    return rows.withColumns({"avg_complexity": F.col("n_chars") / F.col("loc"), "max_complexity": F.floor(F.col("n_chars") / F.col("loc")) + F.col("functions")})


STATIC = """st AS (
  SELECT *, n_chars / loc::DOUBLE AS avg_complexity, floor(n_chars / loc::DOUBLE)::BIGINT + functions AS max_complexity
  FROM (SELECT source AS repo, doc_id AS file, lang AS language,
               (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS loc,
               (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '.', '')))::BIGINT AS functions, n_chars
        FROM documents)
)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a risk that follows their length, and the toxic label as the defect flag."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("file"), F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality"))
    risk = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return static_metrics(spark, d).withColumn("risk", risk).join(labels, "file", "left").withColumn("buggy", F.coalesce("toxic", F.lit(0))).select("repo", "file", "language", "loc", "functions", "avg_complexity", "max_complexity", "risk", "buggy", "quality")


SCORED = f"""{STATIC}, sc AS (
  SELECT repo, file, language, loc, functions, avg_complexity, max_complexity, n_chars / (n_chars + 1000.0::DOUBLE) AS risk, coalesce(toxic, 0)::INTEGER AS buggy, quality::INTEGER AS quality
  FROM st LEFT JOIN labels ON st.file = labels.doc_id
)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The scored documents that have a label."""
    return scored(spark, d).where(F.col("quality").isNotNull())


LABELLED = f"""{SCORED}, lb AS (SELECT * FROM sc WHERE quality IS NOT NULL)"""


def url_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: what follows the scheme, without query and fragment."""
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, d, "pages").select(F.col("page_id").alias("file_id"), path.alias("path"))


PATHS = """pt AS (
  SELECT page_id AS file_id, regexp_replace(regexp_replace(coalesce(url, ''), '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages
)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("commit_id"), F.col("text").alias("msg"))


def part_files(spark: SparkSession, d: str) -> DataFrame:
    """Change sets: the lines of an order with metrics of their parts."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file")).distinct()
    counts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count(F.lit(1)).alias("commits"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").cast("long").alias("loc"), (F.col("p_retailprice") / 1000).alias("avg_complexity"), (F.pmod(F.col("p_partkey"), F.lit(7))).alias("coupled_file_count"), (F.pmod(F.col("p_partkey") * 37, F.lit(101)) / 101.0).alias("risk"))
    return lines.join(parts.join(counts, "file"), "file").select("commit_id", "file", "loc", "commits", "avg_complexity", "coupled_file_count", "risk")


PART_FILES = """cs AS (
  SELECT l.commit_id, l.file, p_size::BIGINT AS loc, commits, p_retailprice / 1000 AS avg_complexity, (p_partkey % 7)::BIGINT AS coupled_file_count, ((p_partkey * 37) % 101) / 101.0::DOUBLE AS risk
  FROM (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM lineitem) l
  JOIN part ON p_partkey = l.file
  JOIN (SELECT l_partkey AS file, count(*) AS commits FROM lineitem GROUP BY 1) c ON c.file = l.file
)"""


def source_text(functions: Column, depth: Column, text: Column, language: str = "py") -> Column:
    """Source with so many functions of two parameters, each with ``depth`` nested branches, and then the text as comment lines."""
    py = language == "py"
    steps = F.when(depth > 0, F.sequence(F.lit(1), depth.cast("int"))).otherwise(F.array().cast("array<int>"))
    inner = F.array_join(F.transform(steps, lambda j: F.concat(F.repeat(F.lit("    "), j), F.lit("if a:\n" if py else "if (a) {\n"))), "")
    ends = F.lit("") if py else F.concat(F.repeat(F.lit("}\n"), depth.cast("int")), F.lit("}\n"))
    body = F.concat(inner, F.repeat(F.lit("    "), depth.cast("int") + 1), F.lit("return b\n"), ends)
    each = F.when(functions > 0, F.sequence(F.lit(1), functions.cast("int"))).otherwise(F.array().cast("array<int>"))
    code = F.array_join(F.transform(each, lambda k: F.concat(F.lit("def f" if py else "function f"), k, F.lit("(a, b):\n" if py else "(a, b) {\n"), body)), "")
    mark = "# " if py else "// "
    said = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]", " ")
    return F.concat(code, F.lit(mark), F.replace(said, F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
