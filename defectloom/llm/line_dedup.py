"""Line dedup: every line that several documents share stays in the first of them only.

Lines become 128-bit hashes. One exchange deals them by hash range, sorted by
hash, document and position, and a streaming pass over that order marks all
but the first occurrences. A document gets back a compressed bitmap of kept
lines (runs), never text. Only DataFrame functions are used.

Lines that are very common would fill a range on their own. Their number is
bounded: at most ``1 / hot_share`` keys can each hold more than that share of
all lines. They are found by a first counting pass that adds up before it
shuffles, and are settled by a broadcast of that bounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.llm.common import ascii_lower, numbered, written

_SPACE = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1
_RUNS = "array<struct<start:int,len:int>>"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A to Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(_SPACE)))


def _named(docs: DataFrame, id_col: str, text: str) -> dict[str, Column]:
    """What names a row: its id, nulls as the last of all ids, and a hash of its text."""
    return {"_d": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "_t": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10) -> DataFrame:
    """Rows (h1, h2, _d, _t, pos) of the lines whose keys have at least ``min_chars`` code points."""
    lines = docs.select(*[c.alias(k) for k, c in _named(docs, id_col, text).items()], F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("_d", "_t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "_d", "_t", "pos")


def hot_lines(lines: DataFrame, hot_share: float, buckets: int = 65_536) -> DataFrame:
    """Rows (h1, h2, first): keys with more than ``hot_share`` of all lines, at most ``1 / hot_share`` of them.

    Lines are counted by hash bucket first (``buckets`` rows at most); a hot key
    lies in a bucket at least as full, so keys are counted only there.
    """
    bucket = F.pmod(F.col("h1"), F.lit(buckets))
    counts = lines.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.select("b", "n", F.sum("n").over(Window.partitionBy()).alias("all")).where(F.col("n") > hot_share * F.col("all"))
    inside = lines.join(F.broadcast(full), bucket == F.col("b"), "inner")
    return inside.groupBy("h1", "h2").agg(F.min("_d").alias("first"), F.count(F.lit(1)).alias("n"), F.max("all").alias("all")).where(F.col("n") > hot_share * F.col("all")).select("h1", "h2", "first")


def drop_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, hot_share: float = 0.001) -> DataFrame:
    """Rows (_d, _t, _runs): for each document that loses lines, the dropped positions as sorted runs (start, len)."""
    lines = written(line_hashes(docs, id_col, text, min_chars), "lines")
    hot = written(hot_lines(lines, hot_share), "hot-lines")
    from_hot = lines.join(F.broadcast(hot), ["h1", "h2"]).where(F.col("_d") != F.col("first")).select("_d", "_t", "pos")
    cold = lines.join(F.broadcast(hot), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2")
    stream = Window.partitionBy("h1", "h2").orderBy("_d", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_cold = cold.withColumn("first", F.first("_d").over(stream)).where(F.col("_d") != F.col("first")).select("_d", "_t", "pos")
    dropped = from_hot.unionByName(from_cold)
    # positions less their rank are equal within a run; rows alike in id and text count once
    rank = F.dense_rank().over(Window.partitionBy("_d", "_t").orderBy("pos"))
    runs = dropped.withColumn("island", F.col("pos") - rank).groupBy("_d", "_t", "island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("len"))
    return runs.groupBy("_d", "_t").agg(F.sort_array(F.collect_list(F.struct("start", "len"))).cast(_RUNS).alias("_runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = 10, hot_share: float = 0.001, broadcast_docs: int = 20_000) -> DataFrame:
    """``docs`` with columns n_lines, n_dropped, drop_runs (the compressed bitmap) and kept_text added, in place of any of these names.

    A line's key has no ASCII white space at its ends and A to Z in lower case.
    Keys of at least ``min_chars`` code points that stand in two or more
    documents lose all lines except those in the document with the smallest id.
    A null or empty text is one empty line and keeps it; a document that loses
    every line keeps its row with an empty text. Null ids count as one document
    after all others; rows alike in id and text are treated alike. An empty
    table gives no rows.

    Bitmaps of at most ``broadcast_docs`` documents are broadcast, so that no
    text is shuffled; beyond that texts and bitmaps meet in a sort-merge join,
    which can spill and splits skewed keys.
    """
    docs = docs.drop("n_lines", "n_dropped", "drop_runs", "kept_text")
    names = docs.columns
    docs, (id_col, text) = numbered(docs, id_col, text)
    runs = written(drop_runs(docs, id_col, text, min_chars, hot_share), "runs")
    n_docs, n_runs = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_runs")), F.lit(0))).first()
    few = n_docs <= broadcast_docs and n_runs <= 32 * broadcast_docs
    joined = docs.withColumns(_named(docs, id_col, text)).join(F.broadcast(runs) if few else runs.hint("merge"), ["_d", "_t"], "left").drop("_d", "_t")
    out = joined.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).withColumn("drop_runs", F.coalesce("_runs", F.array().cast(_RUNS)))
    n = F.size("_lines")
    starts = F.concat(F.array(F.lit(0)), F.transform("drop_runs", lambda r: r["start"] + r["len"]))
    ends = F.concat(F.transform("drop_runs", lambda r: r["start"]), F.array(n))
    keep = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda r: r["n"] > 0)
    kept = F.array_join(F.transform(keep, lambda r: F.array_join(F.slice("_lines", r["a"] + 1, r["n"]), "\n")), "\n")
    lost = F.aggregate("drop_runs", F.lit(0), lambda s, r: s + r["len"])
    kept = F.when(F.size("drop_runs") == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(kept)
    out = out.select(*docs.columns, n.cast("long"), lost.cast("long"), "drop_runs", kept)
    return out.toDF(*names, "n_lines", "n_dropped", "drop_runs", "kept_text")
