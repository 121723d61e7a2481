"""Token counts from an exact length histogram.

The corpus is reduced to one row per encoded length. Suffix sums over that
histogram then answer, for every context limit, how many documents reach it,
how many tokens there are in all, how many remain when each document is cut
there, and which share of documents is shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.llm import bpe
from defectloom.llm.common import written


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text", cache_entries: int = 1_000_000) -> DataFrame:
    """Rows (length, n_docs): documents of each encoded length, added up per batch so that little is shuffled.

    A null text counts as empty, with length 0.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(tokenizer, cache_entries)
        for batch in batches:
            lengths: list[int] = []
            for at in range(0, batch.num_rows, 512):
                part = batch.column(0).slice(at, 512).to_pylist()
                lengths += [len(b) // 4 for b in encode.encode_many([t or "" for t in part])]
            counts = pa.array(lengths, pa.int64()).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["length", "n_docs"])

    part = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "length long, n_docs long")
    return part.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def length_report(histogram: DataFrame, bucket: int = 512) -> DataFrame:
    """Suffix sums over a histogram (length, n_docs), for the limit of each row's length.

    Returns per length: n_docs, n_tokens (theirs), docs_ge and tokens_ge (of
    documents at least that long), total_docs, total_tokens, truncated_tokens
    (left when every document is cut at this length) and shorter_share (the
    part of documents shorter than it). An empty histogram gives no rows.

    The sums run inside buckets of ``bucket`` lengths in parallel; only the
    bucket totals, one row per ``bucket`` lengths, are summed in one task.
    """
    h = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / bucket).alias("bucket"))
    sums = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("k"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    later = sums.select(
        "bucket",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("k").over(above), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("k").over(everything).alias("total_tokens"),
    )
    within = Window.partitionBy("bucket").orderBy(F.col("length").desc())
    out = h.join(later, "bucket").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.sum("n_docs").over(within) + F.col("later_docs")).alias("docs_ge"),
        (F.sum("n_tokens").over(within) + F.col("later_tokens")).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    shorter = F.col("total_docs") - F.col("docs_ge")
    return out.withColumns(
        {
            "truncated_tokens": F.col("total_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge"),
            "shorter_share": shorter / F.col("total_docs"),
        }
    )


def truncated_total(report: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut at ``limit``, for any limit, null on no documents.

    The shortest length at or above the limit has the suffix sums that hold for it.
    """
    at = report.where(F.col("length") >= limit).agg(F.min_by(F.struct("tokens_ge", "docs_ge"), "length").alias("s"))
    total = report.agg(F.max("total_tokens").alias("total"))
    return at.crossJoin(total).select(
        F.lit(limit).cast("long").alias("limit"),
        (F.col("total") - F.coalesce(F.col("s.tokens_ge"), F.lit(0)) + limit * F.coalesce(F.col("s.docs_ge"), F.lit(0))).alias("truncated_tokens"),
    )


def length_quantile(report: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of documents does not exceed, null on no documents."""
    reached = F.col("total_docs") - F.col("docs_ge") + F.col("n_docs") >= F.ceil(F.lit(float(q)) * F.col("total_docs"))
    return report.where(reached).agg(F.min("length").alias("length")).select(F.lit(float(q)).alias("q"), "length")


def token_counts(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """The report of :func:`length_report` over the whole texts of ``docs``; each is encoded once, as the histogram is stored."""
    return length_report(written(encoded_lengths(docs, tokenizer or bpe.default_tokenizer(), text), "histogram"))
