"""A corpus from raw documents to packed windows: language, lines, near duplicates, mix, packing.

Every stage takes tables with nulls in any column, empty and very long texts,
repeated rows, no rows, and further columns of any name, which it passes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectloom.llm import language_id, line_dedup, minhash_dedup, mixing, packing
from defectloom.llm.common import new_folder, table

#: Bits a byte from which a text is in none of the languages: its bytes as they are cost no more.
FOREIGN_BITS = 8.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are in a language of the labelled ones, with that language as ``lang``.

    Null texts and those without a letter go, and texts whose entropy against
    the nearest language is ``FOREIGN_BITS`` a byte or more: other scripts and
    noise. Repeated rows are judged alike and all stay or go. Where no row has
    a label, nothing is known and all go.
    """
    held = language_id.is_held_out(F.col("doc_id"))
    models = language_id.train(docs.where(~held), "text", "lang", F.col("doc_id"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    said = language_id.predict(docs, models, [rest], keep_text=True)
    known = said.where((F.col("lang_pred") != "und") & (F.col("bits") < FOREIGN_BITS))
    found = {"text": F.col("_text"), "lang": F.col("lang_pred")}
    return known.select(*[found.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that an earlier document has out of the texts; every row stays, a null text null, and ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs)
    lost = F.col("n_dropped") > 0
    new = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(lost, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    kept = cut.withColumns({f"_new_{c}": x for c, x in new.items()})
    return kept.select(*[F.col(f"_new_{c}" if c in new else f"`{c}`").alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8.

    A row without id is judged by its text; texts without words are near nothing.
    """
    return minhash_dedup.drop_near_duplicates(docs, words=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight says; texts without words are taken as often as their source's rate says for sure."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training windows, null texts as empty; the cache of text pieces is small, as executors have run other stages before."""
    return packing.pack(docs, cache_entries=200_000)


STAGES = [("language", known_language), ("line_dedup", unique_lines), ("near_dedup", one_of_each), ("mixing", mixed_sources), ("packing", packed)]

#: Languages, random rounding and packing are not expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
