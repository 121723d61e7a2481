"""Synthetic rows of the smaller class between neighbours, and removal of rows whose nearest neighbour is of the other class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectloom.ml.neighbours import hash_key, hash_ranks, nearest_neighbours
from defectloom.session import stored


def _share(h: Column) -> Column:
    """A number from 0 to below 1 by eight hexadecimal digits."""
    return F.conv(h, 16, 10).cast("double") / float(1 << 32)


def smote(df: DataFrame, columns: Sequence[str], k: int = 5, key: str = "file", label: str = "buggy", weight: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` and as many synthetic rows of the smaller class as it lacks, with the columns synthetic, base and copy added.

    Every row of the smaller class is the base of equally many synthetic rows,
    or of one more for the first by hash. A synthetic row lies between its base
    and one of the base's ``k`` nearest rows of the class (at most all others),
    both chosen by a hash of seed, base and copy, so reruns agree. Its features
    are doubles, its label is the class's, its weight the mean of all weights,
    its base the key of the row it was made of; its other columns are null.
    Where a class has fewer than two rows, or both are equally large, nothing is
    added. Keys must be unique and not null; features that are null count as 0.
    """
    kept = stored(df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}))
    stats = kept.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"), *([F.avg(weight).alias("w")] if weight else [])).first()
    types = dict(kept.dtypes)
    as_they_are = kept.withColumns({"synthetic": F.lit(False), "base": F.lit(None).cast(types[key]), "copy": F.lit(None).cast("long")})
    few, many = sorted((stats["p"], stats["n"]))
    if few < 2 or few == many:
        return as_they_are
    value = 1 if stats["p"] == few else 0
    small = stored(kept.where((F.col(label) == 1) == F.lit(value == 1)).select(F.col(key).alias("base"), F.col(label).alias("_label"), *columns))
    near = nearest_neighbours(small, columns, min(k, few - 1), "base", seed=seed).select("base", F.transform("neighbours", lambda x: x["id"]).alias("_ids"))
    each, more = divmod(many - few, few)
    ranked = hash_ranks(small, "base", seed=seed, name="_rank").withColumn("_copies", each + (F.col("_rank") <= more).cast("int"))
    copies = ranked.where("_copies > 0").join(near, "base").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long"))))
    h = hash_key(F.concat_ws(":", F.col("base").cast("string"), F.col("copy")), seed)
    pick = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.size("_ids").cast("long")).cast("int")
    chosen = copies.withColumns({"_id": F.get("_ids", pick), "_gap": _share(F.substring(h, 9, 8))})
    ends = small.select(F.col("base").cast("string").alias("_id"), *[F.col(c).alias(f"_to_{i}") for i, c in enumerate(columns)])
    between = {c: F.col(c) + F.col("_gap") * (F.col(f"_to_{i}") - F.col(c)) for i, c in enumerate(columns)}
    made = chosen.join(ends, "_id").withColumns(between)
    given = {label: F.col("_label"), "synthetic": F.lit(True), "base": F.col("base"), "copy": F.col("copy"), **({weight: F.lit(stats["w"])} if weight else {})}
    return as_they_are.unionByName(made.select(*[(F.col(c) if c in columns else given.get(c, F.lit(None).cast(t))).alias(c) for c, t in as_they_are.dtypes]))


def row_id(key: str = "file") -> Column:
    """What names a row of :func:`smote`: ``0:`` and its key, or ``1:``, its base and its copy."""
    return F.when(F.col("synthetic"), F.concat_ws(":", F.lit("1"), F.col("base").cast("string"), F.col("copy"))).otherwise(F.concat(F.lit("0:"), F.col(key).cast("string")))


def tomek_links(df: DataFrame, columns: Sequence[str], key: str, label: str = "buggy", seed: int = 42) -> DataFrame:
    """Rows (key, other): pairs of rows of different classes that are each other's nearest row of all, both ways.

    Of rows at one distance the one with the smaller key, as a string, is the nearest.
    """
    near = nearest_neighbours(df, columns, 1, key, seed=seed).where(F.size("neighbours") > 0).select(F.col(key).cast("string").alias("_a"), F.get("neighbours", F.lit(0))["id"].alias("_b"))
    near = stored(near)
    mutual = near.join(near.select(F.col("_a").alias("_b"), F.col("_b").alias("_a")), ["_a", "_b"])
    labels = df.select(F.col(key).cast("string").alias("_k"), F.col(label).alias("_l"))
    one = mutual.join(labels.withColumnsRenamed({"_k": "_a", "_l": "_la"}), "_a")
    both = one.join(labels.withColumnsRenamed({"_k": "_b", "_l": "_lb"}), "_b")
    return both.where(F.col("_la") != F.col("_lb")).select(F.col("_a").alias(key), F.col("_b").alias("other"))


def smote_tomek(df: DataFrame, columns: Sequence[str], k: int = 5, key: str = "file", label: str = "buggy", weight: str | None = None, seed: int = 42) -> DataFrame:
    """The rows of :func:`smote` without those in Tomek links, original rows as well as synthetic ones."""
    told = stored(smote(df, columns, k, key, label, weight, seed).withColumn("_row", row_id(key)))
    linked = tomek_links(told, columns, "_row", label, seed).select("_row")
    return told.join(linked, "_row", "left_anti").drop("_row")
