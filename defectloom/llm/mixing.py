"""Mixing sources to target weights by pivotal dependent rounding.

Each document has an expected number of copies, ``target / source_size``. Its
whole part is certain; the fractional parts of a source are rounded together.
Two documents at a time, mass moves from one to the other, in a random
direction whose odds keep every expectation, until one of the two has an
integral number of copies. Moves are measured in words (one document's gain in
words is the other's loss), so the words a source gives change only by the
rounding of its very last document.

Documents are dealt into small blocks; a block is folded in one pass and leaves
at most one fractional document, which goes to the next level of the tree.
Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.llm.common import checkpointed, numbered, written


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts as 0."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(F.filter(parts, lambda w: w != "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds rank, weight and target to rows (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn. They
    share ``share`` times all words by weight; no target exceeds ``cap`` times
    its source's words, and what is above goes to the others by weight, until
    none is above. That end state gives each source ``min(cap * size, level *
    weight)`` with one common level, found here in one ordered pass: sources
    reach their cap in the order of ``cap * size / weight``.

    One row per source is sorted in one task; documents never are.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = sizes.select("source", "source_size", F.row_number().over(order).alias("rank"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    most = cap * F.col("source_size")
    by_level = Window.orderBy((F.col("most") / F.col("weight")).asc(), "rank")
    x = ranked.withColumn("most", most.cast("double"))
    x = x.withColumns(
        {
            "budget": share * F.sum("source_size").over(every).cast("double"),
            "capped_before": F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_left": F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_left")
    x = x.withColumn("free", (level * F.col("weight") <= F.col("most")).cast("int")).withColumn("level", level)
    first_free = F.min(F.when(F.col("free") == 1, F.struct("capped_before", "level"))).over(every)
    x = x.withColumn("level", first_free["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return x.select("source", "source_size", "rank", "weight", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


_ITEM = "struct<key:bigint,id:bigint,fingerprint:bigint,size:bigint,whole:bigint,p:double>"
_STATE = f"struct<left:{_ITEM},done:array<{_ITEM}>>"


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """One step of the fold: the fractional document left so far meets the next one."""
    a = acc["left"]
    room_up = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
    room_down = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
    up = _uniform(F.lit(seed), a["key"], x["key"], a["id"], x["id"]) * (room_up + room_down) < room_down

    def item(y: Column, p: Column) -> Column:
        return F.struct(y["key"].alias("key"), y["id"].alias("id"), y["fingerprint"].alias("fingerprint"), y["size"].alias("size"), y["whole"].alias("whole"), p.alias("p"))

    gains, loses = (1 - a["p"]) * a["size"], x["p"] * x["size"]
    a_drops, x_gains = a["p"] * a["size"], (1 - x["p"]) * x["size"]
    a_up = F.when(gains <= loses, F.lit(1.0)).otherwise(a["p"] + loses / a["size"])
    x_down = F.when(loses <= gains, F.lit(0.0)).otherwise(x["p"] - gains / x["size"])
    a_down = F.when(a_drops <= x_gains, F.lit(0.0)).otherwise(a["p"] - x_gains / a["size"])
    x_up = F.when(x_gains <= a_drops, F.lit(1.0)).otherwise(x["p"] + a_drops / x["size"])
    new_a, new_x = item(a, F.when(up, a_up).otherwise(a_down)), item(x, F.when(up, x_down).otherwise(x_up))

    def whole(p: Column) -> Column:
        return (p <= 0.0) | (p >= 1.0)

    both = F.struct(new_a.alias("a"), new_x.alias("x"))
    none = F.lit(None).cast(_ITEM)
    met = F.transform(
        F.array(both),
        lambda b: F.struct(
            F.when(whole(b["a"]["p"]), F.when(whole(b["x"]["p"]), none).otherwise(b["x"])).otherwise(b["a"]).alias("left"),
            F.concat(acc["done"], F.filter(F.array(b["a"], b["x"]), lambda y: whole(y["p"]))).alias("done"),
        ),
    )[0]
    return F.when(a.isNull(), F.struct(x.alias("left"), acc["done"].alias("done"))).otherwise(met).cast(_STATE)


def _round(items: DataFrame, seed: int, block: int) -> DataFrame:
    """Rounds rows (rank, n, item), n being an upper bound of its source's rows: rows (rank, item), all integral.

    Each level writes its blocks to the shared folder; the next one reads the
    one fractional document that each block left, so the rows shrink by
    ``block`` each time and the number of levels is the logarithm of the rows.
    """
    most = items.agg(F.max("n")).first()[0] or 0
    done, level = [], 0
    while most > 0:
        blocks = F.ceil(F.col("n") / block)
        dealt = items.select("rank", blocks.alias("n"), F.pmod(F.xxhash64(F.lit(seed + level), "item.key"), blocks).alias("block"), "item")
        gathered = dealt.groupBy("rank", "n", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        start = F.struct(F.lit(None).cast(_ITEM).alias("left"), F.array().cast(f"array<{_ITEM}>").alias("done")).cast(_STATE)
        folded = written(gathered.select("rank", "n", F.aggregate("items", start, lambda acc, x: _pair(acc, x, seed + level)).alias("s")), f"mix-{level}")  # noqa: B023
        done.append(folded.select("rank", F.explode("s.done").alias("item")))
        items = folded.where(F.col("s.left").isNotNull()).select("rank", "n", F.col("s.left").alias("item"))
        level, most = level + 1, -(-most // block) if most > 1 else 0
        if most == 1:
            break
    odds = _uniform(F.lit(seed), F.lit("last"), "item.key") < F.col("item.p")
    last = items.select("rank", F.struct("item.key", "item.id", "item.fingerprint", "item.size", "item.whole", odds.cast("double").alias("p")).alias("item"))
    for d in done:
        last = last.unionByName(d)
    return last


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 1,
    block: int = 128,
    broadcast_sources: int = 100_000,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    fingerprint: Column | None = None,
) -> DataFrame:
    """Rows (id, fingerprint, source, size, source_size, target, copies), one for each row of ``docs``.

    ``size`` counts words. ``fingerprint`` hashes text and source, if it is not
    given: with the id it names the row, and rows alike in both are
    interchangeable. Null
    texts have no words; null sources are one source, last in order; null ids
    are kept. A document without words, or of a source whose target is 0, has
    no fractional part. Ties and repeated rows are rounded one by one. An empty
    table gives no rows.

    The table of sources is broadcast up to ``broadcast_sources`` rows; beyond
    that it is joined by a shuffle that splits hot sources.
    """
    sized = written(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.xxhash64(F.col(text), F.col(source)) if fingerprint is None else fingerprint).alias("fingerprint"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
        ),
        "sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    targets = checkpointed(source_targets(per_source.select("source", "source_size"), weights, share, cap).withColumnRenamed("source", "s").join(per_source.select(F.col("source").alias("s2"), "n"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2"))
    side = F.broadcast(targets) if targets.count() <= broadcast_sources else targets
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = sized.join(side, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    p = F.when(F.col("size") > 0, F.col("rate") - F.col("whole")).otherwise(F.lit(0.0))
    rows = rows.select("id", "fingerprint", "size", "rank", "n", "whole", p.alias("p"))
    key = F.xxhash64(F.lit(seed), "id", "fingerprint")
    item = F.struct(key.alias("key"), "id", "fingerprint", "size", "whole", "p").alias("item")
    certain = rows.where(F.col("p") <= 0).select("rank", item)
    rounded = _round(rows.where(F.col("p") > 0).select("rank", "n", item), seed, block)
    out = certain.unionByName(rounded)
    side = F.broadcast(targets) if side is not targets else targets
    return out.join(side.select("rank", "s", "source_size", "target"), "rank").select(
        "item.id", "item.fingerprint", F.col("s").alias("source"), "item.size", "source_size", "target", (F.col("item.whole") + F.col("item.p").cast("long")).alias("copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", broadcast_rows: int = 100_000, **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` says, in the same columns of any names.

    Rows are told apart by a hash of all their columns, so rows alike in id and
    text keep their other columns. Rows alike in everything share their copies:
    one of them is taken as often as all of them together. Those are thinned
    out before the join; where there are none, texts are shuffled once. Their
    list is broadcast up to ``broadcast_rows`` rows.
    """
    names = docs.columns
    docs, (id_col, text, source) = numbered(docs, id_col, text, source)
    plain = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else F.col(c) for c, t in docs.dtypes]
    # nulls leave a hash as it is, so their places are hashed too
    fingerprint = F.xxhash64(*plain, *[c.isNull() for c in plain])
    name = {"_mix_i": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "_mix_f": fingerprint}
    copies = mix(docs, id_col=id_col, text=text, source=source, fingerprint=fingerprint, **options)
    total = written(copies.groupBy(F.coalesce("id", F.lit(0)).alias("_mix_i"), F.col("fingerprint").alias("_mix_f")).agg(F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows")), "copies")
    keyed = docs.withColumns(name)
    repeated = total.where("_mix_rows > 1").select(*name)
    n = repeated.count()
    if n:
        side = F.broadcast(repeated) if n <= broadcast_rows else repeated
        keyed = keyed.join(side, list(name), "left_anti").unionByName(keyed.join(side, list(name), "left_semi").dropDuplicates(list(name)))
    joined = keyed.join(total.where("_mix_copies > 0"), list(name))
    return joined.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select(*docs.columns).toDF(*names)
