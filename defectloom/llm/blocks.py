"""Comparing the members of groups in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectloom.llm.common import checkpointed


def _total(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x[field].cast("long"))


def block_pairs(members: DataFrame, group: list[str], member: Column, weight: Column, max_rows: int, max_weight: int, broadcast_groups: int = 100_000, alone: int = 1, star: str | None = None) -> DataFrame:
    """``members`` with bi and bj added: each pair of a group's members meets in exactly one (group, bi, bj), or in its own block.

    A group is dealt into as few blocks as hold ``max_rows`` rows and
    ``max_weight`` each on average, or into one if it has at most ``alone``
    times as much; a member goes to every pair that its block
    is in, so groups of one block, nearly all, are not repeated. ``own`` is the
    member's block. Groups of several blocks, of which there is at most one for
    ``max_rows`` rows or ``max_weight``, are broadcast up to ``broadcast_groups``
    and joined by a shuffle beyond that; so members are not shuffled by group.

    Members of a group with equal numbers in the column ``star``, from 0 on, need
    not meet: if they fill a block, their blocks are their own and pairs of such
    blocks are left out. Members of smaller stars, and those with -1, meet all others. So a group that is one star but for a few
    members costs its size times these, not its square.
    """
    kind = F.lit(-1) if star is None else F.col(star)
    sizes = members.groupBy(*group, kind.alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))

    def blocks(n: Column, w: Column) -> Column:
        return F.greatest(F.ceil(n / max_rows), F.ceil(w / max_weight)).cast("int")

    whole = sizes.groupBy(*group).agg(F.sum("_n").alias("_n"), F.sum("_w").alias("_w"), F.collect_list(F.struct("_s", "_n", "_w")).alias("_stars"))  # a group has few stars

    def own_blocks(x: Column) -> Column:
        return (x["_s"] >= 0) & ((x["_n"] >= max_rows) | (x["_w"] >= max_weight))

    rest = F.filter("_stars", lambda x: ~own_blocks(x))
    n, w = (_total(rest, c) for c in ("_n", "_w"))
    stars = F.flatten(F.transform(F.filter("_stars", own_blocks), lambda x: F.array_repeat(x["_s"], blocks(x["_n"], x["_w"]))))
    # the block's star by block; blocks of one star lie side by side
    large = checkpointed(whole.where(blocks(F.col("_n"), F.col("_w")) > alone).select(*group, F.concat(F.array_repeat(F.lit(-1), blocks(n, w)), stars).alias("_b")))
    few = large.count() <= broadcast_groups
    joined = members.join(F.broadcast(large) if few else large, group, "left").withColumn("_s", kind).withColumn("_s", F.when(F.array_contains("_b", F.col("_s")), F.col("_s")).otherwise(-1))
    mine = F.size(F.filter("_b", lambda x: x == F.col("_s")))
    own = F.array_position("_b", F.col("_s")).cast("int") - 1 + F.pmod(F.xxhash64(F.lit(3), member), mine).cast("int")
    dealt = joined.withColumn("own", F.when(F.col("_b").isNull(), 0).otherwise(own))
    every = F.filter(F.transform("_b", lambda x, o: F.when((F.col("_s") < 0) | (x != F.col("_s")), o)), lambda o: o.isNotNull())
    others = F.coalesce(every, F.array(F.lit(0)))
    pairs = F.transform(others, lambda o: F.struct(F.least(o, "own").alias("bi"), F.greatest(o, "own").alias("bj")))
    return dealt.withColumn("_p", F.explode(pairs)).withColumns({"bi": F.col("_p.bi"), "bj": F.col("_p.bj")}).drop("_p", "_b", "_s")


def streamed(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows that are equal in their first ``n_keys`` columns, from rows in the order of these."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            k = tuple(keys[:, a].tolist())
            if k != key and held:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = k
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def slices_of_bytes(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes each in column ``text``, a longer value alone or last."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    ends = np.arange(most, sizes[-1], most) if len(sizes) else []
    cuts = np.unique(np.concatenate([[0], np.searchsorted(sizes, ends) + 1, [batch.num_rows]])).astype(np.int64)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        yield batch.slice(a, b - a)


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column."""
    offsets = a.offsets.to_numpy()
    return a.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Joins position i with others; returns one of them for each set newly joined."""
        roots = self.root[others]
        fresh, first = np.unique(roots, return_index=True)
        keep = fresh != self.root[i]
        if not keep.any():
            return others[:0]
        self.root[np.isin(self.root, fresh[keep])] = self.root[i]
        return others[first[keep]]
