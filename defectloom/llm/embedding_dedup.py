"""Near-duplicate embeddings by a forest of random-projection trees.

Trees split recursively along random directions at medians; a vector near a
split goes both ways (spill). The forest has two levels. Coarse trees, fitted on
a bounded sample, deal large groups into cells that one task can hold; a vector
is shipped once for each of its cells, and a group that is small enough is one
cell. In a cell many thin trees split its own members down to leaves, and
vectors that share a leaf are compared by exact cosine in double precision.

Vectors are compared only within a group: one label and one dimension. Equal
vectors of a group are one class, so a vector that repeats a million times is
compared once. A pair of classes is counted only in the first cell they share,
so counts add up without any list of pairs; cells return counts and a spanning
forest. Cells that the trees cannot split are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectloom.llm.blocks import Forest, block_pairs, column, lists, streamed
from defectloom.llm.common import written
from defectloom.llm.components import components

_LAST = (1 << 63) - 1
#: A split that would send more than this part of its vectors both ways is not made.
_MOST_SPILT = 0.3


class ProjectionTree:
    """Splits of a sample, down to nodes of at most ``least`` vectors or those that no direction splits well.

    Node i sends x left if ``x @ direction[i] <= threshold[i] + spill`` and
    right if it is above ``threshold[i] - spill``; children are nodes, or
    leaves as the complements of their numbers.
    """

    def __init__(self, sample: np.ndarray, least: int, spill: float, seed: int, tries: int = 3):
        rng = np.random.default_rng(seed)
        self.spill = spill
        direction, threshold, child, self.leaf_rows = [], [], [], []
        work = [(np.arange(len(sample)), -1, 0)]
        self.start = -1
        while work:
            rows, parent, side = work.pop()
            best = None
            for _ in range(tries if len(rows) > least else 0):
                d = rng.standard_normal(sample.shape[1])
                d /= np.linalg.norm(d)
                along = sample[rows] @ d
                middle = float(np.median(along))
                spilt = float(np.mean(np.abs(along - middle) <= spill))
                if best is None or spilt < best[0]:
                    best = spilt, d, along, middle
            if best is None or best[0] > _MOST_SPILT:
                me = ~len(self.leaf_rows)
                self.leaf_rows.append(rows)
            else:
                me = len(direction)
                direction.append(best[1])
                threshold.append(best[3])
                child.append([0, 0])
                work += [(rows[best[2] > best[3] - spill], me, 1), (rows[best[2] <= best[3] + spill], me, 0)]
            if parent >= 0:
                child[parent][side] = me
            else:
                self.start = me
        self.direction, self.threshold, self.child = np.array(direction), np.array(threshold), np.array(child, dtype=np.int64)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaf numbers, a row once for each of its leaves."""
        row, node = np.arange(len(x)), np.full(len(x), self.start)
        rows, leaves = [row[node < 0]], [~node[node < 0]]
        row, node = row[node >= 0], node[node >= 0]
        while len(row):
            off = np.einsum("ij,ij->i", x[row], self.direction[node]) - self.threshold[node]
            left, right = off <= self.spill, off > -self.spill
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.child[node[left], 0], self.child[node[right], 1]])
            rows.append(row[node < 0])
            leaves.append(~node[node < 0])
            row, node = row[node >= 0], node[node >= 0]
        return np.concatenate(rows), np.concatenate(leaves)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided off first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spill_width(threshold: float, dim: int, share: float) -> float:
    """``share`` of the standard deviation with which two unit vectors at the threshold differ along a random direction."""
    return share * float(np.sqrt(2 * (1 - threshold) / dim))


def _cell_rows(dim: int, cell_rows: int, cell_values: int) -> int:
    return max(2, min(cell_rows, cell_values // max(1, dim)))


def coarse_forest(classes: DataFrame, threshold: float, coarse: int, spill: float, cell_rows: int, cell_values: int, sample: int, seed: int) -> dict[tuple[int, int], list[ProjectionTree]]:
    """Trees of the groups with more classes than a cell holds, fitted on ``sample`` classes of all of them in expectation.

    Groups of which fewer than 32 classes fall into the sample get no tree; so
    at most ``sample / 32`` groups have one.
    """
    most = F.greatest(F.lit(2), F.least(F.lit(cell_rows), F.floor(F.lit(cell_values) / F.greatest(F.lit(1), F.col("dim")))))
    large = classes.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).where(F.col("n") > most)
    total, dim = large.agg(F.sum("n"), F.max("dim")).first()
    if not total:
        return {}
    share = min(1.0, min(sample, 64 * sample // dim) / total)
    fitted = {(r["g1"], r["g2"]): r["dim"] for r in large.where(F.col("n") * share >= 32).collect()}
    if not fitted:
        return {}
    wanted = classes.sparkSession.createDataFrame(sorted(fitted), "g1 long, g2 long")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h1", "h2"), 11) / float(1 << 53)
    got = classes.where(u < share).join(F.broadcast(wanted), ["g1", "g2"]).select("g1", "g2", "h1", "h2", "embedding").toArrow().sort_by([("h1", "ascending"), ("h2", "ascending")])
    key = np.stack([got.column(0).to_numpy(), got.column(1).to_numpy()])
    out = {}
    for (g1, g2), d in sorted(fitted.items()):
        mine = np.flatnonzero((key[0] == g1) & (key[1] == g2))
        values, _ = lists(column(got.select(["embedding"]).take(pa.array(mine)), "embedding"))
        x = _unit(values.reshape(len(mine), d))
        least = max(16, int(share * _cell_rows(d, cell_rows, cell_values)))
        out[g1, g2] = [ProjectionTree(x, least, spill_width(threshold, d, spill), seed + i) for i in range(coarse)]
    return out


def _dealt(classes: DataFrame, forest: dict[tuple[int, int], list[ProjectionTree]]) -> DataFrame:
    """Rows (cell, g1, g2, rep, size, cells, embedding): a class once for each cell; ``cells`` are all its cells in order."""
    rows = classes.select("g1", "g2", "rep", "size", "embedding")
    if not forest:
        return rows.select(F.lit(0).cast("long").alias("cell"), "g1", "g2", "rep", "size", F.array(F.lit(0).cast("long")).alias("cells"), "embedding")
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                g1, g2 = part.column(0).to_numpy(), part.column(1).to_numpy()
                row, code = [], []
                alone = np.ones(part.num_rows, dtype=bool)
                for key in set(zip(g1.tolist(), g2.tolist())) & trees.keys():
                    mine = np.flatnonzero((g1 == key[0]) & (g2 == key[1]))
                    alone[mine] = False
                    values, _ = lists(part.column(4).take(pa.array(mine)))
                    x = _unit(values.reshape(len(mine), -1))
                    for i, t in enumerate(trees[key]):
                        r, leaf = t.leaves(x)
                        row.append(mine[r])
                        code.append(leaf + (i << 32))
                row.append(np.flatnonzero(alone))
                code.append(np.zeros(len(row[-1]), dtype=np.int64))
                row, code = np.concatenate(row), np.concatenate(code)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                ends = np.cumsum(np.bincount(row, minlength=part.num_rows))
                take = pa.array(row)
                cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(code))
                yield pa.RecordBatch.from_arrays([pa.array(code), *[part.column(i).take(take) for i in range(4)], cells.take(take), part.column(4).take(take)], ["cell", "g1", "g2", "rep", "size", "cells", "embedding"])

    return rows.mapInArrow(run, "cell long, g1 long, g2 long, rep long, size long, cells array<long>, embedding " + dict(rows.dtypes)["embedding"])


def near_matrix(x: np.ndarray, threshold: float, trees: int, leaf: int, spill: float, seed: int) -> np.ndarray:
    """Which of the unit vectors share a leaf of some tree and have the wanted cosine."""
    m = len(x)
    near = np.zeros((m, m), dtype=bool)
    for i in range(trees if m > 2 * leaf else 1):
        found = ProjectionTree(x, leaf, spill, seed + i).leaf_rows if m > 2 * leaf else [np.arange(m)]
        for rows in found:
            mine = x[rows]
            for at in range(0, len(rows), 1024):
                near[np.ix_(rows[at : at + 1024], rows)] |= mine[at : at + 1024] @ mine.T >= threshold
        if len(found) == 1:  # all with all: other trees add nothing
            break
    np.fill_diagonal(near, False)
    return near | near.T


def _cell_links(t: pa.Table, cell: int, bi: int, bj: int, threshold: float, trees: int, leaf: int, spill: float, seed: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of each member the vectors newly linked to it, and a spanning forest of the links."""
    m = t.num_rows
    values, _ = lists(column(t, "embedding"))
    x = _unit(values.reshape(m, -1))
    near = near_matrix(x, threshold, trees, leaf, spill_width(threshold, x.shape[1], spill), seed)
    if bi != bj:
        own = column(t, "own").to_numpy()
        for b in (bi, bj):
            rows = np.flatnonzero(own == b)
            near[np.ix_(rows, rows)] = False
    codes, offsets = lists(column(t, "cells"))
    row, earlier = np.repeat(np.arange(m), np.diff(offsets)), codes < cell
    if earlier.any():
        order = np.argsort(codes[earlier], kind="stable")
        for rows in np.split(row[earlier][order], np.flatnonzero(np.diff(codes[earlier][order])) + 1):
            near[np.ix_(rows, rows)] = False
    reps, size = column(t, "rep").to_numpy(), column(t, "size").to_numpy().astype(np.float64)
    linked = np.flatnonzero(near.any(axis=1))
    counts = np.concatenate([near[linked[at : at + 256]].astype(np.float64) @ size for at in range(0, len(linked), 256)] or [size[:0]])
    forest, links = Forest(m), []
    for i in linked.tolist():
        links += [(int(reps[i]), int(reps[j])) for j in forest.join(i, np.flatnonzero(near[i])).tolist()]
    return reps[linked], counts.astype(np.int64), links


def _compared(members: DataFrame, threshold: float, trees: int, leaf: int, spill: float, block_rows: int, block_values: int, seed: int) -> DataFrame:
    """Rows (rep, other, links): counts of new links (other null) and edges (links null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, _, _, bi, bj), t in streamed(batches, 5):
            if t.num_rows < 2:
                continue
            reps, counts, links = _cell_links(t, cell, bi, bj, threshold, trees, leaf, spill, seed)
            if len(reps):
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.nulls(len(reps), pa.int64()), pa.array(counts)], ["rep", "other", "links"])
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["rep", "other", "links"])

    dealt = block_pairs(members, ["cell", "g1", "g2"], F.col("rep"), F.size("embedding"), block_rows, block_values, alone=2)
    keys = ["cell", "g1", "g2", "bi", "bj"]
    rows = dealt.select(*keys, "own", "rep", "size", "cells", "embedding").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "rep long, other long, links long")


def _usable(e: Column) -> Column:
    return F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    trees: int = 8,
    leaf: int = 128,
    spill: float = 0.4,
    coarse: int = 3,
    cell_rows: int = 8192,
    cell_values: int = 1 << 23,
    sample: int = 65_536,
    seed: int = 7,
    id_col: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``.

    Vectors are linked where their labels, of any type that Spark can hash, are
    equal and not null, their dimensions are equal, and their cosine is at least
    ``threshold``. Vectors that are null, zero, or with null or non-finite
    components link with nothing. Arrays of floats are kept as they are, all
    others are doubles. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` tells whether it is
    the row's own. Null ids count as the largest; rows of one id with different
    vectors are different vectors; an empty table gives no rows. Labels and
    vectors are told apart by 128-bit hashes.

    A cell holds at most ``cell_rows`` vectors and ``cell_values`` numbers.
    Coarse trees are fitted on ``sample`` classes at most (in expectation, of 64
    dimensions, fewer of more); all rows are indexed. A cell that stays larger
    is compared in blocks, so that nothing is left out. ``spill`` is in units of
    the deviation of a pair at the threshold along a random direction.
    """
    kind = dict(vectors.dtypes)[embedding]
    e = F.col(embedding) if kind == "array<float>" else F.col(embedding).cast("array<double>")
    usable = F.coalesce(F.col(label).isNotNull() & _usable(e), F.lit(False))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.col(label).alias("label"), e.alias("embedding"), usable.alias("usable"))
    hashes = {f"{k}{i}": F.xxhash64(F.lit(s), *c) for k, c in (("g", ["label", F.size("embedding")]), ("h", ["embedding"])) for i, s in ((1, 3), (2, 5))}
    keyed = written(rows.withColumns(hashes).drop("label"), "vectors")
    key = ["g1", "g2", "h1", "h2"]
    whole = keyed.where("usable").groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
    classes = written(whole.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    forest = coarse_forest(classes, threshold, coarse, spill, cell_rows, cell_values, sample, seed)
    # a pair of blocks is as large as a cell
    met = written(_compared(_dealt(classes, forest), threshold, trees, leaf, spill, max(1, cell_rows // 2), max(1, cell_values // 2), seed), "vector-links")
    counts = met.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(met.where("links IS NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep")
    ids = classes.select("rep", "id")
    firsts = found.join(ids, "rep").groupBy("component").agg(F.min("id").alias("first"))
    of_linked = found.join(firsts, "component").select("rep", "first")
    named = (
        classes.select(*key, "rep", "id", "size")
        .join(counts, "rep", "left")
        .join(of_linked, "rep", "left")
        .select(*key, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("first", "id").alias("component"))
    )
    linked = keyed.where("usable").select("id", *key).join(named, key).select("id", "n_links", "component")
    alone = keyed.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.when(F.col("id") != _LAST, F.col("id")).alias("vec_id"), "n_links", F.when(F.col("component") != _LAST, F.col("component")).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
