"""Exact nearest neighbours of every row, without a cross join, and exact ranks by hash.

Rows with equal vectors are one point, of which the first ids suffice. Points
lie in the cells of pivots. A point first meets its own cell, which bounds how
far its neighbours are; then it is sent only to the cells that, by the triangle
inequality and the planes between pivots, can hold nearer ones. Cells and the
points sent to them are parted into groups of bounded size, so no task holds
more than two groups' worth of vectors; groups return each point's best alone.
In many dimensions the bounds exclude little, and more cells are visited: that
costs time, never memory, and no neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.session import stored

_BEST = "array<struct<d:double,id:string>>"


def hash_key(key: Column, seed: int) -> Column:
    """A row's place in hash order: hexadecimal digits of its key and the seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_ranks(df: DataFrame, key: str, by: Sequence[str] = (), seed: int = 42, name: str = "rank") -> DataFrame:
    """``df`` with the rank, from 1 on, of each row within its group in the order of a hash of its key; of equal keys any is first.

    Rows are counted in 4096 bands of the hash, whose totals are summed in
    order; only the rows of one band are ranked in one task, so that a group
    of any size is spread. A null key is a key like others.
    """
    told = df.withColumn("_h", hash_key(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)).withColumn("_band", F.substring("_h", 1, 3))
    groups = {f"_g{i}": F.col(c) for i, c in enumerate(by)}
    told = told.withColumns(groups) if groups else told
    bands = told.groupBy(*groups, "_band").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1))  # 4096 rows a group at most
    starts = bands.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    on = [told[c].eqNullSafe(starts[c]) for c in groups] + [told["_band"] == starts["_band"]]
    joined = told.join(starts, on).select(told["*"], "_before")
    within = F.row_number().over(Window.partitionBy(*groups, "_band").orderBy("_h"))
    return joined.withColumn(name, F.col("_before") + within).drop("_h", "_band", "_before", *groups)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, each summed by itself, so that a pair has one value wherever it meets."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _streamed(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that are equal in their first columns, from rows in the order of these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, start, last = [], i, key
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _best_of(asks: pa.Table, points: pa.Table, k: int, dim: int) -> list[list[dict]]:
    """Of each asking vector the k nearest ids among the points', ties by id."""
    one = lambda t, c: t.column(c).combine_chunks() if t.num_rows else None
    p = _vectors(one(points, "vec"), dim)
    ids = points.column("ids").to_pylist()
    out = []
    width = min(len(p), k)
    for at in range(0, asks.num_rows, 256):
        d = _distances(_vectors(one(asks.slice(at, 256), "vec"), dim), p)
        cut = np.partition(d, width - 1, axis=1)[:, width - 1]  # each point has an id at least, so farther ones are not among the best
        for row, most in zip(d, cut):
            near = np.flatnonzero(row <= most)
            out.append([{"d": x, "id": y} for x, y in sorted((float(row[j]), i) for j in near for i in ids[j])[:k]])
    return out


def _met(asks: DataFrame, points: DataFrame, k: int, dim: int, rows: int) -> DataFrame:
    """Rows (c, best) for each asking point (c, vec, cell) and part of its cell's points (c, vec, ids, cell).

    Points and asking points of a cell are dealt by hash into parts of about
    ``rows``; each part of the ones meets each part of the others.
    """
    def parts(df: DataFrame) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n"))

    sizes = parts(asks).withColumnRenamed("n", "na").join(parts(points).withColumnRenamed("n", "np"), "cell")  # a row for each cell

    def dealt(df: DataFrame, mine: str, other: str, kind: int, ids: Column) -> DataFrame:
        own = F.pmod(F.xxhash64(F.lit(kind), "c"), F.col(mine)).cast("int")
        x = df.join(F.broadcast(sizes), "cell").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        a, b = (own, F.col("_other")) if kind == 0 else (F.col("_other"), own)
        return x.select("cell", a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), "c", "vec", ids.alias("ids"))

    both = dealt(asks, "na", "np", 0, F.lit(None).cast("array<string>")).unionByName(dealt(points, "np", "na", 1, F.col("ids")))
    keys = ["cell", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.string())]))
        for t in _streamed(batches, 3):
            asking = t.filter(pc.equal(t.column("kind"), 0))
            held = t.filter(pc.equal(t.column("kind"), 1))
            if asking.num_rows and held.num_rows:
                yield pa.RecordBatch.from_arrays([asking.column("c").combine_chunks(), pa.array(_best_of(asking, held, k, dim), kind)], ["c", "best"])

    return both.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, f"c long, best {_BEST}")


def _kept_best(found: DataFrame, k: int) -> DataFrame:
    """The k best of all that a point's rows (c, best) hold; a point has one row for each part that it met."""
    return found.groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def nearest_neighbours(df: DataFrame, columns: Sequence[str], k: int, key: str = "file", rows: int = 4096, most_pivots: int = 1024, seed: int = 42) -> DataFrame:
    """Rows (key, neighbours): for every row its k nearest others as an array of (d, id), d the squared distance, in order of d, then of id.

    Ids are the keys as strings, which must be unique and not null; distances are Euclidean
    over ``columns``, in which a null counts as 0. Fewer than k other rows give
    fewer neighbours, an empty table no rows. At most ``most_pivots`` pivots are
    broadcast; a task holds ``rows`` points and as many that ask.
    """
    dim = len(columns)
    vec = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    told = df.select(F.col(key).alias("_key"), F.col(key).cast("string").alias("id"), vec.alias("vec")).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})
    told = stored(told)
    # the first k + 1 ids of a point are enough: one of them may be the asking row itself
    first = told.withColumn("_r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("_r") <= k + 1)
    points = first.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids"))
    points = stored(points.withColumn("c", F.monotonically_increasing_id()))
    n = points.count()
    if not n:
        return told.select(F.col("_key").alias(key), F.array().cast(_BEST).alias("neighbours"))
    wanted = min(most_pivots, -(-n // rows))
    pivots = np.array([r["vec"] for r in points.orderBy(F.xxhash64(F.lit(seed), "vec"), "c").limit(wanted).collect()], dtype=np.float64).reshape(wanted, dim)  # wanted is bounded

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                d = _distances(_vectors(part.column(1), dim), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(cell)), cell]))], ["c", "vec", "ids", "cell", "far"])

    held = stored(points.select("c", "vec", "ids").mapInArrow(placed, "c long, vec array<double>, ids array<string>, cell int, far double"))
    radius = np.full(wanted, -1.0)
    for r in held.groupBy("cell").agg(F.max("far").alias("far")).collect():  # a row for each pivot
        radius[r["cell"]] = r["far"]
    own = stored(_kept_best(_met(held.select("c", "vec", "cell"), held, k + 1, dim, rows), k + 1))
    if wanted > 1:
        between = np.sqrt(_distances(pivots, pivots))

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    cell, most = part.column(2).to_numpy(), np.sqrt(part.column(3).to_numpy())
                    d = np.sqrt(_distances(_vectors(part.column(1), dim), pivots))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = (d**2 - d[np.arange(len(cell)), cell][:, None] ** 2) / (2 * between[cell])
                    least = np.maximum(d - radius[None, :], np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0))
                    # a little slack for rounding; what is sent in vain changes nothing
                    ask = (least * (1 - 1e-9) - 1e-12 <= most[:, None]) & (radius[None, :] >= 0)
                    ask[np.arange(len(cell)), cell] = False
                    row, target = ask.nonzero()
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(target.astype(np.int32))], ["c", "vec", "cell"])

        bound = F.when(F.size("best") > k, F.element_at("best", -1)["d"]).otherwise(float("inf"))
        asks = held.select("c", "vec", "cell").join(own, "c").select("c", "vec", "cell", bound.alias("most")).mapInArrow(sent, "c long, vec array<double>, cell int")
        own = _kept_best(own.unionByName(_met(stored(asks), held, k + 1, dim, rows)), k + 1)
    of_point = points.select("h1", "h2", "c").join(own, "c").select("h1", "h2", "best")
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    return told.join(of_point, ["h1", "h2"]).select(F.col("_key").alias(key), others.alias("neighbours"))
