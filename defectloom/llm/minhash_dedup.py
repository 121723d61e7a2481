"""Near duplicates by bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles as 64-bit hashes; its sketch
   is the k smallest. Documents with equal sets form one class, and only each
   class's first document goes on.
2. Inverted lists of retained values bring documents together. Two sets with
   the wanted similarity share most of their retained values, so each document
   is listed under its rarest ones only, as many as it takes for two such
   documents to meet; passages that many documents share make no lists.
3. Documents that share a list meet under that list's first document. In a
   group of several blocks all are first compared with eight of its members;
   what is linked to the same ones is one star, whose members need not meet.
   The similarity estimated from union sketches then drops documents that are
   near to no other; large groups are compared in blocks.
4. For those left the full sets are read again, and exact similarity links
   them. A block returns a spanning forest of its links, not its pairs.
5. Links make components; the smallest id names each.

A document is an id with a set: rows of one id, or without id, that differ in
their sets are different documents. Classes carry numbers of their own, so
that classes of one id stay apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from defectloom.llm.blocks import Forest, block_pairs, column, lists, slices_of_bytes, streamed
from defectloom.llm.common import numbered, written
from defectloom.llm.components import components

_LAST = (1 << 63) - 1
#: Bytes of text that are hashed together; some forty bytes of memory for each.
_SLICE = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for at least n places."""
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE))
    return _POWERS[size]


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of bytes other than ASCII white space, A to Z in lower case;
    a text with fewer words than a shingle has is one shingle, without any
    word it has none. All texts are hashed together: a word's hash comes from
    the difference of two running sums.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    word = _mix((sums[end] - sums[begin]) * inverse[begin])
    # sums modulo 2**64 have known collisions between patterned strings of a thousand bytes
    for i in np.flatnonzero(end - begin >= 512).tolist():
        word[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    at = np.searchsorted(begin, np.cumsum(sizes) - sizes)  # each text's first word
    counts = np.diff(np.concatenate([at, [len(begin)]]))
    full = word[: max(0, len(word) - words + 1)].copy()
    for i in range(1, words):
        full = _mix(full * np.uint64(_BASE) + word[i : i + len(full)])
    out = []
    for a, n in zip(at.tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(full[a : a + n - words + 1].view(np.int64)))
        elif n:
            h = word[a : a + 1].copy()
            for i in range(1, n):
                h = _mix(h * np.uint64(_BASE) + word[a + i : a + i + 1])
            out.append(_mix(h + np.uint64(n)).view(np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out


def _fingerprints(sets: list[np.ndarray]) -> list[pa.Array]:
    """The columns n, f1, f2: set sizes and two fingerprints of each set."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    f1 = np.array([int(s.sum()) for s in sets], dtype=np.int64)
    f2 = np.array([int(_mix(s.view(np.uint64) ^ np.uint64(_BASE)).sum().view(np.int64)) if len(s) else 0 for s in sets], dtype=np.int64)
    return [pa.array(n), pa.array(f1), pa.array(f2)]


def sketches(docs: DataFrame, words: int, k: int, id_col: str, text: str) -> DataFrame:
    """Rows (id, n, f1, f2, sketch): set size, two fingerprints of the set, its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of_bytes(batch, 1, _SLICE):
                sets = shingle_sets([t or b"" for t in part.column(1).to_pylist()], words)
                kept = [s[:k] for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), *_fingerprints(sets), sketch], ["id", "n", "f1", "f2", "sketch"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.encode(F.col(text), "UTF-8").alias("t"))
    return rows.mapInArrow(run, "id long, n long, f1 long, f2 long, sketch array<long>")


def prefix_share(k: int, percent: int, deviations: float = 5.4) -> float:
    """The part of its retained values that a document surely shares with one of the wanted similarity.

    The number shared is binomial about ``k * t``; it falls ``deviations``
    standard deviations short with a chance below one in a million.
    """
    t = percent / 100
    return max(0.0, (k * t - deviations * math.sqrt(k * t * (1 - t))) / k)


def meeting_groups(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows (pivot, rep): documents that share a list of a rare retained value, under the list's smallest id."""
    postings = classes.select("rep", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    frequent = postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = postings.join(frequent, "v")
    mine = Window.partitionBy("rep")
    share = prefix_share(k, percent)
    # values in one document only are the rarest and make no list, but they count
    room = F.col("kept") - F.floor(F.col("kept") * share) + 1 - (F.col("kept") - F.count(F.lit(1)).over(mine))
    rare = listed.withColumns({"rank": F.row_number().over(mine.orderBy("df", "v")), "room": room}).where("rank <= room").select("v", "rep")
    rare = written(rare, "postings")
    pivots = rare.groupBy("v").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("v", "pivot")
    return rare.join(pivots, "v").select("pivot", "rep").distinct()


@lru_cache(maxsize=8)
def least_shared(k: int, percent: int, tail: float = 1e-7) -> np.ndarray:
    """For each union of at most 2k retained values, the least number shared that is no rarer than ``tail`` at the wanted similarity.

    Of the union's values a binomial number is shared; the chance to be under
    the bound is at most ``tail``.
    """
    t = percent / 100
    least = np.zeros(2 * k + 1)
    for union in range(1, 2 * k + 1):
        chance, x = 0.0, -1
        while chance <= tail:
            x += 1
            chance += math.comb(union, x) * t**x * (1 - t) ** (union - x)
        least[union] = x
    return least


def _near_enough(values: np.ndarray, offsets: np.ndarray, n: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Matrix of pairs whose union-sketch estimate does not rule the similarity out."""
    m, kept = len(n), np.diff(offsets)
    distinct, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    several = counts > 1
    place = np.cumsum(several) - 1
    row = np.repeat(np.arange(m), kept)
    use = several[inverse]
    row, col = row[use], place[inverse[use]]
    shared = np.zeros((m, m), dtype=np.float32)
    width = 2048
    for at in range(0, int(several.sum()), width):
        mine = (col >= at) & (col < at + width)
        x = np.zeros((m, width), dtype=np.float32)
        x[row[mine], col[mine] - at] = 1
        shared += x @ x.T
    last = np.where(n > k, values[np.maximum(offsets[1:] - 1, 0)], np.iinfo(np.int64).max)
    below = np.empty((m, m))  # values of i up to where both sketches are complete
    for i in range(m):
        own = values[offsets[i] : offsets[i + 1]]
        below[i] = np.searchsorted(own, np.minimum(last[i], last), side="right")
    union = below + below.T - shared
    exact = (n <= k)[:, None] & (n <= k)[None, :]
    ok = (shared > 0) & (shared + 1e-6 >= np.where(exact, percent / 100 * union, least_shared(k, percent)[union.astype(np.int64)]))
    ok &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    np.fill_diagonal(ok, False)
    return ok


def _across(own: np.ndarray, bi: int, bj: int) -> np.ndarray | None:
    """Which pairs a block pair is to compare; None for all."""
    return None if bi == bj else (own[:, None] != own[None, :])


def promising(groups: DataFrame, k: int, percent: int, block_rows: int) -> DataFrame:
    """The rows (pivot, rep, star) of ``groups`` (pivot, rep, star, n, sketch) that some other member may be similar to."""

    names = ["pivot", "rep", "star"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: list[int] = []
        reps: list[np.ndarray] = []
        stars: list[np.ndarray] = []
        for (pivot, bi, bj), t in streamed(batches, 3):
            if t.num_rows > 1:
                values, offsets = lists(column(t, "sketch"))
                ok = _near_enough(values, offsets, column(t, "n").to_numpy(), k, percent)
                across = _across(column(t, "own").to_numpy(), bi, bj)
                hit = (ok if across is None else ok & across).any(axis=1)
                if hit.any():
                    reps.append(column(t, "rep").to_numpy()[hit])
                    stars.append(column(t, "star").to_numpy()[hit])
                    pivots += [pivot] * int(hit.sum())
            if len(pivots) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(np.concatenate(reps)), pa.array(np.concatenate(stars))], names)
                pivots, reps, stars = [], [], []
        if pivots:
            yield pa.RecordBatch.from_arrays([pa.array(pivots, pa.int64()), pa.array(np.concatenate(reps)), pa.array(np.concatenate(stars))], names)

    dealt = block_pairs(groups, ["pivot"], F.col("rep"), F.lit(1), block_rows, block_rows, star="star")
    rows = dealt.select("pivot", "bi", "bj", "own", "rep", "star", "n", "sketch").repartition("pivot", "bi", "bj").sortWithinPartitions("pivot", "bi", "bj")
    return rows.mapInArrow(run, "pivot long, rep long, star int").distinct()


def _exact_links(t: pa.Table, across: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose full sets are similar enough."""
    values, offsets = lists(column(t, "set"))
    n, reps = np.diff(offsets), column(t, "rep").to_numpy()
    _, code = np.unique(values, return_inverse=True)
    mark = np.zeros(int(code.max()) + 1 if len(code) else 0, dtype=np.int32)
    forest, links = Forest(len(n)), []
    for i in range(len(n) - 1):
        may = forest.root != forest.root[i]
        may[: i + 1] = False
        may &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
        if across is not None:
            may &= across[i]
        others = np.flatnonzero(may)
        if not len(others):
            continue
        own = code[offsets[i] : offsets[i + 1]]
        mark[own] = 1
        if len(others) * 4 > len(n):
            running = np.concatenate([[0], np.cumsum(mark[code])])
            both = running[offsets[others + 1]] - running[offsets[others]]
        else:
            both = np.array([int(mark[code[offsets[j] : offsets[j + 1]]].sum()) for j in others.tolist()])
        mark[own] = 0
        near = others[100 * both >= percent * (n[others] + n[i] - both)]
        if len(near):
            links += [(int(reps[i]), int(reps[j])) for j in forest.join(i, near).tolist()]
    return links


def linked(members: DataFrame, percent: int, block_rows: int, block_weight: int) -> DataFrame:
    """Edges (a, b) that span the links among rows (pivot, rep, star, n, set) of each group, but those within a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, bi, bj), t in streamed(batches, 3):
            if t.num_rows > 1 and (links := _exact_links(t, _across(column(t, "own").to_numpy(), bi, bj), percent)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    dealt = block_pairs(members, ["pivot"], F.col("rep"), F.col("n"), block_rows, block_weight, star="star")
    rows = dealt.select("pivot", "bi", "bj", "own", "rep", "set").repartition("pivot", "bi", "bj").sortWithinPartitions("pivot", "bi", "bj")
    return rows.mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text: str, broadcast_ids: int) -> DataFrame:
    """Rows (id, n, f1, f2, set) of the documents in ``wanted`` (id, n, f1, f2), and of others that share an id with one.

    Of the rows without id, which may be many, only those in ``wanted`` come, each once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices_of_bytes(batch, 1, _SLICE):
                sets = shingle_sets([t or b"" for t in part.column(1).to_pylist()], words)
                ends = np.cumsum([len(s) for s in sets])
                full = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), *_fingerprints(sets), full], ["id", "n", "f1", "f2", "set"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.encode(F.col(text), "UTF-8").alias("t"))

    def read(ids: DataFrame) -> DataFrame:
        few = ids.count() <= broadcast_ids
        return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(run, "id long, n long, f1 long, f2 long, set array<long>").where("n > 0")

    found = read(wanted.select("id").where(F.col("id") != _LAST).distinct())
    nameless = wanted.where(F.col("id") == _LAST).drop("id")
    if nameless.take(1):
        alone = rows.where(F.col("id") == _LAST).mapInArrow(run, found.schema).join(nameless, ["n", "f1", "f2"], "left_semi").dropDuplicates(["n", "f1", "f2"])
        found = found.unionByName(alone)
    return found


@F.pandas_udf(ArrayType(IntegerType()))
def _classes(hits: pd.Series) -> pd.Series:
    """Of lists of numbers that belong together, the smallest number that each number's leads to, by number."""

    def joined(lists_: list[list[int]]) -> list[int]:
        root = list(range(1 + max((x for h in lists_ for x in h), default=-1)))
        for h in lists_:
            old = {root[x] for x in h}
            root = [min(old) if r in old else r for r in root]
        return root

    return hits.map(joined)


def stars(docs: DataFrame, groups: DataFrame, classes: DataFrame, words: int, percent: int, block_rows: int, id_col: str, text: str, broadcast_ids: int, leaders: int = 4, broadcast_hashes: int = 4_000_000) -> tuple[DataFrame, DataFrame | None]:
    """``groups`` (pivot, rep) with a column star, and the edges (a, b) that were found; star is -1 where nothing is known.

    In groups of more than ``block_rows`` members, all members' full sets are
    compared with those of a few members: the sets with the most copies, one of
    each of ``leaders`` parts by hash, as what others were made from is often
    copied whole too, and ``leaders`` more by hash. A member belongs to the star of the leaders that it is linked to; leaders with a
    common member are one star. A star's members are in one component, so they
    need not be compared with each other, and a group of a million near copies
    is linked by a million comparisons instead of a million squared.

    Leaders' sets are broadcast up to ``broadcast_hashes`` values in all, and
    joined by a shuffle that can split groups beyond that.
    """
    none = F.lit(-1).alias("star")
    large = written(groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).select("pivot"), "large-groups")
    n = large.count()
    if not n:
        return groups.select("pivot", "rep", none), None
    side = F.broadcast(large) if n <= 100_000 else large
    members = written(groups.join(side, "pivot"), "members")
    by_copies = [F.max(F.when(F.pmod(F.xxhash64(F.lit(-1), "rep"), F.lit(leaders)) == i, F.struct("copies", (-F.col("rep")).alias("r")))) for i in range(leaders)]
    by_hash = [F.min(F.struct(F.xxhash64(F.lit(i), "rep"), "rep")) for i in range(leaders)]
    first = members.join(classes.select("rep", "copies"), "rep").groupBy("pivot").agg(F.array(*[-x["r"] for x in by_copies], *[x["rep"] for x in by_hash]).alias("first"))
    first = first.select("pivot", F.array_distinct(F.array_compact("first")).alias("first"))
    wanted = members.select("rep").distinct().join(classes.select("rep", "id", "n", "f1", "f2"), "rep")
    sets = written(_full_sets(docs, wanted.drop("rep"), words, id_col, text, broadcast_ids).join(wanted, ["id", "n", "f1", "f2"]).select("rep", "n", "set"), "group-sets")
    of_leader = written(first.select("pivot", F.explode("first").alias("rep")).join(sets, "rep"), "leaders")
    total = of_leader.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lead = of_leader.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct("rep", "set"))).alias("lead"))  # at most twice ``leaders`` of each
    compared = members.join(sets, "rep").join(F.broadcast(lead) if total <= broadcast_hashes else lead, "pivot")

    def close(x, i):
        both = F.size(F.array_intersect(x["set"], F.col("set")))
        return F.when(100 * both >= percent * (F.size(x["set"]) + F.col("n") - both), i)

    hits = F.filter(F.transform("lead", close), lambda i: i.isNotNull())
    seen = written(compared.select("pivot", "rep", hits.alias("hits"), F.transform("lead", lambda x: x["rep"]).alias("lead")), "stars")
    class_of = seen.where(F.size("hits") > 0).groupBy("pivot").agg(F.collect_set("hits").alias("hits")).select("pivot", _classes("hits").alias("class"))
    edges = seen.select("rep", F.explode(F.transform("hits", lambda i: F.get("lead", i))).alias("b")).where("rep <> b").select(F.col("rep").alias("a"), "b")
    named = seen.join(F.broadcast(class_of) if n <= 100_000 else class_of, "pivot", "left").select("pivot", "rep", F.coalesce(F.get("class", F.get("hits", F.lit(0))), F.lit(-1)).alias("star"))
    rest = groups.join(side, "pivot", "left_anti").select("pivot", "rep", none)
    return rest.unionByName(named), edges


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    k: int = 48,
    id_col: str = "doc_id",
    text: str = "text",
    block_rows: int = 1024,
    block_weight: int = 2_000_000,
    broadcast_ids: int = 1_000_000,
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Two documents are linked if their sets' intersection has at least
    ``percent`` hundredths of their union. ``component_id`` is the smallest id
    that links lead to, ``kept`` tells whether the row's document is the one of
    that id (of several, or of none with an id, the smallest set fingerprint).
    A null text is empty; a document without words is linked with nothing. Rows
    of one id and one set are one document; a null id counts as the largest. An
    empty table gives no rows. The list of documents to read again is broadcast
    up to ``broadcast_ids`` ids and joined by a shuffle beyond that.
    """
    return _judged(docs, words, percent, k, id_col, text, block_rows, block_weight, broadcast_ids).drop("f1", "f2")


def _judged(docs: DataFrame, words: int, percent: int, k: int, id_col: str, text: str, block_rows: int, block_weight: int, broadcast_ids: int) -> DataFrame:
    """The rows of ``near_duplicates`` with the sets' fingerprints f1 and f2."""
    base = written(sketches(docs, words, k, id_col, text), "sketches")
    whole = base.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    classes = written(whole.withColumn("rep", F.monotonically_increasing_id()), "classes")
    met, known = stars(docs, written(meeting_groups(classes, k, percent), "groups"), classes, words, percent, block_rows, id_col, text, broadcast_ids)
    near = written(promising(met.join(classes.select("rep", "n", "sketch"), "rep"), k, percent, block_rows).join(classes.select("rep", "id", "n", "f1", "f2"), "rep"), "promising")
    sets = written(_full_sets(docs, near.select("id", "n", "f1", "f2").distinct(), words, id_col, text, broadcast_ids), "sets")
    edges = linked(near.join(sets, ["id", "n", "f1", "f2"]), percent, block_rows, block_weight)
    found = components(edges if known is None else edges.unionByName(known)).withColumnRenamed("id", "rep")
    of_linked = found.join(classes.select("rep", "id", "n", "f1", "f2"), "rep")
    firsts = of_linked.groupBy("component").agg(F.min(F.struct("id", "n", "f1", "f2")).alias("first"))
    # nearly all classes are alone; theirs is their own smallest id
    linked_to = of_linked.join(firsts, "component").select("rep", "first")
    of_class = classes.select("n", "f1", "f2", "rep", "id").join(linked_to, "rep", "left").select("n", "f1", "f2", F.coalesce("first", F.struct("id", "n", "f1", "f2")).alias("first"))
    own = base.select("id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left")
    component = F.coalesce("first.id", "id")
    doc_id = F.when(F.col("id") != _LAST, F.col("id"))
    return own.select(
        doc_id.alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(component != _LAST, component).alias("component_id"),
        F.coalesce(F.struct("id", "n", "f1", "f2") == F.col("first"), F.lit(True)).alias("kept"),
        "f1",
        "f2",
    )


def _with_fingerprints(docs: DataFrame, words: int, text: str) -> DataFrame:
    """``docs`` with the columns _n, _f1, _f2 of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices_of_bytes(batch, last, _SLICE):
                sets = shingle_sets([t or b"" for t in part.column(last).to_pylist()], words)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *_fingerprints(sets)], [*part.schema.names[:last], "_n", "_f1", "_f2"])

    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in ("_n", "_f1", "_f2")]])
    return docs.withColumn("_bytes", F.encode(F.col(text), "UTF-8")).mapInArrow(run, schema)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text", broadcast_ids: int = 1_000_000, k: int = 48, block_rows: int = 1024, block_weight: int = 2_000_000) -> DataFrame:
    """``docs`` with one row of each component, the document of the smallest id; of rows with one id and one set, the first by text.

    A row without an id goes only if its own text is linked; without words, it stays.
    """
    names = docs.columns
    docs, (id_col, text) = numbered(docs, id_col, text)
    found = written(_judged(docs, words, percent, k, id_col, text, block_rows, block_weight, broadcast_ids), "near-duplicates")
    several = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_several")).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("_several")
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct()

    def sized(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= broadcast_ids else ids

    key = F.col(id_col).cast("long")
    named, nameless = docs.where(key.isNotNull()), docs.where(key.isNull())
    shared, without_id = bool(several.take(1)), bool(found.where("doc_id IS NULL").take(1))
    if not shared:
        left = named.join(sized(gone), key == F.col("_gone"), "left_anti")
    else:
        # ids of several rows are judged row by row, all others by the id
        several = sized(several)
        once = named.join(several, key == F.col("_several"), "left_anti")
        left = once.join(sized(gone), key == F.col("_gone"), "left_anti")
    if not shared and not without_id:
        return left.toDF(*names)
    unsure = nameless if not shared else nameless.unionByName(named.join(several, key == F.col("_several"), "left_semi"))
    marked = _with_fingerprints(unsure, words, text).withColumn("_id", F.coalesce(key, F.lit(_LAST)))
    bad = found.where("NOT kept").select(F.coalesce("doc_id", F.lit(_LAST)).alias("_id"), F.col("n_shingles").alias("_n"), F.col("f1").alias("_f1"), F.col("f2").alias("_f2")).distinct()
    rows = marked.join(bad, ["_id", "_n", "_f1", "_f2"], "left_anti")
    empty = F.col("_id").eqNullSafe(_LAST) & (F.col("_n") == 0)
    order = F.row_number().over(Window.partitionBy("_id", "_n", "_f1", "_f2").orderBy(F.col(text), F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t and t != "variant"])))
    first = rows.where(~empty).withColumn("_rank", order).where("_rank = 1")
    return left.unionByName(first.select(*docs.columns)).unionByName(rows.where(empty).select(*docs.columns)).toDF(*names)
