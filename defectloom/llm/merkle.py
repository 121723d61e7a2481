"""A Merkle manifest of a dataset, with a proof for every row.

Leaves stand in order within their group; every run of ``ARITY`` nodes becomes
one node, until one is left. The groups' last nodes form a tree of the same kind.

The tree is cut into aligned blocks of ``ARITY ** LEVELS`` nodes. Blocks are
dealt to tasks, become one node each, and those are dealt in blocks again: a
storey holds a small part of the nodes of the one below. Proofs come from the
top down. A block is crossed leaf by leaf by fractal traversal: for each of a
few stacked subtrees the task keeps the one that exists, which holds the
present leaf's neighbours, and grows the one that will be wanted next, by one
leaf a step, so that it is ready in time. A leaf's path within the block is
followed by the block's own path, which the storey above has made. A task holds
one block, and of each subtree a part of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.llm.common import written

ARITY, LEVELS, STEP = 8, 4, 2
_DIGEST = 64
#: One level of a path: how many of the run's other nodes stand before the node, and those nodes.
Path = list[tuple[int, str]]
_PATH = "array<struct<place:int,others:string>>"


def node_of(run: str) -> str:
    return sha256(run.encode()).hexdigest()


def fold(node: str, path: Path) -> str:
    """The root that a node and its path give."""
    for place, others in path:
        at = place * _DIGEST
        node = node_of(others[:at] + node + others[at:])
    return node


class Subtree:
    """The levels ``low`` to ``high`` (not included) over a range of a block's leaves, grown leaf by leaf.

    Nodes of its own levels are kept; below them only the open runs are.
    """

    def __init__(self, leaves: Sequence[str], low: int, high: int, first: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = first, min(len(leaves), first + ARITY**high)
        self.kept: list[list[str]] = [[] for _ in range(high - low)]
        self.runs: list[list[str]] = [[] for _ in range(high)]
        self.root = ""

    def grow(self, n: int) -> None:
        """Takes up to ``n`` further leaves; with the last one, open runs are closed."""
        stop = min(self.end, self.at + n)
        for leaf in self.leaves[self.at : stop]:
            self._add(0, leaf)
        if self.at < stop == self.end:
            for level in range(self.high):
                if self.runs[level]:
                    self._close(level)
        self.at = stop

    def _add(self, level: int, node: str) -> None:
        if self.low <= level:
            self.kept[level - self.low].append(node)
        self.runs[level].append(node)
        if len(self.runs[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        node = node_of("".join(self.runs[level]))
        self.runs[level] = []
        if level + 1 == self.high:
            self.root = node
        else:
            self._add(level + 1, node)


def block_levels(rows: int, group_size: int, levels: int) -> int:
    """How far a block's nodes are joined: all its levels where the group has further blocks, else until one is left."""
    if group_size > ARITY**levels:
        return levels
    n, least = 0, 1
    while least < rows:
        n, least = n + 1, least * ARITY
    return n


def block_root(leaves: Sequence[str], levels: int) -> str:
    if not levels:
        return leaves[0]
    tree = Subtree(leaves, levels, levels, 0)
    tree.grow(len(leaves))
    return tree.root


def traverse(leaves: Sequence[str], levels: int, step: int = STEP) -> Iterator[Path]:
    """Every leaf's path within its block, in order."""
    bounds = [(low, min(low + step, levels)) for low in range(0, levels, step)]
    exist = [Subtree(leaves, low, high, 0) for low, high in bounds]
    for tree in exist:
        tree.grow(len(leaves))
    desired = [Subtree(leaves, low, high, ARITY**high) if ARITY**high < len(leaves) else None for low, high in bounds]
    for s in range(len(leaves)):
        path: Path = []
        for (low, high), tree in zip(bounds, exist):
            for level in range(low, high):
                at = s // ARITY**level % ARITY ** (high - level)  # within the subtree
                first = at - at % ARITY
                run = tree.kept[level - low][first : first + ARITY]
                place = at - first
                path.append((place, "".join(run[:place] + run[place + 1 :])))
        yield path
        for i, (low, high) in enumerate(bounds):
            nxt = desired[i]
            if nxt is None:
                continue
            nxt.grow(1)
            if (s + 1) % ARITY**high == 0:
                exist[i] = nxt
                first = s + 1 + ARITY**high
                desired[i] = Subtree(leaves, low, high, first) if first < len(leaves) else None


def positions(nodes: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``nodes`` with pos, their place in their group by ``order``, and n, the group's size.

    A group is spread over ranges; a row's place is its place in the range and
    the group's rows in the ranges before, so no group meets in one task. Rows
    that are alike in all of ``order`` are told apart by where they were read.
    """
    told = nodes.withColumn("_u", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_u")]
    # the number holds the range and the place in it
    kept = written(told.repartitionByRange(*by).sortWithinPartitions(*by).drop("_u").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    kept = kept.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    runs = kept.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range of a group
    starts = runs.select(group, "_part", (before - F.col("_first")).alias("_add"), F.sum("_n").over(w).alias("n"))
    return kept.join(starts, [group, "_part"]).withColumn("pos", F.col("_row") + F.col("_add")).drop("_at", "_part", "_row", "_add")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one block after another, from rows that begin with (g, block) in order."""
    own: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if own and own[0][:2] != row[:2]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _dealt(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels).cast("long"))


def next_storey(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (g, pos, n, h): the blocks of ``nodes`` (g, pos, n, h) as nodes of the storey above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            g, block, _, n, _ = rows[0]
            h = block_root([r[4] for r in rows], block_levels(len(rows), n, levels))
            yield pa.RecordBatch.from_pydict({"g": [g], "pos": [block], "n": [-(-n // ARITY**levels)], "h": [h]})

    rows = _dealt(nodes, levels).select("g", "block", "pos", "n", "h").repartition("g", "block").sortWithinPartitions("g", "block", "pos")
    return rows.mapInArrow(run, "g string, pos long, n long, h string")


def storeys(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` and the storeys above it, up to the one with a single node in each group; a storey has ``ARITY ** -levels`` of the nodes below."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(written(next_storey(out[-1], levels), "storey"))
    return out


def _meeting(nodes: DataFrame, payload: Sequence[str], upper: DataFrame, levels: int) -> DataFrame:
    """The rows of each block after one row with the block's own path; both are dealt alike, so no join is needed."""
    types = {c: t for c, t in nodes.dtypes if c in payload}
    below = _dealt(nodes, levels).select("g", "block", "pos", "n", "h", *payload, F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    above = upper.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("h"), *[F.lit(None).cast(types[c]).alias(c) for c in payload], "path", "subroot")
    return below.unionByName(above).repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _crossed(rows: list[tuple], levels: int) -> Iterator[tuple[tuple, Path, str]]:
    """(row, its whole path, its group's last node) of one block, whose first row holds the block's own path."""
    head, leaves = rows[0], [r[4] for r in rows[1:]]
    own = [(x["place"], x["others"]) for x in head[-2]]
    for row, path in zip(rows[1:], traverse(leaves, block_levels(len(leaves), rows[1][3], levels))):
        yield row, path + own, head[-1]


def paths(nodes: DataFrame, upper: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (g, pos, path, subroot) of ``nodes``, given those of the storey above."""
    fields = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            found = list(_crossed(rows, levels))
            said = [[{"place": p, "others": o} for p, o in path] for _, path, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r, _, _ in found]), pa.array([r[2] for r, _, _ in found]), pa.array(said, fields), pa.array([s for _, _, s in found])], ["g", "pos", "path", "subroot"])

    return _meeting(nodes, [], upper, levels).mapInArrow(run, f"g string, pos long, path {_PATH}, subroot string")


def downward(tree: list[DataFrame], top: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Rows (g, pos, path, subroot) of the storey above the lowest, from those of the highest, storey by storey."""
    for nodes in reversed(tree[1:-1]):
        top = written(paths(nodes, top, levels), "paths")
    return top


def field(c: Column) -> Column:
    """One field of a leaf: ``-`` for null, else its length in UTF-8 bytes, a colon and its value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "lang", shown: dict[str, Column] | None = None, keep_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row, and with ``keep_proofs`` its place and its path.

    A leaf is the hash of the row's ``columns`` (see :func:`field`), lower-case
    hexadecimal SHA-256 like every node. Leaves of a group ascend by id, nulls
    first; rows of one id ascend by their leaves. The groups ascend by their
    UTF-8 bytes, the null group first. proof_sha256 hashes the row's siblings,
    from its run up to the root. ``shown`` has columns that are read with
    another value, as of a copy in doubt: folded_root is what that value's leaf
    gives with the proof of the true rows, and verified tells whether it is the
    root. A null group is a group; texts may be null, empty or of any length;
    repeated rows are leaves of their own; columns of other names are not looked
    at; an empty table gives no rows.
    """
    read = lambda c: F.col(f"`{c}`")
    seen = [(shown or {}).get(c, read(c)) for c in columns]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("1"), read(group).cast("string")), F.lit("0")).alias("g"),
        read(id_col).try_cast("long").alias("doc_id"),
        leaf_of([read(c) for c in columns]).alias("h"),
        leaf_of(seen).alias("shown"),
    )
    placed = written(positions(written(leaves, "leaves"), "g", ["doc_id", "h"]), "placed")
    tree = storeys(placed, levels)
    subroots = tree[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "h") if len(tree) > 1 else placed.select(F.lit("").alias("g"), F.col("g").alias("name"), "h")
    groups = written(positions(subroots, "g", ["name"]), "groups")
    crown = storeys(groups.select("g", "pos", "n", "h"), levels)
    root = next((r["h"] for r in crown[-1].take(1)), None)
    if root is None:
        return docs.sparkSession.createDataFrame([], _ddl(keep_proofs))
    # the highest node of all has an empty path; the groups' last nodes get theirs from it
    above = crown[-1].select("g", "pos", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"))
    of_groups = written(paths(crown[0], downward(crown, above, levels), levels), "paths") if len(crown) > 1 else above
    named = groups.select("pos", "name", "h").join(of_groups.select("pos", "path"), "pos")
    top = written(named.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot")), "paths")
    upper = downward(tree, top, levels)
    return _rows(placed, upper, root, keep_proofs, levels)


def _ddl(keep_proofs: bool) -> str:
    return "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (f", pos long, proof {_PATH}" if keep_proofs else "")


def _rows(placed: DataFrame, upper: DataFrame, root: str, keep_proofs: bool, levels: int) -> DataFrame:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + (["pos", "proof"] if keep_proofs else [])
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64(), pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))]

    def one(row: tuple, path: Path, subroot: str) -> tuple:
        _, _, pos, _, leaf, doc, shown, _, _ = row
        folded = fold(shown, path)
        out = (doc, leaf, subroot, root, node_of("".join(others for _, others in path)), folded, folded == root)
        return (*out, pos, [{"place": p, "others": o} for p, o in path]) if keep_proofs else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            found = [one(*x) for x in _crossed(rows, levels)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    return _meeting(placed, ["doc_id", "shown"], upper, levels).mapInArrow(run, _ddl(keep_proofs))
