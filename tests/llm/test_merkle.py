"""The manifest and its proofs against a plain tree over whole lists."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

pytest.importorskip("defectloom.llm")

from pyspark.sql import functions as F

from defectloom.llm import merkle
from defectloom.llm.common import ascii_lower
from defectloom.llm.queries import op11_merkle_manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos string, h string"
LONG = "Long Text é " * 20_000


def H(s):
    return sha256(s.encode()).hexdigest()


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        path.append((i % 8, "".join(run[: i % 8] + run[i % 8 + 1 :])))
        i //= 8
    return path


def plain_fold(node, path):
    for place, others in path:
        node = H(others[: 64 * place] + node + others[64 * place :])
    return node


def plain_leaf(doc, text, lang, source, n_chars):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n_chars, text)))


def plain_manifest(rows):
    def lower(d, t):
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and t is not None
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if hit else t

    groups = {}
    for d, t, lang, source, n, *_ in rows:
        groups.setdefault(lang, []).append((d, plain_leaf(d, t, lang, source, n), plain_leaf(d, lower(d, t), lang, source, n)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_levels([leaf for _, leaf, _ in groups[lang]])
    crown = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, (d, leaf, shown) in enumerate(groups[lang]):
            path = plain_path(trees[lang], i) + plain_path(crown, k)
            folded = plain_fold(shown, path)
            out.append((d, leaf, trees[lang][-1][0], crown[-1][0], H("".join(o for _, o in path)), folded, folded == crown[-1][0]))
    return sorted(out, key=repr)


def shown():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return {"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))}


@pytest.mark.parametrize("step", [1, 2, 3, 4])
@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 200, 513])
def test_traversal_equals_a_plain_tree(n, step):
    leaves = [H(str(i)) for i in range(n)]
    whole = plain_levels(leaves)
    levels = merkle.block_levels(n, n, 4)
    assert levels == len(whole) - 1 and merkle.block_root(leaves, levels) == whole[-1][0]
    assert list(merkle.traverse(leaves, levels, step)) == [plain_path(whole, i) for i in range(n)]


def test_traversal_of_a_last_block_and_its_memory():
    leaves = [H(str(i)) for i in range(70)]
    alone = plain_levels(leaves)
    # a block among others climbs all its levels, a node without neighbours too
    top = alone[-1][0]
    for _ in range(4 - (len(alone) - 1)):
        top = H(top)
    assert merkle.block_levels(70, 5000, 4) == 4 and merkle.block_root(leaves, 4) == top
    for i, path in enumerate(merkle.traverse(leaves, 4)):
        assert len(path) == 4 and merkle.fold(leaves[i], path) == top
    tree = merkle.Subtree([H(str(i)) for i in range(4096)], 2, 4, 0)
    most = 0
    for _ in range(4096):
        tree.grow(1)
        most = max(most, sum(map(len, tree.kept)) + sum(map(len, tree.runs)))
    assert most <= 64 + 8 + 4 * 8


def some_rows(n=700):
    rng = np.random.default_rng(2)
    texts = [None, "", "ABC def", "É Ä \x00 x", LONG]
    out = []
    for i in range(n):
        lang = [None, "en", "en", "de", "", "zz é", "-", "en"][int(rng.integers(0, 8))]
        out.append((int(rng.integers(-50, 600)) if i % 9 else None, texts[int(rng.integers(0, 4 if i else 5))] if i % 3 else f"Text {i}", lang, "s" if i % 2 else None, i if i % 5 else None, "x", None, "y"))
    return out + out[:20] + [(77, LONG, "en", "s", 1, "", "", "")] + [(5, "same", "en", "s", 1, "", "", "")] * 150


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    rows = some_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    out = merkle.manifest(df, shown=shown(), keep_proofs=True, levels=levels)
    got = out.collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == plain_manifest(rows)
    for r in got[::17]:
        path = [(x["place"], x["others"]) for x in r["proof"]]
        assert merkle.fold(r["leaf"], path) == r["root"] and H("".join(o for _, o in path)) == r["proof_sha256"]


def test_many_groups_and_single_rows(spark):
    rows = [(i, f"T{i}", f"lang{i % 90}", "s", 1, "", "", "") for i in range(200)]
    assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS), shown=shown(), levels=1).collect()), key=repr) == plain_manifest(rows)
    alone = [(i, f"T{i}", f"lang{i}", "s", 1, "", "", "") for i in range(9)]
    for part in (alone, alone[:1], [(None, None, None, None, None, "", "", "")], [(1, "A", None, None, 2, "", "", ""), (2, "B", None, None, 2, "", "", "")]):
        assert sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(part, DOCS), shown=shown()).collect()), key=repr) == plain_manifest(part)
    nothing = merkle.manifest(spark.createDataFrame([], DOCS))
    assert nothing.count() == 0 and nothing.columns[:2] == ["doc_id", "leaf"]


def test_a_changed_row_is_found(spark):
    rows = some_rows(100)
    df = spark.createDataFrame(rows, DOCS)
    assert merkle.manifest(df).where("not verified").count() == 0
    found = merkle.manifest(df, shown={"text": F.when(F.col("n_chars") == 31, F.lit("changed")).otherwise(F.col("text"))})
    assert found.where("not verified").count() == sum(r[4] == 31 and r[1] != "changed" for r in rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op11_merkle_manifest(spark, sf).collect()), key=repr)
    assert got == plain_manifest(rows) and {r[6] for r in got} == {True, False}
