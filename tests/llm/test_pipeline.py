"""Each stage of the pipeline against a plain version, on a small table and on odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("defectloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F

from defectloom.llm import bpe, language_id
from test_table_operators import LOWER, WORD, plain_sets, plain_targets, smallest_reachable
from test_text_operators import plain_phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row string, _d string, c1 string"
SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def corpus():
    """Clean texts in two languages, shared lines, near copies, junk, foreign script, nulls and repeated rows."""
    rng = np.random.default_rng(11)
    words = {"en": "the and of river stone house water light under over garden small large green winter summer".split(), "de": "der und das fluss stein haus wasser licht unter klein gross garten winter sommer nacht gestern".split()}
    data = []

    def add(doc_id, text, lang, source):
        data.append((doc_id, text, lang, source, None if text is None else len(text), "clash", "clash", None, "c"))

    for i in range(60):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(rng.choice(words[lang], 12)) + "." for _ in range(int(rng.integers(2, 6)))]
        if i % 4 == 0:
            lines.insert(1, "This line stands in many documents, word for word.")
        add(i, "\n".join(lines), lang if i % 5 else None, f"s{i % 3}" if i % 7 else None)
    long = " ".join(rng.choice(words["en"], 400))
    for i in range(100, 106):
        add(i, long + f" {'x' * (i - 99)}", "en", "s0")
    for text in (None, "", " 12 34 !", "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 4):
        add(200 + len(data), text, "en" if text else None, "s1")
    data += [data[0]] * 2 + [data[1][:5] + ("another row of this id and text",) + data[1][6:]]
    add(None, "a row without an id in the garden under the small house", "en", None)
    return data


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def plain_language(spark, docs):
    held = language_id.is_held_out(F.col("doc_id"))
    samples = language_id.samples(docs.where(~held), "text", "lang", F.col("doc_id"))
    out = Counter()
    for r in docs.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        t = language_id.folded(r["text"])
        bits = {x: plain_phrases(t, s) * np.log2(len(s)) for x, s in samples.items()}
        best = min(sorted(bits), key=bits.get)
        if (bits[best] - np.log2(len(samples[best]))) / len(t) < 8:
            out[(*r[:2], best, *r[3:])] += 1
    return out


def plain_unique_lines(data):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    last = 1 << 63
    holders = defaultdict(set)
    for r in data:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(last if r[0] is None else r[0])
    out = Counter()
    for r, n in data.items():
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == (last if r[0] is None else r[0])]
        out[r if len(kept) == len(lines) else (r[0], "\n".join(kept), *r[2:4], len("\n".join(kept)), *r[5:])] += n
    return out


def plain_one_of_each(data):
    """Which (id, set of shingles) stay, each once; texts without words and id stay each."""
    docs = sorted({(r[0] is None, r[0] or 0, frozenset(plain_sets(r[1], 5))) for r in data}, key=lambda d: (d[0], d[1], len(d[2]), hash(d[2])))
    edges = [(i, j) for i, a in enumerate(docs) for j, b in enumerate(docs) if i < j and a[2] and b[2] and 5 * len(a[2] & b[2]) >= 4 * len(a[2] | b[2])]
    first = smallest_reachable(range(len(docs)), edges)
    return {docs[i] for i in first if first[i] == i}


def check_mixing(before, after):
    size = {r: len(WORD.findall(r[1] or "")) for r in before}
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r, n in before.items():
        sizes[r[3]] += n * size[r]
        longest[r[3]] = max(longest[r[3]], size[r])
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    for r, n in after.items():
        taken[r[3]] += n * size[r]
    target = plain_targets(sizes)
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in sizes)


def check_packing(docs, pieces):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(bpe.default_tokenizer()).encode
    wanted, found, windows = Counter(), Counter(), defaultdict(list)
    for r, n in docs.items():
        ids = [*encode(r[1] or "", add_special_tokens=False).ids, 1]
        wanted[r[0], len(ids)] += n * len(ids)
        for p in (p for p in pieces if p["doc_id"] == r[0] and p["doc_tokens"] == len(ids)):
            assert sum(x[0] == r[0] for x in docs) > 1 or p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    for p in pieces:
        found[p["doc_id"], p["doc_tokens"]] += p["length"]
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert wanted == found
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0


def test_stages_and_chain(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), DOCS).repartition(3)
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = rows(docs) if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            assert out[name] == plain_language(spark, before)
            assert {r[2] for r in out[name]} == {"en", "de"} and len(out[name]) < before.distinct().count()
    assert out["line_dedup"] == plain_unique_lines(out["language"])
    assert any(r[1] != x[1] for r, x in zip(sorted(out["line_dedup"], key=str), sorted(out["language"], key=str)))
    kept = Counter((r[0] is None, r[0] or 0, frozenset(plain_sets(r[1], 5))) for r in out["near_dedup"].elements())
    stay = plain_one_of_each(out["line_dedup"])
    assert {k for k in kept if k[2]} == {d for d in stay if d[2]} and all(n == 1 for k, n in kept.items() if k[2])
    assert sum(n for k, n in kept.items()) < sum(out["line_dedup"].values()) and set(out["near_dedup"]) <= set(out["line_dedup"])
    check_mixing(out["near_dedup"], out["mixing"])
    check_packing(out["mixing"], out["packing"])

    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # order and random numbers depend on the rows alone, so only the windows may differ
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == Counter((p["doc_id"], p["doc_tokens"]) for p in out["packing"] if p["start"] == 0)
    check_packing(out["mixing"], pieces)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = STAGES["language"](spark, docs, SF)
    assert kept.columns == docs.columns and rows(kept) == rows(docs)
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() > 0.3 * docs.count()


def test_mixing_keeps_every_column(spark):
    data = [(1, "one text", x, "s", 8, None, None, None, None) for x in ("en", "de")] + [(2, "b", None, "t", 1, None, None, None, None), (2, "b", "t", None, 1, None, None, None, None)]
    out = rows(STAGES["mixing"](spark, spark.createDataFrame(data, DOCS), SF))
    assert set(out) <= set(data) and max(out.values()) <= 2


@pytest.mark.parametrize("data", [[], [(None,) * 9] * 2, [(1, "", None, None, 0, None, None, None, None)] * 2 + [(7, "a b c d e f", "en", "s", None, None, None, None, None)]])
def test_odd_tables(spark, data):
    docs = spark.createDataFrame(data, DOCS)
    got = {name: rows(stage(spark, docs, SF)) for name, stage in corpus_pipeline.STAGES}
    with_words = [r for r in data if r[1]]
    assert got["language"] == Counter(with_words) and got["line_dedup"] == Counter(data)
    assert got["near_dedup"] == Counter(dict.fromkeys(data, 1) if data and data[0][0] else data)
    assert set(got["mixing"]) <= set(data) and all(got["mixing"][r] in (1, 2) for r in with_words)
    assert sum(n for p, n in got["packing"].items() if p[1] == 0) == len(data)


def test_clean_removes_what_was_written(spark):
    from pathlib import Path

    from defectloom.llm import common

    kept = common.written(spark.range(3), "x")
    assert kept.count() == 3
    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "defectloom" / spark.sparkContext.applicationId
    assert any(folder.iterdir())
    common.clean(spark)
    assert not folder.exists()
