"""Fill-in-middle examples against a plain version."""

import hashlib

import pytest

pytest.importorskip("defectloom.llm")

from pyspark.sql import functions as F

from defectloom.llm import fill_in_middle as fim

DOCS = "doc_id long, text string, form string, c0 string, _u string"
LONG = "langer Text 🙂 " * 20_000
TEXTS = [None, "", "a", "plain words here", "é́ ñ 🙂🙂 日本", "\x1e\x1b\x1b0\x1e1 \x1b1 x\x1e", "has <P> inside", "<S", "<S>", "x<M>", "<" * 9 + ">", "line\nline\n\n  end ", "\r\n\t   a", "0\x1b", LONG, "same", "same", "$0 \\ $1 [a]"]


def rows():
    return [(i, t, "clash", None, "clash") for i, t in enumerate(TEXTS)] + [(i + 100, f"text number {i} <", "x", "y", "z") for i in range(60)] + [(None, "no id", "", "", ""), (None, None, "", "", ""), (3, "plain words here", "", "", "")]


def plain(doc, text, percent=90, spm_percent=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in fim.MARKERS) or h3 % 100 >= percent:
        return n, "plain", None, None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("percent", "spm_percent"), [(90, 20), (100, 0), (100, 100), (0, 50)])
def test_equals_a_plain_version(spark, percent, spm_percent):
    df = spark.createDataFrame(rows(), DOCS).repartition(3).withColumnRenamed("form", "kind")
    out = fim.fill_in_middle(df, percent=percent, spm_percent=spm_percent)
    assert out.columns == [*df.columns, "n_units", "form", "prefix", "middle", "suffix", "output"]
    got = sorted((tuple(r) for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).select("doc_id", "text", "n_units", "form", "prefix", "middle", "suffix", "output", "back").collect()), key=repr)
    assert got == sorted(((d, t, *plain(d, t, percent, spm_percent), t or "") for d, t, *_ in rows()), key=repr)
    forms = {r[3] for r in got}
    assert forms == ({"plain", "psm", "spm"} if (percent, spm_percent) == (90, 20) else {"plain"} if not percent else {"plain", "spm" if spm_percent else "psm"})


def test_columns_of_the_added_names_are_replaced(spark):
    df = spark.createDataFrame(rows(), DOCS)
    assert fim.fill_in_middle(df).columns.count("form") == 1 and fim.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, text="form")


@pytest.mark.parametrize("unit", ["word", "line"])
def test_words_and_lines_stay_whole(spark, unit):
    import re

    pattern = {"word": r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    df = spark.createDataFrame(rows(), DOCS)
    for r in fim.fill_in_middle(df, unit=unit, percent=100).collect():
        units = re.findall(pattern, r["text"] or "")
        if r["form"] == "plain":
            continue
        assert r["n_units"] == len(units) and r["prefix"] + r["middle"] + r["suffix"] == r["text"]
        ends = {len("".join(units[:k])) for k in range(len(units) + 1)} if len(units) < 1000 else None
        assert ends is None or {len(r["prefix"]), len(r["prefix"] + r["middle"])} <= ends


def test_markers_that_could_meet_are_refused(spark):
    df = spark.createDataFrame(rows(), DOCS)
    for bad in (("", "<S>", "<M>"), ("<<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, markers=bad)
