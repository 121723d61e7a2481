"""Filters, near duplicates, mixing and lines against plain versions, with odd rows in every table."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("defectloom.llm")

from pyspark.sql import functions as F

from defectloom.llm import embedding_dedup, line_dedup, minhash_dedup, mixing, queries, url_filter
from defectloom.llm.blocks import block_pairs
from defectloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, rep string, n string"


def smallest_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


# ---- urls

URLS = ["http://www.Example.com/en/7x?q#f", "https://example.com/en/6", "http://a.net/de/81", "http://example.net/de/8", "http://x.example.net/de/7", "http://org/es/", "http://forg/es/", None, "", "no scheme", "http://", "x://h", "http://com#/en/", "http://com/en/", "a://b://c.com/en/", "http://ÄB.com/EN/", "http://ex.com/en/" + "y" * 9000]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
        host, path = m[1].translate(LOWER), m[2]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_urls(spark):
    data = [(i, u, "x") for i, u in enumerate(URLS)] + [(1, URLS[1], "y")]
    df = spark.createDataFrame(data, "page_id long, url string, rule string")
    got = url_filter.judge_urls(df, queries.RULES).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_verdict(r["url"])
    assert url_filter.judge_urls(df.limit(0), queries.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(df, []).collect()} == {"allow"}
    both = url_filter.judge_urls(df, [("allow", "com", "/en/"), ("block", "com", "/en/")]).collect()
    assert {r["verdict"] for r in both if r["rule"]} == {"block"}


def test_long_lists_take_several_cascades(spark):
    rng = np.random.default_rng(9)
    hosts = [f"h{i}.example" for i in range(300)]
    rules = [(str(rng.choice(["block", "allow"])), str(h), "/" + "p" * int(rng.integers(0, 700))) for h in rng.choice(hosts, 900)]
    urls = [f"http://www.{h}/{'p' * int(rng.integers(0, 800))}" for h in rng.choice(hosts, 600)]
    fits = {}
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        hits = [(len(h + p), len(h), h + p, a == "block") for a, h, p in rules if host.endswith("." + h) and ("/" + path).startswith(p)]
        fits[i] = (max(hits)[2], "block" if max(hits)[3] else "allow") if hits else (None, "allow")
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, _keys string, c0 string")
    for most in (1 << 28, 1024):
        out = url_filter.judge_urls(df, rules, max_bytes=most)
        assert out.columns == [*df.columns, "host", "path", "rule", "verdict"]
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in out.collect()} == fits


def test_cascade_is_exact(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("key")).select("key", url_filter.key_hashes(F.col("key")).alias("h")).select("key", "h.a", "h.b").cache()
    listed = keys.where("cast(key as int) % 7 = 0").select("a", "b")
    cascade = url_filter.build_cascade(keys.select("a", "b"), listed, first_mistakes=0.3)
    assert len(cascade.levels) > 2
    all_keys = keys.toPandas()
    said = cascade.listed(all_keys["a"].to_numpy(), all_keys["b"].to_numpy())
    assert (said == (all_keys["key"].astype(int) % 7 == 0).to_numpy()).all()
    with pytest.raises(RuntimeError):
        url_filter.build_cascade(keys.select("a", "b"), listed, max_bytes=8)
    assert url_filter.build_cascade(keys.select("a", "b"), listed.limit(0)).levels == []


def test_short_lists_against_large_universes(spark):
    hashes = url_filter.key_hashes(F.col("id").cast("string"))
    for size in (20_000, 1_000_000):
        keys = spark.range(size).select("id", hashes.alias("h")).select("id", "h.a", "h.b")
        listed = keys.where(f"id % {size // 50} = 7").select("a", "b")
        bits = url_filter.cascade_bits(50, size)
        cascade = url_filter.build_cascade(keys.select("a", "b"), listed, max_bytes=512)
        assert 8 * cascade.nbytes <= 1.25 * bits + 8 * 128 and url_filter.parts_for(50, size, 512) == 1
        found = keys.toPandas()
        assert (cascade.listed(found["a"].to_numpy(), found["b"].to_numpy()) == (found["id"] % (size // 50) == 7).to_numpy()).all()
    # a bound on the size of lists alone would not hold: the first level grows with the universe's logarithm
    assert url_filter.parts_for(50, 10**11, 512) == 1 and url_filter.cascade_bits(50, 10**11) < 50 * 60
    assert url_filter.parts_for(10**9, 10**11, 256 << 20) in range(6, 12)


def test_rules_and_many_urls(spark):
    rules = [("block" if i % 3 else "allow", f"h{i}.example", f"/p{i % 7}") for i in range(50)]
    urls = spark.range(1_000_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 5000, F.lit(".example/p"), F.col("id") % 11, F.lit("/"), F.col("id")).alias("url"))
    got = url_filter.judge_urls(urls, rules, max_bytes=1024)
    i, p = F.col("page_id") % 5000, F.col("page_id") % 11
    fits = (i < 50) & (p.cast("string").substr(1, 1) == (i % 7).cast("string"))
    expect = F.when(fits, F.when(i % 3 > 0, "block").otherwise("allow"))
    # rules are prefixes: /p1 fits /p10 as well
    assert got.where(F.col("rule").isNotNull() != fits).count() == 0
    assert got.where(fits & (F.col("verdict") != expect)).count() == 0 and got.count() == 1_000_000


# ---- near duplicates

def plain_sets(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def near_docs():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    data, i = [], 0
    common = " ".join(rng.choice(vocabulary, 60))
    for g in range(25):
        base = rng.choice(vocabulary, int(rng.integers(20, 300))).tolist()
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for at in rng.integers(0, len(w), int(rng.integers(0, max(1, len(w) // 30)))):
                w[at] = str(rng.choice(vocabulary))
            text = " ".join(w) + (" " + common if g % 2 else "")
            data.append((i, text.upper() if i % 5 == 0 else text))
            i += 1
    data += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "two words"), (i + 4, "Two  WORDS"), (i + 5, "one"), (i + 6, "long " * 5000), (i + 7, "é Ä ü"), (i + 8, "é ä ü")]
    return data


@pytest.mark.parametrize(("words", "percent", "block_rows"), [(3, 85, 1024), (5, 80, 4)])
def test_near_duplicates(spark, words, percent, block_rows):
    data = near_docs()
    sets = {i: plain_sets(t, words) for i, t in data}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expect = smallest_reachable(sets, edges)
    df = spark.createDataFrame([(i, t, None, None, None, "c", "r", "n") for i, t in data], DOCS).repartition(5)
    got = minhash_dedup.near_duplicates(df, words, percent, block_rows=block_rows).collect()
    assert len(edges) > 20 and len(got) == len(data)
    assert {r["doc_id"]: r["component_id"] for r in got} == expect
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == expect[r["doc_id"]]) for r in got)
    left = minhash_dedup.drop_near_duplicates(df, words, percent, block_rows=block_rows)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i in expect if expect[i] == i)


def test_near_duplicates_odd_rows(spark):
    t = " ".join(f"v{i}" for i in range(40))
    data = [(7, t), (7, t), (None, t), (9, None), (9, None), (None, "alone with more words")]
    df = spark.createDataFrame([(i, x, None, None, None, "", "", "") for i, x in data], DOCS)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert len(got) == 6 and (7, 7, True) in got and (9, 9, True) in got and (None, 7, False) in got
    assert sum(r["doc_id"] == 7 for r in minhash_dedup.drop_near_duplicates(df).collect()) == 1
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("percent", "few"), [(85, 37), (80, 34)])
def test_near_duplicates_with_unlucky_sketches(spark, percent, few):
    """A pair at the threshold whose smallest 50 hashes share far less than the whole sets do."""
    pool = [f"u{i}" for i in range(1000)]
    order = np.argsort([int(minhash_dedup.shingle_sets([w.encode()], 1)[0][0]) for w in pool])
    pool = [pool[i] for i in order]
    shared, total = pool[:few], 10 * percent
    alone = pool[few : few + 2 * (48 - few)]
    rest = pool[few + len(alone) :]
    shared = shared + rest[: total - few]
    own = alone + rest[total - few :]
    texts = [" ".join(shared + own[i::2]) for i in (0, 1)]
    a, b = (plain_sets(t, 1) for t in texts)
    assert 100 * len(a & b) == percent * len(a | b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minhash_dedup.near_duplicates(df, 1, percent).collect()} == {0}


def test_rows_without_id_are_judged_by_their_text(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "tuv")
    near = t + " t60"
    rows = [(7, t), (None, near), (None, u), (None, u), (None, u.upper()), (None, "alone with more words"), (None, None), (None, ""), (3, v), (8, v + " v60"), (8, "another text of this id"), (8, "another text of this id"), (9, None), (9, None)]
    df = spark.createDataFrame([(i, x, "en", "s", None, "c", "r", "n") for i, x in rows], DOCS).repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect())
    assert got == {(7, 56, 7, True): 1, (None, 57, 7, False): 1, (None, 56, None, True): 3, (None, 1, None, True): 1, (None, 0, None, True): 2, (3, 56, 3, True): 1, (8, 57, 3, False): 1, (8, 1, 8, True): 2, (9, 0, 9, True): 2}
    left = minhash_dedup.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == {(7, t): 1, (None, u.upper()): 1, (None, "alone with more words"): 1, (None, None): 1, (None, ""): 1, (3, v): 1, (8, "another text of this id"): 1, (9, None): 1}


def test_patterned_words_do_not_collide():
    """Strings by the parity of the bits of their places are equal under any polynomial modulo a power of two."""
    parity = [bin(i).count("1") & 1 for i in range(4096)]
    a, b = bytes(97 + p for p in parity), bytes(98 - p for p in parity)
    sets = minhash_dedup.shingle_sets([a, b, a + b" x", b + b" x"], 1)
    assert sets[0][0] != sets[1][0] and len(np.intersect1d(sets[2], sets[3])) == 1 and sets[0][0] in sets[2]


def near_copies(spark, m):
    """Copies of one text with a word changed in each, and some texts that are near to a few of them only."""
    rng = np.random.default_rng(13)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(m):
        w = list(base)
        w[int(rng.integers(0, 150))] = f"x{i}"
        if i % 100 == 0:  # further off
            for at in range(0, 16, 8):
                w[at] = f"y{i}_{at}"
        texts.append((i, " ".join(w)))
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(4)


def test_a_large_group_costs_its_size(spark):
    """Rows dealt to pairs of blocks grow with a group of near copies, not with its square."""
    dealt = {}
    for m in (600, 1200):
        docs = near_copies(spark, m)
        base = minhash_dedup.sketches(docs, 3, 48, "doc_id", "text")
        classes = minhash_dedup.written(base.withColumns({"rep": F.monotonically_increasing_id(), "copies": F.lit(1)}), "classes")
        groups = minhash_dedup.written(minhash_dedup.meeting_groups(classes, 48, 85), "groups")
        met, known = minhash_dedup.stars(docs, groups, classes, 3, 85, 64, "doc_id", "text", 10**6)
        assert known.count() > 0 and met.count() == groups.count()
        rows = {x: block_pairs(y, ["pivot"], F.col("rep"), F.lit(1), 64, 64, star="star").count() for x, y in (("stars", met), ("none", met.withColumn("star", F.lit(-1))))}
        dealt[m] = rows["stars"] / groups.count(), rows["none"] / groups.count()
    assert dealt[1200][1] > 1.7 * dealt[600][1] and dealt[1200][0] < 1.3 * dealt[600][0] and dealt[1200][0] < 0.3 * dealt[1200][1]


def test_stars_lose_no_link(spark):
    docs = near_copies(spark, 300)
    sets = {r["doc_id"]: plain_sets(r["text"], 3) for r in docs.collect()}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, 3, 90, block_rows=32).collect()}
    assert got == smallest_reachable(sets, edges)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == smallest_reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- vectors

def vectors():
    rng = np.random.default_rng(2)
    data = []
    for g in range(60):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 8))):
            data.append((base + rng.standard_normal(16) * 0.12 * rng.random(), g % 4))
    data += [(data[0][0], 0)] * 5 + [(data[0][0] * 3, 0)]
    rows = [(i, [float(np.float32(x)) for x in v], None if i % 31 == 30 else lab) for i, (v, lab) in enumerate(data)]
    n = len(rows)
    return rows + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] + [1.0] * 15, 0), (n + 4, [float("inf")] * 16, 0), (n + 5, [1.0], 0), (n + 6, [], 0)]


def brute_links(rows):
    """Links among (id, vector, label) with usable vectors of equal label and dimension."""
    good = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v, _ in good}
    return [(a, b) for a, va, la in good for b, vb, lb in good if a < b and la == lb and len(va) == len(vb) and unit[a] @ unit[b] >= 0.98]


@pytest.mark.parametrize(("leaf", "cell_rows"), [(128, 8192), (8, 16)])
def test_vectors(spark, leaf, cell_rows):
    rows = vectors()
    edges = brute_links(rows)
    links = Counter(x for e in edges for x in e)
    expect = smallest_reachable([i for i, _, _ in rows], edges)
    df = spark.createDataFrame([(i, v, lab, "x", "y") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, rep string, size string").repartition(3)
    got = embedding_dedup.near_duplicate_vectors(df, leaf=leaf, cell_rows=cell_rows).collect()
    assert len(got) == len(rows) and len(edges) > 50
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: links[i] for i, _, _ in rows}
    assert {r["vec_id"]: r["component_id"] for r in got} == expect
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
    assert {r["n_links"] for r in embedding_dedup.near_duplicate_vectors(df.where("embedding is null")).collect()} == {0}


def test_vectors_of_any_dimension_and_label(spark):
    """Every dimension is compared, doubles stay doubles, huge and tiny components keep their direction, labels may be text."""
    rows = [(0, [1.0, 2.0], "a"), (1, [1.0, 2.001], "a"), (2, [2.0, 1.0], "a"), (3, [1.0, 2.0, 3.0], "a"), (4, [1.0, 2.0, 3.0], "a"), (5, [1.0, 2.0, 3.0], "b"), (6, [1e300, 5e300], "a"), (7, [1e300, 1e300], "a"), (8, [1e-310, 5e-310], "a"), (9, [1.0, 2.0, 3.0], None), (10, [1.0, 2.0, 3.0], ""), (11, [-1.0, -2.0], "a")]
    edges = brute_links(rows)
    links = Counter(x for e in edges for x in e)
    assert {(0, 1), (3, 4), (6, 8)} <= set(edges) and (6, 7) not in edges
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: links[i] for i, _, _ in rows}
    assert {r["vec_id"]: r["component_id"] for r in got} == smallest_reachable([i for i, _, _ in rows], edges)


def test_vectors_without_id_or_of_one_id(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (None, [1.0, 0.01], 1), (None, [1.0, 1.0], 1), (None, None, 1)]
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == {(5, 1, 5, True): 2, (7, 1, 5, False): 1, (None, 1, 5, False): 1, (None, 0, None, True): 2}


def hard_pairs(n, dim, seed):
    """Pairs with cosine 0.9805, just above the threshold."""
    rng = np.random.default_rng(seed)
    data = []
    for i, b in enumerate(rng.standard_normal((n, dim))):
        b /= np.linalg.norm(b)
        d = rng.standard_normal(dim)
        d -= (d @ b) * b
        d *= np.sqrt(1 - 0.9805**2) / np.linalg.norm(d)
        data += [(2 * i, b.astype(np.float32).tolist(), 1), (2 * i + 1, (0.9805 * b + d).astype(np.float32).tolist(), 1)]
    return data


@pytest.mark.parametrize(("n", "dim", "options", "least"), [(400, 64, {"leaf": 16}, 0.99), (3000, 64, {"leaf": 16, "cell_rows": 64}, 0.99), (3000, 8, {"leaf": 16, "cell_rows": 64}, 0.95)])
def test_recall_at_the_threshold(spark, n, dim, options, least):
    """Of trees within cells only, and of coarse trees with some seven levels of splits above them."""
    df = spark.createDataFrame(hard_pairs(n, dim, 8), "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicate_vectors(df, **options).collect()
    assert sum(r["n_links"] >= 1 for r in got) >= least * 2 * n


def test_a_dense_cluster_is_compared_in_blocks(spark):
    """No direction splits it, so trees must not send it both ways again and again."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    data = [(i, (base + rng.standard_normal(32) * 0.01).astype(np.float32).tolist(), 1) for i in range(700)]
    got = embedding_dedup.near_duplicate_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), leaf=8, cell_rows=64).collect()
    assert {r["n_links"] for r in got} == {699} and {r["component_id"] for r in got} == {0}


# ---- mixing

def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def mix_docs():
    rng = np.random.default_rng(4)
    data = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{int(rng.integers(0, 7))}" if i % 3 else "hot") for i in range(3000)]
    data += [(5000, None, "s1"), (5001, "", None), (5002, "\u00a0 x\ty", None), (5003, "word " * 20000, "s2"), (None, "a b", "s3"), (1, "b b", "s3"), (1, "b b", "s3")]
    return [(i, t, "en", s, None, "c", "r", "n") for i, t, s in data]


def test_mixing(spark):
    rows = mix_docs()
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    size = {t: len(WORD.findall(t or "")) for _, t, *_ in rows}
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size[r[1]]
    target = plain_targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 2 and r["copies"] in (int(r["target"] / r["source_size"]) if r["source_size"] else 0, (int(r["target"] / r["source_size"]) if r["source_size"] else 0) + 1)
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        longest = max(size[r[1]] for r in rows if r[3] == s)
        assert abs(taken[s] - target[s]) <= longest + 1
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    clashing = df.withColumns({"id": F.lit(1), "fingerprint": F.lit(1), "copies": F.lit(1)})
    out = mixing.mixed(clashing)
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert out.columns == clashing.columns
    for s in sizes:
        assert abs(words.get(s, 0) - target[s]) <= max(size[r[1]] for r in rows if r[3] == s) + 1
    assert mixing.mix(df.limit(0)).count() == 0
    assert sum(r["copies"] for r in mixing.mix(df.where("text is null")).collect()) == 0


def test_mixing_is_unbiased(spark):
    df = spark.createDataFrame([(i, "a b c", "", "x" if i < 60 else "y", None, "", "", "") for i in range(80)], DOCS)
    share = np.zeros(80)
    for seed in range(5):
        for r in mixing.mix(df, weights=(1, 1), share=0.7, seed=seed, block=8).collect():
            share[r["id"]] += r["copies"]
    assert abs(share[:60].mean() / 5 - 84 / 180) < 0.02 and 0.2 < share[:60].std() < 3


# ---- lines

def plain_lines(rows, n=10):
    docs = [(i if i is not None else 1 << 63, (t or "").split("\n")) for i, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, lines in docs:
        for x in lines:
            if len(key(x)) >= n:
                holders[key(x)].add(i)
    out = []
    for i, lines in docs:
        keep = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != i)]
        out.append((i if i != 1 << 63 else None, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


def test_lines(spark):
    rng = np.random.default_rng(6)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", " \t", "Äquivalent ßtraße", "the hot line of all"]
    rows = [(i, "\n".join([*rng.choice(pool, int(rng.integers(1, 12))), "the hot line of all" if i % 3 else f"own line {i} here"])) for i in range(1, 150)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\r\n  LINE NUMBER 3 OF THE POOL\x0b\n"), (204, "line number 3 of the pool\nline number 3 of the pool"), (None, "the hot line of all\nnull id own line"), (205, "äquivalent ßtraße"), (206, "x\n" * 5000)]
    rows += [rows[3]]
    df = spark.createDataFrame([(i, t, None, None, None, "", "", "") for i, t in rows], DOCS).repartition(4)
    for share in (0.001, 0.05, 1.0):  # all hot, some hot, none hot
        out = line_dedup.dedup_lines(df, hot_share=share).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("h"))
        assert Counter(map(tuple, out.collect())) == Counter(plain_lines(rows))
    clashing = df.withColumns({c: F.lit(1) for c in ("runs", "n_lines", "pos", "h1", "first")})
    assert line_dedup.dedup_lines(clashing).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).count() == len(rows)
    runs = line_dedup.dedup_lines(df).select("n_dropped", "drop_runs").collect()
    assert all(sum(x["len"] for x in r["drop_runs"]) == r["n_dropped"] for r in runs)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
