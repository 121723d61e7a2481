"""Token counts, packing, shards, media and languages against plain versions, with odd rows in every table."""

import hashlib
import zlib

import numpy as np
import pytest

pytest.importorskip("defectloom.llm")

from pyspark.sql import functions as F

from defectloom.llm import bpe, language_id, mpeg_audio, packing, sstable, token_counts
from defectloom.llm.queries import op10_language_id

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, id string"
LONG = "palabra larga " * 6000
TEXTS = [None, "", "one two three", "one two three", "  a b\n\nc  d ", "a\tb   c", "it's <|endoftext|> here", "日本語 テキスト。\n1,000.5 £", "\0x \0y", "!!!", LONG, "x" * 5000, "é́ ñ º 🙂"]


def rows(texts=TEXTS):
    return [(i if i != 5 else None, t, None if i % 3 else "en", "s" if i % 2 else None, None, "clash", "clash") for i, t in enumerate(texts)] + [(2, "one two three", "en", "s", 1, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_piece_encoder_equals_the_library(ids):
    e = bpe.PieceEncoder(bpe.default_tokenizer(), cache_entries=50)
    for _ in range(2):  # with an empty and with a used, often emptied cache
        got = e.encode_many([t or "" for t in TEXTS])
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == [ids(t) for t in TEXTS]


def test_token_counts(docs, spark, ids):
    lengths = [len(ids(r[1])) for r in rows()]
    report = token_counts.token_counts(docs).collect()
    assert {r["length"]: r["n_docs"] for r in report} == {n: lengths.count(n) for n in set(lengths)}
    for r in report:
        n = r["length"]
        assert r["total_docs"] == len(lengths) and r["total_tokens"] == sum(lengths)
        assert r["docs_ge"] == sum(x >= n for x in lengths) and r["tokens_ge"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert r["shorter_share"] == pytest.approx(sum(x < n for x in lengths) / len(lengths))
    df = token_counts.token_counts(docs)
    for limit in (0, 3, 4, 100, 10**6):
        assert token_counts.truncated_total(df, limit).first()["truncated_tokens"] == sum(min(x, limit) for x in lengths)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert token_counts.length_quantile(df, q).first()["length"] == sorted(lengths)[int(np.ceil(q * len(lengths))) - 1]
    empty = token_counts.token_counts(docs.limit(0))
    assert empty.count() == 0 and token_counts.length_quantile(empty, 0.5).first()["length"] is None


def test_suffix_sums_over_buckets(spark):
    h = spark.createDataFrame([(1, 2), (5, 1), (9, 4), (10, 1)], "length long, n_docs long")
    got = {r["length"]: (r["docs_ge"], r["tokens_ge"]) for r in token_counts.length_report(h, bucket=4).collect()}
    assert got == {1: (8, 53), 5: (6, 51), 9: (5, 46), 10: (1, 10)}


def check_pieces(pieces, docs_ids, size):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert sorted(map(str, by_doc)) == sorted({str(d) for d, _ in docs_ids})
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == size or at & (at - 1) == 0
    return by_doc


def test_packing(docs, ids):
    size = 2048
    expect = [(r[0], [*ids(r[1]), 1]) for r in rows()]
    got = packing.pack(docs, size=size).collect()
    by_doc = check_pieces(got, expect, size)
    assert sum(p["length"] for p in got) == sum(len(x) for _, x in expect)
    for doc, own in expect:
        if sum(d == doc for d, _ in expect) > 1:
            continue
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == zlib.crc32(np.array(own[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(own)
    assert packing.pack(docs.limit(0)).count() == 0


def test_sum_of_squares_places_by_the_rule():
    closed = []
    p = packing.SumOfSquares(10, closed.append)
    rng = np.random.default_rng(3)
    for i, n in enumerate(rng.integers(1, 10, 300)):
        before = p.count.copy()
        p.add(i, bytes(4 * int(n)), int(n))
        best = min(
            sum(c * c for c in after)
            for after in (
                [c + (h == level + n) - (h == level and level > 0) for h, c in enumerate(before) if 0 < h < 10]
                for level in range(0, 11 - n)
                if level == 0 or before[level]
            )
        )
        assert (p.count[1:10] ** 2).sum() == best
    p.close()
    sizes = [sum(len(x[2]) // 4 for x in w) for w in closed]
    assert sum(s != 10 for s in sizes) <= 3 and all(s == 10 or s & (s - 1) == 0 for s in sizes)


def test_token_tables(docs, spark, ids, tmp_path):
    folder = f"file://{tmp_path}/t"
    shards = sstable.write_tables(docs, folder)
    got = sstable.read_tables(spark, folder, shards).collect()
    expect = sorted(((r[0], r[1]) for r in rows()), key=lambda x: (x[0] is not None, x[0]))
    start = 0
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [d for d, _ in expect]
    for r, (_, text) in zip(sorted(got, key=lambda r: r["start"]), expect):
        own = np.array([*ids(text), 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own) // 4, zlib.crc32(own))
        start += len(own) // 4
    for doc in (None, 0, 2, 10, 12):
        mine = [np.array([*ids(t), 2], "<u4").tobytes() for d, t in expect if d == doc]
        assert sstable.lookup(folder, shards, doc) == mine
    assert sstable.lookup(folder, shards, 999) == [] and sstable.lookup(folder, shards, -1) == []
    assert sstable.token_tables(docs.limit(0)).count() == 0


def test_table_blocks_and_damage(tmp_path):
    import pyarrow.fs as pafs

    path = str(tmp_path / "a.sst")
    values = {sstable.key_of(i * 3): bytes(4 * (i % 50)) + b"\1\0\1\0" * (i % 2) for i in range(5000)}
    with open(path, "wb") as f:
        w = sstable.TableWriter(f)
        for k, v in values.items():
            w.add(k, v)
        w.close()
    fs = pafs.LocalFileSystem()
    r = sstable.TableReader(fs.open_input_file(path))
    assert len(r.blocks) > 3 and {k: sstable.unpack_ids(v) for k, v in r.scan()} == values
    assert all(r.get(k) == [values[k]] for k in list(values)[::97]) and r.get(sstable.key_of(1)) == []
    data = bytearray(open(path, "rb").read())
    data[100] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        list(sstable.TableReader(fs.open_input_file(path)).scan())


def test_carried_texts(docs):
    got = mpeg_audio.carried_texts(docs, keep_media=True).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert r["n_frames"] == len(r["offsets"]) and r["duration_us"] == r["n_frames"] * 24_000
    assert len({r["media_sha256"] for r in got if texts[r["doc_id"]] == "one two three"}) == 1
    assert mpeg_audio.carried_texts(docs.limit(0)).count() == 0


def test_texts_that_look_like_tags_and_frames(spark):
    head = mpeg_audio._frame(320, b"")[:4]
    signs = [b"TAG", b"ID3\3\0\x40", b"ID3\4\0\0\0\0\0\x10", head, head * 3, b"\xff\xfb\x90\x64", b"Xing", b"TAGTAG" * 20, b"\xff" * 40, b"3DI", b"APETAGEX", b"LYRICS200"]
    for size in (64, 128, 192, 320, 896, 960, 1024, 1856):
        for sign in signs:
            for at in range(max(0, size - 256), size - len(sign) + 1):
                payload = b"a" * at + sign + b"a" * (size - at - len(sign))
                assert mpeg_audio.decode_payload(mpeg_audio.encode_payload(payload)) == payload
    rng = np.random.default_rng(12)
    for _ in range(300):
        payload = bytes(rng.integers(0, 256, 64 * int(rng.integers(1, 60))).astype(np.uint8))
        assert mpeg_audio.decode_payload(mpeg_audio.encode_payload(payload)) == payload
    texts = ["xxTAG" + "a" * 100, *("b" * n + "TAG" + "a" * 300 for n in range(40)), "ID3" * 60, "TAG", "Xing" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in mpeg_audio.carried_texts(df).collect():
        raw = texts[r["doc_id"]].encode()
        assert r["payload_sha256"] == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()


def test_audio_parser(spark):
    payload = bytes(range(255)) * 40
    media = mpeg_audio.encode_payload(payload)
    found = mpeg_audio.parse(media)
    assert mpeg_audio.decode_payload(media) == payload
    assert found["table"] == "Xing" and found["table_frames"] == found["n_frames"] and found["crc_bad"] == 0 and found["tag_crc_ok"]
    a, b = found["offsets"][3:5]
    cut = media[:a] + b"junk" * 7 + media[a:]
    again = mpeg_audio.parse(cut)
    assert again["resyncs"] == 1 and again["skipped"] >= 28 and again["n_frames"] == found["n_frames"]
    bad = bytearray(media)
    bad[a + 10] ^= 1
    assert mpeg_audio.parse(bytes(bad))["crc_bad"] == 1
    with pytest.raises(ValueError):
        mpeg_audio.decode_payload(bytes(bad))
    tagged = media[:-128] + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95)
    assert mpeg_audio.parse(tagged)["tags"]["ID3v1:title"] == "Title"
    # MPEG-2 layer III at 24 kHz, one channel, no checksum; layer II at 48 kHz
    v2 = (bytes((0xFF, 0xF3, 8 << 4 | 1 << 2, 0xC0)) + bytes(188)) * 3
    f = mpeg_audio.parse(v2)
    assert (f["n_frames"], f["rate"], f["samples"], f["channels"], f["layer"]) == (3, 24000, 3 * 576, 1, 3)
    l2 = (bytes((0xFF, 0xFD, 8 << 4 | 1 << 2, 0)) + bytes(380)) * 2
    assert mpeg_audio.parse(l2)["samples"] == 2 * 1152
    for odd in (None, b"", b"\xff", b"ID3", b"\xff\xfb", bytes(500)):
        assert mpeg_audio.parse(odd)["n_frames"] == 0
    df = spark.createDataFrame([(1, media), (None, None), (2, b"")], "k long, m binary")
    assert {r["id"]: r["audio"]["n_frames"] for r in mpeg_audio.with_audio(df, "k", "m").collect()} == {1: found["n_frames"], None: 0, 2: 0}


def plain_crc(bits: str) -> int:
    crc = 0xFFFF
    for x in bits:
        top = crc >> 15 ^ int(x)
        crc = crc << 1 & 0xFFFF
        crc ^= 0x8005 if top else 0
    return crc


def test_checksums_of_layers_one_and_two():
    rng = np.random.default_rng(6)

    def bits_of(b: bytes) -> str:
        return "".join(f"{x:08b}" for x in b)

    # layer I at 32 kbit/s and 48 kHz, one channel: 16 bytes of allocations
    head, body = bytes((0xFF, 0xFE, 1 << 4 | 1 << 2, 0xC0)), bytes(rng.integers(0, 256, 26).astype(np.uint8))
    ok = head + plain_crc(bits_of(head[2:] + body[:16])).to_bytes(2, "big") + body
    assert len(ok) == 32 == mpeg_audio.Header.parse(ok, 0).size
    # layer II at 64 kbit/s and 48 kHz, one channel: 27 subbands, then two bits for each that is used
    head2, body2 = bytes((0xFF, 0xFC, 4 << 4 | 1 << 2, 0xC0)), bytes(rng.integers(0, 256, 186).astype(np.uint8))
    widths = [4] * 11 + [3] * 12 + [2] * 4
    stream, at, used = bits_of(body2), 0, 0
    for n in widths:
        used += "1" in stream[at : at + n]
        at += n
    ok2 = head2 + plain_crc(bits_of(head2[2:]) + stream[: at + 2 * used]).to_bytes(2, "big") + body2
    assert len(ok2) == 192 == mpeg_audio.Header.parse(ok2, 0).size
    for good, inside in ((ok, 10), (ok2, 12)):
        bad = good[:inside] + bytes((good[inside] ^ 0x10,)) + good[inside + 1 :]
        found = mpeg_audio.parse(good * 2 + bad + good)
        assert (found["n_frames"], found["crc_frames"], found["crc_bad"]) == (4, 4, 1)
    # one channel and two in one recording, each with its own side information
    frames = []
    for mode, side in ((0, 32), (0xC0, 17)):
        h, s = bytes((0xFF, 0xFA, 5 << 4 | 1 << 2, mode)), bytes(rng.integers(0, 256, side).astype(np.uint8))
        frames.append((h + plain_crc(bits_of(h[2:] + s)).to_bytes(2, "big") + s).ljust(3 * 64, b"\0"))
    assert mpeg_audio.parse(b"".join(frames) * 2)["crc_bad"] == 0


def plain_phrases(text: bytes, sample: bytes) -> int:
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_equal_a_plain_parse():
    samples = {"a": b"banana bandana cabana", "b": b"der die das und der hund"}
    m = language_id.Model(samples)
    texts = [b"banana", b"der hund und die banane", b"zzz", b"", b"q banana q", b"ab" * 40, b"aqa", b"abab", b"banana bandana cabana" * 3]
    for block in (4, 16, 1000):
        got = m.phrases(texts, block, warm_up=block // 2, lanes=3)
        assert got.tolist() == [[plain_phrases(t, samples[x]) for x in m.languages] for t in texts]


def test_phrases_of_random_texts():
    rng = np.random.default_rng(7)

    def string(letters, most):
        return bytes(rng.choice(list(letters), int(rng.integers(0, most))).astype(np.uint8))

    for _ in range(100):
        samples = {x: string(b"abc ", 60) + b"a" for x in "pqr"} | {"s": b"a" * 50}
        m = language_id.Model(samples)
        texts = [string(b"abcz ", 120) for _ in range(8)] + [samples["q"] * 4, b"a" * 130]
        expect = [[plain_phrases(t, samples[x]) for x in m.languages] for t in texts]
        assert m.phrases(texts, 8, 4, lanes=7).tolist() == m.phrases(texts).tolist() == expect


def test_samples_are_whole_documents_of_any_number_of_languages(spark):
    data = [(i, f"word{chr(97 + x) * 3} is said in {chr(97 + x) * 4}tongue often " * (1 + i % 5), f"l{x:02d}", None, None, "", "") for x in range(12) for i in range(x * 40, x * 40 + 40)]
    data += [(9000 + i, "giant document " * 3000, "zz", None, None, "", "") for i in range(3)]
    df = spark.createDataFrame(data, DOCS).repartition(4)
    models = language_id.train(df, "text", "lang", F.col("doc_id"), sample_bytes=1000, languages_at_once=5)
    assert [len(m.languages) for m in models] == [5, 5, 3]
    sizes = {x: 2**b for m in models for x, b in zip(m.languages, m.bits)}
    assert len(sizes) == 13 and all(700 < n < 2200 for n in sizes.values())
    one = language_id.identify(df, sample_bytes=1000)
    several = language_id.identify(df, sample_bytes=1000, languages_at_once=5)
    assert one.columns == several.columns
    parts = [sorted(map(tuple, df.select("doc_id", "held_out", "lang_pred", F.round("score", 9), F.round("bits", 9)).collect())) for df in (one, several)]
    assert parts[0] == parts[1]
    assert one.where("lang_pred = 'l03'").count() == 40


def test_language_edges(spark):
    text = {"en": "the cat and the dog are in the house with a man", "de": "der hund und die katze sind in dem haus mit einem mann"}
    data = [(i, text["en" if i % 2 else "de"], "en" if i % 2 else "de", None, None, "", "") for i in range(60)]
    data += [(100, None, "en", None, None, "", ""), (101, "", "en", None, None, "", ""), (102, "123 !?", "en", None, None, "", ""), (103, text["de"] * 2000, None, None, None, "", ""), (None, text["en"], None, None, None, "", "")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(data, DOCS)).collect()}
    assert len(got) == len(data)
    assert [got[k]["lang_pred"] for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"]
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got.values())
    tied = [(i, "same text", x, None, None, "", "") for i in range(8) for x in "bac"]
    assert {r["lang_pred"] for r in language_id.identify(spark.createDataFrame(tied, DOCS)).collect()} == {"a"}
    none = language_id.identify(spark.createDataFrame([(1, "abc", None, None, None, "", "")], DOCS)).first()
    assert none["lang_pred"] == "und" and none["score"] == 0
    assert language_id.identify(spark.createDataFrame([], DOCS)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in op10_language_id(spark, sf).collect() if r["held_out"]]
    assert held and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)


def test_an_emptied_cache_learns_only_what_is_lacking():
    from defectloom.llm import bpe

    e = bpe.PieceEncoder(bpe.default_tokenizer(), 6)
    learnt, learn = [], e._learn
    e._learn = lambda new: (learnt.append(set(new)), learn(new))
    first = e.encode_many(["one two three four"])
    again = e.encode_many(["one two three four five six seven"])  # too many: the cache is emptied, known ids stay in hand
    assert learnt[1] == {"five", "six", "seven"}
    plain = bpe.PieceEncoder(bpe.default_tokenizer())
    assert first + again == plain.encode_many(["one two three four", "one two three four five six seven"])
