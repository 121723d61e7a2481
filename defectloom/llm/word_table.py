"""BPE ids by a table of distinct words, and text from ids by a table of pieces.

Byte-level BPE never merges across words, and Spark can split a text into the
words of the tokenizer: its pattern is put into the terms of the JVM's regular
expressions, with the library's own letters and digits. All occurrences are
counted, and every distinct word is encoded once. The ids then go back to
where the words stand:

* frequent words, as many as a stated bound allows, are a broadcast table,
  looked up once for each distinct word of a batch; if that is every word but
  those that stand at one place in all texts, these are encoded in that place;
* otherwise the others leave holes in their texts. Holes meet the rest of the table in a
  join by word, return to their texts in a join by the text's hash, and are
  filled by position. Texts that are equal have their holes looked up once.

Decoding joins ids to the vocabulary's pieces, a broadcast table of as many
rows as the vocabulary has, and joins the pieces in order.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectloom.llm import bpe
from defectloom.llm.common import written

#: Texts that are looked up at once; an Arrow batch has more.
_PART = 256
#: Code points from here on are letters or digits in no version of Unicode.
_LAST_LETTER = 0x40000


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def letters_and_digits(path: str) -> tuple[str, str]:
    """All characters that the library takes for letters, and for digits: those that do not end a word of their kind."""
    pre, found = _library(path).pre_tokenizer, []
    points = [c for c in range(_LAST_LETTER) if not 0xD800 <= c < 0xE000 and c not in (10, 39)]
    for around in "a1":
        inside: list[str] = []
        for at in range(0, len(points), 1 << 15):
            text = "".join(f"{around}{chr(c)}{around}\n" for c in points[at : at + (1 << 15)])
            inside += [text[i + 1] for _, (i, j) in pre.pre_tokenize_str(text) if j - i == 3]
        found.append("".join(inside))
    return found[0], found[1]


def _ranges(chars: str) -> str:
    """Characters as ranges of a pattern's class."""
    out, points = [], sorted(map(ord, chars))
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out)


def word_pattern(spark: SparkSession, path: str) -> str:
    """The words of the vocabulary's pre-tokenizer, for the JVM: every text is its matches in a row.

    The JVM's letters and digits may be of another version of Unicode; what
    they lack, or have too many, is put right. Added tokens are words, and end
    a text for the words before them, as the library splits there first.
    """
    library, java = _library(path), spark.sparkContext._jvm.java.util.regex.Pattern
    kind = type(library.pre_tokenizer).__name__
    if kind != "ByteLevel" or library.normalizer is not None or not library.pre_tokenizer.use_regex or library.pre_tokenizer.add_prefix_space:
        raise ValueError("this operator takes byte-level vocabularies that split by pattern, without normalizer and prefix space")
    added = list(library.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        raise ValueError("added tokens that take white space or stand as single words are not supported")
    classes, both = [], ""
    for name, chars in zip("LN", letters_and_digits(path)):
        lacking = java.compile(rf"\p{{{name}}}").matcher(chars).replaceAll("")
        held = set(chars)
        others = "".join(chr(c) for c in range(_LAST_LETTER) if not 0xD800 <= c < 0xE000 and chr(c) not in held)
        if java.compile(rf"\P{{{name}}}").matcher(others).replaceAll(""):
            raise ValueError(f"the JVM has characters of class {name} that the tokenizer has not")
        classes.append((rf"\p{{{name}}}", lacking))
        both += lacking
    low = rf"\x{{0}}-\x{{{min(map(ord, both)) - 1:x}}}" if both else ""
    # a class of its own for what is lacking, asked only beyond the first of it: most characters are below
    letter, digit = (f"[{p}[[^{low}]&&[{_ranges(x)}]]]" if x else f"[{p}]" for p, x in classes)
    mark = rf"[\P{{IsWhite_Space}}&&\P{{L}}&&\P{{N}}&&[[{low}][^{_ranges(both)}]]]" if both else r"[\P{IsWhite_Space}&&\P{L}&&\P{N}]"
    tokens = "|".join(f"\\Q{t.content}\\E" for t in sorted(added, key=lambda t: -len(t.content)))
    space = r"\p{IsWhite_Space}"
    ended, marks = (f"(?:(?={space}|\\z)|(?={tokens}))", f"(?:(?!{tokens}){mark})++") if tokens else (f"(?={space}|\\z)", f"{mark}++")
    parts = [tokens] if tokens else []
    parts += ["'s|'t|'re|'ve|'m|'ll|'d", f" ?{letter}++", f" ?{digit}++", f" ?{marks}", f"{space}+{ended}", f"{space}+"]
    return "|".join(parts)


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def distinct_words(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows (word, n): every distinct word of all texts and how often it stands there; counts are added up before they are shuffled."""
    return docs.select(F.explode(words_of(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class WordEncoder:
    """Ids of single words; a word that is an added token has that token's id."""

    def __init__(self, path: str):
        library = _library(path)
        self._tokenize, self._letters = library.model.tokenize, bpe._byte_letters()
        self._added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}

    def __call__(self, word: str) -> list[int]:
        if word in self._added:
            return [self._added[word]]
        return [t.id for t in self._tokenize(word.encode().decode("latin-1").translate(self._letters))]


@lru_cache(maxsize=4)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """Rows (word, n, ids): each word's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            ids = [pack(f"<{len(own)}I", *own) for own in map(encode, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    return words.mapInArrow(run, "word string, n long, ids binary")


class Frequent:
    """Words with their ids in flat arrays, some forty bytes a word, for looking up in batches."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words = words
        hashes = np.concatenate([self.hash(words.slice(at, 1 << 16)) for at in range(0, len(words), 1 << 16)] or [np.zeros(0, dtype=np.uint64)])
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]
        # the last number, of words that are not held, has no ids
        self.start = np.concatenate(([0], np.cumsum(pc.binary_length(ids).to_numpy() // 4, dtype=np.int64))).astype(np.int32)
        self.start = np.append(self.start, self.start[-1])
        data = ids.buffers()[2] if len(ids) else None
        ids = np.frombuffer(data, dtype="<i4", count=int(self.start[-1])) if data else np.zeros(0, dtype="<i4")
        self.ids = ids.astype(np.uint16) if not len(ids) or ids.max() < 65_536 else ids

    @staticmethod
    def hash(words: pa.Array) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Each word's number, -1 for words that are not held; of words with one hash each is compared."""
        out = np.full(len(words), -1, dtype=np.int64)
        if not len(self.hashes) or not len(words):
            return out
        hashes = self.hash(words)
        at, ask = np.searchsorted(self.hashes, hashes), np.arange(len(words))
        while True:
            open_ = at < len(self.hashes)
            at, ask = at[open_], ask[open_]
            same = self.hashes[at] == hashes[ask]
            at, ask = at[same], ask[same]
            if not len(ask):
                return out
            equal = pc.equal(self.words.take(pa.array(self.order[at])), words.take(pa.array(ask))).to_numpy(zero_copy_only=False)
            out[ask[equal]] = self.order[at[equal]]
            at, ask = at[~equal] + 1, ask[~equal]

    def look_up(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(ids of all rows, where each row's ids begin and the last ones end, each hole's row, its place among the row's ids, its word)."""
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        code = self.numbers(coded.dictionary)[at] if len(at) else np.zeros(0, dtype=np.int64)
        placed = np.where(code < 0, len(self.start) - 2, code)
        length = self.start[placed + 1] - self.start[placed]
        before = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
        ids = self.ids[np.repeat(self.start[placed] - before[:-1], length) + np.arange(before[-1])].astype(np.int32)
        begins = before[ends]
        holes = np.flatnonzero(code < 0)
        row = np.searchsorted(ends, holes, side="right") - 1
        return ids, begins, row, before[holes] - begins[row], coded.dictionary.take(pa.array(at[holes]))


def _in_place(ids: np.ndarray, begins: np.ndarray, row: np.ndarray, at: np.ndarray, words: pa.Array, encode: WordEncoder) -> tuple[np.ndarray, np.ndarray]:
    """The ids with holes filled by encoding their words here, and where each row's begin."""
    if not len(row):
        return ids, begins
    own = [encode(w) for w in words.to_pylist()]
    length = np.array([len(x) for x in own])
    ids = np.insert(ids, np.repeat(begins[row] + at, length), np.concatenate(own).astype(np.int32))
    return ids, begins + np.concatenate(([0], np.cumsum(np.bincount(row, length, len(begins) - 1).astype(np.int64))))


def frequent_words(table: DataFrame, most_words: int, most_bytes: int, longest: int = 64) -> tuple[DataFrame, DataFrame]:
    """(the most frequent words, the others): the first within both bounds, by whole steps of an eighth of a power of two in count.

    Words of over ``longest`` bytes are never among the first.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    short = F.octet_length("word") <= longest
    sizes = table.where(short).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word") + F.octet_length("ids")).alias("bytes"))
    least, words, size = 1 << 30, 0, 0
    for r in sizes.orderBy(F.col("step").desc()).collect():  # at most 8 rows for each power of two
        words, size = words + r["words"], size + r["bytes"]
        if words > most_words or size > most_bytes:
            break
        least = r["step"]
    return table.where(short & (step >= least)), table.where(~short | (step < least))


def _broadcast(frequent: DataFrame) -> Broadcast:
    found = frequent.select("word", "ids").toArrow()  # within the bounds of frequent_words
    words, ids = (pa.concat_arrays(found.column(c).chunks) if found.num_rows else pa.array([], t) for c, t in (("word", pa.string()), ("ids", pa.binary())))
    del found
    return frequent.sparkSession.sparkContext.broadcast(Frequent(words, ids))


def _packed(ids: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(ids.astype("<u4").tobytes(), asbytes=True) if ids.size else b""


#: What a pass over the texts gives: the ids (and what they decode to), where holes are words that stand nowhere else; the words of holes, of rows that have any; ids with holes.
_SAID = {"ids": "ids array<int>", "text": "ids array<int>, text string", "holes": "words array<string>", "open": "size long, packed binary, at array<long>"}


def _looked_up(docs: DataFrame, keys: list[str], shared: Broadcast, path: str, said: str, table: Broadcast | None = None) -> DataFrame:
    """Rows of ``docs`` (keys, the words of a text) with the columns of ``_SAID[said]`` in place of the words."""
    k = len(keys)
    names = [*keys, *(c.split()[0] for c in _SAID[said].split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _PART):
                part = batch.slice(first, _PART)
                ids, begins, row, at, words = shared.value.look_up(part.column(k))
                if said in ("ids", "text"):
                    ids, begins = _in_place(ids, begins, row, at, words, _encoder(path))
                    lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))
                    texts = [pa.array(_decoded(lists, table.value), pa.string())] if said == "text" else []
                    yield pa.RecordBatch.from_arrays([*part.columns[:k], lists, *texts], names)
                    continue
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                offsets = pa.array(cuts, pa.int32())
                if said == "holes":
                    out = [*part.columns[:k], pa.ListArray.from_arrays(offsets, words)]
                    yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(cuts[1:] > cuts[:-1]))
                    continue
                packed = [_packed(ids[a:b]) for a, b in zip(begins, begins[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(np.diff(begins)), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int64()))], names)
            batch = part = words = None  # the next batch is read when this one is let go

    return docs.mapInArrow(run, ", ".join([f"{c} {t}" for c, t in docs.dtypes[:k]] + [_SAID[said]]))


def _filled(batches: Iterator[pa.RecordBatch], table: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, size, packed, at, found) as (id, ids), and what the ids decode to where there is a table of pieces."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            part = batch.slice(first, 1024)
            rows: list[np.ndarray] = []
            for size, packed, at, found in zip(*(part.column(i).to_pylist() for i in range(1, 5))):
                ids = np.frombuffer(codec.decompress(packed, 4 * size, asbytes=True), dtype="<u4") if size else np.zeros(0, dtype="<u4")
                if at:
                    own = [np.frombuffer(x, dtype="<u4") for x in found]
                    ids = np.insert(ids, np.repeat(at, [len(x) for x in own]), np.concatenate(own))
                rows.append(ids)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
            flat = np.concatenate(rows).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            texts = [pa.array(_decoded(lists, table.value), pa.string())] if table else []
            yield pa.RecordBatch.from_arrays([part.column(0), lists, *texts], ["doc_id", "ids", "text"][: 2 + len(texts)])


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text: str = "text", frequent: int = 2_000_000, frequent_bytes: int = 48 << 20, salts: int = 32, hot_share: float = 0.001, decoded: bool = False) -> DataFrame:
    """Rows (doc_id, ids): the ids of every whole text as the tokenizers library gives them, without tokens of its own; with ``decoded`` the text that :func:`decode` makes of them as well, in the same pass.

    A null or empty text has no ids. An added token that stands in a text
    becomes its id, as in the library. Every row counts, null ids (and what is
    no integer, which reads as null) and repeated rows too; other columns are
    not looked at; an empty table gives no rows.

    The broadcast table holds at most ``frequent`` words and ``frequent_bytes``
    bytes. Where that is all words that stand at two places or more, a word that
    it lacks stands at one, where it is encoded, and no text is shuffled. Else
    all others go by joins; texts that are more than ``hot_share`` of all rows, of which
    there are at most ``1 / hot_share``, meet their holes in ``salts`` parts. A
    row's words must fit a task's memory.
    """
    spark, path = docs.sparkSession, tokenizer or bpe.default_tokenizer()
    pattern = word_pattern(spark, path)
    x = docs.select(F.col(id_col).try_cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    counts = written(distinct_words(x, "t", pattern), "words")
    often, rare = frequent_words(written(encoded_words(counts.where("n > 1"), path), "repeated-words"), frequent, frequent_bytes)
    shared, words = _broadcast(often), words_of(F.col("t"), pattern).alias("w")
    table = _broadcast_pieces(spark, path) if decoded else None
    if rare.isEmpty():
        return _looked_up(x.select(F.col("id").alias("doc_id"), words), ["doc_id"], shared, path, "text" if decoded else "ids", table)
    rare = rare.unionByName(encoded_words(counts.where("n = 1"), path))
    key = [F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2")]

    holes = _looked_up(x.select(*key, words), ["h1", "h2"], shared, path, "holes")
    texts = holes.groupBy("h1", "h2").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))  # equal texts have equal holes
    asked = texts.select("h1", "h2", "copies", F.posexplode("words").alias("k", "word"))
    said = asked.join(rare.select("word", "ids"), "word").groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("f"), F.first("copies").alias("copies"))
    fillings = written(said.select("h1", "h2", "copies", F.transform("f", lambda s: s["ids"]).alias("found")), "fillings")

    least = hot_share * docs.count()
    hot = fillings.where(F.col("copies") > least).select("h1", "h2", F.lit(True).alias("hot"))  # at most 1 / hot_share rows
    spread = F.explode(F.when(F.col("copies") > least, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    open_ = _looked_up(x.select("id", *key, words), ["id", "h1", "h2"], shared, path, "open")
    dealt = open_.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", F.when(F.col("hot"), (F.rand(5) * salts).cast("int")).otherwise(0))
    whole = dealt.join(fillings.select("h1", "h2", spread, "found"), ["h1", "h2", "salt"], "left")
    return whole.select("id", "size", "packed", "at", "found").mapInArrow(lambda batches: _filled(batches, table), "doc_id long, ids array<int>" + (", text string" if decoded else ""))


def pieces(path: str) -> list[bytes]:
    """Every id's bytes, by id; ids that the vocabulary lacks have none."""
    vocabulary = _library(path).get_vocab(with_added_tokens=True)
    byte_of = {c: b for b, c in bpe._byte_letters().items()}
    out = [b""] * (1 + max(vocabulary.values(), default=-1))
    for piece, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return out


def _decoded(lists: pa.ListArray, table: pa.BinaryArray) -> list[str]:
    """Each row's ids joined to their pieces, in order, as text."""
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = lists.flatten()
    if not len(flat):
        return [""] * len(lists)
    known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    found = table.take(pc.if_else(known, flat, None)).fill_null(b"")
    cuts = np.frombuffer(found.buffers()[1], dtype=np.int32)[found.offset : found.offset + len(found) + 1]
    data = memoryview(found.buffers()[2] or b"")
    return [str(data[cuts[a] : cuts[b]], "utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _broadcast_pieces(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(pa.array(pieces(path), pa.binary()))


def decode(rows: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (doc_id, text): the text of every row's ids as the library decodes them, added tokens included.

    Bytes that are no UTF-8 become U+FFFD. Ids that the vocabulary lacks, null
    ones and a null array have no text, so that such a row is empty; every row
    counts.
    """
    shared = _broadcast_pieces(rows.sparkSession, tokenizer or bpe.default_tokenizer())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _PART):
                part = batch.slice(first, _PART)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_decoded(part.column(1), shared.value), pa.string())], ["doc_id", "text"])
            batch = part = None

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {dict(rows.dtypes)[id_col]}, text string")
