"""URL rules by cascades of Bloom filters.

A cascade holds a set of listed keys exactly, for every key of a known
universe: its first filter encodes the listed keys, its second the keys of the
universe that the first takes for listed by mistake, its third the listed keys
that the second takes for mistakes, and so on until no mistake is left. A key
is listed if the first filter that does not know it is an even one (counted
from one). Serving needs the filters only, no join.

The universe is every key that any url of the corpus asks about: each of its
host's suffixes with each path prefix as long as some rule's path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectloom.llm.common import ascii_lower, checkpointed, numbered, written

#: Seeds of the two hashes from which a level's bit places are made.
_SEEDS = (11, 23)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def candidate_keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every key (host suffix followed by path prefix) that could be a rule for the url, once each."""
    fitting = F.filter(F.lit(list(lengths)).cast("array<int>"), lambda n: n <= F.char_length(path))
    prefixes = F.transform(fitting, lambda n: F.substr(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))


def key_hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(_SEEDS[0]), key).alias("a"), F.xxhash64(F.lit(_SEEDS[1]), key).alias("b"))


class Level:
    """One Bloom filter; its size follows from the number of keys and the wanted share of mistakes."""

    def __init__(self, number: int, keys: int, mistakes: float):
        self.number = number
        self.hashes = max(1, round(-np.log2(mistakes)))
        self.bits = max(64, int(np.ceil(keys * self.hashes / np.log(2))) + 63 & ~63)
        self.words = np.zeros(self.bits // 64, dtype=np.uint64)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bit places, one row per key; every level has its own."""
        a, b = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64) | np.uint64(1)
        i = np.arange(self.hashes, dtype=np.uint64) + np.uint64(1 + 64 * self.number)
        x = a[:, None] + i * b[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return x % np.uint64(self.bits)

    def add(self, places: np.ndarray) -> None:
        np.bitwise_or.at(self.words, (places >> np.uint64(6)).ravel(), np.uint64(1) << (places & np.uint64(63)).ravel())

    def knows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p = self.places(a, b)
        return ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    """The levels; ``listed`` answers for many keys at once."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @property
    def nbytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        ask = np.arange(len(a))
        for k, level in enumerate(self.levels):
            known = level.knows(a[ask], b[ask])
            out[ask[~known]] = k % 2 == 1
            ask = ask[known]
        out[ask] = len(self.levels) % 2 == 1
        return out


def _known(keys: DataFrame, level: Level) -> DataFrame:
    """The keys (a, b) that a level knows; the filter goes to the executors as a broadcast of checked size."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            if len(a):
                yield batch.filter(pa.array(shared.value.knows(a, b)))

    return keys.select("a", "b").mapInArrow(run, "a long, b long")


def _filled(keys: DataFrame, n: int, number: int, mistakes: float) -> Level:
    """A level with all the keys: tasks make filter words, which are joined by OR before they reach the driver."""
    level = Level(number, n, mistakes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Level(number, n, mistakes)
        for batch in batches:
            if batch.num_rows:
                own.add(own.places(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        at = own.words.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.words[at].view(np.int64))], ["at", "word"])

    words = keys.select("a", "b").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    level.words[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return level


def first_rate(listed: int, universe: int) -> float:
    """The first level's share of mistakes that makes a cascade smallest: the second level then holds about as many keys as the first ones that it halves."""
    return min(0.5, max(1, listed) * 0.5**0.5 / max(1, universe - listed))


def cascade_bits(listed: int, universe: int) -> float:
    """What a cascade takes: for each listed key the first level's hashes, and three and a half bits in all later levels."""
    return listed * (max(1, round(-np.log2(first_rate(listed, universe)))) / np.log(2) + 3.5)


def build_cascade(universe: DataFrame, listed: DataFrame, first_mistakes: float | None = None, later_mistakes: float = 0.5, max_bytes: int = 256 << 20) -> Cascade:
    """A cascade for distinct keys, given as rows (a, b) of :func:`key_hashes`; ``listed`` is a part of ``universe``.

    The first level's share of mistakes follows from both sizes unless it is
    given (:func:`first_rate`), so that the second level holds fewer keys than
    the first, however large the universe is; later levels halve their input.
    The size is that of :func:`cascade_bits`, by which :func:`parts_for` parts
    the keys; the whole goes to the driver and every executor. No listed keys
    give no levels, and no key is then listed.
    """
    levels: list[Level] = []
    inside, outside = listed.select("a", "b"), None
    n, total, stuck = inside.count(), 0, 0
    mistakes = first_mistakes or (first_rate(n, universe.count()) if n else 0.5)
    while n:
        total += Level(len(levels), n, mistakes).words.nbytes
        if total > max_bytes:
            raise RuntimeError(f"the cascade needs more than {max_bytes} bytes, which parts_for rules out")
        level = _filled(inside, n, len(levels), mistakes)
        levels.append(level)
        against = universe.join(listed, ["a", "b"], "left_anti") if outside is None else outside
        wrong = checkpointed(_known(against, level))
        inside, outside, before, n, mistakes = wrong, inside, n, wrong.count(), later_mistakes
        stuck = stuck + 1 if n >= before else 0
        if stuck > 64:
            raise RuntimeError("two keys share both hashes")  # a chance of 2 ** -128 for each pair
    return Cascade(levels)


def parts_for(listed: int, universe: int, max_bytes: int) -> int:
    """Cascades that so many listed keys take in so large a universe, with a quarter of their size and 128 bytes (small levels are rounded up) to spare."""
    return max(1, int(-(-1.25 * cascade_bits(listed, universe) // (8 * max(64, max_bytes - 128)))))


def judge_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], url: str = "url", max_bytes: int = 256 << 20) -> DataFrame:
    """``pages`` with host, path, rule and verdict added (columns of these names are replaced).

    ``rules`` are rows (action, host, path) with the action ``allow`` or
    ``block``. A rule fits its host and all subdomains where the url's path
    starts with the rule's. The longest fitting key (host and path together)
    wins, of equally long ones the one with the longer host; a key both allowed
    and blocked is blocked. A url that no rule fits is in neither cascade and is
    allowed. Null urls and urls without ``://`` have empty host and path and fit
    no rule. Repeated rows keep their rows; an empty table gives none; other
    columns may have any names.

    A task holds cascades of at most ``max_bytes`` (1 KB at least). A listed key
    takes some 1.44 * log2(universe / listed) + 4 bits, 40 to 60 of them in the
    largest universes; longer lists are parted by the hash of the key into
    several pairs of cascades, which are asked one after another; answers
    between them are stored in the shared folder.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "action string, host string, path string")
    listed = rules.select("action", F.concat("host", "path").alias("key"), F.char_length("path").alias("n"))
    lengths = sorted((r[0] for r in listed.select("n").distinct().collect()), reverse=True)  # at most as many as a path has characters
    pages = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages.withColumnRenamed(url, "url").drop("host", "path", "rule", "verdict")
    names = pages.columns
    pages, (url,) = numbered(pages, url if url in names else "url")
    seen = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if not lengths:
        return seen.select(*pages.columns, "host", "path", F.lit(None).cast("string"), F.lit("allow")).toDF(*names, "host", "path", "rule", "verdict")
    keys = seen.select("host", "path").distinct().select(F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    universe = checkpointed(keys.select("key", key_hashes(F.col("key")).alias("h")).select("key", "h.a", "h.b"))
    mine = {x: checkpointed(listed.where(F.col("action") == x).select("key").distinct().join(universe, "key").select("a", "b")) for x in ("block", "allow")}
    asked_for = universe.count()
    parts = max(parts_for(x.count(), asked_for, max_bytes // 2) for x in mine.values())
    asked = seen.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    asked = asked.withColumn("_hashes", F.transform("_keys", key_hashes)).withColumn("_said", F.transform("_keys", lambda k: F.lit(0)))
    for i in range(parts):
        def part(x: DataFrame) -> DataFrame:
            return x.select("a", "b") if parts == 1 else x.select("a", "b").where(F.pmod("a", F.lit(parts)) == i)  # noqa: B023

        cascades = [build_cascade(part(universe), part(mine[x]), max_bytes=max_bytes // 2) for x in ("block", "allow")]
        asked = asked.withColumn("_said", _answers(spark, cascades, parts, i)("_hashes.a", "_hashes.b", "_said"))
        if i < parts - 1:
            asked = written(asked, "urls")
    # candidates come with longer hosts and prefixes first, so of equally long ones the earliest wins
    fits = F.filter(
        F.transform("_keys", lambda k, i: F.struct(F.char_length(k).alias("n"), (-i).alias("i"), k.alias("key"), F.get("_said", i).alias("said"))),
        lambda c: c["said"] != 0,
    )
    best = asked.withColumn("_best", F.array_max(fits))
    verdict = F.when(F.col("_best.said") == 1, "block").otherwise("allow")
    return best.select(*pages.columns, "host", "path", F.col("_best.key"), verdict).toDF(*names, "host", "path", "rule", "verdict")


def _answers(spark: SparkSession, cascades: list[Cascade], parts: int, part: int):
    """A function of the candidates' hashes and answers so far: 1 blocked, 2 allowed, 0 neither; only keys of this part are asked about."""
    shared = spark.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<int>")
    def said(first: pd.Series, second: pd.Series, before: pd.Series) -> pd.Series:
        if not first.map(len).sum():
            return pd.Series([[]] * len(first), dtype=object)
        a, b = np.concatenate(first.tolist()).astype(np.int64), np.concatenate(second.tolist()).astype(np.int64)
        out = np.concatenate(before.tolist()).astype(np.int32)
        mine = np.flatnonzero(a % parts == part)
        block, allow = shared.value
        out[mine[allow.listed(a[mine], b[mine])]] = 2
        out[mine[block.listed(a[mine], b[mine])]] = 1
        return pd.Series(np.split(out, np.cumsum(first.map(len))[:-1]), index=first.index)

    return said.asNondeterministic()  # it stands for a column: a filter on the verdict must not carry it into a lambda
