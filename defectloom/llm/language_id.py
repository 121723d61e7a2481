"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a sample of its labelled text. A
text is parsed against it from left to right: each phrase is the longest string
from the current place that occurs in the sample, or one byte where none does.
With c phrases in a text of m bytes and a sample of n bytes, ``c * log2(n) / m``
estimates the cross entropy in bits a byte; the language with the fewest such
normalised phrases wins, of equal ones the first name by code point.

Texts are compared as UTF-8 in lower case with each run of white space, ASCII
digits and marks as one space. A parse is a walk through states, so long texts
are parsed in blocks side by side: a block starts from the state that a short
run over the bytes before it gives, and wherever that is not the state in which
the block before ends, it is walked again from there. Phrases run over the ends
of blocks and counts are those of one walk over the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.llm.blocks import slices_of_bytes
from defectloom.llm.common import written

_FOLD = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_LOW = (1 << 32) - 1


def folded(text: str) -> bytes:
    """What is parsed: lower case, each run of other ASCII characters one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of ``codes``; state 1 is the root, state 0 unused.

    Has at most ``2 * len(codes)`` states and ``3 * len(codes)`` transitions.
    """
    nexts: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def interleaved(nexts: list[dict[int, int]], width: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """The automaton as one sparse array and the root's transitions.

    A state is the place in the array from which its transitions lie at their
    codes' distances, interleaved with those of other states; each entry holds
    its owner in the upper half and the next state in the lower half. Places
    begin at ``offset``. The root, and a state without transitions, is 0 and
    owns no entry; root[c] is the state after c, 0 where there is none.
    """
    place = [0] * len(nexts)
    taken, used = bytearray(4 * sum(map(len, nexts)) + 2 * width + 2), set()
    at = 0
    for s in sorted(range(2, len(nexts)), key=lambda s: (-len(nexts[s]), s)):
        codes, tries = list(nexts[s]), 0
        if not codes:
            continue
        first = min(codes)
        b = max(0, at - first)
        while b in used or any(taken[b + c] for c in codes):
            b, tries = b + 1, tries + 1
        if tries > 64:  # what is left free here is too little to search again
            at = b + first - 32
        while taken[at]:
            at += 1
        place[s] = b
        used.add(b)
        for c in codes:
            taken[b + c] = 1
    # place 0 of the whole array would be the root's
    base = [p + offset if nexts[s] and s > 1 else 0 for s, p in enumerate(place)]
    entries = np.full(max(used, default=0) + width + 1, -1 << 32, dtype=np.int64)
    for s in range(2, len(nexts)):
        for c, t in nexts[s].items():
            entries[place[s] + c] = base[s] << 32 | base[t]
    root = np.zeros(width, dtype=np.int64)
    for c, t in nexts[1].items():
        root[c] = base[t]
    return entries, root


class Model:
    """Automata of all languages in one sparse array; code 0 is a byte that no sample has."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        used = sorted(set(b"".join(samples.values())))
        codes = np.zeros(256, dtype=np.int64)
        codes[used] = np.arange(1, len(used) + 1)
        self.codes, width = codes, len(used) + 1
        offset, parts, roots = 1, [np.full(1, -1 << 32, dtype=np.int64)], []
        for x in self.languages:
            entries, root = interleaved(suffix_automaton(codes[np.frombuffer(samples[x], dtype=np.uint8)].tolist()), width, offset)
            parts.append(entries)
            roots.append(root)
            offset += len(entries)
        self.entries = np.concatenate([*parts, np.full(width, -1 << 32, dtype=np.int64)])
        self.roots = np.array(roots) if roots else np.zeros((0, width), dtype=np.int64)
        self.bits = [float(np.log2(max(2, len(samples[x])))) for x in self.languages]

    @property
    def nbytes(self) -> int:
        return self.entries.nbytes + self.roots.nbytes

    def phrases(self, texts: list[bytes], block: int = 1024, warm_up: int = 64, lanes: int = 4096) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns); ``block`` and ``warm_up`` set the work, not the result."""
        k = len(self.languages)
        counts = np.zeros((len(texts), k), dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        blocks = -(-sizes // block)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not k or not len(owner):
            return counts
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        data = self.codes[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        start = (np.cumsum(sizes) - sizes)[owner] + nth * block
        size = np.minimum(block, sizes[owner] - nth * block)
        later = np.flatnonzero(nth > 0)
        first = np.zeros((k, len(owner)), dtype=np.int64)
        warm_up = min(warm_up, block)
        first[:, later] = self._walk(data, start[later] - warm_up, np.full(len(later), warm_up), first[:, later], lanes)[1]
        found, last = self._walk(data, start, size, first, lanes)
        wrong = later
        while len(wrong):
            wrong = wrong[(first[:, wrong] != last[:, wrong - 1]).any(axis=0)]
            if not len(wrong):
                break
            first[:, wrong] = last[:, wrong - 1]
            found[:, wrong], last[:, wrong] = self._walk(data, start[wrong], size[wrong], first[:, wrong], lanes)
            after = wrong + 1
            wrong = after[after < len(nth)]
            wrong = wrong[nth[wrong] > 0]
        np.add.at(counts, owner, found.T)
        return counts

    def _walk(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each lane and the states at the lanes' ends; lanes take a step at a time, long ones first."""
        found, last = np.zeros_like(state), np.empty_like(state)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), lanes):
            lane = order[at : at + lanes]
            begin, s, n = start[lane], state[:, lane], np.zeros((len(state), len(lane)), dtype=np.int64)
            length = size[lane]
            # lanes still at work at each step
            active = len(lane) - np.searchsorted(length[::-1], np.arange(int(length[0])), side="right")
            for step, m in enumerate(active.tolist()):
                c = data[begin[:m] + step]
                here = s[:, :m]
                entry = self.entries[here + c]
                begins = (entry >> 32) != here  # no way on, or at the root: the byte begins a phrase
                n[:, :m] += begins
                s[:, :m] = np.where(begins, self.roots[:, c], entry & _LOW)
            found[:, lane], last[:, lane] = n, s
        return found, last

    def entropies(self, texts: list[str | None], block: int = 1024) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Places of the texts with a letter, their bits against each language, and their folded bytes."""
        at = [i for i, t in enumerate(texts) if has_letter(t)]
        data = [folded(texts[i]) for i in at]
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        return at, self.phrases(data, block) * np.array(self.bits), sizes


def samples(labelled: DataFrame, text: str, lang: str, key, sample_bytes: int = 40_000) -> dict[str, bytes]:
    """A sample of each language's labelled text, folded.

    It is made of whole documents, the first by a hash of
    ``key`` and text, until it has ``sample_bytes`` bytes; longer documents are
    passed over, and only where a language has no shorter one its first
    document is cut. So a sample has less than twice ``sample_bytes`` bytes.

    One pass adds up bytes by language and by the leading zero bits of the
    hash; it tells how many zero bits leave enough text of each language, and a
    second pass gathers only the documents that have them.
    """
    h = F.xxhash64(key, F.col(text))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), h.alias("h"), F.octet_length(text).cast("long").alias("n"), F.col(text).alias("t"))
    fits = F.col("n") <= sample_bytes
    zeros = F.lit(63) - F.floor(F.log2(F.greatest(F.lit(1), F.shiftrightunsigned("h", 1)).cast("double"))).cast("int")
    rows = rows.withColumns({"fits": fits, "z": zeros})
    sums = rows.groupBy("lang", "fits", "z").agg(F.sum("n").alias("n")).collect()  # at most 2 * 64 rows for each language
    depth: dict[str, tuple[bool, int]] = {}
    for x in {r["lang"] for r in sums}:
        mine = {f: {r["z"]: r["n"] for r in sums if r["lang"] == x and r["fits"] == f} for f in (True, False)}
        use = bool(mine[True])
        total, z = 0, max(mine[use])
        for z in sorted(mine[use], reverse=True):
            total += mine[use][z]
            if total >= 2 * sample_bytes:
                break
        depth[x] = (use, z)
    if not depth:
        return {}
    spark = labelled.sparkSession
    wanted = spark.createDataFrame([(x, f, z) for x, (f, z) in sorted(depth.items())], "lang string, fits boolean, least int")
    near = rows.join(F.broadcast(wanted), ["lang", "fits"]).where(F.col("z") >= F.col("least"))
    alike = near.groupBy("lang", "h").agg(F.first(F.substring("t", 1, sample_bytes)).alias("t"))
    before = F.sum(F.octet_length("t")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    picked = alike.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < sample_bytes).select("lang", "h", "t").collect()
    found: dict[str, bytes] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["h"])):
        found[r["lang"]] = found.get(r["lang"], b"") + b" " + folded(r["t"])
    return {x: found[x] for x in sorted(found) if found[x].strip()}


def train(labelled: DataFrame, text: str, lang: str, key, sample_bytes: int = 40_000, languages_at_once: int = 64) -> list[Model]:
    """Models of the languages in :func:`samples`, of at most ``languages_at_once`` languages each."""
    found = samples(labelled, text, lang, key, sample_bytes)
    names = list(found)
    return [Model({x: found[x] for x in names[i : i + languages_at_once]}) for i in range(0, len(names), languages_at_once)]


_SUMS = "_first string, _least double, _sum double, _languages int, _bytes long, _bits double"


def predict(docs: DataFrame, models: list[Model], id_cols: list, text: str = "text", block: int = 1024, keep_text: bool = False) -> DataFrame:
    """``id_cols``, with ``keep_text`` the text as ``_text``, and lang_pred, score and bits for every row.

    ``score`` tells how much less than the mean of the other languages the
    text's entropy against its own is, from 0 to 1. ``bits`` is that entropy in
    bits a byte without the text's first phrase, so that very short texts have
    0. Where the text is null or has no letter, or nothing was learned, the
    language is ``und``, the score 0 and bits null.

    A task holds one model at a time; with several, all but the last leave
    their sums and the texts in the shared folder for the next one.
    """
    spark = docs.sparkSession
    state = docs.select(*id_cols, F.col(text).cast("string").alias("_text"))
    n = len(state.columns) - 1
    kept = state.schema
    for i, model in enumerate(models or [Model({})]):
        last = i >= len(models) - 1
        passed = n + (keep_text or not last)  # texts go back only where they are needed
        state = state.mapInArrow(_with_sums(spark.sparkContext.broadcast(model), n, passed, i == 0, block), _extended(kept[:passed]))
        if not last:
            state = written(state, "languages")
    others = (F.col("_sum") - F.col("_least")) / F.greatest(F.lit(1), F.col("_languages") - 1)
    score = F.when(F.col("_first").isNull(), 0.0).when(F.col("_languages") == 1, 1.0).when(others > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_least") / others))).otherwise(0.0)
    bits = F.when(F.col("_first").isNotNull(), (F.col("_least") - F.col("_bits")) / F.col("_bytes"))
    return state.select(*[f"`{c}`" for c in kept.names[: n + keep_text]], F.coalesce("_first", F.lit("und")).alias("lang_pred"), score.alias("score"), bits.alias("bits"))


def _extended(schema):
    from pyspark.sql.types import StructType

    return StructType([*schema.fields, *StructType.fromDDL(_SUMS).fields])


def _with_sums(shared, n: int, passed: int, start: bool, block: int):
    """A pass over batches that adds one model's languages to the sums in the last six columns; column n is the text, the first ``passed`` columns are passed on."""
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices_of_bytes(batch, n):
                rows = part.num_rows
                was = [[None] * rows, [None] * rows, [0.0] * rows, [0] * rows, [0] * rows, [None] * rows] if start else [c.to_pylist() for c in part.columns[n + 1 :]]
                first, least, total, languages, size, unit = was
                at, bits, sizes = m.entropies(part.column(n).to_pylist(), block)
                if m.languages:
                    best = bits.argmin(axis=1)
                    for row, i in enumerate(at):
                        own = float(bits[row, best[row]])
                        if least[i] is None or own < least[i]:
                            first[i], least[i], unit[i] = m.languages[best[row]], own, m.bits[best[row]]
                        total[i] += float(bits[row].sum())
                        languages[i] += len(m.languages)
                        size[i] = int(sizes[row])
                yield pa.RecordBatch.from_arrays([*part.columns[:passed], *[pa.array(c, k) for c, k in zip(was, kinds)]], [*part.schema.names[:passed], "_first", "_least", "_sum", "_languages", "_bytes", "_bits"])

    return run


def is_held_out(doc_id) -> object:
    """Whether crc32 of the id's decimal text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample_bytes: int = 40_000, block: int = 1024, languages_at_once: int = 64) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, bits), one for each row of ``docs``.

    Learns from the rows that are not held out and have a language. Without any
    such row every text is ``und``, as are null texts and those without a
    letter. Rows with equal texts get equal answers, ids and other columns of
    any name are never looked at; a null id is not held out. Of languages with
    equal entropies the first name by code point is said. An empty table gives
    no rows.
    """
    held = is_held_out(F.col(id_col))
    models = train(docs.where(~held), text, lang, F.col(id_col), sample_bytes, languages_at_once)
    return predict(docs, models, [F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out")], text, block)
