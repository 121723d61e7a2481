"""Fill-in-middle examples, cut with DataFrame functions only.

A delimiter that the text cannot hold is put in after every unit: the text is
escaped first, so that the delimiter is free, and a regular expression appends
it to each unit. The delimiters are then the units' count, ``substring_index``
takes the first, the middle and the last ones of them, and the parts lose the
delimiter and their escapes again before they are put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectloom.llm.common import numbered

#: The delimiter, and the character that escapes it and itself.
_MARK, _ESCAPE = "\x1e", "\x1b"
_PAIR = f"{_ESCAPE}[01]"
#: What a unit is, as a pattern over escaped text; each matches every text from end to end, a character being a code point.
UNITS = {"char": f"(?s){_PAIR}|.", "word": r"\s*\S+|\s+", "line": r"[^\n]*\n|[^\n]+"}
MARKERS = ("<P>", "<S>", "<M>")


def escaped(text: Column) -> Column:
    """The text without the delimiter."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_MARK), F.lit(_ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    """A run of marked units as it stands in the text."""
    bare = F.replace(part, F.lit(_MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "1"), F.lit(_MARK)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))


def marked(text: Column, unit: str = "char") -> Column:
    """The escaped text with the delimiter after every unit."""
    return F.regexp_replace(escaped(text), UNITS[unit], f"$0{_MARK}")


def n_units(units: Column) -> Column:
    """How many units a marked text has."""
    return (F.octet_length(units) - F.octet_length(F.replace(units, F.lit(_MARK), F.lit("")))).cast("long")


def first_units(units: Column, n: Column) -> Column:
    return unescaped(F.call_function("substring_index", units, F.lit(_MARK), n.cast("int")))


def last_units(units: Column, n: Column) -> Column:
    """The last ``n`` units; a marked text ends with a delimiter, which counts as one more part."""
    return unescaped(F.call_function("substring_index", units, F.lit(_MARK), -(n.cast("int") + 1)))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a row's key: the first groups of eight digits of a hash."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _checked(markers: Sequence[str]) -> None:
    """Markers must not run into each other: else a text without any could make one at a seam."""
    if len(set(markers)) < 3:
        raise ValueError("three different markers are needed")
    for a in markers:
        for b in markers:
            if not a or any(a[:k] == b[-k:] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", unit: str = "char", percent: int = 90, spm_percent: int = 20, markers: Sequence[str] = MARKERS, seed: int = 1) -> DataFrame:
    """``docs`` with n_units, form, prefix, middle, suffix and output added, in place of any of these names.

    The text is cut after the smaller and after the larger of two draws, each
    from 0 to all of its units; ``percent`` of texts become examples, of which
    ``spm_percent`` have the suffix first. Forms: ``psm`` is prefix marker, prefix,
    suffix marker, suffix, middle marker, middle; ``spm`` is suffix marker,
    suffix, prefix marker, prefix, middle marker, middle; ``plain`` is the text
    as it is, with null parts. Texts that are empty or hold a marker are plain,
    so that every output can be read back; a null text counts as empty. A null
    id is a key of its own, so all rows without id share their draws; repeated
    rows are treated alike. Other columns pass and may have any names; an empty
    table gives no rows. A text's marked form takes up to twice its bytes.
    """
    _checked(markers)
    added = ["n_units", "form", "prefix", "middle", "suffix", "output"]
    if {id_col, text} & set(added):
        raise ValueError(f"the columns of ids and texts must not be named as one of {added}")
    docs = docs.drop(*added)
    names = docs.columns
    docs, (id_col, text) = numbered(docs, id_col, text)
    x = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    held = F.lit(False)
    for m in markers:
        held = held | F.contains("_t", F.lit(m))
    h = draws(F.col(id_col), seed)
    # only what is cut is marked; each step is a column of its own, so that it is computed once
    x = x.withColumn("_plain", (F.col("_t") == "") | held | (h[2] % 100 >= percent)).withColumn("_u", marked(F.col("_t"), unit)).withColumn("_n", n_units(F.col("_u")))
    ends = [h[i] % (F.col("_n") + 1) for i in range(2)]
    x = x.withColumns({"_a": F.least(*ends), "_b": F.greatest(*ends)})
    # the middle is what the first b units have after the first a
    upto = F.concat(F.call_function("substring_index", "_u", F.lit(_MARK), F.col("_b").cast("int")), F.lit(_MARK))
    middle = F.when(F.col("_a") == F.col("_b"), "").otherwise(last_units(upto, F.col("_b") - F.col("_a")))
    cut = {"_p": first_units(F.col("_u"), F.col("_a")), "_m": middle, "_s": last_units(F.col("_u"), F.col("_n") - F.col("_b"))}
    x = x.withColumns({k: F.when(~F.col("_plain"), c) for k, c in cut.items()})
    p, s, m = (F.lit(x) for x in markers)
    spm = h[3] % 100 < spm_percent
    form = F.when(F.col("_plain"), "plain").when(spm, "spm").otherwise("psm")
    x = x.withColumn("_form", form)
    output = F.when(F.col("_form") == "plain", F.col("_t")).when(F.col("_form") == "spm", F.concat(s, "_s", p, "_p", m, "_m")).otherwise(F.concat(p, "_p", s, "_s", m, "_m"))
    return x.select(*docs.columns, "_n", "_form", "_p", "_m", "_s", output.alias("_o")).toDF(*names, *added)


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output of :func:`fill_in_middle` was made of."""
    p, s, m = markers
    ahead, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(ahead, s, 1), p, -1), middle, F.substring_index(ahead, s, -1))
    spm = F.concat(F.substring_index(ahead, p, -1), middle, F.substring_index(F.substring_index(ahead, p, 1), s, -1))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
