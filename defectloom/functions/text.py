"""Commit messages and issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from defectloom.functions.core import any_of

# Results depend on these very lists.
HIGH_KEYWORDS = ("crash", "exception", "failure", "null", "panic", "segfault", "deadlock", "overflow", "memory leak")
MEDIUM_KEYWORDS = ("fix", "bug", "issue", "resolve", "patch", "defect", "broken")
IGNORE_KEYWORDS = (
    "refactor", "cleanup", "rename", "format", "style", "lint", "flake8", "pylint", "mypy", "pyright", "ruff", "black", "typing", "annotation", "type hint", "type check",
    "typo", "docs", "documentation", "readme", "rst", "docstring", "grammar", "spelling", "comment", "update", "upgrade", "bump", "pre-commit", "ci", "release", "version",
)
BUG_LABELS = ("bug", "defect", "error", "failure", "crash", "issue", "problem")


def subject_line(c: Column) -> Column:
    """The first line of the message without white space around the message, lower case."""
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    return F.lower(F.element_at(F.split(trimmed, "\n"), 1))


def commit_confidence(c: Column, high: Sequence[str] = HIGH_KEYWORDS, medium: Sequence[str] = MEDIUM_KEYWORDS, ignore: Sequence[str] = IGNORE_KEYWORDS) -> Column:
    """1.0, 0.7 or 0.0 by substrings of the subject; words to ignore come first."""
    s = subject_line(c)
    return F.when(any_of(s, ignore), 0.0).when(any_of(s, high), 1.0).when(any_of(s, medium), 0.7).otherwise(0.0)


def is_bug_fix(c: Column, **words) -> Column:
    return commit_confidence(c, **words) > 0


def weighted_bug_fix(c: Column, strong: Sequence[str], medium: Sequence[str], weak: Sequence[str], default: float = 0.75) -> Column:
    """Weights 1.0, 0.75 and 0.4 by words anywhere in the message, ``default`` without any."""
    s = F.lower(F.coalesce(c, F.lit("")))
    return F.when(any_of(s, strong), 1.0).when(any_of(s, medium), 0.75).when(any_of(s, weak), 0.4).otherwise(F.lit(float(default)))


def issue_refs(c: Column) -> Column:
    """Distinct issue numbers, in order of size: #n, and n at the end of an issue's address."""
    plain = F.regexp_extract_all(c, F.lit(r"#(\d+)"), 1)
    linked = F.regexp_extract_all(F.lower(c), F.lit(r"(?:fixe?s?|closes?|resolves?|addresse?s?)\s+(?:https?://)?(?:www\.)?github\.com/[^/]+/[^/]+/issues/(\d+)"), 1)
    return F.array_sort(F.array_distinct(F.transform(F.concat(plain, linked), lambda x: x.cast("long"))))


def is_bug_issue(labels: Column, title: Column, body: Column, words: Sequence[str] = BUG_LABELS) -> Column:
    tagged = F.arrays_overlap(F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower), F.array(*[F.lit(w) for w in words]))
    return tagged | any_of(F.lower(F.coalesce(title, F.lit(""))), words) | any_of(F.lower(F.coalesce(body, F.lit(""))), words)


def keywords_in(text: Column, words: Sequence[str]) -> Column:
    """The distinct words of ``words``, in any order, that stand in the text as whole words; one pass over the text for all of them.

    At each place the longest word is found; words that it begins with, up to a
    border between words, stand there too.
    """
    words = list(dict.fromkeys(words))
    edge = r"[\p{L}\p{N}_]"
    by_length = sorted(words, key=lambda w: (-len(w), w))
    pattern = rf"(?<!{edge})(?=({'|'.join(f'\\Q{w}\\E' for w in by_length)})(?!{edge}))"
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
    within = {w: [v for v in words if v != w and w.startswith(v) and not (w[len(v)].isalnum() or w[len(v)] == "_")] for w in words}
    if not any(within.values()):
        return hits
    shorter = F.create_map(*[x for w, vs in within.items() if vs for x in (F.lit(w), F.array(*[F.lit(v) for v in vs]))])
    return F.array_distinct(F.concat(hits, F.flatten(F.transform(hits, lambda w: F.coalesce(F.try_element_at(shorter, w), F.array().cast("array<string>"))))))


def bug_type(c: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """The class whose keywords, as whole words, have the most letters in all; of equals the first, null without any."""
    every = [w for words in keywords.values() for w in words]

    def best(hits: Column) -> Column:
        items = []
        for i, (name, words) in enumerate(keywords.items()):
            score = F.aggregate(hits, F.lit(0), lambda s, w: s + F.when(w.isin(*words), F.char_length(w)).otherwise(0))  # noqa: B023
            items.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
        return F.greatest(*items) if len(items) > 1 else items[0]

    def name(hits: Column) -> Column:
        found = best(hits)
        return F.when(found["score"] > 0, found["name"])

    # the hits are named once and the class follows from them alone, so that the text is searched once
    return F.transform(F.array(keywords_in(F.lower(F.coalesce(c, F.lit(""))), every)), name)[0]
