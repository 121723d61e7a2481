"""Source trees: files that pass the filters, with static metrics."""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectloom.functions import paths as P

METRICS = "path string, language string, loc long, functions long, avg_complexity double, max_complexity long, avg_params double, max_function_length long, max_nesting_depth int, top_functions array<struct<name:string,cx:int,length:int,params:int>>"
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.ExceptHandler, ast.Match)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_FUNCTION = re.compile(r"\bfunction\b\s*(\w*)\s*\(([^)]*)\)|(?:^|[\s;{}])(\w+)\s*\(([^;{}()]*)\)\s*(?:throws [\w, .]+)?\{|(\w+)\s*=\s*(?:async\s*)?\(?([\w\s,]*)\)?\s*=>")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function"}
_BRACED = ("js", "jsx", "ts", "tsx", "java")
# What can begin something other than code; a regular expression only where an operand is due.
_OPENS = re.compile(r"""//|/\*|\"\"\"|["'`/{}]""")
_OPERAND_DUE = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await))\s*\Z")
_ENDS = {
    "//": re.compile(r"\n"),
    "/*": re.compile(r"\*/"),
    '"""': re.compile(r"(?:\\.|[^\\])*?\"\"\"", re.DOTALL),
    '"': re.compile(r'(?:\\.|[^"\\\n])*["\n]?', re.DOTALL),
    "'": re.compile(r"(?:\\.|[^'\\\n])*['\n]?", re.DOTALL),
    "/": re.compile(r"(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*"),
    "`": re.compile(r"(?:\\.|(?!\$\{)[^`\\])*(?:`|\$\{|\Z)", re.DOTALL),
}
_NOT_NEWLINE = re.compile(r"[^\n\r\x0b\x0c]")
_BRANCH_WORDS = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?")


def parsed(source: str) -> ast.AST | None:
    """The syntax tree of Python source; None where it does not parse or is nested too deeply for the parser, which reports that as MemoryError."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def nesting_depth(source: str) -> int:
    """The deepest nesting of branches, loops, try, with and match in Python source; 0 where it does not parse."""
    tree = parsed(source)
    if tree is None:
        return 0
    most, work = 0, [(tree, 0)]
    while work:
        node, depth = work.pop()
        depth += isinstance(node, _NESTING)
        most = max(most, depth)
        work += [(child, depth) for child in ast.iter_child_nodes(node)]
    return most


def _python_functions(source: str) -> list[tuple[str, int, int, int]]:
    tree = parsed(source)
    out = []
    for f in ast.walk(tree) if tree is not None else ():
        if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            cx = 1 + sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(f))
            a = f.args
            out.append((f.name, cx, f.end_lineno - f.lineno + 1, len(a.posonlyargs + a.args + a.kwonlyargs)))
    return out


def lexed(source: str, language: str) -> tuple[str, str]:
    """(code alone, code and literals) of a language with braces: in place of comments, and in the first of literals too, there are spaces.

    One pass with a stack: a template may hold code, which may hold templates.
    Java has text blocks and no templates or regular expressions; a slash
    begins a regular expression only after what leaves an operand due. A
    string that is not closed ends with its line, a comment or template with the text.
    """
    java, code, both = language == "java", [], []
    at, depth = 0, 0
    templates: list[int] = []  # the depth of braces at which each open template goes on

    def put(start: int, end: int, literal: bool | None) -> None:
        part = source[start:end]
        blank = _NOT_NEWLINE.sub(" ", part)
        code.append(part if literal is None else blank)
        both.append(blank if literal is False else part)

    def template(start: int) -> int:
        m = _ENDS["`"].match(source, start)
        put(start, m.end(), True)
        if m[0].endswith("${"):
            templates.append(depth)
        return m.end()

    while m := _OPENS.search(source, at):
        kind, begin = m[0], m.start()
        put(at, begin, None)
        at = begin
        if kind in "{}":
            if kind == "}" and templates and templates[-1] == depth:
                templates.pop()
                put(at, at + 1, True)
                at = template(at + 1)
                continue
            depth = depth + 1 if kind == "{" else max(0, depth - 1)
            put(at, at + 1, None)
            at += 1
        elif kind == "`" and not java:
            put(at, at + 1, True)
            at = template(at + 1)
        elif kind in ("//", "/*"):
            end = _ENDS[kind].search(source, m.end())
            stop = len(source) if end is None else end.start() if kind == "//" else end.end()
            put(at, stop, False)
            at = stop
        else:
            end = None
            if kind == '"""' and not java:
                kind = '"'
            if kind in ('"""', '"', "'"):
                end = _ENDS[kind].match(source, begin + len(kind))
            elif kind == "/" and not java and _OPERAND_DUE.search("".join(code[-3:])[-40:]):
                end = _ENDS["/"].match(source, begin + 1)
            stop = begin + 1 if end is None else end.end()
            put(at, stop, None if end is None else True)
            at = stop
    put(at, len(source), None)
    return "".join(code), "".join(both)


def _closing(source: str) -> tuple[list[int], list[int]]:
    """Places of all opening braces and of what closes each, one pass for all; -1 where nothing does."""
    opens, closes, stack = [], [], []
    for m in re.finditer("[{}]", source):
        if m[0] == "{":
            stack.append(len(opens))
            opens.append(m.start())
            closes.append(-1)
        elif stack:
            closes[stack.pop()] = m.start()
    return opens, closes


def _brace_functions(source: str) -> list[tuple[str, int, int, int]]:
    """Functions in the code of a language with braces, without its comments and literals; a body runs to the brace that closes it, without any brace to the end."""
    out = []
    opens, closes = _closing(source)
    branches = [m.start() for m in _BRANCH_WORDS.finditer(source)]
    lines = [m.start() for m in re.finditer("\n", source)]
    for m in _FUNCTION.finditer(source):
        name = m[1] or m[3] or m[5] or "(anonymous)"
        if name in _KEYWORDS:
            continue
        params = next((p for p in (m[2], m[4], m[6]) if p is not None), "")
        at = bisect_left(opens, m.end() - 1)
        end = closes[at] + 1 if at < len(opens) and closes[at] >= 0 else len(source)

        def within(places: list[int]) -> int:
            return bisect_left(places, end) - bisect_left(places, m.start())  # noqa: B023

        out.append((name, 1 + within(branches), within(lines) + 1, len([p for p in params.split(",") if p.strip()])))
    return out


def measure(path: str, source: str) -> dict:
    """Metrics of one file."""
    language = P.SUPPORTED_EXTENSIONS.get("." + path.rsplit(".", 1)[-1].lower())
    if language in _BRACED:
        code, both = lexed(source, language)
        found, loc = _brace_functions(code), sum(1 for x in both.splitlines() if x.strip())
    else:
        found = _python_functions(source) if language == "py" else []
        mark = "#" if language == "py" else "//"
        loc = sum(1 for x in source.splitlines() if x.strip() and not x.strip().startswith(mark))
    cx = [f[1] for f in found]
    top = sorted(found, key=lambda f: (-f[1], -f[2], f[0]))[:5]
    return {
        "path": path,
        "language": language,
        "loc": loc,
        "functions": len(found),
        "avg_complexity": sum(cx) / len(cx) if cx else 0.0,
        "max_complexity": max(cx, default=0),
        "avg_params": sum(f[3] for f in found) / len(found) if found else 0.0,
        "max_function_length": max((f[2] for f in found), default=0),
        "max_nesting_depth": nesting_depth(source) if language == "py" else 0,
        "top_functions": [dict(zip(("name", "cx", "length", "params"), f)) for f in top],
    }


def write_tree(files: DataFrame, root: str) -> int:
    """Writes rows (path, content) as files under ``root`` from the executors, and returns their number.

    Paths are relative; one that is absolute or steps out of its folder is refused.
    """
    import posixpath

    import pyarrow as pa
    import pyarrow.fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root.rstrip("/"))
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path.startswith("/") or posixpath.normpath(path).split("/")[0] in ("..", "."):
                    raise ValueError(f"not a path within the tree: {path}")
                fs.create_dir(posixpath.dirname(f"{base}/{path}"), recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _wanted(rel: Column) -> Column:
    return P.ext_filter(rel) & (P.dir_class(rel) != "excluded") & ~P.exclude_pattern(rel)


def _tree(spark: SparkSession, root: str) -> DataFrame:
    """The files under ``root`` that pass the filters, with ``rel_path``.

    The condition is put to the files' metadata too, by which Spark drops files
    while it lists them; so contents of others are never read.
    """
    below = lambda c: F.regexp_replace(c, "^.*?" + re.escape(root.rstrip("/").removeprefix("file://")) + "/", "")
    listed = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(_wanted(below(F.coalesce(F.try_url_decode(F.replace(listed, F.lit("+"), F.lit("%2B"))), listed))))
    return files.withColumn("rel_path", below(F.col("path"))).where(_wanted(F.col("rel_path")))


def scan_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, rel_path, length) of files under ``root`` that pass the extension, directory and name filters; contents are not read."""
    return _tree(spark, root).select("path", "rel_path", "length")


def scan_static_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of the files that :func:`scan_source_tree` lists, read once and alone, one file at a time in each task."""
    return measured(_tree(spark, root).select("rel_path", F.decode("content", "UTF-8").alias("source")))


def measured(rows: DataFrame) -> DataFrame:
    """Metrics of rows (path, source)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([measure(p, s or "") for p, s in frame.itertuples(index=False)], columns=[x.split()[0] for x in METRICS.split(", ")])

    return rows.mapInPandas(run, METRICS)
