"""Paths: normal forms, pieces and what kind of file a path names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from defectloom.functions.core import any_of

# Results depend on these very lists.
SUPPORTED_EXTENSIONS = {".py": "py", ".js": "js", ".jsx": "jsx", ".ts": "ts", ".tsx": "tsx", ".java": "java", ".html": "html", ".css": "css", ".json": "json", ".yaml": "yaml", ".yml": "yml"}
ALLOWED_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".html", ".css", ".json", ".yaml", ".yml")
EXCLUDED_EXTENSIONS = (".md", ".txt", ".rst", ".log", ".csv", ".png", ".jpg", ".jpeg", ".svg", ".pdf")
EXCLUDED_DIRS = (
    "test", "tests", "testing", "__tests__", "spec", "specs", "t", "docs", "documentation", "docs_src", "build", "dist", "out", ".git", ".github", "node_modules", "__pycache__", "coverage",
    "static", "assets", "public", "vendor", "examples", "example", "sample", "samples", "demo", "demos", "benchmarks", ".venv", "venv", "env", "migrations",
)
CORE_DIRS = (
    "src", "lib", "app", "backend", "frontend", "api", "routers", "services", "db", "models", "database", "utils", "middleware", "controllers",
    "routing", "dependencies", "security", "schemas", "endpoints", "views", "handlers",
)
CONDITIONAL_DIRS = ("scripts", "config", "migrations")
FRAMEWORK_KEYWORDS = ("middleware", "routing", "security", "dependency", "template", "templating", "websocket", "openapi", "static", "auth")
IMPORTANT_KEYWORDS = (
    "model", "db", "database", "api", "route", "controller", "service", "schema", "auth", "migration", "seed", "config", "settings",
    "middleware", "dependency", "security", "static", "template", "websocket", "cors", "gzip", "openapi",
)
APPLICATION_KEYWORDS = ("app", "service", "controller", "route", "handler", "middleware", "auth", "util", "helper")
ENTRY_POINTS = ("index.js", "main.py", "app.py", "package.json", "setup.py")
EXCLUDED_NAMES = ("README.md", "readme.md", "README.txt", "readme.txt", "requirements.txt", "requirements-dev.txt", "Dockerfile", "docker-compose.yml", "Makefile", "CMakeLists.txt", "LICENSE", "LICENSE.txt", "HISTORY.md", "CHANGELOG.md")
TEST_DIRS = ("test", "tests", "spec", "testing")
TEST_NAME_PARTS = ("test_", "_test", "conftest", "fixture", "fixtures", "factory", "factories", "mock", "mocks")
TEST_ENDINGS = (".test.js", ".spec.js", ".test.ts", ".spec.ts")


def norm_path(c: Column) -> Column:
    """Lower case, forward slashes, no leading ./ or /, no slashes at the ends; empty for null."""
    lower = F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")))
    return F.btrim(F.regexp_replace(lower, r"^(\./|/)", ""), F.lit("/"))


def clean_path(c: Column) -> Column:
    """The last two parts after src/, lib/ and app/ are taken out anywhere."""
    bare = norm_path(c)
    for prefix in ("src/", "lib/", "app/"):
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    return F.array_join(_last(F.split(bare, "/"), 2), "/")


def _last(parts: Column, n: int) -> Column:
    return F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (n - 1)), F.lit(n))


def last_parts(c: Column, n: int) -> Column:
    return F.array_join(_last(F.split(c, "/"), n), "/")


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(c, "/?[^/]*$", "")


def extension(c: Column) -> Column:
    """The last dot of the name and what follows, lower case; empty where there is none or the name begins with it."""
    return F.lower(F.regexp_extract(basename(c), r"[^.](\.[^.]+)$", 1))


def stem(c: Column) -> Column:
    name = basename(c)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def file_language(c: Column, extensions: dict[str, str] | None = None) -> Column:
    """The language of the extension, or null."""
    table = F.create_map(*[F.lit(x) for kv in (extensions or SUPPORTED_EXTENSIONS).items() for x in kv])
    return F.try_element_at(table, extension(c))


def ext_filter(c: Column, allowed: Sequence[str] = ALLOWED_EXTENSIONS, excluded: Sequence[str] = EXCLUDED_EXTENSIONS) -> Column:
    e = extension(c)
    return ~e.isin(*excluded) & e.isin(*allowed)


def _parts(c: Column) -> Column:
    return F.split(F.lower(c), "/")


def _overlaps(parts: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def dir_class(c: Column, repo: Column | None = None, excluded: Sequence[str] = EXCLUDED_DIRS, core: Sequence[str] = CORE_DIRS, conditional: Sequence[str] = CONDITIONAL_DIRS) -> Column:
    """excluded, core, conditional or other by the parts of the path; the repository's own name counts as core where given."""
    parts = _parts(c)
    is_core = _overlaps(parts, core)
    if repo is not None:
        is_core = is_core | F.array_contains(parts, F.lower(repo))
    return F.when(_overlaps(parts, excluded), "excluded").when(is_core, "core").when(_overlaps(parts, conditional), "conditional").otherwise("other")


def skip_dir(c: Column, repo: Column | None = None, skip: Sequence[str] = EXCLUDED_DIRS, core: Sequence[str] = CORE_DIRS) -> Column:
    parts = _parts(c)
    keep = _overlaps(parts, core)
    if repo is not None:
        keep = keep | F.array_contains(parts, F.lower(repo))
    return ~keep & _overlaps(parts, skip)


def important_keyword(c: Column, words: Sequence[str] = IMPORTANT_KEYWORDS) -> Column:
    return any_of(F.lower(c), words)


def exclude_pattern(c: Column) -> Column:
    """Names of tests, private, generated, minified and other files that are not analysed."""
    name, s = basename(c), stem(c)
    private = s.startswith("_") & ~name.isin("__init__.py", "__init__.js", "__init__.ts") & ~name.startswith("_utils") & ~name.startswith("_config")
    test = name.startswith("test_") | name.endswith("_test.py") | name.startswith("spec_") | name.endswith("_spec.py")
    made = any_of(F.lower(c), ("node_modules", "__pycache__", ".venv", "venv/", "env/", "coverage/", "__generated__"))
    for end in (".min.js", ".min.css", "_pb2.py", ".pb.go", ".lock", ".log"):
        made = made | c.endswith(end)
    return test | private | made | name.isin(*EXCLUDED_NAMES)


def is_test_file(c: Column) -> Column:
    p = norm_path(c)
    hit = any_of(p, [f"/{d}/" for d in TEST_DIRS])
    for d in TEST_DIRS:
        hit = hit | p.startswith(f"{d}/")
    name = basename(p)
    hit = hit | any_of(name, TEST_NAME_PARTS)
    for e in TEST_ENDINGS:
        hit = hit | name.endswith(e)
    return hit


def is_generated_file(c: Column, dirs: Sequence[str] = EXCLUDED_DIRS) -> Column:
    """Whether one of the directories stands anywhere in the path but at its end."""
    parts = F.split(norm_path(c), "/")
    return _overlaps(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), dirs)


def trivial_file(c: Column, loc: Column, functions: Column) -> Column:
    p, name = F.lower(c), F.lower(basename(c))
    example = F.when((loc >= 20) | (functions >= 2), False).when(p.contains("tutorial") & (loc >= 15), False).otherwise(True)
    return (
        F.when(name.isin(*ENTRY_POINTS) | any_of(p, FRAMEWORK_KEYWORDS), False)
        .when((c.endswith(".json") | c.endswith(".yaml") | c.endswith(".yml")) & (functions == 0), True)
        .when((loc <= 3) & (functions == 0), True)
        .when(p.contains("example"), example)
        .otherwise((functions == 0) & (loc < 30) & ~important_keyword(c))
    )


def meaningful_file(c: Column, loc: Column, functions: Column, total_files: Column, directory: Column) -> Column:
    """Nine rules in order; with more than 500 files the thresholds on functions and lines are lower."""
    p, name = F.lower(c), F.lower(basename(c))
    relaxed = total_files > 500
    enough = functions >= F.when(relaxed, 1).otherwise(2)
    sized = (loc >= F.when(relaxed, 10).otherwise(15)) & (functions >= 1)
    some = (functions >= 1) | (loc >= 10)
    return (
        (directory == "core")
        | (any_of(p, FRAMEWORK_KEYWORDS) & some)
        | name.isin(*ENTRY_POINTS)
        | enough
        | sized
        | important_keyword(c)
        | (~relaxed & any_of(p, ("example", "tutorial")) & some)
        | (any_of(p, APPLICATION_KEYWORDS) & ((loc >= 5) | (functions >= 1)))
        | (loc >= 50)
    )


def include_file(c: Column, loc: Column, functions: Column, total_files: Column, known_buggy: Column, repo: Column | None = None) -> Column:
    """Known defects stay; else extension, directory, triviality and meaning decide in this order."""
    directory = dir_class(c, repo)
    return F.when(F.coalesce(known_buggy, F.lit(False)), True).when(~ext_filter(c), False).when(directory == "excluded", False).when(directory == "core", True).when(trivial_file(c, loc, functions), False).otherwise(meaningful_file(c, loc, functions, total_files, directory))


def repo_from_path(c: Column, known: Sequence[str] = (), marker: str = "dataset") -> Column:
    """The part after ``marker``, else the first known repository in the path, else ``unknown``."""
    parts = F.split(c, "/")
    at = F.array_position(parts, marker)
    after = F.when((at > 0) & (at < F.size(parts)), F.get(parts, at.cast("int")))
    named = [F.when(F.array_contains(parts, k), k) for k in known]
    return F.coalesce(after, *named, F.lit("unknown"))


def dir_similarity(a: Column, b: Column) -> Column:
    """Directories that both paths have, as sets."""
    return F.size(F.array_intersect(F.split(dirname(a), "/"), F.split(dirname(b), "/")))


def owner_repo(remote: Column) -> Column:
    """owner/repo of an https or ssh remote, or null."""
    found = F.regexp_extract(remote, r"^(?:https?://[^/]+/|(?:ssh://)?git@[^:/]+[:/])([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    return F.nullif(found, F.lit(""))
