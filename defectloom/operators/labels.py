"""Labels: fix commits, matching labels to files, hybrid sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from defectloom.functions import paths as P
from defectloom.session import dealt, stored, stored_parts


# How comment lines begin, by the language's name; other languages have none.
COMMENT_MARKS = {"python": ("#", '"""', "'''"), "javascript": ("//", "/*", "*"), "typescript": ("//", "/*", "*"), "java": ("//", "/*", "*"), "go": ("//", "/*", "*"), "cpp": ("//", "/*", "*"), "csharp": ("//", "/*", "*")}


def substantive_line(line: Column, language: Column, marks: dict[str, Sequence[str]] | None = None) -> Column:
    """Neither blank nor a comment line of its language."""
    marks = COMMENT_MARKS if marks is None else marks
    bare = F.btrim(line, F.lit(" \t\n\r\x0b\x0c"))
    keep = bare != ""
    for begins in dict.fromkeys(marks.values()):
        names = [k for k, v in marks.items() if v == begins]
        comment = bare.startswith(begins[0])
        for m in begins[1:]:
            comment = comment | bare.startswith(m)
        keep = keep & ~(F.coalesce(language.isin(*names), F.lit(False)) & comment)
    return keep


def substantive(changed: Column, before: Column, after: Column, language: Column, has_diff: Column | None = None, min_churn_ratio: float = 0.01, marks: dict[str, Sequence[str]] | None = None) -> Column:
    """Whether a change of ``changed`` lines is more than an incidental edit of the file.

    At least three lines change, and ``min_churn_ratio`` of the lines there were
    (or are, where the text before is null or empty), and of the first
    ``changed`` lines before at least one (up to five changed) or two are code.
    Where both texts are missing, five changed lines do.
    """
    before, after = F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))
    n = F.coalesce(changed, F.lit(0))
    lines = F.size(F.split(F.coalesce(before, after), "\n", -1))
    code = F.size(F.filter(F.slice(F.split(before, "\n", -1), F.lit(1), F.greatest(n, F.lit(0)).cast("int")), lambda x: substantive_line(x, language, marks)))
    large = (n >= 3) & (F.coalesce(code, F.lit(0)) >= F.when(n <= 5, 1).otherwise(2)) & (n / lines >= min_churn_ratio)
    out = F.when(n == 0, False).when(before.isNull() & after.isNull(), n >= 5).otherwise(large)
    return out if has_diff is None else F.coalesce(has_diff, F.lit(False)) & out


def szz_inline(cf: DataFrame, max_files: int = 15, confidence: str = "confidence") -> DataFrame:
    """Per path of fix commits with at most ``max_files`` files: highest confidence, number of fixes, their messages.

    Files of a commit are counted by an aggregate, so that a vast commit is never one task's rows.
    """
    cf, n = stored_parts(cf.select(*[c for c in ("repo", "commit_id", "file", confidence, "msg") if c in cf.columns]))
    cf = dealt(cf, n, "repo", "commit_id")
    small = cf.groupBy("repo", "commit_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= max_files).select("repo", "commit_id")
    return szz_labels(cf.where(F.col(confidence) > 0).join(small, ["repo", "commit_id"], "left_semi"), confidence)


def szz_labels(rows: DataFrame, confidence: str = "confidence", path: str = "file") -> DataFrame:
    """Labels of the rows that a chain has kept: highest confidence, number of fixes and their messages by path."""
    aggs = [F.max(confidence).alias("confidence"), F.count(F.lit(1)).alias("bug_count")]
    if "msg" in rows.columns:
        aggs.append(F.array_sort(F.collect_set("msg")).alias("messages"))
    return rows.groupBy("repo", path).agg(*aggs)


def szz_filter_chain(commits: DataFrame, max_files: int = 20, window_days: float = 2555, min_confidence: float = 0.4) -> DataFrame:
    """Commits (repo, is_merge, confidence, age_days, n_files) with the first reason to skip each, or ``kept``; ages may have fractions."""
    return commits.withColumn("reason", _commit_reason(max_files, window_days, min_confidence).otherwise("kept"))


def _commit_reason(max_files: int, window_days: float, min_confidence: float) -> Column:
    return (
        F.when(F.col("is_merge"), "merge")
        .when(F.col("confidence") <= 0, "not_fix")
        .when(F.col("age_days") > window_days, "window")
        .when(F.col("n_files") > max_files, "files")
        .when(F.col("confidence") < min_confidence, "confidence")
    )


def szz_file_chain(rows: DataFrame, substantive_change: Column, blamed: Column, max_files: int = 20, window_days: float = 2555, min_confidence: float = 0.4) -> DataFrame:
    """Commit files (is_merge, confidence, age_days, n_files, old_path, new_path) with ``path`` and the first reason to skip each, or ``kept``.

    The commit's reasons come first; then the path is the old one, else the new
    one, in normal form, and files without a path, of tests, generated, of other
    extensions, with trivial changes only, and those whose changed lines
    nobody wrote before (not ``blamed``) go.
    """
    path = P.norm_path(F.coalesce(F.nullif("old_path", F.lit("")), "new_path"))
    extension = F.lit(False)
    for e in P.SUPPORTED_EXTENSIONS:
        extension = extension | F.col("path").endswith(e)
    reason = (
        _commit_reason(max_files, window_days, min_confidence)
        .when(F.col("path") == "", "path")
        .when(P.is_test_file(F.col("path")), "test")
        .when(P.is_generated_file(F.col("path")), "generated")
        .when(~extension, "extension")
        .when(~F.coalesce(substantive_change, F.lit(False)), "trivial")
        .when(~F.coalesce(blamed, F.lit(False)), "blame")
        .otherwise("kept")
    )
    return rows.withColumn("path", path).withColumn("reason", reason)


def label_match(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Joins labels (repo, norm_path, confidence, bug_count) to files (repo, file, norm_path) in five stages.

    1 the exact path; 2 the cleaned two-part path; 3 a label path that ends with
    the file's last two parts (what would end with three, stage 4, is found
    here); 5 the same name, more common directories first. Only the first
    stage that holds counts; ties go to the shorter and then the smaller label
    path. A label may match several files.

    Each stage is an equi-join with one label for each key, the best one, so
    files are never multiplied. For stage 3 a label is listed under every ending
    of its last directory. Only files without a match so far, and with a label
    of their name, go on to stage 5 (see :func:`_nearest`).
    """
    best = F.min(F.struct(F.length("key").alias("len"), "key", "confidence", "bug_count"))
    k = labels.select("repo", F.col("norm_path").alias("key"), "confidence", "bug_count")
    parts = F.split("key", "/")
    folder = F.try_element_at(parts, F.lit(-2))
    endings = F.transform(F.sequence(F.lit(1), F.length(folder) + 1), lambda i: F.concat(F.substr(folder, i), F.lit("/"), F.element_at(parts, -1)))
    exact = k.groupBy("repo", F.col("key").alias("norm_path")).agg(best.alias("m1"))
    cleaned = k.groupBy("repo", P.clean_path(F.col("key")).alias("clean")).agg(best.alias("m2"))
    ended = k.where(F.size(parts) >= 2).withColumn("tail", F.explode(endings)).groupBy("repo", "tail").agg(best.alias("m3"))
    named = k.groupBy("repo", P.basename(F.col("key")).alias("name")).agg(best.alias("m0"))

    f = files.select("repo", "file", "norm_path", P.clean_path(F.col("norm_path")).alias("clean"), P.basename(F.col("norm_path")).alias("name"), P.dirname(F.col("norm_path")).alias("dir"))
    f = f.withColumn("tail", F.when(F.size(F.split("norm_path", "/")) >= 2, P.last_parts(F.col("norm_path"), 2)))
    j = f.join(exact, ["repo", "norm_path"], "left").join(cleaned, ["repo", "clean"], "left").join(ended, ["repo", "tail"], "left").join(named, ["repo", "name"], "left")
    j = stored(j.select("repo", "file", "name", "dir", "m1", "m2", "m3", "m0"))
    left = j.where(F.coalesce("m1", "m2", "m3").isNull() & F.col("m0").isNotNull())
    j = j.join(_nearest(left, k, best), ["repo", "name", "dir"], "left")
    stage = F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2).when(F.col("m3").isNotNull(), 3).when(F.col("m0").isNotNull(), 5).otherwise(0)
    hit = F.coalesce("m1", "m2", "m3", "m5", "m0")
    out = j.select("repo", "file", stage.alias("stage"), hit.alias("m"))
    found = F.col("m").isNotNull()
    return out.select(
        "repo",
        "file",
        "stage",
        F.col("m.key").alias("matched"),
        found.cast("int").alias("buggy"),
        F.coalesce("m.confidence", F.lit(0.3)).alias("confidence"),
        F.when(found, "szz").otherwise("clean").alias("source"),
        F.when(found, F.least(F.col("m.bug_count") * F.col("m.confidence"), F.lit(5.0))).otherwise(0.0).alias("bug_score"),
    )


def _nearest(f: DataFrame, k: DataFrame, best: Column, few: int = 64) -> DataFrame:
    """Rows (repo, name, dir, m5): of the labels of a file's name, the best of those with the most directories in common.

    A directory that at most ``few`` label folders of a name have is joined as
    it is: a file meets ``few`` folders for each of its directories, and all
    that they have in common is counted. Folders that share only directories that more have
    differ in these alone, so one label stands for each set of them, and files
    are told apart by their sets of them: what is compared are distinct sets.
    Folders that share both kinds are counted in full by the first way, and by
    less in the second, which then does not count.
    """
    key = ["repo", "name"]

    def folders(c: Column) -> Column:
        return F.array_distinct(F.split(c, "/"))

    l_dirs = k.withColumns({"name": P.basename(F.col("key")), "l_dir": P.dirname(F.col("key"))}).groupBy(*key, "l_dir").agg(best.alias("m"))
    f_dirs = f.select(*key, "dir").distinct()
    l_parts = l_dirs.select(*key, "l_dir", "m", F.explode(folders(F.col("l_dir"))).alias("part"))
    held = l_parts.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    common = held.where(F.col("n") > few).groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("often"))  # at most a part of the labels' directories
    rare = l_parts.join(held.where(F.col("n") <= few).select(*key, "part"), [*key, "part"])
    f_parts = f_dirs.withColumn("part", F.explode(folders(F.col("dir"))))
    met = f_parts.join(rare, [*key, "part"]).select(*key, "dir", "l_dir", "m").distinct()
    counted = met.select(*key, "dir", "m", F.size(F.array_intersect(folders(F.col("dir")), folders(F.col("l_dir")))).alias("n"))

    def often(c: str) -> Column:
        return F.array_sort(F.array_intersect(folders(F.col(c)), F.col("often"))).alias("set")

    l_sets = l_dirs.join(common, key).select(*key, often("l_dir"), "m").groupBy(*key, "set").agg(F.min("m").alias("m"))
    f_named = f_dirs.join(common, key).select(*key, "dir", often("dir"))
    pairs = f_named.select(*key, "set").distinct().join(l_sets.withColumnRenamed("set", "l_set"), key)
    of_set = pairs.select(*key, "set", F.struct((-F.size(F.array_intersect("set", "l_set"))).alias("c"), "m").alias("b")).groupBy(*key, "set").agg(F.min("b").alias("b"))
    by_set = f_named.join(of_set, [*key, "set"]).select(*key, "dir", "b")
    every = counted.select(*key, "dir", F.struct((-F.col("n")).alias("c"), "m").alias("b")).unionByName(by_set)
    return every.groupBy(*key, "dir").agg(F.min("b")["m"].alias("m5"))


def two_stage_match(files: DataFrame, labels: DataFrame) -> DataFrame:
    """The exact path, else the first label of the same name."""
    f = files.select("repo", "file", "norm_path", P.basename(F.col("norm_path")).alias("name"))
    exact = labels.select("repo", "norm_path", F.col("confidence").alias("c1"))
    named = labels.groupBy("repo", P.basename(F.col("norm_path")).alias("name")).agg(F.min_by("confidence", "norm_path").alias("c2"))
    return f.join(exact, ["repo", "norm_path"], "left").join(named, ["repo", "name"], "left").select("repo", "file", F.coalesce("c1", "c2").alias("confidence"), F.when(F.col("c1").isNotNull(), "exact").when(F.col("c2").isNotNull(), "name").otherwise("none").alias("matched_by"))


def hybrid_labels(szz: DataFrame, issues: DataFrame) -> DataFrame:
    """Union of (path, confidence) from both sources; an issue names the source, the greater confidence holds."""
    j = szz.select("path", F.col("confidence").alias("szz_confidence")).join(issues.select("path", F.col("confidence").alias("issue_confidence")), "path", "full_outer")
    s, i = F.coalesce("szz_confidence", F.lit(0.0)), F.coalesce("issue_confidence", F.lit(0.0))
    return j.select("path", F.lit(True).alias("is_buggy"), F.greatest(s, i).alias("confidence"), F.when(i > 0, "issue").otherwise("szz").alias("source"), s.alias("szz_confidence"), i.alias("issue_confidence"))


def apply_labels(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels by path, with false, 0 and ``none`` where there is none."""
    return files.join(labels.select("path", "is_buggy", "confidence", "source"), "path", "left").withColumns({"is_buggy": F.coalesce("is_buggy", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.0)), "source": F.coalesce("source", F.lit("none"))})


def message_match(files: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages (path, msg) by exact path, else cleaned path, else a name of more than six characters; of several the smallest."""
    f = files.select("file", "path", P.clean_path(F.col("path")).alias("clean"), P.basename(F.col("path")).alias("name"))

    def side(key: Column, name: str) -> DataFrame:
        return messages.groupBy(key.alias(name)).agg(F.min("msg").alias(f"m_{name}"))

    j = f.join(side(F.col("path"), "path"), "path", "left").join(side(P.clean_path(F.col("path")), "clean"), "clean", "left").join(side(P.basename(F.col("path")), "name"), "name", "left")
    return j.select("file", F.coalesce("m_path", "m_clean", F.when(F.length("name") > 6, F.col("m_name"))).alias("msg"))


def match_rate(a: DataFrame, b: DataFrame, key: str = "path") -> DataFrame:
    """Keys of b, those also in a, and their share."""
    mine = b.select(key).distinct()
    both = mine.join(a.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return both.agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("matched")).withColumn("match_rate", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0))


def has_test_file(files: DataFrame) -> DataFrame:
    """Whether a file of six test names stands beside it or in a test directory beside its own."""
    p = F.col("path")
    folder, s, e = P.dirname(p), P.stem(p), F.regexp_extract(P.basename(p), r"[^.](\.[^.]+)$", 1)
    names = [F.concat(F.lit("test_"), s, e), F.concat(s, F.lit("_test"), e), F.concat(F.lit("spec_"), s, e), F.concat(s, F.lit("_spec"), e), F.concat(s, F.lit(".spec"), e), F.concat(s, F.lit(".test"), e)]
    beside = P.dirname(folder)
    folders = [folder, *[F.concat_ws("/", F.nullif(beside, F.lit("")), F.lit(t)) for t in ("tests", "test", "spec", "__tests__")]]
    wanted = F.array(*[F.concat_ws("/", F.nullif(d, F.lit("")), n) for d in folders for n in names])
    hits = files.select("path", F.explode(wanted).alias("candidate")).join(files.select(F.col("path").alias("candidate")).distinct(), "candidate", "left_semi").select("path").distinct().withColumn("_hit", F.lit(True))
    return files.join(hits, "path", "left").withColumn("has_test_file", F.coalesce("_hit", F.lit(False))).drop("_hit")


def shared_filename(files: DataFrame) -> DataFrame:
    """Flags files whose name occurs in more than one repository."""
    named = files.withColumn("name", P.basename(F.col("path")))
    shared = named.groupBy("name").agg(F.count_distinct("repo").alias("_k")).where("_k > 1").select("name", F.lit(True).alias("_s"))
    return named.join(shared, "name", "left").withColumn("has_shared_filename", F.coalesce("_s", F.lit(False))).drop("_s")


def name_lookup_first(files: DataFrame, terms: DataFrame, most_terms: int = 10_000) -> DataFrame:
    """For each term the first file, by file, whose path holds it in any case.

    The terms are a request's few, at most ``most_terms`` (more are refused), so
    they are broadcast; each file keeps its terms, and the least file of each is
    an aggregate.
    """
    if terms.limit(most_terms + 1).count() > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    hit = F.contains(F.lower("path"), F.lower("term"))
    return files.join(F.broadcast(terms), hit).groupBy("term").agg(F.min_by("path", "file").alias("path"), F.min("file").alias("file"))
