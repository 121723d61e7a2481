"""The git source: odd names, moves, texts, parts, streams, and the defect chain over a repository made here."""

import subprocess

import pytest
from pyspark.sql import functions as F

from defectloom.sources import git_log, szz
from defectloom.streaming import incremental as S

ODD = 'ta\tb"ü.py'


class Repo:
    def __init__(self, path):
        self.path, self.now = path, 1_700_000_000
        self.git("init", "-q")

    def git(self, *args, **env):
        return subprocess.run(["git", "-C", str(self.path), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *args], check=True, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", **env}).stdout

    def commit(self, msg, *options, **files):
        for name, text in files.items():
            self.write(name, text)
        self.now += 86_400
        at = f"{self.now} +0000"
        self.git("add", "-A")
        self.git("commit", "-qm", msg, *options, GIT_AUTHOR_DATE=at, GIT_COMMITTER_DATE=at)
        return self.git("rev-parse", "HEAD").strip()

    def write(self, name, text):
        f = self.path / name
        f.parent.mkdir(exist_ok=True, parents=True)
        if text is None:
            f.unlink()
        elif isinstance(text, bytes):
            f.write_bytes(text)
        else:
            f.write_text(text)


def code(n, *changed):
    return "".join(f"value_{i} = {'other' if i in changed else 'plain'}({i})\n" for i in range(n))


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = Repo(tmp_path_factory.mktemp("git"))
    r.hashes = [
        r.commit("first\x1e\n\nbody \x1f :100 x", **{ODD: "a\nb\nc\nd\n", "y.txt": "x\n" * 9}),
        r.commit("second", **{ODD: "a\nB\nc\nd\n", "bin.dat": bytes(range(256)) * 4, "y.txt": None, "sub/z.txt": "x\n" * 9}),
        r.commit("nothing", "--allow-empty"),
        r.commit("third", **{"sub/z.txt": None}),
    ]
    (r.path / "link").symlink_to("y")
    r.hashes.append(r.commit("a link"))
    (r.path / "link").unlink()
    r.hashes.append(r.commit("no link", link="--- a\n"))
    # a merge, which is left out
    r.git("checkout", "-qb", "side", r.hashes[3])
    r.hashes.append(r.commit("on the side", side="1\n"))
    r.git("checkout", "-q", "-")
    r.git("merge", "-q", "--no-ff", "-m", "merged", "side")
    return r


@pytest.mark.parametrize("part", ["1", "2", "5000"])
def test_changes_diffs_and_texts(spark, repo, part):
    spark.dataSource.register(git_log.GitLog)
    df = spark.read.format("git_log").options(repos=str(repo.path), diff="true", sources="true", commits_per_part=part).load()
    rows = sorted(df.collect(), key=lambda r: (r["seq"], r["new_path"] or r["old_path"]))
    by = {(r["msg"].split("\n")[0].strip("\x1e"), r["new_path"] or r["old_path"]): r for r in rows}
    assert len(rows) == 9 and len({r["commit_id"] for r in rows}) == 6 and {r["author"] for r in rows} == {"Ann"}
    order = [repo.hashes.index(h) for h in dict.fromkeys(r["commit_id"] for r in rows)]
    assert order[:4] == [0, 1, 3, 4] and [r["seq"] for r in rows][:2] == [0, 0] and by["third", "sub/z.txt"]["seq"] == 3  # an empty commit has a number
    first = by["first", ODD]
    assert (first["change"], first["old_path"], first["new_path"], first["added"], first["deleted"]) == ("A", None, ODD, 4, 0)
    assert first["msg"].endswith("body \x1f :100 x") and first["source_before"] is None and first["source_after"] == "a\nb\nc\nd\n"
    second = by["second", ODD]
    assert (second["change"], second["old_path"], second["added"], second["deleted"], second["source_before"]) == ("M", ODD, 1, 1, "a\nb\nc\nd\n")
    assert "-b\n+B\n" in second["diff"] and second["diff"].startswith("diff --git")
    moved = by["second", "sub/z.txt"]
    assert (moved["change"], moved["old_path"], moved["added"], moved["deleted"]) == ("R", "y.txt", 0, 0) and "rename from y.txt" in moved["diff"]
    data = by["second", "bin.dat"]
    assert (data["added"], data["deleted"], data["source_after"]) == (0, 0, None)
    gone = by["third", "sub/z.txt"]
    assert (gone["change"], gone["new_path"], gone["deleted"], gone["source_after"]) == ("D", None, 9, None)
    kind = by["no link", "link"]
    assert kind["change"] == "T" and kind["diff"].count("diff --git") == 2 and kind["source_after"] == "--- a\n"


def test_since_and_sizes(spark, repo):
    spark.dataSource.register(git_log.GitLog)
    read = spark.read.format("git_log").option("repos", str(repo.path))
    late = read.option("since", repo.hashes[3]).load()
    assert {r["msg"] for r in late.collect()} == {"a link", "no link", "on the side"} and late.agg(F.min("seq")).first()[0] == 4
    small = spark.read.format("git_log").options(repos=str(repo.path), sources="true", max_source_bytes="9").load()
    assert {r["source_after"] for r in small.collect()} == {"a\nb\nc\nd\n", None, "y", "--- a\n", "1\n"} or small.where("length(source_after) > 8").count() == 0
    with pytest.raises(Exception, match="git|returned non-zero"):
        read.option("since", "nosuchcommit").load().collect()


def test_blame_of_removed_lines(spark, repo):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,4 +3,3 @@ def f\n a\n-b\n-c\n+d\n e\n@@ -20,2 +19,3 @@\n-q\n r\n+s\n\\ No newline at end of file"
    assert git_log.removed_spans(diff) == [(4, 2), (20, 1)] and git_log.removed_spans("") == []
    spark.dataSource.register(git_log.GitLog)
    rows = spark.read.format("git_log").options(repos=str(repo.path), diff="true").load()
    got = {(r["fix"], r["path"], r["intro"]) for r in git_log.blame_lines(rows).collect()}
    h = repo.hashes
    # removed lines of the two texts, of the text that was deleted after its move, and of the link
    moved_by = {x for f, p, x in got if (f, p) == (h[3], "sub/z.txt")}
    assert (h[1], ODD, h[0]) in got and (h[5], "link", h[4]) in got and moved_by <= {h[0], h[1]} and moved_by
    spark.dataSource.register(git_log.GitBlame)
    assert [(r["path"], r["intro"]) for r in spark.read.format("git_blame").options(repos=str(repo.path), fixes=h[1]).load().collect()] == [(ODD, h[0])]


def test_the_chain_over_a_repository(spark, tmp_path):
    r = Repo(tmp_path)
    r.commit("Add files", **{"src/a.py": code(40), "src/b.py": code(40), "src/c.py": code(10), "tests/test_a.py": code(20), "notes/n.md": "text\n" * 20, "old/m.py": code(30)})
    r.commit("Fix crash in a", **{"src/a.py": code(40, 1, 2, 3), "tests/test_a.py": code(20, 1, 2, 3), "notes/n.md": "word\n" * 20})
    r.commit("Fix a typo bug", **{"src/b.py": code(40, 1, 2, 3, 4)})  # to be ignored
    r.commit("Fix b", **{"src/b.py": code(40, 1, 2, 3, 4, 7)})  # one line
    r.commit("Fix issue of a again", **{"src/a.py": code(40, 9, 10, 11)})
    r.commit("Fix c by lines at its end", **{"src/c.py": code(10) + code(9, 5)})  # nothing is removed
    r.write("old/m.py", None)
    r.commit("Fix the place of m", **{"new/m.py": code(30, 4, 5, 6)})
    for i in range(25):
        r.write(f"many/f{i}.py", code(9))
    r.commit("Fix everything", **{"src/a.py": code(40, 20, 21, 22)})
    chain = szz.szz_chain(szz.commit_rows(spark, [str(r.path)])).select("msg", "path", "reason").collect()
    reasons = {(x["msg"], x["path"]): x["reason"] for x in chain}
    assert reasons["Add files", "src/a.py"] == "not_fix" and reasons["Fix a typo bug", "src/b.py"] == "not_fix"
    assert reasons["Fix crash in a", "src/a.py"] == "kept" and reasons["Fix crash in a", "tests/test_a.py"] == "test" and reasons["Fix crash in a", "notes/n.md"] == "extension"
    assert reasons["Fix b", "src/b.py"] == "trivial" and reasons["Fix c by lines at its end", "src/c.py"] == "blame"
    assert reasons["Fix the place of m", "old/m.py"] == "kept" and reasons["Fix everything", "src/a.py"] == "files"
    labels = {x["path"]: x for x in szz.szz_from_git(spark, [str(r.path)]).collect()}
    assert labels.keys() == {"src/a.py", "old/m.py"}
    assert (labels["src/a.py"]["confidence"], labels["src/a.py"]["bug_count"]) == (1.0, 2) and labels["src/a.py"]["messages"] == ["Fix crash in a", "Fix issue of a again"]
    assert labels["old/m.py"]["confidence"] == 0.7
    last = szz.szz_chain(szz.commit_rows(spark, [str(r.path)]), window_days=2).where("reason = 'kept'").collect()
    assert {x["path"] for x in last} == {"old/m.py"}


def test_identities_over_moves(spark):
    steps = [
        (0, None, "a", "A"), (1, "a", "a", "M"), (2, "a", "b", "R"), (3, "b", "b", "M"), (3, None, "a", "A"), (4, "b", "c", "R"), (5, "c", "d", "R"), (6, "d", "d", "M"),
        (7, "a", None, "D"), (8, None, "a", "A"), (9, "a", "e", "R"), (10, "d", "a", "R"), (11, "a", "a", "M"), (12, "old", "old", "M"), (13, "old", "new", "R"), (14, "e", "f", "C"), (15, "f", "f", "M"), (16, "e", None, "D"),
    ]
    # two files change places
    steps += [(20, None, "p", "A"), (20, None, "q", "A"), (21, "p", "q", "R"), (21, "q", "p", "R"), (22, "p", "p", "M")]
    chain = [(100 + i, f"m{i}", f"m{i + 1}", "R") for i in range(40)]
    df = spark.createDataFrame([("r", *s) for s in [*steps, (99, None, "m0", "A"), *chain]], "repo string, seq long, old_path string, new_path string, change string").repartition(3)
    rows = szz.file_identities(df).collect()
    assert len(rows) == len(steps) + 41
    ids = {(r["seq"], r["old_path"], r["new_path"]): (r["file_id"]["path"], r["file_id"]["begin"]) for r in rows}
    one = {ids[0, None, "a"], ids[1, "a", "a"], ids[2, "a", "b"], ids[3, "b", "b"], ids[4, "b", "c"], ids[5, "c", "d"], ids[6, "d", "d"], ids[10, "d", "a"], ids[11, "a", "a"]}
    assert one == {("a", 10)}
    assert ids[3, None, "a"] == ids[7, "a", None] == ("a", 3) and ids[8, None, "a"] == ids[9, "a", "e"] == ids[16, "e", None] == ("e", 9)
    assert ids[12, "old", "old"] == ids[13, "old", "new"] == ("new", 13) and ids[14, "e", "f"] == ids[15, "f", "f"] == ("f", 14)
    assert ids[20, None, "p"] == ids[21, "p", "q"] == ("q", 21) and ids[20, None, "q"] == ids[22, "p", "p"] == ("p", 21)
    assert {v for k, v in ids.items() if k[0] >= 99} == {("m40", 139)}
    assert szz.file_identities(df.limit(0)).count() == 0


def test_a_stream_takes_only_new_commits(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).mkdir()
    a, b = Repo(tmp_path / "a"), Repo(tmp_path / "b")
    a.commit("one", **{"x.py": "1\n"})
    a.commit("two", **{"x.py": "2\n", "y.py": "1\n"})
    b.commit("first", **{"z.py": "1\n"})
    spark.dataSource.register(git_log.GitLog)
    work = f"file://{tmp_path}/work"

    def drained():
        stream = spark.readStream.format("git_log").options(repos=f"{a.path},{b.path}", sources="true").load()
        query = stream.writeStream.option("checkpointLocation", f"{work}/offsets").format("parquet").option("path", f"{work}/out").start()
        query.processAllAvailable()
        query.stop()
        return sorted(((r["msg"], r["new_path"], r["seq"], r["source_after"]) for r in spark.read.parquet(f"{work}/out").collect()), key=repr)

    begun = [("first", "z.py", 0, "1\n"), ("one", "x.py", 0, "1\n"), ("two", "x.py", 1, "2\n"), ("two", "y.py", 1, "1\n")]
    assert drained() == begun
    a.commit("three", **{"y.py": "3\n"})
    assert drained() == sorted([*begun, ("three", "y.py", 2, "3\n")], key=repr)
    assert len(drained()) == 5  # nothing new, nothing twice
    b.commit("second", **{"z.py": None, "w.py": "5\n" * 7})
    assert len(drained()) == 7
