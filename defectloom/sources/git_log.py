"""Git repositories as tables and as streams, read through the ``git`` program where the repositories are.

``spark.dataSource.register(GitLog)``, then
``spark.read.format("git_log").option("repos", "/a,/b").load()`` or
``spark.readStream``. Merges are left out, commits come oldest first, files that
moved are told from those that were added. A repository's history is read in
parts of some thousand commits, side by side; git's output is read from its
pipe record by record, names and messages of any characters included.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COMMIT_FILES = "repo string, commit_id string, seq bigint, author string, commit_time timestamp, msg string, old_path string, new_path string, added bigint, deleted bigint, change string"
#: What a commit begins with; no record of a file does.
_MARK = b"\x1e"
_HEADER = "--format=%x1e%H%x00%an%x00%ct%x00%B%x00"
_NO_BLOB = b"0" * 40


def run_git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, errors="replace").stdout


def head_hash(repo: str) -> str:
    return run_git(repo, "rev-parse", "HEAD").strip()


def _span(since: str | None, until: str) -> list[str]:
    return ["--no-merges", f"{since}..{until}" if since else until]


def count_commits(repo: str, since: str | None, until: str) -> int:
    return int(run_git(repo, "rev-list", "--count", *_span(since, until)))


def _text(b: bytes | None) -> str | None:
    return None if b is None else b.decode("utf-8", "replace")


def _piped(repo: str, args: list[str], given: list[str], end: bytes) -> Iterator[bytes]:
    """What git writes, cut at ``end``, with ``given`` as its input; an error of git's is raised at the end."""
    with subprocess.Popen(["git", "-C", repo, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        p.stdin.write("".join(f"{x}\n" for x in given).encode())
        p.stdin.close()
        rest = b""
        while chunk := p.stdout.read(1 << 16):
            *whole, rest = (rest + chunk).split(end)
            yield from whole
        if rest:
            yield rest
        said = p.stderr.read()
        if p.wait():
            raise RuntimeError(f"git {args[0]} in {repo}: {_text(said)}")


class Change:
    """One file of one commit: its kind (A, D, M, R, C or T), blobs, paths and changed lines."""

    __slots__ = ("added", "deleted", "kind", "new_blob", "new_path", "old_blob", "old_path")

    def __init__(self, head: bytes, first: bytes, second: bytes | None):
        fields = head.lstrip(b":").split(b" ")
        self.old_blob, self.new_blob, self.kind = fields[2], fields[3], _text(fields[4][:1])
        # what was added has no old path, what was deleted no new one
        self.old_path = None if self.kind == "A" else first
        self.new_path = None if self.kind == "D" else second if second is not None else first
        self.added = self.deleted = 0


def commits(repo: str, hashes: list[str]) -> Iterator[tuple[str, str, datetime, str, list[Change]]]:
    """(hash, author, time, message, changes) of the commits in the order given; the changes of one commit are held at once."""
    records = _piped(repo, ["log", "--no-walk=unsorted", "--stdin", "-z", "--raw", "--numstat", "--find-renames", "--no-abbrev", _HEADER], hashes, b"\0")
    head = next(records, None)
    while head is not None:
        commit, author, when, msg = head.lstrip(b"\n")[1:], next(records), next(records), next(records)
        changes: list[Change] = []
        counted = 0
        for record in records:
            record = record.lstrip(b"\n")
            if record[:1] == _MARK:
                head = record
                break
            if record[:1] == b":":
                first = next(records)
                changes.append(Change(record, first, next(records) if record.rsplit(b" ", 1)[1][:1] in (b"R", b"C") else None))
            elif record:
                added, deleted, path = record.split(b"\t", 2)
                if not path:  # the names of a moved file follow
                    next(records), next(records)
                changes[counted].added, changes[counted].deleted = (int(x) if x.isdigit() else 0 for x in (added, deleted))
                counted += 1
        else:
            head = None
        yield _text(commit), _text(author), datetime.fromtimestamp(int(when), timezone.utc), _text(msg).strip(), changes


def patches(repo: str, hashes: list[str], context: int = 3) -> Iterator[list[str]]:
    """The patches of each commit's files, in the order of :func:`commits`; those of one commit are held at once."""
    lines = _piped(repo, ["log", "--no-walk=unsorted", "--stdin", "-p", f"--unified={context}", "--find-renames", "--format=%x1e%H"], hashes, b"\n")
    own: list[list[bytes]] | None = None
    for line in lines:
        if line[:1] == _MARK:  # lines of a file begin with a space, a sign or a word
            if own is not None:
                yield [_text(b"\n".join(x)) for x in own]
            own = []
        elif line.startswith(b"diff --git "):
            own.append([line])
        elif own:
            own[-1].append(line)
    if own is not None:
        yield [_text(b"\n".join(x)) for x in own]


class Blobs:
    """Texts by blob, through one ``git cat-file``; None for no blob, binary data, what is no file, and more than ``most`` bytes."""

    def __init__(self, repo: str, most: int):
        self._most = most
        self._git = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._git.stdin.close()
        self._git.stdout.close()
        self._git.wait()

    def __call__(self, blob: bytes) -> str | None:
        if blob == _NO_BLOB:
            return None
        self._git.stdin.write(blob + b"\n")
        self._git.stdin.flush()
        said = self._git.stdout.readline().split()
        if len(said) != 3:  # missing, as submodules' commits are
            return None
        left, data = int(said[2]) + 1, []
        keep = left <= self._most and said[1] == b"blob"
        while left:
            part = self._git.stdout.read(min(left, 1 << 20))
            left -= len(part)
            if keep:
                data.append(part)
        text = b"".join(data)[:-1]
        return None if not keep or b"\0" in text[:8000] else _text(text)


class _Part(InputPartition):
    """``count`` commits of a repository from the ``first`` on, of those after ``since`` up to ``until``; ``seq`` is the number of the first."""

    def __init__(self, repo: str, since: str | None, until: str, first: int, count: int, seq: int):
        self.repo, self.since, self.until, self.first, self.count, self.seq = repo, since, until, first, count, seq


class GitLog(DataSource):
    """One row for each commit and changed file.

    Options: ``repos`` (comma separated), ``since`` (a commit), ``diff`` and
    ``sources`` (``true`` adds the columns diff, and source_before and
    source_after), ``max_source_bytes`` (larger texts are null; 16 MB),
    ``commits_per_part`` (5000). old_path is null for an added file, new_path
    for a deleted one; a moved file (change R) has both. Lines of binary files
    count as 0. ``seq`` numbers a repository's commits from the oldest.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def _wants(self, what: str) -> bool:
        return str(self.options.get(what, "")).lower() == "true"

    def schema(self) -> str:
        return COMMIT_FILES + (", diff string" if self._wants("diff") else "") + (", source_before string, source_after string" if self._wants("sources") else "")

    def reader(self, schema):
        return GitLogReader(self.options, self._wants("diff"), self._wants("sources"))

    def streamReader(self, schema):  # noqa: N802
        return GitLogStreamReader(self.options, self._wants("diff"), self._wants("sources"))


class _History:
    """What the batch and the stream reader share."""

    def __init__(self, options, diff: bool = False, sources: bool = False):
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.since = options.get("since")
        self.diff, self.sources = diff, sources
        self.most = int(options.get("max_source_bytes", 16 << 20))
        self.part = max(1, int(options.get("commits_per_part", 5000)))

    def parts(self, repo: str, since: str | None, until: str) -> list[_Part]:
        """Parts of a fixed span, so that commits made meanwhile, and repeated tasks, change nothing."""
        before = count_commits(repo, None, since) if since else 0
        n = count_commits(repo, since, until)
        return [_Part(repo, since, until, at, min(self.part, n - at), before + at) for at in range(0, n, self.part)]

    def read(self, partition):
        p = partition
        hashes = run_git(p.repo, "rev-list", "--reverse", *_span(p.since, p.until)).split()[p.first : p.first + p.count]
        own_patches = patches(p.repo, hashes) if self.diff else None
        with Blobs(p.repo, self.most) as blobs:
            for seq, (commit, author, time, msg, changes) in enumerate(commits(p.repo, hashes), p.seq):
                texts = next(own_patches) if self.diff else []
                at = 0
                for c in changes:
                    row = [p.repo, commit, seq, author, time, msg, _text(c.old_path), _text(c.new_path), c.added, c.deleted, c.kind]
                    if self.diff:
                        n = 2 if c.kind == "T" else 1  # a file that becomes a link, or the other way, is deleted and added
                        row.append("\n".join(texts[at : at + n]))
                        at += n
                    if self.sources:
                        row += [blobs(c.old_blob), blobs(c.new_blob)]
                    yield tuple(row)


class GitLogReader(_History, DataSourceReader):
    def partitions(self):
        return [p for r in self.repos for p in self.parts(r, self.since, head_hash(r))]


class GitLogStreamReader(_History, DataSourceStreamReader):
    """Offsets are each repository's last commit; a batch has the commits between two of them, so a restart takes only what is new."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {r: self.since or "" for r in self.repos}

    def latestOffset(self) -> dict:  # noqa: N802
        return {r: head_hash(r) for r in self.repos}

    def partitions(self, start: dict, end: dict):
        return [p for r in sorted(end) if start.get(r, "") != end[r] for p in self.parts(r, start.get(r) or None, end[r])]

    def commit(self, end: dict) -> None:
        """Nothing to let go: the repository keeps its commits."""


def removed_spans(diff: str) -> list[tuple[int, int]]:
    """(first line, number of lines) of the runs of lines that a patch removes, by their numbers before it."""
    spans: list[list[int]] = []
    line = None
    for x in diff.split("\n"):
        if x.startswith("@@ "):
            line = int(x.split(" ", 2)[1][1:].partition(",")[0])
        elif x.startswith("diff --git "):
            line = None
        elif line is None or x[:1] == "\\":
            continue
        elif x[:1] == "-":
            if spans and sum(spans[-1]) == line:
                spans[-1][1] += 1
            else:
                spans.append([line, 1])
            line += 1
        elif x[:1] == " ":
            line += 1
    return [(a, n) for a, n in spans]


def blamed_commits(repo: str, commit: str, path: str, spans: list[tuple[int, int]]) -> list[str]:
    """The commits that last wrote these lines of ``path`` before ``commit``, each once, in the order of the lines; one blame for all lines."""
    if not spans:
        return []
    ranges = [x for a, n in spans for x in ("-L", f"{a},+{n}")]
    out = run_git(repo, "blame", "-s", "-l", "--root", *ranges, f"{commit}^", "--", path)
    return list(dict.fromkeys(line.split()[0] for line in out.splitlines()))


def blame_lines(changes: DataFrame) -> DataFrame:
    """Rows (repo, fix, path, intro): the commits that wrote the lines which ``changes`` (repo, commit_id, old_path, diff) removed, once for each file.

    Added files and changes that remove nothing have no row. Files are blamed
    side by side, each by one git where its repository is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str, str]] = []
            for repo, commit, path, diff in zip(*(c.to_pylist() for c in batch.columns)):
                if path is not None and diff:
                    out += [(repo, commit, path, x) for x in blamed_commits(repo, commit, path, removed_spans(diff))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["repo", "fix", "path", "intro"])

    rows = changes.select("repo", "commit_id", "old_path", "diff").repartition("repo", "commit_id", "old_path")
    return rows.mapInArrow(run, "repo string, fix string, path string, intro string")


class GitBlame(DataSource):
    """Commits that wrote the lines which fix commits removed: rows (repo, fix, path, intro); options ``repos`` and ``fixes``. For many fixes see :func:`blame_lines`."""

    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return "repo string, fix string, path string, intro string"

    def reader(self, schema):
        return GitBlameReader(self.options)


class _Fix(InputPartition):
    def __init__(self, repo: str, fix: str):
        self.repo, self.fix = repo, fix


class GitBlameReader(DataSourceReader):
    def __init__(self, options):
        self.repos = [r for r in options.get("repos", "").split(",") if r]
        self.fixes = [f for f in options.get("fixes", "").split(",") if f]

    def partitions(self):
        return [_Fix(r, f) for r in self.repos for f in self.fixes]

    def read(self, partition):
        repo, fix = partition.repo, partition.fix
        for (*_, changes), texts in zip(commits(repo, [fix]), patches(repo, [fix], context=0)):
            at = 0
            for c in changes:
                if c.old_path is not None:
                    path = _text(c.old_path)
                    for intro in blamed_commits(repo, fix, path, removed_spans(texts[at])):
                        yield repo, fix, path, intro
                at += 2 if c.kind == "T" else 1
