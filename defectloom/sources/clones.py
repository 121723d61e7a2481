"""Repositories by address or path: what may be cloned, where to, and the command that does it."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may be cloned depends on these.
ALLOWED_HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
CLONE_DEPTH = 500
_NAME = r"[A-Za-z0-9_][A-Za-z0-9_.-]*"


def remote_verdict(address: Column, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    """``ok``, or why an address may not be cloned: ``scheme`` (not https), ``host`` (not listed), ``traversal`` (.. in its path), ``name`` (no owner and repository)."""
    a = F.coalesce(address, F.lit(""))
    host = F.lower(F.regexp_extract(a, r"^https://(?:[^/@]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(a, r"^https://[^/?#]*/([^?#]*)", 1)
    return (
        F.when(~F.lower(a).startswith("https://"), "scheme")
        .when(~host.isin(*hosts), "host")
        .when(F.array_contains(F.split(path, "/"), ".."), "traversal")
        .when(~path.rlike(rf"^{_NAME}/{_NAME}/?$"), "name")
        .otherwise("ok")
    )


def clone_or_local(source: str, folder: str, depth: int = CLONE_DEPTH, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> Path:
    """The path of a local repository as it is, or of a clone of ``source`` under ``folder``; a clone that is there is used again.

    Addresses outside ``hosts``, without https, or whose name would lie outside
    ``folder`` are refused before anything runs.
    """
    if (Path(source) / ".git").exists():
        return Path(source).resolve()
    parts = urlsplit(source)
    names = [x for x in parts.path.split("/") if x]
    if parts.scheme != "https" or (parts.hostname or "") not in hosts or len(names) != 2 or not all(re.fullmatch(_NAME, x) and x != ".." for x in names):
        raise ValueError(f"not a repository that may be cloned: {source}")
    base = Path(folder).resolve()
    target = (base / names[0] / names[1].removesuffix(".git")).resolve()
    if not target.is_relative_to(base) or target == base:
        raise ValueError(f"outside of the folder: {source}")
    if not (target / ".git").exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        subprocess.run(["git", "clone", "--quiet", "--depth", str(depth), "--no-single-branch", "--", source, str(target)], check=True)
    return target
