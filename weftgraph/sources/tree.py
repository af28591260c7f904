"""A source tree as a DataFrame: (path, language, content, hash, last_modified), a row for each file of a known language.

Spark's own file sources hide names that begin with _ or ., and with them __init__.py; this one doesn't.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.scalars import IGNORED_DIRS, LANGUAGES

SCHEMA = "path string, language string, content string, hash string, last_modified double"


def language_of(path: str) -> str | None:
    stem, dot, extension = os.path.basename(path).rpartition(".")
    return LANGUAGES.get(extension) if dot and stem else None


def walk(root: str) -> Iterator[str]:
    """Paths below root, links followed once, ignored directories pruned, in order; what can't be listed is skipped."""
    seen: set[str] = set()
    for folder, dirs, names in os.walk(root, followlinks=True):
        real = os.path.realpath(folder)
        if real in seen:
            dirs[:] = []
            continue
        seen.add(real)
        dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS and not d.startswith("."))
        for name in sorted(names):
            path = os.path.relpath(os.path.join(folder, name), root)
            if language_of(path):
                yield path


def confined(path: str, root: str) -> str:
    """The real path, which must be root or below it."""
    real, top = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if real != top and not real.startswith(top + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return real


def modified(path: str) -> float:
    try:
        return os.stat(path).st_mtime
    except OSError:
        return 0.0


def row(root: str, path: str) -> tuple | None:
    """None for a file that is gone or isn't UTF-8."""
    full = os.path.join(root, path)
    try:
        with open(full, "rb") as f:
            data = f.read()
        return (path, language_of(path), data.decode(), hashlib.sha256(data).hexdigest(), modified(full))
    except (OSError, UnicodeDecodeError):
        return None


@dataclass
class Paths(InputPartition):
    paths: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("filesPerPartition", "64"))
        self.only = json.loads(options["only"]) if "only" in options else None

    def partitions(self) -> list[Paths]:
        paths = list(walk(self.root)) if self.only is None else self.only
        return [Paths(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path in partition.paths:
            if (found := row(self.root, path)) is not None:
                yield found


def changed_at(path: str) -> int:
    """When content, name or place of a file last changed, in nanoseconds; 0 if it is gone."""
    try:
        own = os.lstat(path)
    except OSError:
        return 0
    return max(own.st_mtime_ns, own.st_ctime_ns)


class TreeStreamReader(DataSourceStreamReader):
    """Polls the tree. An offset is the time of the newest change to a file or folder below root, so nothing is kept
    between polls and a restart goes on from the checkpoint. The first batch has all files. A file that goes changes its
    folder: a batch without rows."""

    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("filesPerPartition", "64"))

    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        folders = {self.root, *(os.path.dirname(os.path.join(self.root, p)) for p in walk(self.root))}
        files = (os.path.join(self.root, p) for p in walk(self.root))
        return {"ns": max([changed_at(f) for f in folders] + [changed_at(f) for f in files])}

    def partitions(self, start: dict, end: dict) -> list[Paths]:
        paths = [p for p in walk(self.root) if start["ns"] < changed_at(os.path.join(self.root, p)) <= end["ns"]]
        return [Paths(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        return (found for p in partition.paths if (found := row(self.root, p)) is not None)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


def read_tree(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """All files, or those of the given paths."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("sourcetree")
    return (reader if only is None else reader.option("only", json.dumps(only))).load(root)


def stream_tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("sourcetree").load(root)


def git_changed(root: str, last_commit: str | None) -> list[str] | None:
    """Paths below root that differ from last_commit or aren't committed; None where version control can't tell."""

    def git(*args: str) -> list[str] | None:
        try:
            done = subprocess.run(["git", "-C", root, *args], stdin=subprocess.DEVNULL, capture_output=True, text=True, timeout=60)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.splitlines() if done.returncode == 0 else None

    if not last_commit or git("cat-file", "-t", last_commit) != ["commit"]:
        return None
    lists = [git("diff", "--name-only", "--relative", f"{last_commit}..HEAD"), git("ls-files", "--others", "--exclude-standard"), git("diff", "--name-only", "--relative"), git("diff", "--name-only", "--relative", "--cached")]
    return None if None in lists else sorted({p for own in lists for p in own})


def git_head(root: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], stdin=subprocess.DEVNULL, capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None
