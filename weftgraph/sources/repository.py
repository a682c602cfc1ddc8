"""A source repository as a table of files: a batch data source that reads one top folder per task.

``spark.read.format("source_repository").load(root)``. Names that begin with a dot or an underscore
are read too, which Spark's own file sources leave out.
"""

from __future__ import annotations

import fnmatch
import hashlib
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is never part of a repository's own source.
IGNORED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "*.pyc", "*.min.js", "*.lock")
MAX_BYTES = 1_500_000
SCHEMA = "repo_id string, path string, size long, mtime double, content_hash string, indexed_at string, content string"


def ignore_pattern(root: str) -> re.Pattern[str]:
    """One pattern for the default globs and the lines of the root's .gitignore; negations and comments are passed over."""
    globs = list(IGNORED)
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8", errors="replace") as lines:
            globs += [x.strip().strip("/") for x in lines if x.strip() and x.lstrip()[0] not in "#!"]
    except OSError:
        pass
    return re.compile("|".join(fnmatch.translate(g) for g in globs))


def is_ignored(path: str, pattern: re.Pattern[str]) -> bool:
    parts = path.split("/")
    return any(pattern.match(p) for p in parts) or any(pattern.match("/".join(parts[:n])) for n in range(1, len(parts) + 1))


def repo_id(root: str) -> str:
    name = re.sub(r"[^a-zA-Z0-9_.-]+", "-", os.path.basename(os.path.abspath(root))).strip("-").lower() or "repo"
    return f"{name}-{hashlib.blake2b(os.path.abspath(root).encode(), digest_size=6).hexdigest()}"


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.path, self.deep = path, deep


class SourceRepository(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options["path"])


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = os.path.abspath(root)

    def partitions(self) -> list[InputPartition]:
        pattern = ignore_pattern(self.root)
        folders = [e.name for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and not is_ignored(e.name, pattern)]
        return [Folder("", False), *(Folder(f, True) for f in sorted(folders))]

    def read(self, partition: Folder) -> Iterator[tuple]:
        pattern, own, now = ignore_pattern(self.root), repo_id(self.root), datetime.now(timezone.utc).isoformat()
        for folder, names, files in os.walk(os.path.join(self.root, partition.path)):
            at = os.path.relpath(folder, self.root).replace(os.sep, "/").removeprefix(".").lstrip("/") if folder != self.root else ""
            names[:] = sorted(n for n in names if not is_ignored(f"{at}/{n}".lstrip("/"), pattern)) if partition.deep else []
            for name in sorted(files):
                path = f"{at}/{name}".lstrip("/")
                full = os.path.join(folder, name)
                if is_ignored(path, pattern) or os.path.islink(full):
                    continue
                stat = os.stat(full)
                if stat.st_size > MAX_BYTES:
                    continue
                with open(full, "rb") as f:
                    data = f.read()
                if b"\0" in data[:4096]:
                    continue
                text = data.decode("utf-8", "replace")
                yield own, path, stat.st_size, stat.st_mtime, hashlib.sha256(text.encode()).hexdigest(), now, text
