"""Connector plug-in point: a PySpark Python data source over landed provider API pages.

Each line of a landed file is one API response page (GitHub ``{"tree": [...]}``, GitLab ``[...]``,
Bitbucket ``{"values": [...]}``) wrapped as ``{"repo_id", "provider", "ref", "page"}``. The batch
reader cuts every file into byte ranges of ``split_bytes``; a range reads the lines that begin in it,
so a large file is read by many tasks and a page is bounded by the provider's page size. Rows are
unified manifest entries of files; include / exclude globs, and with the option ``pushdown`` (and
``spark.sql.python.filterPushdown.enabled``) filters as well, are applied before they leave Python.

    spark.dataSource.register(RepoDumpSource)
    spark.read.format("repodump").option("path", folder).option("include", "src/**/*").load()
    spark.readStream.format("repodump").option("path", folder).load()

The stream reader's offset is a file name and a byte position in it. Files are landed under ascending
names, and only the last one grows; so the offset says what is read however many files there are, and
a restart reads each line once. Lines without their line end yet are left for later.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In,
                                    InputPartition, StringStartsWith)

from ..functions.paths import glob_to_regex
from ..schemas import MANIFEST

SPLIT_BYTES = 64 << 20
#: Rows of an Arrow batch that a task gives.
ROWS = 10_000
_ARROW = pa.schema([("repo_id", pa.string()), ("provider", pa.string()), ("path", pa.string()), ("entry_type", pa.string()),
                    ("sha", pa.string()), ("size", pa.int64()), ("ref", pa.string())])


class _Range(InputPartition):
    """Lines of a file that begin at a byte from ``start`` to before ``stop``."""

    def __init__(self, path: str, start: int, stop: int):
        super().__init__(path)
        self.path, self.start, self.stop = path, start, stop


def _compile(globs: str | None):
    """One pattern per glob; a glob that matches everything stays one that does."""
    return [re.compile(glob_to_regex(g.strip()).replace(r"\z", r"\Z")) for g in (globs or "").split(",") if g.strip()]


def _file_system(path: str):
    """File system and path in it (local, HDFS or object-store paths, through pyarrow)."""
    from pyarrow import fs as pafs
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def _files(root: str) -> list[tuple[str, int]]:
    """Name and size of the data files below ``root``, by name. Only names are listed on the driver."""
    from pyarrow import fs as pafs
    filesystem, at = _file_system(root)
    infos = filesystem.get_file_info(pafs.FileSelector(at, recursive=True))
    scheme = root.split("://", 1)[0] + "://" if "://" in root and not root.startswith("file:") else ""
    return sorted((scheme + i.path, i.size) for i in infos
                  if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")))


def _splits(path: str, start: int, stop: int, piece: int) -> list[_Range]:
    return [_Range(path, x, min(x + piece, stop)) for x in range(start, stop, piece)]


def _lines(stream, start: int, stop: int, piece: int = 1 << 20) -> Iterator[bytes]:
    """Lines that begin in the range, cut at newlines only; one piece and one line are in memory."""
    at, rest = start, b""
    if start:
        # The line that reaches over the start belongs to the range before it.
        stream.seek(start - 1)
        at, first = start - 1, True
    else:
        first = False
    while at < stop or rest:
        block = stream.read(piece)
        if not block:
            break
        *whole, rest_now = (rest + block).split(b"\n")
        for line in whole:
            if first:
                first = False
            elif at >= stop:
                return
            else:
                yield line
            at += len(line) + 1
        rest = rest_now
        if at >= stop:
            return
    if rest and not first and at < stop:
        yield rest


class _Pages:
    """Pages of a range as batches of manifest rows."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.include = options.get("include")
        self.exclude = options.get("exclude")
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.equal: dict[str, set] = {}
        self.starts: list[str] = []

    def rows(self, part: _Range) -> Iterator[pa.RecordBatch]:
        inc = _compile(self.include) or [re.compile(r"(?s)^.*\Z")]
        exc = _compile(self.exclude)
        filesystem, path = _file_system(part.path)
        held: list[tuple] = []
        with filesystem.open_input_file(path) as fh:
            for line in _lines(fh, part.start, part.stop):
                if line.strip():
                    held.extend(self._entries(json.loads(line), inc, exc))
                if len(held) >= ROWS:
                    yield self._batch(held)
                    held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def _entries(self, doc: dict, inc, exc) -> Iterator[tuple]:
        provider, repo, ref = doc.get("provider"), doc.get("repo_id"), doc.get("ref")
        wanted = lambda column, value: column not in self.equal or value in self.equal[column]
        if not (wanted("provider", provider) and wanted("repo_id", repo)):
            return  # the whole page
        page = doc.get("page")
        if provider == "github":
            entries = (page or {}).get("tree", [])
        elif provider == "bitbucket":
            entries = (page or {}).get("values", [])
        else:
            entries = page or []
        for e in entries:
            if e.get("type") not in ("blob", "commit_file"):
                continue
            path = e.get("path")
            if path is None or not any(r.search(path) for r in inc) or any(r.search(path) for r in exc):
                continue
            if not wanted("path", path) or not all(path.startswith(s) for s in self.starts):
                continue
            sha = e.get("sha") if provider == "github" else (e.get("id") if provider == "gitlab" else None)
            size = e.get("size") if provider in ("github", "bitbucket") else None
            at = ((e.get("commit") or {}).get("hash") if provider == "bitbucket" else None) or ref
            if wanted("ref", at):
                yield (repo, provider, path, "file", sha, size, at)


class RepoDumpReader(_Pages, DataSourceReader):
    def partitions(self):
        return [r for name, size in _files(self.root) for r in _splits(name, 0, size, self.split)]

    def read(self, partition: _Range):
        yield from self.rows(partition)


class FilteringReader(RepoDumpReader):
    """With the option ``pushdown``. Spark keeps a relation's planned reader, filters and all, and may
    use it for the relation's next query: load a relation anew for each filter."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on repo_id, provider, ref and path, and prefixes of path, are applied here; the
        others are Spark's."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("repo_id", "provider", "ref", "path"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                values.discard(None)  # null equals nothing
                self.equal[column] = self.equal.get(column, values) & values
            elif isinstance(f, StringStartsWith) and column == "path":
                self.starts.append(f.value)
            else:
                yield f


class RepoDumpStreamReader(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        """The end of the last whole line of the last file."""
        files = _files(self.root)
        for name, size in reversed(files):
            end = self._last_line_end(name, size)
            if end or name == files[0][0]:
                return {"file": name, "at": end}
        return self.initialOffset()

    @staticmethod
    def _last_line_end(name: str, size: int, piece: int = 1 << 16) -> int:
        filesystem, path = _file_system(name)
        with filesystem.open_input_file(path) as fh:
            while size:
                start = max(0, size - piece)
                fh.seek(start)
                place = fh.read(size - start).rfind(b"\n")
                if place >= 0:
                    return start + place + 1
                size = start
        return 0

    def partitions(self, start: dict, end: dict):
        out = []
        for name, size in _files(self.root):
            if start["file"] <= name <= end["file"]:
                first = start["at"] if name == start["file"] else 0
                out += _splits(name, first, end["at"] if name == end["file"] else size, self.split)
        return out

    def read(self, partition: _Range):
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        """Landed files stay; nothing to release."""


class RepoDumpSource(DataSource):
    @classmethod
    def name(cls):
        return "repodump"

    def schema(self):
        return MANIFEST

    def reader(self, schema):
        pushdown = str(self.options.get("pushdown", "false")).lower() == "true"
        return FilteringReader(self.options) if pushdown else RepoDumpReader(self.options)

    def streamReader(self, schema):
        return RepoDumpStreamReader(self.options)
