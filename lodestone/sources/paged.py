"""Files read page by page as a Python data source: a partition for each range of pages (of several, where there are many), filters on pages and files pushed down.

A page reader is any object with

* ``index(file)``: the number of pages, or where each page begins and the last one ends, in bytes;
* ``page(file, n, span)``: the text of page n, from 1; span is its (begin, end) in bytes where the index has them.

``file`` is a seekable binary file of pyarrow's file systems (local, HDFS, S3, GCS), opened where the range is read, so no
content goes through a shuffle or the driver, and a reader that knows byte positions reads its own pages only. Planning
indexes every file once, some at a time; a format with a page table has that read alone, plain text is streamed through in
fixed blocks. Filters that compare ``page`` or ``file_path`` with values leave out files before they are indexed, and ranges
before they are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

PER_TASK, BLOCK, THREADS = 16, 1 << 20, 16
#: Ranges beyond this number share tasks.
TASKS = 512
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class TextPages:
    """Pages of a text file: `lines` lines each, cut at line feeds."""

    def __init__(self, lines: int = 55):
        self.lines = lines

    def index(self, file) -> list[int]:
        starts, at, seen = [0], 0, 0
        while block := file.read(BLOCK):
            k = block.find(b"\n")
            while k >= 0:
                seen += 1
                if seen % self.lines == 0:
                    starts.append(at + k + 1)
                k = block.find(b"\n", k + 1)
            at += len(block)
        return starts if starts[-1] == at and at else [*starts, at]

    def page(self, file, n: int, span: tuple[int, int]) -> str:
        file.seek(span[0])
        return bytes(file.read(span[1] - span[0])).decode("utf-8", "replace")


class WholeContent:
    """A reader from two functions of a file's content: count(content) and page(content, n)."""

    def __init__(self, count, page):
        self.count, self.one, self.held = count, page, None

    def index(self, file) -> int:
        return self.count(bytes(file.read()))

    def page(self, file, n: int, span=None) -> str:
        if self.held is None or self.held[0] is not file:  # read once for all pages of a range
            file.seek(0)
            self.held = (file, bytes(file.read()))
        return self.one(self.held[1], n)


def file_system(path: str):
    """(file system, path in it) of a URI or a local path."""
    import os

    from pyarrow import fs

    if path.startswith("file:"):
        path = path.removeprefix("file:")
        path = "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, folder or pattern names, in order. Names that begin with a dot or an underscore are left out."""
    from fnmatch import fnmatch

    from pyarrow import fs

    system, at = file_system(path)
    hidden = lambda p, base: any(x[:1] in "._" and "=" not in x for x in p[len(base) :].strip("/").split("/"))
    wild = next((k for k, c in enumerate(at) if c in "*?["), None)
    if wild is None and system.get_file_info(at).type == fs.FileType.File:
        return [(at, system.get_file_info(at).size)]
    base = at if wild is None else at[:wild].rpartition("/")[0]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path, base) and (wild is None or fnmatch(f.path, at)))


@dataclass
class Pages(InputPartition):
    """Pages first to last of a file; starts: where they begin and the last one ends, or nothing."""

    path: str
    first: int
    last: int
    starts: list[int]


@dataclass
class Together(InputPartition):
    """Ranges that one task reads one after another."""

    ranges: list[Pages]


class PageRanges(DataSourceReader):
    def __init__(self, path: str, reader, fallback=None, start: int | None = None, end: int | None = None, per_task: int = PER_TASK, empty_files: bool = True):
        self.path, self.reader, self.fallback, self.start, self.end, self.per_task, self.empty_files = path, reader, fallback, start, end, per_task, empty_files
        self.tests: list[tuple[str, str, object]] = []

    def _either(self, what: str, file, *args):
        try:
            return getattr(self.reader, what)(file, *args)
        except Exception:
            if self.fallback is None:
                raise
            file.seek(0)
            return getattr(self.fallback, what)(file, *args)

    def _passes(self, column: str, value) -> bool:
        for c, how, want in self.tests:
            if c == column and not {"eq": lambda: value == want, "gt": lambda: value > want, "ge": lambda: value >= want, "lt": lambda: value < want, "le": lambda: value <= want, "in": lambda: value in want}[how]():
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, _ = file_system(self.path)

        def ranges(f: tuple[str, int]) -> list[Pages]:
            path, size = f
            if not self._passes("file_path", path) or not (size or self.empty_files):
                return []
            with system.open_input_file(path) as file:
                index = self._either("index", file)
            starts = index if isinstance(index, list) else []
            total = max(0, len(starts) - 1) if starts else int(index)
            lo, hi = max(1, self.start or 1), min(total, self.end or total)
            lo, hi = (1, total) if lo > hi else (lo, hi)
            wanted = [n for n in range(lo, hi + 1) if self._passes("page", n)]
            out: list[Pages] = []
            for n in wanted:
                if out and n == out[-1].last + 1 and n < out[-1].first + self.per_task:
                    out[-1].last = n
                else:
                    out.append(Pages(path, n, n, []))
            for p in out:
                p.starts = starts[p.first - 1 : p.last + 1]
            return out

        with ThreadPoolExecutor(THREADS) as pool:
            found = [p for held in pool.map(ranges, listed(self.path)) for p in held]
        if len(found) <= TASKS:
            return found
        # many small files: neighbouring ranges share a task, by their pages
        every, out, ahead = sum(p.last - p.first + 1 for p in found), [], 0
        for p in found:
            at = ahead * TASKS // every
            if out and out[-1][0] == at:
                out[-1][1].ranges.append(p)
            else:
                out.append((at, Together([p])))
            ahead += p.last - p.first + 1
        return [t for _, t in out]

    def read(self, partition: Pages | Together) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for p in partition.ranges if isinstance(partition, Together) else [partition]:
            with system.open_input_file(p.path) as file:
                for n in range(p.first, p.last + 1):
                    k = n - p.first
                    span = (p.starts[k], p.starts[k + 1]) if p.starts else None
                    yield p.path, n, self._either("page", file, n, span)


class PushedPageRanges(PageRanges):
    """The same reader for sessions that push filters down to Python sources."""

    KINDS = {EqualTo: "eq", EqualNullSafe: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("page", "file_path") and isinstance(f, IsNotNull):
                continue  # neither is ever null
            how = self.KINDS.get(type(f))
            if column in ("page", "file_path") and how and getattr(f, "value", None) is not None:
                self.tests.append((column, how, f.value))
            else:
                yield f


def source(reader, fallback=None, start: int | None = None, end: int | None = None, per_task: int = PER_TASK, empty_files: bool = True, name: str = "page_ranges", pushed: bool = True):
    """A data source class over a page reader: (file_path, page, text)."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "file_path string, page int, text string"

        def reader(self, schema) -> DataSourceReader:
            return (PushedPageRanges if pushed else PageRanges)(self.options["path"], reader, fallback, start, end, per_task, empty_files)

    return Source


def read(spark: SparkSession, path: str, reader=None, **options) -> DataFrame:
    """(file_path, page, text) of paged files; turns the session's filter pushdown to Python sources on."""
    spark.conf.set(PUSHDOWN, "true")
    made = source(reader or TextPages(), **options)
    spark.dataSource.register(made)
    return spark.read.format(made.name()).option("path", path).load()
