"""Spans of DOCX and PDF files as a data source: format "span_files" of the Python data source interface, for tables and streams.

    spark.dataSource.register(SpanFiles)
    spark.read.format("span_files").option("partitionBytes", 64 << 20).load("file:///in").where("format = 'docx'")
    spark.readStream.format("span_files").load("file:///in")

A row is a span with the path and format of its file, or the error of a file that can't be read. Files are listed once, by the driver, and dealt to
partitions by their bytes, largest first. Filters on path and format (equality, IN, beginnings) choose files before any is opened, where
spark.sql.python.filterPushdown.enabled is on. The stream's offset is the time and path of the newest file that was taken, so files must
come with rising modification times; a file that is written anew later is read again. Paths are those that pyarrow's file
systems reach; what only Spark reads goes through ingest.load_files().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from ..schema import SPAN
from .extraction import as_struct, attempt
from .files import NEEDS_OCR, read_any
from .text_files import place

SCHEMA = f"path string, format string, error string, span {SPAN}"
FORMATS = {".docx": "docx", ".pdf": "pdf"}
PARTITION_BYTES = 64 << 20


@dataclass(frozen=True)
class File:
    path: str
    size: int
    seen: int
    """Modification time in nanoseconds."""

    @property
    def format(self) -> str | None:
        return FORMATS.get(self.path[self.path.rfind(".") :].lower())


@dataclass
class Files(InputPartition):
    files: list[File]


def listed(path: str) -> list[File]:
    """Files of a known format at or below a path, by path."""
    files, root = place(path)
    found = files.get_file_info(root)
    infos = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
    out = [File(i.path, i.size, i.mtime_ns) for i in infos if i.type == fs.FileType.File]
    return sorted((f for f in out if f.format), key=lambda f: f.path)


def dealt(files: list[File], most: int) -> list[Files]:
    """Files in as few partitions as hold their bytes, largest first; a file of over `most` bytes has its own."""
    n = max(1, -(-sum(f.size for f in files) // most))
    parts: list[list[File]] = [[] for _ in range(n)]
    room = [0] * n
    for f in sorted(files, key=lambda f: (-f.size, f.path)):
        k = min(range(len(room)), key=lambda k: room[k])
        if parts[k] and room[k] + f.size > most:
            parts.append([])
            room.append(0)
            k = len(parts) - 1
        parts[k].append(f)
        room[k] += f.size
    return [Files(p) for p in parts if p]


def rows_of(path: str, files: list[File], highlight_mode: str) -> Iterator[tuple]:
    """Rows of a partition, a file at a time."""
    system, _ = place(path)
    for f in files:
        try:
            with system.open_input_stream(f.path) as s:
                content = s.read()
        except OSError as e:
            yield f.path, f.format, f"{type(e).__name__}: {e}", None
            continue
        spans, info, error = attempt(lambda x: read_any(x, highlight_mode), content)
        if error is None and not spans and info.image_area > 0:
            error = NEEDS_OCR
        if error is not None:
            yield f.path, f.format, error, None
        else:
            for s in spans:
                yield f.path, f.format, None, as_struct(s)


class _Options:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.mode = options.get("highlightMode", "white")
        if self.most <= 0:
            raise ValueError("partitionBytes must be positive")


class SpanReader(_Options, DataSourceReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.chosen: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("path",), ("format",)):
                self.chosen.append(f)
            else:
                yield f

    def _wanted(self, file: File) -> bool:
        for f in self.chosen:
            value = getattr(file, f.attribute[0])
            if not (value in f.value if isinstance(f, In) else value.startswith(f.value) if isinstance(f, StringStartsWith) else value == f.value):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        return dealt([f for f in listed(self.path) if self._wanted(f)], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.files, self.mode)


class SpanStream(_Options, DataSourceStreamReader):
    """Offsets are (time, path) of the newest file taken."""

    def initialOffset(self) -> dict:
        return {"seen": -1, "path": ""}

    def latestOffset(self) -> dict:
        newest = max(((f.seen, f.path) for f in listed(self.path)), default=(-1, ""))
        return {"seen": newest[0], "path": newest[1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, last = ((o["seen"], o["path"]) for o in (start, end))
        return dealt([f for f in listed(self.path) if after < (f.seen, f.path) <= last], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.files, self.mode)


class SpanFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "span_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpanReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SpanStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("span_files") known, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpanFiles)
