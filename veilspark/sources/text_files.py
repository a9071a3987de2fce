"""A text file for each row, written by the tasks themselves: format "text_files" of the Python data source interface.

    spark.dataSource.register(TextFiles)
    df.select("name", "text").write.format("text_files").mode("append").save("file:///out")

A task writes its files to a folder of its own under `_pending-<job>`, whose name holds the task and the attempt. The commit renames the
folders of the attempts that succeeded, one rename a task, and leaves `_SUCCESS`; the abort removes what is pending. So a job that fails
leaves no file, a repeated or speculative attempt is never mixed with another, and the driver sees a message a task and no text. The path may be
any that pyarrow's file systems reach and all machines share, on a file system that renames folders.

The same format reads what it wrote: a task a folder.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes and files that a reading task hands over together.
READ_BYTES, READ_FILES = 4 << 20, 1024


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


def place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/_pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = place(self.path)
        context = TaskContext.get()
        folder = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job[:8]}"
        at, n = f"{self._pending(root)}/{folder}", 0
        for name, text in iterator:
            if not name or name != os.path.basename(name) or name.startswith((".", "_")):
                raise ValueError(f"not the name of a file: {name!r}")
            if not n:
                files.create_dir(at)
            target = f"{at}/{name}"
            if files.get_file_info(target).type != fs.FileType.NotFound:
                raise ValueError(f"two rows have the name {name!r}")
            with files.open_output_stream(target) as out:
                out.write((text or "").encode())
            n += 1
        return Written(folder if n else "", n)

    def commit(self, messages: list[Written]) -> None:
        files, root = place(self.path)
        if self.overwrite and files.get_file_info(root).type == fs.FileType.Directory:
            for old in files.get_file_info(fs.FileSelector(root)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part-"):
                    files.delete_dir(old.path)
        files.create_dir(root)
        for m in messages:
            if m is not None and m.folder:
                files.move(f"{self._pending(root)}/{m.folder}", f"{root}/{m.folder}")
        self._clear(files, root)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*place(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            files.delete_dir(self._pending(root))


@dataclass
class Folder(InputPartition):
    path: str


class TextFilesReader(DataSourceReader):
    """Reads a writer's files again: a task a folder, which it lists itself, so that the driver sees folders and no files."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Folder]:
        files, root = place(self.path)
        return [Folder(x.path) for x in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda x: x.path) if x.type == fs.FileType.Directory and x.base_name.startswith("part-")]

    def read(self, partition: Folder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was written
            return
        files, _ = place(self.path)
        names: list[str] = []
        texts: list[str] = []
        held = 0
        for x in files.get_file_info(fs.FileSelector(partition.path)):
            with files.open_input_stream(x.path) as file:
                raw = file.read()
            names.append(x.base_name)
            texts.append(raw.decode())
            held += len(raw)
            if held >= READ_BYTES or len(names) >= READ_FILES:
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "text"])
                names, texts, held = [], [], 0
        if names:
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "text"])


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return TextFilesReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["name", "text"]:
            raise ValueError("columns name and text are needed")
        return TextFilesWriter(self.options["path"], overwrite)


def file_name(path: str = "path") -> Column:
    """A name for the text of the file at a path: its own, a hash of the whole path, and .txt."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[^A-Za-z0-9._-]|^[._]+", "_")
    return F.concat(F.regexp_replace(F.substring(base, 1, 120), "^[._]+", ""), F.lit("-"), F.lower(F.hex(F.xxhash64(path))), F.lit(".txt"))


def write_text_files(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """df (name, text) as a file a row under path."""
    spark = df.sparkSession
    spark.dataSource.register(TextFiles)
    df.select("name", "text").write.format("text_files").mode("overwrite" if overwrite else "append").save(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """name and text of the files that write_text_files() left under path."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("text_files").load(path)
