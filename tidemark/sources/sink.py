"""Committed writing of files: a data source whose tasks stage their files and move them into place only when all are written.

``write_files(rows, "hdfs://.../clean", "name", "cleaned")`` writes each row's bytes to its name below the folder, on any file system that
Arrow knows by its address.  A null content is skipped; an empty one gives an empty file.

* A task writes below ``_staging-<job>`` in the folder.  When it has written all its rows, it moves them; a reader never sees part of a file, and
  a task that fails before leaves nothing but staged files.  Commit and abort remove the staging folder, whatever attempts and lost executors
  left there; commit then writes ``_SUCCESS``.  The driver makes the staging folder, and tasks never do, so an attempt that is still running
  or only begins when the job has ended fails instead of staging files again.
* Files that are there already are never replaced.  Equal bytes are taken as written by an earlier attempt; other bytes are an error.
* Only counts go to the driver.  So a job that is aborted keeps the whole files of tasks that had ended, and running it again completes them.
* Names must differ (``packages.unique_names``) and stay below the folder; an empty one, one with ``..`` or an absolute one is an error.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.session import ship

CHUNK = 1 << 20
CLEARINGS = 20  # a running attempt may add files while its folder is removed


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    filesystem, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return filesystem, root.rstrip("/")


def _below(name: str | None) -> str:
    parts = (name or "").split("/")
    if not all(parts) or {".", ".."} & set(parts) or parts[0].startswith("_staging-"):
        raise ValueError(f"not a name below the folder: {name!r}")
    return "/".join(parts)


def _equal(filesystem: fs.FileSystem, a: str, b: str) -> bool:
    with filesystem.open_input_stream(a) as one, filesystem.open_input_stream(b) as other:
        while True:
            x, y = one.read(CHUNK), other.read(CHUNK)
            if x != y:
                return False
            if not x:
                return True


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def begin(self) -> FilesWriter:
        filesystem, root = _opened(self.folder)
        filesystem.create_dir(self._staging(root), recursive=True)
        return self

    def write(self, iterator: Iterator[Row]) -> Written:
        filesystem, root = _opened(self.folder)
        task = TaskContext.get()
        own = f"{self._staging(root)}/{task.partitionId()}-{task.taskAttemptId()}"
        filesystem.create_dir(own, recursive=False)
        staged, total = [], 0
        for name, content in iterator:
            if content is None:
                continue
            staged.append((f"{own}/{len(staged)}", f"{root}/{_below(name)}"))
            with filesystem.open_output_stream(staged[-1][0]) as out:
                out.write(pa.py_buffer(content))
            total += len(content)
        for part, final in staged:
            if filesystem.get_file_info(final).type == fs.FileType.NotFound:
                filesystem.create_dir(final.rpartition("/")[0], recursive=True)
                filesystem.move(part, final)
            elif not _equal(filesystem, part, final):
                raise FileExistsError(f"other bytes are there already: {final}")
        return Written(len(staged), total)

    def _clear(self) -> tuple[fs.FileSystem, str]:
        filesystem, root = _opened(self.folder)
        for left in range(CLEARINGS - 1, -1, -1):
            if filesystem.get_file_info(self._staging(root)).type != fs.FileType.Directory:
                break
            try:
                filesystem.delete_dir(self._staging(root))
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)
        return filesystem, root

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, root = self._clear()
        filesystem.create_dir(root, recursive=True)
        with filesystem.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class FilesSink(DataSource):
    """``df.write.format("tidemark_files").mode("append").save(folder)`` for rows of (name string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files are never replaced: use mode append")
        if [f.dataType.simpleString() for f in schema.fields] != ["string", "binary"]:
            raise ValueError("rows of (name string, content binary) are needed")
        return FilesWriter(self.options["path"]).begin()


def write_files(rows: DataFrame, folder: str, name_col: str = "name", content_col: str = "cleaned") -> None:
    """Write the rows' bytes below ``folder``, committed task by task; see the module."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select(F.col(name_col).cast("string").alias("name"), F.col(content_col).cast("binary").alias("content")).write.format("tidemark_files").mode("append").save(folder)
