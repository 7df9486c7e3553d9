"""Whole files as the output of a query, committed together: a sink for rows of a path and the bytes of a file.

Tasks put files into one staging folder beside the targets, under names of their own, and tell the driver what they
staged.  Once all tasks are done, the driver moves the files to their places; if one fails for good nothing is moved.
The staging folder goes in either case, with all that attempts left there that failed, ran twice or were lost.
Readers thus never see a part of a job's files before it is over, nor ever a part of a file.

Paths may be of any file system that Arrow knows by its URI (local, hdfs, s3, gs, abfs); plain ones are local.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from densika.runtime import visible

NAME = "densika_files"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]  # where a file is, and where it goes


class FileWriter(DataSourceWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, folder = file_system(self.staging)
        store.create_dir(folder, recursive=True)
        out = []
        for row in iterator:
            place = posixpath.join(folder, uuid.uuid4().hex)
            with store.open_output_stream(place) as stream:
                stream.write(bytes(row["data"]))
            out.append((place, row["path"]))
        return Staged(out)

    def commit(self, messages: list[Staged | None]) -> None:
        store, folder = file_system(self.staging)
        moves = [(place, file_system(path)[1]) for m in messages if m is not None for place, path in m.files]
        for parent in {posixpath.dirname(path) for _, path in moves}:
            store.create_dir(parent, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: store.move(*move), moves))
        self._clear(store, folder)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*file_system(self.staging))

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["staging"])


def write_files(rows: DataFrame, root: str) -> None:
    """Writes ``data`` of each row to its ``path``; what is staged meanwhile is in a folder under ``root``."""
    visible(rows.sparkSession).dataSource.register(Files)
    staging = posixpath.join(root, f"_staging-{uuid.uuid4().hex}")
    rows.select("path", "data").write.format(NAME).mode("append").option("staging", staging).save()
