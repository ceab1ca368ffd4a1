"""A sink of letters: a file for each, written by tasks, all of a job or none; and their source.

A task writes its files to a folder of its own beside the others (``_writing-<job>``), through whatever file system the
path names. When all tasks are done, the driver moves each task's folder into place, one step for each task whatever the
number of its letters; when one has failed for good, it removes them all, and tasks that go on find no folder to write
to. Attempts that were given up are never moved.

They are read back by a task for each of these folders, which lists its files itself, so the driver never holds a list of
letters and a task isn't made for a few of them, as by Spark's readers of files.

Defined results: a null text is an empty file (Spark's readers pass empty files over; here it is an empty text), a null kind the folder that Spark reads as null; a name that a task has
written for that kind already gets a number; a null, empty or dotted name, or one with a slash, fails the job.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NULL_KIND = "__HIVE_DEFAULT_PARTITION__"
#: Bytes of letters that a task reads before it hands them on.
BATCH = 2**22


@dataclass
class Written(WriterCommitMessage):
    folder: str
    task: int


@dataclass
class TaskFolder(InputPartition):
    path: str


class LetterFolder:
    path: str

    def _store(self) -> tuple[fs.FileSystem, str]:
        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + self.path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(self.path)


class LetterWriter(LetterFolder, DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        store, root = self._store()
        store.create_dir(f"{root}/_writing-{self.job}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = self._store()
        task = TaskContext.get().partitionId()
        folder, names, made = f"{root}/_writing-{self.job}/{uuid.uuid4().hex}", Counter(), set()
        store.create_dir(folder, recursive=False)  # there is none for a task that goes on after its job has failed
        for row in iterator:
            place = self._place(row["kind"], row["name"])
            names[place] += 1
            if names[place] > 1:
                stem, dot, end = place.rpartition(".")
                place = f"{stem}-{names[place]}.{end}" if dot and "/" not in end else f"{place}-{names[place]}"
            parent = f"{folder}/{place.rpartition('/')[0]}"
            if parent not in made:
                store.create_dir(parent, recursive=False)
                made.add(parent)
            with store.open_output_stream(f"{folder}/{place}") as file:
                file.write((row["text"] or "").encode())
        return Written(folder, task)

    @staticmethod
    def _place(kind: str | None, name: str | None) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"{name!r} can't name a letter's file")
        return f"kind={NULL_KIND if kind is None else quote(kind, safe=' .-_')}/{name}"

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.type == fs.FileType.Directory and old.base_name.startswith("part="):
                    store.delete_dir(old.path)
        for message in messages:
            if message is not None:
                store.move(message.folder, f"{root}/part={message.task:05}-{self.job[:8]}")
        store.delete_dir(f"{root}/_writing-{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/_writing-{self.job}").type != fs.FileType.NotFound:
            store.move(f"{root}/_writing-{self.job}", f"{root}/_gone-{self.job}")  # out of the way of tasks that go on
            store.delete_dir(f"{root}/_gone-{self.job}")


class LetterReader(LetterFolder, DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[TaskFolder]:
        store, root = self._store()
        return [TaskFolder(place.path) for place in _inside(store, root, "part=")]

    def read(self, partition: TaskFolder | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no task has written a letter
            return
        store, _ = self._store()
        rows, size = [], 0
        for place in _inside(store, partition.path, "kind="):
            kind = unquote(place.base_name.removeprefix("kind="))
            for file in store.get_file_info(fs.FileSelector(place.path)):
                if file.type != fs.FileType.File or file.base_name.startswith((".", "_")):
                    continue
                with store.open_input_stream(file.path) as stream:
                    content = stream.read()
                rows.append({"kind": None if kind == NULL_KIND else kind, "name": file.base_name, "text": content.decode()})
                size += len(content)
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, COLUMNS)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, COLUMNS)


def _inside(store: fs.FileSystem, folder: str, begin: str) -> list[fs.FileInfo]:
    """The folders of a folder whose names begin so."""
    found = store.get_file_info(fs.FileSelector(folder))
    return [place for place in found if place.type == fs.FileType.Directory and place.base_name.startswith(begin)]


COLUMNS = pa.schema([(name, pa.string()) for name in ("kind", "name", "text")])


class LetterFiles(DataSource):
    """Rows (kind, name, text) as files under the path."""

    @classmethod
    def name(cls) -> str:
        return "letter_files"

    def schema(self) -> str:
        return "kind string, name string, text string"

    def writer(self, schema, overwrite: bool) -> LetterWriter:
        return LetterWriter(self.options["path"], overwrite)

    def reader(self, schema) -> LetterReader:
        return LetterReader(self.options["path"])
