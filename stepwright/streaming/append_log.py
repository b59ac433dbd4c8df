"""A row log as a Python data source: streams and tables append JSON lines, each row once.

A task writes its rows to a file of its own; when a batch commits, a manifest of that name says which
files belong to it, and readers go by manifests. A batch that is committed again, as after a failure
between commit and checkpoint, finds its manifest and leaves the log as it is; files of tasks that
were lost or repeated are in no manifest. Writes that fail are tried again after growing pauses.

Options: path; query, a name that tells apart streams that share a log (default `main`); tries and
pause_seconds for writes.

Defined cases: a batch without rows has a manifest without files; null fields are left out of a line
and read as null; a log that does not exist, or without manifests, has no rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_batch-"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, root.rstrip("/")


def retried(action: Callable[[], object], tries: int, pause: float) -> object:
    """What action() gives; after an OSError it is tried again, after a pause that doubles."""
    for k in range(tries):
        try:
            return action()
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("tries has to be 1 at least")


class LogWriter:
    """What batches and streams have in common."""

    def __init__(self, options: dict[str, str]):
        self.path, self.query = options["path"], options.get("query", "main")
        self.tries, self.pause = int(options.get("tries", 4)), float(options.get("pause_seconds", 0.05))

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = place_of(self.path)
        name, rows, sink = f"part-{uuid.uuid4().hex}.jsonl", 0, None
        for row in iterator:
            if sink is None:
                retried(lambda: store.create_dir(root, recursive=True), self.tries, self.pause)
                sink = retried(lambda: store.open_output_stream(f"{root}/{name}"), self.tries, self.pause)
            fields = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
            sink.write((json.dumps(fields, ensure_ascii=False, default=str) + "\n").encode())
            rows += 1
        if sink is not None:
            retried(sink.close, self.tries, self.pause)
        return Written(name if rows else None, rows)

    def publish(self, messages: list[Written | None], batch: str) -> None:
        """Name the files of a batch, unless that is done already."""
        store, root = place_of(self.path)
        manifest = f"{root}/{MANIFEST}{self.query}-{batch}.json"
        files = [{"file": m.file, "rows": m.rows} for m in messages if m and m.file]
        store.create_dir(root, recursive=True)
        if store.get_file_info(manifest).type == fs.FileType.File:
            self.remove(messages)
            return
        draft = f"{root}/.draft-{uuid.uuid4().hex}"

        def save() -> None:
            with store.open_output_stream(draft) as sink:
                sink.write(json.dumps(files).encode())

        retried(save, self.tries, self.pause)
        retried(lambda: store.move(draft, manifest), self.tries, self.pause)

    def remove(self, messages: list[Written | None]) -> None:
        store, root = place_of(self.path)
        for m in messages:
            if m and m.file and store.get_file_info(f"{root}/{m.file}").type == fs.FileType.File:
                store.delete_file(f"{root}/{m.file}")


class LogStreamWriter(LogWriter, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.publish(messages, str(batchId))

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.remove(messages)


class LogTableWriter(LogWriter, DataSourceWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.publish(messages, uuid.uuid4().hex)

    def abort(self, messages: list[Written | None]) -> None:
        self.remove(messages)


class AppendLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "append_log"

    def writer(self, schema: StructType, overwrite: bool) -> LogTableWriter:
        if overwrite:
            raise ValueError("a log is only appended to")
        return LogTableWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> LogStreamWriter:
        return LogStreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AppendLog)


def committed(path: str) -> list[dict]:
    """file and rows of all committed batches."""
    store, root = place_of(path)
    found = []
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(MANIFEST):
            with store.open_input_stream(info.path) as source:
                found += json.load(source)
    return found


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of committed batches."""
    files = [f"{path.rstrip('/')}/{x['file']}" for x in committed(path)]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
