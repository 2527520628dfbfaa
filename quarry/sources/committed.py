"""A sink whose batches are there once or not at all: a PySpark Python data source.

Tasks write their records to files of their own and report the names; the driver commits a batch by
putting one manifest, named after the batch, in its place. Readers take the files that manifests
name, so rows of failed or running jobs are never seen (``sweep`` deletes what they leave). A batch that is written again (a retried
micro-batch, or a batch job with the same ``batch`` option) finds its manifest and leaves it: one copy.

    spark.dataSource.register(CommittedSink)
    df.write.format("committed").option("path", folder).option("batch", "2024-01-01").mode("append").save()
    df.writeStream.format("committed").option("path", folder).option("checkpointLocation", ...).start()
    read_committed(spark, folder)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from .connector import _file_system


@dataclass
class Written(WriterCommitMessage):
    """A task's files and rows."""

    files: list[str]
    rows: int


def _put_once(root: str, name: str, text: str) -> bool:
    """Whether this call put the file there: whole, by a move, unless it is there already."""
    from pyarrow import fs as pafs
    filesystem, at = _file_system(root)
    filesystem.create_dir(f"{at}/commits", recursive=True)
    to, tmp = f"{at}/commits/{name}", f"{at}/commits/.{name}.{uuid.uuid4().hex}"
    if filesystem.get_file_info(to).type != pafs.FileType.NotFound:
        return False
    with filesystem.open_output_stream(tmp) as out:
        out.write(text.encode())
    filesystem.move(tmp, to)
    return True


class _Sink:
    def __init__(self, options: dict):
        self.root = options["path"]
        self.batch = options.get("batch") or uuid.uuid4().hex

    def _write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, at = _file_system(self.root)
        filesystem.create_dir(f"{at}/data", recursive=True)
        # The attempt's own name: a task that runs twice doesn't touch the other's file.
        name = f"data/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        writer, rows = None, 0
        try:
            for b in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(f"{at}/{name}", b.schema, filesystem=filesystem, compression="zstd")
                writer.write_batch(b)
                rows += b.num_rows
        except BaseException:
            if writer is not None:
                writer.close()
                filesystem.delete_file(f"{at}/{name}")
            raise
        if writer is not None:
            writer.close()
        return Written([name] if writer is not None else [], rows)

    def _commit(self, batch: str, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        files = [f for m in done for f in m.files]
        if not _put_once(self.root, f"{batch}.json", json.dumps({"batch": batch, "files": files, "rows": sum(m.rows for m in done)})):
            self._drop(messages)  # the batch is there: these are another copy

    def _drop(self, messages: list[Written | None]) -> None:
        filesystem, at = _file_system(self.root)
        for m in messages:
            for f in (m.files if m is not None else []):
                filesystem.delete_file(f"{at}/{f}")


class BatchWriter(_Sink, DataSourceArrowWriter):
    def write(self, iterator):
        return self._write(iterator)

    def commit(self, messages):
        self._commit(f"batch-{self.batch}", messages)

    def abort(self, messages):
        self._drop(messages)


class StreamWriter(_Sink, DataSourceStreamArrowWriter):
    def write(self, iterator):
        return self._write(iterator)

    def commit(self, messages, batchId):
        self._commit(f"stream-{batchId:012d}", messages)

    def abort(self, messages, batchId):
        self._drop(messages)


class CommittedSink(DataSource):
    @classmethod
    def name(cls):
        return "committed"

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("committed batches are never overwritten; use mode('append')")
        return BatchWriter(self.options)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options)


def sweep(path: str, older_than_secs: float = 86_400) -> list[str]:
    """Delete data files that no commit names and that are older than any job still running: what
    killed tasks and drivers left behind."""
    import time

    from pyarrow import fs as pafs
    filesystem, at = _file_system(path)
    named = {f for c in commits(path) for f in c["files"]}
    gone = [i for i in filesystem.get_file_info(pafs.FileSelector(f"{at}/data", allow_not_found=True))
            if f"data/{i.base_name}" not in named and (i.mtime_ns or 0) / 1e9 < time.time() - older_than_secs]
    for i in gone:
        filesystem.delete_file(i.path)
    return sorted(i.base_name for i in gone)


def commits(path: str) -> list[dict]:
    """The committed batches: batch, files and rows, by name."""
    from pyarrow import fs as pafs
    filesystem, at = _file_system(path)
    infos = filesystem.get_file_info(pafs.FileSelector(f"{at}/commits", allow_not_found=True))
    out = []
    for i in sorted((i for i in infos if not i.base_name.startswith(".")), key=lambda i: i.base_name):
        with filesystem.open_input_stream(i.path) as fh:
            out.append(json.loads(fh.read()))
    return out


def read_committed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all committed batches, as of now."""
    files = [f"{path}/{f}" for c in commits(path) for f in c["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
