"""Arrow IPC files as a Spark source and sink (Python data source ``arrow_ipc``).

``register(spark)``; one input partition for each file, one file for each task;
``path`` must be seen by all executors.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema


def _files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".arrow"))


class ArrowIpcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        with ipc.open_file(_files(self.options["path"])[0]) as f:
            return from_arrow_schema(f.schema)

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition):
        with ipc.open_file(partition.value) as f:
            for i in range(f.num_record_batches):
                yield f.get_batch(i)


@dataclass
class _Written(WriterCommitMessage):
    file: str | None


class _Writer(DataSourceArrowWriter):
    """Tasks write under hidden names; the commit renames them."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        os.makedirs(self.path, exist_ok=True)
        file, out = os.path.join(self.path, f".{uuid.uuid4().hex}"), None
        for batch in iterator:
            if out is None:
                out = ipc.new_file(file, batch.schema)
            out.write_batch(batch)
        if out is None:
            return _Written(None)
        out.close()
        return _Written(file)

    def commit(self, messages):
        for i, m in enumerate(messages):
            if m is not None and m.file:
                os.rename(m.file, os.path.join(self.path, f"part-{i:06d}-{os.path.basename(m.file)[1:9]}.arrow"))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.file:
                os.remove(m.file)


def register(spark) -> None:
    """Make the source known to a session, which becomes the active one."""
    spark.sql("SELECT 1")
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    spark.dataSource.register(ArrowIpcSource)


def write_table(table: pa.Table, file: str) -> None:
    with ipc.new_file(file, table.schema) as out:
        out.write_table(table)
