"""Tables that cut lineage, written to the folder all executors share.

``Scratch(spark).save(df)`` writes ``df`` as Parquet under ``spark.checkpoint.dir``
(a private folder only where that setting is absent, as in local tests) and reads
it back, so that a lost executor costs a reread, never a rerun of what came before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a folder of our own for local runs."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="millrace-"))
    return "file://" + _local[0]


class Scratch:
    """Written intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
        self.made = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing returned still reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(conf).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
