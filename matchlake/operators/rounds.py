"""Tables of iterations in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

Keep = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without and gets a temporary folder."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='matchlake-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


@contextmanager
def rounds(spark: SparkSession, shared: str, label: str) -> Iterator[tuple[Keep, Keep]]:
    """Two functions that write a table and read it back: the first one's tables are removed at the end, the second one's stay."""
    folder = f"{shared}/{label}-{uuid.uuid4().hex}"

    def written(df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield lambda df: written(df, f"{folder}/{uuid.uuid4().hex}"), lambda df: written(df, f"{shared}/{label}-kept-{uuid.uuid4().hex}")
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
