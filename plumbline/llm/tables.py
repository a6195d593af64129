"""Intermediate tables in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_folder: str | None = None
_recorded: list[str] | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of our own only where it is unset."""
    global _own_folder
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="plumbline-shared-")
    return _own_folder


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    path = new_path(df.sparkSession, label)
    if _recorded is not None:
        _recorded.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recording() -> Iterator[list[str]]:
    """Gives the paths of the tables that materialize() writes meanwhile, for delete() once nothing reads them."""
    global _recorded
    before, _recorded = _recorded, []
    try:
        yield _recorded
    finally:
        _recorded = before


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table that materialize() returned; nothing may read it afterwards."""
    files = df.inputFiles()
    if files:
        delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def with_columns_replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name is replaced, whatever its case."""
    added = {name.lower() for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in added]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])
