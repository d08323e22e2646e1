"""Tables written on the way to a result: they cut lineage, survive lost executors, and belong to who wrote them."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: For each open `owned` block of this thread or task, innermost last, the folders that `materialize` has written in it.
_OWNERS: ContextVar[tuple[list[str], ...]] = ContextVar("owners", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) may leave it unset, as
    its driver and executors are one process with one temporary folder (those of a local-cluster are not)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), f"scoreloom-{os.getuid()}")).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scoreloom/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    if owners := _OWNERS.get():
        owners[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place.getParent(), True)


def discard(table: DataFrame) -> None:
    """Delete a table of `materialize` that nothing to be computed reads any more."""
    for written in _OWNERS.get():
        if table.written_to in written:
            written.remove(table.written_to)
    _delete(table.sparkSession, table.written_to)


def release(spark: SparkSession) -> None:
    """Have the driver collect garbage, upon which Spark deletes the shuffle files of plans that nobody holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def owned() -> Iterator[list[str]]:
    """Collects the folders that `materialize` writes in the block, for `drop` once nothing reads them any more."""
    written: list[str] = []
    before = _OWNERS.set((*_OWNERS.get(), written))
    try:
        yield written
    finally:
        _OWNERS.reset(before)


def drop(spark: SparkSession, written: list[str]) -> None:
    """Delete folders of an `owned` block."""
    while written:
        _delete(spark, written.pop())


def settled(build: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What build returns, written as a table; the tables that build wrote on its way are deleted."""
    with owned() as written:
        made = build()
        with owned() as kept:
            out = materialize(made, tag)
    drop(out.sparkSession, written)
    if owners := _OWNERS.get():
        owners[-1].extend(kept)
    return out
