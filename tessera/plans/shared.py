"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; on a local master without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables that are deleted at the end of scratch(), but for those kept."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not df]
        return df


_scratch: list[Scratch] = []


@contextmanager
def scratch() -> Iterator[Scratch]:
    """What materialise() writes inside is deleted at the end, as nothing that is still to run reads it; keep() spares a
    table, which then belongs to the scratch() around this one, if there is one."""
    own = Scratch()
    _scratch.append(own)
    written: list[DataFrame] = []
    try:
        yield own
        written = own.tables
    finally:
        _scratch.remove(own)
        for df in written:
            discard(df)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that has run are deleted at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back: what follows no longer depends on the plan before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    for held in _scratch[-1:]:
        held.tables.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
