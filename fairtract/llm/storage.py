"""Written tables and files in the folder that all machines of a cluster share."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, with its scheme; only a local session may go without.

    A path without a scheme is one of the default file system, which need not be the machine's own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(folder)
    return qualified(spark, folder.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is put into the shared folder inside is deleted at the end, but for tables staged with ``keep``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: lineage ends there."""
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(staged: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = staged.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_of(path: str) -> str | None:
    """The path of a file as the machine's own file system shows it, if its scheme says so."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def put(path: str, data: bytes) -> None:
    """Write a file whole or not at all, so that a repeated task does no harm."""
    local = local_of(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_output_stream(name) as out:
        out.write(data)


def mapped(path: str, dtype):
    """A file as a read-only mapped array.

    Files of a store that is not mounted are copied to an unnamed temporary
    file first, which is gone as soon as the worker ends.
    """
    import numpy as np

    local = local_of(path)
    if local:
        size = os.path.getsize(local)
        return np.memmap(local, dtype, "r") if size else np.zeros(0, dtype)
    import tempfile

    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    copy = tempfile.TemporaryFile()
    with system.open_input_stream(name) as source:
        shutil.copyfileobj(source, copy)
    copy.flush()
    return np.memmap(copy, dtype, "r") if copy.tell() else np.zeros(0, dtype)
