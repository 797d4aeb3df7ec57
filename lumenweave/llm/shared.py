"""Shared folder, table access and small helpers for the text operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of an Arrow batch that carries whole texts, so that a worker's batch has a bound.
BATCH_BYTES, TEXT_BATCH = 16 << 20, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> str:
    """Small Arrow batches for whole texts, and the shared folder as a URI.

    The folder is the one in spark.checkpoint.dir; a temporary one is set only where that is unset and one machine does
    all the work (tests). Elsewhere executors would not see each other's files, so that is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    uri = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not uri:
        got = context._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        uri = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(uri)
    return uri


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{prepare(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: its lineage ends there, and a lost executor costs nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, uri: str) -> None:
    """Removes a table of the shared folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_column(docs: DataFrame):
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """name, lengthened until it is no column's."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI of the shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_bytes(uri: str, data: bytes) -> None:
    """Writes a file whole or not at all; a repeated task writes the same file again."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def mapped(uri: str, dtype):
    """The array in a file: memory-mapped where the folder is mounted, else from a local copy that is mapped."""
    import numpy as np

    from pyarrow import fs

    store, path = filesystem(uri)
    if not isinstance(store, fs.LocalFileSystem):
        local = os.path.join(tempfile.gettempdir(), uuid.uuid5(uuid.NAMESPACE_URL, uri).hex)
        if not os.path.exists(local):
            part = f"{local}.{uuid.uuid4().hex}"
            fs.copy_files(path, part, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            os.replace(part, local)
        path = local
    if not os.path.getsize(path):
        return np.empty(0, dtype)
    return np.memmap(path, dtype, "r")
