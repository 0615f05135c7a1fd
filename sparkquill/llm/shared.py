"""Places that the driver and every executor can reach, and rows packed for a shuffle."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of packed arrays: a bucket of keys and the arrays of all its entries.
PACKED = "bucket int, kind int, data binary"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's checkpoint folder; only in local mode without one under a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparkquill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting to delete a job's shuffle files when it ends; what stage() wrote takes their place.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers that are broadcast at most; a larger table is shuffled.
BROADCAST_ROWS = 500_000


def write(df: DataFrame, path: str, **options) -> None:
    """Writes df as Parquet; its shuffle files are deleted then, so that steps do not pile them up."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, **options)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts the lineage."""
    path = shared_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one run of an operator, deleted as soon as no later step reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = shared_path(self.spark, name)
        write(df, self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for n in names:
            remove(self.spark, self.paths.pop(n))


def without(docs: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """docs, all columns, but the rows whose keys are a row of gone (a staged table, no nulls).

    gone is counted first: up to BROADCAST_ROWS rows are broadcast and docs stay where they are; more are joined by shuffles.
    """
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in zip(gone.columns, keys)))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, gone.columns, "left_anti").select("row.*")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Hadoop's file systems."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a path of the shared folder; none if there is no such path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the cluster's setting for the size of its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of the input (as stored) for each bucket of packed rows, which a task holds whole.
BUCKET_BYTES, MAX_BUCKETS = 16 << 20, 200_000


def buckets(docs: DataFrame) -> int:
    """Buckets for packed rows made of docs: they grow with the bytes of the tables that docs is made of, and are the session's shuffle partitions at least."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < 1 << 60)  # what has no statistics says 2 ** 63 - 1
    return max(partitions(docs.sparkSession), min(-(-size // BUCKET_BYTES), MAX_BUCKETS))


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays, all of one length, one behind the other; unpack() takes the same types."""
    return np.int64(len(arrays[0])).tobytes() + b"".join(bytewise(np.ascontiguousarray(a)) for a in arrays)


def unpack(data: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(unbytewise(data, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def scatter(buckets: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """PACKED rows, one for each bucket that occurs."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(buckets[part[0]]), kind, pack(*(a[part] for a in arrays))


def packed_batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about limit bytes each from tuples."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) if isinstance(x, (bytes, str)) else 8 for x in row)
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def delta(a: np.ndarray) -> np.ndarray:
    """Differences, small where neighbours are close; np.cumsum undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def bytewise(a: np.ndarray) -> bytes:
    """An array's lowest bytes first, then the next: small numbers compress to little more than those."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unbytewise(data: bytes, kind: str, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
