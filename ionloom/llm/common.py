"""Helpers that several text operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Spark's setting that removes a query's shuffle files when the query ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting that bounds the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, under names of its own, so extra columns can't clash."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[text_col].cast("string").alias("text"),
        *(docs[c].alias(c) for c in more),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between steps: the session's ``spark.checkpoint.dir``.

    Only on a single machine a temporary folder stands in for it; a cluster must name a shared one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{context.applicationId}"


def settle(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The write is a job of its own: what was shuffled for it isn't needed any more and is removed when
    it ends (:data:`SHUFFLES_GO`).  The tables of an application lie in one folder named after it.
    ``batch_bytes`` bounds the Arrow batches that the job sends to Python.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    wanted = {SHUFFLES_GO: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in settled:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def parts_of(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Parts to deal a table's data to: as many as it takes to keep a part's input below ``bytes_each``, and at least the session's shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 60)  # a table of unknown size says a greater one
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 17, size // bytes_each))


def squeeze(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings as one compressed column value."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return zlib.compress(head + b"".join(parts), 1)


def unsqueeze(payload: bytes) -> list[bytes]:
    """The byte strings that :func:`squeeze` took."""
    raw = zlib.decompress(payload)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
    at, out = 8 * (n + 1), []
    for size in sizes:
        out.append(raw[at : at + size])
        at += size
    return out


def main_length(vectors: DataFrame, vector_col: str) -> int:
    """The most common length of a table's non-empty vectors, the longer one of equally common lengths; 0 without any.  Runs at once."""
    sizes = vectors.select(F.size(vector_col).alias("d")).where("d > 0").groupBy("d").count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def finite(vector: Column) -> Column:
    """Whether a vector of doubles is there and none of its components is null or non-finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
