"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Spark's setting that removes a query's shuffle files when the query ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def step_folder(spark: SparkSession) -> str:
    """The application's own folder in ``spark.checkpoint.dir``; only on a single machine a temporary one stands in."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{context.applicationId}"


class Step:
    """A table that is written, so that a lost executor costs no more than the step it was in.

    Call :meth:`drop` once nothing reads it any more.
    """

    def __init__(self, df: DataFrame, **sums: Column):
        """``sums``: aggregates that are taken while the table is written, then in :attr:`sums`."""
        self.spark = df.sparkSession
        schema, seen = df.schema, Observation()
        if sums:
            df = df.observe(seen, *(c.alias(name) for name, c in sums.items()))
        self.path = f"{step_folder(self.spark)}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(SHUFFLES_GO, None)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.parquet(self.path)
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLES_GO)
            else:
                self.spark.conf.set(SHUFFLES_GO, before)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        self.sums = seen.get if sums else {}

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
