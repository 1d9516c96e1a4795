"""A stage boundary: a narrow table that later stages read several times is written once to the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame


def barrier(df: DataFrame) -> DataFrame:
    """The rows from a Parquet table in spark.checkpoint.dir; where none is set, a temporary folder serves a local master.

    Parquet and not ``checkpoint()``: later reads prune columns, and the optimizer
    of Spark 4.1 failed on a union of checkpointed plans, in its constraints. The
    table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    path = f"{sc.getCheckpointDir()}/barrier-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)
