"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import shared_dir

#: Words of every operator: maximal runs without ASCII white space.  ``bytes.split()`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lectern_path = path
    return out


def no_wider(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` in no more partitions than ``source``, which is no smaller: as a table it then has no more files.

    A shuffle's partitions become a file each where adaptive execution doesn't join them; for every file on a local disk Hadoop starts ``chmod`` three times,
    and a process that a big executor starts counts as big as the executor until it runs its own program.
    """
    return df.coalesce(max(1, source.rdd.getNumPartitions()))


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop an external table together with its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    spark.sql(f"DROP TABLE {name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more, and let the driver drop the shuffle files of finished jobs.

    Spark deletes a shuffle's files when the driver collects the garbage that refers to it, which may be long after a big job.
    """
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.lectern_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is on the driver's path alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def slices(batch, column: str, most: int = 4 << 20):
    """Parts of an Arrow batch with about ``most`` bytes (or one row) of a binary or string column each."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def trim() -> None:
    """Give memory back that a block has left free: workers live on, and two or more share an executor's limit."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def free_prefix(columns: list[str], prefix: str = "lectern_") -> str:
    """``prefix`` with as many underscores more as it takes to begin no column's name."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def text_bytes(col):
    """UTF-8 bytes of a string column, null as empty."""
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")
