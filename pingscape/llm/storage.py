"""Shared storage for intermediate tables, and unique column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`.

    Where it is unset, a session inside one process (as in tests) gets a scratch folder; on a
    cluster, whose executors could not see one, that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pingscape-shared-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder once and read it back: cuts the lineage,
    so a lost executor re-reads files instead of recomputing earlier stages."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete saved tables that no later plan reads (their successors are saved)."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: Iterable[str], name: str) -> str:
    """`name`, or a variant that no column has (Spark compares names without case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name
