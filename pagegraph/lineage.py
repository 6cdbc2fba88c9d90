"""Cutting lineage in the folder that the cluster shares, and finding this package from its workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def visible(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, unless they can already (``--py-files``, ``PYTHONPATH``)."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep) + env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def folder(df: DataFrame) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "pagegraph-checkpoints"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df``, materialised reliably: a lost executor costs no recomputation."""
    folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the same folder, so that later scans read only the columns they need."""
    path = f"{folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what ``stored`` wrote, once every reader of it has been written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
