"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_temporary: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results, ``spark.checkpoint.dir``. Where none is named a local session gets
    a temporary one; on a cluster, where each executor would write to a disk of its own, it's an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _temporary.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tallystone-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read on from there, so that a lost executor costs a re-read and
    not the whole lineage. It runs when called. The files go with the folder, or as soon as nothing refers to them with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As cut(), by a Parquet table in the shared folder. Spark then knows the table's true size, where a checkpoint goes on
    with the estimate of the plan before it, which joins multiply; so small tables are broadcast and large ones are not."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
