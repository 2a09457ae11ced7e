"""Growing corpora: new poster files become observations as they arrive; rules are derived in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallystone.operators.judging import derive
from tallystone.operators.metrics import observe
from tallystone.schemas import POSTER


def follow(spark: SparkSession, folder: str, into: str, checkpoint: str) -> StreamingQuery:
    """Append the observations of new Parquet files of posters in ``folder`` to ``into``, until stopped;
    each file once, also after a restart from ``checkpoint``."""

    def add(batch: DataFrame, number: int) -> None:
        # a batch that is written again after a failure replaces its own folder
        observe(batch).write.mode("overwrite").parquet(f"{into}/batch={number}")

    return spark.readStream.schema(POSTER).parquet(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rules(spark: SparkSession, observations: str) -> DataFrame:
    """Rules are quantiles of all observations, so they are derived anew."""
    return derive(spark.read.parquet(observations).drop("batch"))
