"""Arriving files of grids as a stream: tables are processed once each; series checks run on all that has come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gridmill.operators import checks
from gridmill.options import DEFAULT, Options
from gridmill.plans.observations import observe


def refresh(spark: SparkSession, source: str, schema: str | StructType, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataFrame:
    """Runs `work` on files that have come to `source` since the last call and appends its rows to `target`.

    The checkpoint remembers files, so a file is read once. Each micro-batch overwrites its own folder
    `batch=N`, so a batch that is run again after a failure leaves no row twice. Returns the target.
    """

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(target)


def refresh_observations(
    spark: SparkSession, source: str, schema: str | StructType, context: Callable[[DataFrame], DataFrame], vocabulary: DataFrame, target: str, checkpoint: str, options: Options = DEFAULT
) -> tuple[DataFrame, DataFrame]:
    """(observations of all grids that have come, jumps between their periods); grids that are new are read, checked and coded.

    `context` gives the context of some grids. A table is checked when it comes; series run through all
    tables, so their jumps are looked for anew in the whole of the target.
    """

    def work(batch: DataFrame) -> DataFrame:
        return observe(batch, context(batch), vocabulary, options=options).long

    long = refresh(spark, source, schema, work, target, checkpoint)
    return long, checks.period_jump_check(long, options)
