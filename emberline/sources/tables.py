"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.session import tune


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Columns and filters are pushed to the scan by the queries that use it."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that is read in fewer splits than there are cores, dealt out by its key; a larger one stays where it is read.

    Only how the work is shared depends on it, never the result: a table of few splits holds few megabytes a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.rdd().getNumPartitions() < cores else df
