"""Reading the corpus tables, and tables written to the folder all executors share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from spanloom.session import shared_folder, ship_package

# Rows per Arrow batch: bounds what a Python worker holds of long texts.
ARROW_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage and keeps lost executors cheap."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small, and gives the workers this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
