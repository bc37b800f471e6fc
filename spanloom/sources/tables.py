"""Sources and sinks: message and metric files, table creation, append and overwrite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from spanloom import schemas
from spanloom.operators.infra import with_ingestion_parts

# Tables are divided into folders by date. Within a file rows are sorted by hour: bounds on time are cut to dates, and folders
# by hour would only mean 24 times the files.
PARTITIONS, SORTED = ["ingestion_date"], ["ingestion_hour"]


def parsed_schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan of landed OTLP messages, one JSON text per line."""
    return spark.read.text(path)


def message_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream over a landing folder of OTLP messages. ``max_files`` bounds a micro-batch by size."""
    reader: DataStreamReader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def broker_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Stream of OTLP messages from a Kafka topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    )
    return raw.select(F.col("value").cast("string").alias("value"))


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Batch scan of a parquet table."""
    reader = spark.read
    return (reader.schema(schema) if schema else reader).parquet(path)


def table_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Stream over the files of an append-only parquet table."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def create_if_missing(spark: SparkSession, path: str, schema: str) -> bool:
    """Create an empty table, partitioned by ingestion date where it has one. True when created."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return False
    empty = spark.createDataFrame([], schema)
    writer = empty.write
    if set(PARTITIONS) <= set(empty.columns):
        writer = writer.partitionBy(*PARTITIONS)
    writer.parquet(path)
    return True


def create_all(spark: SparkSession, folder: str) -> list[str]:
    """Create every table that is missing under a folder; returns the names created."""
    return [
        name for name, (schema, _) in schemas.TABLES.items() if create_if_missing(spark, f"{folder}/{name}", schema)
    ]


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace a derived table."""
    df.write.mode("overwrite").option("overwriteSchema", "true").parquet(path)


# --- metric ingest ---


@dataclass(frozen=True)
class MetricFormat:
    """A metric's JSON fields: schema, and the ones that may be absent."""

    schema: str
    optional: tuple[str, ...]


GPU_FORMAT = MetricFormat(schemas.GPU_SAMPLE, ("gpu_uuid",))
NETWORK_FORMAT = MetricFormat(schemas.NETWORK_SAMPLE, ("peer_node_id",))


def checked_metrics(lines: DataFrame, fmt: MetricFormat, column: str = "value") -> DataFrame:
    """Parse JSON lines as text fields, cast each, and say what is wrong with a line in ``reject_reason``."""
    fields = parsed_schema(fmt.schema).fields
    raw = lines.withColumn("_raw", F.from_json(F.col(column), "map<string,string>"))

    def cast(name: str, of_type: str) -> Column:
        text = F.col("_raw")[name]
        return text if of_type == "string" else text.try_cast(of_type)

    typed = raw.select(
        column, "_raw", *[cast(f.name, f.dataType.simpleString()).alias(f.name) for f in fields]
    )
    problems = [
        F.when(
            F.col(f.name).isNull() & (F.lit(f.name not in fmt.optional) | F.col("_raw")[f.name].isNotNull()),
            F.when(F.col("_raw")[f.name].isNull(), F.lit(f"missing {f.name}")).otherwise(F.lit(f"bad {f.name}")),
        )
        for f in fields
    ]
    reason = F.when(F.col("_raw").isNull(), F.lit("not JSON")).otherwise(
        F.nullif(F.concat_ws("; ", *problems), F.lit(""))
    )
    filled = [F.coalesce(F.col(o), F.lit("")).alias(o) for o in fmt.optional]
    kept = [F.col(f.name) for f in fields if f.name not in fmt.optional]
    return typed.withColumn("reject_reason", reason).select(column, "reject_reason", *kept, *filled)


def accepted(checked: DataFrame, fmt: MetricFormat) -> DataFrame:
    """Valid samples with partition columns taken from their own time."""
    names = [f.name for f in parsed_schema(fmt.schema).fields]
    return with_ingestion_parts(checked.where(F.col("reject_reason").isNull()).select(*names))


def rejected(checked: DataFrame, column: str = "value") -> DataFrame:
    return checked.where(F.col("reject_reason").isNotNull()).select(column, "reject_reason")


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def metric_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream over a folder of metric JSON lines; each file is read once."""
    return message_stream(spark, path, max_files)
