"""Document operators on streams: they are stateless, so a stream goes through them as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.nodes import variant_nodes


def stream_table(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def stream_nodes(events: DataFrame, json_column: str, keep: list[str], depth: int = 2) -> DataFrame:
    """Node rows of a JSON text column of a stream."""
    return variant_nodes(events.withColumn("__v", F.try_parse_json(json_column)), "__v", keep, depth)


def windowed_counts(events: DataFrame, time: str, key: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a key in tumbling windows; late rows are dropped after the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), key).agg(F.count("*").alias("n"))


def run_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all there is as Parquet, exactly once, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
