"""New samples scored as their files arrive: the batch functions on a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlens.operators.scoring import score_risk, score_types
from cohortlens.sources.bundle import ModelBundle


def read_sample_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(folder)


def score_stream(samples: DataFrame, bundle: ModelBundle, **options) -> DataFrame:
    """Stateless per row, so it needs no watermark; missing values take training medians."""
    score = score_risk if bundle.kind == "binary" else score_types
    return score(samples, bundle, missing="training", **options)


def write_score_stream(scored: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scores as Parquet; the checkpoint folder must be on shared storage."""
    writer = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
