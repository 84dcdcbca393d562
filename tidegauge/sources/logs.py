"""JSON-lines and Kafka sources of raw logs, and the fallback between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import shift_to
from ..schema import RAW_LOG
from ..settings import Settings


def typed_logs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Raw logs of JSON text, with ``errors`` and the text itself as ``line``; other columns are kept.

    Text fields have to be JSON text; whole numbers may be text of digits too.  A field that is absent
    or null is null and no error; one of another kind is null and named in ``errors``, and so is text
    that is no JSON object.  Fields that a raw log does not have are ignored, blank lines are skipped.
    """
    held = lines.where(F.trim(value) != "").withColumn("line", F.col(value)).withColumn("doc_", F.try_parse_json(value))
    fields = [f.split(" ") for f in RAW_LOG.split(", ")]
    typed, errors = {}, [F.when(~F.coalesce(F.schema_of_variant("doc_").startswith("OBJECT"), F.lit(False)), "expected object")]
    for name, kind in fields:
        found = F.schema_of_variant(F.try_variant_get("doc_", f"$.{name}", "variant"))
        text = F.try_variant_get("doc_", f"$.{name}", "string")
        if kind == "int":
            typed[name] = F.when((found == "BIGINT") | ((found == "STRING") & text.rlike(r"^\s*[+-]?\d+\s*$")), text.try_cast("int"))
        else:
            typed[name] = F.when(found == "STRING", text)
        errors.append(F.when((found != "VOID") & typed[name].isNull(), f"{name}: expected {'integer' if kind == 'int' else 'string'}"))
    return held.withColumns(typed | {"errors": F.array_compact(F.array(*errors))}).drop(value, "doc_")


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw logs of JSON-lines files, with the ``errors`` of each line."""
    return typed_logs(spark.read.text(path))


def stream_json_logs(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    return typed_logs((reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).text(path))


def stream_kafka_logs(spark: SparkSession, servers: str, s: Settings = Settings()) -> DataFrame:
    """Raw logs of a topic. Offsets live in the query's checkpoint, so nothing between two batches is
    missed; needs Spark's Kafka connector on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", s.topic).option("startingOffsets", "latest").option("maxOffsetsPerTrigger", s.batch_size)
    return typed_logs(source.load().select(F.col("value").cast("string")))


def first_with_rows(*candidates: DataFrame) -> DataFrame | None:
    """The first source that has a row; None if all are idle."""
    return next((df for df in candidates if not df.isEmpty()), None)


def or_sample(logs: DataFrame, sample: DataFrame, now: str, s: Settings = Settings()) -> tuple[DataFrame | None, str]:
    """The logs and where they come from: the source itself, where it has any; else the sample, moved
    so that its latest log is ``now``, or, where events keep their original time, nothing (idle)."""
    if not logs.isEmpty():
        return logs, "kafka"
    return (None, "idle") if s.use_original_event_time else (shift_to(sample, now), "sample")


def read_training_samples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples in CSV, the latency under its older name."""
    return spark.read.option("header", True).schema("timestamp string, ip string, endpoint string, status int, request_time_ms int, user_agent string, is_bot int, current_rps int, is_anomaly int").csv(path)
