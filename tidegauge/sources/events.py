"""The driver's ``events`` table as raw logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENDPOINTS = ["catalog/search", "auth", "account", "catalog/product", "basket", "payment", "media/img", "admin/user"]
AGENTS = ["Mozilla/5.0", "Mozilla/5.0 (Mobile)", "Mozilla/5.0 (X11; Linux x86_64)", "Googlebot/2.1", "curl/8.6.0", "python-requests/2.32.3"]


def as_raw_logs(events: DataFrame) -> DataFrame:
    """Rows of ``events`` as events of the log pipeline; event_id is the order of arrival.

    Columns event_id, timestamp (ISO text, whole seconds), event_time (with its part of a second) and
    those of a raw log.
    """
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    u = F.col("user_id")
    kind = F.col("event_type")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    ts = F.col("ts").cast("timestamp")
    endpoint = F.concat(F.lit("/shop/"), pick(ENDPOINTS, k % 8))
    method = F.when(kind == "click", F.when(k % 7 == 0, "HEAD").otherwise("GET")).when(kind.isin("signup", "purchase"), "POST").when((kind == "error") & (k % 3 == 0), "PATCH").otherwise("GET")
    status = F.when(kind == "error", pick([500, 503, 404, 429], k % 4)).when(kind == "signup", 201).when((kind == "click") & (k % 10 == 0), 302).otherwise(200)
    ip = F.when(u % 25 == 0, "1.2.3.4").when(u % 25 == 1, "1.1.1.1").otherwise(F.format_string("10.0.%d.%d", F.floor(u / 256), u % 256))
    return events.select(
        "event_id",
        F.lit("v2").alias("schema_version"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.lit(None).cast("string").alias("original_timestamp"),
        F.format_string("req-%06d", F.col("event_id")).alias("request_id"),
        F.concat(F.lit("sess-u"), u.cast("string")).alias("session_id"),
        ip.alias("ip"),
        pick(AGENTS, u % 6).alias("user_agent"),
        method.alias("method"),
        endpoint.alias("endpoint"),
        endpoint.alias("route_template"),
        status.alias("status"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        ts.alias("event_time"),
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_logs(spark.read.parquet(f"{sf_dir}/events.parquet"))
