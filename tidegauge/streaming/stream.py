"""The log pipeline as a stream: events wait in the state store until their windows close.

Sums of a batch go to folders of that batch, by slot of time, which a repeated batch replaces; so a lost
executor or a restart from the checkpoint leaves every event counted once.  Slots that no later window
can need are neither read nor kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.anomaly import anomaly_partials, anomaly_windows, score_anomaly
from ..operators.bot import bot_partials, bot_windows, score_bot
from ..operators.enrich import anomaly_rows, bot_rows, enrich, forecast_rows
from ..operators.forecast import forecast_features, score_forecast, traffic_buckets
from ..functions.times import aligned
from ..operators.rollups import roll_up_states
from ..settings import Settings
from ..sinks import commits, write_batch


#: Time column of each kind of sums.
_TIMES = {"bot": "pane", "anomaly": "pane", "buckets": "bucket_end"}


def _keep(s: Settings) -> int:
    """Seconds of sums that a window or history may still need."""
    return max(s.event_retention, s.bucket_retention)


def _slot(time: str, s: Settings) -> Column:
    """The folder of a time: a span of as many seconds as are kept, an hour at least."""
    return F.floor(F.unix_seconds(time) / max(3600, _keep(s)))


def _put(df: DataFrame, path: str, batch: int, time: str, s: Settings) -> None:
    out = df.withColumn("slot", _slot(time, s)).withColumn("batch", F.lit(batch)).sortWithinPartitions("slot")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(path)


def _put_sums(batch: DataFrame, path: str, number: int, s: Settings) -> None:
    _put(bot_partials(batch, s.bot_slide), f"{path}/bot", number, "pane", s)
    _put(anomaly_partials(batch, s.anomaly_slide), f"{path}/anomaly", number, "pane", s)
    _put(traffic_buckets(batch, s.bucket), f"{path}/buckets", number, "bucket_end", s)


def _start(query, available_now: bool, s: Settings) -> StreamingQuery:
    query = query.trigger(availableNow=True) if available_now else query.trigger(processingTime=f"{s.trigger_seconds} seconds")
    return query.start()


def stream_partials(events: DataFrame, path: str, s: Settings = Settings(), available_now: bool = False) -> StreamingQuery:
    """Starts a query that keeps the sums of bot windows, anomaly windows and traffic buckets of a
    stream of events (whole seconds) below ``path``."""

    def each(batch: DataFrame, number: int) -> None:
        _put_sums(batch, path, number, s)

    return _start(events.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint"), available_now, s)


def _read(spark: SparkSession, path: str, name: str, s: Settings, since: int | None, last: int | None) -> DataFrame:
    found = spark.read.parquet(f"{path}/{name}")
    if since is not None:
        found = found.where((F.col("slot") >= since // max(3600, _keep(s))) & (F.unix_seconds(_TIMES[name]) >= since))
    if last is not None:
        found = found.where(F.col("batch") <= last)
    return found.drop("batch", "slot")


def streamed_features(spark: SparkSession, path: str, s: Settings = Settings(), since: int | None = None, last: int | None = None, until: int | None = None) -> dict[str, DataFrame]:
    """Scored windows and forecasts of the sums kept so far, of batches up to ``last``; ``since`` (seconds)
    bounds the state that is read, by folder, and ``until`` is the end of what is known.  Windows that
    begin before ``since`` lack what came before it."""
    buckets = _read(spark, path, "buckets", s, since, last).groupBy("scope", "endpoint", "bucket_end").agg(F.sum("requests").alias("requests"))
    sums = _read(spark, path, "anomaly", s, since, last).groupBy("endpoint", "pane", "latency_ms").agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    return {
        "bot": score_bot(bot_windows(_read(spark, path, "bot", s, since, last), s.bot_window, s.bot_slide), s),
        "anomaly": score_anomaly(anomaly_windows(sums, s), s),
        "forecast": score_forecast(forecast_features(buckets, s, until), s),
    }


def _expire(spark: SparkSession, path: str, before: int, s: Settings) -> None:
    """Deletes the state of all slots before a time."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in _TIMES:
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/slot=*")) or []:
            if int(status.getPath().getName().split("=")[1]) < before // max(3600, _keep(s)):
                fs.delete(status.getPath(), True)


def grid(s: Settings) -> int:
    """Seconds between the times at which windows and buckets of all kinds end together."""
    return math.lcm(s.bot_slide, s.anomaly_slide, s.bucket)


def closed_events(events: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Each event of a stream once, as soon as all windows and buckets that end at its grid points are closed.

    Events (whole seconds) wait in the state store, keyed by their span of the grid and request id,
    until the watermark, which is ``event_retention`` seconds behind the latest event, passes the
    span's end.  Events without a time, repeated request ids within that retention, and events of a
    span that is closed are left out.  The state holds the events of the open spans and the request
    ids of the retention; both leave it by the watermark.
    """
    timed = events.where("event_time is not null").withWatermark("event_time", f"{s.event_retention} seconds")
    unique = timed.dropDuplicatesWithinWatermark(["request_id"])
    span = F.window("event_time", f"{grid(s)} seconds", startTime="1 second")  # spans are (start, end]
    return unique.groupBy(span, "request_id").agg(F.first(F.struct(*events.columns)).alias("event")).select("event.*")


def run_stream(events: DataFrame, root: str, s: Settings = Settings(), available_now: bool = False, roll_up: bool = False) -> StreamingQuery:
    """Starts the whole pipeline: events with their scores and the three feature tables, below ``root``.

    Takes the events that ``closed_events`` lets go.  A micro-batch then holds all events of the spans
    since the one before, and so all windows that end in these spans are complete: each is written once,
    in the batch that closes it, from the batch's sums and those of earlier batches that still reach
    into them.  What a batch writes is in proportion to its events; nothing is written twice.  The four tables of
    a batch (and, with ``roll_up``, the mergeable states of the five roll-ups) become visible together,
    see ``sinks``.  A batch that is repeated after a crash is written over or, if it was committed,
    left as it is.  In the end the tables hold the rows that the batch functions give, up to the last
    span that is closed.
    """
    spark = events.sparkSession
    state = f"{root}/state"

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            until = batch.agg(F.unix_seconds(aligned(F.max("event_time"), grid(s)))).first()[0]
            if until is None:
                return
            begun = max((c["until"] for c in commits(spark, root).values() if c.get("number", number) < number), default=None)
            since = begun - _keep(s) if begun is not None else None
            _put_sums(batch, state, number, s)
            got = streamed_features(spark, state, s, since, number, until)
            new = lambda df, time: df.where((F.unix_seconds(F.col(time)) <= until) & (F.unix_seconds(F.col(time)) > (begun if begun is not None else F.lit(-(1 << 62)))))
            bots, anomalies, forecasts = new(got["bot"], "window_end"), new(got["anomaly"], "window_end"), new(got["forecast"], "bucket_end")
            tables = {"processed_logs": enrich(batch, bots, anomalies, forecasts, s), "bot_feature_windows": bot_rows(bots), "load_forecasts": forecast_rows(forecasts), "anomaly_alerts": anomaly_rows(anomalies)}
            write_batch(tables | (roll_up_states(tables) if roll_up else {}), root, number, number=number, until=until)
            if since is not None:
                _expire(spark, state, since, s)
        finally:
            batch.unpersist()

    return _start(closed_events(events, s).writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/checkpoint"), available_now, s)
