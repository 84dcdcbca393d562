"""One query per operator, over the whole ``events`` or ``pages`` table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.web import infer_latency_ms, normalize_endpoint, route_template
from ..operators import anomaly, bot, enrich, forecast, models, rollups
from ..functions.sliding import sliding, spans
from ..functions.times import aligned, iso_text, parse_iso
from ..operators.normalize import judged, normalize, retained, whole_seconds
from ..operators.quality import validate
from ..schema import CONTRACTS
from ..settings import Settings
from ..sources.access_log import parse_lines, rebase, sessionize
from ..sources.events import as_raw_logs, raw_logs
from ..sources.logs import read_json_logs
from ..sinks import read_table, write_batch
from ..store import save_bucketed
from ..streaming.stream import run_stream, stream_partials, streamed_features
from .faults import record_text

#: The events table has one event in minutes, so windows of hours and days are the useful ones.
WIDE = Settings(bot_window=86400, bot_slide=14400, anomaly_window=3600, anomaly_slide=600, anomaly_lookback=18000, bucket=3600)
PLAIN = Settings()
RANGE = ("2024-01-09 04:05:06", "2024-01-16 07:08:09")
SESSION_GAP, KEEP, ANCHOR = 21_600, 864_000, "2026-04-06T10:00:00Z"


def _out(df: DataFrame, rounded: bool = False) -> DataFrame:
    """Times without zone, as the tables have them; with ``rounded``, doubles to nine places."""
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif rounded and isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 9).alias(f.name)
        cols.append(c)
    return df.select(*cols)


#: Events for each partition of a shuffle, at most. Each has rows in about six windows of every kind.
EVENTS_A_PARTITION = 50_000


def _sized(spark: SparkSession, sf_dir: str) -> SparkSession:
    """The session in UTC, with as many partitions for a shuffle as the events need: their number grows
    with the table, so that what one task holds does not. Stages whose one method would be longer than the
    JVM compiles (8,000 bytes) are left in methods by expression."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    needed = -(-spark.read.parquet(f"{sf_dir}/events.parquet").count() // EVENTS_A_PARTITION)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < needed:
        spark.conf.set("spark.sql.shuffle.partitions", needed)
    return spark


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_logs(_sized(spark, sf_dir), sf_dir)


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_seconds(_events(spark, sf_dir))


def q01_normalize(spark, sf_dir):
    logs = _events(spark, sf_dir).drop("event_time")
    # fields of some rows are taken away, so that defaults show
    gone = lambda c, m: F.when(F.col("event_id") % m != 0, F.col(c)).alias(c)
    holes = {"request_id": 3, "session_id": 5, "ip": 7, "user_agent": 11, "method": 13, "route_template": 17, "status": 19, "latency_ms": 23}
    logs = logs.select(*(gone(c, holes[c]) if c in holes else c for c in logs.columns), F.lit(5).alias("request_time_ms")).withColumn("method", F.lower("method"))
    return _out(normalize(logs)).drop("original_timestamp")


def q02_bot_features(spark, sf_dir):
    return _out(bot.bot_features(_whole(spark, sf_dir), WIDE))


def q02_bot_features_default(spark, sf_dir):
    return _out(bot.bot_features(_whole(spark, sf_dir), PLAIN))


def q03_bot_latest(spark, sf_dir):
    return _out(bot.bot_latest(_events(spark, sf_dir), WIDE))


def _bots(spark, sf_dir):
    return bot.score_bot(bot.bot_features(_whole(spark, sf_dir), WIDE), WIDE)


def q04_bot_scores(spark, sf_dir):
    return _out(_bots(spark, sf_dir).select(*bot.KEYS, "window_end", "bot_score", "is_bot", "model_version"))


def q05_anomaly_features(spark, sf_dir):
    return _out(anomaly.anomaly_features(_whole(spark, sf_dir), WIDE))


def q05_anomaly_latest(spark, sf_dir):
    return _out(anomaly.anomaly_latest(_events(spark, sf_dir), WIDE))


def _anomalies(spark, sf_dir):
    return anomaly.score_anomaly(anomaly.anomaly_features(_whole(spark, sf_dir), WIDE), WIDE)


def q06_anomaly_scores(spark, sf_dir):
    return _out(_anomalies(spark, sf_dir).select("endpoint", "window_end", "anomaly_score", "is_anomaly", "model_version"))


def q07_traffic_buckets(spark, sf_dir):
    return _out(forecast.traffic_buckets(_whole(spark, sf_dir), WIDE.bucket))


def _forecasts(spark, sf_dir):
    buckets = forecast.traffic_buckets(_whole(spark, sf_dir), WIDE.bucket)
    return forecast.score_forecast(forecast.forecast_features(buckets, WIDE), WIDE)


def q08_forecast_features(spark, sf_dir):
    buckets = forecast.traffic_buckets(_whole(spark, sf_dir), WIDE.bucket)
    found = forecast.forecast_features(buckets, WIDE).withColumn("history", F.array_join("history_rps", ","))
    return _out(found.drop("history_rps"))


def q09_forecasts(spark, sf_dir):
    return _out(_forecasts(spark, sf_dir).select("scope", "endpoint", "bucket_end", "predicted_request_count", "model_version"))


def _processed(spark, sf_dir):
    return enrich.enrich(_whole(spark, sf_dir), _bots(spark, sf_dir), _anomalies(spark, sf_dir), _forecasts(spark, sf_dir), WIDE)


def q10_processed_logs(spark, sf_dir):
    return _out(_processed(spark, sf_dir)).drop("replay_timestamp")


def q10_processed_logs_as_of(spark, sf_dir):
    events = _events(spark, sf_dir)
    bots = bot.score_bot(bot.bot_latest(events, WIDE), WIDE)
    anomalies = anomaly.score_anomaly(anomaly.anomaly_latest(events, WIDE), WIDE)
    forecasts = _forecasts(spark, sf_dir)
    last = forecasts.agg(F.max("bucket_end")).scalar()
    return _out(enrich.enrich_as_of(events, bots, anomalies, forecasts.where(F.col("bucket_end") == last), WIDE)).drop("replay_timestamp")


def q11_bot_table(spark, sf_dir):
    return _out(enrich.bot_rows(_bots(spark, sf_dir)))


def q12_forecast_table(spark, sf_dir):
    return _out(enrich.forecast_rows(_forecasts(spark, sf_dir)))


def q13_anomaly_table(spark, sf_dir):
    return _out(enrich.anomaly_rows(_anomalies(spark, sf_dir)))


#: Stored tables: what makes them, the keys of their buckets, their time column.
_STORED = {
    "events": (lambda spark, d: enrich.placed(_whole(spark, d), WIDE), [*bot.KEYS, "bot_end"], "event_time"),
    "bot_feature_windows": (_bots, [*bot.KEYS, "window_end"], "window_end"),
    "anomaly_alerts": (_anomalies, ["endpoint", "window_end"], "window_end"),
    "load_forecasts": (_forecasts, ["endpoint", "bucket_end"], "bucket_end"),
    "processed_logs": (lambda spark, d: enrich.enrich(*(_stored(spark, d, n) for n in ("events", "bot_feature_windows", "anomaly_alerts", "load_forecasts")), WIDE), ["request_id"], "timestamp"),
}


def _table_name(sf_dir: str, name: str) -> str:
    return f"tidegauge_{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}_{name}"


def _stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the events below a folder, stored when a query of the session first asks for it."""
    _sized(spark, sf_dir)
    made, keys, time = _STORED[name]
    table = _table_name(sf_dir, name)
    if spark.catalog.tableExists(table):
        return spark.table(table)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return save_bucketed(made(spark, sf_dir), table, f"{_shared(spark)}/{table}-{uuid.uuid4().hex}", keys, time, buckets)


def q14_table_counts(spark, sf_dir):
    return rollups.table_counts({name: _stored(spark, sf_dir, name) for name in ("processed_logs", "bot_feature_windows", "load_forecasts", "anomaly_alerts")})


def q15_bot_stats_hourly(spark, sf_dir):
    return _out(rollups.bot_stats_hourly(_stored(spark, sf_dir, "bot_feature_windows")), rounded=True)


def q16_endpoint_perf_hourly(spark, sf_dir):
    return _out(rollups.endpoint_perf_hourly(_stored(spark, sf_dir, "anomaly_alerts")), rounded=True)


def q17_forecast_accuracy_hourly(spark, sf_dir):
    return _out(rollups.forecast_accuracy_hourly(_stored(spark, sf_dir, "load_forecasts")), rounded=True)


def q18_processed_logs_summary_hourly(spark, sf_dir):
    return _out(rollups.processed_logs_summary_hourly(_stored(spark, sf_dir, "processed_logs")), rounded=True)


def q19_system_traffic_minutely(spark, sf_dir):
    return _out(rollups.system_traffic_minutely(_stored(spark, sf_dir, "processed_logs")), rounded=True)


def q20_requests_per_minute(spark, sf_dir):
    return _out(rollups.requests_per_minute(_stored(spark, sf_dir, "processed_logs")))


def q21_latest_system_forecast(spark, sf_dir):
    return rollups.latest_system_forecast(_stored(spark, sf_dir, "load_forecasts"))


def q22_top_bots(spark, sf_dir):
    return rollups.top_bots(_stored(spark, sf_dir, "bot_feature_windows"))


def q23_top_anomalies(spark, sf_dir):
    return rollups.top_anomalies(_stored(spark, sf_dir, "anomaly_alerts"))


def q24_sessionize(spark, sf_dir):
    return sessionize(_events(spark, sf_dir).drop("session_id"), "event_id", SESSION_GAP).select("event_id", "session_id", "session_number")


def q25_route_templates(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", route_template(normalize_endpoint(F.col("url"))).alias("route_template"))


def q26_normalize_endpoint(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", normalize_endpoint(F.col("url")).alias("endpoint"))


def q27_latency_heuristic(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", infer_latency_ms(F.col("endpoint"), F.col("status"), F.col("user_agent")).alias("inferred_ms"))


def q28_parse_access_log(spark, sf_dir):
    logs = _events(spark, sf_dir)
    local = F.timestamp_seconds(F.unix_seconds("event_time") + 12_600)
    line = F.concat(
        F.col("ip"), F.lit(" - - ["), F.date_format(local, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0330] "'), F.col("method"), F.lit(" "), F.col("endpoint"),
        F.lit("/"), F.col("event_id").cast("string"), F.lit('?x=1 HTTP/1.1" '), F.col("status").cast("string"), F.lit(' 512 "-" "'), F.col("user_agent"), F.lit('"'),
    )
    line = F.when(F.col("event_id") % 10 == 3, F.lit("no log line")).when(F.col("event_id") % 10 == 7, F.replace(line, F.lit('] "'), F.lit('] "X'))).otherwise(line)
    return _out(parse_lines(logs.select("event_id", line.alias("value")))).drop("latency_ms")


def q30_late_filter(spark, sf_dir):
    return retained(_events(spark, sf_dir), KEEP).select("event_id")


def q30_retained_buckets(spark, sf_dir):
    return _out(forecast.retained_buckets(forecast.traffic_buckets(_whole(spark, sf_dir), WIDE.bucket), WIDE))


def q31_bot_as_run(spark, sf_dir):
    return _out(bot.bot_as_run(retained(_events(spark, sf_dir), KEEP), WIDE))


def q32_anomaly_as_run(spark, sf_dir):
    return _out(anomaly.anomaly_as_run(retained(_events(spark, sf_dir), KEEP), WIDE))


def q34_stream_windows(spark, sf_dir):
    """The windows of q02, from a stream over the files of the events table."""
    _sized(spark, sf_dir)
    root = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream_partials(whole_seconds(as_raw_logs(stream)), root, WIDE, available_now=True).awaitTermination()
    found = streamed_features(spark, root, WIDE)["bot"]
    return _out(found.drop("bot_score", "is_bot", "model_version"))


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    import tempfile

    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def _kept(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: what is used several times is made once."""
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def q35_guardrail(spark, sf_dir):
    model = (F.element_at("history_rps", -1) * 9 - 20).cast("double")
    guarded = forecast.guard_forecast(_forecasts(spark, sf_dir).withColumn("model_forecast", model), "model_forecast", WIDE)
    return _out(guarded.select("scope", "endpoint", "bucket_end", "upper_bound", "predicted_request_count", "model_version"))


def q36_replay_rebase(spark, sf_dir):
    moved = rebase(_events(spark, sf_dir), ANCHOR, "event_id", 30.0)
    return _out(moved.select("event_id", "replay_time", "timestamp"))


#: Linear models with plain weights, whose scores SQL can give as well.
MODEL = replace(WIDE, mode="model")
BOT_MODEL = models.Scorer(models.Linear((0.25, -0.00001, -0.002, 1.5, -0.5, 0.25, 2.0, 1.0, -0.75, 0.5, 1.25, 0.75, 0.5, 0.125), -1.0), tuple(models.BOT_FEATURES), 0.5)
ANOMALY_MODEL = models.Scorer(models.Linear((0.0625, 0.004, 0.002, 0.001, 3.0, -0.006, -1.0), -0.5), tuple(models.ANOMALY_FEATURES), 0.5)
FORECAST_MODEL = models.Scorer(models.Linear((0.0, 0.0, 0.0, 0.0, 0.0, 0.25, 0.25, 0.5, 0.5, 40.0, -12.0, 0.5, 0.125, -0.25), -2.0, logistic=False), tuple(models.FORECAST_FEATURES))


def q37_bot_model(spark, sf_dir):
    """Clients whose windows lack the mean time get the heuristic score."""
    features = bot.bot_features(_whole(spark, sf_dir), MODEL).withColumn("average_time_ms", F.when(F.col("number_of_requests") % 3 != 0, F.col("average_time_ms")))
    return _out(models.score_bot_by(features, BOT_MODEL, MODEL).select(*bot.KEYS, "window_end", "bot_score", "is_bot", "model_version"))


#: Small forests, as ``models.compiled`` makes them of fitted ones.
BOT_FOREST = models.Scorer(models.Forest(((0, 3.5, (3, 0.75, 0.125, 0.5), (13, 1.0, 0.625, 0.9375)), (6, 0.0625, (1, 3600.5, 0.25, (2, 150.25, 0.375, 0.75)), 0.875), (12, 0.0, 0.3125, (8, 0.5, 0.8125, 0.4375))), 14), tuple(models.BOT_FEATURES), 0.5)
FORECAST_FOREST = models.Scorer(models.Forest(((9, 1.5, (10, 0.55, 0.75, 2.25), (11, 0.9, 3.5, 6.0)), (12, 11.0, 1.0, (8, 2.0, 2.5, 7.75))), 14), tuple(models.FORECAST_FEATURES))


def q53_forest_scores(spark, sf_dir):
    """Bot windows and forecasts by forests: windows that lack the mean time, and forecasts past the
    guardrail, keep the heuristic."""
    features = bot.bot_features(_whole(spark, sf_dir), MODEL).withColumn("average_time_ms", F.when(F.col("number_of_requests") % 3 != 0, F.col("average_time_ms")))
    bots = models.score_bot_by(features, BOT_FOREST, MODEL).select(F.concat_ws(" ", *bot.KEYS).alias("entity"), F.col("window_end").alias("at"), F.col("bot_score").alias("value"), F.col("is_bot").cast("string").alias("said"))
    buckets = forecast.forecast_features(forecast.traffic_buckets(_whole(spark, sf_dir), MODEL.bucket), MODEL)
    loads = models.score_forecast_by(buckets, FORECAST_FOREST, MODEL).select(F.concat_ws(" ", "scope", "endpoint"), "bucket_end", F.col("predicted_request_count").cast("double"), "model_version")
    return _out(bots.union(loads))


def q38_anomaly_model(spark, sf_dir):
    """All windows by the model."""
    scored = models.score_anomaly_by(anomaly.anomaly_features(_whole(spark, sf_dir), MODEL), ANOMALY_MODEL, MODEL)
    return _out(scored.select("endpoint", "window_end", "anomaly_score", "is_anomaly", "model_version"))


def q39_forecast_model(spark, sf_dir):
    """Histories of nine buckets, as those for three o'clock, get the heuristic forecast."""
    features = forecast.forecast_features(forecast.traffic_buckets(_whole(spark, sf_dir), MODEL.bucket), MODEL)
    features = features.withColumn("history_rps", F.when(F.col("hour_of_day") == 3, F.slice("history_rps", 2, 9)).otherwise(F.col("history_rps")))
    return _out(models.score_forecast_by(features, FORECAST_MODEL, MODEL).select("scope", "endpoint", "bucket_end", "predicted_request_count", "model_version"))


_V2 = {"feature_version": "'v2'", "window_start": "start_text", "window_end": "end_text", "bucket_end": "start_text", "predicted_bucket_end": "end_text", "history_rps": "history_text"}


def _contract_errors(contract: str, table: Callable[[SparkSession, str], DataFrame], keys: list[str], turn: str, texts: dict[str, str], expressions: dict[str, str | None]) -> Callable[[SparkSession, str], DataFrame]:
    """Every row of a table as a JSON record, about half of them with a planted fault, and the broken rules.

    ``turn`` deals out the faults; ``texts`` are times, or lists, that the records hold as text."""

    def query(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        text, n = record_text(CONTRACTS[contract], expressions)
        rows = table(spark, sf_dir)
        held = rows.withColumns({c: F.array_join(x, ",", "0") if "history" in x else iso_text(F.col(x)) for c, x in texts.items()}).withColumn("fault", F.expr(f"pmod({turn}, {2 * n})"))
        if "history_text" in texts:
            held = held.withColumn("history_text", F.concat(F.lit("["), "history_text", F.lit("]")))
        records = held.select(*keys, F.expr(text).alias("record"))
        return _out(validate(records, "record", CONTRACTS[contract]).select(*keys, F.array_join("errors", "; ").alias("errors")))

    return query


_BY_BOT, _BY_LOAD, _BY_ENDPOINT = [*bot.KEYS, "window_end"], ["scope", "endpoint", "bucket_end"], ["endpoint", "window_end"]
_WINDOW, _BUCKETS = {"start_text": "window_start", "end_text": "window_end"}, {"start_text": "bucket_end", "end_text": "predicted_bucket_end", "history_text": "history_rps"}
_TURN = {"bot": "unix_seconds(window_end) DIV 14400 + number_of_requests", "forecast": "unix_seconds(bucket_end) DIV 3600 + length(endpoint)", "anomaly": "unix_seconds(window_end) DIV 600 + request_count"}
q29_contract_errors = _contract_errors("raw-log", _events, ["event_id"], "event_id", {}, {"original_timestamp": None})
q40_processed_log_contract = _contract_errors("processed-log", lambda spark, d: _stored(spark, d, "processed_logs"), ["request_id"], "latency_ms + status", {"time_text": "timestamp"}, {"timestamp": "time_text", "replay_timestamp": None})
q41_bot_request_contract = _contract_errors("bot-request", _bots, _BY_BOT, _TURN["bot"], _WINDOW, _V2)
q41_bot_response_contract = _contract_errors("bot-response", _bots, _BY_BOT, _TURN["bot"], {}, {"is_bot": "is_bot = 1"})
q42_forecast_request_contract = _contract_errors("forecast-request", _forecasts, _BY_LOAD, _TURN["forecast"], _BUCKETS, _V2)
q42_forecast_response_contract = _contract_errors("forecast-response", _forecasts, _BY_LOAD, _TURN["forecast"], {}, {})
q43_anomaly_request_contract = _contract_errors("anomaly-request", _anomalies, _BY_ENDPOINT, _TURN["anomaly"], _WINDOW, _V2)
q43_anomaly_response_contract = _contract_errors("anomaly-response", _anomalies, _BY_ENDPOINT, _TURN["anomaly"], {}, {"is_anomaly": "is_anomaly = 1"})


def q44_stream_tables(spark, sf_dir):
    """The four tables that the streaming pipeline has written of the events table, up to the last span closed."""
    _sized(spark, sf_dir)
    root = f"{_shared(spark)}/pipeline-{uuid.uuid4().hex}"
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    run_stream(whole_seconds(as_raw_logs(stream)), root, WIDE, available_now=True).awaitTermination()
    rows = {
        "processed_logs": (F.col("request_id"), "timestamp", F.col("bot_score") + F.col("anomaly_score"), "predicted_load"),
        "bot_feature_windows": (F.concat_ws(" ", *bot.KEYS), "window_end", F.col("bot_score"), "max_barrage"),
        "anomaly_alerts": (F.col("endpoint"), "window_end", F.col("anomaly_score"), "request_count"),
        "load_forecasts": (F.concat_ws(" ", "scope", "endpoint"), "bucket_end", F.lit(None).cast("double"), "predicted_request_count"),
    }
    found = None
    for name, (entity, time, score, load) in rows.items():
        part = read_table(spark, root, name).select(F.lit(name).alias("table_name"), entity.alias("entity"), F.col(time).alias("at"), score.alias("score"), F.col(load).cast("long").alias("load"))
        found = part if found is None else found.union(part)
    return _out(found, rounded=True)


def _kept_rollup(name: str, source: str, at: str, made: Callable[[SparkSession, str], DataFrame] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """A roll-up whose states three batches have left in a stored table; each batch has rows of every
    hour, so that those of the later ones are late.  ``made`` gives the source's rows with fewer columns."""

    def query(spark, sf_dir):
        root = f"{_shared(spark)}/rollups-{uuid.uuid4().hex}"
        rows = made(spark, sf_dir) if made else _stored(spark, sf_dir, source)
        for batch in range(3):
            mine = rows.where(F.pmod(F.unix_seconds(at) + F.crc32(F.col("endpoint" if "endpoint" in rows.columns else "ip").cast("binary")), F.lit(3)) == batch)
            write_batch(rollups.roll_up_states({source: mine}, [name]), root, batch)
        return _out(rollups.rolled_up(read_table(spark, root, name), name), rounded=True)

    return query


def _traffic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed logs with what the traffic is made of, written once: the stored table, if the session has it,
    else events with the flags of their own windows; windows at whose end no event is aren't stored."""
    if spark.catalog.tableExists(_table_name(sf_dir, "processed_logs")):
        return _stored(spark, sf_dir, "processed_logs")
    events = _kept(spark, _whole(spark, sf_dir), "normalized")
    bots = bot.score_bot(bot.bot_features(events, WIDE, at_events=True), WIDE)
    anomalies = anomaly.score_anomaly(anomaly.anomaly_features(events, WIDE), WIDE)
    return _kept(spark, enrich.flagged(events, bots, anomalies, WIDE), "flagged")


q45_kept_bot_stats = _kept_rollup("bot_stats_hourly", "bot_feature_windows", "window_end")
q46_kept_endpoint_perf = _kept_rollup("endpoint_perf_hourly", "anomaly_alerts", "window_end")
q47_kept_forecast_accuracy = _kept_rollup("forecast_accuracy_hourly", "load_forecasts", "predicted_bucket_end")
q48_kept_logs_summary = _kept_rollup("processed_logs_summary_hourly", "processed_logs", "timestamp")
q49_kept_system_traffic = _kept_rollup("system_traffic_minutely", "processed_logs", "timestamp", _traffic_rows)


def q50_latency_sketches(spark, sf_dir):
    """Windows of 30 days whose percentiles come from daily sketches, and whether the true ranks of
    those values are within twice the stated error."""
    events = _whole(spark, sf_dir)
    day, window = WIDE.bot_window, 30 * WIDE.bot_window
    found = anomaly.sketched_percentiles(anomaly.latency_sketches(events, day), window, day)
    panes = events.groupBy("endpoint", aligned(F.col("event_time"), day).alias("pane"), "latency_ms").agg(F.count("*").alias("n"))
    bins = sliding(spans(panes, window, day), ["endpoint", "latency_ms"], window, day, ["n"])
    both = bins.join(found, ["endpoint", "window_end"])
    n, error = F.col("request_count"), 2 * anomaly.SKETCH_ERROR

    def within(c: str, q: float):
        """Whether the ranks of the value, from that of its first to that of its last copy, touch q."""
        below, upto = (F.sum(F.when(cond, F.col("n")).otherwise(0)) for cond in (F.col("latency_ms") < F.col(c), F.col("latency_ms") <= F.col(c)))
        return (below / F.first(n) <= q + error) & (upto / F.first(n) >= q - error)

    judged = both.groupBy("endpoint", "window_end").agg(F.first(n).alias("request_count"), within("p95_latency_ms", 0.95).alias("p95_within"), within("p99_latency_ms", 0.99).alias("p99_within"))
    return _out(judged)


def q51_ingest(spark, sf_dir):
    """Events as files of JSON lines with faults planted by event_id, read, normalized, and judged."""
    fields = ["timestamp", "request_id", "session_id", "ip", "user_agent", "method", "endpoint", "status", "latency_ms"]
    logs = _events(spark, sf_dir).select("event_id", "timestamp", F.to_json(F.struct(*fields)).alias("json"))
    line, fault = F.col("json"), F.pmod("event_id", F.lit(16))

    def put(field: str, value: str):
        """The line with JSON text in place of a field's value."""
        return F.regexp_replace(line, F.lit(f'"{field}":("[^"]*"|[0-9]+)'), F.lit(f'"{field}":{value}'))

    planted = {
        0: put("status", '"abc"'), 1: put("status", "500.7"), 2: put("timestamp", '"10:00"'), 3: put("timestamp", '"2026"'), 4: put("status", '"404"'),
        5: F.replace(put("latency_ms", "77"), F.lit('"latency_ms"'), F.lit('"request_time_ms"')), 6: put("ip", "5"), 7: F.lit("[1]"), 8: F.substring(line, 1, 30), 9: put("status", "null"),
        10: F.replace(line, F.col("timestamp"), F.substring("timestamp", 1, 10)), 11: put("latency_ms", "true"), 12: put("timestamp", "7"), 13: F.replace(line, F.substring("timestamp", -4, 4), F.concat(F.substring("timestamp", -4, 3), F.lit("+03:30"))),
    }
    text = line
    for k, broken in planted.items():
        text = F.when(fault == k, broken).otherwise(text)
    path = f"{_shared(spark)}/lines-{uuid.uuid4().hex}"
    logs.select(text.alias("value")).write.text(path)
    found = judged(normalize(read_json_logs(spark, path)))
    return _out(found.select("request_id", "status", "latency_ms", "event_time", F.array_join("errors", "; ").alias("errors")))


def q54_original_time(spark, sf_dir):
    """Replayed events that keep their original time: two in three have one, a day and more before."""
    logs, s = _events(spark, sf_dir).drop("event_time"), replace(WIDE, use_original_event_time=True)
    before = F.date_format(parse_iso(F.col("timestamp")) - F.expr("interval 1 day 90 minutes"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    logs = logs.withColumn("original_timestamp", F.when(F.col("event_id") % 3 == 0, before).when(F.col("event_id") % 3 == 1, F.lit("")))
    logs = logs.withColumn("original_timestamp", F.when(F.col("event_id") % 3 == 2, F.replace(before, F.lit("Z"), F.lit("+00:00"))).otherwise(F.col("original_timestamp")))
    events = _kept(spark, normalize(logs, s), "normalized")
    buckets = _kept(spark, forecast.traffic_buckets(events, s.bucket), "buckets")
    forecasts = forecast.score_forecast(forecast.forecast_features(buckets, s), s)
    bots = bot.score_bot(bot.bot_features(events, s), s)
    anomalies = anomaly.score_anomaly(anomaly.anomaly_features(events, s), s)
    return _out(enrich.enrich(events, bots, anomalies, forecasts, s).select("request_id", "timestamp", "replay_timestamp", "status", "latency_ms"))


def q52_dashboard_range(spark, sf_dir):
    """The dashboard over a week of the stored tables: requests by minute, bots, anomalies, last forecast."""
    logs, bots, anomalies, forecasts = (_stored(spark, sf_dir, n) for n in ("processed_logs", "bot_feature_windows", "anomaly_alerts", "load_forecasts"))
    minutes = rollups.requests_per_minute(logs, RANGE).select(F.lit("requests").alias("panel"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("entity"), F.col("requests").cast("double").alias("value"))
    worst = rollups.top_bots(bots, RANGE).select(F.lit("bots"), "entity", "bot_score")
    slow = rollups.top_anomalies(anomalies, RANGE).select(F.lit("anomalies"), "endpoint", "anomaly_score")
    load = rollups.latest_system_forecast(forecasts, RANGE).select(F.lit("forecast"), F.lit("system"), F.col("predicted_request_count").cast("double"))
    return minutes.union(worst).union(slow).union(load)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, f in globals().items() if k[0] == "q" and k[1:3].isdigit()}
