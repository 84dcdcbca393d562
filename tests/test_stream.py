"""The whole pipeline as a stream, with late and repeated events and restarts, against the batch functions."""

import datetime

from pyspark.sql import functions as F

from tidegauge.operators import rollups
from tidegauge.operators.anomaly import anomaly_features, score_anomaly
from tidegauge.operators.bot import bot_features, score_bot
from tidegauge.operators.enrich import anomaly_rows, bot_rows, enrich, forecast_rows
from tidegauge.operators.forecast import forecast_features, score_forecast, traffic_buckets
from tidegauge.settings import Settings
from tidegauge.sinks import commits, read_table
from tidegauge.streaming.stream import run_stream

START = datetime.datetime(2026, 3, 1, 9, 50, tzinfo=datetime.UTC)
SCHEMA = "schema_version string, timestamp string, original_timestamp string, request_id string, session_id string, ip string, user_agent string, method string, endpoint string, route_template string, status int, latency_ms int, event_time timestamp"


def event(i: int, second: int, request: str | None = None) -> tuple:
    t = START + datetime.timedelta(seconds=second)
    client = i % 5
    return ("v2", t.strftime("%Y-%m-%dT%H:%M:%SZ"), None, request or f"req-{i}", f"s{client}", f"10.0.0.{client}", "agent", "GET", f"/e{i % 3}", f"/e{i % 3}", 500 if i % 7 == 0 else 200, 20 + i % 90, t)


def tables_of(events, s):
    bots, anomalies = score_bot(bot_features(events, s), s), score_anomaly(anomaly_features(events, s), s)
    forecasts = score_forecast(forecast_features(traffic_buckets(events, s.bucket), s), s)
    return {"processed_logs": enrich(events, bots, anomalies, forecasts, s), "bot_feature_windows": bot_rows(bots), "load_forecasts": forecast_rows(forecasts), "anomaly_alerts": anomaly_rows(anomalies)}


def closed(rows, name, until):
    time = {"processed_logs": "timestamp", "load_forecasts": "bucket_end"}.get(name, "window_end")
    return rows.where(F.unix_seconds(F.col(time)) <= until)


def files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_stream_equals_batch(spark, tmp_path):
    s = Settings()
    first = [event(i, i * 5) for i in range(100)]  # 500 seconds
    second = [event(100 + i, 500 + i * 5) for i in range(100)] + [event(900, 450), event(901, 700)]  # 901 is out of order
    late = [event(990, 10), event(991, 200)]  # their spans are closed by then
    repeated = [event(150, 750), event(199, 995, "req-199")]
    third = [event(200 + i, 1500 + i * 5) for i in range(50)]
    batches = [first, second, third + late + repeated + [event(5000, 9_000)]]
    source, out = str(tmp_path / "in"), tmp_path / "out"
    root, good, seen, before = str(out), [], [], {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        run_stream(stream, root, s, available_now=True, roll_up=True).awaitTermination()  # started again for each file
        good += [*rows[:50], rows[-1]] if n == 2 else rows
        seen += rows
        watermark = max(r[-1] for r in seen).timestamp() - s.event_retention
        ends = [-(-r[-1].timestamp() // 60) * 60 for r in good]
        until = max((e for e in ends if e + 1 <= watermark), default=None)
        assert until == max((c["until"] for c in commits(spark, root).values()), default=None)
        want = tables_of(spark.createDataFrame(good, SCHEMA), s)
        for name, all_rows in want.items():
            rows = closed(all_rows, name, until)
            got = read_table(spark, root, name)
            assert sorted(map(str, got.select(*rows.columns).collect())) == sorted(map(str, rows.collect())), (n, name)
        now = files(out / "processed_logs") | files(out / "bot_feature_windows") | files(out / "load_forecasts") | files(out / "anomaly_alerts")
        assert before.items() <= now.items() and len(now) > len(before)  # nothing is written again
        before = now
    for name, of in (("bot_stats_hourly", "bot_feature_windows"), ("endpoint_perf_hourly", "anomaly_alerts"), ("system_traffic_minutely", "processed_logs")):
        got = rollups.rolled_up(read_table(spark, root, name), name)
        again = getattr(rollups, name)(closed(want[of], of, until))
        places = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*again.columns).collect())
        assert places(got) == places(again), name
    # a day later the state of the day before is gone, what was written stays
    for later in ([event(6000, 90_000), event(6001, 95_000)], [event(6002, 99_000)], [event(6003, 105_000)]):
        spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), root, s, available_now=True).awaitTermination()
    slots = {int(f.name[5:]) for f in (out / "state" / "bot").iterdir() if f.name.startswith("slot=")}
    assert min(slots) * 3600 > START.timestamp() + 85_000
    assert before.items() <= files(out / "processed_logs").items() | files(out / "bot_feature_windows").items() | files(out / "load_forecasts").items() | files(out / "anomaly_alerts").items()
