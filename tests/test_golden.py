"""Figures worked out by hand: a sample of four events, borders of windows, odd times and paths."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.times import aligned, parse_iso
from tidegauge.functions.web import normalize_endpoint, route_template
from tidegauge.operators.anomaly import anomaly_features, anomaly_latest, score_anomaly
from tidegauge.operators.bot import bot_as_run, bot_features, bot_latest, score_bot
from tidegauge.operators.enrich import enrich
from tidegauge.operators.forecast import forecast_features, forecast_latest, score_forecast, traffic_buckets
from tidegauge.operators.normalize import normalize, quarantine, retained, shift_to
from tidegauge.settings import Settings
from tidegauge.sinks import write_fallback
from tidegauge.sources.logs import or_sample, read_json_logs, typed_logs

S = Settings()
ROW = {"schema_version": "v2", "session_id": "s", "ip": "10.0.0.1", "user_agent": "Mozilla/5.0", "method": "GET", "endpoint": "/a", "status": 200, "latency_ms": 10}
# The sample: (seconds after 10:00:00, client, address, agent, endpoint, status, latency).
SAMPLE = [(0, "b1", "1.2.3.4", "Googlebot/2.1", "/p", 200, 80), (5, "b1", "1.2.3.4", "Googlebot/2.1", "/p", 404, 95), (12, "u10", "192.168.1.10", "Mozilla/5.0", "/o", 500, 3200), (40, "u11", "192.168.1.11", "Mozilla/5.0 (Mobile)", "/l", 200, 140)]


def logs(spark, *rows):
    return typed_logs(spark.createDataFrame([(json.dumps(ROW | r),) for r in rows], "value string"))


def at(second: float) -> str:
    t = datetime.datetime(2026, 3, 24, 10) + datetime.timedelta(seconds=second)
    return t.isoformat() + "Z"


def events(spark, *seconds, **more):
    return normalize(logs(spark, *({"timestamp": at(s), "request_id": f"r{i}", **more} for i, s in enumerate(seconds))))


@pytest.fixture(scope="module")
def sample(spark):
    return normalize(logs(spark, *({"timestamp": at(t), "request_id": f"r{t}", "session_id": c, "ip": i, "user_agent": a, "endpoint": e, "status": s, "latency_ms": m} for t, c, i, a, e, s, m in SAMPLE)))


def test_sample_of_four_events(sample):
    bots = {r.session_id: r for r in score_bot(bot_latest(sample), S).collect()}
    got = {k: (r.number_of_requests, r.total_duration_s, r.average_time_ms, r.http_response_4xx, r.http_response_5xx, r.max_barrage, r.bot_score, r.is_bot) for k, r in bots.items()}
    assert got == {"b1": (2, 5.0, 87.5, 0.5, 0.0, 1, 0.715, 1), "u10": (1, 0.0, 3200.0, 0.0, 1.0, 1, 0.42, 0), "u11": (1, 0.0, 140.0, 0.0, 0.0, 1, 0.32, 0)}
    found = {r.endpoint: r for r in score_anomaly(anomaly_latest(sample), S).collect()}
    assert {k: (r.request_count, r.p95_latency_ms, r.p99_latency_ms, r.baseline_avg_latency_ms, r.anomaly_score, r.is_anomaly) for k, r in found.items()} == {
        "/l": (1, 140.0, 140.0, 140.0, 0.0, 0), "/o": (1, 3200.0, 3200.0, 3200.0, 0.2, 0), "/p": (2, 94.25, 94.85, 87.5, 0.0076, 0)}
    loads = {r.endpoint: r for r in score_forecast(forecast_latest(traffic_buckets(sample, 60), "2026-03-24T10:00:40Z"), S).collect()}
    assert {k: (r.history_rps[-2:], r.rolling_mean_5, r.rolling_std_5, r.predicted_request_count) for k, r in loads.items()} == {
        "": ([1, 3], 0.8, 1.166, 5), "/p": ([1, 1], 0.4, 0.49, 1), "/o": ([0, 1], 0.2, 0.4, 2), "/l": ([0, 1], 0.2, 0.4, 2)}
    assert loads[""].hour_of_day == 10 and loads[""].day_of_week == 1


def test_borders_of_windows(spark):
    edge = events(spark, 0, 60)
    assert [r.number_of_requests for r in bot_latest(edge).collect()] == [1]  # the start is outside, the end inside
    assert bot_latest(events(spark, 0.9)).collect() == []
    ends = spark.createDataFrame([(at(0.9),), (at(1),)], "t string").select(aligned(parse_iso(F.col("t")), 60).cast("string").alias("e"))
    assert [r.e[11:] for r in ends.collect()] == ["10:00:00", "10:01:00"]
    assert [r.request_id for r in retained(events(spark, 0, 360, -1), 360).orderBy("request_id").collect()] == ["r0", "r1"]
    night = events(spark, -4 * 3600 - 1, -4 * 3600 - 1, -4 * 3600, -4 * 3600)
    assert bot_features(night).where("number_of_requests = 4").select("night").distinct().first().night == 1
    third = events(spark, -4 * 3600 - 1, -4 * 3600, -4 * 3600)
    assert bot_features(third).where("number_of_requests = 3").select("night").distinct().first().night == 0
    assert bot_as_run(third).first().night == 1


def test_sliding_sums_over_spans_and_gaps(spark):
    """Against every window by itself, over more than a span of SPAN window lengths, with a hot client."""
    seconds = sorted({7 * i % 5000 + (i // 700) * 9000 for i in range(1500)})
    table = events(spark, *seconds)
    got = {r.window_end.timestamp(): (r.number_of_requests, r.total_duration_s, r.max_barrage) for r in bot_features(table).collect()}
    start = datetime.datetime(2026, 3, 24, 10, tzinfo=datetime.UTC).timestamp()
    times = [start + s for s in seconds]
    want = {}
    for end in {(-(-t // 10) + j) * 10 for t in times for j in range(6)}:
        mine = [t for t in times if end - 60 < t <= end]
        want[end] = (len(mine), max(mine) - min(mine), 1)
    assert got == want
    counts = {(r.window_end.timestamp()): (r.request_count, r.baseline_avg_latency_ms) for r in anomaly_features(table).collect()}
    assert counts == {e: (n, 10.0) for e, (n, _, _) in want.items()}


def test_times_with_a_date_only(spark):
    texts = ["2026-03-24T10:00:00Z", "2026-03-24 10:00:00.5+03:30", "2026-03-24T10:00", "2026-03-24", "2026-03-24T10:00:00,25+0330", "10:00", "2026", "2026-03", "abc", "", "2026-02-30", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "v string").select(parse_iso(F.col("v")).cast("string").alias("t")).collect()]
    assert got[:5] == ["2026-03-24 10:00:00", "2026-03-24 06:30:00.5", "2026-03-24 10:00:00", "2026-03-24 00:00:00", "2026-03-24 06:30:00.25"] and got[5:] == [None] * 7


def test_malformed_logs_go_to_quarantine(spark):
    good, bad = quarantine(normalize(logs(spark, {"timestamp": at(0), "status": "abc"}, {"timestamp": at(1), "status": 500.7}, {"timestamp": "10:00"}, {"timestamp": "2026"}, {"timestamp": at(2), "status": "404"}, {"timestamp": at(3), "status": None, "extra": 1})))
    assert sorted((r.event_time.second, r.status) for r in good.collect()) == [(2, 404), (3, 200)] and "line" not in good.columns
    assert sorted(e for r in bad.collect() for e in r.errors) == ["event_time: no date-time"] * 2 + ["status: expected integer"] * 2
    untyped = spark.createDataFrame([(at(0), "x"), (at(0), "7")], "timestamp string, status string").selectExpr("*", *(f"string(null) AS {c}" for c in ("schema_version", "request_id", "session_id", "ip", "user_agent", "method", "endpoint", "route_template", "latency_ms")))
    assert sorted(r.status for r in normalize(untyped).collect()) == [7, 200]


def test_original_event_time(spark):
    s = Settings(use_original_event_time=True)
    replayed = normalize(logs(spark, {"timestamp": "2026-04-06T10:00:00Z", "original_timestamp": "2019-01-22T00:26:16Z", "request_id": "r"}), s)
    buckets = traffic_buckets(replayed, 60)
    assert {str(r.e) for r in buckets.select(F.col("bucket_end").cast("string").alias("e")).collect()} == {"2019-01-22 00:27:00"}
    row = enrich(replayed, score_bot(bot_features(replayed), s), score_anomaly(anomaly_features(replayed), s), score_forecast(forecast_features(buckets, s), s), s).select(F.col("timestamp").cast("string"), F.col("replay_timestamp").cast("string")).first()
    assert tuple(row) == ("2019-01-22 00:26:16", "2026-04-06 10:00:00")


def test_sample_in_place_of_an_idle_source(spark, sample):
    held = logs(spark, {"timestamp": at(0)}, {"timestamp": at(30)}, {"timestamp": "soon"})
    none = held.where("false")
    assert or_sample(held, none, at(0))[1] == "kafka" and or_sample(none, held, at(0), Settings(use_original_event_time=True)) == (None, "idle")
    moved, source = or_sample(none, held, "2030-01-01T00:00:00Z")
    assert source == "sample" and sorted(r.timestamp for r in moved.collect()) == ["2029-12-31T23:59:30Z", "2030-01-01T00:00:00Z", "soon"]
    assert shift_to(none, at(0)).collect() == []


def test_paths(spark):
    cases = {"/a+b%20c": "/a+b c", "/a%zzb%20c": "/a%zzb c", "http://h:1/x?y=1#z": "/x", "h:80/p": "/80/p", "mailto:x@y": "/x@y", "?q": "/?q", "//host/p": "/p", "%": "/%"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", normalize_endpoint(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in got} == cases
    shown = spark.createDataFrame([("/image/60844/productModel/200x200",)], "t string").select(route_template(F.col("t")).alias("e")).first().e
    assert shown == "/image/{id}/productModel/{size}"


def test_files_of_lines(spark, tmp_path, sample):
    (tmp_path / "a.jsonl").write_text('{"timestamp": "2026-03-24T10:00:00Z", "status": 200}\n\n  \nnot json\n[1]\n')
    found = read_json_logs(spark, str(tmp_path / "a.jsonl")).collect()
    assert [r.errors for r in found] == [[], ["expected object"], ["expected object"]] and found[0].status == 200
    write_fallback({"processed_logs": sample.select("request_id"), "anomaly_alerts": sample.select("endpoint").limit(1)}, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["table"] for x in lines) == ["anomaly_alerts"] + ["processed_logs"] * 4
