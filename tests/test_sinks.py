"""Batches that become visible at once: crashes, repeats, seeds, compaction, retention."""

import pytest

from tidegauge import sinks
from tidegauge.sinks import batch_summary, commit, commits, compact, prune, put_table, read_table, seed_if_empty, write_batch


def alerts(spark, *rows):
    return spark.createDataFrame(list(rows), "endpoint string, at string").selectExpr("endpoint", "timestamp(at) AS window_end")


def logs(spark, *rows):
    return spark.createDataFrame(list(rows), "endpoint string, ip string, at string").selectExpr("endpoint", "ip", "timestamp(at) AS timestamp")


def names(df):
    return sorted(r.endpoint for r in df.collect())


def test_seed_batches_and_a_crash_between_two_tables(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        read_table(spark, root, "anomaly_alerts")
    assert seed_if_empty(spark, root, "anomaly_alerts", alerts(spark, ("/seed", "2026-03-01 00:00:00")))
    assert not seed_if_empty(spark, root, "anomaly_alerts", alerts(spark, ("/twice", "2026-03-01 00:00:00")))
    first = {"anomaly_alerts": alerts(spark, ("/a", "2026-03-31 23:00:00"), ("/b", "2026-04-01 00:00:00")), "processed_logs": logs(spark, ("/a", "1", "2026-03-31 23:00:00"))}
    assert write_batch(first, root, 0) and not write_batch(first, root, 0)
    assert names(read_table(spark, root, "anomaly_alerts")) == ["/a", "/b", "/seed"]
    assert batch_summary(commits(spark, root)["0"]["rows"], "kafka", "file") == {"source": "kafka", "sink": "file", "count": 1, "bot_windows": 0, "forecasts": 0, "anomalies": 2}
    # a crash after the first table of batch 1: neither table shows it
    put_table(alerts(spark, ("/c", "2026-05-01 00:00:00"), ("/d", "2026-04-02 00:00:00")), root, "anomaly_alerts", "1")
    assert names(read_table(spark, root, "anomaly_alerts")) == ["/a", "/b", "/seed"]
    assert names(read_table(spark, root, "processed_logs")) == ["/a"]
    # the repeated batch leaves nothing of the crash behind
    assert write_batch({"anomaly_alerts": alerts(spark, ("/c", "2026-04-02 00:00:00")), "processed_logs": logs(spark, ("/c", "1", "2026-04-02 00:00:00"))}, root, 1)
    assert names(read_table(spark, root, "anomaly_alerts")) == ["/a", "/b", "/c", "/seed"]
    assert names(read_table(spark, root, "anomaly_alerts", ["202604"])) == ["/b", "/c"]
    with pytest.raises(FileExistsError):
        commit(spark, root, "1", {"tables": []})
    with pytest.raises(ValueError):
        write_batch(first, root, "../x")
    assert write_batch({"anomaly_alerts": alerts(spark, ("/z", "2026-04-02 00:00:00")).where("false")}, root, "empty")
    assert len(names(read_table(spark, root, "anomaly_alerts"))) == 4


def test_compaction_keeps_rows_even_if_it_breaks_off(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for i in range(5):
        write_batch({"anomaly_alerts": alerts(spark, (f"/{i}", f"2026-0{i + 1}-01 00:00:00"))}, root, i, number=i, until=i * 60)
    merged = compact(spark, root, keep=2)
    assert names(read_table(spark, root, "anomaly_alerts")) == ["/0", "/1", "/2", "/3", "/4"]
    assert set(commits(spark, root)) == {merged, "3", "4"} and commits(spark, root)[merged]["until"] == 120
    assert not (tmp_path / "anomaly_alerts" / "batch=0").exists()
    monkeypatch.setattr(sinks, "commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        compact(spark, root, keep=1)
    assert names(read_table(spark, root, "anomaly_alerts")) == ["/0", "/1", "/2", "/3", "/4"]
    assert compact(spark, root, keep=10) is None


def test_retention_by_month_and_by_day(spark, tmp_path):
    root = str(tmp_path)
    write_batch({"anomaly_alerts": alerts(spark, ("/old", "2026-01-15 00:00:00"), ("/new", "2026-03-15 00:00:00"))}, root, 0)
    minutes = spark.sql("SELECT timestamp(d) AS minute, 1L AS n FROM VALUES '2026-03-01 10:00:00', '2026-03-09 10:00:00', '2026-03-15 10:00:00' AS t(d)")
    write_batch({"system_traffic_minutely": minutes}, root, 1)
    assert prune(spark, root, "anomaly_alerts", "2026-03-16 12:00:00") == ["202601"]
    assert names(read_table(spark, root, "anomaly_alerts")) == ["/new"]
    assert prune(spark, root, "system_traffic_minutely", "2026-03-16 12:00:00") == ["20260301"]
    assert read_table(spark, root, "system_traffic_minutely", ["20260315"]).count() == 1
    plan = read_table(spark, root, "system_traffic_minutely")._jdf.queryExecution().toString()
    assert "20260301" not in plan
