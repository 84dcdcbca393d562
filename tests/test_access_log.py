"""Access-log files: discovery, parsing, sessions of hot clients, replay."""

import gzip
import random

import pytest

from tidegauge.sources.access_log import discover_log_files, line_counts, parse_counted, read_lines, replay_access_logs, sessionize

LINE = '10.0.0.{} - - [22/Jan/2019:03:56:{:02d} +0330] "{} HTTP/1.1" {} 512 "-" "agent/{}"\n'


def by_hand(records, gap):
    last, number, out = {}, {}, {}
    for seq, ip, agent, t in sorted(records):
        k = ip, agent
        if k not in last or t < last[k] or t - last[k] > gap:
            number[k] = number.get(k, 0) + 1
        last[k] = t
        out[seq] = number[k]
    return out


@pytest.mark.parametrize("span_rows", [1, 7, 100, 1 << 20])
def test_sessions_of_a_client_with_a_third_of_the_rows(spark, span_rows):
    rng = random.Random(span_rows)
    records, t = [], 0
    for seq in range(3000):
        t += rng.choice([0, 1, 20, 20, 900, 901, 2000, -5])
        ip = "hot" if rng.random() < 0.35 else rng.choice(["a", "b", None])
        records.append((seq, ip, rng.choice(["x", None]) if ip != "hot" else "x", max(t, 0)))
    table = spark.createDataFrame(records, "seq long, ip string, user_agent string, t long").selectExpr("*", "timestamp_seconds(t) AS event_time").repartition(5)
    found = sessionize(table, "seq", 900, span_rows)
    assert set(found.columns) == {*table.columns, "session_id", "session_number"}
    want = by_hand([(s, str(i), str(u), t) for s, i, u, t in records], 900)
    assert {r.seq: r.session_number for r in found.collect()} == want
    if span_rows == 100:  # no group of a window over records holds more than a span
        assert max(r["count"] for r in table.selectExpr("ip", "user_agent", "floor(seq / 100) AS s").groupBy("ip", "user_agent", "s").count().collect()) <= 100


def test_files_to_replay(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "access.log").write_text("".join(LINE.format(1, i, f"GET /a/{i}", 200, 1) for i in range(5)) + "no log line\n")
    with gzip.open(tmp_path / "sub" / "b.gz", "wt") as f:
        f.write(LINE.format(2, 1, "POST /b", 500, 2))
    (tmp_path / "notes.md").write_text("not a log")
    found = discover_log_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in found] == ["access.log", "b.gz"]
    with pytest.raises(FileNotFoundError):
        discover_log_files(spark, str(tmp_path / "none"))
    lines = read_lines(spark, found)
    records, counts = parse_counted(lines)
    assert len(records.collect()) == 6 and counts.get() == {"scanned": 7, "parsed": 6, "skipped": 1}
    assert records._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert line_counts(lines).first().asDict() == {"scanned": 7, "parsed": 6, "skipped": 1}
    rows = replay_access_logs(spark, str(tmp_path), "2026-04-06T10:00:00Z", time_scale=1.0).collect()
    assert len(rows) == 6 and {r.session_number for r in rows} == {1}
    two = replay_access_logs(spark, str(tmp_path), "2026-04-06T10:00:00Z", cycles=2).collect()
    assert len(two) == 12 and len({r.request_id for r in two}) == 12
    rounds = [[r.replay_time for r in two if r.cycle == c] for c in (0, 1)]
    assert 0 < (min(rounds[1]) - max(rounds[0])).total_seconds() <= 2
    assert replay_access_logs(spark, str(tmp_path), "2026-04-06T10:00:00Z", max_records=4).count() == 4
    with pytest.raises(ValueError):
        replay_access_logs(spark, str(tmp_path), "2026-04-06T10:00:00Z", cycles=0)
