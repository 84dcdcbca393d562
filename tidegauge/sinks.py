"""The four tables as Parquet: batches that become visible at once, JSON-lines fallback, and retention.

Every batch has folders of its own, ``<root>/<table>/batch=<batch>/month=<yyyyMM>``, and is visible from
the moment when its commit file ``<root>/commits/<batch>.json`` is in place, all its tables together.
Readers go by the commit files only: what a crash left behind is not read, and the repeated batch
writes over it; a batch that is committed is not written again.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Time column and sort key of each table, and days that its rows are kept.
TABLES = {
    "processed_logs": ("timestamp", ["timestamp", "endpoint", "ip"], 30),
    "bot_feature_windows": ("window_end", ["window_end", "ip", "session_id"], 30),
    "load_forecasts": ("bucket_end", ["bucket_end", "scope", "endpoint"], 30),
    "anomaly_alerts": ("window_end", ["window_end", "endpoint"], 30),
    "system_traffic_minutely": ("minute", ["minute"], 7),
    "bot_stats_hourly": ("hour", ["hour", "ip", "session_id"], 30),
    "endpoint_perf_hourly": ("hour", ["hour", "endpoint"], 30),
    "forecast_accuracy_hourly": ("hour", ["hour", "scope", "endpoint"], 30),
    "processed_logs_summary_hourly": ("hour", ["hour", "endpoint"], 30),
}
#: Folders by day, where rows are kept for a few days only.
_FOLDER = {"system_traffic_minutely": ("day", "yyyyMMdd")}
_MONTH = ("month", "yyyyMM")


def _folder(name: str) -> tuple[str, str]:
    return _FOLDER.get(name, _MONTH)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def put_table(rows: DataFrame, root: str, name: str, batch: str) -> int:
    """Rows of a table as a batch's folders, sorted within each file; not visible before ``commit``.
    Their number is counted as they are written."""
    time, order, _ = TABLES[name]
    by, form = _folder(name)
    out = rows.drop("batch", by).withColumn(by, F.date_format(time, form))
    counted = Observation()
    out = out.observe(counted, F.count(F.lit(1)).alias("n"))
    out.sortWithinPartitions(by, *order).write.mode("overwrite").partitionBy(by).parquet(f"{root}/{name}/batch={batch}")
    return counted.get["n"]


def commit(spark: SparkSession, root: str, batch: str, note: dict) -> None:
    """Makes a batch visible: its commit file appears whole, by a rename."""
    fs, final = _files(spark, f"{root}/commits/{batch}.json")
    _, temp = _files(spark, f"{root}/commits/.{batch}-{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    try:
        out.write(bytearray(json.dumps({"batch": batch, **note}).encode()))
    finally:
        out.close()
    if not fs.rename(temp, final):
        fs.delete(temp, False)
        raise FileExistsError(f"batch {batch} is committed already")


def commits(spark: SparkSession, root: str) -> dict[str, dict]:
    """The notes of all visible batches; those that a compaction has replaced are left out."""
    fs, folder = _files(spark, f"{root}/commits")
    if not fs.exists(folder):
        return {}
    lines = spark.read.text(f"{root}/commits", pathGlobFilter="*.json", wholetext=True).collect()  # a small file a batch
    found = {note["batch"]: note for note in (json.loads(r.value) for r in lines)}
    gone = {b for note in found.values() for b in note.get("replaces", [])}
    return {b: note for b, note in found.items() if b not in gone}


def write_batch(tables: dict[str, DataFrame], root: str, batch: int | str, **note: object) -> bool:
    """Writes a batch of rows of several tables and commits it; False if it has been committed before."""
    batch = str(batch)
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
        raise ValueError(f"no name for a batch: {batch!r}")
    spark = next(iter(tables.values())).sparkSession
    fs, path = _files(spark, f"{root}/commits/{batch}.json")
    if fs.exists(path):
        return False
    written = {name: put_table(rows, root, name, batch) for name, rows in tables.items()}
    commit(spark, root, batch, {"tables": list(tables), "rows": written, **note})
    return True


def _folders(spark: SparkSession, root: str, name: str) -> list[tuple[str, str, str]]:
    """(batch, month, path) of a table's visible folders."""
    seen = {b for b, note in commits(spark, root).items() if name in note["tables"]}
    fs, pattern = _files(spark, f"{root}/{name}/batch=*/{_folder(name)[0]}=*")
    found = [str(status.getPath().toString()) for status in fs.globStatus(pattern) or []]
    parts = [(*re.findall(r"=([^/=]*)", p)[-2:], p) for p in found]
    return sorted(p for p in parts if p[0] in seen)


def read_table(spark: SparkSession, root: str, name: str, months: list[str] | None = None) -> DataFrame:
    """The visible rows of a table; ``months`` (yyyyMM, where folders are days yyyyMMdd) prunes folders."""
    paths = [p for _, month, p in _folders(spark, root, name) if months is None or month in months]
    if not paths:
        raise FileNotFoundError(f"{root}/{name} has no visible rows" + (f" in {months}" if months else ""))
    found = spark.read.option("basePath", f"{root}/{name}").parquet(*paths)
    return found.withColumns({c: F.col(c).cast("string") for c in ("batch", _folder(name)[0])})


def seed_if_empty(spark: SparkSession, root: str, name: str, seed: DataFrame) -> bool:
    """Writes ``seed``, as a batch of its own, if the table has no row yet; whether it did."""
    return not _folders(spark, root, name) and write_batch({name: seed}, root, f"seed-{name}")


def compact(spark: SparkSession, root: str, keep: int = 100) -> str | None:
    """Puts all but the newest ``keep`` batches together as one, and deletes their folders; the name of
    the new batch.  Readers see either the old batches or the new one."""
    notes = commits(spark, root)
    old = sorted(notes, key=lambda b: (notes[b].get("number", -1), b))[: max(0, len(notes) - keep)]
    if len(old) < 2:
        return None
    tables = {}
    for name in sorted({t for b in old for t in notes[b]["tables"]}):
        paths = [p for b, _, p in _folders(spark, root, name) if b in old]
        if paths:
            tables[name] = spark.read.option("basePath", f"{root}/{name}").parquet(*paths)
    merged = f"merged-{uuid.uuid4().hex}"
    number = max(notes[b].get("number", -1) for b in old)
    until = max((notes[b]["until"] for b in old if "until" in notes[b]), default=None)
    write_batch(tables, root, merged, replaces=old, number=number, **({"until": until} if until is not None else {}))
    for name in tables:
        for b in old:
            fs, path = _files(spark, f"{root}/{name}/batch={b}")
            fs.delete(path, True)
    return merged


def write_fallback(tables: dict[str, DataFrame], path: str) -> None:
    """{"table": ..., "row": {...}} as JSON lines, all tables in one folder, nothing twice."""
    out = None
    for name, rows in tables.items():
        lines = rows.select(F.to_json(F.struct(F.lit(name).alias("table"), F.struct(*rows.columns).alias("row"))).alias("value"))
        out = lines if out is None else out.union(lines)
    out.write.mode("overwrite").text(path)


def write_lines(records: DataFrame, path: str) -> None:
    """Records as JSON lines, missing values as null, as a replay writes them."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def batch_summary(tables: dict[str, DataFrame] | dict[str, int], source: str, sink: str) -> dict[str, str | int]:
    """Where a batch came from and went to, and the rows of each of its tables: of tables, or without
    running anything again of the numbers that a commit notes (``commits(...)[batch]["rows"]``)."""
    rows = {name: x if isinstance(x, int) else x.count() for name, x in tables.items()}
    names = {"count": "processed_logs", "bot_windows": "bot_feature_windows", "forecasts": "load_forecasts", "anomalies": "anomaly_alerts"}
    return {"source": source, "sink": sink, **{k: rows.get(name, 0) for k, name in names.items()}}


def expired_months(spark: SparkSession, root: str, name: str, now: str) -> list[str]:
    """Months (days) all of whose rows are past the table's days of retention."""
    limit = F.date_format(F.lit(now).cast("timestamp") - F.expr(f"interval {TABLES[name][2]} days"), _folder(name)[1])
    last = spark.range(1).select(limit.alias("limit")).first().limit
    return sorted({month for _, month, _ in _folders(spark, root, name) if month < last})


def prune(spark: SparkSession, root: str, name: str, now: str) -> list[str]:
    """Deletes the folders of expired months (days) of all batches."""
    gone = expired_months(spark, root, name, now)
    for _, month, path in _folders(spark, root, name):
        if month in gone:
            fs, folder = _files(spark, path)
            fs.delete(folder, True)
    return gone
