"""Combined-format access logs: files, lines, sessions and replay times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import iso_text, seconds_after
from ..functions.web import infer_latency_ms, normalize_endpoint, route_template

# Fixed format of a line: ip, time, request, status, bytes, referer, user agent, forwarded.
LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+) "([^"]*)" "([^"]*)"(?: "([^"]*)")?$'
METHODS = ["GET", "POST", "HEAD", "PUT", "DELETE", "PATCH"]
SUFFIXES = (".log", ".txt", ".gz")


def discover_log_files(spark: SparkSession, root: str) -> list[str]:
    """Files below ``root`` (or that file itself) that look like logs by suffix or name, sorted; if
    none does, all files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(root)
    found, files = [], fs.listFiles(path, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    found.sort()
    if not found:
        raise FileNotFoundError(f"no file below {root}")
    name = lambda p: p.rsplit("/", 1)[-1].lower()
    likely = [p for p in found if name(p).endswith(SUFFIXES) or "access" in name(p) or "log" in name(p)]
    return likely or found


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, seq): lines of text or gzip files in order of arrival: by file name, then by place."""
    lines = spark.read.text(paths).withColumn("file", F.input_file_name())
    return lines.withColumn("seq", F.struct("file", F.monotonically_increasing_id().alias("n"))).select("value", "seq")


def parse_lines(lines: DataFrame, value: str = "value", cycle: int = 0) -> DataFrame:
    """Records of the lines that can be parsed, with all other columns of ``lines``.

    Lines of another format, of a method that is not known or of an impossible date are left out
    (``line_counts`` counts them).
    """
    g = lambda i: F.regexp_extract(value, LINE, i)
    request = F.split(F.trim(g(3)), r"\s+")
    rest = [c for c in lines.columns if c != value]
    cut = lines.where(F.col(value).rlike(LINE)).select(*rest, g(1).alias("ip"), F.try_to_timestamp(g(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("event_time"), request.alias("q_"), g(4).cast("int").alias("status"), F.coalesce(F.nullif(F.trim(g(7)), F.lit("")), F.lit("unknown")).alias("user_agent"))
    good = cut.where((F.size("q_") >= 2) & F.upper(F.get("q_", F.lit(0))).isin(*METHODS) & F.col("event_time").isNotNull())
    target = good.withColumn("method", F.upper(F.get("q_", F.lit(0)))).withColumn("target", F.get("q_", F.lit(1))).withColumn("endpoint", normalize_endpoint(F.get("q_", F.lit(1))))
    stamp = F.concat(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    digest = F.sha1(F.encode(F.concat_ws("|", F.lit(str(cycle)), stamp, "ip", "method", "target", F.col("status").cast("string"), "user_agent"), "UTF-8"))
    return target.select(
        *rest,
        F.lit("v2").alias("schema_version"),
        iso_text(F.col("event_time")).alias("timestamp"),
        iso_text(F.col("event_time")).alias("original_timestamp"),
        F.concat(F.lit("req-"), F.substring(digest, 1, 16)).alias("request_id"),
        "ip",
        "user_agent",
        "method",
        "endpoint",
        route_template(F.col("endpoint")).alias("route_template"),
        "status",
        infer_latency_ms(F.col("endpoint"), F.col("status"), F.col("user_agent")).alias("latency_ms"),
        "event_time",
    )


class LineCounts:
    """Scanned, parsed and skipped lines, counted by the job that reads the records: there once an action
    on them has ended."""

    def __init__(self) -> None:
        self.scanned_, self.parsed_ = Observation(), Observation()

    def get(self) -> dict[str, int]:
        scanned, parsed = self.scanned_.get["n"], self.parsed_.get["n"]
        return {"scanned": scanned, "parsed": parsed, "skipped": scanned - parsed}


def parse_counted(lines: DataFrame, value: str = "value", cycle: int = 0) -> tuple[DataFrame, LineCounts]:
    """As ``parse_lines``, with the counts of its lines, which cost no pass of their own."""
    counts, n = LineCounts(), F.count(F.lit(1)).alias("n")
    return parse_lines(lines.observe(counts.scanned_, n), value, cycle).observe(counts.parsed_, n), counts


def line_counts(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: scanned, parsed and skipped lines, of one pass."""
    records, counts = parse_counted(lines, value)
    records.write.format("noop").mode("overwrite").save()
    return lines.sparkSession.createDataFrame([tuple(counts.get().values())], "scanned long, parsed long, skipped long")


#: Places of arrival that are worked on together, of one client.
SPAN_ROWS = 1 << 20


def sessionize(records: DataFrame, arrival: str = "seq", gap_seconds: int = 900, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Records with ``session_id`` and ``session_number``, by (ip, user agent) in order of arrival.

    A session begins with a client's first record, after a gap of more than ``gap_seconds``, and
    where time goes backwards.  ``arrival`` is a whole number or, as ``read_lines`` gives it, a file and
    a number; no two records share one.

    A client's records are cut into spans of ``span_rows`` places of arrival, so that a client with any
    share of the records is no single task: within a span sessions are counted apart; of each span only
    its edges, the first and last time and the number of sessions that begin inside, meet those of the
    client's other spans, and give the number that each span counts on from.
    """
    is_place = isinstance(records.schema[arrival].dataType, T.StructType)
    span = F.struct(F.col(arrival)["file"].alias("file"), F.floor(F.col(arrival)["n"] / span_rows).alias("n")) if is_place else F.floor(F.col(arrival) / span_rows)
    client = ["ip", "user_agent"]
    limit = gap_seconds * 1_000_000

    def fresh(now: str, before: str) -> Column:
        gap = F.unix_micros(now) - F.unix_micros(before)
        return F.coalesce(((gap < 0) | (gap > limit)).cast("long"), F.lit(1).cast("long"))

    by = W.partitionBy(*client, "span_").orderBy(arrival)
    placed = records.withColumn("span_", span).withColumn("before_", F.lag("event_time").over(by))
    inside = F.when(F.row_number().over(by) > 1, fresh("event_time", "before_")).otherwise(0)
    counted = placed.withColumn("fresh_", inside).withColumn("within_", F.sum("fresh_").over(by.rowsBetween(W.unboundedPreceding, 0)))
    edges = counted.groupBy(*client, "span_").agg(F.min_by("event_time", arrival).alias("first_"), F.max_by("event_time", arrival).alias("last_"), F.sum("fresh_").alias("inside_"))
    spans = W.partitionBy(*client).orderBy("span_")
    edges = edges.withColumn("prior_", F.lag("last_").over(spans)).withColumn("begins_", F.when(F.row_number().over(spans) == 1, 1).otherwise(fresh("first_", "prior_")))
    earlier = F.coalesce(F.sum(F.col("begins_") + F.col("inside_")).over(spans.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*(F.col(c).alias(f"{c}_") for c in client), F.col("span_").alias("of_"), (earlier + F.col("begins_")).alias("base_"))
    same = F.col("ip").eqNullSafe(F.col("ip_")) & F.col("user_agent").eqNullSafe(F.col("user_agent_")) & (F.col("span_") == F.col("of_"))
    numbered = counted.join(edges, same).withColumn("session_number", F.col("base_") + F.col("within_"))
    name = F.substring(F.sha1(F.encode(F.concat_ws("|", "ip", "user_agent"), "UTF-8")), 1, 8)
    sessions = numbered.withColumn("session_id", F.format_string("sess-%s-%04d", name, F.col("session_number")))
    return sessions.drop("span_", "before_", "fresh_", "within_", "ip_", "user_agent_", "of_", "base_")


def rebase(records: DataFrame, anchor: str, arrival: str = "seq", time_scale: float = 30.0) -> DataFrame:
    """Replay times: ``anchor`` plus the time since the first record to arrive, ``time_scale`` times
    as fast; never before ``anchor``."""
    if time_scale <= 0:
        raise ValueError("time_scale must be positive")
    first = records.agg(F.unix_micros(F.min_by("event_time", arrival))).scalar()
    delta = F.greatest(F.lit(0.0), (F.unix_micros("event_time") - first) / F.lit(float(time_scale)))
    moved = F.timestamp_micros(F.unix_micros(F.lit(anchor).cast("timestamp")) + F.floor(delta).cast("long"))
    return records.withColumn("replay_time", moved).withColumn("timestamp", iso_text(moved))


def replay_access_logs(spark: SparkSession, root: str, anchor: str, time_scale: float = 30.0, gap_seconds: int = 900, max_records: int | None = None, cycles: int = 1) -> DataFrame:
    """Raw logs of all access logs below ``root``, each of ``cycles`` rounds with request ids and
    sessions of its own; a round begins in the second after the last record of the one before.
    ``max_records`` is the cap that a caller may ask for."""
    if cycles < 1 or (max_records is not None and max_records < 1) or gap_seconds <= 0:
        raise ValueError("cycles, max_records and the gap must be positive")
    lines = read_lines(spark, discover_log_files(spark, root))
    out = None
    for cycle in range(cycles):
        got = sessionize(parse_lines(lines, cycle=cycle), gap_seconds=gap_seconds)
        got = rebase(got, anchor, time_scale=time_scale).withColumn("cycle", F.lit(cycle))
        if cycle:
            last = got.agg(F.unix_seconds(F.max("replay_time")) - F.unix_seconds(F.lit(anchor).cast("timestamp"))).scalar()
            got = got.withColumn("replay_time", seconds_after(F.col("replay_time"), cycle * (last + 1))).withColumn("timestamp", iso_text(F.col("replay_time")))
        out = got if out is None else out.union(got)
    return out.orderBy("cycle", "seq").limit(max_records) if max_records else out
