"""Operator 1: sharding by jump consistent hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .tables import table, with_field

#: Rows of a file that are numbered together.
BLOCK_ROWS = 65_536


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key by jump consistent hashing (Lamping and Veach, 2014).

    Needs no ring table.  From n to n + 1 shards only about 1 in n + 1 keys moves, always into the
    new shard.
    """
    key = keys.astype(np.uint64)
    bucket = np.full(len(key), -1, dtype=np.int64)
    at = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = at[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        at[live] = np.floor((bucket[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[at[live] < shards]
    return bucket


def _with_shards(rows: DataFrame, shards: dict[str, int]) -> DataFrame:
    """Rows, whose first column is a key, with a column for each number of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            keys = np.asarray(ids.fill_null(0) if ids.null_count else ids).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(jump_hash(keys, n), pa.int32()) for n in shards.values())], names=[*batch.schema.names, *shards])

    schema = rows.schema
    for name in shards:
        schema = T.StructType([*schema.fields, T.StructField(name, T.IntegerType())])
    return rows.mapInArrow(run, schema)


def assign_shards(docs: DataFrame, shards: int = 16, grown: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of each row; the key and the number of shards alone decide the shard.

    The slots of a shard run from 0 without a gap in the order of files and of rows in them.  Rows are
    counted by file, block of BLOCK_ROWS rows and shard; a block's slots begin where those of the blocks
    before it end, and within a block rows are numbered in order.  So no group holds more than a block,
    however many rows a key, source or shard has, and neither the cluster's size nor tasks that run
    again change a slot.  Texts are not shuffled.  ``docs`` that are no plain scan of files are written
    to a table first.

    Returns ``id_col``, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, law
    ("key"), shard, slot and grown_shard (the shard with ``grown`` shards, one more by default).
    Rows with equal ids share a shard and have slots of their own.  A null id has the shard of key 0
    and a null text the checksum 0 of no bytes; a very long text is read where it lies.  Other columns
    are ignored.  An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    place = [F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS).alias("block"), F.col("_metadata.row_index").alias("at")]
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(["_metadata"] if _scans_files(docs) else []))
    if "_metadata" not in docs.columns:
        docs = stored(docs, "documents")
    many = {"shard": shards, "grown_shard": shards + 1 if grown is None else grown}
    counted = _with_shards(docs.select("id", *place[:2]), {"shard": shards}).groupBy("file", "block", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))
    starts = counted.select("file", "block", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    crc = F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32")
    rows = _with_shards(docs.select("id", size, crc, *place), many)
    rank = F.row_number().over(W.partitionBy("file", "block", "shard").orderBy("at"))
    found = rows.join(starts, ["file", "block", "shard"]).withColumn("slot", (F.col("start") + rank - 1).cast("long"))
    return found.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _scans_files(docs: DataFrame) -> bool:
    """Whether the rows' places in files are known."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """The whole rows in one folder per shard; each task writes to the shards of its own rows."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            shard = jump_hash(np.asarray(ids.fill_null(0) if ids.null_count else ids).astype(np.int64), shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    rest = docs.drop("shard")
    rest.mapInArrow(place, with_field(rest, "shard", T.IntegerType())).write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 16)


#: The same by recursion over the jumps; 2,862,933,555,777,941,757 is the multiplier of the jump hash.
#: The ids of the tables ascend within their one file.
OP1_SQL = """
WITH RECURSIVE jumps(doc_id, n, key, b, j) AS (
    SELECT doc_id, n, doc_id::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (16), (17)) AS counts(n)
    UNION ALL
    SELECT doc_id, n, next, j, floor((j + 1) * (2147483648.0::DOUBLE / ((next // 8589934592) + 1)::DOUBLE))::BIGINT
    FROM (SELECT doc_id, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE j < n)
),
placed AS (
    SELECT doc_id, max(b) FILTER (WHERE n = 16 AND j >= n) AS shard, max(b) FILTER (WHERE n = 17 AND j >= n) AS grown_shard FROM jumps GROUP BY doc_id
),
crc_table AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)
),
bytes AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
),
checked AS (
    SELECT doc_id, len(h) // 2 AS n, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS crc
    FROM bytes, crc_table
)
SELECT doc_id, n + 1 AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM checked JOIN placed USING (doc_id)
"""
