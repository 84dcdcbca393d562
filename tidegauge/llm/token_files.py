"""Operator 6: token-id files with a shared zstandard dictionary.

A file set is a Parquet table of blocks.  A block holds some consecutive documents in ascending
order of id: one zstandard frame for each document, compressed on its own with the dictionary that
all share, an index of the frames' offsets, the documents' ids and token counts, and the
dictionary's hash.  The dictionary itself is a one-row table beside it.  ``read_documents`` reads a
few documents: blocks are pruned by their least and greatest id, and of a block only the frames of
those documents are decompressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, heads, text_chunks, vocabulary
from .shared import lean_workers, shared_dir
from .tables import table, tokenizer_path

#: The dictionary is trained on at most so many documents and bytes of each.
DICT_SAMPLE_DOCS, DICT_SAMPLE_BYTES, DICT_BYTES = 1_000, 16_384, 65_536
#: Frames gathered into one block, and ranges of ids (a file each) at most.
BLOCK_BYTES, RANGES = 1 << 20, 100_000
#: Spans of ids by which files are left out when some documents are read.
SPANS = 16
LEVEL = 3


def _serialised(encoder: Encoder, texts: list[str], end_id: int) -> list[bytes]:
    """Each text's ids with the end id, as little-endian unsigned 16-bit integers."""
    got = encoder.encode(texts)
    n = got.per_doc()
    ids = np.insert(got.ids(), np.cumsum(n), np.uint16(end_id)).astype("<u2")
    at = np.concatenate([[0], np.cumsum(n + 1)])
    return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


def train_dictionary(docs: DataFrame, vocab_path: str, end_id: int = 0, text_col: str = "text") -> bytes:
    """A zstandard dictionary trained on the id arrays of a bounded sample of documents.

    The sample is the first rows of each partition, one at least; the others are not read.  Too few
    samples to train on: their plain bytes serve as the dictionary (none: no dictionary).  The
    dictionary changes the size of the files, never what is read back.
    """
    rows = -(-DICT_SAMPLE_DOCS // max(1, docs.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(vocab_path))
        for batch in heads(batches, rows):
            for _, texts in text_chunks(batch.column(0)):
                found = [x[:DICT_SAMPLE_BYTES] for x in _serialised(encoder, texts, end_id)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    samples = sorted(bytes(r.ids) for r in docs.select(text_col).mapInArrow(run, "ids binary").limit(DICT_SAMPLE_DOCS * 2).collect())
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def _dictionary(raw: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(raw) if raw else None


def write_token_files(docs: DataFrame, path: str, vocab_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending order of document id.

    Only compressed frames are shuffled, to ranges of ids whose borders come from a quantile sketch
    of the id column; each range is one file.  Rows with equal ids keep a stable order by their
    frames; null ids come first; a null or empty text is just the end id; a very long text is one
    frame.  Other columns are ignored.  An empty table gives a file set without blocks.
    """
    spark = docs.sparkSession
    lean_workers(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = train_dictionary(picked, vocab_path, end_id)
    dict_hash = hashlib.sha256(raw).hexdigest()
    shared = spark.sparkContext.broadcast(raw)
    n_ranges = max(1, min(RANGES, picked.rdd.getNumPartitions()))
    borders = sorted(set(picked.approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.2 / n_ranges))) if n_ranges > 1 else []

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(vocab_path))
        pack = zstd.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value))
        for batch in batches:
            for rows, texts in text_chunks(batch.column(1)):
                data = _serialised(encoder, texts, end_id)
                ids = batch.column(0).slice(rows.start, len(texts))
                part = np.searchsorted(borders, np.asarray(ids.fill_null(-(1 << 62))), side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), ids, pa.array([len(x) // 2 for x in data], pa.int32()), pa.array([pack.compress(x) for x in data], pa.binary())],
                    names=["part", "doc_id", "n", "frame"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part = None
        start = begin = size = number = 0

        def block() -> pa.RecordBatch:
            offs = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])]).astype("<u4")
            known = [x[0] for x in held if x[0] is not None]
            cols = {
                "first_id": ([min(known, default=None)], pa.int64()), "last_id": ([max(known, default=None)], pa.int64()),
                "part": ([part], pa.int32()), "block": ([number], pa.int32()), "start": ([begin], pa.int64()), "tokens": ([start - begin], pa.int64()), "dict_hash": ([dict_hash], pa.string()),
                "doc_ids": ([[x[0] for x in held]], pa.list_(pa.int64())), "n_tokens": ([[x[1] for x in held]], pa.list_(pa.int32())), "offsets": ([offs.tobytes()], pa.binary()), "frames": ([b"".join(x[2] for x in held)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols.values()], names=list(cols))

        for batch in batches:
            for p, d, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size + len(frame) > BLOCK_BYTES):
                    yield block()
                    held, size, number, begin = [], 0, number + 1, start
                if p != part:
                    part, start, begin, number = p, 0, 0, 0
                held.append((d, n, frame))
                size, start = size + len(frame), start + n
        if held:
            yield block()

    dealt = picked.mapInArrow(frames, "part int, doc_id long, n int, frame binary").repartitionById(n_ranges, F.col("part")).sortWithinPartitions(F.asc("part"), F.asc_nulls_first("doc_id"), F.asc("frame"))
    dealt.mapInArrow(blocks, "first_id long, last_id long, part int, block int, start long, tokens long, dict_hash string, doc_ids array<long>, n_tokens array<int>, offsets binary, frames binary").write.parquet(f"{path}/blocks")
    spark.createDataFrame([(dict_hash, bytearray(raw))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _starts(files: DataFrame) -> dict[int, int]:
    """Ids before each range, from one number for each of at most RANGES ranges."""
    totals = sorted(files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    return dict(zip((r.part for r in totals), np.concatenate([[0], np.cumsum([r.n for r in totals])]).tolist()))


def _read(spark: SparkSession, path: str, blocks: DataFrame, base: dict[int, int], id_col: str, wanted: set[int] | None) -> DataFrame:
    found = spark.read.parquet(f"{path}/dictionary").first()
    have = spark.sparkContext.broadcast((found.dict_hash, bytes(found.dictionary), base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, raw, base = have.value
        unpack = zstd.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for r in range(batch.num_rows):
                part, start, dict_hash, ids, counts, offs, frames = (c[r].as_py() for c in batch.columns)
                if dict_hash != name:
                    raise ValueError(f"a block was written with dictionary {dict_hash}, not {name}")
                offs = np.frombuffer(offs, dtype="<u4")
                n = np.asarray(counts, dtype=np.int64)
                at = base[part] + start + np.cumsum(n) - n
                rows = [i for i, d in enumerate(ids) if wanted is None or d in wanted]
                texts = [np.frombuffer(unpack.decompress(frames[offs[i] : offs[i + 1]]), dtype="<u2").astype("<u4").tobytes() for i in rows]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array(at[rows]), pa.array(n[rows]), pa.array(texts, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    return blocks.select("part", "start", "dict_hash", "doc_ids", "n_tokens", "offsets", "frames").mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids binary")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of a file set: id, start (ids of all documents before it), n_tokens, and the
    ids as little-endian unsigned 32-bit integers.

    Repeated and null ids are rows of their own, a document without text has the end id alone, and
    a file set without blocks gives an empty result.
    """
    lean_workers(spark)
    files = spark.read.parquet(f"{path}/blocks")
    return _read(spark, path, files, _starts(files), id_col, None)


def read_documents(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """Those of some ids only, as by ``read_token_files``; ids that no document has give no row.

    A first pass over the blocks' ranges of ids finds those that may hold one; only these are read
    then (of files, only those within one of SPANS spans of the ids), and of them only the frames asked
    for are decompressed.  Null ids are ignored; the ids are
    the caller's list, and repeated ones count once.
    """
    files = spark.read.parquet(f"{path}/blocks")
    wanted = np.array(sorted({d for d in ids if d is not None}), dtype=np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(0).is_valid())
            first, last = (np.asarray(known.column(c)).astype(np.int64) for c in (0, 1))
            held = np.searchsorted(wanted, first, side="left") < np.searchsorted(wanted, last, side="right")
            yield known.select(["part", "block"]).filter(pa.array(held))

    met = files.select("first_id", "last_id", "part", "block").mapInArrow(near, "part int, block int").collect()  # as many as ids, but for repeated ids
    gaps = np.sort(np.argsort(-np.diff(wanted.astype(np.float64)), kind="stable")[: SPANS - 1]) + 1
    spans = [(int(x[0]), int(x[-1])) for x in np.split(wanted, gaps) if len(x)]
    keys = ", ".join(f"{(r.part << 32) + r.block}L" for r in met)
    found = files.where(" OR ".join(f"(first_id <= {b}L AND last_id >= {a}L)" for a, b in spans)).where(f"(CAST(part AS LONG) << 32) + block IN ({keys})") if met else files.where("false")
    return _read(spark, path, found, _starts(files), id_col, set(wanted.tolist()))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
