"""Operator 11: MinHash fingerprints of documents, their likeness, and searches by signature bands."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean_workers, stored
from .tables import output_schema, table
from .textvec import _mix, chunks, shingles, unique_per_doc

#: Words of a shingle, and hash functions of a fingerprint, each of which keeps BITS bits of its minimum.
WIDTH, FUNCTIONS, BITS = 5, 128, 16
#: Values of a band: documents of similarity 0.75 share one of the 32 bands all but 5 times in a million.
BAND = 4

_A = _mix(np.arange(5001, FUNCTIONS + 5001, dtype=np.uint64)) | np.uint64(1)
_B = _mix(np.arange(6001, FUNCTIONS + 6001, dtype=np.uint64))


def _signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set the minimum under each of the functions x -> (a x + b) mod 2**64, BITS of it; all
    zeros for the empty set."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, FUNCTIONS), dtype="<u2")
    if len(full):
        for i in range(FUNCTIONS):
            h = values * _A[i]
            h += _B[i]
            out[full, i] = np.minimum.reduceat(h, first[full]) >> np.uint64(16) & np.uint64(0xFFFF)
    return out


def _prints(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
    """Sets of shingles and signatures of the batch's texts, some texts at a time."""
    for rows, words in chunks(batch):
        values, first = unique_per_doc(*shingles(words, words.hashes(lower=True), width))
        yield rows, np.split(values, first[1:-1]), _signatures(values, first)


def _likeness(x: np.ndarray, y: np.ndarray, empty: bool) -> float:
    return 0.0 if empty else float((x == y).mean())


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets without repeats; 1 for two empty ones."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    total = len(x) + len(y) - shared
    return shared / total if total else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, fingerprint) of each text, in one narrow pass.

    A fingerprint is the hexadecimal text of FUNCTIONS minima over the distinct shingles of ``width``
    words (A-Z as a-z; the whole sequence where there are fewer): equal for equal texts, and of two
    texts as many values agree as their shingles' Jaccard similarity says, within 0.044 at most
    (standard error).  A text without words, null included, has a fingerprint of zeros.  Repeated rows
    and null ids stay rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets, signs in _prints(batch, width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, len(sets)), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes().hex() for s in signs], pa.string())], names=[id_col, "n_shingles", "fingerprint"])

    lean_workers(docs.sparkSession)
    picked = docs.select(id_col, F.col(text_col).alias("text"))
    return picked.mapInArrow(run, output_schema(picked, id_col, more="n_shingles long, fingerprint string"))


# -- the next document, in the order of ids --------------------------------------------------------
def _cuts(ids: DataFrame, parts: int) -> tuple[list[int], list[int]]:
    """Ascending ids at which ranges of about equal size begin, and for each range from the highest
    down, that of rows without an id last, the number of parts to split it into by text."""
    share = [i / parts for i in range(1, parts)] or [0.5]
    row = ids.agg(F.percentile_approx("id", share, max(10_000, 20 * parts)), F.count("id"), F.count("*")).first()
    found = Counter(row[0] or [])
    hot = {c: n for c, n in found.items() if n > 1}  # an id that holds more than a part's share of the rows
    cuts = sorted(found.keys() | {min(c + 1, (1 << 63) - 1) for c in hot})
    splits = [hot.get(c, 1) for c in reversed(cuts)] + [1]
    missing = row[2] - row[1]
    return cuts, [*splits, max(1, round(parts * missing / row[2])) if row[2] else 1]


def _placed(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Rows (id, text, h) with ``part``, by descending id and then h, and after each part's rows, with
    ``stop`` 1, the row with which the next part begins (after the last one: the first part).

    Only ranges' bounds reach the driver, two numbers a part.
    """
    cuts, splits = _cuts(rows.select("id"), parts)
    base = np.concatenate([[0], np.cumsum(splits)])

    def part_of(ids: pa.Array, h: pa.Array) -> np.ndarray:
        known = np.asarray(ids.is_valid())
        at = len(cuts) - np.searchsorted(np.array(cuts, dtype=np.int64), np.asarray(ids.fill_null(0)), side="right")
        at = np.where(known, at, len(cuts) + 1)
        high = (np.asarray(h).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return base[at] + (high * np.array(splits, dtype=np.uint64)[at] >> np.uint64(32)).astype(np.int64)

    @F.arrow_udf("int")
    def number(ids: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array(part_of(ids, h), pa.int32())

    order = F.struct(F.col("id").isNull().alias("none"), F.bitwise_not("id").alias("down"), "h")
    firsts = rows.select("id", "h").withColumn("part", number("id", "h")).groupBy("part").agg(F.min(order).alias("o")).select("part", F.bitwise_not("o.down").alias("id"), "o.h").collect()
    begins = {r.part: (r.id, r.h) for r in firsts}
    there = sorted(begins)
    before = dict(zip(there, [there[-1:][0], *there[:-1]])) if there else {}

    @F.arrow_udf("array<int>")
    def to(ids: pa.Array, h: pa.Array) -> pa.Array:
        part = part_of(ids, h)
        pairs = zip(part.tolist(), ids.to_pylist(), h.to_pylist())
        return pa.array([[p, before[p]] if begins[p] == (i, x) else [p] for p, i, x in pairs], pa.list_(pa.int32()))

    return rows.withColumn("to", to("id", "h")).select("id", "text", "h", F.posexplode("to").alias("stop", "part")), int(base[-1])


def with_next(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Applies ``run`` to batches (id, text, stop) of consecutive texts, those of descending ids.

    Texts are shuffled once, to as many tasks as ``spark.sql.shuffle.partitions`` says, which read
    them in order.  The row after a row with ``stop`` 1 does not follow it: that row only ends what
    comes before.  Rows of equal id follow by a hash of the text, rows without an id after all others;
    both may hold any share of the rows.  Rows of equal id and text are in one task.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    placed, parts = _placed(rows, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = placed.repartitionById(parts, "part").sortWithinPartitions("part", "stop", F.desc_nulls_last("id"), "h")
    return sent.select("id", "text", "stop").mapInArrow(run, schema)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the beginning of the next
    document's, by descending id; after the last document comes the first.

    Beside the estimates ``near_edited`` and ``near_next`` (the share of equal values) stand the exact
    similarities of the sets, ``jaccard_edited`` and ``jaccard_next``, and the numbers of equal bands.
    Two texts without words are alike (1), one without is unlike all others (0).

    A null text is empty.  Rows of equal id follow each other by a hash of their text, those without
    an id come last; a single document is its own next.  A text is never cut, and tasks hold some
    texts at a time.  Other columns are ignored; an empty table gives an empty result.
    """
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "jaccard_edited", "jaccard_next", "bands_edited", "bands_next"]
    kinds = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4, *[pa.int32()] * 2]

    def bands(x: np.ndarray, y: np.ndarray) -> int:
        return int((x == y).reshape(-1, BAND).all(axis=1).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for rows, sets, signs in _prints(batch, width):
                part = batch.slice(rows.start, len(sets))
                held += zip(*(c.to_pylist() for c in part.columns), sets, signs)
                pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[2]]
                held = held[-1:]
                edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
                after = [x for _, s, z in _prints(pa.RecordBatch.from_arrays([pa.array(edited, pa.string())], names=["text"]), width) for x in zip(s, z)]
                out = []
                for (a, b), text, (s, z) in zip(pairs, edited, after):
                    near = lambda x, y, p, q: _likeness(p, q, (len(x) == 0) != (len(y) == 0))
                    out.append((
                        a[0], len(a[1]), hashlib.sha256(text.encode()).hexdigest(), a[4].tobytes().hex(), z.tobytes().hex(), near(a[3], s, a[4], z), near(a[3], b[3], a[4], b[4]),
                        _jaccard(a[3], s), _jaccard(a[3], b[3]), bands(a[4], z), bands(a[4], b[4]),
                    ))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), *kinds])], names=[id_col, *names])

    lean_workers(docs.sparkSession)
    ddl = ["bigint", *["string"] * 3, *["double"] * 4, *["int"] * 2]
    return with_next(docs, run, ", ".join([f"`{id_col}` bigint", *(f"{n} {k}" for n, k in zip(names, ddl))]), id_col, text_col)


# -- searches ----------------------------------------------------------------------------------
def band_keys(fingerprint: Column) -> Column:
    """A key for each band of a fingerprint; two fingerprints share a key where a whole band agrees."""
    length = BAND * BITS // 4
    return F.transform(F.sequence(F.lit(0), F.lit(FUNCTIONS // BAND - 1)), lambda i: F.xxhash64(i, F.substr(fingerprint, i * length + 1, F.lit(length))))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, fingerprint, members): the sorted shingles of each text (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets, signs in _prints(batch, width):
                columns = [batch.column(0).slice(at.start, len(sets)), pa.array([s.tobytes().hex() for s in signs], pa.string()), pa.array([s.view(np.int64).tolist() for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "fingerprint", "members"])

    return rows.mapInArrow(run, "id long, fingerprint string, members array<long>")


def search(queries: DataFrame, docs: DataFrame, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(query_id, id, jaccard): the documents whose shingles have a Jaccard similarity of ``least`` or
    more to a query's, found by the bands of their fingerprints.

    Equal fingerprints are one candidate: documents are joined on bands as one representative, the
    least id, for each fingerprint, and the other ids of a representative are those of
    ``fingerprints`` with the same value.  The pairs that share a band are confirmed on the full sets,
    which are read for their two sides only.  The result has a row for each query fingerprint (its least
    id) and representative.

    Texts without words and rows without an id are not found; a query finds itself only as the
    representative of its fingerprint.
    """

    def known(df: DataFrame, name: str) -> DataFrame:
        found = fingerprints(df.where(F.col(id_col).isNotNull()), id_col, text_col, width).where("n_shingles > 0")
        return stored(found.groupBy("fingerprint").agg(F.min(id_col).alias("id")), name).select(F.col("id").alias(f"{name}_id"), F.col("fingerprint").alias(f"{name}_print"))

    def members(df: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
        own = [F.col(f"{name}_id").alias("id"), F.col(f"{name}_print").alias("fingerprint")]
        met = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(pairs.select(own[0]).distinct(), "id", "left_semi")
        found = _sets(met, width).dropDuplicates(["id", "fingerprint"])
        return found.select(F.col("id").alias(f"{name}_id"), F.col("fingerprint").alias(f"{name}_print"), F.col("members").alias(name))

    keyed = lambda df: df.select("*", F.explode(band_keys(F.col(df.columns[1]))).alias("band"))
    pairs = stored(keyed(known(queries, "query")).join(keyed(known(docs, "doc")), "band").drop("band").distinct(), "pairs")
    both = pairs.join(members(queries, "query", pairs), ["query_id", "query_print"]).join(members(docs, "doc", pairs), ["doc_id", "doc_print"])
    shared = F.size(F.array_intersect("query", "doc"))
    found = both.select("query_id", F.col("doc_id").alias("id"), (shared / (F.size("query") + F.size("doc") - shared)).alias("jaccard"))
    return found.where(F.col("jaccard") >= least)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
