"""Operator 2: a quality classifier by the perplexity of a modified Kneser-Ney model.

An interpolated modified Kneser-Ney bigram model (Chen and Goodman, 1998) over the pieces of a public
BPE vocabulary is trained on all trusted text: labelled documents of quality 1 that are not toxic.

Counts are sharded by a hash of the bigram.  Only bigrams that would weigh on their shard, those with
more than one in HEAVY of a shard's share of all occurrences, are broadcast: at most HEAVY for each shard,
at any size.  What they add to a document is summed up where the document is read.  Of all others, tasks send to each
shard one packed array for a block of documents, each bigram once per document; the shard holds its part
of the model, adds up the log probabilities by document and returns one number per document.  Shards are
copied in proportion to the partitions of the documents and each block asks one copy, so that a bigram
which is rare in trusted text but common in the corpus is no task's burden either.  A document's
perplexity is compared with a high quantile of that of trusted documents of its language, whose own
occurrences are left out of the counts when they are scored.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import Encoder, text_chunks, vocabulary
from .shared import free_name, lean_workers, stored
from .tables import table, tokenizer_path

#: Ids fit 16 bits; the highest stands for the start of a document.
IDS = 1 << 16
START = IDS - 1
#: Parts of a shard's share of all occurrences, from one of which a bigram is broadcast (8 bytes each),
#: and shards at most; 256 shards of the 65,536 ** 2 bigrams that could be would still fit a task.
HEAVY, SHARDS = 1_000, 256
#: Pieces that a block of documents holds about; bounds a task's arrays.
BLOCK_PIECES = 500_000
#: A document is kept up to this quantile of its language's trusted perplexities, times SLACK.
QUANTILE, SLACK = 0.995, 1.25
#: A short text says little: its mean is taken with so many pieces of its language's trusted mean.
PRIOR_PIECES = 64
#: Steps of the histogram of log perplexities from which the quantiles come.
BIN = 0.005
#: Ids or languages that are broadcast at most; beyond, the same join shuffles.
BROADCAST_ROWS = 2_000_000


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays by byte planes, compressed: sorted keys as differences pack well."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.array([len(a), a.dtype.itemsize], np.int64).tobytes())
        parts.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstd.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstd.ZstdDecompressor().decompress(data), dtype=np.uint8)
    out, pos = [], 8
    for _ in range(int(raw[:8].view(np.int64)[0])):
        n, width = (int(x) for x in raw[pos : pos + 16].copy().view(np.int64))
        planes = raw[pos + 16 : pos + 16 + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"u{width}") if n else np.zeros(0, f"u{width}"))
        pos += 16 + n * width
    return out


def _steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint32(0)).astype(np.uint32)


def _keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint32)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * np.uint32(2654435761)) >> np.uint32(7)) % np.uint32(shards)


class _Model:
    """What every task needs beside its shard's bigrams: arrays over the vocabulary."""

    def __init__(self, stats: list, n_pieces: int):
        self.total, by_count, follows = np.zeros(IDS), np.zeros((3, IDS)), np.zeros(IDS)
        kinds = np.zeros(5, dtype=np.int64)
        for kind, i, a, b, c, d in stats:
            if kind == "context":
                self.total[i], by_count[:, i] = a, (b, c, d)
            elif kind == "follows":
                follows[i] = a
            else:
                kinds[1:] = a, b, c, d
        self.discount = self._discounts(kinds)
        safe = np.maximum(self.total, 1)
        self.backoff = np.where(self.total > 0, (self.discount[1:4, None] * by_count).sum(axis=0) / safe, 1.0)
        spread = np.bincount(np.minimum(follows.astype(np.int64), 4), minlength=5)
        d = self._discounts(spread)
        all_follows = max(1.0, follows.sum())
        left = (d[np.minimum(follows.astype(np.int64), 3)] * (follows > 0)).sum() / all_follows if follows.any() else 1.0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.lower = np.maximum(follows - d[np.minimum(follows.astype(np.int64), 3)], 0) / all_follows + left / n_pieces

    @staticmethod
    def _discounts(n: np.ndarray) -> np.ndarray:
        """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of types seen 1-4 times."""
        out = np.zeros(4)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        for k in (1, 2, 3):
            out[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) if n[k] and n[k + 1] else 0.5 * k
        return out

    def frequent(self, parts: list[bytes]) -> _Model:
        """The model with the counts of its most frequent bigrams."""
        found = [_unpack(p) for p in parts]
        keys = np.concatenate([_keys(x[0]) for x in found] or [self.keys])
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], np.concatenate([x[1] for x in found] or [self.counts])[order]
        return self

    def log_probability(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        u, v = keys >> np.uint32(16), keys & np.uint32(0xFFFF)
        seen = np.maximum(counts - self.discount[np.clip(counts, 0, 3).astype(np.int64)], 0) / np.maximum(self.total[u], 1)
        return np.log(seen + self.backoff[u] * self.lower[v])


def _bigrams(encoder: Encoder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The (piece before, piece) key of every piece of some texts, and the pieces of each text."""
    got = encoder.encode(texts)
    n = got.per_doc()
    ids = got.ids().astype(np.uint32)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = START
    return before << np.uint32(16) | ids, n


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the (sorted) keys of each shard, in order."""
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if ends[s] < ends[s + 1]:
            yield s, order[ends[s] : ends[s + 1]]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of sorted keys and their counts for each shard; rows come sorted by shard."""
    shard, keys, counts = None, [], []

    def out() -> pa.RecordBatch:
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([_pack(_steps(k), n)], pa.binary())], names=["shard", "data"])

    for batch in batches:
        for s, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if keys and s != shard:
                yield out()
                keys, counts = [], []
            shard = s
            steps, n = _unpack(data)
            keys.append(_keys(steps))
            counts.append(n)
            if len(keys) > 16:  # combine now and then, so that a shard's keys are held about once
                k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                keys, counts = [k], [np.bincount(inverse, weights=np.concatenate(counts)).astype(np.uint32)]
    if keys:
        yield out()


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums over a shard's bigrams: by context, by following word, and by count."""
    names = ["kind", "id", "a", "b", "c", "d"]
    size = IDS
    for batch in batches:
        for data in batch.column(1).to_pylist():
            steps, n = _unpack(data)
            keys = _keys(steps)
            u, v = (keys >> np.uint32(16)).astype(np.int64), (keys & np.uint32(0xFFFF)).astype(np.int64)
            total = np.bincount(u, weights=n, minlength=size)
            by = [np.bincount(u[n == 1], minlength=size), np.bincount(u[n == 2], minlength=size), np.bincount(u[n > 2], minlength=size)]
            follows = np.bincount(v, minlength=size)
            c, f = np.flatnonzero(total), np.flatnonzero(follows)
            kinds = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)
            cols = [np.concatenate([total[c], follows[f], kinds[1:2]])] + [np.concatenate([x[c], np.zeros(len(f)), kinds[k : k + 1]]) for k, x in zip((2, 3, 4), by)]
            kind = ["context"] * len(c) + ["follows"] * len(f) + ["kinds"]
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([c, f, [0]])), *(pa.array(x.astype(np.int64)) for x in cols)], names=names)


def _heavy(model: DataFrame, least: int) -> list[bytes]:
    """Packed keys and counts of the bigrams that occur ``least`` times or more."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                steps, counts = _unpack(data)
                at = np.flatnonzero(counts >= least)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(_steps(_keys(steps)[at]), counts[at])], pa.binary())], names=["data"])

    return [bytes(r.data) for r in model.mapInArrow(pick, "data binary").collect()]


def _table(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstd.ZstdCompressor(level=1).compress(sink.getvalue())


def perplexities(docs: DataFrame, labels: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, body (hash of the text), lang, trusted, n_pieces and log_ppl (nats a piece; null
    without pieces) of every row.

    A null or empty text has no pieces; a very long one is a block of its own; rows are scored one by
    one, whatever their ids; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    lean_workers(spark)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias("good_")).distinct()
    few = good.count() <= BROADCAST_ROWS
    good = F.broadcast(good) if few else good
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    parts = docs.rdd.getNumPartitions()
    shards = max(4, min(SHARDS, parts // 4))
    copies = -(-parts // shards)

    trusted = source.join(good, F.col("doc_id") == F.col("good_"), "left_semi").select("text")
    n_pieces = len(vocabulary(vocab_path).strings)

    def bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            rows = [(s, _pack(_steps(held[at]), counts[at].astype(np.uint32))) for s, at in _by_shard(held, shards)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "data"])

        encoder = Encoder(vocabulary(vocab_path))
        for batch in batches:
            for _, texts in text_chunks(batch.column(0)):
                k, n = np.unique(_bigrams(encoder, texts)[0], return_counts=True)
                held, inverse = np.unique(np.concatenate([held, k]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([counts, n]), minlength=len(held)).astype(np.int64)
                if len(held) > 4_000_000:
                    yield out()
                    held, counts = held[:0], counts[:0]
        if len(held):
            yield out()

    model = trusted.mapInArrow(bigram_counts, "shard int, data binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(_merged, "shard int, data binary")
    model = stored(model, "bigrams")
    stats = model.mapInArrow(_statistics, "kind string, id long, a long, b long, c long, d long").groupBy("kind", "id").agg(*(F.sum(x).alias(x) for x in "abcd")).collect()  # two rows a piece of the vocabulary
    occurrences = sum(r.a for r in stats if r.kind == "context")
    least = occurrences // (shards * HEAVY) + 1 if HEAVY else 1 << 32
    shared = spark.sparkContext.broadcast(_Model(stats, n_pieces).frequent(_heavy(model, least)))

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, docs_, heads, n_docs, n_held = None, [], [], [], 0, 0
        encoder = Encoder(vocabulary(vocab_path))

        def out() -> pa.RecordBatch:
            # one entry for each bigram of a document, sorted by bigram, with its number of times
            joint = np.concatenate(keys).astype(np.uint64)
            keys.clear()
            joint <<= np.uint64(32)
            joint |= np.concatenate(docs_)
            docs_.clear()
            joint.sort()
            at = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.zeros(0, np.int64)
            times = np.diff(np.append(at, len(joint)))
            joint = joint[at]
            key, doc = (joint >> np.uint64(32)).astype(np.uint32), (joint & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            head = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
            own, model = np.asarray(head.column(3)).astype(np.int64), shared.value
            base = np.zeros(n_docs)
            if len(model.keys) and len(key):
                at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
                here = model.keys[at] == key
                left = model.counts[at[here]].astype(np.int64) - times[here] * own[doc[here]]  # a trusted document does not vouch for itself
                base = np.bincount(doc[here], weights=model.log_probability(key[here], left) * times[here], minlength=n_docs)
                key, doc, times = key[~here], doc[~here], times[~here]
            head = head.append_column("base", pa.array(base))
            sent = [(s, _pack(_steps(key[at]), doc[at], times[at].astype(np.uint32))) for s, at in _by_shard(key, shards)]
            flags = _pack(own.astype(np.uint8))
            copy = (block * 0x9E3779B97F4A7C15 >> 40) % copies
            # the documents' columns go along once, with a shard that differs from block to block
            meta = [None] * len(sent)
            if sent:
                meta[block % len(sent)] = _table(head)
            if not sent:
                sent, meta = [(0, _pack(key, doc, times.astype(np.uint32)))], [_table(head)]
            return pa.RecordBatch.from_arrays(
                [pa.array([s * copies + copy for s, _ in sent], pa.int32()), pa.array([1] * len(sent), pa.int32()), pa.array([block] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary()), pa.array([flags] * len(sent), pa.binary()), pa.array(meta, pa.binary())],
                names=["slot", "kind", "block", "data", "flags", "head"],
            )

        for batch in batches:
            for rows, texts in text_chunks(batch.column(5)):
                part = batch.slice(rows.start, len(texts))
                if block is None:
                    block = part.column(0)[0].as_py()
                k, n = _bigrams(encoder, texts)
                keys.append(k)
                docs_.append(np.repeat(np.arange(n_docs, n_docs + len(texts), dtype=np.uint32), n))
                heads.append(pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), part.column(4), pa.array(n)], names=["doc_id", "body", "lang", "trusted", "n_pieces"]))
                n_docs, n_held = n_docs + len(texts), n_held + len(k)
                if n_held > BLOCK_PIECES or n_docs > 500_000:
                    yield out()
                    block, keys, docs_, heads, n_docs, n_held = None, [], [], [], 0, 0
        if heads:
            yield out()

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, known, n_known = None, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        for batch in batches:
            for s, kind, block, data, flags, head in zip(*(c.to_pylist() for c in batch.columns)):
                if s != slot:
                    slot, known, n_known = s, np.zeros(0, np.uint32), np.zeros(0, np.uint32)
                if kind == 0:
                    steps, n_known = _unpack(data)
                    known = _keys(steps)
                    continue
                steps, doc, times = _unpack(data)
                key, own = _keys(steps), _unpack(flags)[0]
                counts = np.zeros(len(key), dtype=np.int64)
                if len(known) and len(key):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    counts = np.where(known[at] == key, n_known[at], 0).astype(np.int64)
                counts -= times * own[doc]  # a trusted document does not vouch for itself
                log_p = shared.value.log_probability(key, np.maximum(counts, 0)) * times
                sums = np.bincount(doc, weights=log_p, minlength=len(own))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([s], pa.int32()), pa.array([sums.astype("<f8").tobytes()], pa.binary()), pa.array([head], pa.binary())], names=["block", "slot", "sums", "head"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, head = None, None, None

        def out() -> pa.RecordBatch:
            t = pa.ipc.open_stream(zstd.ZstdDecompressor().decompress(head)).read_next_batch()
            n = np.asarray(t.column(4))
            log_ppl = pa.array(-(total + np.asarray(t.column(5))) / np.maximum(n, 1), mask=n == 0)
            return pa.RecordBatch.from_arrays([*t.columns[:5], log_ppl], names=[*t.schema.names[:5], "log_ppl"])

        for batch in batches:
            for b, _, sums, h in zip(*(c.to_pylist() for c in batch.columns)):
                if block is not None and b != block:
                    yield out()
                    total = head = None
                block, head = b, h or head
                sums = np.frombuffer(sums, "<f8")
                total = sums.copy() if total is None else total + sums
        if block is not None:
            yield out()

    flagged = source.join(good, F.col("doc_id") == F.col("good_"), "left").select("doc_id", F.xxhash64("text").alias("body"), "lang", F.col("good_").isNotNull().alias("trusted"), "text")
    if not few:  # after a shuffle a task that is run again may cut other blocks
        flagged = stored(flagged, "flagged")
    flagged = flagged.select(F.monotonically_increasing_id().alias("row"), *flagged.columns)
    sent = flagged.mapInArrow(requests, "slot int, kind int, block long, data binary, flags binary, head binary")
    slot = F.explode(F.sequence(F.col("shard") * copies, F.col("shard") * copies + copies - 1)).alias("slot")
    parts = model.select(slot, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "data", F.lit(None).cast("binary").alias("flags"), F.lit(None).cast("binary").alias("head"))
    summed = sent.union(parts).repartitionById(shards * copies, F.col("slot")).sortWithinPartitions("slot", "kind", "block").mapInArrow(scores, "block long, slot int, sums binary, head binary")
    return summed.repartition("block").sortWithinPartitions("block", "slot").mapInArrow(gathered, "doc_id long, body long, lang string, trusted boolean, n_pieces long, log_ppl double")


def classify(docs: DataFrame, labels: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, body, lang, n_pieces, perplexity, smoothed, threshold and kept of every row.

    ``smoothed`` is the perplexity with PRIOR_PIECES more pieces of the mean log probability of the
    language's trusted text.  The threshold of a language is the given quantile of that of its
    trusted documents, in steps of BIN nats, times ``slack``; a language without trusted documents (or a null language)
    has that of all trusted documents together.  Nothing trusted: no threshold, and all rows with
    text are kept.  A null or empty text has no perplexity and is not kept.  Repeated rows
    and null ids are scored as rows of their own; other columns are ignored.  An empty table gives
    an empty result.
    """
    scored = stored(perplexities(docs, labels, vocab_path, id_col, text_col, lang_col), "perplexity")
    in_trusted = F.when(F.col("trusted"), F.col("log_ppl") * F.col("n_pieces"))
    mean = F.round(F.sum(in_trusted) / F.sum(F.when(F.col("trusted") & F.col("log_ppl").isNotNull(), F.col("n_pieces"))), 6)
    means = scored.where("lang is not null").groupBy("lang").agg(mean.alias("own_mean")).select(F.col("lang").alias("mean_lang"), "own_mean")
    means = F.broadcast(means) if means.count() <= BROADCAST_ROWS else means
    all_mean = scored.agg(mean.alias("m")).first().m
    centre = F.coalesce("own_mean", F.lit(all_mean).cast("double"), F.col("log_ppl"))
    smoothed = (F.col("log_ppl") * F.col("n_pieces") + PRIOR_PIECES * centre) / (F.col("n_pieces") + PRIOR_PIECES)
    scored = scored.join(means, F.col("lang") == F.col("mean_lang"), "left").withColumn("smooth_", smoothed)
    known = scored.where("trusted and log_ppl is not null").select("lang", F.ceil(F.col("smooth_") / BIN).cast("long").alias("bin"))
    by_lang = known.where("lang is not null").groupBy("lang", "bin").agg(F.count("*").alias("n"))
    overall = known.groupBy("bin").agg(F.count("*").alias("n")).withColumn("lang", F.lit(""))

    def at_quantile(bins: DataFrame) -> DataFrame:
        # one row a language and bin: windows over histograms, not over documents
        up, all_ = W.partitionBy("lang").orderBy("bin"), W.partitionBy("lang")
        run = bins.withColumn("below", F.sum("n").over(up)).withColumn("all", F.sum("n").over(all_))
        return run.where(F.col("below") >= quantile * F.col("all")).groupBy("lang").agg((F.min("bin") * BIN).alias("log_limit"))

    limits = at_quantile(by_lang).select(F.col("lang").alias("lang_"), F.col("log_limit").alias("own_limit"))
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    common = at_quantile(overall).first()
    limit = F.coalesce(F.col("own_limit"), F.lit(common.log_limit if common else None).cast("double"))
    found = scored.join(limits, F.col("lang") == F.col("lang_"), "left").withColumn("limit_", limit + math.log(slack))
    kept = F.col("log_ppl").isNotNull() & F.coalesce(F.col("smooth_") <= F.col("limit_"), F.lit(True))
    return found.select(F.col("doc_id").alias(id_col), "body", "lang", "n_pieces", F.exp("log_ppl").alias("perplexity"), F.exp("smooth_").alias("smoothed"), F.exp("limit_").alias("threshold"), kept.alias("kept"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all columns, whatever their names."""
    id_, body = free_name(docs, "id"), free_name(docs, "body")
    bad = classify(docs, labels, vocab_path, id_col, text_col, lang_col).where(~F.col("kept")).select(F.col(id_col).alias(id_), F.col("body").alias(body))
    bad = stored(bad.distinct(), "rejected")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, docs[id_col].eqNullSafe(bad[id_]) & F.xxhash64(docs[text_col]).eqNullSafe(bad[body]), "left_anti")


def op2_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tokenizer_path("byte_bpe_50k.json"))
    return found.select("doc_id", "lang", "n_pieces", "perplexity", "smoothed", "threshold", "kept")
