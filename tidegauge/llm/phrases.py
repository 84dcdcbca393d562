"""Operator 12: collocations, counted by automata of the phrases that a sketch does not rule out."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lean_workers, small_batches, stored
from .tables import table
from .textvec import combine

#: Bytes of text that are worked on at a time: the size of a shard, and so of its automaton.
SHARD_BYTES = 6 << 20
#: Words for each cell of the sketch, whatever the size of the corpus: so the share of phrases that pass
#: wrongly does not grow with it. MOST_CELLS is beyond any corpus; past it more phrases pass, never fewer.
CELL_WORDS, MOST_CELLS = 1, 1 << 40
#: Cells of a piece of the sketch at most, and pieces at least. Pieces are summed up one at a time.
PIECE_CELLS, LEAST_PIECES = 1 << 22, 128
#: Bytes of a row group of the stored shards: a task reads one at a time.
GROUP_BYTES = 16 << 20
#: Cells of a shard's own table for each cell that passes, and in all.
OWN_CELLS, MOST_OWN = 128, 1 << 24
#: What each byte counts as: A-Z as a-z, what ends a piece as a byte that no UTF-8 text has, a tab as a blank.
_END = b"\xff"
_BYTES = np.frombuffer(bytes(range(256)).lower().translate(bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", _END * 10 + b" ")), dtype=np.uint8)
#: Symbols of a word's code: the first of one set, all others of another, so that no code begins within one.
_DIGITS, _FIRST, _STOP = 64, 128, 127


def _cut(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language of a task's rows, about ``shard_bytes`` at a time; of all languages, twice
    as many bytes wait at most."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    waiting = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            held[lang].append(text)
            size[lang] += len(text)
            waiting += len(text)
            if size[lang] >= shard_bytes or waiting >= 2 * shard_bytes:
                most = max(size, key=size.__getitem__)
                waiting -= size.pop(most)
                yield most, held.pop(most)
    yield from held.items()


def _zipped(data: bytes) -> bytes:
    return zstd.compress(data, 1)


def _unzipped(data: pa.Scalar) -> bytes:
    return zstd.decompress(data.as_buffer())


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32: their lowest bytes, their second bytes, and so on."""
    return _zipped(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _of_planes(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(_unzipped(data), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _packed(at: np.ndarray) -> bytes:
    """Ascending cells of a piece, by their distances."""
    return _planes(np.diff(at.astype("<u4"), prepend=np.zeros(1, "<u4")))


def _unpacked(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(_of_planes(data), dtype=np.uint32)


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The different words of some texts, and all of them by their numbers from 1, 0 at the end of each piece."""
    data = _BYTES[np.frombuffer(_END + _END.join(texts) + _END, dtype=np.uint8)]
    inside, end = data != ord(" "), data == _END[0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | end[1:] | end[:-1]
    starts = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist()[1:], np.asarray(coded.indices)[1:]


def _shards(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, lang, n, words, ids): texts of one language as the numbers of their words, 0 at the end
    of each piece, with their ``n`` words and, in the order of their numbers from 1, their different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (lang, texts) in enumerate(_cut(batches, shard_bytes)):
            words, found = _numbered(texts)
            row = [task << 32 | k], [lang], [np.count_nonzero(found)], [_zipped(b" ".join(words))], [_planes(found)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "lang", "n", "words", "ids"])

    return rows.mapInArrow(run, "shard long, lang string, n long, words binary, ids binary")


class _Shard:
    """The words of some texts as numbers, and their phrases."""

    def __init__(self, lang: pa.Scalar, words: pa.Scalar, ids: pa.Scalar) -> None:
        self.words = [_END, *_unzipped(words).split()]
        self.all = _of_planes(ids).astype(np.int64)
        within = self.all != 0
        piece = np.cumsum(~within)[within]
        self.ids = self.all[within]
        seed = crc32(lang.as_py().encode())
        self._hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], dtype=np.uint64)
        self._inner = np.append(piece[1:] == piece[:-1], False)  # whether the next word is in the same piece

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of n words within a piece."""
        m = max(0, len(self.ids) - n + 1)
        whole = [self._inner[i : m + i] for i in range(n - 1)]
        at = np.flatnonzero(np.logical_and.reduce(whole)) if whole else np.arange(m)
        return at, combine(self._hashes[self.ids], n)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def distinct(self, at: np.ndarray, n: int) -> np.ndarray:
        """Indexes into ``at``: one for each different phrase of n words among those that begin there, phrases
        that begin alike side by side."""
        key = self.ids[at]
        for i in range(1, n):
            if len(self.words) ** (i + 1) >> 63:  # else the numbers side by side are a number
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.words) + self.ids[at + i]
        return np.unique(key, return_index=True)[1]

    def texts(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that begin there, words parted by a blank."""
        words = pa.array(self.words, pa.large_binary())
        return pc.binary_join_element_wise(*(words.take(pa.array(self.ids[at + k])) for k in range(n)), pa.scalar(b" ", pa.large_binary()))

    def counts(self, phrases: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """How often phrases, given by (n, first words), stand in the pieces, overlaps included: hits of
        an Aho-Corasick automaton over the words' codes, which are of one length."""
        width = 1
        while _DIGITS**width < len(self.words):
            width += 1
        codes = np.arange(len(self.words))[:, None] // _DIGITS ** np.arange(width - 1, -1, -1) % _DIGITS
        codes[:, 0] += _FIRST
        codes[0] = _STOP
        codes = codes.astype(np.uint8)
        automaton, known = ahocorasick.Automaton(), 0
        for n, at in phrases:
            keys, long = codes[self.ids[at[:, None] + np.arange(n)]].tobytes().decode("latin-1"), n * width
            deque(map(automaton.add_word, (keys[i : i + long] for i in range(0, len(keys), long)), range(known, known + len(at))), 0)
            known += len(at)
        if not known:
            return np.zeros(0, dtype=np.int64)
        automaton.make_automaton()
        hits = np.fromiter(map(itemgetter(1), automaton.iter(codes[self.all].tobytes().decode("latin-1"))), dtype=np.int32)
        return np.bincount(hits, minlength=known)


def _cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Cell of each hash, in as few bytes as hold it."""
    return (hashes % np.uint64(cells)).astype(np.uint32 if cells <= 1 << 32 else np.uint64)


def sketch_size(words: int) -> tuple[int, int]:
    """Cells of the sketch of so many words, and of each of its pieces."""
    cells = min(MOST_CELLS, max(1 << 16, words // CELL_WORDS))
    return cells, min(PIECE_CELLS, -(-cells // LEAST_PIECES))


def _sketch(shards: DataFrame, longest: int, least: int, cells: int, piece: int) -> DataFrame:
    """(shard, first, at): of the cells that a shard touches, by piece from its ``first`` cell, those whose
    count reaches ``least`` in a count-min sketch of one wide row over all phrases of 1 to ``longest``
    words.  If the cell of a phrase does not, neither does the phrase.

    Each shard sends the cells that it touched with their counts, by piece of the row; each piece is
    summed up in an array of fixed size, and answers each shard.  Nothing meets in one place.
    """
    edges = np.arange(0, cells + piece, piece, dtype=np.uint64)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *row in zip(*(batch.column(c) for c in ("shard", "lang", "words", "ids"))):
                shard = _Shard(*row)
                at = np.concatenate([_cells(shard.phrases(n)[1], cells) for n in range(1, longest + 1)])
                at.sort()
                begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
                n = np.minimum(np.diff(np.append(begin, len(at))), least).astype(np.uint8)
                at = at[begin]
                bounds = np.searchsorted(at, edges)
                full = np.flatnonzero(np.diff(bounds))
                parts = [slice(bounds[k], bounds[k + 1]) for k in full]
                packed = [_packed(at[p].astype(np.uint64) - edges[k]) for k, p in zip(full, parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()] * len(full), pa.int64()), pa.array(edges[full].astype(np.int64)), pa.array(packed, pa.binary()), pa.array([_zipped(n[p].tobytes()) for p in parts], pa.binary())],
                    names=["shard", "first", "at", "n"],
                )

    def reached(sent: pa.Table) -> pa.Table:
        counts = np.zeros(piece, dtype=np.uint8)
        for cell, n in zip(sent.column("at"), sent.column("n")):
            at = _unpacked(cell)
            counts[at] = np.minimum(counts[at].astype(np.uint16) + np.frombuffer(_unzipped(n), dtype=np.uint8), least)
        full = counts >= least
        passing = [_packed(at[full[at]]) for at in map(_unpacked, sent.column("at"))]
        return pa.table([sent.column("shard"), sent.column("first"), pa.array(passing, pa.binary())], names=["shard", "first", "at"])

    sent = shards.select("shard", "lang", "words", "ids").mapInArrow(touched, "shard long, first long, at binary, n binary")
    return sent.groupBy("first").applyInArrow(reached, "shard long, first long, at binary").where("octet_length(at) > 0")


def _packed_phrases(phrases: pa.Array, counts: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Phrases, each with an end, and their counts, by ranges."""
    ended = pc.binary_join_element_wise(phrases, *(pa.scalar(x, pa.large_binary()) for x in (b"", b"\n")))
    at = np.frombuffer(ended.buffers()[1], dtype=np.int64)
    text = memoryview(ended.buffers()[2] or b"")
    ranges = list(zip(bounds[:-1], bounds[1:]))
    return [_zipped(text[at[i] : at[j]]) for i, j in ranges], [_planes(counts[i:j]) for i, j in ranges]


def _unpacked_phrases(phrases: pa.ChunkedArray, counts: pa.ChunkedArray) -> pa.Table:
    """(phrase, n) of all of them."""
    data = np.frombuffer(b"".join(map(_unzipped, phrases)), dtype=np.uint8)
    end = data == ord("\n")
    ends = np.flatnonzero(end)
    at = np.append(0, ends - np.arange(len(ends))).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data[~end])])
    return pa.table([texts, pa.array(np.concatenate([*map(_of_planes, counts)]).astype(np.int64))], names=["phrase", "n"])


def _scan(shards: DataFrame, sketch: DataFrame, longest: int, least: int, cells: int, piece: int) -> DataFrame:
    """(lang, size, phrase, n): sums of the shards' counts of the phrases that the sketch lets pass, if
    they reach ``least``.  A shard sends its phrases together, by language and piece of the sketch."""

    def run(one: pa.Table, passing: pa.Table) -> pa.Table:
        shard = _Shard(*(one.column(c)[0] for c in ("lang", "words", "ids")))
        cell = np.concatenate([np.zeros(0, dtype=np.uint64), *(_unpacked(at) + np.uint64(first.as_py()) for first, at in zip(passing.column("first"), passing.column("at")))])
        own = np.zeros(min(MOST_OWN, 1 << (OWN_CELLS * len(cell)).bit_length()), dtype=bool)
        own[_cells(cell, len(own))] = True
        found, pieces = [], []
        for n in range(1, longest + 1):
            at, hashes = shard.phrases(n)
            cell = _cells(hashes, cells)
            passed = np.flatnonzero(own[_cells(cell, len(own))])
            passed = passed[shard.distinct(at[passed], n)]
            found.append((n, at[passed]))
            pieces.append(cell[passed] // piece)
        single = np.bincount(shard.ids, minlength=1)[shard.ids[found[0][1]]]
        counts, pieces = np.concatenate([single, shard.counts(found[1:])]), np.concatenate(pieces)
        order = np.argsort(pieces, kind="stable")
        full, begin = np.unique(pieces[order], return_index=True)
        phrases = pa.concat_arrays([shard.texts(at, n) for n, at in found]).take(pa.array(order))
        sent = _packed_phrases(phrases, counts[order], np.append(begin, len(order)))
        lang = pa.array([one.column("lang")[0].as_py()] * len(full), pa.string())
        return pa.table([lang, pa.array(full.astype(np.int64)), *(pa.array(x, pa.binary()) for x in sent)], names=["lang", "piece", "phrases", "counts"])

    def summed(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        sums = _unpacked_phrases(sent.column("phrases"), sent.column("counts")).group_by("phrase").aggregate([("n", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("n_sum"), least))
        phrases = sums.column("phrase").cast(pa.string())
        size = pc.add(pc.count_substring(phrases, " "), 1).cast(pa.int32())
        return pa.table([pa.array([key[0].as_py()] * len(phrases), pa.string()), size, phrases, sums.column("n_sum")], names=["lang", "size", "phrase", "n"])

    both = shards.select("shard", "lang", "words", "ids").groupBy("shard").cogroup(sketch.groupBy("shard"))
    sent = both.applyInArrow(run, "lang string, piece long, phrases binary, counts binary")
    return sent.groupBy("lang", "piece").applyInArrow(summed, "lang string, size int, phrase string, n long")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, size, phrase, n) of all phrases of 1 to ``longest`` words that occur ``least`` times or
    more in a language, and of the number of words (size 0)."""
    if not 2 <= longest or not 1 <= least <= 255:
        raise ValueError("phrases have two words or more, and counts of 1 to 255 are asked for")
    lean_workers(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text")).where("text != ''")
    shards = stored(_shards(rows, shard_bytes), "shards", **{"parquet.block.size": GROUP_BYTES})
    cells, piece = sketch_size(shards.agg(F.sum("n")).first()[0] or 0)
    counts = _scan(shards, _sketch(shards, longest, least, cells, piece), longest, least, cells, piece)
    return counts.unionByName(shards.groupBy("lang").agg(F.lit(0).alias("size"), F.lit("").alias("phrase"), F.sum("n").alias("n")))


def _with_parts(counts: DataFrame, longest: int) -> DataFrame:
    """Candidates (lang, phrase, size, a) with the cut of the least score: l, r, score."""
    words = F.split("phrase", " ")
    join = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), join(F.lit(1), k).alias("first"), join(k + 1, F.col("size") - k).alias("rest")))
    cut = counts.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(cuts).alias("cut")).select("lang", "phrase", "size", "a", "cut.*")
    parts = counts.where(f"size between 1 and {longest - 1}")
    part = lambda name, n: parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    both = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = both.withColumn("score", score)
    least = F.min(F.struct("score", "k", "l", "r")).alias("least")
    return scored.groupBy("lang", "phrase", "size", "a").agg(least).select("lang", "phrase", "size", "a", "least.l", "least.r", "least.score")


def _inside(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, longer): of each phrase within a longer candidate, that one's count at most."""
    words = F.split("phrase", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))))
    return counts.where("size > 2").select("lang", F.explode(runs).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``top`` phrases of each language by how much more often their parts stand together than
    apart: lang, rank, phrase, a, l, r, n, score.

    A-Z count as a-z; a piece ends at ``.,;:!?`` and line ends, and words within it are parted by
    blanks and tabs.  Texts are stored as shards of word numbers.  A first scan of them fills a
    count-min sketch of all phrases, as wide as the corpus is large, whose pieces tell each shard which of
    its cells reach ``least``; a second one compiles the phrases of those cells into an Aho-Corasick
    automaton over words and counts its overlapping matches.  The shards' counts are summed up, and
    only then do the exact thresholds hold.  So an automaton is as large as a shard and a piece of the
    sketch of fixed size, however many phrases the corpus has; a phrase that the sketch lets pass
    wrongly costs a row; none is lost.  Parts are looked up by joins that Spark may split for frequent
    words, and ranks are cut in each task before a language meets.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its least cut, ``n`` all words of the
    language; the score is floor(1000000 * a * a / (l * r)), exact to counts of 15 digits.  Phrases
    within a longer candidate that has half their count or more are left out.  A null text is empty,
    a null lang 'und'; repeated rows count as often as they stand; a long text is scanned whole; other
    columns are ignored; an empty table gives an empty result.
    """
    counts = stored(phrase_counts(docs, longest, least, shard_bytes), "phrases")
    found = _with_parts(counts, longest).join(_inside(counts, longest), ["lang", "phrase"], "left")
    found = found.where("longer is null or 100 * longer < 50 * a")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda w: w != '') AS w
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
        FROM documents
    )
),
counts AS (
    SELECT lang, size, phrase, count(*) AS a
    FROM (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase FROM pieces, range(1, 4) AS s(size))
    GROUP BY ALL
),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND a >= 10),
cuts AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS f, array_to_string(w[k + 1 :], ' ') AS g FROM candidates c, range(1, 3) AS s(k) WHERE k < size),
scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = f AND x.size = k JOIN counts y ON y.lang = cuts.lang AND y.phrase = g AND y.size = cuts.size - k
),
cut_least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM candidates WHERE size = 3),
kept AS (SELECT c.* FROM cut_least c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 50 * c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
