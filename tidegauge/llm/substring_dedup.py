"""Operator 9: removal of lines and passages that occur before.

Units are hashed, digests are grouped globally, the earliest ranked occurrence stays and the others
go, with their places in the original text retained.  The main units are lines.

A line's hash does not find a passage that stands inside longer lines or across line breaks.  For
those there is a second kind of unit, which ``passages=False`` turns off: each PASSAGE = 50 words in a
row.  Not all of them are shuffled.  Runs of RUN words chosen by winnowing (Schleimer et al., 2003)
are anchors: of any RUN + WINDOW - 1 = 49 words that two documents have in common, both select the
same run.  Anchors that follow each other within RUN words, and do so in the earlier document too,
prove that all words from the first to the last are equal.  What a passage has before and after
them is found by hashing the PASSAGE words around the outer anchors only, in all documents that have
these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, give_back, hot_rows, join_groups, lean_workers, small_batches, stored
from .tables import table, with_field
from .textvec import Words, _mix, chunks, ranges

#: Bytes of text handled at a time.
CHUNK = 1 << 17
#: Words that a line needs to be a unit.
LINE_WORDS = 5
#: Words of a passage, of an anchor, and consecutive anchors of which the least hash is selected.
PASSAGE, RUN, WINDOW = 50, 25, 25
#: Ids of documents that are broadcast at most, to leave others out of a shuffle of texts.
BROADCAST_IDS = 2_000_000

_OCCURRENCE = "hash long, check int, doc_id long, body long, at int, n int, line boolean"
_FOUND = "doc_id long, body long, at int, n int, keeper long, hash long, hot boolean"
_RUN = "hash long, check int, doc_id long, body long, at int, later boolean, wide long"

_FIRST, _SECOND = 0xD1342543DE82EF95, 0x2545F4914F6CDD1D
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class _Sums:
    """Running sums of word hashes, from which any span's polynomial hash is a difference."""

    def __init__(self, h: np.ndarray, odd: int):
        if odd not in _powers or len(_powers[odd][0]) < len(h) + 1:
            size = max(len(h) + 1, 1 << 19)
            up, down = np.full(size, np.uint64(odd)), np.full(size, np.uint64(pow(odd, -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers[odd] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = _powers[odd]
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])

    def spans(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        size = np.asarray(n).astype(np.uint64)
        return _mix((self.total[start + n] - self.total[start]) * self.down[start] + size)


def _digests(sums: tuple[_Sums, _Sums], start: np.ndarray, n: np.ndarray | int) -> list[pa.Array]:
    """64 bits by which spans are grouped and 32 further ones that must be equal too."""
    return [pa.array(sums[0].spans(start, n).view(np.int64)), pa.array((sums[1].spans(start, n) >> np.uint64(32)).astype(np.uint32).view(np.int32))]


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of each line of LINE_WORDS words or more."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.cumsum(words.data == 0x0A)[words.start] + words.doc_of_word()
    start = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    n = np.diff(np.append(start, len(number)))
    return start[n >= LINE_WORDS], n[n >= LINE_WORDS]


def _anchors(words: Words, sums: _Sums) -> np.ndarray:
    """First words of the selected runs of RUN words of each document."""
    n = len(words.start) - RUN + 1
    m = n - WINDOW + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    doc = words.doc_of_word()
    whole = doc[:n] == doc[RUN - 1 :]  # within one document
    grams = sums.spans(np.arange(n), RUN)
    grams[~whole] = np.uint64(0xFFFFFFFFFFFFFFFF)
    # sliding minimum over WINDOW by doubling
    low, span = grams, 1
    while span * 2 <= WINDOW:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    low = np.minimum(low[:m], low[WINDOW - span : WINDOW - span + m])
    inside = doc[:m] == doc[RUN + WINDOW - 2 : RUN + WINDOW - 2 + m]
    picked = np.zeros(n, dtype=bool)
    for shift in range(WINDOW):
        picked[shift : shift + m] |= inside & (grams[shift : shift + m] == low)
    return np.flatnonzero(picked & whole)


def _occurrences(passages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            ids, bodies = batch.column(0), batch.column(1)
            for rows, words in chunks(batch, size=CHUNK):
                h = words.hashes(lower=True)
                sums = _Sums(h, _FIRST), _Sums(h, _SECOND)
                a, n = _lines(words)
                b = _anchors(words, sums[0]) if passages else np.zeros(0, np.int64)
                at, n = np.concatenate([a, b]), np.concatenate([n, np.full(len(b), RUN)])
                doc = np.searchsorted(words.first, at, side="right") - 1
                part = pa.array(doc + rows.start)
                place = [pa.array((at - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.arange(len(at)) < len(a))]
                yield pa.RecordBatch.from_arrays([*_digests(sums, at, n), ids.take(part), bodies.take(part), *place], names=["hash", "check", "doc_id", "body", "at", "n", "line"])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that go (lines, and chains of anchors of PASSAGE words or more), and with them, by hash,
    the outer anchors of all chains.

    Each row has the later lines and anchors of one document, by where they begin.
    """
    for batch in batches:
        flat = batch.column(2).flatten()
        if not len(flat):
            continue
        doc = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(2).offsets)))
        at, n, line, keeper, there, digest, hot = (np.asarray(flat.field(k)) for k in ("at", "n", "line", "keeper", "there", "hash", "hot"))
        run = np.flatnonzero(~line)
        d, a, k, shift = doc[run], at[run], keeper[run], (at - there)[run]
        fresh = np.ones(len(run), dtype=bool)
        fresh[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (shift[1:] != shift[:-1]) | (a[1:] > a[:-1] + RUN)
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(run))[: len(begin)] - 1
        size = a[end] + RUN - a[begin]
        long = size >= PASSAGE
        lines = np.flatnonzero(line)
        gone = np.concatenate([doc[lines], d[begin[long]]])
        outer = run[np.unique(np.concatenate([begin, end]))] if len(run) else run
        part, n_gone, n_outer = pa.array(np.concatenate([gone, doc[outer]])), len(gone), len(outer)
        none, cols = pa.nulls(n_outer, pa.int32()), []
        cols.append(pa.concat_arrays([pa.array(np.concatenate([at[lines], a[begin[long]]]), pa.int32()), none]))
        cols.append(pa.concat_arrays([pa.array(np.concatenate([n[lines], size[long]]), pa.int32()), none]))
        cols.append(pa.concat_arrays([pa.array(np.concatenate([keeper[lines], k[begin[long]]]), pa.int64()), pa.nulls(n_outer, pa.int64())]))
        cols.append(pa.concat_arrays([pa.nulls(n_gone, pa.int64()), pa.array(digest[outer], pa.int64())]))
        cols.append(pa.concat_arrays([pa.nulls(n_gone, pa.bool_()), pa.array(hot[outer], pa.bool_())]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(1).take(part), *cols], names=["doc_id", "body", "at", "n", "keeper", "hash", "hot"])


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All PASSAGE words in a row that hold one of the given anchors; ``later`` where a later one, and
    not inside a chain of the document, all words of which go already.

    Spots are anchors (without ``n``) and chains (with it).  ``wide`` is a digest that takes in the word
    before and the word after, where the passages that begin one word earlier and later are given too
    (and, of a later one, are later themselves or inside a chain).
    """
    for batch in batches:
        ids, bodies = batch.column(0), batch.column(1)
        for rows, words in chunks(batch, size=CHUNK):
            spots = batch.column(3).slice(rows.start, words.n_docs)
            flat, doc = spots.flatten(), np.repeat(np.arange(words.n_docs), np.diff(np.asarray(spots.offsets)))
            at, late, n = np.asarray(flat.field("at")) + words.first[doc], np.asarray(flat.field("later")), np.asarray(flat.field("n"))
            begin, anchor = at[n > 0], n == 0
            reach = np.maximum.accumulate(begin + n[n > 0])  # spots are in order
            at, late, doc = at[anchor], late[anchor], doc[anchor]
            if not len(at):
                continue
            h = words.hashes(lower=True)
            low, high = np.maximum(at + RUN - PASSAGE, words.first[doc]), np.minimum(at, words.first[doc + 1] - PASSAGE)
            size = np.maximum(high - low + 1, 0)
            every = ranges(low, size)
            place = np.unique(every)
            later = np.isin(place, every[np.repeat(late, size)])
            chain = np.searchsorted(begin, place, side="right")
            inside = np.append(0, reach)[chain] >= place + PASSAGE
            later &= ~inside
            doc = np.searchsorted(words.first, place, side="right") - 1
            part = pa.array(doc + rows.start)
            sums = _Sums(h, _FIRST), _Sums(h, _SECOND)
            goes, inner = later | inside, np.zeros(len(place), dtype=bool)
            inner[1:-1] = (place[2:] - place[:-2] == 2) & (~later[1:-1] | goes[2:] & goes[:-2])
            wide = np.zeros(len(place), dtype=np.int64)
            wide[inner] = sums[0].spans(place[inner] - 1, PASSAGE + 2).view(np.int64)
            cols = [*_digests(sums, place, PASSAGE), ids.take(part), bodies.take(part), pa.array((place - words.first[doc]).astype(np.int32)), pa.array(later), pa.array(wide, mask=~inner)]
            yield pa.RecordBatch.from_arrays(cols, names=["hash", "check", "doc_id", "body", "at", "later", "wide"])


def _few(ids: DataFrame) -> DataFrame | None:
    """Distinct ids as a broadcast side, if their number allows it."""
    ids = stored(ids.distinct(), "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else None


def _passages(texts: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, body, at, n, keeper) of the PASSAGE words around outer anchors that a smaller id has.

    Where the first document has the words before and after as well, its neighbours go too, and one
    in PASSAGE of such is enough for all words between the outermost ones.
    """
    edges = found.where("hash is not null").groupBy("hash").agg(F.max("hot").alias("hot"))
    anchors = join_groups(shared.where("not line").select("hash", "doc_id", "body", "at", "later"), edges, ["hash"])
    chains = found.where(F.col("hash").isNull() & (F.col("n") >= PASSAGE)).select("doc_id", "body", "at", F.lit(False).alias("later"), "n")
    spots = anchors.select("doc_id", "body", "at", "later", F.lit(0).alias("n")).union(chains)
    spots = spots.groupBy("doc_id", "body").agg(F.array_sort(F.collect_set(F.struct("at", "later", "n"))).alias("spots"), F.min("n").alias("least")).where("least = 0")
    spots = stored(spots.drop("least"), "spots")
    few = _few(spots.select("doc_id"))
    near = (texts if few is None else texts.join(few, "doc_id", "left_semi")).join(spots, ["doc_id", "body"])
    runs = stored(near.select("doc_id", "body", "text", "spots").mapInArrow(_around, _RUN), "runs")
    hot = F.col("times") > hot_rows(runs)
    first = runs.groupBy("hash").agg(F.min(F.struct("doc_id", "check", F.col("wide").isNull().alias("edge"), "wide")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
    first = stored(first.where("last > first.doc_id").select("hash", "first", hot.alias("hot")), "first")
    later = join_groups(runs.where("later").select("hash", "check", "doc_id", "body", "at", "wide"), first, ["hash"]).where("doc_id > first.doc_id and check = first.check")
    later = later.where((F.col("at") % PASSAGE == 0) | ~F.coalesce(F.col("wide") == F.col("first.wide"), F.lit(False)))
    return later.select("doc_id", "body", "at", F.lit(PASSAGE).alias("n"), F.col("first.doc_id").alias("keeper"))


def _spans(texts: DataFrame, passages: bool) -> DataFrame:
    """(doc_id, body, at, n, keeper): words [at, at + n) of a text that go."""
    occ = stored(texts.mapInArrow(_occurrences(passages), _OCCURRENCE), "units")
    hot = F.col("times") > hot_rows(occ)
    first = occ.groupBy("hash", "line").agg(F.min(F.struct("doc_id", "at", "check")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
    first = stored(first.where("times > 1 and (line or last > first.doc_id)").select("hash", "line", "first", hot.alias("hot")), "first")
    later = F.when(F.col("line"), F.struct("doc_id", "at") > F.struct("first.doc_id", "first.at")).otherwise(F.col("doc_id") > F.col("first.doc_id"))
    shared = join_groups(occ, first, ["hash", "line"]).where("check = first.check")
    shared = stored(shared.select("hash", "doc_id", "body", "at", "n", "line", F.col("first.doc_id").alias("keeper"), F.col("first.at").alias("there"), later.alias("later"), "hot"), "shared")
    each = shared.where("later").groupBy("doc_id", "body").agg(F.array_sort(F.collect_set(F.struct("at", "n", "line", "keeper", "there", "hash", "hot"))).alias("spans"))
    found = stored(each.mapInArrow(_chains, _FOUND), "found")
    gone = found.where("hash is null").select("doc_id", "body", "at", "n", "keeper")
    return gone.union(_passages(texts, shared, found)) if passages else gone


def _cut(words: Words, doc: int, spans: list[dict]) -> tuple[str, list[dict]]:
    """The document's text without the words of the spans, and the merged spans by code points.

    A span takes the white space after it along, but a line break only where it began its line.
    """
    base = int(words.text_start[doc])
    body = words.data[base : words.text_start[doc + 1]]
    first, last = int(words.first[doc]), int(words.first[doc + 1])
    edge, keeper = np.zeros(last - first + 1, dtype=np.int64), {}
    for s in spans:
        edge[s["at"]] += 1
        edge[s["at"] + s["n"]] -= 1
        keeper[s["at"]] = min(s["keeper"], keeper.get(s["at"], s["keeper"]))
    change = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=np.int8(0))
    char = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])  # code points before each byte
    keep = np.ones(len(body), dtype=bool)
    cuts = []
    for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
        begin, end = int(words.start[first + a]) - base, int(words.end[first + b - 1]) - base
        cuts.append({"start": int(char[begin]), "end": int(char[end]), "keeper": keeper[a]})
        fresh = begin == 0 or body[begin - 1] == 0x0A
        while end < len(body) and body[end] in (0x20, 0x09, 0x0B, 0x0C, 0x0D):
            end += 1
        if fresh and end < len(body) and body[end] == 0x0A:
            end += 1
        keep[begin:end] = False
    return body[keep].tobytes().decode(), cuts


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = True, deduped: str = "deduped", removed: str = "removed") -> DataFrame:
    """The rows with two more columns: ``deduped``, the text that stays, and ``removed``, an array of
    (start, end, keeper): code points [start, end) of the original text that went, and the least id of
    a document that has what begins there.

    Units are compared by their words with A-Z lowered; white space does not count.  A line of at
    least LINE_WORDS words goes if an equal line stands in a document of a smaller id or before it
    in the same one.  With ``passages`` all words go, too, that are part of PASSAGE words in a row
    which a document of a smaller id has, and no others.

    A digest that holds any share of all occurrences is a minimum that combines before the shuffle;
    its occurrences get the first by broadcast and don't meet in one task.  Digests have 96 bits.
    Only texts with something to look at are shuffled, as long as the ids of these can be broadcast.

    A null text stays null with nothing removed; an empty text stays empty; a very long one is hashed
    whole by one task.  Rows of one id are ranked alike: equal rows keep and lose the same, so that of
    equal first places all stay, and different texts of one id are told apart by their digest.  A row
    with a null id keeps its text and removes nothing from others.  Columns of the names of the two
    new ones are replaced, all others are kept.  An empty table gives an empty result.
    """
    lean_workers(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.drop(deduped, removed)
    body, own = free_name(docs, "body"), free_name(docs, "spans")
    keyed = docs.withColumn(body, F.xxhash64(text_col))
    texts = keyed.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(body).alias("body"), F.col(text_col).alias("text"))
    gone = _spans(texts, passages)
    spans = gone.groupBy("doc_id", "body").agg(F.collect_set(F.struct("at", "n", "keeper")).alias("spans"))
    id_, of = free_name(keyed, "id"), free_name(keyed, "of")
    spans = stored(spans.select(F.col("doc_id").alias(id_), F.col("body").alias(of), F.col("spans").alias(own)), "spans")
    few = _few(spans.select(id_))
    same = (keyed[id_col] == spans[id_]) & (keyed[body] == spans[of])
    names, at = docs.columns, docs.columns.index(text_col)
    cut_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("keeper", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, words in chunks(batch, text_col, CHUNK):
                part = batch.slice(rows.start, words.n_docs)
                texts, cuts = part.column(at).to_pylist(), [[] for _ in range(words.n_docs)]
                for d, spans in enumerate(part.column(len(names)).to_pylist()):
                    if spans:
                        texts[d], cuts[d] = _cut(words, d, spans)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(cuts, cut_type)], names=[*names, deduped, removed])

    span = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("keeper", T.LongType())
    schema = with_field(docs, deduped, T.StringType()).add(removed, T.ArrayType(span))
    if few is None:
        return keyed.join(spans, same, "left").select(*(keyed[c] for c in names), spans[own]).mapInArrow(run, schema)
    touched = keyed.join(few, keyed[id_col] == few[id_], "left_semi").join(spans, same, "left").select(*(keyed[c] for c in names), spans[own])
    whole = docs.join(few, docs[id_col] == few[id_], "left_anti").select(*(docs[c] for c in names), docs[text_col].alias(deduped), F.array().cast(T.ArrayType(span)).alias(removed))
    return touched.mapInArrow(run, schema).union(whole)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = True) -> DataFrame:
    """``docs`` with the repeated lines and passages taken out of the texts: ``text_col`` is the
    ``deduped`` of ``substring_duplicates``, which also says what becomes of odd rows."""
    text, spans = free_name(docs, "deduped"), free_name(docs, "removed")
    done = substring_duplicates(docs, id_col, text_col, passages, text, spans)
    return done.select(*(F.col(text).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size("removed").cast("long").alias("n_removed"), "removed", F.col("deduped").alias("text"))
