"""Byte-pair encoding of whole Arrow batches with numpy.

Texts are cut into pre-tokens by character class, equal pre-tokens of a chunk are found by hash, and
the merges run on all distinct pre-tokens of the chunk at once: in each round every sequence applies
its own lowest-rank pair at all places where it stands (rank-synchronous merging).  A pair that
contains a merged symbol always ranks after the merge that made the symbol, so this gives the same
symbols as merging one place at a time.  A pre-token of more than LONG bytes would hold the rounds of
all others up; its pairs go through a queue instead, in time that grows little faster than its length.

Which characters are letters or numbers depends on a library's version of Unicode.  Characters that
Python's tables don't have are looked up once in a worker in the pre-tokenizer of the vocabulary, and
texts with characters that its normalizer treats in another way than Python go through the former.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .textvec import Words, ranges, text_buffers

_NONE = np.uint32(0xFFFFFFFF)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes of a pre-token up to which it is merged in rounds with all others.
LONG = 128
#: Text handled at a time; bounds the arrays of a task.
CHUNK = 1 << 19


class PairTable:
    """Open-addressing table from a 32-bit key to a 32-bit value, read for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        size = 1 << self.bits
        self.keys = np.full(size, _NONE, dtype=np.uint32)
        self.values = np.zeros(size, dtype=np.uint32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            at = (slot[todo] + self.probes - 1) & (size - 1)
            free = self.keys[at] == _NONE
            got, index = np.unique(at[free], return_index=True)
            chosen = todo[free][index]
            self.keys[got], self.values[got] = keys[chosen], values[chosen]
            todo = np.setdiff1d(todo, chosen, assume_unique=True)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values; 0xFFFFFFFF for keys that are not there."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        rest = np.flatnonzero((found != keys) & (found != _NONE))
        for p in range(1, self.probes):
            if not len(rest):
                break
            at = (slot[rest] + p) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (found != _NONE)]
        return out


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}


@lru_cache(maxsize=1)
def _python_classes() -> tuple[np.ndarray, np.ndarray]:
    """SPACE, LETTER, NUMBER or OTHER of each code point, and those that Python's tables don't have.

    Beyond plane 3 there are no letters, numbers or spaces.
    """
    out, unknown = np.full(0x110000, OTHER, dtype=np.uint8), np.zeros(0x110000, dtype=bool)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x40000):
        category = unicodedata.category(chr(c))
        out[c] = kinds.get(category[0], OTHER)
        unknown[c] = category == "Cn"
    # White_Space of the Unicode standard, fixed values
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out, unknown


def _classes(pre_tokenizer) -> np.ndarray:
    """The classes of the code points as a pre-tokenizer of the tokenizers library has them."""
    known, unknown = _python_classes()
    out, doubt = known.copy(), np.flatnonzero(unknown)
    # of "a", a character and "!" a letter joins the first, a number neither, all else the last
    begins = np.zeros(3 * len(doubt) + 1, dtype=bool)
    for i in range(0, len(doubt), 4096):
        part = doubt[i : i + 4096]
        begins[[3 * i + a for _, (a, _) in pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}!" for c in part))]] = True
    at, after = begins[1::3][: len(doubt)], begins[2::3][: len(doubt)]
    out[doubt] = np.where(~at, LETTER, np.where(after, NUMBER, OTHER))
    return out


def _normal(text: str) -> str:
    """Composed form and lower case of each character, by Python's tables."""
    text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def _differing(normalizer) -> np.ndarray:
    """Code points that Python's tables don't have or that a normalizer treats in another way."""
    out = _python_classes()[1].copy()
    for c in map(chr, range(0x80, 0x40000)):
        mark, apart = unicodedata.combining(c), unicodedata.normalize("NFD", c)
        tried = [c, apart] if apart != c or c.lower() != c else []
        if mark:  # next to a mark of a higher and one of a lower class
            tried += ["\u0345" + c, "\u0306" + c, c + "\u0323", c + "\u0334"]
        if any(normalizer.normalize_str(x) != _normal(x) for x in tried):
            out[[ord(x) for x in c + apart]] = True
    return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in a process."""
    return Vocabulary(path)


class Vocabulary:
    """A BPE vocabulary file in the JSON format of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError(f"{path}: ids beyond 65535 are not supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        #: Words without white space and lower-cased, or GPT-style pieces that carry the space before.
        self.words_only = bool(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        # the library's rules for characters, without its vocabulary
        rules = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": [], "unk_token": None}, "added_tokens": [], "post_processor": None}))
        self.normalizer, self.kinds = rules.normalizer, _classes(rules.pre_tokenizer)
        self.differs = _differing(rules.normalizer) if self.words_only else None
        letters = _byte_letters()
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.uint32)
        self.last_id = np.array([vocab[letters[b] + self.suffix] for b in range(256)], dtype=np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint32)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        self.ranks = PairTable(left << np.uint32(16) | right, np.arange(len(pairs), dtype=np.uint32))
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in (vocab | self.special).items():
            self.strings[i] = s
        self._rank_of: dict[int, int] | None = None

    # -- merging ---------------------------------------------------------------------------------
    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte strings data[start:end], one after the other, and the count for each."""
        long = np.flatnonzero(end - start > LONG)
        if not len(long):
            return self._merge_rounds(data, start, end)
        short = np.flatnonzero(end - start <= LONG)
        some, n_some = self._merge_rounds(data, start[short], end[short])
        more = [self._merge_queue(data[a:b]) for a, b in zip(start[long], end[long])]
        n = np.zeros(len(start), dtype=np.int64)
        n[short], n[long] = n_some, [len(x) for x in more]
        at, flat = np.cumsum(n) - n, np.empty(int(n.sum()), dtype=np.uint16)
        flat[ranges(at[short], n_some)] = some
        flat[ranges(at[long], n[long])] = np.concatenate(more)
        return flat, n

    def _merge_queue(self, data: np.ndarray) -> np.ndarray:
        """Ids of one byte string: its pairs by rank and place, from a queue."""
        if self._rank_of is None:
            used = self.ranks.keys != _NONE
            self._rank_of = dict(zip(self.ranks.keys[used].tolist(), self.ranks.values[used].tolist()))
        rank_of, made = self._rank_of, self.made
        sym = self.byte_id[data].tolist()
        if self.suffix:
            sym[-1] = int(self.last_id[data[-1]])
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.ranks.get(np.array(sym[:-1], np.uint32) << np.uint32(16) | np.array(sym[1:], np.uint32))
        at = np.flatnonzero(pairs != _NONE)
        queue = (pairs[at].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(queue)
        while queue:
            first = heapq.heappop(queue)
            rank, i = first >> 32, first & 0xFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n or rank_of.get(sym[i] << 16 | sym[j]) != rank:
                continue
            sym[i], sym[j] = int(made[rank]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of.get(sym[i] << 16 | sym[k])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of.get(sym[h] << 16 | sym[i])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | h)
        return np.array([x for x in sym if x >= 0], dtype=np.uint16)

    def normalized(self, part: str) -> str:
        """A text in composed form and lower case, as the vocabulary has its words."""
        if part.isascii():
            return part.lower()
        if self.differs[np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)].any():
            return self.normalizer.normalize_str(part)
        return _normal(part)

    def _merge_rounds(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = end - start
        n = len(start)
        counts = np.zeros(n, dtype=np.int64)
        sym = self.byte_id[data[ranges(start, lengths)]]
        live = np.flatnonzero(lengths > 0)
        size = lengths[live]
        if self.suffix and len(live):
            last = np.cumsum(size) - 1
            sym[last] = self.last_id[data[end[live] - 1]]
        done_seq: list[np.ndarray] = []
        done_sym: list[np.ndarray] = []
        while len(live):
            first = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(live)), size)
            rank = np.full(len(sym), _NONE, dtype=np.uint32)
            inner = owner[1:] == owner[:-1]
            at = np.flatnonzero(inner)
            rank[at] = self.ranks.get(sym[at] << np.uint32(16) | sym[at + 1])
            best = np.minimum.reduceat(rank, first)
            ended = best == _NONE
            if ended.any():
                gone = ended[owner]
                done_seq.append(live[ended])
                done_sym.append(sym[gone].astype(np.uint16))
                counts[live[ended]] = size[ended]
                stay = ~gone
                sym, rank, owner, live, best = sym[stay], rank[stay], owner[stay], live[~ended], best[~ended]
                if not len(live):
                    break
                owner = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]).astype(np.int64)]))
            hit = rank == best[owner]
            # a run "aaa" of one symbol holds overlapping pairs: take every second one from its left
            over = np.flatnonzero(hit[1:] & hit[:-1])
            if len(over):
                hit = self._alternate(hit)
            where = np.flatnonzero(hit)
            sym[where] = self.made[rank[where]]
            keep = np.ones(len(sym), dtype=bool)
            keep[where + 1] = False
            sym, owner = sym[keep], owner[keep]
            size = np.bincount(owner, minlength=len(live))
        if not done_seq:
            return np.zeros(0, dtype=np.uint16), counts
        seq, flat = np.concatenate(done_seq), np.concatenate(done_sym)
        n_of = counts[seq]
        src = np.zeros(n, dtype=np.int64)
        src[seq] = np.cumsum(n_of) - n_of
        return flat[ranges(src, counts)], counts

    @staticmethod
    def _alternate(hit: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(hit)
        begins = np.ones(len(at), dtype=bool)
        begins[1:] = at[1:] != at[:-1] + 1
        run_start = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        out = np.zeros_like(hit)
        out[at[(at - run_start) % 2 == 0]] = True
        return out


@dataclass
class Pieces:
    """Pre-tokens of a chunk in text order. A special string is a piece of no bytes with its id."""

    words: Words
    special: np.ndarray  # int64: id of a special string, or -1


def _cut(points: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (in code points) of the pre-tokens of texts joined at ``bounds``."""
    n, words_only = len(points), vocab.words_only
    kind = vocab.kinds[points]
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[bounds[:-1][np.diff(bounds) > 0]] = True
    text_start[n] = True
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= text_start[:n]
    quote = (points == 0x27) & change
    after = np.zeros(n, dtype=bool)  # first code point after a contraction
    at = np.flatnonzero(quote)
    if not words_only:  # a space before belongs to the piece, which is then no contraction
        at = at[(at == 0) | text_start[at] | (points[at - 1] != 0x20)]
    nxt = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
    inside1 = ~text_start[np.minimum(at + 1, n)]
    inside2 = inside1 & ~text_start[np.minimum(at + 2, n)]
    one, two = nxt[at + 1], nxt[at + 2]
    short = inside1 & np.isin(one, [0x73, 0x74, 0x6D, 0x64])
    long = inside2 & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
    begin = change.copy()
    cont = at[short | long]
    begin[cont + 1] = False
    tail = np.concatenate([at[short] + 2, at[long & ~short] + 3])
    after[tail[tail < n]] = True
    begin |= after
    if words_only:
        begin |= kind == NUMBER
        begin &= kind != SPACE
        starts = np.flatnonzero(begin)
        stop = change | begin
        stop[cont + 1] = begin[cont + 1]
        ends = np.append(np.flatnonzero(stop), n)
        return starts, ends[np.searchsorted(ends, starts, side="right")]
    space = kind == SPACE
    solid_next = np.zeros(n, dtype=bool)
    solid_next[:-1] = ~space[1:] & ~text_start[1:n]
    last = space & solid_next  # last white space before something else
    begin |= last
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    begin[joined] = False
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)


def pieces(texts: list[str], vocab: Vocabulary) -> Pieces:
    """Pre-tokens of the texts, each text's special strings taken out first."""
    segments: list[str] = []
    owner: list[int] = []
    marks: list[tuple[int, int]] = []  # number of segments before, id
    mark_owner: list[int] = []
    split = re.compile("(" + "|".join(map(re.escape, vocab.special)) + ")") if vocab.special else None
    for d, text in enumerate(texts):
        parts = split.split(text) if split and any(s in text for s in vocab.special) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                marks.append((len(segments), vocab.special[part]))
                mark_owner.append(d)
            else:
                segments.append(vocab.normalized(part) if vocab.words_only else part)
                owner.append(d)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    joined = "".join(segments)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    data = np.frombuffer(joined.encode("utf-8"), dtype=np.uint8)
    starts, ends = _cut(points, bounds, vocab) if len(points) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    seg = np.searchsorted(bounds, starts, side="right") - 1
    doc = np.asarray(owner, dtype=np.int64)[seg]
    if len(data) != len(points):
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        starts, ends = byte_at[starts], byte_at[ends]
    special = np.full(len(starts), -1, dtype=np.int64)
    if marks:
        at = np.searchsorted(seg, [m[0] for m in marks])
        starts, ends = np.insert(starts, at, 0), np.insert(ends, at, 0)
        doc, special = np.insert(doc, at, mark_owner), np.insert(special, at, [m[1] for m in marks])
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Pieces(Words(data, np.zeros(len(texts) + 1, dtype=np.int64), starts, ends, first), special)


@dataclass
class Encoded:
    """Ids by distinct piece: piece p of the chunk has ids flat[at[p] : at[p] + n[p]]."""

    flat: np.ndarray
    at: np.ndarray
    n: np.ndarray
    first: np.ndarray  # pieces of each document

    def per_doc(self) -> np.ndarray:
        """Number of ids of each document."""
        total = np.concatenate([[0], np.cumsum(self.n)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def ids(self) -> np.ndarray:
        """Ids of all documents of the chunk, one after the other."""
        return self.flat[ranges(self.at, self.n)]


class Encoder:
    """Encodes chunk after chunk; keeps the ids of pieces seen before, up to ``keep`` of them."""

    def __init__(self, vocab: Vocabulary, keep: int = 100_000):
        self.vocab, self.keep = vocab, keep
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.where = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint16)

    def _unseen(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.vocab.merge(data, start, end)

    def encode(self, texts: list[str]) -> Encoded:
        p = pieces(texts, self.vocab)
        h = p.words.hashes()
        marked = np.flatnonzero(p.special >= 0)
        h[marked] = p.special[marked].astype(np.uint64)  # no bytes: the hash of such a piece is free
        distinct, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self._clear()
        at = np.searchsorted(self.known, distinct)
        at_ok = np.minimum(at, max(0, len(self.known) - 1))
        old = self.known[at_ok] == distinct if len(self.known) else np.zeros(len(distinct), dtype=bool)
        new = np.flatnonzero(~old)
        if len(new):
            flat, n = self._unseen(p.words.data, p.words.start[index[new]], p.words.end[index[new]])
            where = np.cumsum(n) - n + len(self.flat)
            sp = np.flatnonzero(p.special[index[new]] >= 0)
            if len(sp):
                where[sp] = len(self.flat) + len(flat) + np.arange(len(sp))
                n[sp] = 1
                flat = np.concatenate([flat, p.special[index[new[sp]]].astype(np.uint16)])
            self.flat = np.concatenate([self.flat, flat])
            self.known = np.insert(self.known, at[new], distinct[new])
            self.where = np.insert(self.where, at[new], where)
            self.count = np.insert(self.count, at[new], n)
            at = np.searchsorted(self.known, distinct)
        return Encoded(self.flat, self.where[at][inverse], self.count[at][inverse], p.words.first)


def heads(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The first ``rows`` rows; what follows is not read."""
    for batch in batches:
        yield batch.slice(0, rows)
        rows -= batch.num_rows
        if rows <= 0:
            return


def text_chunks(col: pa.Array, size: int = CHUNK):
    """Slices of a text column with about ``size`` bytes each, and their texts (null: empty)."""
    _, offsets = text_buffers(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield slice(i, j), [x or "" for x in col.slice(i, j - i).to_pylist()]
        i = j
