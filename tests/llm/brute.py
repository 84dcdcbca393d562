"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[str]:
    found = WORD.findall(text or "")
    return [w.translate(LOWER) for w in found] if lower else found


def jump(key: int, shards: int) -> int:
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def shingle_set(text: str | None) -> set:
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_duplicates(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter()
    for group in holders.values():
        common.update(combinations(sorted(group), 2))
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def base_rules(text: str | None) -> dict:
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            inside.update((i, i + 1, i + 2))
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
        "base_failed": len(w) < 50 or 100 * len(inside) > 50 * len(w),
    }


def crc(data: bytes) -> int:
    return zlib.crc32(data)


# -- substrings --------------------------------------------------------------------------------
def substrings(docs: list[tuple[int, str]], passages: bool = True) -> dict[int, tuple[str, list[tuple[int, int, int]]]]:
    """doc -> the text that stays and (start, end, keeper) of what goes, for distinct ids."""
    found, lines, runs = {}, {}, {}
    for d, text in sorted(docs):
        spots = [(m.start(), m.end(), m[0].translate(LOWER)) for m in WORD.finditer(text)]
        w = [x[2] for x in spots]
        units, at = [], 0
        for line in text.split("\n"):
            n = len(WORD.findall(line))
            if n >= 5:
                key = tuple(w[at : at + n])
                if key in lines:
                    units.append((at, n, lines[key]))
                lines.setdefault(key, d)
            at += n
        keys = [tuple(w[i : i + 50]) for i in range(len(w) - 49)] if passages else []
        units += [(i, 50, runs[k]) for i, k in enumerate(keys) if runs.get(k, d) != d]
        for k in keys:
            runs.setdefault(k, d)
        found[d] = (text, spots, units)
    out = {}
    for d, (text, spots, units) in found.items():
        gone = {i for a, n, _ in units for i in range(a, a + n)}
        cuts, i, kept, at = [], 0, [], 0
        while i < len(spots):
            j = i
            while j in gone:
                j += 1
            if j > i:
                begin, end = spots[i][0], spots[j - 1][1]
                cuts.append((begin, end, min(k for a, _, k in units if a == i)))
                kept.append(text[at:begin])
                while end < len(text) and text[end] in " \t\x0b\x0c\r":
                    end += 1
                if (begin == 0 or text[begin - 1] == "\n") and end < len(text) and text[end] == "\n":
                    end += 1
                at = end
            i = max(j, i + 1)
        out[d] = ("".join([*kept, text[at:]]), cuts)
    return out


# -- decontamination ---------------------------------------------------------------------------
def bench_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bench_grams(w: list[str]) -> Counter:
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def simhash(w: list[str]) -> int:
    hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in w]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(w))


def leaks(docs, items, radius: int = 64) -> dict[tuple[int, int], float]:
    """(doc, item) -> best similarity of an item-sized window within the radius, of all that overlap
    the document."""
    out: dict = {}
    prepared = [(i, bench_words(t)) for i, t in items]
    prepared = [(i, w, bench_grams(w), simhash(w)) for i, w in prepared if w]
    for d, text in docs:
        w = bench_words(text)
        here = set()
        for k in range(1, 6):
            here.update(tuple(w[p : p + k]) for p in range(len(w) - k + 1))
        for item, iw, grams, finger in prepared:
            m = len(iw)
            if not here & grams.keys():
                continue
            for s in range(1 - m, len(w)):
                win = w[max(s, 0) : max(0, s + m)]
                g = bench_grams(win)
                both = sum(min(n, grams[x]) for x, n in g.items() if x in grams)
                sim = both / (sum(g.values()) + sum(grams.values()) - both)
                if 100 * sim >= 75 and (radius == 64 or (simhash(win) ^ finger).bit_count() <= radius):
                    out[d, item] = max(out.get((d, item), 0), sim)
    return out


# -- log-likelihood ratio ------------------------------------------------------------------------
def ratio_scores(docs: dict[int, str], trusted: set[int], buckets: int = 10_000, scale: int = 10_000) -> dict[int, float | None]:
    """Mean log ratio of the trusted and the raw multinomial over hashed unigrams and bigrams."""
    as_long = lambda h: h - (1 << 64) if h >> 63 else h
    of_long = lambda n, seed: xxhash.xxh64_intdigest(struct.pack("<q", n), seed)
    grams = {}
    for d, text in docs.items():
        tokens = regex.findall(r"[\p{L}\p{N}_]+|[^\x20\x09-\x0D\p{L}\p{N}_]+", text.lower())
        h = [as_long(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens]
        pairs = [as_long(of_long(b, of_long(a, 42))) for a, b in zip(h, h[1:])]
        grams[d] = [x % buckets for x in h + pairs]
    raw = Counter(b for g in grams.values() for b in g)
    target = Counter(b for d, g in grams.items() if d in trusted for b in g)
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    ratio = [round(scale * (math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw))) for b in range(buckets)]
    return {d: sum(ratio[b] for b in g) / len(g) / scale if g else None for d, g in grams.items()}


# -- licences ----------------------------------------------------------------------------------
def licence_scorer(templates, least: float = 0.75):
    """A function from a text to its best (-cosine, licence), or None."""
    bag = lambda text: Counter(re.findall(r"[^\W_]+", text.lower()))
    bags = [(name, bag(text)) for name, text in templates]
    seen = Counter(t for _, b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    vector = lambda b: {t: (1 + math.log(n)) * idf.get(t, math.log(1 + len(bags)) + 1) for t, n in b.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(name, vector(b)) for name, b in bags]

    def score(text: str):
        v = vector(bag(text))
        got = [(-round(sum(v.get(t, 0) * x for t, x in u.items()) / length(u) / length(v), 6), name) for name, u in vectors] if v else []
        return min((g for g in got if g[0] <= -least), default=None)

    return score


def own_licence(text, of_notice, of_file):
    """(licence, is a licence file) of a text by itself, or None."""
    words = lambda u: len(re.findall(r"[^\W_]+", u.lower()))
    plain = re.sub(r"(?m)^[ \t]*(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--)[ \t]?", "", text or "")
    paragraphs = [re.sub(r"\s+", " ", p, flags=re.ASCII) for p in re.split(r"\n[ \t]*\n", plain)]
    levels = [plain.split("\n"), [s for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)], paragraphs]
    found = [[(m, words(u)) for u in level if (m := of_notice(u))] for level in levels]
    whole = of_file(text or "")
    if whole:
        return whole[1], True
    if any(found):
        return min(m for level in found for m, _ in level)[1], 2 * max(sum(n for _, n in level) for level in found) >= words(text)
    return None


# -- Kneser-Ney --------------------------------------------------------------------------------
def kneser_ney(trusted: dict[int, list[int]], docs: dict[int, list[int]], n_pieces: int, start: int = 65535) -> dict[int, float]:
    """Mean negative log probability of each document, its own trusted counts left out."""
    pairs = Counter(p for ids in trusted.values() for p in zip([start, *ids], ids))
    total, by, follows = Counter(), defaultdict(Counter), Counter()
    for (u, v), n in pairs.items():
        total[u] += n
        by[u][min(n, 3)] += 1
        follows[v] += 1

    def discounts(n):
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.05) if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]

    d1 = discounts(Counter(min(n, 5) for n in pairs.values()))
    d0 = discounts(Counter(min(n, 4) for n in follows.values()))
    everything = max(1, sum(follows.values()))
    left = sum(d0[min(n, 3)] for n in follows.values()) / everything if follows else 1.0
    out = {}
    for d, ids in docs.items():
        own = Counter(zip([start, *trusted[d]], trusted[d])) if d in trusted else Counter()
        s = 0.0
        for u, v in zip([start, *ids], ids):
            n = pairs[u, v] - own[u, v]
            low = max(follows[v] - d0[min(follows[v], 3)], 0) / everything + left / n_pieces
            back = sum(d1[k] * by[u][k] for k in (1, 2, 3)) / total[u] if total[u] else 1.0
            s -= math.log(max(n - d1[min(n, 3)], 0) / max(total[u], 1) + back * low)
        if ids:
            out[d] = s / len(ids)
    return out
