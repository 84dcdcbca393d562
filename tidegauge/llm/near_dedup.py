"""Operator 5: near-duplicate documents by a chosen-path set similarity join.

Every document is a set of five-word shingles, of which FUNCTIONS hash functions pick one minwise token
each (Christiani and Pagh, 2017; Christiani et al., 2018).  In each of a number of independent trees all
documents start at the root.  A node's own hash chooses which tokens its documents branch by, 4 / 3 of
them on average, and documents with the same token share a child.  A node stops branching as soon as
its members can be compared exhaustively, which is done by fingerprint; what fingerprints call similar
is confirmed on the full sets.

Two documents of similarity 0.75 keep one common child on average.  They meet in a node of depth 1, 2,
3, 4 or 5 of a tree with probability 0.81, 0.69, 0.60, 0.53 or 0.48, in one of TREES trees all but 2 in
10**12, 8 in 10**9, 4 in 10**7, 5 in 10**6 or 3 in 10**5; of higher similarity more surely.  Only groups
of more than BLOCK documents that share a token reach beyond depth 1.

Work on groups of copies is kept linear: equal sets have one representative; a first round links
each representative to the leaders of most of its nodes only, members that have the most in common with
all others; after that only pairs whose components
still differ are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import HOT_ROWS, free_name, give_back, hot_rows, join_groups, lean_workers, small_batches, stored
from .tables import table
from .textvec import _mix, binary_column, chunks, shingles, unique_per_doc

#: Five-word shingles, Jaccard similarity of at least 75 / 100.
WIDTH, ABOVE, OF = 5, 75, 100
#: Independent trees, and minwise functions in all.
TREES, FUNCTIONS = 16, 128
#: (tree, function) of the tokens that the roots choose: one, in every third tree two.
ROOTS = [(t, f) for t in range(TREES) for f in ([8 * t, 8 * t + 4] if t % 3 == 0 else [8 * t])]
#: Further levels at most.
LEVELS = 4
#: Members compared at once; a node of more branches unless its comparisons are no more than WORK.
BLOCK, WORK = 512, 2_000_000
#: Blocks' worth of members that a block of a large node's smaller components is compared with at once.
WIDE = 4
#: Leaders of a node of more than FEW members, each of a share of them; of a smaller node one.  Many
#: members can weigh as much as the best one and have little in common with the others: not all do.
LEADERS, FEW = 3, 64
#: Nodes that a representative has to have in common with a leader, to be compared with it first.
LED = len(ROOTS) // 4
#: Likely pairs for each member of a block up to which they are listed; beyond, the block is linked
#: as a whole with its sets at hand.
SPARSE = 4
#: Bytes of text handled at a time.
CHUNK = 1 << 17
#: Fingerprints have an error of 0.04 at 0.75; a pair below this estimate is not confirmed.
LEAST_ESTIMATE = 0.58
#: Ids that are broadcast at most (8 bytes each); beyond, the same join shuffles.
BROADCAST_IDS = 2_000_000

_A = _mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = _mix(np.arange(1001, FUNCTIONS + 1001, dtype=np.uint64))


def _minwise(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """FUNCTIONS minwise tokens (32 bits of them) of each non-empty set."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, FUNCTIONS), dtype=np.uint32)
    if len(full):
        for i in range(FUNCTIONS):
            h = values * _A[i]
            h += _B[i]
            out[full, i] = np.minimum.reduceat(h, first[full]) >> np.uint64(32)
    return out


def _sum_per_doc(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _digest(values: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Size and 128-bit digest of each set: equal for equal sets."""
    return [pa.array(np.diff(first), pa.int64()), pa.array(_sum_per_doc(_mix(values), first)), pa.array(_sum_per_doc(_mix(values ^ np.uint64(0x5851F42D4C957F2D)), first))]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for rows, words in chunks(batch, size=CHUNK):
            values, first = unique_per_doc(*shingles(words, words.hashes(lower=True), WIDTH))
            tokens = _minwise(values, first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(rows.start, words.n_docs) for c in (0, 1)), *_digest(values, first), binary_column(tokens.ravel(), np.arange(words.n_docs + 1) * FUNCTIONS)],
                names=["doc_id", "body", "n", "h1", "h2", "tokens"],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        for _, words in chunks(batch, size=CHUNK):
            values, first = unique_per_doc(*shingles(words, words.hashes(lower=True), WIDTH))
            yield pa.RecordBatch.from_arrays([*_digest(values, first), binary_column(values, first)], names=["n", "h1", "h2", "members"])


def _matrix(col: pa.Array, kind: type) -> np.ndarray:
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, dtype=kind).reshape(len(col), -1) if len(col) else np.zeros((0, 1), dtype=kind)


def _child(node: np.ndarray, root: np.ndarray, function: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The number of a node's child; its lowest five bits are the root."""
    mixed = _mix(node * np.uint64(0x9E3779B97F4A7C15) + (function.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64)))
    return mixed << np.uint64(5) | root.astype(np.uint64)


def _nodes(tokens: np.ndarray) -> np.ndarray:
    """The nodes at depth 1 of each representative, one for each of ROOTS."""
    tree, function = (np.array(x) for x in zip(*ROOTS))
    return _child(_mix(tree.astype(np.uint64) + np.uint64(1)), np.arange(len(ROOTS)), function, tokens[:, function])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            node = _nodes(_matrix(part.column(1), np.uint32)).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.repeat(np.asarray(part.column(0)), len(ROOTS)))], names=["node", "rep"])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members' nodes one level deeper: by one token that the node chooses, or by two."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            node = np.asarray(part.column(0)).view(np.uint64)
            tokens = _matrix(part.column(2), np.uint32)
            choice = _mix(node + np.uint64(7919))
            function = (choice % np.uint64(FUNCTIONS)).astype(np.int64)
            more = np.flatnonzero(choice >> np.uint64(8) & np.uint64(0xFFFF) < np.uint64(65536 // 3))
            second = (function[more] + 1 + (choice[more] >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64) % (FUNCTIONS - 1)) % FUNCTIONS
            at, function = np.concatenate([np.arange(len(node)), more]), np.concatenate([function, second])
            child = _child(node[at], node[at] & np.uint64(31), function, tokens[at, function]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(child), part.column(1).take(pa.array(at))], names=["node", "rep"])


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity from 8-bit fingerprints: a chance match in 256 is taken off."""
    return ((x == y).sum(axis=1) / FUNCTIONS - 1 / 256) / (1 - 1 / 256)


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough at all."""
    return np.minimum(n, m) * OF >= np.maximum(n, m) * ABOVE


def _pairs(block: dict[str, np.ndarray], root: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others, estimates): likely similar members of different components in a block.

    A block compared with itself has only left members; else left ones meet those that are not.  A
    pair that shares a node of an earlier root too is left to that one, unless that node branched: its
    pairs are compared only where they share a child.
    """
    rep, comp, n, left, prints, trail, branched = (block[k] for k in ("rep", "comp", "n", "left", "prints", "trail", "branched"))
    alone = bool(left.all())
    for i in np.flatnonzero(left):
        at = np.flatnonzero((comp != comp[i]) & _fits(n, n[i]) & ((rep > rep[i]) if alone else ~left))
        if len(at) and root:
            whole = np.flatnonzero(branched[i] >> np.arange(root) & 1 == 0)
            at = at[~(trail[np.ix_(at, whole)] == trail[i, whole]).any(axis=1)]
        if len(at):
            est = _similar(prints[at], prints[i])
            good = est >= LEAST_ESTIMATE
            if good.any():
                yield int(i), at[good], est[good]


def _block(entries: pa.Array) -> dict[str, np.ndarray]:
    out = {k: np.asarray(entries.field(k)) for k in ("rep", "comp", "n", "left", "branched")}
    return out | {"prints": _matrix(entries.field("prints"), np.uint8), "trail": _matrix(entries.field("trail"), np.uint32)}


_FOUND = "node long, i int, j int, a long, b long"


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The likely pairs of each block; of a block with more of them than SPARSE times its members
    only its name, with null for the pair."""
    for batch in batches:
        for r in range(batch.num_rows):
            node, i, j = (batch.column(c)[r].as_py() for c in range(3))
            block = _block(batch.column(3)[r].values)
            rep, out_a, out_b, room = block["rep"], [], [], SPARSE * len(block["rep"])
            for k, at, _ in _pairs(block, node & 31):
                out_a.append(np.minimum(rep[at], rep[k]))
                out_b.append(np.maximum(rep[at], rep[k]))
                room -= len(at)
                if room < 0:
                    break
            if not out_a:
                continue
            a, b = (pa.array([None], pa.int64()), pa.array([None], pa.int64())) if room < 0 else (pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b)))
            yield pa.RecordBatch.from_arrays([pa.array([node] * len(a), pa.int64()), pa.array([i] * len(a), pa.int32()), pa.array([j] * len(a), pa.int32()), a, b], names=["node", "i", "j", "a", "b"])


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within dense blocks, confirmed on the full sets; no more than join the components."""
    for batch in batches:
        for r in range(batch.num_rows):
            node, entries = batch.column(0)[r].as_py(), batch.column(1)[r].values
            block = _block(entries)
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in entries.field("members")]
            root = {int(c): int(c) for c in block["comp"]}

            def find(c: int, root: dict = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            out_a, out_b = [], []
            for k, at, est in _pairs(block, node & 31):
                best_first = at[np.argsort(-est, kind="stable")]
                for first in range(0, len(best_first), 64):
                    x = find(int(block["comp"][k]))
                    apart = [m for m in best_first[first : first + 64] if find(int(block["comp"][m])) != x]
                    for m in np.array(apart, dtype=np.int64)[_enough_of(sets[k], [sets[m] for m in apart])]:
                        x, y = find(int(block["comp"][k])), find(int(block["comp"][m]))
                        if x != y:
                            root[x] = y
                            out_a.append(block["rep"][k])
                            out_b.append(block["rep"][m])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def _enough(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return OF * both >= ABOVE * (len(x) + len(y) - both)


def _enough_of(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The same of one set and each of several; none is empty."""
    if not others:
        return np.zeros(0, dtype=bool)
    n, flat = np.array([len(y) for y in others]), np.concatenate(others)
    hits = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    both = np.add.reduceat(hits.astype(np.int64), np.cumsum(n) - n)
    return OF * both >= ABOVE * (len(x) + n - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for pair in zip(batch.column(2), batch.column(3)) for x in pair)
        mask = pa.array([_enough(x, y) for x, y in zip(sets, sets)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``rep`` is among the ids, so that others are not shuffled; all of them if the ids
    are too many to be broadcast."""
    ids = ids.distinct()
    return rows.join(F.broadcast(ids), "rep", "left_semi") if ids.count() <= BROADCAST_IDS else rows


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough.

    The set of an ``a`` with more than HOT_ROWS pairs is copied once for each HOT_ROWS of them.
    """
    of_a, of_b = (_of(sets, pairs.select(F.col(c).alias("rep"))) for c in ("a", "b"))
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("copies")).where("copies > 1")
    copies = F.broadcast(copies)  # no more rows than pairs / HOT_ROWS
    copy = F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int")
    dealt = pairs.select("a", "b").join(copies, "a", "left").select("a", "b", copy.alias("copy"))
    x = of_a.select(F.col("rep").alias("a"), F.col("members").alias("x")).join(copies, "a", "left")
    x = x.select("a", "x", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    y = of_b.select(F.col("rep").alias("b"), F.col("members").alias("y"))
    return dealt.join(x, ["a", "copy"]).join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long")


def _occupied(paths: DataFrame) -> DataFrame:
    """Members of the nodes that two or more share, with the node's size."""
    nodes = paths.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    nodes = stored(nodes.withColumn("hot", F.col("size") > hot_rows(paths)), "nodes")
    return join_groups(paths, nodes, ["node"])


def _with_leaders(members: DataFrame) -> DataFrame:
    """(rep, leader): for each representative the members that lead most of its nodes, LED at least, up
    to LEADERS of them.

    A node is led by that of its members whose nodes have most members in all: of a text and changed
    copies of it, the text, with which each has more in common than with the others.  One of many members
    has one such leader for each of LEADERS shares of them.
    """
    weight = members.groupBy("rep").agg(F.sum("size").alias("weight"))
    share = F.when(F.col("size") > FEW, F.pmod(F.xxhash64("rep"), F.lit(LEADERS))).otherwise(F.lit(0))
    weighed = members.join(weight, "rep").select("node", "rep", "size", "weight", share.alias("share"))
    leaders = weighed.groupBy("node", "share").agg(F.max(F.struct("weight", "rep")).alias("top"), F.max("size").alias("size"))
    leaders = stored(leaders.select("node", F.col("top.rep").alias("leader"), (F.col("size") > hot_rows(members)).alias("hot")), "leaders")
    led = join_groups(members.select("node", "rep"), leaders, ["node"]).where("rep != leader")
    counted = led.groupBy("rep", "leader").agg(F.count("*").alias("k")).where(F.col("k") >= LED)
    best = F.slice(F.sort_array(F.collect_list(F.struct("k", "leader")), asc=False), 1, LEADERS)  # of LEADERS * len(ROOTS) / LED at most
    return counted.groupBy("rep").agg(best.alias("best")).select("rep", F.explode("best.leader").alias("leader"))


def _labelled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their components (their own id while they have no link)."""
    named = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    return members.join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of nodes with several components: size, the largest component and how many others."""
    members = members.select("node", "rep", "comp")
    by = members.groupBy("node", "comp").agg(F.count("*").alias("k"))
    nodes = by.groupBy("node").agg(F.sum("k").alias("size"), F.max(F.struct("k", "comp")).alias("most"))
    nodes = nodes.select("node", "size", F.col("most.comp").alias("main"), (F.col("size") - F.col("most.k")).alias("minor")).where("minor > 0")
    nodes = stored(nodes.withColumn("hot", F.col("size") > hot_rows(members)), "nodes")
    return join_groups(members, nodes, ["node"]).drop("hot")


def _marked(prints: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``prints`` with a bit in ``branched`` for each root below which the member's node branches."""
    if rest is None:
        return prints.withColumn("branched", F.lit(0).cast("long"))
    bits = rest.groupBy("rep").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("node").bitwiseAND(31).cast("int"))).alias("branched"))
    return stored(prints.join(bits, "rep", "left").withColumn("branched", F.coalesce("branched", F.lit(0).cast("long"))), "marked")


def _dealt(members: DataFrame, prints: DataFrame) -> DataFrame:
    """Members of mixed nodes by blocks (i, j) to be compared.

    A node of up to BLOCK members is one block.  In a larger one the members outside its largest
    component form blocks of their own, each compared with itself and with every other block; the
    pairs inside the largest component are linked already, and its blocks are WIDE times as large, so that
    the others are copied less often.
    """
    nb = F.ceil(F.col("size") / (WIDE * BLOCK)).cast("int")
    minor = F.col("comp") != F.col("main")
    n_minor = F.ceil(F.col("minor") / BLOCK).cast("int")
    own = F.when(F.col("size") <= BLOCK, F.lit(0)).when(minor, F.pmod(F.xxhash64("rep"), n_minor).cast("int")).otherwise(n_minor + F.pmod(F.xxhash64("rep"), nb).cast("int"))
    n_left = F.when(F.col("size") <= BLOCK, F.lit(1)).otherwise(n_minor)
    n_all = F.when(F.col("size") <= BLOCK, F.lit(1)).otherwise(n_minor + nb)
    placed = members.withColumn("own", own).withColumn("n_left", n_left).withColumn("n_all", n_all)
    # (i, j): left block i with block j; a left block meets itself and those after it
    meets = F.when(
        F.col("own") < F.col("n_left"),
        F.concat(
            F.transform(F.sequence(F.col("own"), F.col("n_all") - 1), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
            F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>")),
        ),
    ).otherwise(F.transform(F.sequence(F.lit(0), F.col("n_left") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))
    return placed.join(prints, "rep").withColumn("at", F.explode(meets)).select("node", "at.i", "at.j", "rep", "comp", "n", "prints", "trail", "branched", (F.col("own") == F.col("at.i")).alias("left"))


_ENTRY = ["rep", "comp", "n", "prints", "trail", "branched", "left"]


def _found(dealt: DataFrame) -> DataFrame:
    """Likely pairs of the blocks' members, and the blocks that have too many of them."""
    blocks = dealt.groupBy("node", "i", "j").agg(F.collect_list(F.struct(*_ENTRY)).alias("block"))
    return stored(blocks.mapInArrow(_compare_blocks, _FOUND), "found")


def _sets(source: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, members) of some representatives, from the text of one document of each.

    Sets are joined and grouped by the same keys, so that they are shuffled once.
    """
    wanted = stored(reps.join(ids.distinct(), "rep").select("rep", "least", "n", "h1", "h2"), "wanted")
    texts = wanted.select(F.col("least").alias("doc_id")).distinct()
    texts = F.broadcast(texts) if wanted.count() <= BROADCAST_IDS else texts
    every = source.join(texts, "doc_id", "left_semi").mapInArrow(_shingle_sets, "n long, h1 long, h2 long, members binary")
    named = every.join(wanted.select("rep", "n", "h1", "h2"), ["n", "h1", "h2"]).groupBy("n", "h1", "h2", "rep").agg(F.any_value("members").alias("members"))
    return stored(named.select("rep", "members"), "sets")


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body (hash of the text), n, component_id and kept of every row."""
    lean_workers(docs.sparkSession)
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text"))
    signed = stored(source.mapInArrow(_signatures, "doc_id long, body long, n long, h1 long, h2 long, tokens binary"), "signed")
    # equal sets have one representative; its number is fixed once the table is written
    reps = signed.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least"), F.any_value("tokens").alias("tokens"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    paths = reps.select("rep", "tokens").mapInArrow(_paths, "node long, rep long")
    members = stored(_occupied(paths), "members")

    # Round 1: each representative with the leader of most of its nodes.
    best = _with_leaders(members).select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    best = stored(best, "best")
    links = stored(_links(best, _sets(source, reps, best.select(F.col("a").alias("rep")).union(best.select("b")))), "links")
    comps = connected_components(links)

    # Round 2: all pairs of a node whose components differ; large nodes branch first.
    todo = stored(_mixed(_labelled(members, comps)), "mixed")
    prints = reps.join(todo.select("rep").distinct(), "rep").select("rep", "n", "tokens").mapInArrow(_prints, "rep long, n long, prints binary, trail binary")
    prints = stored(prints, "prints")
    compared = []
    for level in range(LEVELS + 1):
        large = F.lit(False) if level == LEVELS else (F.col("size") > BLOCK) & (F.col("size") * F.col("minor") > WORK)
        rest = todo.where(large)
        last = level == LEVELS or rest.isEmpty()
        if level == 0:
            prints = _marked(prints, None if last else rest)
        dealt = _dealt(todo.where(~large), prints)
        compared.append((dealt, _found(dealt)))
        if last:
            break
        below = rest.select("node", "rep").join(_of(reps.select("rep", "tokens"), rest.select("rep")), "rep").select("node", "rep", "tokens").mapInArrow(_children, "node long, rep long")
        todo = stored(_mixed(_labelled(_occupied(stored(below, "below")), comps)), "mixed")
    pairs, full = None, None
    for dealt, found in compared:
        some = found.where("a is not null").select("a", "b")
        crowded = dealt.join(found.where("a is null").select("node", "i", "j"), ["node", "i", "j"], "left_semi")
        pairs, full = (some, crowded) if pairs is None else (pairs.union(some), full.union(crowded))
    pairs, full = stored(pairs.distinct(), "pairs"), stored(full, "crowded")
    sets = _sets(source, reps, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(full.select("rep")))
    blocks = full.join(sets, "rep").groupBy("node", "i", "j").agg(F.collect_list(F.struct(*_ENTRY, "members")).alias("block")).select("node", "block")
    more = stored(_links(pairs, sets).union(blocks.mapInArrow(_link_blocks, "a long, b long")), "links")
    comps = connected_components(links.union(more))

    # a component has the least id of its documents
    named = reps.select("rep", "least", "n", "h1", "h2").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "rep")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), (F.count("*") > hot_rows(named)).alias("hot"))
    named = join_groups(named, stored(least, "least"), ["component"])
    # and a set, however many documents have it, the component of its representative
    sizes = signed.where("n > 0").groupBy("n", "h1", "h2").agg((F.count("*") > hot_rows(signed)).alias("hot"))
    named = stored(named.drop("hot").join(sizes, ["n", "h1", "h2"]).select("n", "h1", "h2", "component_id", "hot"), "named")
    linked = F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    own = ["doc_id", "body", "n"]
    out = join_groups(signed.where(linked).select(*own, "h1", "h2"), named, ["n", "h1", "h2"]).select(*own, "component_id")
    out = out.union(signed.where(~linked).select(*own, F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id and kept.

    Words are runs of other characters than white space (0x20, 0x09-0x0D), with A-Z lowered.  The
    set of a document is that of its distinct five-word shingles, compared by 64-bit hashes; with fewer
    words it is the whole sequence as one; a null, empty or blank text has the empty set and is linked
    with nothing.  Documents are linked from a similarity of 0.75; component_id is the least id that
    links reach, and documents of that id are kept.  Rows are documents of their own: of rows with one
    id and different texts each is in the component of its own text, all of the id being kept where it
    is the least.  Equal rows have equal results.  A very long text is one set, read by one task.
    Other columns are ignored, a null id is never linked, and an empty table gives an empty result.
    """
    found = _components(docs, id_col, text_col)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The low byte of each minwise token, and 32 bits of each root's node."""
    for batch in batches:
        tokens = _matrix(batch.column(2), np.uint32)
        prints, trail, rows = tokens.astype(np.uint8), _nodes(tokens).astype(np.uint32), np.arange(len(tokens) + 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary_column(prints.ravel(), rows * FUNCTIONS), binary_column(trail.ravel(), rows * len(ROOTS))], names=["rep", "n", "prints", "trail"])


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is kept: of each group of near-duplicates that of the least
    id; rows with a null id stay.  All columns are kept, whatever their names."""
    id_, of = free_name(docs, "id"), free_name(docs, "of")
    gone = _components(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_), F.col("body").alias(of)).distinct()
    gone = stored(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, (docs[id_col] == gone[id_]) & (F.xxhash64(docs[text_col]) == gone[of]), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by brute force: all pairs of documents with a shingle in common, and what links reach.
OP5_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, e.b FROM reached r JOIN either e ON e.a = r.other
),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM components c LEFT JOIN sizes USING (doc_id)
"""
