"""Operator 10: near-duplicates by SimHash and BK-trees.

A text's words (A-Z lower-cased) give three-word shingles, repeats included; a fingerprint bit is set if it is set in
over half of the shingles' XXH64. Fingerprints that differ in at most ``radius`` bits are linked; a group is what links
reach.

Distinct fingerprints are dealt into shards: of 5 blocks of bits, two fingerprints within 2 bits agree in 3 at least, so
each goes to the 10 shards named by its choices of 3 blocks, and no link is lost. A shard of more than ``SHARD``
fingerprints is dealt again in the same way by the bits it leaves open (26 at radius 2), after which 11 bits are open and a
shard holds 2048 at most. A shard's BK-tree keys children by their integer distance to the parent; a search at
distance d follows only the edges from d - radius to d + radius. Trees are built and searched where their shard is,
and not broadcast, since nothing bounds the number of fingerprints. A shard passes on, for each member, its smallest
reachable member; groups then come from rounds of hooking and contraction on these edges.

Edge cases: a null or empty text has fingerprint zero and links like any other; fewer than three words are one shingle; a
null id never names a group unless all its ids are null; repeated rows get the same group; an empty table gives an empty
one; other columns are ignored (``dedup`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import cut, even

SEED, WIDTH = 42, 3
#: Searches (query, node) advanced together, over a fingerprint's words. On each level of a tree at most as many times as
#: many wait as a search follows edges: 5 at radius 2.
FRONTIER = 1 << 16
#: Fingerprints of a shard beyond which it is dealt again.
SHARD = 2048


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(WIDTH, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): fingerprints as signed longs; key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps)], names=["doc_id", "key", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(radius: int, keep: int = 3, among: int = (1 << 64) - 1) -> list[int]:
    """Bit masks of all choices of ``keep`` among ``radius + keep`` blocks of the bits ``among``."""
    places = [b for b in range(64) if among >> b & 1]
    bounds = [round(len(places) * k / (radius + keep)) for k in range(radius + keep + 1)]
    blocks = [sum(1 << b for b in places[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, keep)]


class BKTrees:
    """A tree for each run of fingerprints (of one or more words), all built and searched level by level together."""

    def __init__(self, fps: np.ndarray, runs: np.ndarray):
        self.fps = fps.reshape(len(fps), -1)
        self.span, self.frontier = 64 * self.fps.shape[1] + 1, FRONTIER // self.fps.shape[1]
        rows, groups = np.arange(len(fps)), runs
        first = np.concatenate([[True], groups[1:] != groups[:-1]])
        self.roots = rows[first][np.cumsum(first) - 1] if len(rows) else rows  # of each element's run
        self.equal = np.arange(len(fps))  # of each element, the one in its tree with its fingerprint
        rows, parents = rows[~first], self.roots[~first]
        keys, nodes = [], []
        while len(rows):
            distance = self.distance(rows, parents)
            self.equal[rows[distance == 0]] = parents[distance == 0]
            rows, edge = rows[distance > 0], (parents * self.span + distance)[distance > 0]
            order = np.argsort(edge, kind="stable")
            rows, edge = rows[order], edge[order]
            first = np.concatenate([[True], edge[1:] != edge[:-1]])[: len(edge)]
            heads = rows[first]
            keys.append(edge[first])
            nodes.append(heads)
            parents = heads[np.cumsum(first) - 1][~first]
            rows = rows[~first]
        keys, nodes = np.concatenate([*keys, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*nodes, np.empty(0, np.int64)]).astype(np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of the elements."""
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).sum(axis=1, dtype=np.int64)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of elements of one run within the radius, in parts: each pair of different fingerprints once, and each
        other element with the one that stands for its fingerprint."""
        apart = self.equal != np.arange(len(self.equal))
        if apart.any():
            yield np.flatnonzero(apart), self.equal[apart]
        asked = np.flatnonzero(~apart)
        stack: list[tuple[np.ndarray, np.ndarray]] = []
        begun = 0
        while stack or begun < len(asked):
            if not stack:
                every = asked[begun : begun + self.frontier]
                stack, begun = [(every, self.roots[every])], begun + len(every)
            own = [stack.pop()]
            while stack and sum(len(q) for q, _ in own) + len(stack[-1][0]) <= self.frontier:  # small parts go on together
                own.append(stack.pop())
            query, node = (np.concatenate(x) for x in zip(*own, strict=True))
            later = node < query  # what lies below a node comes after it
            if not later.any():
                continue
            query, node = query[later], node[later]
            distance = self.distance(query, node)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * self.span + np.maximum(distance - radius, 1))
            high = np.searchsorted(self.keys, node * self.span + np.minimum(distance + radius, self.span - 1), side="right")
            ends = np.cumsum(high - low)
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + 1, self.frontier)))
            for x, y in zip(cuts, [*cuts[1:], len(ends)], strict=True):
                n = (high - low)[x:y]
                if n.sum():
                    at = np.arange(n.sum()) + np.repeat(low[x:y] - (np.cumsum(n) - n), n)
                    stack.append((np.repeat(query[x:y], n), self.nodes[at]))


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (of each element, the least known member of its set) after joining the sets of the pairs."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        if (low == high).all():
            return labels
        np.minimum.at(labels, high, low)
        while not np.array_equal(nxt := labels[labels], labels):
            labels = nxt


def shard_edges(classes: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v), v < u: within every shard, each member with the smallest member that links reach; ids of ``classes`` (fp, id)."""
    wide = masks(radius)
    every, fine = (1 << 64) - 1, [[m | n for n in masks(radius, among=((1 << 64) - 1) ^ m)] for m in wide]

    def named(masks_of: Column) -> Column:
        return F.transform(masks_of, lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("bits")))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(signed(v & every)).cast("long") for v in values])

    dealt = classes.select("id", "fp", F.explode(named(longs(wide))).alias("s")).select("id", "fp", "s.mask", "s.bits")
    # The shards to deal again are at most len(wide) / SHARD of the fingerprints; the join's way is chosen by their size.
    large = dealt.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD).select("mask", "bits", F.lit(True).alias("large"))
    again = F.create_map(*[x for m, own in zip(wide, fine, strict=True) for x in (F.lit(signed(m)).cast("long"), longs(own))])
    shards = F.when(F.col("large"), named(F.element_at(again, F.col("mask")))).otherwise(F.array(F.struct("mask", "bits")))
    dealt = dealt.join(large, ["mask", "bits"], "left").select("id", "fp", F.explode(shards).alias("s")).select("s.mask", "s.bits", "fp", "id")
    dealt = dealt.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "id")

    return tree_edges(dealt, radius)


def tree_edges(dealt: DataFrame, radius: int) -> DataFrame:
    """``shard_edges`` of shards that are dealt and sorted: two columns that name a shard, a fingerprint's words, an id."""

    def edges(ks: np.ndarray, bits: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch | None:
        runs = np.cumsum(np.concatenate([[0], (ks[1:] != ks[:-1]) | (bits[1:] != bits[:-1])]))
        shared = np.bincount(runs)[runs] > 1
        if not shared.any():
            return None
        fps, ids, runs = np.stack(rest[:-1], axis=1)[shared].astype(np.uint64), rest[-1][shared], runs[shared]
        labels = np.arange(len(fps))  # rows are sorted by id within a run, so the least row has the least id
        for a, b in BKTrees(fps, runs).links(radius):
            new = labels[a] != labels[b]
            labels = unite(labels, a[new], b[new])
        moved = labels != np.arange(len(labels))
        return pa.record_batch([pa.array(ids[moved]), pa.array(ids[labels[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards come in order and whole; the last one of a batch may go on in the next."""
        held: list[np.ndarray] | None = None
        for batch in batches:
            own = [c.to_numpy() for c in batch.columns]
            own = [np.concatenate(x) for x in zip(held, own, strict=True)] if held else own
            if not len(own[0]):
                continue
            last = int(np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1]))[-1]) + 1 if ((own[0] != own[0][-1]) | (own[1] != own[1][-1])).any() else 0
            if last and (out := edges(*(x[:last] for x in own))) is not None:
                yield out
            held = [x[last:] for x in own]
        if held and len(held[0]) and (out := edges(*held)) is not None:
            yield out

    return dealt.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge the smallest node that edges reach.

    A round hooks each node to its smallest neighbour, follows that once, and contracts the edges to what their ends
    became. Every node with a smaller neighbour goes away, so rounds are few; each is cut once, as one table of its
    map and the edges left, and nothing comes to the driver but whether edges are left.
    """
    maps: list[DataFrame] = []
    left = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not left.isEmpty():
        both = left.select("u", "v").unionAll(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("up"))
        upper = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = hooked.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("root"))
        ends = left.join(step.select(F.col("node").alias("u"), F.col("root").alias("a")), "u").join(step.select(F.col("node").alias("v"), F.col("root").alias("b")), "v")
        rest = ends.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
        done = cut(step.select("node", "root", F.lit(True).alias("mapped")).unionAll(rest.select("node", "root", F.lit(False))))
        maps.append(done.where("mapped").select("node", "root"))
        left = done.where("not mapped").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not maps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = maps[0]
    for step in maps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return found


def roots_of(hashed: DataFrame, radius: int = 2) -> DataFrame:
    """(_fp, root, component_id) of every fingerprint of ``hashed``: a class goes by its fingerprint, a group by the smallest one
    (root), so that no id can stand for another; the smallest doc_id is only carried beside."""
    classes = hashed.groupBy("fp").agg(F.min("doc_id").alias("id"))
    roots = components(shard_edges(classes.select("fp", F.col("fp").alias("id")), radius))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), "id")
    return rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("_fp", "root", "component_id")


def group(hashed: DataFrame, radius: int = 2) -> DataFrame:
    """``hashed`` (doc_id, fp) with component_id, the smallest doc_id of its group."""
    hashed = cut(even(hashed))
    return hashed.join(roots_of(hashed, radius), F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def near_duplicates(df: DataFrame, radius: int = 2, **columns) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    return group(fingerprints(df, **columns).select("doc_id", "fp"), radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(df: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group: that of the smallest id, and of the smallest text hash among equal ids. Rows
    without an id stay, as they can't be told apart."""
    named = df.select(F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"))
    hashed = cut(even(fingerprints(df, id_col, text_col)))
    rows = hashed.where("doc_id is not null").join(roots_of(hashed, radius), F.col("fp") == F.col("_fp"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("_first")).select(F.col("_first.doc_id").alias("_id"), F.col("_first.key").alias("_key"))
    kept = named.join(first, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return kept.unionByName(named.where("_id is null")).select("_doc.*")
