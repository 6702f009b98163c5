"""Near copies by SimHash and BK-trees, confirmed by the likeness of their word shingles: one text of each group whose
pairs are linked at ``similarity``.

A text's words (A-Z lower-cased) give the set of its five-word shingles, held as XXH64; texts with one set are a class.
Two classes are linked if the Jaccard likeness of their sets is ``similarity`` at least; a group is what links reach.

Candidates are links of fingerprints, found by the operator's trees (``simhash.tree_edges``). At 0.8 a bit differs with
probability 0.15 (0.19 for four shingles of five), too often for 64 bits and a radius that leaves other texts out, so a
fingerprint has 256 bits: XXH64 of a shingle and three mixes of it vote on them. Pairs at 0.8 differ in 39 bits in the
mean (48), others in 128; the radius is ``RADIUS``, passed with probability 3e-11 (6e-7). Choices of equal bits, which deal
out the operator's shards, would be too many at this radius. A fingerprint goes to ``NAMES`` shards instead, each named by
the strongest, and its side, of ``AMONG`` random mixes of the votes, twice. By simulation a pair at 0.8 shares one but with
probability 1.2e-7; above it both are less.

What candidates reach is brought together once, and there all pairs are settled exactly: a pair at ``similarity`` shares one
of the rarest shingles of both (prefix filter), sizes differ by no more than the similarity allows, and each pair that
is left and not linked by others already has its sets counted.

Edge cases: null and empty texts are one class; fewer than five words are one shingle; rows without an id stay; rows
that share an id are told apart by their texts; other columns are kept; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.simhash import SEED, components, tree_edges
from gridloom.llm.storage import cut, partitions

WORDS, RADIUS = 4, 80
NAMES, AMONG = 88, 64
#: Shingles whose votes are counted together, and texts whose shards are named together: bound a task's memory.
STEP, TEXTS = 1 << 12, 128
#: Shingles of other sets that one set is compared with at a time.
CELLS = 1 << 20
#: Weights are 61 at most, so that those of ``SMALL`` shingles are below one vote.
SMALL, TIE = 64, 1 << 12
_MIXES = np.random.default_rng(SEED).standard_normal((NAMES * 2 * AMONG, WORDS * 64), np.float32)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted set of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(data[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def votes(own: np.ndarray) -> np.ndarray:
    """Of each bit of the fingerprint, by how many the shingles that set it outnumber the others, times ``TIE``. In small
    sets unequal weights below that decide ties: texts of few shingles would else agree in most bits."""
    ones, ties = np.zeros(WORDS * 64, np.int64), np.zeros(WORDS * 64, np.int64)
    for k in range(0, len(own), STEP):
        words = own[k : k + STEP, None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = words[:, 1:]
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
        if len(own) <= SMALL:
            ties = (own % np.uint64(61) + np.uint64(1)).astype(np.int64) @ (2 * bits.astype(np.int64) - 1)
    return TIE * (2 * ones - len(own)) + ties


def fingerprints(counted: np.ndarray) -> np.ndarray:
    """``WORDS`` words for each row of votes."""
    return np.packbits(counted > 0, axis=1, bitorder="little").view("<u8").astype(np.uint64)


def shards(counted: np.ndarray) -> np.ndarray:
    """``NAMES`` numbers for each row of votes."""
    out = np.empty((len(counted), NAMES), np.int16)
    for k in range(0, len(counted), TEXTS):
        mixed = (counted[k : k + TEXTS].astype(np.float32) @ _MIXES.T).reshape(-1, NAMES, 2, AMONG)
        low, high = mixed.argmin(axis=3), mixed.argmax(axis=3)
        below = -np.take_along_axis(mixed, low[..., None], 3)[..., 0] > np.take_along_axis(mixed, high[..., None], 3)[..., 0]
        side = np.where(below, low, high + AMONG)
        out[k : k + TEXTS] = side[:, :, 0] * (2 * AMONG) + side[:, :, 1]
    return out


def sketches(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, key, klass, fp, shards): key stands for the text, klass for its set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            klass, counted = np.empty(batch.num_rows, np.int64), np.empty((batch.num_rows, WORDS * 64), np.int64)
            for k, t in enumerate(batch.column(2)):
                own = shingles(t.as_py(), width)
                klass[k] = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)
                counted[k] = votes(own)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                for x in (fingerprints(counted).astype(np.int64), shards(counted))
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(klass), *lists], names=["doc_id", "key", "klass", "fp", "shards"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, klass long, fp array<long>, shards array<short>")


def candidates(hashed: DataFrame) -> DataFrame:
    """(u, v), v < u: classes of ``hashed`` whose fingerprints the trees link, as ``simhash.shard_edges``."""
    words = [F.col("fp")[k].alias(f"fp{k}") for k in range(WORDS)]
    dealt = hashed.dropDuplicates(["klass"]).select(F.posexplode("shards").alias("name", "bits"), *words, "klass")
    return tree_edges(dealt.repartition("name", "bits").sortWithinPartitions("name", "bits", "klass"), RADIUS)


def settle(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """Of each set the least index of its group; all pairs are settled. Sets go by size; what shares a rare shingle with one
    and is not in its group yet is counted, ``CELLS`` shingles at a time."""
    labels = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    parts = np.split(place, np.cumsum(sizes)[:-1])
    up = np.array([-(-int(n) * similarity.numerator // similarity.denominator) for n in sizes])  # shingles that a partner shares at least
    order = np.argsort(sizes, kind="stable")
    rare = []
    for x in order.tolist():
        own = parts[x]
        few = own[np.lexsort((own, count[own]))][: sizes[x] - up[x] + 1]
        rare.append(few[count[few] > 1])
    keys = np.concatenate(rare)
    holders = np.repeat(np.arange(len(sets)), [len(r) for r in rare])[np.argsort(keys, kind="stable")]  # of each rare shingle, by size
    begin = np.searchsorted(np.sort(keys), np.arange(len(count)))
    earlier = np.zeros(len(count), np.int64)
    own, near = np.zeros(len(count), np.int32), np.zeros(len(sets), bool)
    for at, x in enumerate(order.tolist()):
        few = rare[at]
        for b, n in zip(begin[few].tolist(), earlier[few].tolist(), strict=True):
            near[holders[b : b + n]] = True
        earlier[few] += 1
        found = order[np.flatnonzero(near)]
        near[:] = False
        found = found[sizes[found] >= up[x]]
        own[parts[x]] = 1
        step = 16
        while len(found := found[labels[found] != labels[x]]):
            some, found = found[-step:], found[:-step]
            both = np.add.reduceat(own[np.concatenate([parts[y] for y in some.tolist()])], np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
            for y in some[both * similarity.denominator >= similarity.numerator * (sizes[x] + sizes[some] - both)].tolist():
                if labels[y] != labels[x]:
                    low, high = sorted((labels[x], labels[y]))
                    labels[labels == high] = low
            step = max(1, min(2 * step, CELLS // int(sizes[x])))
        own[parts[x]] = 0
    return labels


def confirmed(members: DataFrame, similarity: Fraction, width: int) -> DataFrame:
    """(klass, least): of ``members`` (root, klass, text), where pairs may link only below one root."""
    dealt = members.repartition(partitions(members.sparkSession), "root").sortWithinPartitions("root", "klass")

    def settled(names: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        labels = settle(sets, similarity)
        return pa.record_batch([pa.array(names, pa.int64()), pa.array([names[k] for k in labels], pa.int64())], names=["klass", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Roots come in order and whole; their texts are held only as sets."""
        root, names, sets = None, [], []
        for batch in batches:
            for r, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if r != root and names:
                    yield settled(names, sets)
                    names, sets = [], []
                root = r
                names.append(k)
                sets.append(shingles(t.as_py(), width))
        if names:
            yield settled(names, sets)

    return dealt.mapInArrow(run, "klass long, least long")


def group(df: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, component) of every row; component is the same within a group and names no row."""
    exact = Fraction(str(similarity))
    hashed = cut(sketches(df, id_col, text_col, width))
    roots = cut(components(candidates(hashed)))
    texts = hashed.groupBy("klass").agg(F.min("key").alias("key")).join(roots.withColumnRenamed("node", "klass"), "klass")
    sources = df.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    members = texts.join(sources, "key").dropDuplicates(["klass"]).select("root", "klass", "text")
    found = cut(confirmed(members, exact, width))
    return hashed.join(found, "klass", "left").select("doc_id", "key", F.coalesce("least", "klass").alias("component"))


def dedup(df: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group: that of the smallest id, and of the smallest key among equal ids."""
    named = df.select(F.struct("*").alias("_doc"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_key"))
    groups = group(df, similarity, width, id_col, text_col).where("doc_id is not null")
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("_first")).select(F.col("_first.doc_id").alias("_id"), F.col("_first.key").alias("_key"))
    kept = named.join(first, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return kept.unionByName(named.where("_id is null")).select("_doc.*")
