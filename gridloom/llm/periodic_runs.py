"""Operator 11: maximal periodic runs of words, by Crochemore's partition refinement.

A run is a stretch of consecutive words with smallest period q, at least ``2 * q`` and ``least`` words long, that no
neighbouring word extends with period q. Level l puts positions with equal factors of l words in one class. From one level to the
next a class is split by where the successors of its positions went, but only by the classes that are not the largest part of
what they were split from (smaller half), so that a position is looked at O(log n) times. Neighbours in a class at distance l on
level l are a square of l words whose root is no power; squares at adjacent positions are merged into a run.

Many texts are refined together, each with an end mark of its own, so that a level costs a few array operations on what moves in
any of them. A level above half of a text's words has no squares, and the text takes no part in it. Nothing is shuffled: a text
is one row, a task holds ``TOGETHER`` words at once, or one longer text.

Edge cases: a null or empty text has no words and no runs; a null id is kept (and gives no damage in ``periodic_tails``); repeated
rows are rows of their own; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run at least.
LEAST = 12
#: Words refined together.
TOGETHER = 1 << 19
#: Small classes up to which a level goes one position at a time.
FEW = 32
RUN = "struct<start: long, length: long, period: long>"


class Classes:
    """Positions of words in classes of equal factors, whose length grows by one with each ``refine``.

    A class is a stretch of ``order`` (in any order) and a chain of positions in ascending order (``after``, ``before``).
    """

    def __init__(self, symbols: np.ndarray, half: np.ndarray):
        """``symbols``: numbers from 0, all used, texts apart; ``half``: of each position the longest root of a square in its text."""
        n = len(symbols)
        self.level, self.half, self.of = 1, half, symbols.astype(np.int64)
        self.order = np.argsort(self.of, kind="stable")
        self.slot = np.empty(n, np.int64)
        self.slot[self.order] = np.arange(n)
        self.size, self.start = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)  # a split without rest leaves a number unused
        counts = np.bincount(self.of)
        self.known = len(counts)
        self.size[: self.known], self.start[: self.known] = counts, np.cumsum(counts) - counts
        self.after, self.before = np.full(n, -1), np.full(n, -1)
        near = self.of[self.order[1:]] == self.of[self.order[:-1]]
        self.after[self.order[:-1][near]], self.before[self.order[1:][near]] = self.order[1:][near], self.order[:-1][near]
        self.moved = np.zeros(n, bool)
        self.views = [memoryview(x) for x in (self.of, self.order, self.slot, self.size, self.start, self.after, self.before, half)]
        self.small = np.arange(self.known)
        #: Positions by the distance to their next neighbour, once few change (``None``: many do, and all are looked at).
        self.waiting: dict[int, list[np.ndarray]] | None = None

    def squares(self) -> np.ndarray:
        """Ascending positions where a square with a root of ``level`` words begins."""
        if self.waiting is None:
            at = np.flatnonzero(self.after - np.arange(len(self.after)) == self.level)
        elif self.level in self.waiting:
            at = np.unique(np.concatenate(self.waiting.pop(self.level)))
            at = at[self.after[at] - at == self.level]
        else:
            return np.empty(0, np.int64)
        return at[self.half[at] >= self.level]

    def wait(self, at: np.ndarray) -> None:
        """Keep positions whose next neighbour is new until their distance is the level."""
        distance = self.after[at] - at
        later = (self.after[at] >= 0) & (distance >= self.level) & (distance <= self.half[at])
        at, distance = at[later], distance[later]
        if len(at) < 8:
            for p, d in zip(at.tolist(), distance.tolist(), strict=True):
                self.waiting[d].append(np.array([p]))
        else:
            by = np.argsort(distance, kind="stable")
            at, distance = at[by], distance[by]
            for part in np.split(at, np.flatnonzero(np.diff(distance)) + 1):
                self.waiting[int(self.after[part[0]] - part[0])].append(part)

    def movers(self) -> np.ndarray:
        """Ascending within each class, class by class: positions before those of the small classes, where a split is possible."""
        n = self.size[self.small]
        at = np.repeat(self.start[self.small] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ahead = self.order[at] - 1
        ahead = ahead[ahead >= 0]
        ahead = ahead[(self.half[ahead] > self.level) & (self.size[self.of[ahead]] > 1)]
        key = self.of[ahead] * len(self.of) + ahead
        key.sort()
        return key % len(self.of)

    def grouped(self, move: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of movers class by class: their classes, of each mover its class's rank among them, an order by where their successors
        went within a class, where a part begins in it, and of each class how many move and how many stay."""
        own, child = self.of[move], self.of[move + 1]
        first = np.concatenate([[True], own[1:] != own[:-1]])
        heads, rank = np.flatnonzero(first), np.cumsum(first) - 1
        key = rank * self.known + child
        by = np.argsort(key, kind="stable")
        parts = np.concatenate([[True], np.diff(key[by]) != 0])
        count = np.diff(np.append(heads, len(move)))
        return own[heads], rank, by, parts, count, self.size[own[heads]] - count

    def refine(self) -> bool:
        """Go on to the next level; false if no class can split any more."""
        if self.waiting is not None and len(self.small) <= FEW and int(self.size[self.small].sum()) <= 2 * FEW:
            return self.refine_few()
        move = self.movers()
        if len(move):
            split = self.grouped(move)
            _, rank, _, parts, count, rest = split
            apart = (rest > 0) | (np.add.reduceat(parts.astype(np.int64), np.cumsum(count) - count) > 1)
            if not apart.all():  # whole classes that stay together
                move = move[apart[rank]]
                split = self.grouped(move) if len(move) else split
        self.level += 1
        if not len(move):
            self.small = np.empty(0, np.int64)
            return False
        self.split(move, *split)
        return True

    def refine_few(self) -> bool:
        """``refine`` one position at a time, where arrays of a few would cost more."""
        of, order, slot, size, start, after, before, half = self.views
        going: dict[int, dict[int, list[int]]] = {}
        for child in self.small.tolist():
            for k in range(start[child], start[child] + size[child]):
                p = order[k] - 1
                if p >= 0 and half[p] > self.level and size[of[p]] > 1:
                    going.setdefault(of[p], {}).setdefault(child, []).append(p)
        self.level += 1
        small = []
        for own, parts in going.items():
            rest = size[own] - sum(map(len, parts.values()))
            if not rest and len(parts) == 1:
                continue
            sizes, touched = [], []
            for part in sorted(parts.values(), key=min):
                part.sort()
                for p in part:
                    x, y = before[p], after[p]
                    if x >= 0:
                        after[x] = y
                        touched.append(x)
                    if y >= 0:
                        before[y] = x
                    size[own] -= 1
                    end = start[own] + size[own]
                    other, k = order[end], slot[p]
                    order[k], slot[other], order[end], slot[p] = other, k, p, end
                name = self.known
                self.known += 1
                for p, q in zip(part, [*part[1:], -1], strict=True):
                    of[p], after[p] = name, q
                    if q >= 0:
                        before[q] = p
                before[part[0]] = -1
                start[name], size[name] = start[own] + size[own], len(part)
                sizes.append((len(part), name))
                touched += part
            if rest:
                sizes.append((rest, own))
            largest = max(sizes, key=lambda x: x[0])
            small += [name for x in sizes if x is not largest for name in x[1:]]
            for p in touched:
                d = after[p] - p
                if after[p] >= 0 and self.level <= d <= half[p]:
                    self.waiting[d].append(np.array([p]))
        self.small = np.array(small, np.int64)
        return bool(small)

    def split(self, move: np.ndarray, classes: np.ndarray, rank: np.ndarray, by: np.ndarray, parts: np.ndarray, count: np.ndarray, rest: np.ndarray) -> None:
        """Take ``move`` (of ``classes``, by ``rank``) out, as new classes at ``parts`` of the order ``by``."""
        self.moved[move] = True
        ahead, behind = self.before[move], self.after[move]
        left = ahead[(ahead < 0) | ~self.moved[ahead]]  # runs of movers in a chain begin and end in the same order
        right = behind[(behind < 0) | ~self.moved[behind]]
        self.after[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        # Movers take the end of their class's stretch of ``order``; those that stay and stood there take the movers' places.
        begin = self.start[classes] + rest
        tail = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(move))
        stood = self.order[tail]
        stood = stood[~self.moved[stood]]
        free = self.slot[move]
        free = free[free < begin[rank]]
        self.order[free], self.slot[stood] = stood, free
        sorted_ = move[by]
        self.order[tail], self.slot[sorted_] = sorted_, tail
        self.moved[move] = False
        # New numbers; where nothing stays, the first part keeps the old one.
        ends = np.flatnonzero(parts)
        sizes = np.diff(np.append(ends, len(move)))
        of_class = rank[by][ends]
        keeps = np.concatenate([[True], of_class[1:] != of_class[:-1]])
        lead = np.flatnonzero(keeps)
        keeps &= rest[of_class] == 0
        names = np.where(keeps, classes[of_class], self.known + np.cumsum(~keeps) - 1)
        self.known += int((~keeps).sum())
        self.size[classes] = rest
        self.start[names], self.size[names] = tail[ends], sizes
        self.of[sorted_] = np.repeat(names, sizes)
        near = ~parts[1:]
        self.after[sorted_], self.before[sorted_] = -1, -1
        self.after[sorted_[:-1][near]], self.before[sorted_[1:][near]] = sorted_[1:][near], sorted_[:-1][near]
        # All but a largest part of every class are small.
        largest = np.maximum.reduceat(sizes, lead)
        whole = np.where(rest >= largest, -1, largest)[of_class]
        top = sizes == whole
        top &= np.cumsum(top) - 1 == (np.cumsum(top) - top)[lead][of_class]  # one of equal ones
        self.small = np.concatenate([names[~top], classes[(rest < largest) & (rest > 0)]])
        if self.waiting is not None:
            self.wait(np.concatenate([left[left >= 0], sorted_]))
        elif len(move) * 64 < len(self.of):
            self.waiting = defaultdict(list)
            self.wait(np.flatnonzero(self.after >= 0))


def runs_of(symbols: np.ndarray, half: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of all texts in ``symbols``."""
    classes, found = Classes(symbols, half), [np.empty((0, 3), np.int64)]
    while True:
        at, q = classes.squares(), classes.level
        if len(at):
            cuts = np.flatnonzero(np.diff(at) != 1)
            first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
            length = last - first + 2 * q
            long = length >= least
            found.append(np.stack([first[long], length[long], np.full(int(long.sum()), q)], axis=1))
        if not classes.refine():
            break
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def together(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Of each text's words the runs, as ``runs_of``."""
    symbols: list[int] = []
    known = 0
    begins, half = [], []
    for words in texts:
        names: dict[bytes, int] = {}
        begins.append(len(symbols))
        symbols += [known + names.setdefault(w, len(names)) for w in words]
        known += len(names) + 1
        symbols.append(known - 1)
        half.append(np.full(len(words) + 1, len(words) // 2))
    if not symbols:
        return []
    runs = runs_of(np.array(symbols), np.concatenate(half), least)
    bounds = np.searchsorted(runs[:, 0], [*begins, len(symbols)])
    return [runs[x:y] - [b, 0, 0] for x, y, b in zip(bounds, bounds[1:], begins, strict=False)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def find_runs(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): runs by start, then period; collapsed is the kept words, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, k = batch.column(0), batch.column(1), 0
            while k < batch.num_rows:
                own, held, begun = [], 0, k
                while k < batch.num_rows and (held == 0 or held < TOGETHER):
                    own.append((texts[k].as_py() or b"").split())  # ASCII blanks and control blanks, as in the contract
                    held += len(own[-1]) + 1
                    k += 1
                runs = together(own, least)
                offsets = np.cumsum([0, *map(len, runs)])
                flat = np.concatenate(runs)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
                kept = pa.array([b" ".join(collapsed(w, r)) for w, r in zip(own, runs, strict=True)], pa.binary())
                yield pa.record_batch([ids.slice(begun, k - begun), lists, kept.cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row a text: how many runs, the longest one (ties: first start, then shortest period), digests of all and of the kept words."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("_best.l")
    return rows.select(
        "doc_id", "n_runs", F.col("_best.s").alias("start"), length.alias("length"), F.col("_best.p").alias("period"),
        F.floor(length * 1000 / F.col("_best.p")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def periodic_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): in every tenth text, by crc32 of its id, the words from some place on repeat with some period."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (F.col("_g") % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    changed = F.transform(F.array(_words(F.col("_text"))), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), g.alias("_g"), (h % 10 == 0).alias("_hit"))
    return rows.select(F.col("_id").alias("doc_id"), F.when(F.col("_hit"), changed).otherwise(F.col("_text")).alias("text"))
