"""Operator 5: best-fit packing of tokenised documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` ids; only longer documents are cut, from their end, so that the
first piece may be shorter. Pieces over half the capacity open a sequence each. All others are placed in
bulk-synchronous rounds over pieces without a place and gaps of open sequences:

* Both are in order of size, and rows of one size in order of rank: pieces are ranked once, in two levels (salted
  groups, then sums of group counts), so that no size is one task's. A sweep upwards lets every gap take the largest
  piece below it that no smaller gap has taken, as brackets close. Rows of one size differ in rank alone, so a sweep is
  settled for runs of ranks: gaps of a room, from one rank to another, take pieces of a size, from one rank to another.
* Gaps are a table. Its tasks find the run of each gap by room and rank, which gives the piece it takes, its new room and
  its rank among gaps of that room: conflicts are settled by rank, each gap takes one piece a round, nothing is shuffled.
* One pass over the table carries its gaps through as many rounds as ``RUNS`` runs allow; the counts of rooms for the
  next pass come from the table. When no gap has room, as many sequences open as the pieces left need at least, and it
  goes on; gaps from before are at an end, since the smallest piece left only grows.
* At last pieces meet their places by size and rank, in a join.

Runs and counts have at most two rows of a size, whatever the number of documents; only they come to the driver.

Edge cases: a null or empty text is a document of its end id alone; repeated rows are separate documents; null ids
pack like others; ties in length go by salt, id and contents; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.storage import cut, even, partitions
from gridloom.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and ``ids`` (packed integers) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer, False)
        end, dtype = int(end_id).to_bytes(to_ids.width, "little"), np.dtype(f"<u{to_ids.width}")
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = []
                part = batch.slice(at, 1024)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.frombuffer(to_ids.encode(text.as_py()) + end, dtype)
                    for k, (start, n) in enumerate(pieces_of(len(ids), capacity)):
                        own = ids[start : start + n]
                        rows.append((doc_id, k, start, n, zlib.crc32(own.astype("<u4"))) + ((own.tobytes(),) if with_ids else ()))
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """What best-fit decreasing, one piece at a time, comes to, found from the counts of lengths: a measure to hold the
    rounds against, not used by them. Rows (length, rank from, rank to, first sequence, pieces for each
    sequence, offset of the first of them).

    Gaps are ranges of sequences with the same remaining room, kept sorted by room. A sweep uses up each range it
    takes but the last, which it splits in at most three; a range is swept once for each length that it receives,
    and lengths in a sequence are distinct between sweeps, so a sequence sees at most sqrt(2 * capacity) sweeps.
    The number of rows is thus at most about 3 * capacity * sqrt(2 * capacity), whatever the input.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # room, first sequence, number of sequences
    made = 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        put_back = []
        at = bisect_left(gaps, (length, -1, -1))
        taken = at
        while rank < n and taken < len(gaps):
            room, first, size = gaps[taken]
            taken += 1
            each = room // length
            full, over = divmod(min(n - rank, each * size), each)
            if full:
                rows.append((length, rank, rank + full * each, first, each, capacity - room))
                put_back.append((room - each * length, first, full))
            if over:
                rows.append((length, rank + full * each, rank + full * each + over, first + full, each, capacity - room))
                put_back.append((room - over * length, first + full, 1))
            if (left := size - full - bool(over)) > 0:
                put_back.append((room, first + full + bool(over), left))
            rank += full * each + over
        del gaps[at:taken]
        if rank < n:  # no gap has room: new sequences
            each = capacity // length
            full, over = divmod(n - rank, each)
            if full:
                rows.append((length, rank, rank + full * each, made, each, 0))
                put_back.append((capacity - each * length, made, full))
            if over:
                rows.append((length, rank + full * each, n, made + full, each, 0))
                put_back.append((capacity - over * length, made + full, 1))
            made += full + bool(over)
        for gap in put_back:
            if gap[0]:
                insort(gaps, gap)
    return rows


#: Rows of a table of pieces or gaps for each task.
TASK_ROWS = 100_000


def ranked(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows`` (kind, id, size, ...) with ``rank``, from 0 and without gaps among those of the same kind and size.

    Rows are dealt by (kind, size, salt), with a salt for each of ``tasks``; a group's offset is the sum of the groups
    before it, from a table of counts.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(tasks)).cast("int"))
    local = salted.withColumn("local", F.row_number().over(W.partitionBy("kind", "size", "salt").orderBy("id")) - 1)
    counts = salted.groupBy("kind", "size", "salt").agg(F.count(F.lit(1)).alias("n")).coalesce(tasks)
    before = W.partitionBy("kind", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("kind", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).coalesce(tasks)
    return local.join(offsets, ["kind", "size", "salt"]).withColumn("rank", F.col("before") + F.col("local")).drop("salt", "local", "before")


#: Rows of the rounds' table: pieces without a place (their key and length), gaps (their sequence and room), and places.
PIECE, GAP, PLACE = 0, 1, 2
#: Runs of ranks that one pass over the gaps takes along, 40 bytes each.
RUNS = 200_000
CARRIED = "kind int, sequence long, size int, rank long, offset long"
#: A room and a rank as one number.
RANKS = 1 << 48

#: Of a round, by ascending (room, rank): room * RANKS + first rank, size taken (0: none), rank of the first piece taken,
#: room afterwards, rank of the first gap among those of that room.
Round = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def matches(pieces: dict[int, int], rooms: dict[int, int]) -> tuple[Round, dict[int, int], dict[int, int]]:
    """One sweep over counts by size: its runs, and the counts of pieces and rooms afterwards. Pieces go from the highest rank."""
    left, after, runs = dict(pieces), defaultdict(int), []
    stack: list[int] = []
    for size in sorted(pieces.keys() | rooms.keys()):
        if left.get(size):
            stack.append(size)
        at, n = 0, rooms.get(size, 0)
        while at < n:
            taken = stack[-1] if stack else 0
            k = min(n - at, left[taken]) if taken else n - at
            if taken:
                left[taken] -= k
                if not left[taken]:
                    stack.pop()
            runs.append((size * RANKS + at, taken, left.get(taken, 0), size - taken, after[size - taken]))
            after[size - taken] += k
            at += k
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    return tuple(columns), {size: n for size, n in left.items() if n}, dict(after)


def carry(gaps: DataFrame, rounds: list[Round], capacity: int) -> DataFrame:
    """``CARRIED`` rows of ``gaps`` (sequence, room, rank) after ``rounds``: places with size and rank of the piece, and the gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, room, rank = (np.asarray(c).astype(np.int64) for c in batch.columns)
            parts = []
            for starts, taken, first, becomes, base in rounds:
                key = room * RANKS + rank
                found = np.searchsorted(starts, key, side="right") - 1
                within, took = key - starts[found], taken[found]
                on = took > 0
                parts.append((np.full(on.sum(), PLACE), sequence[on], took[on], (first[found] + within)[on], capacity - room[on]))
                room, rank = becomes[found], base[found] + within
            parts.append((np.full(len(room), GAP), sequence, room, rank, capacity - room))
            columns = (np.concatenate(c) for c in zip(*parts, strict=True))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "sequence", "size", "rank", "offset"])

    return gaps.select("sequence", "room", "rank").mapInArrow(run, CARRIED)


def sizes(rows: DataFrame, size: str) -> dict[int, int]:
    """How many rows have each size: at most ``capacity`` numbers."""
    return {r[0]: r[1] for r in rows.groupBy(size).agg(F.count(F.lit(1))).collect()}


def sweep(rows: DataFrame, capacity: int, tasks: int = 1) -> DataFrame:
    """One round over ``rows`` (kind, id, size) of pieces and gaps: (kind, id, size, sequence, offset), where places have
    the id of their piece, and gaps and pieces are what is left."""
    order = ranked(rows, tasks)
    pieces, gaps = order.where(F.col("kind") == PIECE), order.where(F.col("kind") == GAP)
    own, left, _ = matches(sizes(pieces, "size"), sizes(gaps, "size"))
    carried = carry(gaps.withColumnsRenamed({"id": "sequence", "size": "room"}), [own], capacity)
    placed = pieces.select("id", "size", "rank").join(carried.where(F.col("kind") == PLACE), ["size", "rank"], "left")
    kind = F.when(F.col("sequence").isNull(), PIECE).otherwise(PLACE)
    nothing = F.lit(None).cast("long")
    return placed.select(kind.alias("kind"), "id", "size", "sequence", "offset").unionAll(
        carried.where(F.col("kind") == GAP).select("kind", F.col("sequence").alias("id"), "size", nothing, nothing)
    )


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = cut(even(pieces)).withColumn("_key", F.monotonically_increasing_id())  # rows stay as they were cut
    keys = pieces.select(F.lit(PIECE).alias("kind"), F.col("_key").alias("id"), F.col("length").cast("int").alias("size"))
    salts = max(partitions(spark), 1 + keys.count() // TASK_ROWS)
    order = cut(ranked(keys, salts).select(F.col("id").alias("_key"), "size", "rank"))
    left = sizes(order, "size")
    alone = order.where(F.col("size") * 2 > capacity)
    gaps = alone.select(F.col("_key").alias("sequence"), (capacity - F.col("size")).alias("room"), "rank")  # of a room as of a size
    rooms = {capacity - size: left.pop(size) for size in list(left) if size * 2 > capacity}
    placed = [alone.select("size", "rank", F.col("_key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    made = 0
    while left:
        if max(rooms, default=0) < min(left):
            n = -(-sum(size * n for size, n in left.items()) // capacity)
            gaps = spark.range(n, numPartitions=1 + n // TASK_ROWS).select((-F.col("id") - 1 - made).alias("sequence"), F.lit(capacity).alias("room"), F.col("id").alias("rank"))
            made, rooms = made + n, {capacity: n}
        least = min(left)
        gaps, rooms = gaps.where(F.col("room") >= least), {room: n for room, n in rooms.items() if room >= least}
        rounds: list[Round] = []
        while left and max(rooms) >= min(left) and sum(len(r[0]) for r in rounds) < RUNS:
            own, left, rooms = matches(left, rooms)
            rounds.append(own)
        state = cut(carry(gaps, rounds, capacity))
        placed.append(state.where(F.col("kind") == PLACE).select("size", "rank", F.col("sequence").alias("sequence_id"), "offset"))
        gaps = state.where(F.col("kind") == GAP).select("sequence", F.col("size").alias("room"), "rank")
        rooms = sizes(gaps, "room")
    places = order.join(reduce(DataFrame.unionAll, placed), ["size", "rank"]).select("_key", "sequence_id", "offset")
    return pieces.join(places, "_key").select(*columns, "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, **columns) -> DataFrame:
    """Tokenise and place; one row for each piece."""
    return place(tokenise(df, tokenizer, end_id, capacity, **columns), capacity)


def assemble(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids, doc_starts: the packed sequences themselves, from placed pieces that have ``ids``.
    A group is one sequence, at most its capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit(b""), lambda out, p: F.concat(out, p["ids"])).alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("doc_starts"),
    )
