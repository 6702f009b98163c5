"""Operator 13: repair of conversations whose turns are out of order, by rank-compressed dynamic programming.

A repaired conversation's role initials are ``(s?(ua)+)?``. Rows are kept (0), get another role (1) or are deleted (2; blank and
repeated ones must be), empty rows are inserted (5), and a cut-off row that is not deleted adds 5. Of the cheapest edits those
whose initials (D, I, K, R) come first are taken.

A run of inserts and the row's own edit behind it are one macro edit. Their codes, ``D``, ``ID``, ``IK`` and so on, are free of
prefixes, so that audits of the same rows compare like their sequences of codes. A layer of the dynamic programme (a row) therefore
holds, for each state of the automaton, only its cost, the rank of its audit among the layer's, and a pointer to its parent; the
next layer's ranks follow from the parent's rank and the code. Audits are read off the pointers afterwards. Layers that differ by
a constant cost are the same, so that few are ever computed.

Conversations of any length are spread: rows are dealt in ranges of (conversation, turn, role) and cut into sections of at most
``SECTION`` rows. A section gives costs and ranks from each state to each (the same programme, begun in each state), a
conversation's sections are then composed in order with the same rule, and each section reads off its own audit. Only the digest
of a repaired text is taken row by row in one task, as SHA-256 allows no other way; the task streams and holds no texts.

Edge cases: null roles and texts are one blank; a row with another initial, or an empty role, can't be kept; rows without a turn come first; rows that share a turn go by role, then text; a
null conv_id is a conversation; repeated rows are duplicates; conversations of ``every`` without rows are empty ones; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import partitions, stage

SECTION = 4096
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: An empty conversation, then one that ends in a system, user or assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The state behind a row by its initial.
NEXT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state behind a row that takes the role which is due.
DUE = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Codes in order. More than two inserts in a row come back to where one or two lead.
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
INITIALS, FINE, TRUNCATED, BLANK, DUPLICATE = "sua ", 0, 1, 2, 3
#: Stands for no row, so that its conversation is known.
NOTHING = 16
LEGAL = {"su", "ua", "au"}
Layer = tuple[tuple[int, int] | None, ...]


def begun(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


def edited(state: int, code: str, initial: str, fault: int) -> tuple[int, int] | None:
    """State and cost behind a macro edit of a row, if it may be taken."""
    for _ in code[:-1]:
        state = DUE[state]
    cost = INSERT * (len(code) - 1)
    if code[-1] == "D":
        return state, cost + DELETE
    if fault in (BLANK, DUPLICATE):
        return None
    cost += CUT_OFF * (fault == TRUNCATED)
    if code[-1] == "R":
        return DUE[state], cost + REROLE
    after = NEXT.get(initial, {}).get(state)
    return None if after is None else (after, cost + KEEP)


@lru_cache(maxsize=1 << 16)
def following(layer: Layer, kind: int) -> tuple[Layer, int, tuple[tuple[int, int] | None, ...]]:
    """The next layer with a least cost of 0, what was taken off, and of each state its parent and the code's place."""
    if kind == NOTHING:
        return layer, 0, ()
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for s, held in enumerate(layer):
        for place, code in enumerate(CODES if held else ()):
            if reached := edited(s, code, INITIALS[kind % 4], kind // 4):
                t, cost = reached
                one = (held[0] + cost, held[1], place, s)
                best[t] = min(best[t] or one, one)
    order = sorted(b[1:3] for b in best if b)
    least = min(b[0] for b in best if b)
    return tuple(b and (b[0] - least, order.index(b[1:3])) for b in best), least, tuple(b and (b[3], b[2]) for b in best)


def through(kinds: bytes, start: int) -> tuple[Layer, int]:
    """The last layer of a section that is begun in ``start``, and the cost to add to it."""
    layer, cost = begun(start), 0
    for kind in kinds:
        layer, more, _ = following(layer, kind)
        cost += more
    return layer, cost


def read_off(kinds: bytes, start: int, end: int) -> list[str]:
    """Codes of a section's rows (of no row: an empty one)."""
    layer, steps, codes = begun(start), [], []
    for kind in kinds:
        layer, _, parents = following(layer, kind)
        steps.append(parents)
    for parents in reversed(steps):
        if parents:
            end, place = parents[end]
        codes.append(CODES[place] if parents else "")
    return codes[::-1]


def compose(sections: list[list[tuple[int, int] | None]]) -> tuple[int, list[int], int]:
    """Of a conversation's sections (16 costs and ranks, by start and end): the least cost, the state before each section and
    after the last one, and how many rows are inserted at the end."""
    layer, parents = begun(EMPTY), []
    for table in sections:
        best: list[tuple[int, int, int, int] | None] = [None] * 4
        for s, held in enumerate(layer):
            for t in STATES if held else ():
                if leg := table[4 * s + t]:
                    one = (held[0] + leg[0], held[1], leg[1], s)
                    best[t] = min(best[t] or one, one)
        order = sorted(b[1:3] for b in best if b)
        layer = tuple(b and (b[0], order.index(b[1:3])) for b in best)
        parents.append([b and b[3] for b in best])
    ends = []
    for s, held in enumerate(layer):
        state = s
        for n in range(3 if held else 0):
            if state in (EMPTY, ASSISTANT):
                ends.append((held[0] + INSERT * n, held[1], n, s))
            state = DUE[state]
    cost, _, tail, end = min(ends)
    states = [end]
    for step in reversed(parents):
        states.append(step[states[-1]])
    return cost, states[::-1], tail


def damage(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (conv_id, turn, role, text) with faults, chosen by crc32 of ``conv_id:turn``."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text, fault = F.coalesce("text", blank), F.col("_fault")
    rows = df.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_fault")).where("_fault <> 0")
    changed = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))).drop("col")


def _first_fault(text: Column) -> Column:
    shown = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)


def in_order(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(conv_id, part, seq, k, turn, role, text, kind): rows by conversation and turn, in sections (part, seq), with their faults."""
    blank = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), _first_fault(F.col("text")).alias("fault"))
    # The first row with some role and text; only those that come again are joined.
    again = rows.groupBy("conv_id", "role", "h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("h").alias("_h"), F.col("c").alias("_c"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c"))
    later = F.coalesce(F.struct(F.col("turn").isNotNull().alias("some"), "turn") > F.col("first"), F.lit(False))
    rows = rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "h", "fault", later.alias("later"))
    if every is not None:
        known = every.select(F.col("conv_id").cast("long")).distinct()
        rows = rows.unionByName(known.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("h"), F.lit(-1).alias("fault"), F.lit(False).alias("later")))
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, k = TaskContext.get().partitionId(), 0, 0
        before: tuple | None = None
        for batch in batches:
            seqs, ks, kinds = [], [], []
            for conv, turn, role, h, fault, later in zip(*(batch.column(x).to_pylist() for x in (0, 1, 2, 4, 5, 6)), strict=True):
                if before is not None and (before[0] != conv or k == SECTION):
                    seq, k = seq + 1, 0
                own = (conv, turn, role, h, fault)
                if fault < 0:
                    kinds.append(NOTHING)
                else:
                    initial = INITIALS.find(role[:1]) if role[:1] else 3
                    if fault != BLANK and (later or own == before):
                        fault = DUPLICATE
                    kinds.append(4 * fault + (initial if initial >= 0 else 3))
                seqs.append(seq)
                ks.append(k)
                before, k = own, k + 1
            yield pa.record_batch(
                [batch.column(0), pa.array([part] * len(ks), pa.int32()), pa.array(seqs, pa.int64()), pa.array(ks, pa.int32()), *(batch.column(x) for x in (1, 2, 3)), pa.array(kinds, pa.int32())],
                names=["conv_id", "part", "seq", "k", "turn", "role", "text", "kind"],
            )

    return dealt.mapInArrow(run, "conv_id long, part int, seq long, k int, turn long, role string, text string, kind int")


def sections(ordered: DataFrame) -> DataFrame:
    """One row a section: its kinds in order, costs and ranks of its 16 pairs of states (cost -1: none), counts, and its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.select(["conv_id", "part", "seq", "rows"]).to_pylist():
                kinds = bytes(r["kind"] for r in row.pop("rows"))
                costs, ranks = [], []
                for s in STATES:
                    layer, cost = through(kinds, s)
                    costs += [held[0] + cost if held else -1 for held in layer]
                    ranks += [held[1] if held else -1 for held in layer]
                initials = "".join(INITIALS[k % 4] for k in kinds if k != NOTHING)
                illegal = sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))
                out.append({**row, "kinds": kinds, "costs": costs, "ranks": ranks, "illegal": illegal, "first": initials[:1], "last": initials[-1:]} | {n: sum(k // 4 == f for k in kinds) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))})
            yield pa.RecordBatch.from_pylist(out, schema)

    fields = {"conv_id": pa.int64(), "part": pa.int32(), "seq": pa.int64(), "kinds": pa.binary(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32())}
    schema = pa.schema([*fields.items(), *((n, pa.int64()) for n in ("illegal", "blank", "duplicate", "truncated")), ("first", pa.string()), ("last", pa.string())])
    rows = ordered.groupBy("conv_id", "part", "seq").agg(F.array_sort(F.collect_list(F.struct("k", "kind"))).alias("rows"))
    return rows.mapInArrow(run, "conv_id long, part int, seq long, kinds binary, costs array<long>, ranks array<int>, illegal long, blank long, duplicate long, truncated long, first string, last string")


def decided(cuts: DataFrame, gaps: DataFrame) -> DataFrame:
    """(conv_id, part, seq, start, codes, tail, counts...) of every section; counts are the conversation's."""
    counts = ("illegal", "blank", "duplicate", "truncated")

    def settle(held: list[tuple]) -> Iterator[tuple]:
        totals = [sum(h[5 + c] for h in held) for c in range(4)]
        ends = [(h[9], h[10]) for h in held if h[9]]
        totals[0] += sum(x[1] + y[0] not in LEGAL for x, y in zip(ends, ends[1:], strict=False))
        cost, states, tail = compose([[None if c < 0 else (c, r) for c, r in zip(h[3], h[4], strict=True)] for h in held])
        for n, h in enumerate(held):
            yield (*h[:3], states[n], states[n + 1], tail, cost, *totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sections come in order and whole conversations; a section is held by its 32 numbers."""
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    out += settle(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*settle(held), strict=True), schema.types, strict=True)], schema=schema)

    names = [("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("tail", pa.int32()), ("cost", pa.int64())]
    schema = pa.schema([*names, *((n, pa.int64()) for n in counts)])
    narrow = cuts.select("conv_id", "part", "seq", "costs", "ranks", *counts, "first", "last")
    composed = narrow.repartition(partitions(cuts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, "conv_id long, part int, seq long, start int, stop int, tail int, cost long, illegal long, blank long, duplicate long, truncated long")

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [",".join(read_off(*x)) for x in zip(*(batch.column(n).to_pylist() for n in ("kinds", "start", "stop")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(codes, pa.string())], names=[*batch.schema.names[:-1], "codes"])

    every = composed.join(cuts.select("part", "seq", "kinds"), ["part", "seq"]).join(gaps.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    every = every.select("conv_id", "part", "seq", "start", "stop", "tail", "cost", *counts, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "kinds")
    return every.mapInArrow(audits, every.drop("kinds").schema.simpleString()[7:-1] + ",codes:string")


def gaps_of(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): numbers missing between a conversation's first and last turn."""
    turns = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long")).where("turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    return turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plan(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Rows in order with, before each section's, a row (k = -1) that has its codes: what ``repaired`` and ``digest`` read."""
    ordered = stage(in_order(rows, every), "turns")
    marks = decided(stage(sections(ordered), "sections"), gaps_of(rows))
    both = ordered.where(F.col("kind") != NOTHING).select("conv_id", "part", "seq", "k", "role", "text").unionByName(marks.withColumn("k", F.lit(-1)).drop("start", "stop"), allowMissingColumns=True)
    return both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "seq", "k")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, dict | None, str, str, str]]:
    """(conv_id, whether it is its first, its totals if so, edit, role, text) of every edit, and one without an edit for each conversation."""
    conv, known, state, tail, codes = None, False, EMPTY, 0, iter(())
    ends = lambda: [(conv, False, None, "I", ROLE[s], "") for s in ([DUE[state], DUE[DUE[state]]][:tail] if known else [])]
    for batch in batches:
        for row in batch.to_pylist():
            if row["k"] < 0:
                if not known or row["conv_id"] != conv:
                    yield from ends()
                    conv, known, state, tail = row["conv_id"], True, EMPTY, row["tail"]
                    yield conv, True, row, "", "", ""
                codes = iter(c for c in row["codes"].split(",") if c)
                continue
            code = next(codes)
            for _ in code[:-1]:
                state = DUE[state]
                yield conv, False, None, "I", ROLE[state], ""
            if code[-1] != "D":
                state = DUE[state] if code[-1] == "R" else NEXT[row["role"][:1]][state]
            yield conv, False, None, code[-1], ROLE[state] if code[-1] == "R" else row["role"], row["text"]
    yield from ends()


def repaired(planned: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the rows of every repaired conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, size = 0, [], 0
        for conv, first, _, edit, role, text in _stream(batches):
            if first:
                place = 0
            elif edit != "D":
                out.append((conv, place, edit, role, text))
                place, size = place + 1, size + len(text)
            if len(out) >= 10_000 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return planned.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digest(planned: DataFrame) -> DataFrame:
    """One row a conversation: faults, the least cost, the audit, and a digest of the repaired ``role:text`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, audit, sha, lines = [], [], None, 0

        def close() -> None:
            if sha is not None:
                out[-1] |= {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        for conv, first, totals, edit, role, text in _stream(batches):
            if first:
                close()
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                out.append({"conv_id": conv} | {n: totals[n] for n in TOTALS})
                audit, sha, lines = [], hashlib.sha256(), 0
                continue
            audit.append(edit)
            if edit != "D":
                sha.update(("\n" * (lines > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                lines += 1
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in TOTALS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return planned.mapInArrow(run, "conv_id long, " + "".join(f"{n} long, " for n in TOTALS) + "audit string, repaired_sha256 string")


def repair(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """The digest of every conversation of ``rows`` and ``every``."""
    return digest(plan(rows, every))
