"""The rounds of best-fit packing against best-fit decreasing, one sweep against a stack, and many tiny pieces."""

import numpy as np
import pytest
from gridloom.llm import best_fit_packing as packing


def pieces_frame(spark, lengths):
    rows = [(k % 50, 0, 0, int(n), k % 3) for k, n in enumerate(lengths)]  # repeated rows too
    return spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


@pytest.mark.parametrize("kind", ["mixed", "one length", "tiny", "halves"])
def test_rounds(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": np.minimum(256, rng.lognormal(4, 1, 1500).astype(int) + 1), "one length": np.full(900, 100),
        "tiny": rng.integers(1, 9, 3000), "halves": rng.integers(120, 137, 600),
    }[kind]
    rows = packing.place(pieces_frame(spark, lengths), 256).collect()
    assert sorted(r.length for r in rows) == sorted(lengths.tolist())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 256
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 256)
    best = len({first + k // each for _, low, high, first, each, _ in plan for k in range(high - low)})
    assert best <= len(by) <= best * 1.01 + 1


def test_sweep_is_a_stack(spark):
    """Every gap takes the largest piece left below it, from the smallest gap up."""
    rng = np.random.default_rng(4)
    pieces, gaps = rng.integers(1, 40, 150).tolist(), rng.integers(1, 60, 90).tolist()
    rows = [(packing.PIECE, k, n) for k, n in enumerate(pieces)] + [(packing.GAP, 1000 + k, n) for k, n in enumerate(gaps)]
    out = packing.sweep(spark.createDataFrame(rows, "kind int, id long, size int"), 100).collect()
    stack, wanted = [], []
    for size, kind in sorted([(n, 0) for n in pieces] + [(n, 1) for n in gaps]):
        if kind == 0:
            stack.append(size)
        elif stack:
            wanted.append((size, stack.pop()))
    placed = [r for r in out if r.kind == packing.PLACE]
    assert sorted((gaps[r.sequence - 1000], r["size"]) for r in placed) == sorted(wanted) and all(r.offset == 100 - gaps[r.sequence - 1000] for r in placed)
    assert sorted(r["size"] for r in out if r.kind == packing.PIECE) == sorted(stack)
    took = {r.sequence: r["size"] for r in placed}
    assert {r.id: r["size"] for r in out if r.kind == packing.GAP} == {1000 + k: n - took.get(1000 + k, 0) for k, n in enumerate(gaps)}
