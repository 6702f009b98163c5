"""Stored fingerprints that give back differences, and ranges that close on each other."""

import numpy as np
from gridloom.llm import iblt_fingerprints as iblt


def test_stored_size():
    """The stated shares of 8, 24 and 32 differing digests come back from two stored fingerprints (3 deviations below them)."""
    rng = np.random.default_rng(2)
    for differ, least in ((8, 0.987), (24, 0.925), (32, 0.88)):
        right = 0
        for _ in range(300):
            keys = rng.integers(0, 1 << 63, 80 + differ, np.uint64)
            left, other = keys[: 80 + differ // 2], np.concatenate([keys[:80], keys[80 + differ // 2 :]])
            near = iblt.stored_likeness(*iblt.fingerprints([left, other]))
            right += near is not None
            assert near is None or abs(near - 80 / (80 + differ)) < 1e-12
        assert right >= least * 300, (differ, right)


def test_enlarged_and_exact_exit(monkeypatch):
    """Larger sketches where the stored ones fail, and sorted digests where none may be made."""
    rng = np.random.default_rng(5)
    left, right = ([rng.integers(0, 1 << 63, n, np.uint64) for n in sizes] for sizes in ((300, 40, 0), (280, 45, 500)))
    near, cells = iblt.compared(left, right)
    assert near.tolist() == [0, 0, 0] and (cells > iblt.CELLS).all()
    monkeypatch.setattr(iblt, "LAST", 0)
    near, cells = iblt.compared(left, right)
    assert near.tolist() == [0, 0, 0] and cells.tolist() == [0, 0, 0]


def test_ranges_close(spark):
    """Many small ranges, null and repeated ids: every row meets the one behind it."""
    rows = [(k // 3 * 7, f"text {k % 3} of {k // 3}. and more.") for k in range(300)] + [(None, "b. no id"), (None, "a. no id"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    wanted = [(i if known else None, len(t), len(iblt.edited(t, u))) for (known, i, t), (_, _, u) in zip(order, order[1:] + order[:1], strict=True)]
    got = iblt.successors(frame).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(((r.doc_id, r.n_chars) for r in got), key=key) == sorted(((i, n) for i, n, _ in wanted), key=key)
    import hashlib

    shas = sorted(hashlib.sha256(iblt.edited(t, u).encode()).hexdigest() for (_, _, t), (_, _, u) in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in got) == shas
