"""The pipeline's near copies are candidates by SimHash: votes, shards and trees of fingerprints with several words."""

import numpy as np
import pytest
from gridloom.llm import near_copies, simhash


def test_votes():
    """The first word is SimHash of the shingles' XXH64, as of the operator with its own width; ties of small sets go either way."""
    text = " ".join(f"w{i}" for i in range(9001))
    own = near_copies.shingles(text, simhash.WIDTH)
    counted = near_copies.votes(own)
    assert len(own) == 8999 and int(near_copies.fingerprints(counted[None])[0, 0]) == simhash.fingerprint(text)
    assert abs(counted).max() < near_copies.TIE * 6 * 8999**0.5 and not near_copies.votes(own[:0]).any()
    for n in range(1, 9):
        sets = [near_copies.shingles(" ".join(f"{k}-{i}" for i in range(n + 4))) for k in range(400)]
        counted = np.array([near_copies.votes(s) for s in sets])
        assert {len(s) for s in sets} == {n} and abs((counted > 0).mean() - 0.5) < 0.015


def test_trees_of_several_words():
    """Runs with equal, close and distant fingerprints against all pairs."""
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 64, (40, near_copies.WORDS), np.uint64)[rng.integers(0, 40, 2500)]
    for _ in range(60):
        rows = np.flatnonzero(rng.random(2500) < 0.5)
        fps[rows, rng.integers(0, near_copies.WORDS, len(rows))] ^= np.uint64(1) << rng.integers(0, 64, len(rows)).astype(np.uint64)
    fps[2000:2300] = fps[:300]
    runs = np.sort(rng.integers(0, 20, 2500))
    close = np.bitwise_count(fps[:, None] ^ fps).sum(axis=2) <= 50
    wanted = simhash.unite(np.arange(2500), *np.nonzero(close & (runs[:, None] == runs)))
    got = np.arange(2500)
    for a, b in simhash.BKTrees(fps, runs).links(50):
        got = simhash.unite(got, a, b)
    assert (got == wanted).all() and 100 < len(set(got.tolist())) < 2400


@pytest.mark.parametrize(("both", "left", "right"), [(4, 0, 1), (40, 5, 5), (40, 0, 10), (400, 50, 50)])
def test_pairs_at_the_similarity(spark, both, left, right):
    """500 pairs of texts at 0.8 are linked, and texts of different pairs are not."""
    texts = []
    for k in range(500):
        words = [f"{k}-{i}" for i in range(both + 4)]
        texts += [(2 * k, " ".join([f"{k}a{i}" for i in range(left)] + words)), (2 * k + 1, " ".join(words + [f"{k}b{i}" for i in range(right)]))]
    a, b = (set(near_copies.shingles(t).tolist()) for _, t in texts[:2])
    assert 5 * len(a & b) == 4 * len(a | b)
    hashed = near_copies.sketches(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", 5)
    of = {r.klass: r.doc_id // 2 for r in hashed.collect()}
    found = {(of[r.u], of[r.v]) for r in near_copies.candidates(hashed).collect()}
    assert found == {(k, k) for k in range(500)}
