"""Many close fingerprints in one shard."""

import numpy as np
from gridloom.llm import simhash


def test_dense_shard(spark):
    """20,000 fingerprints that agree in 38 bits, dense ones among them, against all pairs in blocks."""
    rng = np.random.default_rng(11)
    low = np.unique(np.concatenate([rng.integers(0, 1 << 26, 14_000, np.uint64), rng.integers(0, 1 << 17, 6_500, np.uint64) << np.uint64(9)]))
    low = rng.permutation(low)[:20_000]
    fps = low | np.uint64(0xA5C3_91F0_0000_0000 >> 26 << 26)
    labels = np.arange(len(fps))
    for at in range(0, len(fps), 1000):
        a, b = np.nonzero(np.bitwise_count(fps[at : at + 1000, None] ^ fps) <= 2)
        labels = simhash.unite(labels, a + at, b)
    frame = spark.createDataFrame([(i, f) for i, f in enumerate(fps.astype(np.int64).tolist())], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.group(frame).collect()}
    assert got == dict(enumerate(labels.tolist())) and len(set(got.values())) < len(fps) * 0.9
