"""Digests recovered from two versions of a document, with their side."""

import numpy as np
from gridloom.llm import iblt_fingerprints as iblt


def test_versions(spark):
    long = [f"Sentence number {k}." for k in range(300)]
    pairs = [("One. Two. Three.", "One. 2. Three."), ("same. same.", "same. same."), (None, "new."), ("", None), (" ".join(long), " ".join(long[50:] + ["More."])), ("a. b.", "c. d. e.")]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "doc_id long, old string, new string")
    got = {r.doc_id: (set(r.removed), set(r.added)) for r in iblt.versions(frame).collect()}
    for k, (a, b) in enumerate(pairs):
        old, new = (set(iblt.digests(t or "").astype(np.int64).tolist()) for t in (a, b))
        assert got[k] == (old - new, new - old)
    assert iblt.versions(frame.where("doc_id < 0")).count() == 0
