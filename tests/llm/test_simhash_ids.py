"""Ids that are large, shared or missing don't change what is one group."""

from gridloom.llm import simhash

SOME = "one two three four five"
OTHER = "alpha beta gamma delta epsilon zeta"
THIRD = "red green blue yellow black white grey"


def test_large_ids(spark):
    rows = [(1 << 61, SOME), ((1 << 62) + 5, SOME), ((1 << 63) - 1, OTHER)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()} == {1 << 61: 1 << 61, (1 << 62) + 5: 1 << 61, (1 << 63) - 1: (1 << 63) - 1}
    assert sorted(r.doc_id for r in simhash.dedup(frame).collect()) == [1 << 61, (1 << 63) - 1]


def test_shared_ids(spark):
    rows = [(1, SOME), (1, OTHER), (2, OTHER), (3, THIRD), (None, SOME), (None, "solo")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = [(1, SOME), (1, OTHER), (3, THIRD), (None, SOME), (None, "solo")]
    assert sorted(map(str, map(tuple, simhash.dedup(frame).collect()))) == sorted(map(str, wanted))
    # Texts that share an id are no neighbours by that: both groups of id 1 are named 1, but dedup kept one row of each.
    assert {r.component_id for r in simhash.near_duplicates(frame).collect() if r.doc_id == 2} == {1}
