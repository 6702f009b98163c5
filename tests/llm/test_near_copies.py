"""The pipeline's near-duplicate stage against brute force and on planted near copies."""

import re
from itertools import combinations

import corpus_pipeline
from gridloom.llm import near_copies


def shingles(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_of(texts):
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if root[a] != root[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return root


def planted(*changes, n=80):
    words = [f"w{i}" for i in range(n)]
    for at in changes:
        words[at] = f"x{at}"
    return " ".join(words)


def test_stage_on_planted_near_copies(spark, sf):
    """One changed word of 80 is 0.88, two far apart 0.77; 3 hangs on 1 through 2; 6 and 7 share an id and no words."""
    texts = [(1, planted()), (2, planted(0)), (3, planted(0, 79)), (4, planted(20, 40, 60)), (5, planted()), (6, "a b c d e f"), (6, "g h i j k l"), (1 << 62, "m n o p q r")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    left = dict(corpus_pipeline.STAGES)["dedup"](spark, frame, sf)
    assert left.columns == frame.columns
    assert sorted(map(tuple, left.collect())) == sorted([texts[0], texts[3], texts[5], texts[6], texts[7]])


def test_groups_on_whole_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = groups_of({r.doc_id: r.text for r in frame.collect()})
    rows = near_copies.group(frame).collect()
    least = {}
    for r in rows:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.component] for r in rows} == wanted
    assert {r.doc_id for r in near_copies.dedup(frame).collect()} == set(wanted.values())


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_copies.dedup(none).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (2, ""), (3, "a"), (4, "A ")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in near_copies.dedup(odd).collect()) == [0, 0, 1, 3]
