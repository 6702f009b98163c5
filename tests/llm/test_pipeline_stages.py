"""The pipeline stage by stage against brute force, near copies by five-word shingles at likeness 0.8."""

from collections import Counter

import corpus_pipeline
from gridloom.llm import queries
from test_llm_queries import SPACE, check_mix, check_sequences, crc, tokenizer, water_fill
from test_near_copies import groups_of


def test_stages(spark, sf):
    docs = sorted((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    kept = {r.doc_id for r in queries.op4_quality_rules(spark, sf).where("kept").collect()}
    stages, frame = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    names = frame.columns
    frame = stages["quality"](spark, frame, sf)
    assert frame.columns == names and {r.doc_id for r in frame.select("doc_id").collect()} == kept
    left = [d for d in docs if d[0] in kept]
    groups = groups_of({d: t for d, t, _ in left})
    frame = stages["dedup"](spark, frame, sf)
    left = [d for d in left if groups[d[0]] == d[0]]
    assert frame.columns == names and sorted(r.doc_id for r in frame.select("doc_id").collect()) == [d[0] for d in left]
    mixed = stages["mix"](spark, frame, sf)
    assert mixed.columns == names
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    sizes, totals = {d: len(SPACE.findall(t)) for d, t, _ in left}, Counter()
    for d, _, s in left:
        totals[s] += sizes[d]
    wanted = water_fill(totals, (5, 2, 1), 3)
    check_mix([{"doc_id": d, "size": sizes[d], "source_size": totals[s], "target": wanted[s], "taken": copies[d] * sizes[d]} for d, _, s in left], left)
    rows = [r.asDict() for r in stages["pack"](spark, mixed, sf).collect()]
    encode, text_of, total = tokenizer("byte_bpe_50k.json"), {d: t for d, t, _ in left}, 0
    pieces = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    for d, n in copies.items():
        ids = encode.encode(text_of[d], add_special_tokens=False).ids + [0]
        total += n * len(ids)
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        assert pieces[d, 0, first, crc(ids[:first])] == n
    check_sequences(rows, total)
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
