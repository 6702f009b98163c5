"""Operator 4's verdicts from its rules by plain Python, and names that clash."""

import unicodedata

import pytest
from gridloom.llm import quality_rules
from gridloom.llm.queries import queries
from test_llm_queries import SPACE, base_statistics


def features(text):
    n, chars, symbols, dup, again = base_statistics(text)
    lines = sum(SPACE.search(x) is not None for x in text.split("\n"))
    some = max(n, 1)
    return {
        "symbol_rate": symbols / some, "upper_rate": sum(unicodedata.category(c) == "Lu" for c in text) / max(chars, 1), "bang_rate": text.count("!") / some, "pipe_rate": text.count("|") / some,
        "repeat_share": again / some, "word_length": chars / some, "dup_line_share": dup / max(lines, 1), "n_words": n,
    }


def test_kept_is_the_lists_verdict(spark, sf):
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(documents, labels)
    assert rules
    rows = {r.doc_id: r for r in queries()["op4_quality_rules"](spark, sf).collect()}
    for d in documents.collect():
        found = features(d.text or "")
        first = next((k for k, rule in enumerate(rules, 1) if rule.covers(found)), 0)
        r = rows[d.doc_id]
        assert (r.rule, r.kept) == (first, not r.base_failed and first == 0), d.doc_id


@pytest.mark.parametrize("name", ["n_words", "N_Words", "kept", "_quality_w"])
def test_clashing_names_are_refused(spark, name):
    frame = spark.createDataFrame([(1, "a b", 7)], f"doc_id long, text string, {name} int")
    with pytest.raises(ValueError, match="another prefix"):
        quality_rules.judge(frame, [])
    assert quality_rules.judge(frame, [], prefix="q_").first()[name] == 7
