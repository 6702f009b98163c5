"""Confirmation of near copies within one huge group of candidates."""

import random
from fractions import Fraction

import pytest
from gridloom.llm import near_copies


def brute(texts, similarity=0.8):
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def found(spark, texts):
    members = spark.createDataFrame([(7, k, t) for k, t in enumerate(texts)], "root long, klass long, text string").repartition(4)
    least = {r.klass: r.least for r in near_copies.confirmed(members, Fraction("0.8"), 5).collect()}
    return [least.get(k, k) for k in range(len(texts))]


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    """Chains, rings and clusters at and about the threshold, all sharing passages."""
    rng = random.Random(seed)
    common, texts = words(rng, 60), []
    for _ in range(12):
        own = common + words(rng, 40)
        for _ in range(rng.randrange(1, 8)):
            texts.append(" ".join(own))
            at = rng.randrange(len(own) - 8)
            own = own[:at] + words(rng, rng.randrange(1, 8)) + own[at + rng.randrange(8) :]
    texts = list(dict.fromkeys(texts + [" ".join(common[:k]) for k in range(6, 60, 3)]))
    rng.shuffle(texts)
    got, wanted = found(spark, texts), brute(texts)
    assert len(set(zip(got, wanted, strict=True))) == len(set(got)) == len(set(wanted))
