"""Operator 11 against runs by definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from gridloom.llm import periodic_runs
from gridloom.llm.queries import queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Every stretch that no neighbour extends, of each period, unless a smaller one is a period of it too."""
    found, n, names = [], len(words), {}
    words = np.array([names.setdefault(w, len(names)) for w in words])
    for q in range(1, n // 2 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], words[q:] == words[:-q], [0]])))
        for x, y in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            length = y - x + q
            if length >= max(least, 2 * q) and not any((words[x + d : x + length] == words[x : x + length - d]).all() for d in range(1, q)):
                found.append((x, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def damaged(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, words):
    runs = brute(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_refinement_against_definition():
    rng = random.Random(3)
    for trial in range(500):
        wide = 1 if trial < 400 else 12
        texts = []
        for _ in range(rng.randrange(1, 6)):
            n, letters = rng.randrange(70) * wide, rng.choice([1, 2, 2, 3, 6, 50])
            words = [b"%d" % rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randrange(3 * wide)):
                a, p = rng.randrange(n + 1), rng.randrange(1, 9 * wide)
                b = min(n, a + rng.randrange(40 * wide))
                words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
            texts.append(words)
        least = rng.choice([2, 12])
        got = periodic_runs.together(texts, least)
        assert [[tuple(r) for r in runs.tolist()] for runs in got] == [brute(w, least) for w in texts], trial


@pytest.mark.parametrize("words", [["a"] * 3000, ["a", "b"] * 1500, [str(k % 700) for k in range(3000)], [bin(k).count("1") % 2 for k in range(2048)]])
def test_long_periods(words):
    """One letter, short and long periods, and a word with many squares but no cubes."""
    words = [str(w).encode() for w in words]
    assert [tuple(r) for r in periodic_runs.together([words, [b"x"], words])[2].tolist()] == brute(words)


def test_work_of_a_repeated_word():
    """The smaller half alone moves: one position a level, not the class."""
    classes, moved = periodic_runs.Classes(np.array([0] * 4000 + [1]), np.full(4001, 2000)), 0
    for _ in range(1500):
        moved += len(classes.movers()) if classes.level > 1 else 0
        assert classes.refine()
    assert moved <= 1500


def test_op11(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = sorted(expected(d, damaged(d, SPACE.findall(t))) for d, t in docs)
    frame = queries()["op11_periodic_runs"](spark, sf)
    assert frame.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r)[:8] for r in frame.collect()) == wanted
    assert sum(r[1] > 0 for r in wanted) > 10


def test_op11_edges(spark):
    long = "aa bb cc " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "x " * 11), (6, "x " * 12), (6, "x " * 12), (None, "y  y  " * 9), (None, None), (7, " a\x1c " * 14), (22, "one"), (30, "a b")]
    rows = [(i, t, 1, "s", 2, "c") for i, t in rows]
    schema = "doc_id long, text string, start int, runs string, n_runs int, collapsed string"
    odd = spark.createDataFrame(rows, schema).repartition(3)
    got = [tuple(r) for r in periodic_runs.digest(periodic_runs.find_runs(periodic_runs.periodic_tails(odd))).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    short = [expected(i, damaged(i, SPACE.findall(t or ""))) for i, t, *_ in rows if i != 4]
    assert sorted((r for r in got if r[0] != 4), key=key) == sorted(short, key=key)
    (own,) = [r for r in got if r[0] == 4]
    assert own[:6] == (4, 1, 0, 60_000, 3, 20_000_000) and own[7] == hashlib.sha256(b"aa bb cc").hexdigest()
    direct = periodic_runs.find_runs(odd).where("doc_id = 6").collect()
    assert [[tuple(x) for x in r.runs] for r in direct] == [[(0, 12, 1)]] * 2 and direct[0].collapsed == "x"
    assert periodic_runs.digest(periodic_runs.find_runs(periodic_runs.periodic_tails(odd.where("doc_id < 0")))).count() == 0
