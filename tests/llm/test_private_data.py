"""Operator 12 against the patterns as they are written and the measures by definition."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from gridloom.llm import private_data as P
from gridloom.llm.queries import queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            double = [d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and sum(double) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else "".join(map(str, digits))
                found.append((m.start(), k, m.end(), (kind, value)))
    return sorted(found)


def expected(docs, window=P.WINDOW, support=P.SUPPORT, disclosure=P.DISCLOSURE):
    """(doc, counts, base digest, spans) of each row, by definition."""
    n, has, near, texts, holds = len(docs), Counter(), Counter(), defaultdict(set), Counter()
    kind = lambda t: "number" if t.isdigit() else "code" if any(c.isdigit() for c in t) else "word" if t.isalpha() else "other"
    every = []
    for _, text in docs:
        text = text or ""
        spans = base(text)
        words = {m[0].lower() for m in re.finditer(r"[^\W_]+", text)}
        holds.update(words)
        holds.update({("class", kind(w)) for w in words})
        terms = [(m.start(), m[0].lower(), m.end()) for m in re.finditer(r"[^\W_]+", text) if all(m.end() <= s or m.start() >= e for s, _, e, _ in spans)]
        around = {(v, t) for s, _, _, v in spans for own in ([t for t in terms if t[0] < s][-window:], [t for t in terms if t[0] >= s][:window]) for _, t, _ in own}
        has.update({v for *_, v in spans})
        near.update(around)
        near.update({(v, ("class", kind(t))) for v, t in around})
        for p in around:
            texts[p].add(text)
        every.append((spans, terms, around))

    def tells(entity, term):
        if has[entity] == n:
            return False
        return math.log2(n * near[entity, term] / (has[entity] * holds[term])) / math.log2(n / has[entity]) >= disclosure - 1e-12

    out = []
    for (doc, _), (spans, terms, around) in zip(docs, every, strict=True):
        kinds = {}
        for e, t in around:
            if len(texts[e, t]) >= support and tells(e, t):
                kinds[t] = max(kinds.get(t, 4), 5 if tells(e, ("class", kind(t))) else 4)
        told = [(s, kinds[t], e) for s, t, e in terms if t in kinds]
        text = lambda own: ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e, *_ in sorted(own))
        counts = [sum(k == x for _, k, *_ in spans) for x in range(4)]
        out.append((doc, *counts, hashlib.sha256(text(spans).encode()).hexdigest(), text([s[:3] for s in spans] + told)))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(7)
    pieces = ["a@b.c", "@", ".", "-", "_", "+1", "(23)", " ", "12", "3", "255", "256", "0001", "x.y", "@m.de", "4316522678525456", "+12345678901", "1.2.3.4", "\n", "é", "%", "007", ")"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        assert [s[:3] for s in P.base_spans(text)] == [s[:3] for s in base(text)], text


def test_patterns_take_linear_time():
    began = time.perf_counter()
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" + "(" * 400_000, "1-" * 200_000, "a@b" + ".c" * 200_000, "+" * 400_000):
        P.base_spans(text)
    assert time.perf_counter() - began < 10


def test_op12(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = queries()["op12_private_data"](spark, sf)
    assert frame.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got, wanted = sorted(map(tuple, frame.collect())), sorted(expected(docs))
    assert got == wanted and sum(any(r[1:5]) for r in wanted) > 3


def made():
    """An address that a nickname gives away, one that many words surround, and copies that prove nothing."""
    rng = random.Random(9)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"])
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, fill(30)) for k in range(60)]
    docs += [(100 + k, f"{fill(5)} Zorro mail zorro@night.example.org {fill(10)} and zorro again {fill(3)} x2y") for k in range(4)]
    docs += [(200 + k, f"{fill(12)} 10.0.0.1 {fill(20)}") for k in range(20)]
    docs += [(300, f"unique copied words 192.168.7.7 {fill(9)}")] * 5
    docs += [(400 + k, f"{k} q7w 5 call +1 (200) 555-00{k}1 42 {fill(2)}") for k in range(3)] + [(500 + k, f"İstanbul ab7 77 99 key +49 30 1234567 88 66 ab{k}") for k in range(3)]
    return docs + [(600, None), (601, ""), (None, "no id 10.0.0.1"), (None, None)]


def test_op12_edges(spark):
    docs = made() + [(700, "very long " * 50_000 + " 10.0.0.1 " + "end " * 50_000), (701, "10.0.0.1"), (702, "a@b.cd " * 500)]
    frame = spark.createDataFrame([(d, t, "e", 1, "k", 0) for d, t in docs], "doc_id long, text string, spans string, n int, key string, a int").repartition(3)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    found = P.sanitise(frame)
    got = sorted(map(tuple, P.digest(found).collect()), key=key)
    assert got == sorted(expected(docs), key=key)
    named = {r[0]: r[-1] for r in got}
    assert "generalised" in named[100] and named[300].count(":") == 2 and any("removed" in n for n in named.values())
    texts = {r.doc_id: r.text for r in P.sanitised(frame, found).collect()}
    assert texts[5] == docs[5][1] and texts[600] is None and "zorro" not in texts[100].lower() and "[email]" in texts[100] and "[ip]" in texts[700]
    assert P.sanitised(frame, found).columns == frame.columns and P.sanitised(frame, found).count() == len(docs)
    assert P.digest(P.sanitise(frame.where("doc_id < 0"))).count() == 0
