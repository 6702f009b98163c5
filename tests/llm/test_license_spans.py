"""Spans, labels and score against brute force, and long texts."""

import random
import time

from gridloom.llm import license_scan


def runs_of(words, template, least):
    """(start, place, n) of all maximal common runs ending where no longer one goes on, by comparing every pair of places."""
    n, m = len(words), len(template)
    length = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            length[i][j] = length[i - 1][j - 1] + 1 if words[i - 1] == template[j - 1] else 0
    longest = [max(row) for row in length]
    out = []
    for i in range(1, n + 1):
        if longest[i] >= least and (i == n or longest[i + 1] != longest[i] + 1):
            out += [(i - longest[i], j - longest[i], longest[i]) for j in range(1, m + 1) if length[i][j] >= longest[i]]
    return sorted(out)


def chains_of(runs, size, gap, cover):
    """Every run, in order, joins the oldest chain that it can carry on; overlapping later chains go."""
    chains = []
    for s, p, n in runs:
        fit = [c for c in chains if s >= c["end"] and p >= c["place"] and s - c["end"] <= gap and p - c["place"] <= size]
        if fit:
            fit[0].update(end=s + n, place=p + n, covered=fit[0]["covered"] + n)
        else:
            chains.append(dict(start=s, end=s + n, place=p + n, covered=n))
    kept = []
    for c in sorted(chains, key=lambda c: (c["start"], -c["covered"])):
        if c["covered"] >= cover * size and all(c["start"] >= k["end"] for k in kept):
            kept.append(c)
    return kept


def spoilt(rng, words):
    """Words with some replaced, dropped or repeated."""
    out = []
    for w in words:
        r = rng.random()
        out += [w] if r > 0.08 else [] if r > 0.05 else [w, w] if r > 0.03 else [rng.choice(["acme", "2024", "the"])]
    return out


def test_spans_by_brute_force(spark):
    rng = random.Random(5)
    templates = license_scan.TEMPLATES
    texts = []
    for _ in range(60):
        parts = []
        for name in rng.sample(list(templates), rng.randrange(4)):
            words = templates[name].split()
            a = rng.randrange(len(words) // 2 + 1)
            parts += spoilt(rng, words[a // 3 :] if rng.random() < 0.5 else words) + ["and", "so"] * rng.randrange(9)
        texts.append(" ".join(parts))
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    digests = {r.doc_id: r for r in license_scan.digest(rows).collect()}
    n_spans = 0
    for r in rows.collect():
        words, wanted = license_scan.words_of(texts[r.doc_id]), []
        for label, template in templates.items():
            own = license_scan.words_of(template)
            found = chains_of(runs_of(words, own, min(5, len(own))), len(own), 12, 0.6)
            wanted += [(c["start"], c["end"], label, c["covered"] / len(own)) for c in found]
        assert sorted(map(tuple, r.spans)) == sorted(wanted)
        n_spans += len(wanted)
        d = digests[r.doc_id]
        assert d.labels == ",".join(sorted({p.label for p in r.places} | {w[2] for w in wanted}))
        assert d.score == min(1.0, max([w[3] for w in wanted] + [0.5 if r.places else 0.0]))
    assert n_spans > 40


def test_a_million_words():
    """Time in proportion to a text of licence lines."""
    own = license_scan.scanner(tuple(license_scan.TEMPLATES.items()), tuple(license_scan.PHRASES.items()), 5, 12, 0.6)
    line = " ".join(license_scan.TEMPLATES[k] for k in ("apache-line", "gpl-line", "mit-line"))
    words = license_scan.words_of(line)
    took = {}
    for n in (100_000, 1_000_000):
        text, began = (words * (n // len(words) + 1))[:n], time.perf_counter()
        spans = own.spans(text)
        took[n] = time.perf_counter() - began
        assert len(spans) >= 3 * (n // len(words))
    assert took[1_000_000] < 25 * took[100_000] + 1
