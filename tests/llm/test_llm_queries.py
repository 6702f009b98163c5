"""The ten queries and the pipeline against brute force on small whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from gridloom.llm import license_scan
from gridloom.llm.queries import HOSTILE, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


@pytest.fixture(scope="module")
def result(spark, sf):
    held = {}

    def run(name):
        if name not in held:
            held[name] = [r.asDict(recursive=True) for r in queries()[name](spark, sf).collect()]
        return held[name]

    return run


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_op1(docs, result):
    encode, start = tokenizer("word_bpe_49k.json"), 0
    wanted = {}
    for doc_id, text, _ in docs:
        ids = encode.encode(text, add_special_tokens=False).ids + [2]
        wanted[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in result("op1_token_shards")} == wanted


def test_op2(docs, result):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rows = {r["doc_id"]: r for r in result("op2_license_scan")}
    assert len(rows) == len(docs)
    for doc_id, text, _ in docs:
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = rows[doc_id]
        at = [p for p, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op3(spark, sf, result):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", HOSTILE), (1, "assistant", HOSTILE)]
    rows = {r["conv_id"]: r for r in result("op3_chat_format")}
    assert set(rows) == set(turns)
    for conv_id, own in turns.items():
        own.sort()
        whole, loss = "".join(f"{role}\n{text}\n" for _, role, text in own), "".join(text for _, role, text in own if role == "assistant")
        r = rows[conv_id]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= len(whole)


def base_statistics(text):
    words = SPACE.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {i + d for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_op4(spark, sf, docs, result):
    rows = {r["doc_id"]: r for r in result("op4_quality_rules")}
    assert len(rows) == len(docs)
    for doc_id, text, _ in docs:
        n, chars, symbols, lines, again = base_statistics(text)
        r = rows[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, again), doc_id
        assert r["base_failed"] == (n < 50 or 100 * again > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    fair = [rows[d] for d in good if not rows[d]["base_failed"]]
    assert sum(r["kept"] for r in fair) >= 0.98 * len(fair)


def check_packing(rows, encode, docs):
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    total = 0
    for doc_id, text, _ in docs:
        ids = encode.encode(text, add_special_tokens=False).ids + [0]
        total += len(ids)
        own = [pieces.pop((doc_id, k)) for k in range(-(-len(ids) // 2048))]
        assert [r["start"] + r["length"] for r in own] == [r["start"] for r in own[1:]] + [len(ids)] and own[0]["start"] == 0
        assert all(r["length"] == 2048 for r in own[1:]) and all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
    assert not pieces
    return total


def check_sequences(rows, total, slack=1.03):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(sequences) <= max(total / 2048 * slack + 1, 1)


def test_op5(docs, result):
    rows = result("op5_best_fit_packing")
    check_sequences(rows, check_packing(rows, tokenizer("byte_bpe_50k.json"), docs))


def test_op6(docs, result):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    wanted = {d: (len(t.encode()), len(n := model.encode(t)), len(n) > 4096) for d, t, _ in docs}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in result("op6_token_counts")} == wanted


def test_op7(spark, sf, result):
    from gridloom.llm.queries import URL_RULES

    rows = {r["page_id"]: r for r in result("op7_url_filters")}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        rest = p.url.split("://", 1)[1] if "://" in (p.url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + q), len(h), h + q, v) for h, q, v in URL_RULES if ("." + host.lower()).endswith("." + h) and path.startswith(q)]
        _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
        r = rows[p.page_id]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host.lower(), path, rule, verdict)


def water_fill(sizes, weights, most):
    """Targets by resharing until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * w[s] / share for s in names}
        over = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def check_mix(rows, docs):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(SPACE.findall(text))
    wanted = water_fill(sizes, (5, 2, 1), 3)
    source_of, size_of = {d: s for d, _, s in docs}, {d: len(SPACE.findall(t)) for d, t, _ in docs}
    taken, largest = Counter(), Counter()
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert len(rows) == len(docs)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= largest[s] + 1


def test_op8(spark, sf, docs, result):
    rows = result("op8_source_mixing")
    check_mix(rows, docs)
    again = [r.asDict() for r in queries()["op8_source_mixing"](spark, sf).collect()]
    assert sorted(again, key=lambda r: r["doc_id"]) == sorted(rows, key=lambda r: r["doc_id"])


def test_op9(docs, result):
    from gridloom.llm.iblt_fingerprints import digests

    rows = {r["doc_id"]: r for r in result("op9_iblt_fingerprints")}
    assert len(rows) == len(docs)

    def jaccard(a, b):
        a, b = set(digests(a).tolist()), set(digests(b).tolist())
        return len(a & b) / len(a | b) if a | b else 1.0

    for (doc_id, text, _), (_, following, _) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        r = rows[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(text, changed)) and r["near_next"] == pytest.approx(jaccard(text, following))
    by_text = defaultdict(set)
    for doc_id, text, _ in docs:
        by_text[text].add(rows[doc_id]["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def simhash(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = SPACE.findall(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fingerprints, radius=2):
    """Smallest reachable id by comparing all pairs."""
    ids = sorted(fingerprints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if b < a and (fingerprints[a] ^ fingerprints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op10(docs, result):
    fps = {d: simhash(t) for d, t, _ in docs}
    groups = groups_of(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result("op10_simhash_dedup")} == {d: (f"{fps[d]:016x}", groups[d]) for d in fps}
