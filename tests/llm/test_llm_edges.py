"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from gridloom.llm import best_fit_packing, chat_format, iblt_fingerprints, license_scan, quality_rules, simhash, source_mixing, storage, token_counts, token_shards, url_filters
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, size string, row string, rank string, length string, fp string, _doc string, _id string, part string, token string"
LONG = "word and ünïcode text, 42! " * 20_000
TEXTS = [
    (1, "One two three four. Five six seven eight."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "One two three four. Five six seven eight."), (6, "One two three four. Five six seven eight."), (6, "other text of the same id"),
    (None, "no id"), (None, None), (7, "a  b\u00a0c\x1cd\x85e\u2003f   \n\n g"), (8, "x"), (9, "<|endoftext|> </s> ▁▁ 1234 ½ ² ç ﬁ 日本語 " + "é" * 50), (10, "e\u0301 \u0301x don't DON'T 's 're  \r\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None if i == 1 else "s" if i else "t", 0, 7, "s", "r", "k", "l", "f", "d", "i", "p", "t") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -5")


def ordered():
    return sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_op1(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encode, start, wanted = Tokenizer.from_file(path), 0, []
    for i, t in ordered():
        ids = encode.encode(t or "", add_special_tokens=False).ids + [2]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    folder = str(tmp_path / "shards")
    manifest = token_shards.write_shards(odd, path, 2, folder, seq_len=16)
    got = [tuple(r) for r in token_shards.read_documents(manifest, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == wanted
    shard = max(manifest.collect(), key=lambda r: r.n_tokens)
    reader = token_shards.ShardReader(shard.ids_path, shard.docs_path, folder)
    n = -(-shard.n_tokens // 16)
    real = sum(int(reader.sequence(k)[1].sum()) for k in (0, n // 2, n - 1))
    assert real == 32 + (shard.n_tokens - (n - 1) * 16) and len(reader.sequence(n - 1)[0]) == 16
    whole = np.concatenate(list(reader.span(0, shard.n_tokens)))
    assert np.array_equal(reader.sequence(n // 2)[0], whole[n // 2 * 16 : n // 2 * 16 + 16])
    assert token_shards.encode_documents(none, path, 2).count() == 0


def test_op2(odd, none, spark):
    rows = license_scan.digest(license_scan.scan_licenses(odd)).collect()
    assert len(rows) == len(TEXTS) and all(r.n_base == 0 and r.score == 0 for r in rows)
    assert license_scan.digest(license_scan.scan_licenses(none)).count() == 0
    words = license_scan.TEMPLATES["mit-text"].split()
    changed = "lead in " + " ".join(words[:60]) + " SOMETHING ELSE HERE " + " ".join(words[61:]) + " tail"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, changed), (2, "mit license MIT License mit-license, general public license")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.label, s.start) for s in r[0].spans] == [("mit-text", 2)] and r[0].spans[0].covered > 0.9
    assert [(p.start, p.label) for p in sorted(r[1].places)] == [(0, "mit"), (2, "mit"), (4, "mit"), (6, "gpl")]


def test_op2_matching_statistics():
    """Runs of the automaton against all common runs by brute force."""
    import random

    rng = random.Random(4)
    for _ in range(60):
        sequences = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        text = [rng.randrange(5) for _ in range(25)]
        auto = license_scan.Automaton(sequences)
        inside = lambda w: {(k, i + len(w) - 1) for k, s in enumerate(sequences) for i in range(len(s) - len(w) + 1) if s[i : i + len(w)] == w}  # noqa: B023,E731
        ends = {}
        for end in range(1, len(text) + 1):
            ends[end] = max((n for n in range(end + 1) if n == 0 or inside(text[end - n : end])), default=0)
        wanted = {(e, n) for e, n in ends.items() if n >= 2 and ends.get(e + 1, 0) != n + 1}
        got = list(auto.runs(text, 0, 2))
        assert {(e, n) for e, n, _ in got} == wanted
        assert all(set(auto.places[s]) == inside(text[e - n : e]) or len(auto.places[s]) and n <= auto.length[s] for e, n, s in got)


def event(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")


def test_op3_events(spark):
    log = event(spark, [
        (1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", "assistant", "llo"), (1, 4, 2, "message", "user", "more"),
        (1, 5, 3, "delta", "assistant", "old"), (1, 6, 0, "edit", "user", "hi!"), (1, 7, 1, "regenerate", "assistant", ""), (1, 8, 1, "delta", "assistant", "hey"), (1, 9, 2, "message", "user", "again"),
        (2, 1, 0, None, None, None), (2, 2, 1, "message", "assistant", "<|im_end|>\\<|im_start|>\\\\n[INST]<\\s>"), (None, None, None, "message", "us\ner\\n<s>", "x"), (3, 1, 0, "delta", "assistant", ""),
    ])
    rendered = chat_format.format_chats(log)
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], list(r.learnt)) for r in chat_format.parse(rendered).collect()}
    assert got[1] == ([("user", "hi!"), ("assistant", "hey"), ("user", "again")], ["hey"])
    odd = "<|im_end|>\\<|im_start|>\\\\n[INST]<\\s>"
    assert got[2] == ([("", ""), ("assistant", odd)], [odd])
    assert got[None] == ([("us\ner\\n<s>", "x")], []) and got[3] == ([("assistant", "")], [""])
    for r in rendered.collect():
        inner = r.formatted.replace("<|im_start|>", "", r.n_turns).replace("<|im_end|>\n", "", r.n_turns)
        assert not any(c in inner for c in chat_format.Template().controls)
    assert chat_format.format_chats(log.where("conv_id = 99")).count() == 0


def test_op3_escape_is_reversible(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    template, texts = chat_format.Template(), []

    @settings(max_examples=200, database=None)
    @given(st.lists(st.sampled_from([*template.controls, "\\", "<", "|", "[", "/", "s", ">", "\n", "n", "INST]", "im_end|>"]), max_size=8))
    def gather(parts):
        texts.append("".join(parts))

    gather()
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", template.escape(F.col("t"))).withColumn("u", template.unescape(F.col("e")))
    for r in frame.collect():
        assert r.u == r.t and not any(c in r.e for c in template.controls)


def test_op4(spark, odd, none):
    packed = odd.select(F.struct("*").alias("_all"), F.col("text").alias("_text"))
    rows = quality_rules.judge(packed, [], "_text", "_x").select("_all.doc_id", "_xkept", "_xn_words", "_xn_repeat_words").collect()
    assert len(rows) == len(TEXTS) and not any(r._xkept for r in rows)
    assert [r._xn_repeat_words for r in rows if r.doc_id == 5] == [20_000 * 5]
    assert quality_rules.fit(none, none.select("doc_id", F.lit(1).alias("quality"))) == []
    labels = spark.createDataFrame([(1, 0), (None, 0), (999, 1), (5, None)], "doc_id long, quality int")
    assert quality_rules.fit(odd, labels) == []
    assert quality_rules.judge(none.select("doc_id", "text"), []).count() == 0


def test_op4_learns(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    judged = quality_rules.judge(docs.select("doc_id", "text"), rules).join(labels, "doc_id").select("kept", "base_failed", "quality").collect()
    bad = [r for r in judged if r.quality == 0 and not r.base_failed]
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    assert rules and sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.7 * len(bad)
    assert quality_rules.fit(docs, labels) == rules


def test_op5(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path)
    pieces = best_fit_packing.tokenise(odd, path, 0, 64, with_ids=True)
    placed = best_fit_packing.place(pieces, 64)
    rows = placed.collect()
    wanted = sorted(n for i, t in TEXTS for n in [len(encode.encode(t or "", add_special_tokens=False).ids) + 1])
    assert sum(r.length for r in rows) == sum(wanted) and sum(r.piece == 0 for r in rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 64
    assert len(by) <= sum(wanted) // 64 + 2
    whole = {r.sequence_id: (r.n_tokens, len(r.ids)) for r in best_fit_packing.assemble(placed).collect()}
    assert whole == {k: (sum(n for _, n in own), 2 * sum(n for _, n in own)) for k, own in by.items()}
    assert best_fit_packing.pack_documents(none, path, 0).count() == 0


def test_op5_plan_is_best_fit():
    """The plan on counts against best-fit decreasing piece by piece."""
    import random

    rng = random.Random(1)
    for _ in range(40):
        capacity = rng.choice([7, 16, 50])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 200))), reverse=True)
        gaps = []
        for s in sizes:
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                gaps.append(capacity - s)
        counts = {s: sizes.count(s) for s in sizes}
        used = {}
        for length, low, high, first, each, base in best_fit_packing.plan(counts, capacity):
            for k in range(high - low):
                used.setdefault(first + k // each, []).append((base + k % each * length, length))
        assert sum(map(len, used.values())) == len(sizes) and len(used) == len(gaps)
        assert sorted(capacity - sum(n for _, n in own) for own in used.values()) == sorted(gaps)
        for own in used.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_chunked_tokenisation_is_exact():
    from gridloom.llm.tokens import ChunkEncoder
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoders = [ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), True), ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), False)]
    piece = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\u00a0", "\x1c", "\x85", "\u2003", "\u200b", "'s", "'re", "don't", "ab,", "é!!", "e\u0301", "\u0301", "日本", "12", "½", "İ", "Σς", "ÀÉÿß", "Schön", "naïve,", " WORD", "ªº", "<|endoftext|>", "...", "$%", "x", "\ufb01", "\U0001f600", "\0"])

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.lists(st.one_of(piece, st.text(max_size=3)), max_size=10))
    def same(parts):
        text = "".join(parts).encode("utf-8", "ignore").decode()
        for e in encoders:
            assert e.encode(text) == e.whole(text)

    same()


def test_op6(spark, odd, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, path).collect()))
    assert got == sorted((i is not None, i or 0, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in TEXTS)
    assert token_counts.count_tokens(none, path).count() == 0


def test_op6_pretokens_add_up():
    import sentencepiece
    from hypothesis import given, settings
    from hypothesis import strategies as st

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PieceCounter(path)
    piece = st.sampled_from([" ", "  ", "▁", "\n", "\t", "the", "ab", "é", "12", "7", "...", "!", "²", ".", "</s>", "<s>", "<0x0A>", "日本", "\u00a0", "e\u0301", "ß", "_", "-"])

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.lists(st.one_of(piece, st.text(max_size=3)), max_size=10))
    def same(parts):
        text = "".join(parts).encode("utf-8", "ignore").decode().replace("\0", "")
        assert sum(own.count(own.pretokens(text))) == len(model.encode(text))

    same()


def test_op6_without_head(odd, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    a = sorted(map(tuple, token_counts.count_tokens(odd.where("doc_id is not null"), path).collect()))
    monkeypatch.setattr(token_counts, "HEAD", 0)
    assert sorted(map(tuple, token_counts.count_tokens(odd.where("doc_id is not null"), path).collect())) == a


def test_op7(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM", "http://a.example.com/en", "http://a.example.com/en/x?q", "http://www.EXAMPLE.com/en/", "http://xexample.com/en/", "http://a.net/es/#x", "http://a.net/de/", "x://y://z.com/", "http://com/", "http://.com/", "http://a.net?/es/"]
    pages = spark.createDataFrame([(k % 9, u, "clash", "clash") for k, u in enumerate(urls)], "page_id long, url string, host string, row string")
    rules = url_filters.rules_table(spark, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block"), ("net", "/es/", "allow"), ("com", "/", "allow")])
    got = sorted((r.host, r.path, r.rule or "", r.verdict) for r in url_filters.judge_urls(pages, rules).collect())
    wanted = sorted([("", "", "", "allow")] * 4 + [
        ("a.example.com", "", "", "allow"), ("a.example.com", "/en", "com/", "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("xexample.com", "/en/", "com/", "allow"),
        ("a.net", "/es/", "net/es/", "block"), ("a.net", "/de/", "", "allow"), ("y:", "//z.com/", "", "allow"), ("com", "/", "com/", "allow"), (".com", "/", "com/", "allow"), ("a.net", "", "", "allow"),
    ])
    assert got == wanted
    assert url_filters.judge_urls(pages.where("page_id > 99"), rules).count() == 0 and url_filters.judge_urls(pages, rules.where("host = 'none'"), "block").where("verdict = 'block'").count() == len(urls)


def test_op8(odd, none):
    rows = source_mixing.mix(odd).collect()
    totals = {}
    for i, t in TEXTS:
        key = None if i == 1 else "s" if i else "t"
        totals[key] = totals.get(key, 0) + len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert len(rows) == len(TEXTS) and all(r._source_size == totals[r._doc["source"]] for r in rows)
    assert all(0 <= r._copies <= 3 for r in rows) and all(r._doc["size"] == "s" for r in rows)
    copies = source_mixing.emit(source_mixing.mix(odd))
    assert copies.columns == odd.columns and copies.count() == sum(r._copies for r in rows)
    assert source_mixing.mix(none).count() == 0


def test_op9(odd, none, spark):
    rows = iblt_fingerprints.successors(odd).collect()
    own = ordered()
    pairs = [((t or ""), (u or "")) for (_, t), (_, u) in zip(own, own[1:] + own[:1], strict=True)]
    wanted = sorted((len(t), hashlib.sha256(iblt_fingerprints.edited(t, u).encode()).hexdigest()) for t, u in pairs)
    assert sorted((r.n_chars, r.edited_sha256) for r in rows) == wanted
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert iblt_fingerprints.successors(none).count() == 0
    single = iblt_fingerprints.successors(spark.createDataFrame([(4, "alone here. really alone.")], "doc_id long, text string")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_op9_peeling_retries():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 5, 400, 3000)]
    left = [s for s in sets for _ in sets]
    right = [s for _ in sets for s in sets]
    wanted = [len(np.intersect1d(a, b)) / max(1, len(np.union1d(a, b))) if len(a) + len(b) else 1.0 for a, b in zip(left, right, strict=True)]
    assert iblt_fingerprints.likeness(left, right).tolist() == pytest.approx(wanted)


def test_op10(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(TEXTS)
    empty = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert empty == {2} and all(r.component_id is not None for r in rows if r.doc_id is not None)
    assert {r.component_id for r in rows if r.doc_id == 1} == {1} and simhash.near_duplicates(none).count() == 0
    left = simhash.dedup(odd)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect() if r.doc_id} >= {1, 2, 5, 8} and simhash.dedup(none).count() == 0


def test_op10_links_at_scale(spark):
    """Dense and sparse clusters of fingerprints, against all pairs; chains longer than a shard."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:4]:
        for _ in range(120):
            x = int(b)
            for bit in rng.integers(0, 24, rng.integers(1, 6)):
                x ^= 1 << int(bit)
            fps.add(x)
    x = int(base[5])
    for bit in range(0, 60, 2):
        x ^= 3 << bit
        fps.add(x)
    fps = sorted(fps)
    ids = rng.permutation(len(fps)).tolist()
    frame = spark.createDataFrame([(i, int(np.array(f, np.uint64).astype(np.int64))) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.group(frame).collect()}
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    assert got == {i: least[find(k)] for k, i in enumerate(ids)}


def test_shared_folder(spark):
    assert storage.shared_dir(spark) and storage.stage(spark.range(3).toDF("x"), "test").count() == 3
