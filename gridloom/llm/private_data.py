"""Operator 12: personal data, and the words that give it away, by information-theoretic sanitisation.

Patterns find addresses, card and phone numbers; their values are the protected entities, which go by a digest from then on. A
term (a run of letters and digits, lower-cased) within ``WINDOW`` terms of an entity is a candidate where that happens in
``SUPPORT`` different texts. Over all documents, with N of them and n(.) those that hold something, a term tells

    PMI(entity; term) = log2(N * n(entity near term) / (n(entity) * n(term)))    of    IC(entity) = log2(N / n(entity)),

and it discloses the entity where that is ``DISCLOSURE`` of it or more. Every place of a disclosing term in a text that has it near
that entity becomes a span: ``generalised``, where the term's class (number, code, word, other), counted in the same way, stays below
the threshold and so can stand in its place, else ``removed``.

Texts are read twice: once for entities with their neighbours, once to count the texts of candidate terms. What the second reading
counts is narrowed by a bitmap of ``BITS`` bits, however many candidates there are; a bitmap that fills up lets more through and
loses none. All the rest are joins and sums of small rows; equal texts are one text as far as support goes.

Edge cases: a null or empty text has no spans; rows with equal texts get equal spans, whatever their ids; patterns are matched in
time proportional to the text; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import stage

WINDOW, SUPPORT, DISCLOSURE = 8, 2, 0.6
#: Bits of the bitmap of candidates (1 MB), in buckets of Spark's bitmap functions.
BITS, BUCKET = 1 << 23, 1 << 15
#: Terms counted in a task before counts go on.
HELD = 1 << 18
SEED = 42
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits, so that a run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")
NOT_DIGIT = re.compile("[^0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: of each ``@`` the whole run of local characters before it, as far as none is taken."""
    taken, at = 0, text.find("@")
    while at >= 0:
        low = taken + len(text[taken:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if low < at else None
        if found:
            yield low, found.end()
        taken = found.end() if found else at + 1  # what was tried holds no later address
        at = text.find("@", taken)


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) in order."""
    found = [(x, 0, y, text[x:y].lower()) for x, y in emails(text)]
    found += [(m.start(), 1, m.end(), m[0]) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), digits))
    found += [(m.start(), 3, m.end(), d) for m in PHONE.finditer(text) if 9 <= len(d := NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def class_of(term: str) -> str:
    """What a term can be generalised to."""
    return "\0number" if term.isdigit() else "\0code" if any(c.isdigit() for c in term) else "\0word" if term.isalpha() else "\0other"


def entity_of(kind: int, value: str) -> str:
    return hashlib.blake2b(f"{KINDS[kind]}:{value}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def neighbours(text: str, spans: list[tuple[int, int, int, str]], window: int) -> tuple[set[tuple[str, str, str | None]], dict[str, list[int]]]:
    """(entity, term, its class) within the window, (entity, class, none) likewise, and all places of those terms; terms lie
    outside all spans."""
    if not spans:
        return set(), {}
    places, ends, k, reach = [], [s[:3:2] for s in spans], 0, 0
    for m in TERM.finditer(text):
        while k < len(ends) and ends[k][0] < m.end():
            reach, k = max(reach, ends[k][1]), k + 1
        if m.start() >= reach:
            places.append((m.start(), m[0].lower(), m.end()))
    pairs, at = set(), 0
    for start, kind, _, value in spans:
        while at < len(places) and places[at][0] < start:
            at += 1
        entity = entity_of(kind, value)
        for _, term, _ in places[max(0, at - window) : at + window]:
            pairs |= {(entity, term, class_of(term)), (entity, class_of(term), None)}
    near, held = {t for _, t, _ in pairs}, defaultdict(list)
    for start, term, stop in places:
        if term in near:
            held[term].append((start, stop))
    return pairs, held


SPAN = "struct<start: int, kind: int, stop: int>"


def _key(text: Column) -> list[Column]:
    own = F.coalesce(text, F.lit(""))
    return [F.xxhash64(own).alias("a"), F.crc32(own.cast("binary")).alias("b")]


def find_base(df: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, spans, entities, pairs, places) of every row; key (two hashes) stands for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, *key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                t = text.as_py() or ""
                spans = base_spans(t)
                pairs, places = neighbours(t, spans, window)
                out.append({
                    "doc_id": doc_id, "key": dict(zip("ab", key, strict=True)), "spans": [{"start": s, "kind": k, "stop": e} for s, k, e, _ in spans],
                    "entities": sorted({entity_of(k, v) for _, k, _, v in spans}), "pairs": [{"entity": e, "term": w, "class": c} for e, w, c in pairs],
                    "places": [{"term": w, "at": [{"start": x, "stop": y} for x, y in at]} for w, at in places.items()],
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    span, at = (pa.struct([(n, pa.int32()) for n in names]) for names in (("start", "kind", "stop"), ("start", "stop")))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.struct([("a", pa.int64()), ("b", pa.int64())])), ("spans", pa.list_(span)), ("entities", pa.list_(pa.string())),
        ("pairs", pa.list_(pa.struct([(n, pa.string()) for n in ("entity", "term", "class")]))), ("places", pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(at))]))),
    ])
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("*", *_key(F.col("text")))
    pairs, places = "array<struct<entity: string, term: string, class: string>>", "array<struct<term: string, at: array<struct<start: int, stop: int>>>>"
    return rows.mapInArrow(run, f"doc_id long, key struct<a: long, b: long>, spans array<{SPAN}>, entities array<string>, pairs {pairs}, places {places}")


def bitmap(terms: DataFrame) -> bytes:
    """``BITS`` bits, those of the terms' hashes set."""
    bit = F.pmod(F.xxhash64("term"), F.lit(BITS)) + 1  # Spark numbers bits and buckets from 1
    named = terms.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place"))
    out = bytearray(BITS // 8)
    for row in named.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).collect():  # BITS / BUCKET rows at most
        out[(row.bucket - 1) * BUCKET // 8 : row.bucket * BUCKET // 8] = row.bits
    return bytes(out)


def texts_of(df: DataFrame, bits: bytes, text_col: str = "text") -> DataFrame:
    """(term, n): in how many rows each class, and each term that the bitmap has, is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        known: dict[str, tuple[str, ...]] = {}  # of a spelling what counts for it

        def counted(spelt: str) -> tuple[str, ...]:
            term = spelt.lower()
            bit = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), SEED) % BITS
            return (class_of(term), term) if bits[bit // 8] >> bit % 8 & 1 else (class_of(term),)

        def whole() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                found = set()
                for spelt in set(TERM.findall(text.as_py() or "")):
                    if spelt not in known:
                        if len(known) >= HELD:
                            known.clear()
                        known[spelt] = counted(spelt)
                    found.update(known[spelt])
                counts.update(found)
                if len(counts) >= HELD:
                    yield whole()
        yield whole()

    parts = df.select(F.col(text_col).alias("text")).mapInArrow(run, "term string, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(found: DataFrame, df: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, text_col: str = "text") -> DataFrame:
    """(entity, term, kind): terms that tell ``disclosure`` of what names the entity; kind is the place of generalised or removed."""
    pairs = found.select("key", F.explode("pairs").alias("p")).select("key", "p.*")
    near = pairs.groupBy("entity", "term", "class", "key").agg(F.count(F.lit(1)).alias("rows")).groupBy("entity", "term", "class").agg(F.sum("rows").alias("both"), F.count(F.lit(1)).alias("texts"))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("has"))
    likely = stage(near.where((F.col("texts") >= support) | F.col("class").isNull()).join(entities, "entity"), "private-pairs")
    n = float(found.count())
    told = (F.col("has") < n) & (F.col("both") * n / (F.col("n") * F.col("has")) >= F.pow(n / F.col("has"), F.lit(disclosure)))  # PMI >= disclosure * IC, without logarithms
    terms, classes = likely.where("class is not null"), likely.where("class is null").drop("class").withColumnRenamed("term", "class_")
    counts = stage(texts_of(df, bitmap(terms.select("term").distinct()), text_col), "private-terms")
    of_class = F.broadcast(counts.where(F.col("term").startswith("\0")).select(F.col("term").alias("class_"), "n"))  # four rows
    no_use = classes.join(of_class, "class_").where(told).select("entity", F.col("class_").alias("class"), F.lit(True).alias("no_use"))
    judged = terms.join(counts, "term").where(told).select("entity", "term", "class")
    return judged.join(no_use, ["entity", "class"], "left").select("entity", "term", F.when(F.col("no_use"), KINDS.index("removed")).otherwise(KINDS.index("generalised")).alias("kind"))


def sanitise(df: DataFrame, window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, spans, told) of every row: base spans and those of disclosing terms, each in order."""
    found = stage(find_base(df, window, id_col, text_col), "private")
    kinds = disclosing(found, df, support, disclosure, text_col)
    texts = found.where(F.size("pairs") > 0).select("key", "pairs", "places").dropDuplicates(["key"])
    named = texts.select("key", F.explode("pairs").alias("p")).select("key", "p.entity", "p.term").join(kinds, ["entity", "term"]).groupBy("key", "term").agg(F.max("kind").alias("kind"))
    places = texts.select("key", F.explode("places").alias("p")).select("key", "p.term", "p.at").join(named, ["key", "term"]).select("key", "kind", F.explode("at").alias("at"))
    told = places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at.start", "kind", "at.stop"))).alias("told"))
    return found.select("doc_id", "key", "spans").join(told, "key", "left").withColumn("told", F.coalesce("told", F.array().cast(f"array<{SPAN}>")))


def sanitised(df: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the spans of ``found`` (as ``sanitise`` gives them) replaced in its texts: base spans by their kind, generalised
    terms by their class, removed ones by nothing."""
    names, fields = df.columns, df.schema

    def replaced(text: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
            if s["start"] >= at:
                kind, own = KINDS[s["kind"]], text[s["start"] : s["stop"]]
                out += [text[at : s["start"]], "" if kind == "removed" else f"[{class_of(own.lower())[1:]}]" if kind == "generalised" else f"[{kind}]"]
            at = max(at, s["stop"])
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(0).to_pylist(), batch.column(1)
            row = batch.column(2)
            changed = pa.array([t.as_py() if not s else replaced(t.as_py(), s) for t, s in zip(texts, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([changed if n == text_col else row.field(k) for k, n in enumerate(names)], names=names)

    keyed = df.select(F.struct("*").alias("_row"), F.col(text_col).alias("_own")).select("_row", "_own", F.struct(*_key(F.col("_own"))).alias("_key"))
    once = found.where((F.size("spans") > 0) | (F.size("told") > 0)).dropDuplicates(["key"]).select(F.col("key").alias("_key"), F.concat("spans", "told").alias("_spans"))
    rows = keyed.join(once, "_key", "left").select("_spans", "_own", "_row")
    return rows.mapInArrow(run, fields)


def digest(found: DataFrame) -> DataFrame:
    """One row a document: counts and a digest of base spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = map(count, range(4))
    return found.select("doc_id", *counts, F.sha2(text(F.col("spans")), 256).alias("base_sha256"), text(F.concat("spans", "told")).alias("spans"))
