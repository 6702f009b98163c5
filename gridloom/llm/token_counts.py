"""Operator 6: token counts from the counts of distinct pre-tokens.

A pre-token is a stretch of text whose pieces don't depend on what stands around it: the cuts lie where no piece of
the vocabulary spans two classes of characters (checked against the vocabulary when it is loaded). Each distinct
pre-token of the corpus is counted once; documents' pre-token frequencies are joined to these counts and summed.

A pre-token goes by its text, or, if that is longer than ``LONG`` characters, by its SHA-256, so that keys are short
whatever the text. The join has two exact parts. The ``HEAD`` most frequent keys, a table of fixed size, are looked up
where the text is read; all others leave as (row, key, frequency) rows and meet their counts in a shuffled join. A key
outside the head has at most a ``HEAD``-th of all occurrences or so, so that no key of the join is hot.

Edge cases: a null or empty text has no tokens; repeated rows are counted apart; special strings are ordinary text;
texts of one character only, or without blanks, are single pre-tokens of any length; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import stage

#: Keys in the broadcast table, at most about 20 MB of them.
HEAD = 100_000
#: Longer pre-tokens, in characters, go by their digest and are counted where they are read.
LONG = 40
#: Distinct keys that a task holds before it passes them on.
HELD = 300_000

BLANK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"


class PieceCounter:
    """Cuts a text into pre-tokens and counts the pieces of one."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        latin = re.compile(f"[{LATIN}]")

        def kind(c: str) -> str:
            return "_" if c == BLANK else "n" if c == "\n" else "d" if c in "0123456789" else "a" if latin.match(c) else "x"

        spans = set()
        for i in range(self.model.get_piece_size()):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                spans |= {kind(a) + kind(b) for a, b in pairwise(self.model.id_to_piece(i))}
        if spans & {"a_", "x_", "d_", "n_"}:
            raise ValueError("this vocabulary has pieces that go on behind a blank; their counts can't be summed")
        fine = not spans & {"ax", "xa", "ad", "da", "dd", "dx", "xd", "_d", "an", "na", "xn", "nx", "nn", "nd", "dn", "_n"}
        # A run of blanks belongs to what follows; the library turns a blank into BLANK, and takes BLANK for one.
        pattern = f"[ {BLANK}]*[{LATIN}]+|[ {BLANK}]*[^ {BLANK}{LATIN}0-9\n]+|[0-9\n]|[ {BLANK}]+" if fine else f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+"
        self.split = re.compile(pattern).findall

    def pretokens(self, text: str) -> list[str]:
        """The library puts a blank before a text."""
        return self.split(" " + text) if text else []

    def count(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token. Behind ``\\n``, a piece of its own, no blank is put; it is counted away."""
        return [len(ids) - 2 for ids in self.model.encode(["\n" + t for t in tokens], num_threads=1)]


def key_of(token: str) -> str:
    """The token, or what stands for a long one: no token has a line feed before anything else."""
    return token if len(token) <= LONG else "\n#" + hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def distinct_counts(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(token, frequency, n_tokens): the key of every distinct pre-token of the corpus with its number of pieces. Pieces
    are counted once for each; for long ones once in each part of the texts, as their characters stay there."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, pieces = counter(model), Counter(), {}

        def emit() -> pa.RecordBatch:
            names = ["token", "frequency", "n_tokens"]
            out = pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64()), pa.array([pieces.get(k) for k in seen], pa.int64())], names=names)
            seen.clear()
            pieces.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for token, n in Counter(own.pretokens(text.as_py() or "")).items():
                    seen[key := key_of(token)] += n
                    if len(token) > LONG and key not in pieces:
                        pieces[key] = own.count([token])[0]
                if len(seen) > HELD:  # bounded memory: what went out is summed after the shuffle
                    yield emit()
        yield emit()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            keys, known = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            counted = iter(own.count([k for k, n in zip(keys, known, strict=True) if n is None]))
            yield pa.record_batch([*batch.columns[:2], pa.array([next(counted) if n is None else n for n in known], pa.int64())], names=["token", "frequency", "n_tokens"])

    fields = "token string, frequency long, n_tokens long"
    by_part = df.select(F.col(text_col).alias("text")).mapInArrow(frequencies, fields)
    return by_part.groupBy("token").agg(F.sum("frequency").alias("frequency"), F.max("n_tokens").alias("n_tokens")).mapInArrow(pieces, fields)


def most_frequent(known: DataFrame) -> dict[str, int]:
    """Pieces of the most frequent keys, ``HEAD`` at most.

    The cut is taken from a histogram of frequencies in eighths of doublings (some hundreds of rows), so that no task
    sends more than its share of the table to the driver. Keys below the cut take the joined way.
    """
    known = known.withColumn("class", F.floor(F.log2("frequency") * 8).cast("int"))
    cut, total = None, 0
    for r in sorted(known.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > HEAD:
            break
        cut = r["class"]
    return {} if cut is None else {r[0]: r[1] for r in known.where(F.col("class") >= cut).select("token", "n_tokens").collect()}


def count_tokens(df: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    spark = df.sparkSession
    known = stage(distinct_counts(df, model, text_col).select("token", "frequency", "n_tokens"), "token-counts")
    head = spark.sparkContext.broadcast(most_frequent(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lookup = counter(model), head.value.get
        for batch in batches:
            sums, ends, tokens, times = [], [0], [], []
            for text in batch.column(3):
                total = 0
                for token, n in Counter(own.pretokens(text.as_py() or "")).items():
                    if (pieces := lookup(key := key_of(token))) is None:
                        tokens.append(key)
                        times.append(n)
                    else:
                        total += n * pieces
                sums.append(total)
                ends.append(len(tokens))
            pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(times, pa.int64())], ["token", "n"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.record_batch([*batch.columns[:3], pa.array(sums, pa.int64()), rest], names=["row", "doc_id", "n_bytes", "n_head", "rest"])

    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"),
    ).mapInArrow(run, "row long, doc_id long, n_bytes long, n_head long, rest array<struct<token:string,n:long>>")
    # One row for the looked-up part (its key, the row's number after a line feed, is no pre-token) and one for each other pre-token.
    first = F.array(F.struct(F.concat(F.lit("\n"), F.col("row").cast("string")).alias("token"), F.lit(None).cast("long").alias("n")))
    parts = rows.select("row", "doc_id", "n_bytes", "n_head", F.explode(F.concat(first, F.col("rest"))).alias("part")).select("row", "doc_id", "n_bytes", "n_head", "part.token", "part.n")
    summed = parts.join(known.select("token", "n_tokens"), "token", "left").groupBy("row", "doc_id", "n_bytes").agg(
        F.sum(F.when(F.col("n").isNull(), F.col("n_head")).otherwise(F.col("n") * F.col("n_tokens"))).alias("n_tokens")
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
