"""Operator 1: token ids as Arrow files of fixed-size lists.

Documents in ascending id order form one stream of ids, each document followed by an end id. The stream is
cut into shards along document boundaries (one for each range partition). A shard is an Arrow IPC file,
uncompressed, whose record batches hold equal-length sequences: ``input_ids`` fixed_size_list<uint16|uint32>
and ``mask`` fixed_size_list<bool> (false for padding, in the shard's last sequence alone). Sequence ``i`` of
a shard sits in batch ``i // BATCH`` at row ``i % BATCH``, so a memory map gives it without a copy. A second
file indexes the shard's documents.

Edge cases: a null or empty text gives the end id alone; a null id sorts first; repeated ids are kept, ordered
by text; an empty table gives no shard with documents; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.storage import filesystem, partitions, remove_at_exit, run_dir
from gridloom.llm.tokens import encoder

#: Sequences in a record batch.
BATCH = 256
MANIFEST = "shard int, n_docs long, n_tokens long, seq_len int, width int, ids_path string, docs_path string"


class ShardWriter:
    """Streams documents' ids into the two files of a shard; nothing larger than a batch is held."""

    def __init__(self, folder: str, shard: int, attempt: int, seq_len: int, width: int):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.names = [(f"{root}/{kind}-{shard:06d}.arrow", f"{root}/.{kind}-{shard:06d}.{attempt}") for kind in ("ids", "docs")]
        self.seq_len, self.dtype = seq_len, np.dtype(f"<u{width}")
        ids_type = pa.list_(pa.from_numpy_dtype(self.dtype), seq_len)
        self.ids_schema = pa.schema([("input_ids", ids_type), ("mask", pa.list_(pa.bool_(), seq_len))], {b"shard": str(shard).encode()})
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(part) for _, part in self.names]
        self.files = [pa.ipc.new_file(sink, schema) for sink, schema in zip(self.sinks, (self.ids_schema, self.docs_schema), strict=True)]
        self.held, self.held_bytes, self.n_tokens, self.n_docs = [], 0, 0, 0
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.index.append((doc_id, self.n_tokens, n))
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.n_tokens += n
        self.n_docs += 1
        if self.held_bytes >= BATCH * self.seq_len * self.dtype.itemsize:
            self.flush(BATCH)
        if len(self.index) >= 65_536:
            self.flush_index()

    def flush(self, least: int) -> None:
        data = b"".join(self.held)
        step = BATCH * self.seq_len * self.dtype.itemsize
        at = 0
        while len(data) - at >= step or (least == 0 and at < len(data)):
            self.put(np.frombuffer(data[at : at + step], self.dtype))
            at += step
        self.held, self.held_bytes = [data[at:]], max(0, len(data) - at)

    def put(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.seq_len)
        mask = np.arange(rows * self.seq_len) < len(ids)
        ids = np.concatenate([ids, np.zeros(rows * self.seq_len - len(ids), self.dtype)]) if not mask.all() else ids
        self.files[0].write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)], schema=self.ids_schema))

    def flush_index(self) -> None:
        if self.index:
            self.files[1].write_batch(pa.record_batch([pa.array(x, pa.int64()) for x in zip(*self.index, strict=True)], schema=self.docs_schema))
            self.index = []

    def close(self) -> list[str]:
        """Files appear under their names only when whole, so a second attempt of a task does no harm."""
        self.flush(0)
        self.flush_index()
        for file, sink, (name, part) in zip(self.files, self.sinks, self.names, strict=True):
            file.close()
            sink.close()
            self.fs.move(part, name)
        return [name for name, _ in self.names]


class ShardReader:
    """Random access to a shard's sequences and documents, on a memory map where the file is local."""

    def __init__(self, ids_path: str, docs_path: str, root: str):
        from pyarrow import fs

        system, _ = filesystem(root)
        opened = pa.memory_map if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.ids, self.docs = pa.ipc.open_file(opened(ids_path)), pa.ipc.open_file(opened(docs_path))
        self.seq_len = self.ids.schema.field("input_ids").type.list_size
        self.last: tuple[int, np.ndarray] = (-1, np.empty(0))

    def batch(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.last = (k, self.ids.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True))
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids, a view, and mask of the shard's ``i``-th sequence, the mask unpacked to a byte each; see ``mask``."""
        batch, row = self.ids.get_batch(i // BATCH), i % BATCH
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)[row * self.seq_len : (row + 1) * self.seq_len]
        return ids, batch.column(1).flatten().to_numpy(zero_copy_only=False)[row * self.seq_len : (row + 1) * self.seq_len]

    def mask(self, i: int) -> pa.BooleanArray:
        """The ``i``-th sequence's mask as a view of the file's bits."""
        return self.ids.get_batch(i // BATCH).column(1).flatten().slice(i % BATCH * self.seq_len, self.seq_len)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as views."""
        step = BATCH * self.seq_len
        while n > 0:
            part = self.batch(start // step)[start % step : start % step + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_shards(df: DataFrame, tokenizer: str, end_id: int, folder: str, seq_len: int = 2048, id_col: str = "doc_id", text_col: str = "text", drops_space: bool = True) -> DataFrame:
    """Write ``df``'s ids below ``folder``; the manifest, one row for each shard, is returned and kept there."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, to_ids = TaskContext.get(), encoder(tokenizer, drops_space)
        shard = context.partitionId()
        end = int(end_id).to_bytes(to_ids.width, "little")
        out = ShardWriter(folder, shard, context.taskAttemptId(), seq_len, to_ids.width)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), to_ids.encode_column(batch.column(1)), strict=True):
                out.add(doc_id, ids + end)
        names = out.close()
        yield pa.RecordBatch.from_pylist([dict(shard=shard, n_docs=out.n_docs, n_tokens=out.n_tokens, seq_len=seq_len, width=to_ids.width, ids_path=names[0], docs_path=names[1])], pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("seq_len", pa.int32()), ("width", pa.int32()), ("ids_path", pa.string()), ("docs_path", pa.string())]))

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``base``, the ids of all shards before. One row for each shard, so one window is small."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document as the files have it: doc_id, start, n_tokens, ids_crc32 (ids taken as uint32, little-endian)."""
    spread = manifest.where("n_docs > 0").select("base", "ids_path", "docs_path", "shard").repartition(partitions(manifest.sparkSession), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, ids_path, docs_path, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = ShardReader(ids_path, docs_path, folder)
                for k in range(shard.docs.num_record_batches):
                    docs = shard.docs.get_batch(k)
                    crcs = []
                    for start, n in zip(docs.column(1).to_numpy().tolist(), docs.column(2).to_numpy().tolist(), strict=True):
                        crc = 0
                        for part in shard.span(start, n):
                            crc = zlib.crc32(part.astype("<u4"), crc)
                        crcs.append(crc)
                    starts = pa.array(docs.column(1).to_numpy() + base)
                    yield pa.record_batch([docs.column(0), starts, docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(df: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write the files to a new folder in the shared one and read every document back from them. The folder goes when
    the session's Python ends; ``write_shards`` keeps what it writes."""
    folder = run_dir(df.sparkSession, "token-shards")
    remove_at_exit(df.sparkSession, folder)
    return read_documents(write_shards(df, tokenizer, end_id, folder, **options), folder)
