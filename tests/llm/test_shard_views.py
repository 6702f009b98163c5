"""Sequences and masks are views of the file."""

import numpy as np
import public_tokenizers
from gridloom.llm import token_shards


def test_views(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"some words of row {k}") for k in range(200)], "doc_id long, text string")
    folder = str(tmp_path / "shards")
    shard = max(token_shards.write_shards(frame, public_tokenizers.path("word_bpe_49k.json"), 2, folder, seq_len=16).collect(), key=lambda r: r.n_tokens)
    reader = token_shards.ShardReader(shard.ids_path, shard.docs_path, folder)
    n = -(-shard.n_tokens // 16)
    for k in (0, 1, n - 1):
        ids, mask = reader.sequence(k)
        assert not ids.flags.owndata and ids.__array_interface__["data"] == reader.sequence(k)[0].__array_interface__["data"]  # no copy: the same memory again
        view = reader.mask(k)
        assert view.buffers()[1].address == reader.mask(k).buffers()[1].address and np.array_equal(view.to_numpy(zero_copy_only=False), mask)
    assert reader.mask(n - 1).to_pylist() == [j < (shard.n_tokens - 1) % 16 + 1 for j in range(16)]
