"""Long pre-tokens that many documents share."""

import public_tokenizers
import sentencepiece
from gridloom.llm import token_counts


def test_long_shared_pretokens(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    long = ["x" * 5000, "日本語" * 700, "=" * 3000, "a" * 40, "a" * 41]
    texts = [f"{long[k % 5]} row {k} {long[0]}" for k in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {k: len(model.encode(t)) for k, t in enumerate(texts)}
    for head in (token_counts.HEAD, 0):
        monkeypatch.setattr(token_counts, "HEAD", head)
        assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, path).collect()} == wanted
    keys = [r.token for r in token_counts.distinct_counts(frame, path).collect()]
    assert max(map(len, keys)) <= 66 and len(set(keys)) == len(keys)
    monkeypatch.setattr(token_counts, "HEAD", 5)
    assert any(k.startswith("\n#") for k in token_counts.most_frequent(token_counts.distinct_counts(frame, path)))
