"""Rows of one conversation that share a turn, or have none, are messages of their own."""

import hashlib

from gridloom.llm import chat_format


def test_tied_and_null_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, "user", "x"), (2, None, "assistant", "y"), (2, 5, "user", None), (None, 3, "assistant", "z"), (None, 3, "user", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.parse(chat_format.format_chats(chat_format.messages_as_events(frame)))).collect()}
    assert set(got) == {1, 2, None}
    for conv_id, r in got.items():
        own = sorted(((t is None, t or 0), role, text or "") for c, t, role, text in rows if c == conv_id)
        whole, loss = "".join(f"{role}\n{text}\n" for _, role, text in own), "".join(text for _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
