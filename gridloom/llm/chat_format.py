"""Operator 3: chat transcripts rebuilt from event logs and rendered for training. DataFrame functions only.

A log row is an event: (conv_id, seq, turn, kind, role, text), kind one of

* ``message``: the turn's text so far is replaced (a turn's first event, or a whole message);
* ``delta``: text is appended to the turn;
* ``edit``: the turn's text is replaced, later turns stay;
* ``regenerate``: the turn starts anew, and what later turns had received before it is void.

Within a conversation events apply by ``seq``. Rendering marks each turn and escapes control strings inside roles
and texts, so that the output can be parsed back exactly. The loss mask covers the assistant texts.

Edge cases: null text and null role are empty; a null kind is ``message``; a null seq is 0; a null turn takes ``seq`` as
its turn; null conversation ids form one conversation; rows repeated with the same ``seq`` apply in order of
their contents; an empty table gives an empty one; other columns are ignored. A conversation becomes one row, so
its rendered text must fit one value; what precedes (folding) never holds more than a turn together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the strings that must not occur inside one. ``\\`` is the escape character."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learnt: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        """Backslashes are doubled, then each control string gets one after its first character."""
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for c in self.controls:
            out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
        return out

    def unescape(self, text: Column) -> Column:
        """Left to right, a backslash stands for what it precedes: here by first taking back the marks of control
        strings, which hold the only single backslashes, then halving the rest."""
        for c in reversed(self.controls):
            text = F.replace(text, F.lit(c[0] + "\\" + c[1:]), F.lit(c))
        return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of every conversation."""
    # Conversation and turn as keys without nulls: what is joined by them stays where it is for the grouping by them.
    keys = ["_none", "_conv", "turn"]
    events = log.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.col("seq").cast("long"), F.lit(0)).alias("turn"),
        F.struct(
            F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        ).alias("event"),
    )
    # One narrow row for each turn, with its last reset and regeneration; a turn is void up to the last one of an earlier turn.
    kind, seq = F.col("event.kind"), F.col("event.seq")
    turns = events.groupBy(*keys).agg(F.max(F.when(kind != "delta", seq)).alias("_reset"), F.max(F.when(kind == "regenerate", seq)).alias("_again"))
    earlier = W.partitionBy("_none", "_conv").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    bounds = turns.withColumn("_void", F.max("_again").over(earlier)).drop("_again")
    never = F.lit(-(1 << 62))
    live = events.join(bounds, keys).where((seq >= F.coalesce("_reset", never)) & (seq > F.coalesce("_void", never)))
    folded = live.groupBy(*keys).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("event")).alias("events"))
    whole = F.aggregate("events", F.lit(-1), lambda at, e: F.when(e["kind"] != "delta", at + 1).otherwise(at))
    last_reset = F.aggregate(F.sequence(F.lit(0), F.size("events") - 1), F.lit(0), lambda at, i: F.when(F.get("events", i)["kind"] != "delta", i).otherwise(at))
    kept = F.slice("events", last_reset + 1, F.size("events"))
    return folded.select(
        "conv_id", "turn", F.when(whole >= 0, F.get("events", last_reset)["role"]).otherwise(F.get("events", F.lit(0))["role"]).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def messages_as_events(messages: DataFrame) -> DataFrame:
    """Whole messages as an event log. A conversation's rows are numbered by turn, then role and text, so that rows with
    one turn, or with none, stay separate messages; rows without a turn come last."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").cast("long").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))) - 1
    return messages.select("conv_id", place.cast("long").alias("seq"), place.cast("long").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def render(messages: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row a conversation: conv_id, n_turns, formatted, loss_spans(piece, start, length) in code points.

    ``piece`` counts the parts between start marks, from 1; ``start`` counts within the part, from 0.
    """
    role = F.replace(template.escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    part = messages.select("conv_id", "turn", role.alias("head"), template.escape(F.col("text")).alias("body"), F.col("role").isin(*template.learnt).alias("learnt"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "head", "body", "learnt")))
    spans = F.transform(
        "turns", lambda t, i: F.struct((i + 1).alias("piece"), (F.char_length(t["head"]) + 1).alias("start"), F.when(t["learnt"], F.char_length(t["body"])).alias("length"))
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(template.start), t["head"], F.lit("\n"), t["body"], F.lit(template.end + "\n"))), "")
    return part.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), F.filter(spans, lambda s: s["length"].isNotNull()).alias("loss_spans"))


def parse(rendered: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """What a rendered row holds: ``turns`` (role, text) and ``learnt``, the texts under the mask, all unescaped."""
    plain = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.start)
    pieces = F.split("formatted", plain)
    with_pieces = rendered.withColumn("pieces", F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))))
    tail = len(template.end) + 1

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        start = F.char_length(head) + 2
        body = F.substring(p, start, F.char_length(p) - tail - start + 1)
        # A line feed in a role is a backslash and n; other backslashes there are doubled.
        parts = F.transform(F.split(head, "\\\\\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
        return F.struct(template.unescape(F.array_join(parts, "\\\\")).alias("role"), template.unescape(body).alias("text"))

    learnt = F.transform("loss_spans", lambda s: template.unescape(F.substring(F.get("pieces", s["piece"] - 1), s["start"] + 1, s["length"])))
    return with_pieces.withColumn("turns", F.transform("pieces", turn)).withColumn("learnt", learnt).drop("pieces")


def format_chats(log: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Event log to rendered conversations."""
    return render(fold_events(log), template)


def digest(parsed: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    return parsed.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
