"""Operator 4: quality statistics and a learned decision list. DataFrame functions only on the rows' path.

Words are runs of characters other than blank and U+0009 to U+000D. The statistics of a text come from one row's
own columns: no shuffle. The decision list is learned by sequential covering (grow a conjunction of thresholds on
one part of the labelled rows, prune it on the other, keep it if it stays precise, remove what it covers, repeat)
and becomes an ordered chain of Spark conditional expressions.

Edge cases: a null or empty text has no words and all counts 0, so the base rule rejects it; labels that are null,
or of documents that aren't there, are ignored; a document labelled both ways counts as good; without labels the
list is empty and the base rules decide alone; repeated rows are judged alike; other columns are kept, and names that would be overwritten refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: The labelled rows that a fit may use at most, taken by the hash of their id: the bound on what the driver holds.
FIT_ROWS = 8_000
#: Statistics that conditions may use; shares are of words or of characters in words.
FEATURES = ("symbol_rate", "upper_rate", "bang_rate", "repeat_share", "dup_line_share", "word_length", "pipe_rate", "n_words")

#: Columns that ``statistics`` and ``judge`` add, after the prefix.
ADDED = (
    *FEATURES, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_pipes", "base_failed", "rule", "kept",
)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return let(F.btrim(text, F.lit(SPACES)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def count_of(text: Column, others: str) -> Column:
    """Code points of ``text`` outside the class of ``others``."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("long")


def repeated_windows(hashes: Column, width: int = 3) -> Column:
    """Positions covered by windows of ``width`` that occur twice or more, the first included; windows are compared by
    the 64-bit hash of their words' 64-bit hashes. Sorting brings equal windows together: n log n for any text."""
    n = F.size(hashes)
    # get() is null beyond the end, and such windows are dropped
    keyed = F.transform(hashes, lambda h, i: F.struct(F.xxhash64(h, *(F.get(hashes, i + d) for d in range(1, width))).alias("k"), i.alias("i")))
    whole = F.slice(keyed, F.lit(1), F.greatest(n - (width - 1), F.lit(0)))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, i: (x["k"] == F.get(s, i + 1)["k"]) | (x["k"] == F.get(s, i - 1)["k"]))

    covered = let(F.sort_array(whole), lambda s: F.transform(twice(s), lambda x: F.sequence(x["i"], x["i"] + (width - 1))))
    return F.when(n < width + 1, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(covered)))).cast("long")


def statistics(df: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with the five base counts and the further statistics of ``FEATURES`` (names get ``prefix``).

    The counts come out of a generator of one row, which a later filter on them can't be pushed through: each is
    computed once a text, however often it is used. One pass leaves the characters that are counted, others count in these.
    """
    if clash := {c.lower() for c in df.columns} & {f"{prefix}{n}".lower() for n in (*ADDED, *(f"_quality_{k}" for k in "wlmn"))}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten: choose another prefix, or carry the rest of a row as a struct")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D#*$%&|<>!\p{Lu}]+", "")
    counts = F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("all"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_windows(h)).alias("again"))).alias(f"{prefix}_quality_w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias(f"{prefix}_quality_l"),
        let(marks, lambda m: F.struct(
            count_of(m, r"[^\x20\x09-\x0D]+").alias("space"), count_of(m, r"[^#*$%&|<>]+").alias("symbols"), count_of(m, r"[^!]+").alias("bangs"),
            count_of(m, r"[^|]+").alias("pipes"), count_of(m, r"[^\p{Lu}]+").alias("upper"),
        )).alias(f"{prefix}_quality_m"),
        F.char_length(text).cast("long").alias(f"{prefix}_quality_n"),
    )
    found = df.select("*", F.inline(F.array(counts)))
    w, l, m = (lambda name, part=part: F.col(f"{prefix}_quality_{part}")[name] for part in "wlm")
    out = found.withColumns({
        f"{prefix}n_words": w("all"), f"{prefix}word_chars": F.col(f"{prefix}_quality_n") - m("space"), f"{prefix}n_symbols": m("symbols"),
        f"{prefix}n_dup_lines": l("again"), f"{prefix}n_repeat_words": w("again"), f"{prefix}n_lines": l("all"),
        f"{prefix}n_upper": m("upper"), f"{prefix}n_bangs": m("bangs"), f"{prefix}n_pipes": m("pipes"),
    }).drop(*(f"{prefix}_quality_{part}" for part in "wlmn"))
    n, chars = F.greatest(F.col(f"{prefix}n_words"), F.lit(1)), F.greatest(F.col(f"{prefix}word_chars"), F.lit(1))
    return out.withColumns({
        f"{prefix}symbol_rate": F.col(f"{prefix}n_symbols") / n, f"{prefix}upper_rate": F.col(f"{prefix}n_upper") / chars,
        f"{prefix}bang_rate": F.col(f"{prefix}n_bangs") / n, f"{prefix}pipe_rate": F.col(f"{prefix}n_pipes") / n,
        f"{prefix}repeat_share": F.col(f"{prefix}n_repeat_words") / n, f"{prefix}word_length": F.col(f"{prefix}word_chars") / n,
        f"{prefix}dup_line_share": F.col(f"{prefix}n_dup_lines") / F.greatest(F.col(f"{prefix}n_lines"), F.lit(1)),
    })


@dataclass(frozen=True)
class Rule:
    """Reject if every (feature, is at least, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, row: dict[str, float]) -> bool:
        return all((row[f] >= t) if up else (row[f] < t) for f, up, t in self.conditions)

    def expression(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for f, up, t in self.conditions:
            out = out & ((F.col(prefix + f) >= t) if up else (F.col(prefix + f) < t))
        return out


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    """FOIL's gain of narrowing a rule from (p0, n0) covered bad and good rows to (p, n)."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else -1.0


def _grow(rows: list[tuple[dict, bool]], longest: int, cuts: int) -> Rule:
    conditions: list[tuple[str, bool, float]] = []
    while len(conditions) < longest and any(not bad for _, bad in rows):
        p0 = sum(bad for _, bad in rows)
        best = (0.0, None)
        for f in FEATURES:
            ordered = sorted((r[f], bad) for r, bad in rows)
            step, seen = max(1, len(ordered) // cuts), 0
            for k in range(1, len(ordered)):
                seen += ordered[k - 1][1]
                if ordered[k][0] == ordered[k - 1][0] or (k % step and ordered[k][1] == ordered[k - 1][1]):
                    continue
                cut = (ordered[k][0] + ordered[k - 1][0]) / 2
                for up, p, size in ((True, p0 - seen, len(ordered) - k), (False, seen, k)):
                    if (g := _gain(p0, len(rows) - p0, p, size - p)) > best[0]:
                        best = (g, (f, up, cut))
        if best[1] is None:
            break
        conditions.append(best[1])
        rows = [x for x in rows if Rule((best[1],)).covers(x[0])]
    return Rule(tuple(conditions))


def _prune(rule: Rule, rows: list[tuple[dict, bool]]) -> tuple[Rule, int, int]:
    """The shortest head of the rule with the highest (bad - good) / (bad + good) on rows it wasn't grown on."""
    best, value = (rule, 0, 0), -2.0
    for k in range(1, len(rule.conditions) + 1):
        head = Rule(rule.conditions[:k])
        hit = [bad for r, bad in rows if head.covers(r)]
        p, n = sum(hit), len(hit) - sum(hit)
        if hit and (p - n) / (p + n) > value:
            best, value = (head, p, n), (p - n) / (p + n)
    return best


def learn(rows: list[tuple[dict[str, float], bool]], precision: float = 0.98, support: int = 3, longest: int = 4, most: int = 12, cuts: int = 40) -> list[Rule]:
    """Sequential covering on (statistics, is bad); every third row is for pruning. Keeps only rules that on all rows
    left are right at least ``precision`` of the time, for ``support`` rows at least."""
    rules: list[Rule] = []
    while len(rules) < most and sum(bad for _, bad in rows) >= support:
        grow, test = [x for i, x in enumerate(rows) if i % 3], rows[::3]
        if not any(bad for _, bad in grow):
            break
        grown = _grow(grow, longest, cuts)
        for rule in (_prune(grown, test)[0], grown):  # a head that pruning made too wide gives way to the whole
            hit = [bad for r, bad in rows if rule.covers(r)]
            if rule.conditions and support <= sum(hit) and precision * len(hit) <= sum(hit):
                break
        else:
            break
        rules.append(rule)
        rows = [x for x in rows if not rule.covers(x[0])]
    return rules


def base_failed(prefix: str = "") -> Column:
    """Too short, or over half of its words in repeated windows."""
    return (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from at most ``fit_rows`` labelled documents (label 0: bad), those that the base rules fail left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    # Hashes thin the labels to about the bound where they are, so that no task sends more than its share of it.
    share = min(1.0, 0.95 * fit_rows / max(1, known.count()))
    thinned = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else known
    sample = thinned.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    ids = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    stats = statistics(ids.join(F.broadcast(sample), "_id")).where(~base_failed()).select("_id", "_label", *FEATURES)
    found = stats.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).collect()
    return learn([({f: float(r[f]) for f in FEATURES}, r["_label"] == 0) for r in found])


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list: the first rule that holds, from 1, or 0 for none."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.expression(prefix), k) if out is None else out.when(rule.expression(prefix), k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(documents: DataFrame, rules: list[Rule], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``documents`` with the statistics, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    out = statistics(documents, text_col, prefix)
    out = out.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}rule", verdict(rules, prefix))
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}rule") == 0))
