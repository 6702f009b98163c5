"""Operator 13 against every sequence of edits, plain audit strings, and rows in sections."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from gridloom.llm import conversation_repair as R
from gridloom.llm.queries import queries

SHOWN = re.compile(r"[^\x20\x09-\x0D]")
WANTED = re.compile("(s?(ua)+)?")


def damaged(rows):
    """(conv, turn, role, text) with faults, by conversation, in order."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rows in out.items()}


def facts(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        shown = SHOWN.findall(text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "fine")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return faults, [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal]


def plain(rows, faults):
    """Least (cost, audit, lines) by edits one at a time, with whole audits."""
    best = {"": (0, "", ())}

    def grown(best):
        for _ in range(3):
            for have, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if WANTED.fullmatch(have + role[0]) or WANTED.fullmatch(have + role[0] + "a"):
                        one, to = (cost + 5, audit + "I", (*lines, role + ":")), shape(have + role[0])
                        best[to] = min(best.get(to, one), one)
        return best

    def shape(have):
        """Only whether a system row leads alone, and the last one, matter."""
        return have if len(have) < 2 else "ua" if have[-1] == "a" else "u"

    best = grown(best)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for have, (cost, audit, lines) in best.items():
            options = [(have, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more = cost + 5 * (fault == "truncated")
                options += [(have + (n or "-")[:1], more + p, audit + e, (*lines, f"{n}:{text}")) for n, p, e in ((role, 0, "K"), ("user", 1, "R"), ("assistant", 1, "R"))]
            for to, *one in options:
                if to == have or any(WANTED.fullmatch(to + x) for x in ("", "a", "ua")) and len(to) > len(have):
                    one, to = tuple(one), shape(to)
                    after[to] = min(after.get(to, one), one)
        best = grown(after)
    return min(v for k, v in best.items() if WANTED.fullmatch(k))


def expected(rows):
    faults, numbers = facts(rows)
    cost, audit, lines = plain(rows, faults)
    return (*numbers, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_plain_against_every_sequence():
    """Of tiny conversations all edits are listed."""
    rng = random.Random(1)
    for _ in range(60):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["a.", "b", "", "c!"])) for k in range(rng.randrange(4))]
        faults, _ = facts(rows)
        every = []
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            for edits in itertools.product("DKRS", repeat=len(rows)):  # S: the other role
                for roles in itertools.product("ua", repeat=sum(gaps)) if sum(gaps) < 4 else ():
                    kinds, audit, cost, new = "", "", 0, iter(roles)
                    for k, n in enumerate(gaps):
                        kinds += "".join(next(new) for _ in range(n))
                        audit, cost = audit + "I" * n, cost + 5 * n
                        if k < len(rows):
                            e = edits[k]
                            if e != "D":
                                cost += 5 * (faults[k] == "truncated") + 99 * (faults[k] in ("blank", "duplicate"))
                            kinds += {"D": "", "K": rows[k][1][:1] or "-", "R": "u", "S": "a"}[e]
                            audit, cost = audit + e.replace("S", "R"), cost + {"D": 2, "K": 0}.get(e, 1)
                    if WANTED.fullmatch(kinds):
                        every.append((cost, audit))
        assert plain(rows, faults)[:2] == min(every)


def test_sections_compose_to_the_same():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(["a.", "b", "", "c!", "d?", "e."])) for k in range(rng.randrange(30))]
        faults, _ = facts(rows)
        kinds = bytes(4 * ["fine", "truncated", "blank", "duplicate"].index(f) + "suat".index(r[1][0]) for r, f in zip(rows, faults, strict=True))
        cuts = sorted(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(4)))
        parts = [kinds[x:y] for x, y in itertools.pairwise([0, *cuts, len(rows)])]
        tables = []
        for part in parts:
            ends = [R.through(part, s) for s in R.STATES]
            tables.append([held and (held[0] + cost, held[1]) for layer, cost in ends for held in layer])
        cost, states, tail = R.compose(tables)
        audit = "".join("".join(R.read_off(p, *x)) for p, x in zip(parts, itertools.pairwise(states), strict=True)) + "I" * tail
        assert (cost, audit) == plain(rows, faults)[:2]


def test_codes():
    assert all(not b.startswith(a) for a, b in itertools.permutations(R.CODES, 2)) and sorted(R.CODES) == R.CODES


@pytest.mark.parametrize("section", [R.SECTION, 2])
def test_op13(spark, sf, section, monkeypatch):
    """Also with conversations cut into sections of two rows."""
    monkeypatch.setattr(R, "SECTION", section)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = queries()["op13_conversation_repair"](spark, sf)
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(tuple(r) for r in frame.collect()) == sorted((c, *expected(r)) for c, r in damaged(rows).items())


def test_op13_edges(spark):
    rng = random.Random(5)
    rows = [(1, None, "user", "hi."), (1, None, None, None), (1, 3, "assistant", "no end"), (2, None, None, ""), (None, 4, "user", "a."), (None, 5, "assistant", "b."), (3, 1, "", "x."), (4, 1, "user", "q?\x0b\n"), (4, 1, "user", "q?\x0b\n"), (4, 9, "assistant", "ü! ")]
    rows += [(5, rng.randrange(3_000), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "", "yes"]) + (str(rng.randrange(2_000)) + "." if rng.random() < 0.9 else "")) for _ in range(9_000)]
    rows += [(6, 1, "user", "w " * 300_000), (-7, 2, "user", "."), (2**62, -5, "user", "a."), (2**62, 5, "assistant", "a.")]
    frame = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "conv_id long, turn long, role string, text string, part int, seq int, kind string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in R.repair(R.damage(frame), every=frame).collect()}
    wanted = {c: expected(r) for c, r in damaged(rows).items()}
    assert got == wanted
    none = frame.where("conv_id = 77")
    assert R.repair(R.damage(none), every=none).count() == 0
    assert R.repair(none, every=frame.where("conv_id = 3")).collect()[0].audit == ""


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "first."), (1, 1, "user", "question?"), (1, 2, "system", "x"), (2, 0, "system", "be kind."), (2, 1, "user", "hello."), (2, 2, "assistant", "hi.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in R.repaired(R.plan(frame)).collect())
    assert got == [(1, 0, "R", "user", "first."), (1, 1, "R", "assistant", "question?"), (2, 0, "K", "system", "be kind."), (2, 1, "K", "user", "hello."), (2, 2, "K", "assistant", "hi.")]
