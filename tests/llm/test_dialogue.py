import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casevane.llm import dialogue

FORM = re.compile(r"(s?(ua)+)?")
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def choices(row, fault):
    """(cost, label, rows that come out)."""
    role, text = row
    yield 2, "D", []
    if fault not in ("blank", "duplicate"):
        more = 5 * (fault == "truncated")
        yield more, "K", [(role, text)]
        for r in NAMES.values():
            yield 1 + more, "R", [(r, text)]


def by_enumeration(rows):
    best = None
    inserts = [(5 * len(w), "I" * len(w), [(NAMES[c], "") for c in w]) for w in ("", "u", "a", "ua", "au")]
    options = []
    for row, fault in zip(rows, faults(rows)):
        options += [inserts, list(choices(row, fault))]
    for pick in itertools.product(*options, inserts):
        out = [r for p in pick for r in p[2]]
        if FORM.fullmatch("".join(r[0][:1] for r in out)):
            found = (sum(p[0] for p in pick), "".join(p[1] for p in pick), out)
            best = found if best is None or found[:2] < best[:2] else best
    return best


def from_the_end(rows):
    """Least (cost, labels, lines) of each suffix and grammar state, labels compared as whole strings."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    marks = faults(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts:
            for c, name in NAMES.items():
                if (state, c) in step and (rest := best(i, step[state, c], inserts - 1)):
                    found.append((rest[0] + 5, "I" + rest[1], ((name, ""), *rest[2])))
        if i < len(rows):
            for cost, label, out in choices(rows[i], marks[i]):
                to = state if not out or not out[0][0] else step.get((state, out[0][0][:1]))
                if to is not None and (rest := best(i + 1, to, 3)):
                    found.append((rest[0] + cost, label + rest[1], (*out, *rest[2])))
        return min(found, key=lambda f: f[:2], default=None)

    for i in range(len(rows), -1, -1):
        for s in ("", "s", "u", "a"):
            best(i, s, 3)
    return best(0, "", 3)


def through_the_machines(rows):
    r, seen = dialogue.Repair(), set()
    for role, text in rows:
        r.read(role, text, dialogue.fault_of(text, (role, text) in seen))
        seen.add((role, text))
    return r.finish()


def digest(out):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", " ", ""]), st.sampled_from(["Fine.", "cut", "", " \x0b", "More?", "x\x1c", "Two!\n"]))


@settings(max_examples=40, deadline=None)
@given(st.lists(ROW, max_size=3))
def test_against_all_edit_sequences(rows):
    cost, labels, out = by_enumeration(rows)
    assert from_the_end(rows)[:2] == (cost, labels)
    assert through_the_machines(rows) == (cost, labels, digest(out))


@settings(max_examples=300, deadline=None)
@given(st.lists(ROW, max_size=14))
def test_against_least_suffixes(rows):
    cost, labels, out = from_the_end(rows)
    assert FORM.fullmatch("".join(r[:1] for r, _ in out))
    assert through_the_machines(rows) == (cost, labels, digest(out))


def test_long_conversation():
    r = random.Random(3)
    rows = [(r.choice(["user", "assistant", "system"]), r.choice(["A.", "b", ""]) + str(r.randint(0, 400)) + r.choice(".?x")) for _ in range(700)]
    cost, labels, out = from_the_end(rows)
    assert through_the_machines(rows) == (cost, labels, digest(out))
    many = dialogue.Repair()
    for i in range(30_000):
        many.read("user" if i % 2 == 0 else "assistant", "Yes.", 0)
        assert all(len(dialogue._told(p.labels)) < 4096 for p in many.at.values() if i % 1000 == 0)
    assert many.finish()[:2] == (0, "K" * 30_000)


def slow_damaged(rows):
    """The whole contract over (conv, turn, role, text)."""
    told = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = told(role), told(text)
        fate = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        mine += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    table = set()
    for conv, mine in out.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        marks = faults([r[1:] for r in mine])
        turns = {r[0] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, labels, lines = from_the_end([r[1:] for r in mine])
        table.add((conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, labels, digest(lines)))
    return table


def test_conversations(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", "system", None]), r.choice(["Good day.", "And then", "", None, "Why?", "Same."])) for c in range(120) for t in range(r.randint(1, 9)) if r.random() < 0.9]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (7, None, "user", "Hi."), (7, None, None, "Hi."), (500, 3, "user", "Twice."), (500, 3, "user", "Twice."), (501, None, "user", "x" * 200_000)]
    rows += [(502, -(1 << 40), "user", "a."), (502, 1 << 40, "assistant", "b.")]
    lone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(lone, 1, "user", "Only row.")]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, copies int")
    got = dialogue.repair_damaged(frame.repartition(5))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    table = list(map(tuple, got.collect()))
    assert len(table) == len(set(table)) and set(table) == slow_damaged(rows)
    assert (lone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in table
    assert dialogue.repair_damaged(frame.limit(0)).collect() == []


def test_repair_without_damage(spark):
    rows = [("c", 0, "user", "Hi."), ("c", 1, "user", "Still there?"), ("c", 2, "user", "Hi.")]
    got = dialogue.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).first()
    assert (got.audit, got.cost, got.duplicate, got.illegal) == ("KRD", 3, 1, 2)
    assert got.repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Still there?").hexdigest()
