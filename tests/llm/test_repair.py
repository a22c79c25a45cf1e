"""Repairs of conversations against all edits there are, in one block and in many, and against the digest of their lines."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from emberlog.llm import repair
from emberlog.llm.repair import Repair, edits_of, lightest, repair_damaged

WHITE = " \t\n\x0b\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(WHITE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def forward(rows, found):
    """Least (cost, audit, lines) by a search from the front over all edits, audits kept whole."""
    best = {(0, ""): {"": (0, ())}}  # (row, state letter) -> audit -> cost, lines
    done = []
    todo = [(0, "", "", 0, ())]
    limit = 3 * len(rows) + 1
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    while todo:
        i, state, audit, cost, lines = todo.pop()
        if cost > limit:
            continue
        if best.get((i, state, audit), limit + 1) <= cost:
            continue
        best[i, state, audit] = cost
        if i == len(rows) and state in ("", "a"):
            done.append((cost, audit, lines))
        name = {"u": "user", "a": "assistant"}[step[state]]
        if audit[-3:] != "III":
            todo.append((i, step[state], audit + "I", cost + 2, (*lines, name + ":")))
        if i < len(rows):
            role, text = rows[i]
            todo.append((i + 1, state, audit + "D", cost + 3, lines))
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                todo.append((i + 1, step[state], audit + "R", cost + 2 + more, (*lines, f"{name}:{text}")))
                if not role or role[0] == step[state] or (not state and role[0] == "s"):
                    todo.append((i + 1, role[:1] or state, audit + "K", cost + more, (*lines, f"{role}:{text}")))
    return min(done)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, pairs = {r[1] for r in own} - {None}, [(r[2], r[3]) for r in own]
        kinds = faults(pairs)
        cost, audit, lines = forward(pairs, kinds) if own else (0, "", ())
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *map(kinds.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed, conversations, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why? \n", "cut off", "cuté", "", " \t", "Yes.", None, "long " * 40 + "."]
    return [(c, rnd.choice([t, t, t, rnd.randint(-3, 9), None]), rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rnd.choice(texts)) for c in [*range(conversations), None] for t in range(rnd.randint(0, most))]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_against_all_edits(spark, block, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = some_rows(block, 40, 5)
    given = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "'x' AS initial", "2 AS __part").repartition(3)
    got = repair_damaged(given)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_repaired_turns_are_what_is_hashed(spark):
    rows = some_rows(9, 30, 8)
    got = Repair(spark.createDataFrame(rows, SCHEMA))
    turns = got.turns().orderBy("key", "part", "at", "nth").collect()
    for r in got.report().collect():
        own = [t for t in turns if t.key == r.key]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in own))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == r.repaired_sha256
        assert [e for e in r.audit if e != "D"] == [t.edit for t in own]


def test_superior_functions_and_ties():
    assert lightest("")[0] == (0, "", 0)
    for letters in map("".join, itertools.product("ABCDEGHJM", repeat=3)):
        cost, audit, end = lightest(letters)[0]
        assert end in (0, 3) and len(audit) - audit.count("I") == 3
        assert len(edits_of(audit, letters, 0)) == 3


def test_hot_conversation_and_no_rows(spark):
    hot = [(7, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(9000)]
    got = repair_damaged(spark.createDataFrame(hot, SCHEMA)).collect()
    own = [(r[2], r[3]) for r in damage(hot)]
    kinds = faults(own)
    letters = "".join(chr(65 + 3 * "sua".index(r[0]) + (2 if k in ("blank", "duplicate") else k == "truncated")) for (r, _), k in zip(own, kinds))
    cost, audit, _ = lightest.__wrapped__(letters)[0]
    assert [(r.cost, r.audit) for r in got] == [(cost, audit)]
    assert repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
