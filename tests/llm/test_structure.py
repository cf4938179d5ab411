"""Conversation repair against a plain dynamic programme, and on nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from carrierlab.llm import structure

WORD = re.compile(r"[^\x20\x09-\x0d]")
DELTA = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_best(rows):
    """Cheapest (cost, audit, repaired rows) of (role, text, fault) rows, by a forward programme on whole strings."""
    def closed(best):
        for _ in range(2):
            for state in ("", "s", "u", "a"):
                if state in best:
                    cost, audit, made = best[state]
                    to = "a" if state == "u" else "u"
                    new = (cost + 3, audit + "I", [*made, ("user" if to == "u" else "assistant", "")])
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
        return best

    best = closed({"": (0, "", [])})
    for role, text, fault in rows:
        now = {}

        def offer(state, new, now=now):
            if state not in now or new[:2] < now[state][:2]:
                now[state] = new

        for state, (cost, audit, made) in best.items():
            offer(state, (cost + 4, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (state, role[:1]) in DELTA:
                offer(DELTA[state, role[:1]], (cost + more, audit + "K", [*made, (role, text)]))
            to = "a" if state == "u" else "u"
            offer(to, (cost + more + 3, audit + "R", [*made, ("user" if to == "u" else "assistant", text)]))
        best = closed(now)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def plain_report(table):
    damaged, ids = {}, {c for c, *_ in table}
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        damaged.setdefault(conv, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv in ids:
        rows = sorted(damaged.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows:
            signs = WORD.findall(text)
            faults.append("blank" if not signs else "duplicate" if (role, text) in seen
                          else "" if signs[-1] in ".!?" else "truncated")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        cost, audit, made = plain_best([(r, x, f) for (_, r, x), f in zip(rows, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def conversations():
    rng = random.Random(6)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "why", "ok?", " \n", "", None, "Zoë é.", "end. \t", "a\x00b", "Long " * 3000 + "."]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Say {turn}."))
    rows += [(200, None, "user", f"N {i}.") for i in range(4)] + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    rows += [(201, 5, "user", "Same.")] * 3 + [(201, 5, "assistant", "Same."), (202, -3, "user", "x"), (202, 9, "user", "y.")]
    rows += [(300, i, ("user", "assistant")[i % 2], f"T {i}" + "." * (i % 3)) for i in range(700)]
    # All dropped: crc32("c:0") % 20 == 0.
    alone = next(c for c in range(400, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (alone, 0, "user", "Gone.")]


def test_report_is_exact(spark, monkeypatch):
    monkeypatch.setattr(structure, "PIECE", 64)
    rows = conversations()
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows],
                                  "conv_id long, turn long, role string, text string, cost int, audit string")
    got = {r.conv_id: tuple(r)[1:] for r in structure.report(frame).collect()}
    want = plain_report(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


def test_auction_in_blocks():
    rng = random.Random(9)
    names = ("system", "user", "assistant", "tool")
    faults = ("", "blank", "duplicate", "truncated")
    for _ in range(400):
        n = rng.randint(0, 14)
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n))
        want = plain_best([(names[c % 4], "", faults[c // 4]) for c in codes])[:2]
        for block in (1, 3, 64):
            assert structure.cheapest_edits(codes, block) == want
    long = bytes([1, 2] * 20000 + [2] * 30000)
    assert structure.cheapest_edits(long) == (45000, "K" * 40000 + "RK" * 15000)


def test_repaired_rows(spark):
    frame = spark.createDataFrame(
        [(1, 0, "assistant", "Hi."), (1, 1, "user", "Go."), (1, 1, "user", "Go."), (1, 2, "user", "And?")],
        "conv_id long, turn long, role string, text string").selectExpr("*", "false AS dropped")
    turns, found = structure.repair(frame)
    row = found.first()
    cost, audit, made = plain_best(
        [("assistant", "Hi.", ""), ("user", "Go.", ""), ("user", "Go.", "duplicate"), ("user", "And?", "")])
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (1, 2, cost, audit)
    assert [(r.role, r.text) for r in turns.orderBy("position").collect()] == made
    roles = [r.role for r in turns.orderBy("position").collect()]
    assert roles == ["user", "assistant"] * (len(roles) // 2)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert structure.report(empty).count() == 0
