import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from spotloom.llm import repair
from spotloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First fault of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(roles, found):
    """Least (cost, audit) over all edits, by the turns of the result: role initials are followed one by one, not by a grammar."""
    best = {"": {(0, "")}}  # initials so far, shortened to what matters: whether a system turn leads, and the last pair's state
    legal = re.compile("s?(ua)*u?")

    def add(to, state, value):
        if legal.fullmatch(state):
            state = re.sub("(ua)+", "ua", state)
            to[state] = {min([*to.get(state, ()), value])}

    def pushed(states):
        for _ in range(3):
            out = dict(states)
            for state, values in states.items():
                for cost, audit in values:
                    for t in "ua":
                        add(out, state + t, (cost + 5, audit + "I"))
            states = out
        return states

    for role, fault in zip(roles, found):
        out = {}
        for state, values in pushed(best).items():
            for cost, audit in values:
                add(out, state, (cost + 2, audit + "D"))
                if fault not in ("blank", "duplicate"):
                    extra = 5 * (fault == "truncated")
                    if role[:1]:
                        add(out, state + role[0], (cost + extra, audit + "K"))
                    for t in "ua":
                        add(out, state + t, (cost + extra + 1, audit + "R"))
        best = out
    return min(v for state, values in pushed(best).items() if re.fullmatch("(s?(ua)+)?", state) for v in values)


def exhaustive(roles, found):
    """Least (cost, audit) over every sequence of edits with at most two turns pushed at a place."""
    found_best = None
    letters = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    gaps = ["", "u", "a", "ua", "au"]
    for edits in product(*letters):
        for pushes in product(gaps, repeat=len(roles) + 1):
            out, audit, cost = pushes[0], "I" * len(pushes[0]), 5 * len(pushes[0])
            for role, edit, fault, push in zip(roles, edits, found, pushes[1:]):
                cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + 5 * (fault == "truncated" and edit != "D") + 5 * len(push)
                out += {"D": "", "K": role[:1] or "?", "R": edit[1:]}[edit[0]] + push
                audit += edit[0] + "I" * len(push)
            if re.fullmatch("(s?(ua)+)?", out) and (found_best is None or (cost, audit) < found_best):
                found_best = cost, audit
    return found_best


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of one conversation in order."""
    found = faults(rows)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = cheapest([r for _, r, _ in rows], found)
    size = len(audit) - audit.count("D")
    out, left = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(left)
        if edit != "D":
            role = row[1] if edit == "K" else ("user", "assistant")[(len(out) - size % 2) % 2]
            out.append(f"{role}:{row[2] if row else ''}")
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def in_order(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def test_parser_against_every_edit():
    rng, stacks = random.Random(2), repair.Stacks()
    assert len(stacks.entries) == 8
    for _ in range(150):
        roles = [rng.choice(["user", "assistant", "system", "tool", ""]) for _ in range(rng.randrange(4))]
        found = [rng.choice(["", "", "blank", "duplicate", "truncated"]) for _ in roles]
        tops = {stacks.root: (0, "")}
        for role, fault in zip(roles, found):
            tops = stacks.turn(tops, role[:1], fault in ("blank", "duplicate"), 5 * (fault == "truncated"))
        assert stacks.end(tops) == exhaustive(roles, found) == cheapest(roles, found), (roles, found)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_a_plain_version(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").collect()
    want = {r.conv_id: [] for r in table}
    for r in table:
        shown = [" " if v is None else str(v) for v in (r.conv_id, r.turn)]
        harm = zlib.crc32(":".join(shown).encode()) % 20
        role, text = ("user" if harm == 4 else r.role or " "), " " if r.text is None else r.text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        want[r.conv_id] += [(r.turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_repair"](spark, f"/root/testdata/{sf}").collect()}
    assert got == {conv: plain(in_order(rows)) for conv, rows in want.items()}
    assert sum(r[5] > 0 for r in got.values()) > len(got) / 4


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_long_conversations_over_many_segments_and_tasks(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_TURNS", segment)
    rng = random.Random(segment)
    texts = ["Yes.", "No", "", " \n", "Why?", "Go on!  ", "cut off"] + [f"text {n}." for n in range(60)]
    rows = []
    for conv, size in [(1, 900), (2, 40), (None, 25), (3, 1), (4, 7), *((n, 5) for n in range(5, 30))]:
        rows += [(conv, rng.choice([None, *range(size)]) if rng.random() < 0.2 else t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(texts)) for t in range(size)]
    rows += [(1, 5, "user", "Yes.")] * 30
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn int, role string, text string, part string, n int").repartition(7)
    parts = repair.repair(table)
    got = {r[0]: tuple(r)[1:] for r in repair.summaries(parts).collect()}
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(tuple(row))
    assert got == {conv: plain(in_order(found)) for conv, found in by.items()}
    for conv in (2, None):
        turns = repair.repaired_turns(parts).where("conv_id IS NULL" if conv is None else f"conv_id = {conv}").orderBy("part", "place").collect()
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == got[conv][-1]


def test_awkward_rows(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, 0, None, None), (1, 1, "user", long), (1, 1, "user", long), (1, 2, "assistant", "ok."), (2, None, "", "?"), (2, None, None, "a."), (None, 3, "system", "b."), (4, 7, "user", "gone.")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    from pyspark.sql import functions as F

    got = {r.conv_id: r for r in repair.summaries(repair.repair(table, F.when(F.col("conv_id") == 4, 0).otherwise(1))).collect()}
    assert (got[1].audit, got[1].cost, got[1].blank, got[1].duplicate) == ("DKDK", 4, 1, 1)
    assert got[1].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:ok.".encode()).hexdigest()
    assert tuple(got[4])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[None].audit == "D" and got[2].gaps == 0
    empty = repair.summaries(repair.repair(table.where("false")))
    assert empty.count() == 0 and empty.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
