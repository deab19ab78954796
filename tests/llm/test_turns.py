import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from harrow.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, part int, c string, audit string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(turns.BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """By trying every sequence of edits, from the last row to the first."""
    found, known = faults(rows), {}

    def best(i, state):
        if (i, state) in known:
            return known[i, state]
        known[i, state] = (10**9, "", ())  # a loop of inserts is never cheapest
        ways = [(0, "", ())] if i == len(rows) and state in "ea" else []
        for c, full in (("u", "user"), ("a", "assistant")):
            if state == "u" if c == "a" else state in "esa":
                cost, audit, lines = best(i, c)
                ways.append((cost + 2, "I" + audit, (full + ":", *lines)))
                if i < len(rows) and found[i] in ("", "truncated"):
                    cost, audit, lines = best(i + 1, c)
                    ways.append((cost + 2 + (found[i] != ""), "R" + audit, (f"{full}:{rows[i][1]}", *lines)))
        if i < len(rows):
            c = rows[i][0][:1]
            cost, audit, lines = best(i + 1, state)
            ways.append((cost + 3, "D" + audit, lines))
            if found[i] in ("", "truncated") and c and (c == "s" and state == "e" or c == "u" and state in "esa" or c == "a" and state == "u"):
                cost, audit, lines = best(i + 1, c)
                ways.append((cost + (found[i] != ""), "K" + audit, (":".join(rows[i]), *lines)))
        known[i, state] = min(ways, default=(10**9, "", ()))
        return known[i, state]

    best(0, "e")
    # inserts lead back to a state still being worked out: walk such states again until nothing gets cheaper
    while True:
        before = dict(known)
        for i, state in sorted(known, reverse=True):
            del known[i, state]
            old = before[i, state]
            new = best(i, state)
            known[i, state] = min(old, new)
        if known == before:
            return known[0, "e"]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r, x) for c, t, r, x in damaged(rows) if c == conv), key=lambda t: (t[0] is not None, t[0] or 0, hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        of = [r[1:] for r in mine]
        found, numbers = faults(of), [t for t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(of))
        cost, audit, lines = cheapest(of)
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made_up(rnd, convs, longest):
    rows = []
    for conv in range(convs):
        for turn in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["yes.", "No!", "open end", " \t\n", "", None, f"answer {turn}.", f"Frage {turn}? ", "ß。", "end.\x85", "a. \x0b"])
            rows.append((conv if conv else None, rnd.choice([turn, turn, turn + 2, None]), role, text))
    return rows + rnd.choices(rows, k=len(rows) // 6)


def test_repair_equals_all_edit_sequences(spark):
    rows = made_up(random.Random(3), 60, 7)
    assert got(turns.repaired_digests(table(spark, rows))) == expected(rows)


def test_blocks_and_ranges_compose(spark, monkeypatch):
    """Small blocks and split ranges: a conversation that holds most rows is folded in parts."""
    monkeypatch.setattr(turns, "BLOCK", 3)
    rnd = random.Random(8)
    rows = made_up(rnd, 6, 5) + [(77, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["ok.", f"t {t}.", f"open {t}"])) for t in range(90)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = turns.flagged(turns.light_rows(turns.prepared(table(spark, rows))))
        assert dealt.where("conv = 77").select("part").distinct().count() > 1
        assert got(turns.repaired_digests(table(spark, rows).repartition(3))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Q?"), (1, 2, "user", "More?"), (2, 0, "system", "Rules."), (3, 0, "user", "")]
    out = {}
    for r in turns.repair(table(spark, rows)).collect():
        out.setdefault(r.conv_id, []).append((r.pos, r.role, r.text, r.edit))
    assert out == {1: [(0, "user", "", "I"), (1, "assistant", "Hello.", "K"), (2, "user", "Q?", "K"), (3, "assistant", "More?", "R")]}
    kept = {r.conv_id: (r.cost, r.audit) for r in turns.structure(table(spark, rows)).collect()}
    assert kept == {1: (4, "IKKR"), 2: (3, "D"), 3: (3, "D")}


@pytest.mark.parametrize("turn", [None, 4])
def test_one_text_repeated_in_one_turn(spark, turn):
    rows = [(5, turn, "user", "again?")] * 700 + [(5, 9, "assistant", "Yes.")]
    want = expected(rows)
    assert got(turns.repaired_digests(table(spark, rows))) == want


def test_empty_table(spark):
    assert turns.repaired_digests(table(spark, [])).collect() == []
    assert turns.repair(table(spark, [])).collect() == []


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "end?"), (1, 1, "assistant", "A" * 3_000_000 + ".")]
    assert got(turns.repaired_digests(table(spark, rows))) == expected(rows)


def test_columns_of_damage(spark):
    rows = made_up(random.Random(9), 30, 6)
    mine = sorted(map(repr, damaged(rows)))
    assert sorted(repr(tuple(r)) for r in turns.damage(table(spark, rows)).select("conv_id", "turn", "role", "text").collect()) == mine
    assert turns.damage(table(spark, rows)).where(F.col("role").isNull()).isEmpty()
