"""Conversation repair: the search against every possible edit, the operator against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from precis.llm import conversation_repair as R

PATTERN = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(turns):
    """(cost, audit, roles) of the best of all edits, with up to two insertions between turns."""
    best = None
    for letters in itertools.product(*[["D"] if t[1] else ["D", "K", "R"] for t in turns]):
        for gaps in itertools.product(["", "I", "II"], repeat=len(turns) + 1):
            audit = gaps[0] + "".join(x + "D" * t[3] + g for x, t, g in zip(letters, turns, gaps[1:]))
            cost = 5 * sum(map(len, gaps)) + sum(
                2 * t[3] + {"D": 2, "K": 0, "R": 1}[x] + (5 if x != "D" and t[2] else 0) for x, t in zip(letters, turns))
            if best and (cost, audit) >= best:
                continue
            slots = ["?"] * len(gaps[0])
            for x, t, g in zip(letters, turns, gaps[1:]):
                slots += [] if x == "D" else [t[0] if x == "K" else "?"]
                slots += ["?"] * len(g)
            fits = [(start + "ua" * len(slots))[:len(slots)] for start in ("", "s")]
            if any(PATTERN.match(f) and all(a == "?" and b != "s" or a == b for a, b in zip(slots, f)) for f in fits):
                best = cost, audit
    return best


def test_search_against_every_repair():
    rng = random.Random(4)
    for _ in range(120):
        turns = [(rng.choice("suaa u"), rng.random() < 0.2, rng.random() < 0.2, rng.choice([0, 0, 0, 1])) for _ in range(rng.randint(0, 4))]
        want = every_repair(turns)
        assert R.cheapest_repair(turns) == want
        size = rng.randint(1, 3)
        parts = [turns[i:i + size] for i in range(0, len(turns), size)] or [[]]
        cost, chain = R.chain_repairs([R.segment_repairs(p, False) for p in parts])
        assert (cost, "".join(audit for _, audit in chain)) == want


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [] if lot == 0 else [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def plain(rows, damaged):
    """Per conversation: the contract, row by row, with dynamic programming over (cost, audit, lines)."""
    blank_of = lambda t: not re.search(r"[^\x20\x09-\x0D]", t)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        numbers = {r[1] for r in mine if r[1] is not None}
        sums = {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, "blank": 0, "duplicate": 0, "truncated": 0,
                "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))}
        seen, best = set(), {"": (0, "", [])}

        def offer(states, state, value):
            if state not in states or (value[0], value[1]) < states[state][:2]:
                states[state] = value

        def inserted(states):
            for _ in range(2):
                for state, (cost, audit, lines) in list(states.items()):
                    to = "a" if state == "u" else "u"
                    offer(states, to, (cost + 5, audit + "I", lines + [("assistant:" if to == "a" else "user:")]))
            return states

        best = inserted(best)
        for _, _, role, text in mine:
            gone = True
            if blank_of(text):
                sums["blank"] += 1
            elif (role, text) in seen:
                sums["duplicate"] += 1
            else:
                gone = False
            cut = not gone and text.rstrip(" \t\n\r\x0b\x0c")[-1] not in ".!?"
            sums["truncated"] += cut
            seen.add((role, text))
            now = {}
            for state, (cost, audit, lines) in best.items():
                offer(now, state, (cost + 2, audit + "D", lines))
                if gone:
                    continue
                to, extra = ("a" if state == "u" else "u"), 5 if cut else 0
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    offer(now, role[:1], (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                offer(now, to, (cost + 1 + extra, audit + "R", lines + [("assistant:" if to == "a" else "user:") + text]))
            best = inserted(now)
        cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])
        out[conv] = {**sums, "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def operator_rows(spark, rows, segment):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("_row", F.lit("clash")).withColumn("place", F.lit(1))
    repairs = R.repair_conversations(R.damaged(table), segment=segment)
    digests = {r.conv_id: r.repaired_sha256 for r in R.conversation_digests(repairs.turns).collect()}
    none = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: {**{k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")},
                        "sha": digests.get(r.conv_id, none)} for r in repairs.conversations.collect()}


def odd_rows():
    rng = random.Random(9)
    texts = ["Fine.", "Cut off", "", None, " \t\n", "Again!", "é?\x0b ", "x" * 70_000 + ".", "Why? \x85"]
    roles = ["user", "assistant", "system", "unknown", None, "", "Sys"]
    rows = []
    for conv in [None, 1, 2, 3, 4, 5, 6, 7]:
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts[:2] * 3 + texts)))
    rows += [(8, 1, "user", "Same.")] * 9 + [(9, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(60)]
    return rows


@pytest.mark.parametrize("segment", [4096, 7])
def test_operator_against_plain_python(spark, segment):
    rows = odd_rows()
    changed = damage(rows)
    want = plain(rows, changed)
    got = operator_rows(spark, rows, segment)
    assert set(got) == {r[0] for r in changed}
    assert got == {k: v for k, v in want.items() if k in got}
    for conv in set(want) - set(got):  # every row dropped
        assert want[conv]["cost"] == 0 and want[conv]["audit"] == ""


def test_turns_that_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 3, "user", "Cut"), (1, 4, "assistant", "Yes.")]
    repairs = R.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert [(r.place, r.role, r.text) for r in repairs.turns.orderBy("place").collect()] == [
        (0, "system", "Be kind."), (1, "user", "Hi?"), (2, "assistant", "Yes.")]
    row = repairs.conversations.first()
    assert tuple(row) == (1, 1, 0, 1, 1, 2, 4, "KKDDK")


def test_empty_table(spark):
    repairs = R.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert repairs.conversations.collect() == [] and repairs.turns.collect() == []
    assert R.conversation_digests(repairs.turns).collect() == []


def test_a_hot_conversation_is_searched_in_segments(spark):
    table = spark.range(9000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("Turn "), "id", F.lit(".")).alias("text"))
    row = R.repair_conversations(table, segment=1000).conversations.first()
    assert (row.cost, row.audit) == (0, "K" * 9000)
