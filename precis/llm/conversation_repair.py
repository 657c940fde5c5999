"""Conversation structure repair: the cheapest edits that make turns alternate.

A repaired conversation is empty, or an optional system turn and then user and
assistant turns in turn, ending with an assistant's. Edits: keep a turn (0), give it
the role that fits (1), delete it (2; blank turns and repeats have to go), insert an
empty turn (5); a truncated turn that stays costs 5 more. Of the cheapest repairs the
one whose audit, the initials of its edits in order, comes first in ASCII is taken.

The search is depth-first branch-and-bound with an explicit stack: nodes are
(turns used, last role given). The least cost of the turns to come, from each last
role, bounds a node from below; the incumbent is the best (cost, audit) so far; a
table holds the least cost at which each node has been entered, and prefixes that
come to it later at no less are dropped. Children are entered by bound, then by
letter, so that of equal costs the first audit is met first. The stack runs empty
when the incumbent is proved.

Long conversations are cut into segments that are searched in separate tasks, once
for each pair of roles at their ends; the pairs are then chained. Texts take no part
in this: rows travel as flags, and texts meet the edits by row number at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from precis.llm.common import ASCII_SPACE, quoted
from precis.operators.ids import global_index, join_per_group
from precis.session import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Distinct turns of a segment.
SEGMENT = 4096

#: Last role given: none yet, system, user, assistant; ``NEXT`` is what an edit may give after each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ACCEPTED = (START, ASSISTANT)
NAMES = (None, "system", "user", "assistant")
_INF = float("inf")

#: A turn for the search: initial (s, u, a or other), must go, truncated, further copies that have to go.
Turn = tuple[str, bool, bool, int]


def _after(initial: str, state: int) -> int | None:
    """The state after a turn that is kept, or None where it doesn't fit."""
    if initial == "s":
        return SYSTEM if state == START else None
    want = "a" if state == USER else "u"
    return NEXT[state] if initial == want else None


def _edits(turn: Turn, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what may be done with a turn, its copies deleted with it."""
    initial, must, truncated, copies = turn
    rest = DELETE * copies
    out = [("D", DELETE + rest, state)]
    if not must:
        stay = rest + (TRUNCATED if truncated else 0)
        kept = _after(initial, state)
        if kept is not None:
            out.append(("K", KEEP + stay, kept))
        out.append(("R", REROLE + stay, NEXT[state]))
    return out


def suffix_bounds(turns: list[Turn], ends: tuple[int, ...]) -> list[list[float]]:
    """The least cost of the turns from each on, by last role, if they end in one of ``ends``."""
    base = [0.0 if s in ends else _INF for s in range(4)]
    out = []
    for turn in [None, *reversed(turns)]:
        if turn is not None:
            after = out[-1]
            base = [min(cost + after[to] for _, cost, to in _edits(turn, s)) for s in range(4)]
        user = min(base[USER], INSERT + base[ASSISTANT])
        out.append([min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user,
                    min(base[ASSISTANT], INSERT + base[USER])])
    return out[::-1]


def cheapest_repair(turns: list[Turn], start: int = START, ends: tuple[int, ...] = ACCEPTED,
                    bounds: list[list[float]] | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest repair from ``start`` to one of ``ends``, of equal ones the
    ASCII-least; None if there is none. No turns: nothing to do, or insertions only."""
    bounds = bounds or suffix_bounds(turns, ends)
    if bounds[0][start] == _INF:
        return None
    incumbent: tuple[float, str] = (_INF, "")
    entered: dict[tuple[int, int], int] = {}
    stack: list[tuple] = [(0, start, 0, None)]
    while stack:
        at, state, cost, path = stack.pop()
        if cost + bounds[at][state] >= incumbent[0] or entered.get((at, state), _INF) <= cost:
            continue
        entered[at, state] = cost
        if at == len(turns) and state in ends:
            letters = []
            while path is not None:
                path, letter = path
                letters.append(letter)
            incumbent = min(incumbent, (cost, "".join(reversed(letters))))
            continue
        children = [(cost + INSERT, "I", at, NEXT[state])]
        if at < len(turns):
            copies = turns[at][3]
            children += [(cost + more, letter + "D" * copies, at + 1, to) for letter, more, to in _edits(turns[at], state)]
        children = [(c + bounds[i][s], letter, c, i, s) for c, letter, i, s in children if c + bounds[i][s] < incumbent[0]]
        # the most promising child is entered next, of equal ones the first letter
        for _, letter, c, i, s in sorted(children, reverse=True):
            stack.append((i, s, c, (path, letter)))
    return int(incumbent[0]), incumbent[1]


def segment_repairs(turns: list[Turn], alone: bool) -> list[tuple[int, int, int, str]]:
    """(first state, last state, cost, audit) of a whole conversation (last state: any accepted, written
    as -1), or for every pair of states around a segment of one."""
    if alone:
        cost, audit = cheapest_repair(turns)
        return [(START, -1, cost, audit)]
    out = []
    for end in range(4):
        bounds = suffix_bounds(turns, (end,))
        for start in range(4):
            found = cheapest_repair(turns, start, (end,), bounds)
            if found is not None:
                out.append((start, end, *found))
    return out


def chain_repairs(parts: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cheapest chain over consecutive segments: its cost, and of each segment (first state, audit)."""
    best: dict[int, tuple[int, list[tuple[int, str]]]] = {START: (0, [])}
    text = lambda chain: "".join(audit for _, audit in chain)
    for part in parts:
        now: dict[int, tuple[int, list[tuple[int, str]]]] = {}
        for start, end, cost, audit in part:
            if start in best:
                total, chain = best[start][0] + cost, [*best[start][1], (start, audit)]
                if end not in now or total < now[end][0] or (total == now[end][0] and text(chain) < text(now[end][1])):
                    now[end] = total, chain
        best = now
    return min((best[s] for s in (-1, *ACCEPTED) if s in best), key=lambda b: (b[0], text(b[1])))


# ------------------------------------------------------------------------------------------ tasks

_LEGAL = {"su", "ua", "au"}


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first ``keys`` columns, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _schemas(kind: pa.DataType) -> tuple[pa.Schema, pa.Schema]:
    """What a search gives for a segment, and a chain for a conversation (summary rows and edit rows)."""
    longs = [(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal")]
    repair = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    segments = pa.schema([("conv", kind), ("seg", pa.int64()), *longs, ("rows", pa.list_(pa.int64())),
                          ("initials", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("repairs", pa.list_(repair))])
    chains = pa.schema([("conv", kind), *longs, ("cost", pa.int64()), ("audit", pa.string()), ("place", pa.int64()),
                        ("row", pa.int64()), ("role", pa.string())])
    return segments, chains


def _search(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Segments (conv, seg, alone, gaps, row, initial, blank, duplicate, truncated, copies), sorted, to their repairs."""
    for rows in _groups(batches, 2):
        conv, seg, alone, gaps = rows[0][:4]
        turns: list[Turn] = []
        blank = duplicate = truncated = illegal = 0
        for _, _, _, _, _, initial, is_blank, seen, cut, copies in rows:
            if turns and turns[-1][0] + initial not in _LEGAL:
                illegal += 1
            illegal += copies  # a turn and its copy have one initial
            blank += (1 + copies) * is_blank
            duplicate += 0 if is_blank else copies + seen
            truncated += cut and not is_blank and not seen
            turns.append((initial, is_blank or seen, cut, copies))
        repairs = [dict(zip(("start", "end", "cost", "audit"), r)) for r in segment_repairs(turns, alone)]
        values = [conv, seg, gaps, blank, duplicate, truncated, illegal, [r[4] for r in rows], [t[0] for t in turns],
                  [t[3] for t in turns], repairs]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def applied(audit: str, state: int, rows: list[int], initials: list[str], copies: list[int]) -> list[tuple[int | None, str | None]]:
    """What an audit leaves of a segment: (row, or None for an insertion; its new role, or None where it is kept)."""
    out: list[tuple[int | None, str | None]] = []
    at = turn = 0
    while at < len(audit):
        letter, at = audit[at], at + 1
        if letter in "IR":
            state = NEXT[state]
            out.append((None if letter == "I" else rows[turn], NAMES[state]))
        elif letter == "K":
            state = _after(initials[turn], state)
            out.append((rows[turn], None))
        if letter != "I":
            at, turn = at + copies[turn], turn + 1
    return out


def _chain(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The segments of each conversation, in order, to its summary and the turns that stay."""
    for segments in _groups(batches, 1):
        conv, gaps = segments[0][0], segments[0][2]
        cost, chain = chain_repairs([[(r["start"], r["end"], r["cost"], r["audit"]) for r in s[10]] for s in segments])
        sums = [sum(s[i] for s in segments) for i in range(3, 7)]
        for before, after in zip(segments, segments[1:]):
            sums[3] += before[8][-1] + after[8][0] not in _LEGAL
        values = [conv, gaps, *sums, cost, "".join(audit for _, audit in chain), None, None, None]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)
        place = 0
        for segment, (state, audit) in zip(segments, chain):
            stay = applied(audit, state, *segment[7:10])
            columns = [[conv] * len(stay), *[[None] * len(stay)] * 7, list(range(place, place + len(stay))),
                       [r for r, _ in stay], [role for _, role in stay]]
            place += len(stay)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)


# ------------------------------------------------------------------------------------------ operator

@dataclass
class Repairs:
    """``conversations``: id, gaps, blank, duplicate, truncated, illegal, cost, audit; ``turns``: id, place
    (0-based), role and text of what stays or is inserted."""

    conversations: DataFrame
    turns: DataFrame


def _flags(text: Column) -> tuple[Column, Column]:
    """Blank, and truncated: the last character other than white space ends no sentence."""
    end = F.substring(F.rtrim(text, F.lit(ASCII_SPACE)), -1, 1)
    return end == "", ~end.isin(".", "!", "?") & (end != "")


def repair_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", segment: int = SEGMENT) -> Repairs:
    """The cheapest repair of every conversation of ``turns``.

    Rows are taken by turn, nulls first; rows of one turn by role and then by the
    SHA-256 of their text. A null role or text is one space. A row's first fault counts:
    blank, duplicate (role and text of an earlier row), truncated. ``gaps`` are the
    turn numbers missing between the least and the largest, nulls aside. A null id is
    a conversation like any other; repeated rows are duplicates; texts of any length
    travel once, to the turns that stay. No rows give no conversations. Other
    columns are not read."""
    rows = turns.select(
        quoted(id_col).alias("_conv"), quoted(turn_col).alias("_turn"), F.coalesce(quoted(role_col), F.lit(" ")).alias("_role"),
        F.coalesce(quoted(text_col), F.lit(" ")).alias("_text"))
    # repeated rows are one with their number, before anything is grouped by conversation
    rows = rows.groupBy("_conv", "_turn", "_role", "_text").agg((F.count(F.lit(1)) - 1).alias("_copies"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "repair-rows")
    blank, cut = _flags(F.col("_text"))
    facts = written(rows.select("_conv", "_turn", "_role", "_row", "_copies", F.sha2("_text", 256).alias("_hash"),
                                blank.alias("_blank"), cut.alias("_cut")), "repair-facts")
    # of rows with one role and text in several turns, all but those of the first turn were seen before
    when = F.struct(F.col("_turn").isNotNull().alias("n"), F.col("_turn").alias("t"))
    again = facts.groupBy("_conv", "_role", "_hash").agg(F.min(when).alias("_first"), F.count(F.lit(1)).alias("_n"))
    again = written(again.where("_n > 1").select(F.col("_conv").alias("_c"), F.col("_role").alias("_r"),
                                                 F.col("_hash").alias("_h"), "_first"), "repair-repeats")
    same = F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_role") == F.col("_r")) & (F.col("_hash") == F.col("_h"))
    facts = facts.join(again, same, "left").withColumn("_seen", F.coalesce(when > F.col("_first"), F.lit(False)))
    facts = facts.drop("_c", "_r", "_h", "_first")
    placed = written(global_index(facts.withColumn("_none", F.col("_conv").isNull()),
                                  ["_none", "_conv", F.col("_turn").asc_nulls_first(), "_role", "_hash"], "_at"), "repair-order")
    wide = (F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn")).cast("long")
    whole = placed.groupBy("_none", F.coalesce("_conv", F.lit(0).cast(placed.schema["_conv"].dataType)).alias("_key")).agg(
        F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_size"), F.coalesce(wide, F.lit(0)).alias("_gaps"))
    keyed = placed.withColumn("_key", F.coalesce("_conv", F.lit(0).cast(placed.schema["_conv"].dataType)))
    keyed = join_per_group(keyed, whole, ["_none", "_key"], salt_from=[F.col("_at")])
    keyed = keyed.withColumn("_seg", F.floor((F.col("_at") - F.col("_start")) / segment).cast("long"))
    dealt = keyed.repartition("_none", "_key", "_seg").sortWithinPartitions("_none", "_key", "_seg", "_at").select(
        "_conv", "_seg", (F.col("_size") <= segment).alias("alone"), F.col("_gaps"), "_row",
        F.substring("_role", 1, 1).alias("initial"), "_blank", "_seen", "_cut", "_copies")
    segments, chains = _schemas(to_arrow_type(rows.schema["_conv"].dataType))
    found = written(dealt.mapInArrow(lambda b: _search(b, segments), from_arrow_schema(segments)), "repair-segments")
    chained = found.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(
        lambda b: _chain(b, chains), from_arrow_schema(chains))
    chained = written(chained, "repair-chains")
    summary = chained.where("place is null").select(
        F.col("conv").alias(id_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    stay = chained.where("place is not null").select("conv", "place", "row", "role")
    new = stay.where("row is null").select("conv", "place", "role", F.lit("").alias("text"))
    old = stay.where("row is not null").join(rows, F.col("row") == F.col("_row")).select(
        "conv", "place", F.coalesce("role", "_role").alias("role"), F.col("_text").alias("text"))
    return Repairs(summary, old.unionByName(new).withColumnRenamed("conv", id_col))


def conversation_digests(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, ``repaired_sha256``): the digest of each conversation's ``role:text``, joined by line breaks.

    A digest runs over its text in order, so a conversation is one task's stream; only
    the state of the digest is held."""
    kind = repaired.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, held = False, None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([held.hexdigest()])], names=["conv", "repaired_sha256"])

        for batch in batches:
            for now, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if not open_ or now != conv:
                    if open_:
                        yield closed()
                    open_, conv, held = True, now, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
        if open_:
            yield closed()

    rows = repaired.select(quoted(id_col).alias("conv"), "place", "role", "text")
    out = rows.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "role", "text").mapInArrow(
        digests, f"conv {kind.simpleString()}, repaired_sha256 string")
    return out.withColumnRenamed("conv", id_col)


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Faults by the crc32 of ``id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes the marks
    that end sentences, 3 repeats it, 4 makes it the user's. Nulls are one space (a null turn stays null)."""
    space = F.lit(" ")
    ident, turn = quoted(id_col), quoted(turn_col)
    lot = F.crc32(F.concat(F.coalesce(ident.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))) % 20
    text = F.coalesce(quoted(text_col), space)
    rows = turns.select(
        ident.alias(id_col), turn.alias(turn_col), F.when(lot == 4, "user").otherwise(F.coalesce(quoted(role_col), space)).alias(role_col),
        F.when(lot == 1, "").when(lot == 2, F.translate(text, ".!?", "")).otherwise(text).alias(text_col), lot.alias("_lot"))
    twice = F.explode(F.when(F.col("_lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return rows.where("_lot <> 0").select(id_col, turn_col, role_col, text_col, twice).drop("_copy")
