"""Records between delimiters that hold line breaks, from files in splits.

A delimiter of k line breaks is found line by line: a state tells how many of its
lines the latest lines may be, from each place where it may have begun. What a split
does to the state it is entered with can be told for every state at once, so
splits are read side by side:

1. every split gives, for each state, the state it is left with and its cuts;
2. these are chained per file, a row per split: each split's true state, and the
   number of its first record;
3. every split is cut. Records inside it are done; the one that runs in from the
   split before and the one that runs out are pieces, joined by (file, record).

No task holds more of a file than the record that is open. Cuts are those of
``str.split`` on text read with universal line breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.operators.ids import join_per_group
from precis.session import written

#: Names of files whose size says nothing about their text.
COMPRESSED = r"(?i)\.(gz|bz2|zst|zstd|snappy|lz4|deflate|xz)$"
_BREAK = re.compile("\r\n|\r|\n")


class Cutter:
    """Finds a delimiter line by line. Bit p - 1 of a state: the latest p breaks may be its first p."""

    def __init__(self, delimiter: str):
        self.delimiter = delimiter
        first, *middle, last = delimiter.split("\n")
        self.first, self.middle, self.last = first, middle, last
        self.breaks = len(middle) + 1

    def step(self, state: int, line: str) -> tuple[int, bool]:
        """The state after one more line, and whether a delimiter ends in it."""
        cut = bool(state >> (self.breaks - 1)) and line.startswith(self.last)
        after = 0
        if not cut:  # what overlaps a delimiter is no delimiter
            for p, whole in enumerate(self.middle):
                if state >> p & 1 and line == whole:
                    after |= 2 << p
        if line.endswith(self.first) and (not cut or len(line) >= len(self.last) + len(self.first)):
            after |= 1
        return after, cut


def _lines(value: str, ended: bool = True) -> list[str]:
    """The lines of what the scan takes for one; a last one that no break ends may end in ``\\r``."""
    if "\r" not in value:
        return [value]
    return _BREAK.split(value + "\n")[:-1] if ended else _BREAK.split(value)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((file, block), rows of a batch): rows come in file order."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        start = 0
        keys = list(zip(columns[0], columns[1]))
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], [c[start:i] for c in columns[2:]]
                start = i


_EFFECTS = "file string, block long, states array<int>, cuts array<long>, bytes long, size long"


def _effects(batches: Iterator[pa.RecordBatch], cutter: Cutter) -> Iterator[pa.RecordBatch]:
    """What each split does to every state it may be entered with."""
    every = range(1 << cutter.breaks)
    key, states, cuts, total, size = None, [], [], 0, 0

    def row() -> pa.RecordBatch:
        values = ((key[0], pa.string()), (key[1], pa.int64()), (states, pa.list_(pa.int32())), (cuts, pa.list_(pa.int64())),
                  (total, pa.int64()), (size, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["file", "block", "states", "cuts", "bytes", "size"])

    for now, (values, sizes) in _splits(batches):
        if now != key:
            if key is not None:
                yield row()
            key, states, cuts, total, size = now, list(every), [0] * len(every), 0, sizes[0]
        for value in values:
            total += len(value.encode()) + 1
            for line in _lines(value):
                if len(set(states)) == 1:  # soon the first state doesn't matter any more
                    after, cut = cutter.step(states[0], line)
                    states = [after] * len(states)
                    cuts = [c + 1 for c in cuts] if cut else cuts
                    continue
                steps = {s: cutter.step(s, line) for s in set(states)}
                cuts = [c + steps[s][1] for c, s in zip(cuts, states)]
                states = [steps[s][0] for s in states]
    if key is not None:
        yield row()


_ENTRIES = "file string, block long, state int, record long, first boolean, last boolean, ended boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The splits of each file, in order, to the state and record number they are entered with."""
    held: tuple | None = None  # the latest split, until the next one tells whether it is the last
    state = record = total = 0

    def row(last: bool) -> pa.RecordBatch:
        file, block, entered, number, first, size, packed = held
        ended = last and (packed or total == size)
        values = (file, block, entered, number, first, last, ended)
        types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)],
                                          names=["file", "block", "state", "record", "first", "last", "ended"])

    for batch in batches:
        for file, block, states, cuts, size_of, size in zip(*[c.to_pylist() for c in batch.columns]):
            same = held is not None and held[0] == file
            if held is not None:
                yield row(not same)
            if not same:
                state = record = total = 0
            held = (file, block, state, record, not same, size, bool(re.search(COMPRESSED, file)))
            state, record, total = states[state], record + cuts[state], total + size_of
    if held is not None:
        yield row(True)


_PIECES = "file string, record long, block long, whole boolean, closed boolean, value string"


def _cut(batches: Iterator[pa.RecordBatch], cutter: Cutter) -> Iterator[pa.RecordBatch]:
    """Records inside a split, and the pieces of those that reach beyond it."""
    key, entry, state, number, inside, lines, kept = None, None, 0, 0, False, [], None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                          names=["file", "record", "block", "whole", "closed", "value"])

    def feed(line: str, rows: list[tuple]) -> None:
        nonlocal state, number, inside, lines
        state, cut = cutter.step(state, line)
        if not cut:
            lines.append(line)
            return
        at = len(cutter.last)
        text = "\n".join([*lines, line[:at]])
        rows.append((*key_of(), inside, True, text[:-len(cutter.delimiter)] if inside else text))
        number, inside, lines = number + 1, True, [line[at:]]

    def key_of() -> tuple:
        return key[0], number, key[1]

    def finish(rows: list[tuple]) -> None:
        """The last raw line, whose end may be the file's, and the record that is open."""
        if kept is not None:
            for line in _lines(kept, not entry[3] or entry[4]):
                feed(line, rows)
        if entry[3] and entry[4]:
            feed("", rows)
        text = "\n".join(lines)
        if not (entry[3] and inside):
            rows.append((*key_of(), False, False, text))
        elif text:  # nothing after the last delimiter is no record
            rows.append((*key_of(), True, False, text))

    for now, (values, states, records, firsts, lasts, endeds) in _splits(batches):
        rows: list[tuple] = []
        if now != key:
            if key is not None:
                finish(rows)
            key, entry = now, (states[0], records[0], firsts[0], lasts[0], endeds[0])
            state, number, inside, lines, kept = states[0], records[0], firsts[0], [], None
        for value in values:
            if kept is not None:
                for line in _lines(kept):
                    feed(line, rows)
            kept = value
        yield out(rows)
    if key is not None:
        rows = []
        finish(rows)
        yield out(rows)


def read_multiline(spark: SparkSession, paths, delimiter: str) -> DataFrame:
    """(file, line, value): records split on a delimiter that holds a line break, ``line`` the 0-based number of
    the record in its file. ``\\r\\n`` and ``\\r`` count as ``\\n``; one trailing empty record is not a record; a file
    without a byte has none. Compressed files are taken to end with a line break. A file
    whose lines end in ``\\r`` alone is one line to the scan, which holds it in one row."""
    cutter = Cutter(delimiter)
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.col("_metadata.file_size").alias("size"))
    effects = written(raw.mapInArrow(lambda b: _effects(b, cutter), _EFFECTS), "split-effects")
    entries = effects.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_entries, _ENTRIES)
    lines = raw.drop("size").withColumn("_mono", F.monotonically_increasing_id())
    lines = join_per_group(lines, entries, ["file", "block"], salt_from=[F.col("_mono")], in_order=["file", "block", "_mono"])
    lines = lines.select("file", "block", "value", "state", "record", "first", "last", "ended")
    pieces = written(lines.mapInArrow(lambda b: _cut(b, cutter), _PIECES), "records")
    alone = pieces.where("whole").select("file", F.col("record").alias("line"), "value")
    # a group is one record; each split adds a piece
    joined = pieces.where("not whole").groupBy("file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "\n").alias("value"),
        F.max("closed").alias("closed"))
    text = F.when(F.col("closed"), F.expr(f"left(value, length(value) - {len(delimiter)})")).otherwise(F.col("value"))
    joined = joined.select("file", F.col("record").alias("line"), text.alias("value"), "closed").where("closed or value <> ''")
    return alone.unionByName(joined.drop("closed"))
