"""Records between delimiters with line breaks: against ``str.split``, whatever the splits."""

import random

import pytest

from precis import session
from precis.sources.files import read_delimited
from precis.sources.records import Cutter, _cut, _effects, _entries

DELIMITERS = ["\n\n", "\n---\n", "---\n", "\n---", "a\nb", "a\na", "\n\n\n", "\n--\n\n", "\n-\n-\n", "-\n-"]


def plain(path, delimiter):
    with open(path, newline=None) as f:
        records = f.read().split(delimiter)
    return records if records[-1] else records[:-1]


def texts(seed, n):
    rng = random.Random(seed)
    alphabet = ["", "", "-", "--", "---", "a", "b", "ab", "aba", "word word", "x" * 40, "é-"]
    for _ in range(n):
        breaks = rng.choice([["\n"], ["\r\n"], ["\r"], ["\n", "\r\n", "\r"]])
        lines = [rng.choice(alphabet) + rng.choice(breaks) for _ in range(rng.randint(0, 40))]
        yield "".join(lines) + rng.choice(["", "", "a", "-", "---", "\r"])


@pytest.mark.parametrize("delimiter", DELIMITERS)
def test_states_chain_over_any_splits(delimiter, tmp_path):
    """The three steps in plain Python, over splits of a few lines."""
    import pyarrow as pa

    cutter, rng = Cutter(delimiter), random.Random(len(delimiter))
    for text in texts(7, 150):
        path = tmp_path / "x.txt"
        path.write_bytes(text.encode())
        raw = text.split("\n")
        raw = raw if raw[-1] else raw[:-1]
        bounds = sorted({0, *[rng.randint(0, len(raw)) for _ in range(4)]})
        blocks = [(b, raw[b:e]) for b, e in zip(bounds, [*bounds[1:], len(raw)]) if e > b]
        rows = [("f", b, v) for b, values in blocks for v in values]

        def batch(columns, names):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        got = []
        if rows:
            size = len(text.encode())
            effects = list(_effects(iter([batch([*zip(*[(f, b, v, size) for f, b, v in rows])], list("fbvs"))]), cutter))
            entries = {e["block"]: e for x in _entries(iter(effects)) for e in x.to_pylist()}
            entered = [(f, b, v, *[entries[b][c] for c in ("state", "record", "first", "last", "ended")]) for f, b, v in rows]
            pieces = [p for x in _cut(iter([batch([*zip(*entered)], list("fbvsrile"))]), cutter) for p in x.to_pylist()]
            got = [(p["record"], p["value"]) for p in pieces if p["whole"]]
            for number in {p["record"] for p in pieces if not p["whole"]}:
                parts = sorted((p for p in pieces if p["record"] == number and not p["whole"]), key=lambda p: p["block"])
                value = "\n".join(p["value"] for p in parts)
                if any(p["closed"] for p in parts):
                    got.append((number, value[:-len(delimiter)]))
                elif value:
                    got.append((number, value))
        assert [v for _, v in sorted(got)] == plain(path, delimiter) and [n for n, _ in sorted(got)] == list(range(len(got)))


@pytest.mark.parametrize("broadcast", [64 * 1024 * 1024, 0])
@pytest.mark.parametrize("delimiter", ["\n\n", "\n---\n"])
def test_files_in_splits(spark, tmp_path, monkeypatch, delimiter, broadcast):
    monkeypatch.setattr(session, "BROADCAST_BYTES", broadcast)
    (tmp_path / "in").mkdir()
    long = {"long.txt": ("line of a record\r\n" * 300 + delimiter) * 20, "one.txt": "no delimiter\n" * 2000, "empty.txt": "",
            "blank.txt": "\n" * 999, "end.txt": "a" + delimiter}
    files = {**{f"{i}.txt": t for i, t in enumerate(texts(3, 12))}, **long}
    for name, text in files.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = read_delimited(spark, str(tmp_path / "in"), delimiter).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = {}
    for r in sorted(rows, key=lambda r: (r.file, r.line)):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line, r.value))
    want = {name: list(enumerate(plain(tmp_path / "in" / name, delimiter))) for name in files}
    assert got == {name: records for name, records in want.items() if records}
