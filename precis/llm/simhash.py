"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: every 4-word shingle is hashed to 64 bits, and a bit of the
fingerprint is one if it is set in more than half of the hashes.

Candidates: two fingerprints within ``radius`` bits agree on all but ``radius``
of ``blocks`` bit blocks, so for some choice of ``blocks - radius`` blocks they
agree on all chosen bits. Distinct fingerprints are dealt to one bucket for each
choice; no link is lost. More blocks mean more and smaller buckets; the number
is chosen from the number of distinct fingerprints and never changes the links.

Comparison: a bucket's fingerprints are stored vertically, as 64 bit planes.
Mismatches of one fingerprint with 64 others per machine word are added up, bit
plane by bit plane, in carry-save counters that overflow beyond the radius, and
rows of a block in which all have overflowed are abandoned. A large bucket is
cut into chunks that are compared pairwise in separate tasks, and a block returns
a spanning set of its links, never all pairs. Copies share a fingerprint and are
one row from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import bits_for, key_bitmap, maybe_in, quoted, word_slices
from precis.llm.components import component_roots
from precis.session import written

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a chunk of a large bucket; fingerprints that a task compares at a time.
CHUNK, BLOCK = 4096, 1024
#: Mean bucket size above which one more bit block is used, and the most of them.
BUCKET_ROWS, EXTRA_BLOCKS = 4096, 4

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint (unsigned) of a text; no words: zero. Long texts go slice by slice."""
    counts, n, held = np.zeros(64, dtype=np.int64), 0, []
    for words in word_slices((text or "").encode().lower()):  # bytes: A-Z only, ASCII white space only
        words = held + words
        held = words[max(0, len(words) - words_per_shingle + 1):]
        if len(words) >= words_per_shingle:
            counts += _bit_counts(words, words_per_shingle)
            n += len(words) - words_per_shingle + 1
    if not n and held:  # too few words for a shingle
        counts, n = _bit_counts(held, len(held)), 1
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _bit_counts(words: list[bytes], words_per_shingle: int) -> np.ndarray:
    """How many shingles' hashes have each bit set."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(size)
    n = len(words) - words_per_shingle + 1
    last = ends[words_per_shingle - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip((ends - size)[:n].tolist(), (last - 1).tolist())]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 255):  # sums of 255 rows fit in a byte
        counts += bits[lo:lo + 255].sum(axis=0, dtype=np.uint8)
    return counts


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, text_col: str, name: str, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` plus the fingerprint of ``text_col`` as a long (null text: zero)."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, words_per_shingle)) for t in texts], dtype="int64")

    return docs.withColumn(name, fingerprints(quoted(text_col)))


def block_masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` of the blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    each = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(each, blocks - radius)]


def blocks_for(rows: int, radius: int) -> int:
    """The fewest blocks for which buckets of evenly spread fingerprints stay small."""
    blocks = radius + 1
    while blocks < radius + EXTRA_BLOCKS and rows / 2 ** (64 * (blocks - radius) / blocks) > BUCKET_ROWS:
        blocks += 1
    return blocks


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of all pairs (a, b); roots are the smallest members."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def block_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (member, smallest member) among distinct fingerprints."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    words = -(-n // 64)
    padded = np.zeros((64, words * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    members = np.arange(words * 64)
    root = np.arange(n)
    counters = (radius + 1).bit_length()
    start = (1 << counters) - (radius + 1)  # one more mismatch than the radius overflows
    for lo in range(0, n, 256):
        rows = np.arange(lo, min(lo + 256, n))
        first = lo // 64  # each pair once: the words before the tile are compared from the other side
        # pairs that need no comparison count as beyond the radius
        done = (members[None, first * 64:] <= rows[:, None]) | (members[None, first * 64:] >= n)
        over = np.packbits(done, axis=1, bitorder="little").view("<u8")
        sums = [np.full(over.shape, _FULL if start >> k & 1 else 0, dtype=np.uint64) for k in range(counters)]
        for b in range(64):
            carry = planes[b, first:][None, :] ^ (np.uint64(0) - bits[rows, b].astype(np.uint64))[:, None]
            for s in sums:
                s ^= carry
                carry &= ~s  # set before and now cleared: carried
            over |= carry
            if b >= 15 and b % 8 == 7:
                alive = (over != _FULL).any(axis=1)
                if not alive.all():
                    rows, over, sums = rows[alive], over[alive], [s[alive] for s in sums]
                    if not len(rows):
                        break
        if len(rows):
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(near)
            _union(root, rows[i], j + first * 64)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within buckets that arrive sorted; small buckets share a block, as
    a comparison across buckets can only find true links."""

    def compared(parts: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.unique(np.concatenate(parts).view(np.uint64))
        a, b = block_links(fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[np.ndarray] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
        fps = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if last is None or (keys[:, 0] != last).any():
            starts = np.concatenate(([0], starts))
        last, at = keys[:, -1], 0
        for s in starts.tolist():
            if s > at:
                held.append(fps[at:s])
                size += s - at
                at = s
            if size >= BLOCK:
                yield compared(held)
                held, size = [], 0
        held.append(fps[at:])
        size += len(fps) - at
    if held:
        yield compared(held)


def near_links(prints: DataFrame, radius: int, rows: int) -> DataFrame:
    """Links (a, b) that connect all of ``fp`` in ``prints`` (distinct) within ``radius``."""
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in block_masks(blocks_for(rows, radius), radius)])
    dealt = prints.select("fp", F.posexplode(masks).alias("choice", "key"))
    buckets = dealt.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = buckets.select("choice", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    dealt = dealt.join(buckets, ["choice", "key"])
    own = F.pmod(F.xxhash64("fp", "choice"), F.col("chunks")).cast("int")
    paired = dealt.select("choice", "key", "fp", own.alias("own"),
                          F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    paired = paired.select("choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    group = ["choice", "key", "i", "j"]
    return paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        lambda batches: _links(batches, radius), "a long, b long")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """For every fingerprint of ``rows`` (``_id``, ``_tie``, ``_fp``): ``fp`` and
    ``stay``, the smallest (null id, id, tie) of its component."""
    low = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_tie"))
    prints = written(rows.groupBy(F.col("_fp").alias("fp")).agg(low.alias("low")), "prints")
    roots = written(component_roots(near_links(prints, radius, prints.count())), "roots")
    prints = written(prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    # both written: the members of a large component may be split over tasks
    lowest = written(prints.groupBy("root").agg(F.min("low").alias("stay")), "stays")
    return prints.join(lowest, "root").select("fp", "stay")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links of at most ``radius``
    differing bits.

    Null and wordless texts have fingerprint zero and link like any other. Null
    ids are passed over when the smallest is taken (null only if there is no
    other); repeated rows stay repeated; other columns are not read; an empty
    table gives an empty result."""
    rows = docs.select(quoted(id_col).alias("_id"), F.lit(0).cast("long").alias("_tie"), quoted(text_col).alias("_text"))
    rows = written(with_fingerprint(rows, "_text", "_fp", words_per_shingle).drop("_text"), "fingerprints")
    classes = _components(rows, radius)
    return rows.join(classes, rows._fp == classes.fp).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("stay._id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component
    the row with the smallest id (null ids last; equal ids: the smallest content
    hash; repeated rows: one). Null, empty and blank texts have the fingerprint zero and are
    linked like any other; an empty table gives an empty result.

    Fingerprints are computed once. A bitmap, sized by the rows that
    may go, lets the rows that stay
    pass straight through; only those that may go are shuffled, by id and content
    hash, so a large component spreads over all tasks."""
    rows = docs.select(quoted(id_col).alias("_id"), F.xxhash64(quoted(text_col)).alias("_tie"),
                       quoted(text_col).alias("_text"))
    rows = with_fingerprint(rows, "_text", "_fp", words_per_shingle).groupBy("_id", "_tie", "_fp")
    rows = written(rows.agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    classes = _components(rows, radius)
    stays = F.col("_id").eqNullSafe(F.col("stay._id")) & (F.col("_tie") == F.col("stay._tie"))
    decided = rows.join(classes, rows._fp == classes.fp).select(
        "_id", "_tie", "n", stays.alias("stays"), F.xxhash64("_id", "_tie").alias("_both"))
    decided = written(decided.where("n > 1 or not stays"), "decisions")
    marked = docs.select(
        # one struct holds the row, so that its column names can't clash with the plan's
        F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), quoted(id_col).alias("_id"),
        F.xxhash64(quoted(text_col)).alias("_tie"))
    marked = marked.withColumn("_both", F.xxhash64("_id", "_tie"))
    bits = bits_for(decided.count())
    marked = maybe_in(marked, "_both", key_bitmap(decided, "_both", bits), bits, "_maybe")
    through = marked.where(~F.col("_maybe")).select("_row")
    rest = marked.where("_maybe").alias("r")
    gone = decided.where("not stays").alias("g")
    rest = rest.join(gone, F.col("r._id").eqNullSafe(F.col("g._id")) & (F.col("r._tie") == F.col("g._tie")), "left_anti")
    return through.unionByName(rest.dropDuplicates(["_id", "_tie"]).select("_row")).select("_row.*")
