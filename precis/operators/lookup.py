"""Replace every element of an ``array<string>`` column through a key -> value table.

Used by lemmatization (form -> lemma) and corpus encoding (token -> id).
Three ways with the same result, picked by the measured size of the table:

* a few keys: a literal map inside ``transform`` (JVM only);
* up to ``BROADCAST_BYTES``: the table as two Arrow arrays in a broadcast
  variable; all tokens of an Arrow batch are looked up at once;
* larger: frequent tokens are found by a sketch of fixed size and looked up in the
  row, by a broadcast of their part of the table; only the rest are exploded, joined
  by key and grouped by row again. No token of the rest holds more than about a
  thousandth of all occurrences, so no key is hot and the table is shuffled once.
  Where values are ranks by frequency (``ranked``), the first of them are looked up in
  the row ahead of all this: rows are then written and shuffled as values with gaps.

The functions in Python hand on ``SLICE_TOKENS`` tokens or one row at a time, so that
a worker holds an Arrow batch (of ``BATCH_BYTES``, unless the session sets that) and
little besides, however large the input.

Null tokens stay in their place: they become ``default``, or null without one. A
null array stays null, and rows are told apart by themselves, not by an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from precis import session
from precis.session import bound_batches, measured_bytes, written

LITERAL_KEYS = 256
#: Tokens taken as frequent, and items the sketch of their counts holds: it misses none with
#: more than a thousandth of all occurrences, however many there are.
HOT_TOKENS, SKETCH_ITEMS = 4096, 16_384
#: Longer tokens are never broadcast, so that the frequent ones take 8 MB at most.
HOT_BYTES = 2048
#: Of ranked values the first so many are looked up in the row, of tokens no longer than that: 17 MB at most.
COMMON_TOKENS, COMMON_BYTES = 262_144, 40
#: Tokens that a function in Python works on at a time (a row is never cut).
SLICE_TOKENS = 1 << 18


def map_tokens(df: DataFrame, tokens_col: str, table: DataFrame, key_col: str, value_col: str,
               default=None, out_col: str | None = None, way: str | None = None, ranked: bool = False) -> DataFrame:
    """``out_col = transform(tokens, t -> coalesce(table[t], default or t))``.

    ``way`` ("literal", "broadcast", "join") is taken instead of the measured choice.
    ``ranked``: the values are whole numbers, the smaller the more frequent the key."""
    out_col = out_col or tokens_col
    bound_batches(df.sparkSession)
    # one value per key, chosen deterministically (a recomputed task must pick
    # the same lemma when a form has several)
    tab = table.select(F.col(key_col).alias("_k"), F.col(value_col).alias("_v")).where("_k is not null").groupBy("_k").agg(
        F.min("_v").alias("_v"))
    tab = written(tab, "lookup")
    if way is None:
        way = "broadcast" if measured_bytes(tab) <= session.BROADCAST_BYTES else "join"
        if way == "broadcast" and tab.count() <= LITERAL_KEYS:
            way = "literal"
    if way == "join" and ranked:
        return _by_rank(df, tokens_col, tab, default, out_col)
    return _WAYS[way](df, tokens_col, tab, default, out_col)


def _fallback(tab: DataFrame, default):
    kind = tab.schema["_v"].dataType
    return lambda t: t.cast(kind) if default is None else F.lit(default).cast(kind)


def _by_literal(df: DataFrame, tokens_col: str, tab: DataFrame, default, out_col: str) -> DataFrame:
    pairs = sorted((r["_k"], r["_v"]) for r in tab.collect())  # LITERAL_KEYS rows at most
    fallback = _fallback(tab, default)
    if not pairs:
        return df.withColumn(out_col, F.transform(F.col(tokens_col), fallback))
    m = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return df.withColumn(out_col, F.transform(F.col(tokens_col), lambda t: F.coalesce(m[t], fallback(t))))


def _arrow_sides(tab: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Keys and values of a table whose size is bounded."""
    arrow = tab.toArrow().combine_chunks()
    kind = to_arrow_type(tab.schema["_v"].dataType)
    return arrow.column("_k").combine_chunks().cast(pa.string()), arrow.column("_v").combine_chunks().cast(kind)


def _ends(lists: pa.Array) -> np.ndarray:
    """Where every list of an Arrow column ends among the flattened elements (null lists hold none)."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(sizes)))


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``SLICE_TOKENS`` elements at most, or one row."""
    at, rows = 0, len(ends) - 1
    while at < rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_TOKENS, "right")) - 1)
        yield at, upto
        at = upto


def _coded(tokens: pa.Array, keys: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Distinct tokens of a batch, the number of the distinct token in each place, and where each
    distinct token is among ``keys``: the hash table is one of the batch, not of the keys."""
    coded = tokens.flatten().cast(pa.string()).dictionary_encode()
    met = pc.index_in(keys, value_set=coded.dictionary)
    hits = np.flatnonzero(pc.is_valid(met))
    at = np.full(len(coded.dictionary), -1)
    at[met.drop_null().to_numpy()] = hits
    return coded.dictionary, coded.indices, pa.array(at, mask=at < 0)


def _list_like(lists: pa.Array, ends: np.ndarray, elements: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), elements, mask=pc.is_null(lists))


def _filled(base: pa.Array, ends: np.ndarray, pos: pa.Array, sizes: np.ndarray, new: pa.Array) -> pa.Array:
    """``base``, flattened lists that end at ``ends``, with ``new`` at ``pos`` of its list, ``sizes`` to a list."""
    here = np.full(len(base), -1)
    here[pos.to_numpy(zero_copy_only=False) + np.repeat(ends[:-1], sizes)] = np.arange(len(new))
    return pc.coalesce(base, new.take(pa.array(here, mask=here < 0)))


def _by_broadcast(df: DataFrame, tokens_col: str, tab: DataFrame, default, out_col: str) -> DataFrame:
    kind = to_arrow_type(tab.schema["_v"].dataType)
    shared = df.sparkSession.sparkContext.broadcast(_arrow_sides(tab))  # its size has been measured

    @F.arrow_udf(T.ArrayType(tab.schema["_v"].dataType))
    def looked_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, values = shared.value
        for tokens in batches:
            distinct, codes, at = _coded(tokens, keys)
            entry = pc.coalesce(values.take(at), distinct.cast(kind) if default is None else pa.scalar(default, kind))
            ends = _ends(tokens)
            for a, b in _slices(ends):
                found = entry.take(codes[ends[a]:ends[b]])
                if default is not None:
                    found = pc.coalesce(found, pa.scalar(default, kind))  # null tokens
                yield _list_like(tokens[a:b], ends[a:b + 1] - ends[a], found)

    return df.withColumn(out_col, looked_up(F.col(tokens_col)))


def _by_rank(df: DataFrame, tokens_col: str, tab: DataFrame, default, out_col: str) -> DataFrame:
    """As ``_by_join``, but the keys of the smallest values are looked up first, and rows go on
    as values with gaps, places of the gaps and the tokens that belong there."""
    value_type = tab.schema["_v"].dataType
    kind = to_arrow_type(value_type)
    least = tab.agg(F.min("_v")).first()[0]
    common = tab.where((F.col("_v") < F.lit(least) + COMMON_TOKENS) & (F.octet_length("_k") <= COMMON_BYTES))
    if least is None or measured_bytes(common) > COMMON_TOKENS * (COMMON_BYTES + 24):  # empty, or no ranks
        return _by_join(df, tokens_col, tab, default, out_col)
    shared = df.sparkSession.sparkContext.broadcast(_arrow_sides(common))
    parts = T.StructType([T.StructField("out", T.ArrayType(value_type)), T.StructField("pos", T.ArrayType(T.IntegerType())),
                          T.StructField("tok", T.ArrayType(T.StringType()))])

    @F.arrow_udf(parts)
    def opened(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, values = shared.value
        for tokens in batches:
            distinct, codes, at = _coded(tokens, keys)
            entry, ends = values.take(at), _ends(tokens)
            for a, b in _slices(ends):
                code, upto = codes[ends[a]:ends[b]], ends[a:b + 1] - ends[a]
                out = entry.take(code)
                gaps = np.flatnonzero(pc.and_(pc.is_valid(code), pc.is_null(out)))
                left = np.searchsorted(gaps, upto)
                pos = gaps - np.repeat(upto[:-1], np.diff(left))
                if default is not None:  # null tokens
                    out = pc.if_else(pc.is_null(code), pa.scalar(default, kind), out)
                lists = [_list_like(tokens[a:b], upto, out)] + [
                    pa.ListArray.from_arrays(pa.array(left, pa.int32()), x)
                    for x in (pa.array(pos, pa.int32()), distinct.take(code.take(pa.array(gaps))))]
                yield pa.StructArray.from_arrays(lists, names=["out", "pos", "tok"])

    @F.arrow_udf(T.ArrayType(value_type))
    def closed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for out, pos, val in batches:
            for a, b in _slices(_ends(out)):
                lists, ends = out[a:b], _ends(out[a:b])
                filled = _filled(lists.flatten(), ends, pos[a:b].flatten(), np.diff(_ends(pos[a:b])), val[a:b].flatten())
                yield _list_like(lists, ends, filled)

    rest = [c for c in df.columns if c != out_col]
    df = df.withColumn("_open", opened(F.col(tokens_col))).select(
        *[F.col(f"`{c}`") for c in rest], F.col("_open.out").alias("_out"), F.col("_open.pos").alias("_pos"),
        F.col("_open.tok").alias("_left"))
    mapped = _by_join(df, "_left", tab, default, "_left")
    return mapped.withColumn(out_col, closed(F.col("_out"), F.col("_pos"), F.col("_left"))).drop("_out", "_pos", "_left")


def frequent_tokens(df: DataFrame, tokens_col: str) -> DataFrame:
    """(``_hot``) the most frequent tokens, ``HOT_TOKENS`` rows at most: every token with more
    than a thousandth of all occurrences is among them. A task hands on a sketch of fixed size."""
    tokens = df.select(F.explode(tokens_col).alias("_tok")).where(f"_tok is not null and octet_length(_tok) <= {HOT_BYTES}")
    top = tokens.agg(F.call_function("approx_top_k", "_tok", F.lit(HOT_TOKENS), F.lit(SKETCH_ITEMS)).alias("_top"))
    return top.select(F.explode("_top.item").alias("_hot"))


def _by_join(df: DataFrame, tokens_col: str, tab: DataFrame, default, out_col: str) -> DataFrame:
    value_type = tab.schema["_v"].dataType
    kind = to_arrow_type(value_type)
    # the row numbers are fixed by writing them once
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "token-rows")
    hot = written(frequent_tokens(rows, tokens_col), "frequent")
    fallback = _fallback(tab, default)
    # a frequent token without an entry is settled by the default as well
    settled = F.broadcast(hot).join(tab.join(F.broadcast(hot), F.col("_k") == F.col("_hot")).select("_k", "_v"),
                                    F.col("_hot") == F.col("_k"), "left")
    settled = settled.select(F.col("_hot").alias("_k"), F.coalesce("_v", fallback(F.col("_hot"))).alias("_v"))
    shared = df.sparkSession.sparkContext.broadcast(_arrow_sides(settled))

    @F.arrow_udf("array<struct<pos: int, tok: string>>")
    def others(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for a, b in _slices(_ends(whole)):
                tokens = whole[a:b]
                flat, ends = tokens.flatten().cast(pa.string()), _ends(tokens)
                rest = np.flatnonzero(pc.and_(pc.is_valid(flat), pc.invert(pc.is_in(flat, value_set=shared.value[0]))))
                upto = np.searchsorted(rest, ends)
                pos = rest - np.repeat(ends[:-1], np.diff(upto))
                found = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), flat.take(pa.array(rest))], names=["pos", "tok"])
                yield pa.ListArray.from_arrays(pa.array(upto, pa.int32()), found)

    @F.arrow_udf(T.ArrayType(value_type))
    def put_together(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        keys, values = shared.value
        for whole, joined in batches:
            for a, b in _slices(_ends(whole)):
                tokens, ends = whole[a:b], _ends(whole[a:b])
                parts, sizes = joined[a:b].flatten(), np.diff(_ends(joined[a:b]))
                found = values.take(pc.index_in(tokens.flatten().cast(pa.string()), value_set=keys))
                every = _filled(found, ends, parts.field("pos"), sizes, parts.field("val"))
                if default is not None:
                    every = pc.coalesce(every, pa.scalar(default, kind))  # null tokens
                yield _list_like(tokens, ends, every.cast(kind))

    rest = rows.select("_row", F.explode(others(F.col(tokens_col))).alias("_at")).select("_row", "_at.pos", "_at.tok")
    value = F.coalesce("_v", fallback(F.col("tok")))
    joined = rest.join(tab.hint("merge"), F.col("tok") == F.col("_k"), "left").select(
        F.col("_row").alias("_of"), F.struct("pos", value.alias("val")).alias("_at"))
    # one group is one row's tokens
    regrouped = joined.groupBy("_of").agg(F.collect_list("_at").alias("_mapped"))
    mapped = put_together(F.col(tokens_col), F.col("_mapped"))
    return rows.join(regrouped, F.col("_row") == F.col("_of"), "left").withColumn(out_col, mapped).drop(
        "_row", "_of", "_mapped")


_WAYS = {"literal": _by_literal, "broadcast": _by_broadcast, "join": _by_join}
