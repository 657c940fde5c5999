"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.session import ensure_checkpoint_dir, ship_package, spread

#: Fixed value: the white space that separates words, ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\r\x0b\x0c"

#: Bytes of a text whose words are held as objects at a time.
SLICE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")


def word_slices(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each ``SLICE`` bytes or so; no word is cut."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + SLICE)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


def prepare(spark: SparkSession) -> None:
    """Make the package importable in the workers and settle the shared folder."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table of ``sf_dir``; a scan of fewer splits than cores is spread by ``key``."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, key) if key else df


def quoted(name: str) -> Column:
    """The column of exactly this name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Positions per bitmap row: Spark's bitmap functions use 4,096-byte bitmaps.
_PAGE_BITS = 15


def bits_for(keys: int) -> int:
    """log2 of the bits of a bitmap for so many keys: 16 a key, 64 MB at most (a fuller one filters less)."""
    return max(_PAGE_BITS, min(29, (16 * max(keys, 1) - 1).bit_length()))


def key_bitmap(keys: DataFrame, hash_col: str, bits_log2: int) -> DataFrame:
    """A set of keys as a bitmap of ``2**bits_log2`` bits, one row per 32,768.

    Its size is at most ``2**bits_log2 / 8`` bytes whatever the number of keys,
    so it may be broadcast; a full bitmap only filters nothing."""
    page, slot = _page_slot(F.col(hash_col), bits_log2)
    return keys.select(page.alias("_page"), slot.alias("_slot")).groupBy("_page").agg(
        F.bitmap_construct_agg("_slot").alias("_bits"))


def _page_slot(hash_col: Column, bits_log2: int) -> tuple[Column, Column]:
    low = hash_col.bitwiseAND(F.lit((1 << bits_log2) - 1))
    return F.shiftright(low, _PAGE_BITS), low.bitwiseAND(F.lit((1 << _PAGE_BITS) - 1))


def maybe_in(df: DataFrame, hash_col: str, bitmap: DataFrame, bits_log2: int, name: str) -> DataFrame:
    """``df`` plus boolean ``name``: true for every key of the bitmap, and for
    some others whose hashes collide (an exact join has to follow)."""
    page, slot = (fresh(df, "_page_of"), fresh(df, "_slot_of"))
    p, s = _page_slot(F.col(hash_col), bits_log2)
    joined = df.withColumns({page: p, slot: s}).join(
        F.broadcast(bitmap.withColumnsRenamed({"_page": f"{page}_", "_bits": f"{page}_bits"})),
        F.col(page) == F.col(f"{page}_"), "left")
    byte = F.expr(
        f"cast(conv(hex(substring(`{page}_bits`, cast(`{slot}` div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr(f"cast(`{slot}` & 7 as int)")
    return joined.withColumn(name, F.coalesce(F.call_function("getbit", byte.cast("long"), bit) == 1, F.lit(False))).drop(
        page, slot, f"{page}_", f"{page}_bits")
