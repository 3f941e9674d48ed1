"""Telling apart rows that may be in a set from rows that surely are not, where they are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits in one row of a filter (what Spark's bitmap functions take), and rows of a filter at most: 64 MB.
ROW, ROWS = 32768, 16384
#: Bits for each member, while there are rows left.
SPARSE = 16


def _slot(key: Column, slots: int) -> Column:
    return F.pmod(key, F.lit(slots))


def separated(rows: DataFrame, key: Callable[[str], Column], members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be members, rows that are none); both with the columns of ``rows``.

    ``members`` is a stored frame of one column, hashes as ``key`` gives them for a row; ``key`` is
    called with the prefix of the row's columns. Members are bits in a filter of at most 64 MB,
    whatever their number, which is broadcast: rows are told apart without moving. About one in
    sixteen others is taken for a member; with more than 33 million members it is more of them, in
    the end all, so that what follows has to look again.
    """
    name = members.columns[0]
    slots = ROW * max(1, min(ROWS, -(-members.count() * SPARSE // ROW)))
    slot = _slot(F.col(name), slots)
    bits = members.select(F.expr(f"cast(pmod({name}, {slots}) div {ROW} as int)").alias("place"),
                          (slot % ROW).alias("bit"))
    bits = bits.groupBy("place").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    own = _slot(key("d."), slots)
    place = F.floor(own / ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("m.bits"), (own % ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (own % 8).cast("int")) == 1, F.lit(False))
    met = rows.alias("d").join(F.broadcast(bits.alias("m")), F.col("m.place") == place, "left")
    return met.where(held).select("d.*"), met.where(~held).select("d.*")
