"""Reduction of a large table to the rows whose key another table may hold, without moving it.

The other table's keys are hashed into a bitmap of fixed size, which is broadcast. Rows
that the bitmap lets through by chance are removed by the join that follows; what is
shuffled there follows the keys asked for and not the large table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bitmap has so many rows of 64 bits: at most 32 MB as a broadcast table, whatever
# the number of keys. With 10 million keys one row in seven is let through by chance.
SLOTS = 1 << 20


def _place(*keys: Column) -> tuple[Column, Column]:
    """Row of the bitmap and bit in it, from different bits of one hash."""
    hashed = F.xxhash64(*keys)
    return F.pmod(hashed, F.lit(SLOTS)), F.shiftrightunsigned(hashed, 58).cast("int")


def key_bitmap(keys: DataFrame, *names: str) -> DataFrame:
    """(slot, bits): the bitmap of the keys `names` of a table, null keys too."""
    slot, bit = _place(*map(F.col, names))
    ones = F.expr("shiftleft(1L, bit)")
    return keys.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(
        F.bit_or(ones).alias("bits")
    )


def may_hold(table: DataFrame, bitmap: DataFrame, *names: str) -> DataFrame:
    """The rows of `table` whose keys are, or collide with, one of the bitmap's."""
    slot, bit = _place(*(table[name] for name in names))
    held = (slot == bitmap["slot"]) & (F.getbit(bitmap["bits"], bit) == 1)
    return table.join(F.broadcast(bitmap), held, "left_semi")
