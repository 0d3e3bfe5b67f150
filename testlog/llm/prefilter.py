"""A fixed-size bit table of keys that lets a scan skip rows with no partner.

The table has ``bits`` bits however many keys there are, so it may be broadcast: its
size is known before it is built.  It may let rows through that have no partner, never
the other way round, so the join behind it stays exact at any number of keys.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23
CHUNK = 1 << 15  # bits of one collected row


def slot(*key: str | Column, bits: int = BITS) -> Column:
    """Place of a key in the table."""
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def bit_table(slots: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bytes of the table from a one-column frame of slots (null slots are skipped).

    Rows are combined on the executors; the driver gets at most bits / CHUNK rows of
    4 KB each.
    """
    name = slots.columns[0]
    rows = (
        slots.filter(F.col(name).isNotNull())
        .groupBy(F.expr(f"CAST(`{name}` DIV {CHUNK} AS INT)").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.col(name) % F.lit(CHUNK)).alias("bitmap"))
        .collect()
    )
    table = np.zeros(bits // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row.bitmap), np.uint8)
        table[row.chunk * (CHUNK // 8) :][: len(part)] = part[: bits // 8]
    return table


def in_table(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.int64, copy=False)
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
