"""Joins of many rows to a table with one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bytes of a table that may be broadcast; its rows are counted first.
BROADCAST_BYTES = 16 << 20
#: A key with more than one in so many of all rows is hot, so there are fewer hot keys than this.
HOT_SHARE = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], row_bytes: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key and about ``row_bytes`` a row.

    The table is broadcast where counted small. Beyond that the rows of hot keys
    meet a broadcast of those keys' rows alone, and all others are dealt by key,
    so no task gets more than a small share. Both sides should be stored tables.
    """
    if table.count() * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys, how)
    counts = rows.groupBy(*keys).count()
    total = rows.count()
    hot = F.broadcast(counts.where(F.col("count") * HOT_SHARE > total).select(*keys).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    few = F.broadcast(table.join(hot.drop("_hot"), keys, "left_semi"))  # below HOT_SHARE rows
    apart = marked.where("_hot").drop("_hot").join(few, keys, how)
    return apart.unionByName(marked.where("_hot is null").drop("_hot").join(table, keys, how))
