"""Joins against a table of unique keys that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if at least one row in so many has it; so there are at most this many hot keys, and they can be broadcast.
HOT_SHARE = 1000
#: Keys with fewer rows than this are never split: one task takes them easily.
HOT_ROWS = 100_000


def hot_threshold(total_rows: int) -> int:
    return max(HOT_ROWS, -(-total_rows // HOT_SHARE))


def salted_lookup(big: DataFrame, keys: DataFrame, key: str, weight: str, total_rows: int, spread_by: str, threshold: int | None = None, heaviest: int | None = None) -> DataFrame:
    """Inner join of ``big`` to ``keys``, in which ``key`` is unique and ``weight`` counts its rows in ``big``.

    Keys of at least ``hot_threshold(total_rows)`` rows are at most ``HOT_SHARE`` in number, so their list is broadcast; their rows
    get a salt from ``spread_by`` and their single row in ``keys`` is repeated once for each salt. All rows are kept. Who knows the greatest weight gives it as
    ``heaviest``: without a hot key the join is a plain one.
    """
    at = hot_threshold(total_rows) if threshold is None else threshold
    if heaviest is not None and heaviest < at:
        return big.join(keys, key)
    ways = max(2, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = keys.filter(F.col(weight) >= at).select(F.col(key).alias("_hot"))
    salted = big.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.hash(spread_by), F.lit(ways)).cast("int"))
    )
    repeated = keys.withColumn("_salt", F.explode(F.when(F.col(weight) >= at, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    return salted.drop("_hot").join(repeated, [key, "_salt"]).drop("_salt")
