"""Identity values shared by several rows, and bounded ordered text lists."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellerlens.functions.expressions import is_set

LIST_CHARS = 200
SEPARATOR = ", "


def shared_values(df: DataFrame, key: str, mode: str = "space") -> DataFrame:
    """(key, n) for values carried by more than one row; map-side combine absorbs hot values."""
    counted = df.filter(is_set(F.col(key), mode)).groupBy(key).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > 1)


def ordered_list(df: DataFrame, keys: list[str], order: Column, text: Column, out: str) -> DataFrame:
    """Per key, the texts in order joined by ``", "``, cut at 200 characters and stripped of
    trailing separators. Every element brings at least its separator, so elements past the
    100th cannot reach the cut: each task drops them before the exchange, and a key with
    millions of elements still ships 100 per task, with the same result."""
    reach = ceil(LIST_CHARS / len(SEPARATOR))
    ranked = df.select(*keys, order.alias("_o"), text.alias("_t")).withColumn(
        "_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("_o").asc_nulls_last(), F.col("_t")))
    )
    grouped = ranked.filter(F.col("_r") <= reach).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_r", "_t"))).alias("_items")
    )
    pieces = F.transform("_items", lambda item: F.concat(F.coalesce(item["_t"], F.lit("")), F.lit(SEPARATOR)))
    cut = F.substring(F.array_join(pieces, ""), 1, LIST_CHARS)
    return grouped.select(*keys, F.regexp_replace(cut, "[, ]+$", "").alias(out))


def duplicate_groups(df: DataFrame, key: str, member: str, k: int, mode: str = "trim") -> DataFrame:
    """The ``k`` largest groups of rows sharing ``key``: (key, n, members). Groups are ranked on
    their counts alone; members are listed only for the ``k`` winners (at most ``k`` rows, hence
    the broadcast)."""
    top = shared_values(df, key, mode).orderBy(F.col("n").desc(), F.col(key)).limit(k)
    members = df.select(key, member).join(F.broadcast(top.select(key)), key, "left_semi")
    lists = ordered_list(members, [key], F.col(member), F.col(member), "members")
    return top.join(F.broadcast(lists), key, "left").select(key, "n", "members")
