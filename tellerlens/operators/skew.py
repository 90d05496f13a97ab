"""Joins that split hot keys by their measured share of the rows.

The frequent keys of a side are counted first, by a sketch that every task combines before anything is
exchanged; rows of a frequent key are then dealt to as many slices as its share asks for, and the other
side's rows of that key are repeated once per slice. All other keys are joined as they are. Which keys
count as frequent changes the balance of the tasks only, never the result. Keys that one task can hold
altogether, by Spark's own estimate of their size, are not counted: their join is a plain one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is split when it holds more than one part in this many of the rows.
PARTS = 2048
#: A slice holds at least this many rows: smaller tables are not worth splitting.
SLICE_ROWS = 10_000
MERGERS = 256
#: Key columns up to this size need no split: all of them under one key would still be one task's work.
SMALL_BYTES = 64 << 20


def hot_keys(
    df: DataFrame, keys: str | Sequence[str], parts: int | None = None, slice_rows: int | None = None,
    small_bytes: int | None = None,
) -> DataFrame | None:
    """(_hot, _slices): hashes of the keys of ``df`` that fill more than one slice, at most ``parts`` rows; None
    where the key columns are no larger than ``small_bytes``.

    A slice is ``1 / parts`` of the rows, or ``slice_rows`` where that is more. The sketch tracks eight keys a
    part, so it misses none of this share; NULL keys are not counted. Sketches are merged in two steps: no task
    reads one of every other task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts, slice_rows = parts or PARTS, slice_rows or SLICE_ROWS
    if _estimated_bytes(df.select(*keys)) <= (SMALL_BYTES if small_bytes is None else small_bytes):
        return None
    tracked = F.lit(8 * parts)
    sketch = lambda name, *args: F.call_function(f"approx_top_k_{name}", *args)
    items = df.filter(_all_set([F.col(k) for k in keys])).select(F.xxhash64(*keys).alias("_hot"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("_merger"))
    some = items.groupBy("_merger").agg(sketch("accumulate", F.col("_hot"), tracked).alias("_sketch"), F.count("*").alias("_n"))
    # Grouped by a constant: sketches of no rows cannot be combined, and no group means no row.
    one = some.groupBy(F.lit(0).alias("_all")).agg(
        sketch("combine", F.col("_sketch"), tracked).alias("_sketch"), F.sum("_n").alias("_n"))
    found = one.select(F.explode(sketch("estimate", F.col("_sketch"), F.lit(parts))).alias("_t"), "_n")
    slices = F.ceil(F.col("_t.count") / F.greatest(F.col("_n") / parts, F.lit(slice_rows))).cast("int")
    return found.select(F.col("_t.item").alias("_hot"), slices.alias("_slices")).filter(F.col("_slices") > 1)


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _all_set(keys: Sequence[Column]) -> Column:
    test = F.lit(True)
    for key in keys:
        test = test & key.isNotNull()
    return test


def _with_slices(df: DataFrame, keys: Sequence[Column], hot: DataFrame | None, out: str) -> DataFrame:
    """``out``: the number of slices of the row's key."""
    if hot is None:
        return df.withColumn(out, F.lit(1))
    # At most ``parts`` rows, by the sketch's own limit.
    known = F.broadcast(hot.select(F.col("_hot").alias(f"{out}_hot"), F.col("_slices").alias(f"{out}_n")))
    joined = df.withColumn(f"{out}_hash", F.xxhash64(*keys)).join(known, F.col(f"{out}_hash") == F.col(f"{out}_hot"), "left")
    return joined.withColumn(out, F.coalesce(f"{out}_n", F.lit(1))).drop(f"{out}_hash", f"{out}_hot", f"{out}_n")


def dealt(
    df: DataFrame, keys: Sequence[Column], by: Column, own: DataFrame | None, other: DataFrame | None, names: tuple[str, str]
) -> DataFrame:
    """``df`` with its cell in the grid of its key: dealt over its ``own`` slices by the row key ``by``, repeated
    over the ``other`` side's. Rows without a key match nothing: they are dealt over ``PARTS`` cells, once each."""
    mine, theirs = names
    df = _with_slices(_with_slices(df, keys, own, "_own"), keys, other, "_other")
    turn = F.pmod(F.xxhash64(by), F.when(_all_set(keys), F.col("_own")).otherwise(PARTS)).cast("int")
    df = df.withColumn(mine, turn)
    if other is None:
        df = df.withColumn(theirs, F.lit(0))
    else:
        repeats = F.when(_all_set(keys), F.col("_other")).otherwise(1)
        df = df.withColumn(theirs, F.explode(F.sequence(F.lit(0), repeats - 1)))
    return df.drop("_own", "_other")


def spread_join(
    df: DataFrame, other: DataFrame, left: Sequence[Column], right: Sequence[Column], by: Column,
    hot: DataFrame | None = None, how: str = "inner", by_other: Column | None = None, hot_other: DataFrame | None = None,
    cond: Column | None = None,
) -> DataFrame:
    """Join on ``left`` = ``right`` (and ``cond``), rows of a hot key spread over its slices.

    ``hot`` holds the frequent keys of ``df`` and ``by`` a row key of it; ``hot_other`` and ``by_other`` those of
    ``other``, for inner joins (the rows of a key hot on both sides meet in a grid of slices). Keys of both sides
    must have one type. NULL keys match nothing, and unmatched rows of an outer or anti join come once. Where
    neither side has been measured, neither is large, and the join is a plain one.
    """
    if hot_other is not None and how != "inner":
        raise ValueError("the other side is split in inner joins only: unmatched rows would be repeated")
    types = [[f.dataType for f in side.select(*keys).schema] for side, keys in ((df, left), (other, right))]
    if types[0] != types[1]:
        raise ValueError(f"keys of different types: {types[0]} and {types[1]}")
    on = F.lit(True) if cond is None else cond
    for a, b in zip(left, right):
        on = on & (a == b)
    if hot is None and hot_other is None:
        return df.join(other, on, how)
    by_other = F.lit(0) if by_other is None else by_other
    # The other side's first coordinate is our slice, which it is repeated over.
    ours = dealt(df, left, by, hot, hot_other, ("_li", "_lj"))
    theirs = dealt(other, right, by_other, hot_other, hot, ("_rj", "_ri")).withColumn(
        "_rj", F.when(_all_set(right), F.col("_rj")).otherwise(0))
    on = on & (F.col("_li") == F.col("_ri")) & (F.col("_lj") == F.col("_rj"))
    return ours.join(theirs, on, how).drop("_li", "_lj", "_ri", "_rj")
