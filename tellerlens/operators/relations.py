"""Joins between banking tables: existence tests, lookups with sparse keys, skewed group joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name as a balanced tree: each step analyses the plan it is given, so a chain over
    many parts would analyse the growing left side again and again."""
    if len(parts) == 1:
        return parts[0]
    middle = len(parts) // 2
    return union_all(parts[:middle]).unionByName(union_all(parts[middle:]))


def has_related(df: DataFrame, other: DataFrame, left: str | Sequence[str], right: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` with at least one partner (EXISTS)."""
    return df.join(*_existence(other, left, right), "left_semi")


def lacks_related(
    df: DataFrame, other: DataFrame, left: str | Sequence[str], right: str | Sequence[str], spread: str | None = None
) -> DataFrame:
    """Rows of ``df`` without a partner (NOT EXISTS); a NULL key has no partner. Where the first
    key is often NULL, ``spread`` names a row key that routes those rows instead."""
    return df.join(*_existence(other, left, right, spread), "left_anti")


def _existence(other: DataFrame, left, right, spread: str | None = None) -> tuple[DataFrame, Column]:
    left = [left] if isinstance(left, str) else list(left)
    right = [right] if isinstance(right, str) else list(right)
    # One row per key: the partner side combines map-side, so a hot key costs one row per task.
    keys = other.select(*[F.col(r).alias(f"_key{i}") for i, r in enumerate(right)]).distinct()
    cond = F.lit(True)
    for i, name in enumerate(left):
        col = F.col(name)
        if spread and i == 0:
            cond = cond & col.isNotNull()
            col = _routed(col, F.col(spread))
        cond = cond & (col == F.col(f"_key{i}"))
    return keys, cond


def _routed(key: Column, spread: Column) -> Column:
    return F.coalesce(key, F.concat(F.lit("\x01"), spread.cast("string")))


def lookup(df: DataFrame, other: DataFrame, left: Column, right: Column, spread: Column) -> DataFrame:
    """LEFT JOIN on a key that is often NULL. Rows without a key are routed by ``spread`` (their
    own row key) rather than all hashing to one partition; they still match nothing."""
    return df.join(other, left.isNotNull() & (_routed(left, spread) == right), "left")


def to_many(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """LEFT JOIN to a side where one key may hold a large share of the rows. The matching part is
    an inner join, in which the skewed side can be split, and rows without partner are added."""
    matched = df.join(other, F.col(left) == F.col(right))
    alone = lacks_related(df, other, left, right)
    return matched.unionByName(alone, allowMissingColumns=True)


KEY_BITS = 1 << 20


def maybe_key(col: Column, other: DataFrame, key: str, bits: int = KEY_BITS) -> Column:
    """Scan filter for a join that follows: false only where no row of ``other`` has this key.

    The keys of ``other`` are hashed into a table of ``bits`` bits, 128 KB whatever its size, that reaches the scan as a
    scalar subquery. With far more keys than bits it lets everything pass and costs next to nothing; the join, or the
    existence test, still decides. NULL keys do not pass.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    div = lambda c: F.call_function("div", c, F.lit(64))
    own = spot(F.col(key))
    words = other.filter(F.col(key).isNotNull()).groupBy(div(own).alias("_at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (own % 64).cast("int"))).alias("_word")
    )
    every = other.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("_at"), "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("_word", F.lit(0)).alias("_word"))))
    table = every.agg(F.transform(pairs, lambda p: p["_word"])).scalar()
    word = F.element_at(table, (div(spot(col)) + 1).cast("int"))
    return col.isNotNull() & (F.getbit(word, (spot(col) % 64).cast("int")) == 1)


def salted_group_join(
    df: DataFrame, groups: DataFrame, keys: Sequence[str], spread: Column, cond: Column | None = None,
    how: str = "left_semi", salts: int = SALTS,
) -> DataFrame:
    """Join rows to facts about their group when one group may hold a large share of all rows.
    ``groups`` is already aggregated (few rows per key), so repeating it per salt is cheap, and
    each group's rows spread over ``salts`` tasks. Keys must be non-NULL and named alike."""
    left = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.select(*[F.col(c).alias(f"_g_{c}") for c in right.columns])
    on = F.col("_salt") == F.col("_g__salt")
    for key in keys:
        on = on & (F.col(key) == F.col(f"_g_{key}"))
    if cond is not None:
        on = on & cond
    joined = left.join(right, on, how)
    return joined.drop("_salt", "_g__salt", *[f"_g_{k}" for k in keys])
