"""Ranked samples, metric rows and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellerlens.functions.expressions import EXACT, money, percent_of


def top_sample(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows with their rank. All columns close the sort, so ties are settled the same
    way on every run; numbering happens after the cut, on at most ``k`` rows. Amounts are ranked in
    their exact scale and rounded to cents in this last projection."""
    full_order = [*order, *[F.col(c).asc_nulls_last() for c in df.columns]]
    top = df.orderBy(*full_order).limit(k)
    shown = [money(F.col(f.name)).alias(f.name) if f.dataType == EXACT else F.col(f.name) for f in df.schema.fields]
    return top.select(F.row_number().over(W.orderBy(*full_order)).alias("rank"), *shown)


def down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


METRIC_FIELDS = "check_id string, metric string, grp string, n bigint, amount decimal(38,2), total bigint, pct decimal(18,1)"


def metric(name: str, n: Column | None = None, total: Column | None = None, amount: Column | None = None) -> Column:
    """One metric of a one-row aggregate as a struct, ready for ``explode_metrics``."""
    none = F.lit(None)
    n_col = none.cast("bigint") if n is None else n.cast("bigint")
    total_col = none.cast("bigint") if total is None else total.cast("bigint")
    return F.struct(
        F.lit(name).alias("metric"),
        none.cast("string").alias("grp"),
        n_col.alias("n"),
        (none if amount is None else amount).cast("decimal(38,2)").alias("amount"),
        total_col.alias("total"),
        (none.cast("decimal(18,1)") if n is None or total is None else percent_of(n_col, total_col)).alias("pct"),
    )


def explode_metrics(df: DataFrame, check_id: str, *metrics: Column) -> DataFrame:
    """Turn a one-row aggregate into one row per metric."""
    return df.select(F.inline(F.array(*metrics))).select(F.lit(check_id).alias("check_id"), "*")


def grouped_metrics(df: DataFrame, check_id: str, name: str, group: Column, n: Column, amount: Column | None = None) -> DataFrame:
    """Rows of a frequency table as metric rows; a NULL group stays NULL."""
    none = F.lit(None)
    return df.select(
        F.lit(check_id).alias("check_id"),
        F.lit(name).alias("metric"),
        group.cast("string").alias("grp"),
        n.cast("bigint").alias("n"),
        (none if amount is None else amount).cast("decimal(38,2)").alias("amount"),
        none.cast("bigint").alias("total"),
        none.cast("decimal(18,1)").alias("pct"),
    )


def verdict(n: Column) -> Column:
    return F.when(n > 0, "ANOMALY").otherwise("OK")
