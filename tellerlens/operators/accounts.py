"""Facts per account holder, all from one aggregate of the account table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlens.functions.expressions import exact, ts
from tellerlens.params import RunParams


def account_summary(accounts: DataFrame, where: Column | None = None) -> DataFrame:
    """cust_no, n_accounts, balance, last_activity, first_opened per holder. ``balance`` is NULL
    when every balance is; the two activity dates ignore NULLs."""
    rows = accounts if where is None else accounts.filter(where)
    return rows.groupBy("cust_no").agg(
        F.count("*").alias("n_accounts"),
        exact(F.sum("acy_curr_balance")).alias("balance"),
        F.greatest(F.max("date_last_cr_activity"), F.max("date_last_dr_activity")).alias("last_activity"),
        F.min("ac_open_date").alias("first_opened"),
    )


def open_summary(accounts: DataFrame) -> DataFrame:
    return account_summary(accounts, is_open())


def is_open(prefix: str = "") -> Column:
    return F.col(f"{prefix}record_stat") == "O"


def idle_since(bound, prefix: str = "") -> Column:
    """Neither side of the account moved at or after ``bound``, going by its own dates."""
    cr, dr = F.col(f"{prefix}date_last_cr_activity"), F.col(f"{prefix}date_last_dr_activity")
    return (cr.isNull() | (cr < ts(bound))) & (dr.isNull() | (dr < ts(bound)))


def active_since(params: RunParams, months: int, prefix: str = "") -> Column:
    bound = ts(params.months_ago(months))
    cr, dr = F.col(f"{prefix}date_last_cr_activity"), F.col(f"{prefix}date_last_dr_activity")
    return (cr >= bound) | (dr >= bound)


def holder_totals(accounts: DataFrame, open_only: bool = False) -> DataFrame:
    """Total balance per holder for ranking: over all accounts, or over open ones only."""
    rows = accounts.filter(is_open()) if open_only else accounts
    return rows.groupBy("cust_no").agg(exact(F.sum("acy_curr_balance")).alias("total_balance"))


def holder_flags(accounts: DataFrame) -> DataFrame:
    """Holders with an unfrozen account, and with one neither blocked nor frozen. A NULL flag
    counts as neither set nor unset."""
    unfrozen = F.col("ac_stat_frozen") != "Y"
    return accounts.groupBy("cust_no").agg(
        F.count_if(unfrozen).alias("n_unfrozen"),
        F.count_if(unfrozen & (F.col("ac_stat_block") != "Y")).alias("n_unrestricted"),
    )
