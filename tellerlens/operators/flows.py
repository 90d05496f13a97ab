"""Flows of a group of parties (here: correspondent banks) through their open accounts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlens.functions.expressions import exact
from tellerlens.operators.accounts import is_open
from tellerlens.operators.ledger import DayLedger
from tellerlens.operators.relations import lacks_related, maybe_key
from tellerlens.operators.transactions import since

PARTY_COLUMNS = ("customer_no", "customer_name", "customer_category", "nationality", "swift_code", "kyc_ref_no")


def party_accounts(customers: DataFrame, accounts: DataFrame, party: Column) -> DataFrame:
    """Open accounts of the parties, with party and account columns."""
    parties = customers.filter(party).select(
        "customer_no", F.col("customer_name1").alias("customer_name"), "customer_category",
        "nationality", "swift_code", "kyc_ref_no",
    )
    held = accounts.filter(is_open()).select("cust_ac_no", "cust_no", "ac_open_date", "acy_curr_balance")
    return parties.join(held, F.col("customer_no") == F.col("cust_no")).drop("cust_no")


def account_flows(
    history: DataFrame, held: DataFrame, start: datetime, end: datetime | None = None,
    where: Column | None = None, by: tuple[str, ...] = (), ledger: DayLedger | None = None,
) -> DataFrame:
    """(ac_no, *by, n_refs, debit, credit, volume, n_rows) of at least the parties' accounts, for ``party_flows``.
    A bit table of the parties' account numbers thins the history at the scan, rows combine per account
    and task before the exchange, and few others are left when the sums meet the accounts: no transaction is shuffled."""
    rows = _rows_of(held, since(history, start, end) if ledger is None else ledger.window(start, end))
    if where is not None:
        rows = rows.filter(where)
    if ledger is not None:  # conditions and groups are over the module, which the ledger keeps
        total = lambda name: exact(F.sum(name)).alias(name)
        return rows.groupBy("ac_no", *by).agg(
            F.sum("n_refs").alias("n_refs"), total("debit"), total("credit"), total("volume"), F.sum("n").alias("n_rows")
        )
    amount, side = F.col("lcy_amount"), F.col("drcr_ind")
    return rows.groupBy("ac_no", *by).agg(
        F.count("trn_ref_no").alias("n_refs"),
        exact(F.sum(F.when(side == "D", amount).otherwise(0))).alias("debit"),
        exact(F.sum(F.when(side == "C", amount).otherwise(0))).alias("credit"),
        exact(F.sum(amount)).alias("volume"),
        F.count("*").alias("n_rows"),
    )


def _rows_of(held: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.filter(maybe_key(F.col("ac_no"), held, "cust_ac_no"))


def party_flows(flows: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """Flows summed per party (or per party and further keys)."""
    joined = held.join(flows, F.col("cust_ac_no") == F.col("ac_no"))
    return joined.groupBy(*keys).agg(
        F.sum("n_refs").alias("n_txn"),
        exact(F.sum("debit")).alias("total_debit"),
        exact(F.sum("credit")).alias("total_credit"),
        exact(F.sum("volume")).alias("volume"),
    )


def flow_share(per_party: DataFrame, min_share: float) -> DataFrame:
    """Parties that receive more than ``min_share`` of all credits (a scalar subquery)."""
    total = per_party.agg(exact(F.sum("total_credit"))).scalar()
    shared = per_party.withColumn("all_credit", total).filter(F.col("all_credit") > 0)
    return shared.filter(F.col("total_credit") > F.col("all_credit") * F.lit(str(min_share)).cast("decimal(9,6)"))


def idle_accounts(held: DataFrame, history: DataFrame, start: datetime, ledger: DayLedger | None = None) -> DataFrame:
    """Open party accounts without any transaction since ``start``."""
    recent = _rows_of(held, since(history, start) if ledger is None else ledger.window(start))
    return lacks_related(held, recent, "cust_ac_no", "ac_no")


def low_balance_high_flow(
    held: DataFrame, history: DataFrame, start: datetime, max_balance: int, min_amount: int,
    ledger: DayLedger | None = None,
) -> DataFrame:
    """Near-empty party accounts with a large recent transaction, with the greatest amount of any
    size in the period and the number of large ones."""
    empty = held.filter(F.abs("acy_curr_balance") < max_balance)
    if ledger is not None and ledger.params.low_balance_txn == min_amount:
        days = _rows_of(empty, ledger.window(start)).groupBy("ac_no")
        activity = days.agg(exact(F.max("max_amount")).alias("max_amount"), F.sum("n_over").alias("n_large"))
        return empty.join(activity.filter(F.col("n_large") > 0), F.col("cust_ac_no") == F.col("ac_no"))
    activity = _rows_of(empty, since(history, start)).groupBy("ac_no").agg(
        exact(F.max("lcy_amount")).alias("max_amount"),
        F.count_if(F.col("lcy_amount") > min_amount).alias("n_large"),
    )
    return empty.join(activity.filter(F.col("n_large") > 0), F.col("cust_ac_no") == F.col("ac_no"))
