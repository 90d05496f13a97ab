"""Transaction monitoring. The history is filtered by date, code and amount at the scan and
combined per account before it meets any other table: what is shuffled and joined is one row
per account (and day, hour or counterparty), never one per transaction."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellerlens.functions.expressions import exact, micro_index, ts
from tellerlens.operators.accounts import idle_since, is_open
from tellerlens.operators.ledger import DayLedger
from tellerlens.operators.skew import hot_keys, spread_join
from tellerlens.params import CLOSED_ALERT_STATES, SETTLED_ALERT_STATES, RunParams
from tellerlens.sources.schemas import DAY_COLUMN

ACCOUNT_COLUMNS = ("cust_ac_no", "cust_no")


def since(history: DataFrame, start: datetime, end: datetime | None = None) -> DataFrame:
    """Transactions from ``start`` on (and before ``end``). A history stored by day carries its
    partition column ``trn_day``, on which the same bounds then prune whole folders."""
    when = F.col("trn_dt")
    rows = history.filter(when >= ts(start))
    if end is not None:
        rows = rows.filter(when < ts(end))
    if DAY_COLUMN in history.columns:
        rows = rows.filter(F.col(DAY_COLUMN) >= F.lit(start.date()))
        if end is not None:
            rows = rows.filter(F.col(DAY_COLUMN) <= F.lit(end.date()))
    return rows


def _volume() -> list[Column]:
    return [F.count("*").alias("n"), exact(F.sum("lcy_amount")).alias("volume")]


def with_holder(per_account: DataFrame, accounts: DataFrame, *extra: str) -> DataFrame:
    """Attach the holder (and further account columns) to rows keyed by ``ac_no``."""
    cols = accounts.select(*ACCOUNT_COLUMNS, *extra)
    return per_account.join(cols, F.col("ac_no") == F.col("cust_ac_no")).drop("cust_ac_no")


def with_customer(per_holder: DataFrame, customers: DataFrame, *extra: str) -> DataFrame:
    cols = customers.select("customer_no", F.col("customer_name1").alias("customer_name"), *extra)
    return per_holder.join(cols, F.col("cust_no") == F.col("customer_no")).drop("customer_no")


def large_cash(history: DataFrame, params: RunParams) -> DataFrame:
    """Cash operations at or above the reporting threshold within the window."""
    return since(history, params.days_ago(params.window_days)).filter(
        F.col("trn_code").isin(*params.cash_codes) & (F.col("lcy_amount") >= params.cash_threshold)
    )


def holders_of(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row ``(n_clients)``: distinct holders behind transaction rows."""
    touched = rows.select("ac_no").distinct()
    return with_holder(touched, accounts).agg(F.count_distinct("cust_no").alias("n_clients"))


def cash_days(history: DataFrame, params: RunParams, ledger: DayLedger | None = None) -> DataFrame:
    """(ac_no, day, n, total) of cash operations strictly between the structuring bounds."""
    if ledger is not None:
        held = ledger.window(params.days_ago(params.window_days)).filter(F.col("n_small") > 0)
        return held.groupBy("ac_no", F.col(DAY_COLUMN).alias("day")).agg(F.sum("n_small").alias("n"), exact(F.sum("small")).alias("total"))
    amount = F.col("lcy_amount")
    rows = since(history, params.days_ago(params.window_days)).filter(
        F.col("trn_code").isin(*params.cash_codes)
        & (amount > params.structuring_floor)
        & (amount < params.cash_threshold)
    )
    return rows.groupBy("ac_no", F.to_date("trn_dt").alias("day")).agg(
        F.count("*").alias("n"), exact(F.sum("lcy_amount")).alias("total")
    )


def is_structured(params: RunParams) -> Column:
    return (F.col("n") >= params.structuring_min_count) & (F.col("total") >= params.cash_threshold)


def structuring(history: DataFrame, params: RunParams, ledger: DayLedger | None = None) -> DataFrame:
    """Account-days whose small cash operations add up to the reporting threshold."""
    return cash_days(history, params, ledger).filter(is_structured(params))


def structuring_client_days(
    history: DataFrame, accounts: DataFrame, params: RunParams, ledger: DayLedger | None = None
) -> DataFrame:
    """The same per (client, day), over all accounts of the client."""
    per_client = with_holder(cash_days(history, params, ledger), accounts).groupBy("cust_no", "day").agg(
        F.sum("n").alias("n"), exact(F.sum("total")).alias("total")
    )
    return per_client.filter(is_structured(params))


def account_activity(history: DataFrame, moment: datetime, where: Column | None = None) -> DataFrame:
    """(ac_no, n, volume) since a moment."""
    rows = since(history, moment)
    return (rows if where is None else rows.filter(where)).groupBy("ac_no").agg(*_volume())


def risky_transfers(
    history: DataFrame, accounts: DataFrame, customers: DataFrame, params: RunParams
) -> DataFrame:
    """(risk_country, n, volume) of transfers in the window whose holder or counterparty lives in
    a listed country; the holder's country is the one shown when both do.

    Accounts learn their holder's listed country first. Pairs of a hot account meet it in slices, and then add up
    per (that country, counterparty): a counterparty that a third of the transfers name keeps one row per listed
    country, as do the transfers that name none.
    """
    listed = params.risk_countries
    transfers = since(history, params.days_ago(params.window_days)).filter(F.col("trn_code").isin(*params.transfer_codes))
    pairs = transfers.groupBy("ac_no", "related_customer").agg(*_volume())
    lives = customers.select("customer_no", F.when(F.col("country").isin(*listed), F.col("country")).alias("holder_country"))
    holders = spread_join(
        accounts.select(*ACCOUNT_COLUMNS), lives, [F.col("cust_no")], [F.col("customer_no")], F.col("cust_ac_no"),
        hot_keys(accounts, "cust_no"),
    ).select("cust_ac_no", "holder_country")
    # Counted on the transfers, not on the pairs: no exchange of either before the join.
    held = spread_join(
        pairs, holders, [F.col("ac_no")], [F.col("cust_ac_no")], F.col("related_customer"), hot_keys(transfers, "ac_no")
    )
    known = held.groupBy("holder_country", "related_customer").agg(
        F.sum("n").alias("n"), exact(F.sum("volume")).alias("volume")
    )
    # A counterparty only matters if its country is listed.
    other = customers.filter(F.col("country").isin(*listed)).select(
        F.col("customer_no").alias("other_no"), F.col("country").alias("other_country")
    )
    both = known.join(other, F.col("related_customer") == F.col("other_no"), "left")
    risk = F.coalesce("holder_country", "other_country")
    return both.filter(risk.isNotNull()).groupBy(risk.alias("risk_country")).agg(
        F.sum("n").alias("n"), exact(F.sum("volume")).alias("volume")
    )


def off_hours(history: DataFrame, params: RunParams) -> DataFrame:
    """Transactions at or above the night threshold outside business hours, with their hour."""
    hour = F.hour("trn_dt")
    return (
        since(history, params.days_ago(params.window_days))
        .filter(F.col("lcy_amount") >= params.night_threshold)
        .filter((hour >= params.night_from_hour) | (hour < params.night_to_hour))
        .withColumn("hour_of_day", hour)
    )


def round_amounts(history: DataFrame, params: RunParams, ledger: DayLedger | None = None) -> DataFrame:
    """(ac_no, n, volume) of exact multiples of the round unit."""
    if ledger is not None:
        return ledger.activity(params.days_ago(params.window_days), "n_even", "even")
    amount = F.col("lcy_amount")
    return account_activity(
        history, params.days_ago(params.window_days),
        (amount >= params.round_unit) & (amount % params.round_unit == 0),
    )


#: Block lengths of the pass-through search, each in the one before: microseconds in a second, seconds in an hour.
BLOCKS = (1_000_000, 3600)


def pass_through(history: DataFrame, params: RunParams) -> DataFrame:
    """Accounts (ac_no) with a large credit followed, strictly later and within the hours allowed,
    by a debit of the given share of it.

    Only the greatest debit and the smallest amount still sought matter per account and instant,
    so rows collapse to that first. Instants are then taken together in blocks of growing length
    (``BLOCKS``: seconds, hours). At each length a block looks at its neighbours
    within the next longer one: what a credit seeks may come in a later one, what a credit's second
    mark, at its deadline, seeks may come in an earlier one. The full hours between are looked
    through last, one row per account and hour. No window partition holds more than the million
    instants of a second, however many rows an account has in it or in an hour.
    """
    hours = params.pass_through_hours
    share = Decimal(params.pass_through_percent) / 100
    smallest = params.pass_through_credit * share
    amount = F.col("lcy_amount")
    rows = since(history, params.days_ago(params.window_days)).filter(
        ((F.col("drcr_ind") == "C") & (amount >= params.pass_through_credit))
        | ((F.col("drcr_ind") == "D") & (amount >= F.lit(smallest)))
    )
    sought = F.when(F.col("drcr_ind") == "C", amount * F.lit(share))
    none = F.lit(None)
    here = F.struct(
        F.col("trn_dt").alias("at"),
        F.when(F.col("drcr_ind") == "D", amount).alias("debit"),
        sought.alias("after"),
        none.cast("decimal(38,6)").alias("upto"),
    )
    deadline = F.struct(
        (F.col("trn_dt") + F.make_dt_interval(hours=F.lit(hours))).alias("at"),
        F.when(F.lit(False), amount).alias("debit"),
        F.when(F.lit(False), sought).alias("after"),
        sought.cast("decimal(38,6)").alias("upto"),
    )
    marks = F.when(F.col("drcr_ind") == "C", F.array(here, deadline)).otherwise(F.array(here))
    blocks = (
        rows.select("ac_no", F.explode(marks).alias("m"))
        .groupBy("ac_no", micro_index(F.col("m.at")).alias("block"))
        .agg(F.max("m.debit").alias("debit"), F.min("m.after").alias("after"), F.min("m.upto").alias("upto"))
        .withColumn("hit", F.coalesce(F.col("debit") >= F.col("upto"), F.lit(False)))  # right at the deadline
    )
    for length in BLOCKS:
        inside = W.partitionBy("ac_no", "parent").orderBy("block")
        later = F.max("debit").over(inside.rowsBetween(1, W.unboundedFollowing))
        earlier = F.max("debit").over(inside.rowsBetween(W.unboundedPreceding, -1))
        seen = blocks.withColumn("parent", F.floor(F.col("block") / length).cast("bigint")).withColumns({"later": later, "earlier": earlier})
        found = (F.col("later") >= F.col("after")) | (F.col("earlier") >= F.col("upto"))
        blocks = seen.groupBy("ac_no", F.col("parent").alias("block")).agg(
            F.max("debit").alias("debit"), F.min("after").alias("after"), F.min("upto").alias("upto"),
            F.bool_or(F.col("hit") | F.coalesce(found, F.lit(False))).alias("hit"),
        )
    between = W.partitionBy("ac_no").orderBy("block").rangeBetween(1, hours - 1)
    judged = blocks.withColumn("between", F.max("debit").over(between))
    hit = F.col("hit") | F.coalesce(F.col("between") >= F.col("after"), F.lit(False))
    return judged.filter(hit).select("ac_no").distinct()


def dormant_accounts(accounts: DataFrame, params: RunParams) -> DataFrame:
    """Open accounts whose own activity dates are missing or older than twelve months."""
    return accounts.filter(is_open() & idle_since(params.months_ago(12))).select(
        *ACCOUNT_COLUMNS, "date_last_cr_activity", "date_last_dr_activity"
    )


def recent_activity(history: DataFrame, params: RunParams, ledger: DayLedger | None = None) -> DataFrame:
    """(ac_no, n, volume) over the short window."""
    if ledger is not None:
        return ledger.activity(params.days_ago(params.short_window_days))
    return account_activity(history, params.days_ago(params.short_window_days))


def dormant_reactivated(
    accounts: DataFrame, history: DataFrame, params: RunParams, ledger: DayLedger | None = None
) -> DataFrame:
    """Dormant accounts with transactions in the short window, with their count and volume."""
    active = recent_activity(history, params, ledger)
    return dormant_accounts(accounts, params).join(active, F.col("ac_no") == F.col("cust_ac_no"))


def high_frequency(
    history: DataFrame, accounts: DataFrame, params: RunParams, ledger: DayLedger | None = None
) -> DataFrame:
    """(cust_no, n): clients above the busy count over the short window."""
    per_client = with_holder(recent_activity(history, params, ledger), accounts).groupBy("cust_no").agg(F.sum("n").alias("n"))
    return per_client.filter(F.col("n") > params.busy_count)


def exposed_flows(
    history: DataFrame, accounts: DataFrame, customers: DataFrame, params: RunParams, ledger: DayLedger | None = None
) -> DataFrame:
    """Large transactions of the window per account: (cust_no, kyc_ref_no, customer_name, n,
    volume, n_high), to be met with the exposed and high-risk clients."""
    start = params.days_ago(params.window_days)
    if ledger is not None:
        per_account = ledger.activity(start, "n_exposed", "exposed", "n_high")
    else:
        large = since(history, start).filter(F.col("lcy_amount") >= params.exposed_amount)
        per_account = large.groupBy("ac_no").agg(
            *_volume(), F.count_if(F.col("lcy_amount") >= params.high_risk_amount).alias("n_high")
        )
    return with_customer(with_holder(per_account, accounts), customers, "kyc_ref_no")


def alert_ageing(alerts: DataFrame, params: RunParams) -> DataFrame:
    """One row: alerts open beyond the legal delay, beyond the long one, and raised in a year."""
    pending = ~F.col("sir_status").isin(*CLOSED_ALERT_STATES)
    raised = F.col("sir_date")
    return alerts.agg(
        F.count_if(pending & (raised < ts(params.days_ago(params.alert_days)))).alias("late"),
        F.count_if(pending & (raised < ts(params.days_ago(params.stale_alert_days)))).alias("stale"),
        F.count_if(raised >= ts(params.months_ago(12))).alias("year"),
    )


def alert_delays(alerts: DataFrame, params: RunParams) -> DataFrame:
    """(band, n) of the time that settled alerts of the last twelve months took to close."""
    settled = alerts.filter(
        (F.col("sir_date") >= ts(params.months_ago(12))) & F.col("sir_status").isin(*SETTLED_ALERT_STATES)
        & F.col("close_date").isNotNull()
    )
    return settled.groupBy(alert_delay_band(F.col("sir_date"), F.col("close_date")).alias("band")).agg(F.count("*").alias("n"))


def alert_delay_band(opened: Column, closed: Column) -> Column:
    """Band number 1-4 of the time an alert took to close: 3, 7, 30 days, more."""
    took = closed - opened
    days = lambda n: F.make_dt_interval(F.lit(n))
    return (
        F.when(took <= days(3), 1).when(took <= days(7), 2).when(took <= days(30), 3).otherwise(4)
    )
