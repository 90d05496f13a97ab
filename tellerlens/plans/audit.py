"""The compliance audit: per check its metrics, its findings with severity, and its samples.

Most metrics are filtered counts over a join view, declared as data so that all counts over one
view, of one check or of all of them, come out of a single aggregate. Transaction checks bring
their own plans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlens.functions import expressions as X
from tellerlens.operators import transactions as T
from tellerlens.operators.accounts import account_summary, active_since, is_open
from tellerlens.operators.compare import overdue_bands
from tellerlens.operators.duplicates import shared_values
from tellerlens.operators.ranking import (
    METRIC_FIELDS, down, explode_metrics, grouped_metrics, metric, top_sample, up,
)
from tellerlens.operators.relations import has_related, lookup, union_all
from tellerlens.operators.skew import hot_keys, spread_join
from tellerlens.plans.views import Views

COL = F.col
Query = Callable[[Views], DataFrame]

# --- fixed values: severities of findings ---------------------------------------------------
CRITICAL, HIGH, MEDIUM, FOCUS, NOTE, INFO = "CRITIQUE", "ELEVEE", "MOYENNE", "FOCUS", "NOTE", "INFO"
# --------------------------------------------------------------------------------------------
ALERT_BANDS = ("within 3 days", "4 to 7 days", "8 to 30 days", "more than 30 days")


@dataclass(frozen=True)
class Count:
    """Filtered count over a view; ``of`` adds the percentage of the rows that pass it."""

    name: str
    view: str
    when: Column
    of: Column | None = None


@dataclass(frozen=True)
class Gate:
    """Finding raised by a metric: when it is positive, when it covers everything, or always."""

    severity: str
    metric: str
    message: str
    when: str = "positive"


@dataclass(frozen=True)
class Check:
    id: str
    title: str
    counts: Sequence[Count] = ()
    metrics: Query | None = None  # further scalar metrics
    groups: Query | None = None  # metrics per value of something
    gates: Sequence[Gate] = ()
    samples: dict[str, Query] = field(default_factory=dict)


# ---- shared pieces ---------------------------------------------------------------------------
def _opened() -> Column:
    return COL("o.n_accounts").isNotNull()


def _everyone() -> Column:
    return F.lit(True)


def _client_columns(optional: bool = False) -> list[Column]:
    n, balance = COL("o.n_accounts"), COL("o.balance")
    if optional:
        n, balance = F.coalesce(n, F.lit(0)), F.coalesce(balance, F.lit(0))
    return [
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        COL("c.customer_type").alias("customer_type"), COL("c.customer_category").alias("customer_category"),
        n.alias("n_accounts"), X.exact(balance).alias("balance"),
        F.to_date("o.last_activity").alias("last_activity"), F.to_date("o.first_opened").alias("first_opened"),
    ]


def _clients(view: str, where: Callable[[Views], Column], k: int) -> Query:
    """Standard sample: clients with an open account that pass ``where``, richest first."""

    def sample(v: Views) -> DataFrame:
        rows = v(view).filter(where(v) & _opened()).select(*_client_columns())
        return top_sample(rows, [down("balance")], k)

    return sample


def _frequency(check_id: str, name: str, v: Views, alias: str, column: str, where: Column | None = None, k: int | None = None) -> DataFrame:
    rows = v(alias) if where is None else v(alias).filter(where)
    counted = rows.groupBy(COL(column).alias("g")).agg(F.count("*").alias("n"))
    if k is not None:
        counted = counted.orderBy(COL("n").desc(), COL("g").asc_nulls_last()).limit(k)
    return grouped_metrics(counted, check_id, name, COL("g"), COL("n"))


# ---- section 1: due diligence -------------------------------------------------------------------
def _no_reference() -> Column:
    return X.is_blank(COL("c.kyc_ref_no"))


def _check_101(v: Views) -> Check:
    blank = _no_reference()
    return Check(
        "AML-101", "Clients without KYC reference",
        counts=[
            Count("clients_without_kyc", "co", blank, _everyone()),
            Count("without_kyc_with_open_account", "co", blank & _opened()),
            Count("without_kyc_without_open_account", "co", blank & ~_opened()),
        ],
        gates=[Gate(CRITICAL, "without_kyc_with_open_account", "{n} clients without KYC hold open accounts")],
        samples={"": _clients("co", lambda v: _no_reference(), 20)},
    )


def _unverified() -> Column:
    return X.not_equal_or_null(COL("c.kyc_details"), "V")


def _recent_client(v: Views) -> Column:
    return COL("c.cif_creation_date") >= X.ts(v.params.months_ago(12))


def _check_102(v: Views) -> Check:
    recent = _unverified() & _recent_client(v)
    return Check(
        "AML-102", "Clients whose KYC is not verified",
        counts=[
            Count("clients_unverified", "co", _unverified(), _everyone()),
            Count("unverified_with_open_account", "co", _unverified() & _opened()),
            Count("recent_unverified_with_open_account", "co", recent & _opened()),
        ],
        groups=lambda v: _frequency("AML-102", "clients_by_kyc_status", v, "c", "kyc_details"),
        gates=[Gate(CRITICAL, "recent_unverified_with_open_account", "{n} recent clients operate with unverified KYC")],
        samples={"": _clients("co", lambda v: _unverified() & _recent_client(v), 15)},
    )


def _late_high_risk(v: Views) -> Column:
    return (COL("m.risk_level") == v.params.high_risk_level) & X.expired(COL("r.kyc_nxt_review_date"), v.params.as_of)


def _check_103(v: Views) -> Check:
    retail = overdue_bands("r.kyc_nxt_review_date", v.params)
    bands = [
        Count("retail_overdue" if band == "overdue" else f"retail_overdue_{band}", "r", test) for band, test in retail.items()
    ]
    return Check(
        "AML-103", "Overdue periodic KYC reviews",
        counts=[
            *bands,
            Count("corporate_overdue", "k", X.expired(COL("k.kyc_nxt_review_date"), v.params.as_of)),
            Count("high_risk_overdue_with_open_account", "mrco", _late_high_risk(v) & _opened()),
        ],
        gates=[Gate(FOCUS, "high_risk_overdue_with_open_account", "High-risk clients with an overdue review and open accounts", "always")],
        samples={"": _clients("mrco", _late_high_risk, 20)},
    )


def _no_identity() -> Column:
    return X.is_blank(COL("p.p_national_id")) & X.is_blank(COL("p.passport_no"))


def _check_104(v: Views) -> Check:
    both = lambda a, b: X.is_blank(COL(f"p.{a}")) & X.is_blank(COL(f"p.{b}"))
    missing = {
        "without_birth_date": COL("p.date_of_birth").isNull(),
        "without_identity_document": _no_identity(),
        "without_full_name": X.is_blank(COL("p.first_name")) | X.is_blank(COL("p.last_name")),
        "without_address": both("p_address1", "d_address1"),
        "without_telephone": both("mobile_number", "telephone"),
        "without_birth_country_and_place": both("birth_country", "place_of_birth"),
    }
    return Check(
        "AML-104", "Mandatory personal data missing",
        counts=[
            *[Count(name, "po", test, _everyone()) for name, test in missing.items()],
            Count("without_identity_with_open_account", "po", _no_identity() & _opened()),
        ],
        gates=[Gate(FOCUS, "without_identity_with_open_account", "Clients without identity document and with open accounts", "always")],
        samples={"": _clients("pco", lambda v: _no_identity(), 15)},
    )


def _expired_passports(v: Views) -> DataFrame:
    now = v.params.as_of
    ours, theirs = COL("p.ppt_exp_date"), COL("r.passport_expiry_date")
    rows = v("cprxo").filter((X.expired(ours, now) | X.expired(theirs, now)) & _opened()).select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        F.coalesce("p.passport_no", "r.passport_no").alias("passport_no"),
        F.to_date(F.least(ours, theirs)).alias("expiry_date"),
        COL("o.n_accounts").alias("n_accounts"), COL("o.balance").alias("balance"),
    )
    return top_sample(rows, [down("balance")], 15)


def _check_105(v: Views) -> Check:
    now = v.params.as_of
    return Check(
        "AML-105", "Expired identity documents",
        counts=[
            Count("expired_passports_personal", "p", X.expired(COL("p.ppt_exp_date"), now)),
            Count("expired_passports_kyc", "r", X.expired(COL("r.passport_expiry_date"), now)),
            Count("expired_visas", "r", X.expired(COL("r.visa_expiry_date"), now)),
        ],
        gates=[Gate(FOCUS, "expired_passports_personal", "Expired passports (both sources) with open accounts", "always")],
        samples={"": _expired_passports},
    )


def _check_106(v: Views) -> Check:
    blank = X.is_blank(COL("c.risk_profile"))

    def metrics(v: Views) -> DataFrame:
        unrated = v("c").filter(X.is_blank(COL("risk_profile"))).select("customer_no", "kyc_ref_no")
        files = v("m").select(COL("kyc_ref_no").alias("_ref")).distinct()
        on = [COL("kyc_ref_no")], [COL("_ref")]
        nowhere = spread_join(unrated, files, *on, COL("customer_no"), v.hot_refs, "left_anti")
        row = nowhere.agg(F.count("*").alias("n"))
        return explode_metrics(row, "AML-106", metric("clients_without_any_risk", COL("n")))

    return Check(
        "AML-106", "Risk profile missing",
        counts=[Count("clients_without_risk_profile", "c", blank, _everyone())],
        metrics=metrics,
        groups=lambda v: _frequency("AML-106", "files_by_risk_level", v, "m", "risk_level"),
        gates=[
            Gate(CRITICAL, "clients_without_risk_profile", "No client has a risk profile", "all"),
            Gate(NOTE, "clients_without_risk_profile", "Risk read from the KYC files instead", "all"),
        ],
    )


def _active_without_kyc(v: Views) -> DataFrame:
    accounts = v("a").filter(is_open() & active_since(v.params, 12)).select("cust_ac_no", "cust_no")
    clients = v("c").filter(X.is_blank(COL("kyc_ref_no"))).select("customer_no")
    return accounts.join(clients, COL("cust_no") == COL("customer_no"))


def _check_107(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        row = _active_without_kyc(v).agg(F.count_distinct("cust_ac_no").alias("n"))
        return explode_metrics(row, "AML-107", metric("active_accounts_without_kyc", COL("n")))

    def sample(v: Views) -> DataFrame:
        active = account_summary(v.bank["sttm_cust_account"], is_open() & active_since(v.params, 12)).alias("o")
        rows = v("c").filter(_no_reference()).join(active, COL("o.cust_no") == COL("c.customer_no"))
        return top_sample(rows.select(*_client_columns()), [down("balance")], 20)

    return Check(
        "AML-107", "Accounts in use whose client has no KYC", metrics=metrics,
        gates=[Gate(CRITICAL, "active_accounts_without_kyc", "{n} accounts operate without KYC file")],
        samples={"": sample},
    )


# ---- section 2: exposed and high-risk clients --------------------------------------------------
def _exposed() -> Column:
    return COL("r.pep") == "Y"


def _exposed_list(v: Views) -> DataFrame:
    rows = v("rco").filter(_exposed() & _opened()).select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        COL("c.customer_category").alias("customer_category"), COL("r.nationality").alias("nationality"),
        COL("o.n_accounts").alias("n_accounts"), COL("o.balance").alias("balance"),
        F.to_date("o.last_activity").alias("last_activity"),
        F.when(X.is_set(COL("r.pep_remarks")), "Y").otherwise("N").alias("documented"),
    )
    return top_sample(rows, [down("balance")], 25)


def _undocumented_list(v: Views) -> DataFrame:
    rows = v("rco").filter(_exposed() & X.is_blank(COL("r.pep_remarks"))).select(*_client_columns(optional=True))
    return top_sample(rows, [down("balance")], 20)


def _check_201(v: Views) -> Check:
    return Check(
        "AML-201", "Politically exposed persons",
        counts=[
            Count("exposed_persons", "r", _exposed(), _everyone()),
            Count("exposed_persons_with_open_account", "rco", _exposed() & _opened()),
        ],
        samples={"": _exposed_list},
    )


def _check_202(v: Views) -> Check:
    return Check(
        "AML-202", "Exposed persons without documentation",
        counts=[Count("exposed_without_remarks", "r", _exposed() & X.is_blank(COL("r.pep_remarks")))],
        gates=[Gate(HIGH, "exposed_without_remarks", "{n} exposed persons carry no remark")],
        samples={"": _undocumented_list},
    )


def _check_203(v: Views) -> Check:
    level = v.params.high_risk_level
    high = COL("m.risk_level") == level
    return Check(
        "AML-203", "High-risk clients with open accounts",
        counts=[
            Count("high_risk_files", "m", high),
            Count("high_risk_with_open_account", "mco", high & _opened()),
        ],
        groups=lambda v: _frequency("AML-203", "high_risk_by_type", v, "m", "kyc_cust_type", COL("risk_level") == level),
        samples={"": _clients("mco", lambda v: COL("m.risk_level") == v.params.high_risk_level, 20)},
    )


def _check_204(v: Views) -> Check:
    away = COL("r.resident") == "N"
    return Check(
        "AML-204", "Non-resident clients",
        counts=[
            Count("non_residents_kyc", "r", away),
            Count("non_residents_personal", "p", COL("p.resident_status") == "N"),
            Count("non_residents_with_open_account", "rco", away & _opened()),
        ],
        groups=lambda v: _frequency(
            "AML-204", "non_residents_by_nationality", v, "r", "nationality",
            (COL("resident") == "N") & X.is_set(COL("nationality")), 10),
        samples={"": _clients("rco", lambda v: COL("r.resident") == "N", 15)},
    )


def _attorneys(v: Views) -> DataFrame:
    rows = v("pco").filter((COL("p.pa_issued") == "Y") & _opened()).select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        COL("p.pa_holder_name").alias("holder_name"), COL("p.pa_holder_nationalty").alias("holder_nationality"),
        COL("o.n_accounts").alias("n_accounts"), COL("o.balance").alias("balance"),
        F.to_date("o.last_activity").alias("last_activity"),
    )
    return top_sample(rows, [down("balance")], 20)


def _check_205(v: Views) -> Check:
    issued = COL("p.pa_issued") == "Y"
    return Check(
        "AML-205", "Powers of attorney",
        counts=[
            Count("attorney_given_kyc", "r", COL("r.pa_given") == "Y"),
            Count("attorney_issued_personal", "po", issued),
            Count("attorney_issued_with_open_account", "po", issued & _opened()),
        ],
        samples={"": _attorneys},
    )


def _sensitive(v: Views) -> DataFrame:
    per_category = v("co").groupBy(COL("c.customer_category").alias("code")).agg(
        F.count("*").alias("n_clients"), F.count_if(_opened()).alias("n_with_open_account")
    )
    wanted = v("t").filter(COL("cust_cat").isin(*v.params.sensitive_categories))
    joined = wanted.join(per_category, COL("cust_cat") == COL("code"), "left")
    return joined.select(
        "cust_cat", "cust_cat_desc",
        F.coalesce("n_clients", F.lit(0)).alias("n_clients"),
        F.coalesce("n_with_open_account", F.lit(0)).alias("n_with_open_account"),
    )


def _check_206(v: Views) -> Check:
    return Check(
        "AML-206", "Client categories under closer watch",
        samples={"": lambda v: top_sample(_sensitive(v), [COL("n_clients").desc()], len(v.params.sensitive_categories))},
    )


# ---- section 3: identity ---------------------------------------------------------------------
def _shared_metrics(check_id: str, v: Views, alias: str, key: str) -> DataFrame:
    row = shared_values(v.table(alias), key).agg(F.count("*").alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))
    return explode_metrics(row, check_id, metric("shared_values", COL("ids")), metric("clients_involved", COL("members")))


def _sharing_clients(v: Views, view: str, alias: str, key: str, *shown: str) -> DataFrame:
    """Clients behind shared values, by value and then by balance. A value may be shared by a
    large part of all clients, so its rows meet the list of values in slices."""
    rows = v(view).filter(X.is_set(COL(f"{alias}.{key}"))).select(
        COL(f"{alias}.{key}").alias(key), COL("c.customer_no").alias("customer_no"),
        COL("c.customer_name1").alias("customer_name"), *[COL(f"c.{s}").alias(s) for s in shown],
        F.coalesce("o.n_accounts", F.lit(0)).alias("n_accounts"),
        X.exact(F.coalesce("o.balance", F.lit(0))).alias("balance"),
        F.to_date("o.last_activity").alias("last_activity"),
    )
    shared = shared_values(v.table(alias), key).select(COL(key).alias("_shared"))
    hot = hot_keys(v.table(alias), key)
    involved = spread_join(rows, shared, [COL(key)], [COL("_shared")], COL("customer_no"), hot, "left_semi")
    return top_sample(involved, [up(key), down("balance")], 20)


def _check_301(v: Views) -> Check:
    return Check(
        "AML-301", "National identity numbers shared by clients",
        metrics=lambda v: _shared_metrics("AML-301", v, "p", "p_national_id"),
        gates=[Gate(HIGH, "shared_values", "{n} national identity numbers are shared")],
        samples={"": lambda v: _sharing_clients(v, "pco", "p", "p_national_id", "customer_type")},
    )


def _check_302(v: Views) -> Check:
    return Check(
        "AML-302", "Unique identifiers shared by clients",
        metrics=lambda v: _shared_metrics("AML-302", v, "c", "unique_id_value"),
        gates=[Gate(HIGH, "shared_values", "{n} unique identifiers are shared")],
        samples={"": lambda v: _sharing_clients(v, "co", "c", "unique_id_value", "unique_id_name").drop("last_activity")},
    )


def _check_303(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        rows = [
            explode_metrics(
                shared_values(v.table(alias), "passport_no").agg(F.count("*").alias("n")), "AML-303", metric(name, COL("n"))
            )
            for alias, name in (("p", "shared_passports_personal"), ("r", "shared_passports_kyc"))
        ]
        return rows[0].unionByName(rows[1])

    return Check("AML-303", "Passport numbers shared by clients", metrics=metrics)


def _unidentified() -> Column:
    return (COL("c.customer_type") == "I") & X.is_blank(COL("c.unique_id_value")) & _no_identity()


def _check_304(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        found = v("cpxo").agg(
            F.count_if(_unidentified()).alias("n"), F.count_if(_unidentified() & _opened()).alias("n_open")
        )
        everyone = v("c").agg(F.count_if(COL("customer_type") == "I")).scalar()
        row = found.withColumn("total", everyone)
        return explode_metrics(
            row, "AML-304", metric("individuals_unidentified", COL("n"), COL("total")),
            metric("unidentified_with_open_account", COL("n_open")),
        )

    return Check(
        "AML-304", "Individuals without any identification", metrics=metrics,
        gates=[Gate(CRITICAL, "unidentified_with_open_account", "{n} individuals operate accounts without identification")],
        samples={"": _clients("cpxo", lambda v: _unidentified(), 15)},
    )


def _birth_dates_differ() -> Column:
    return COL("p.date_of_birth") != COL("r.birth_date")


def _birth_date_list(v: Views) -> DataFrame:
    rows = v("prco").filter(_birth_dates_differ()).select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        F.to_date("p.date_of_birth").alias("birth_date_personal"), F.to_date("r.birth_date").alias("birth_date_kyc"),
        F.coalesce("o.n_accounts", F.lit(0)).alias("n_accounts"),
        X.exact(F.coalesce("o.balance", F.lit(0))).alias("balance"),
    )
    return top_sample(rows, [down("balance")], 15)


def _check_305(v: Views) -> Check:
    return Check(
        "AML-305", "Birth dates that differ between files",
        counts=[Count("birth_date_mismatches", "cpr", _birth_dates_differ())],
        gates=[Gate(MEDIUM, "birth_date_mismatches", "{n} birth dates differ between the personal and the KYC file")],
        samples={"": _birth_date_list},
    )


def _underage(v: Views) -> Column:
    return X.years_since(COL("p.date_of_birth"), v.params.as_of) < 18


def _minor(v: Views) -> Column:
    return (COL("p.minor") == "Y") | _underage(v)


def _check_306(v: Views) -> Check:
    return Check(
        "AML-306", "Minors with open accounts",
        counts=[
            Count("minors_by_flag", "po", COL("p.minor") == "Y"),
            Count("minors_by_age", "po", _underage(v)),
            Count("minors_with_open_account", "po", _minor(v) & _opened()),
        ],
        samples={"": _clients("pco", _minor, 15)},
    )


# ---- section 4: transactions ------------------------------------------------------------------
def _history(v: Views) -> DataFrame:
    return v.bank["actb_history"]


def _accounts(v: Views) -> DataFrame:
    return v.bank["sttm_cust_account"]


def _customers(v: Views) -> DataFrame:
    return v.bank["sttm_customer"]


def _with_rating(v: Views, per_holder: DataFrame) -> DataFrame:
    """Attach name and rating (of each KYC row) to rows keyed by ``cust_no``."""
    named = T.with_customer(per_holder, _customers(v), "kyc_ref_no")
    m = v.bank["sttm_kyc_master"].select(COL("kyc_ref_no").alias("_ref"), "risk_level")
    return lookup(named, m, COL("kyc_ref_no"), COL("_ref"), COL("cust_no")).drop("_ref", "kyc_ref_no")


def _per_value(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count("*").alias("n"), X.exact(F.coalesce(F.sum("lcy_amount"), F.lit(0))).alias("volume")
    )


def _overall(per_value: DataFrame, check_id: str, name: str) -> DataFrame:
    """Count and volume over all, summed from the few group rows: in a full run both branches
    share one exchange. The row is there (as 0) even when nothing qualifies."""
    zero = F.lit(0)
    whole = per_value.agg(F.coalesce(F.sum("n"), zero).alias("n"), F.coalesce(F.sum("volume"), zero).alias("volume"))
    return explode_metrics(whole, check_id, metric(name, COL("n"), amount=COL("volume")))


def _period(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        start = v.params.days_ago(v.params.window_days)
        if v.ledger is not None:
            rows, n, credit = v.ledger.window(start), F.coalesce(F.sum("n"), F.lit(0)), COL("credit")
        else:
            rows, n, credit = T.since(_history(v), start), F.count("*"), F.when(COL("drcr_ind") == "C", COL("lcy_amount"))
        row = rows.agg(n.alias("n"), F.count_distinct("ac_no").alias("accounts"), F.sum(credit).alias("credits"))
        return explode_metrics(
            row, "AML-400", metric("transactions", COL("n")), metric("active_accounts", COL("accounts")),
            metric("credit_volume", amount=F.coalesce("credits", F.lit(0))),
        )

    return Check("AML-400", "Totals of the monitoring window", metrics=metrics)


def _check_401(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        cash = T.large_cash(_history(v), v.params)
        clients = T.holders_of(cash, _accounts(v))
        return _overall(_per_value(cash, "drcr_ind"), "AML-401", "large_cash_operations").unionByName(
            explode_metrics(clients, "AML-401", metric("large_cash_clients", COL("n_clients")))
        )

    def groups(v: Views) -> DataFrame:
        per_side = _per_value(T.large_cash(_history(v), v.params), "drcr_ind")
        return grouped_metrics(per_side, "AML-401", "large_cash_by_side", COL("drcr_ind"), COL("n"), COL("volume"))

    def sample(v: Views) -> DataFrame:
        cash = T.large_cash(_history(v), v.params).select("ac_no", "drcr_ind", "lcy_amount", "trn_dt")
        rows = T.with_customer(T.with_holder(cash, _accounts(v)), _customers(v)).select(
            "cust_no", "customer_name", "ac_no", "drcr_ind", X.exact(COL("lcy_amount")).alias("amount"), "trn_dt"
        )
        return top_sample(rows, [down("amount")], 20)

    return Check(
        "AML-401", "Cash operations at or above the reporting threshold", metrics=metrics, groups=groups,
        gates=[Gate(CRITICAL, "large_cash_operations", "{n} cash operations reach the reporting threshold")],
        samples={"": sample},
    )


def _check_402(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        days = T.structuring(_history(v), v.params, v.ledger).agg(F.count("*").alias("n"))
        clients = T.structuring_client_days(_history(v), _accounts(v), v.params, v.ledger).agg(
            F.count("*").alias("days"), F.count_distinct("cust_no").alias("clients")
        )
        return explode_metrics(days, "AML-402", metric("suspicious_account_days", COL("n"))).unionByName(
            explode_metrics(
                clients, "AML-402", metric("suspicious_client_days", COL("days")), metric("suspicious_clients", COL("clients"))
            )
        )

    def sample(v: Views) -> DataFrame:
        per_day = T.with_customer(T.with_holder(T.cash_days(_history(v), v.params, v.ledger), _accounts(v)), _customers(v))
        grouped = per_day.groupBy("cust_no", "customer_name", "ac_no", "day").agg(
            F.sum("n").alias("n"), X.exact(F.sum("total")).alias("total")
        )
        return top_sample(grouped.filter(T.is_structured(v.params)), [down("total")], 15)

    return Check(
        "AML-402", "Structuring below the cash threshold", metrics=metrics,
        gates=[Gate(CRITICAL, "suspicious_account_days", "{n} account-days look like structuring")],
        samples={"": sample},
    )


def _check_403(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        dormant, active = T.dormant_accounts(_accounts(v), v.params), T.recent_activity(_history(v), v.params, v.ledger)
        n = has_related(dormant, active, "cust_ac_no", "ac_no").agg(F.count("*").alias("n"))
        volume = has_related(active, dormant, "ac_no", "cust_ac_no").agg(F.sum("volume").alias("volume"))
        return explode_metrics(n, "AML-403", metric("reactivated_accounts", COL("n"))).unionByName(
            explode_metrics(volume, "AML-403", metric("reactivated_volume", amount=F.coalesce("volume", F.lit(0))))
        )

    def sample(v: Views) -> DataFrame:
        moved = T.dormant_reactivated(_accounts(v), _history(v), v.params, v.ledger)
        rows = T.with_customer(moved, _customers(v)).select(
            "cust_no", "customer_name", "cust_ac_no",
            F.to_date(F.greatest("date_last_cr_activity", "date_last_dr_activity")).alias("last_before"),
            X.exact(F.coalesce("volume", F.lit(0))).alias("volume"), "n",
        )
        return top_sample(rows, [down("volume")], 15)

    return Check(
        "AML-403", "Dormant accounts back in use", metrics=metrics,
        gates=[Gate(HIGH, "reactivated_accounts", "{n} dormant accounts were used again")], samples={"": sample},
    )


def _check_404(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        per_country = T.risky_transfers(_history(v), _accounts(v), _customers(v), v.params)
        return _overall(per_country, "AML-404", "risk_country_transfers")

    def groups(v: Views) -> DataFrame:
        per_country = T.risky_transfers(_history(v), _accounts(v), _customers(v), v.params)
        top = per_country.orderBy(COL("n").desc(), COL("risk_country").asc_nulls_last()).limit(10)
        return grouped_metrics(
            top, "AML-404", "transfers_by_country", COL("risk_country"), COL("n"), F.coalesce("volume", F.lit(0))
        )

    return Check(
        "AML-404", "Transfers involving listed countries", metrics=metrics, groups=groups,
        gates=[Gate(CRITICAL, "risk_country_transfers", "{n} transfers involve a listed country")],
    )


def _check_405(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        night = T.off_hours(_history(v), v.params)
        return _overall(_per_value(night, "hour_of_day"), "AML-405", "night_transactions").unionByName(
            explode_metrics(T.holders_of(night, _accounts(v)), "AML-405", metric("night_clients", COL("n_clients")))
        )

    def groups(v: Views) -> DataFrame:
        per_hour = _per_value(T.off_hours(_history(v), v.params), "hour_of_day")
        return grouped_metrics(per_hour, "AML-405", "night_by_hour", COL("hour_of_day"), COL("n"), COL("volume"))

    return Check(
        "AML-405", "Large transactions outside business hours", metrics=metrics, groups=groups,
        gates=[Gate(MEDIUM, "night_transactions", "{n} large transactions took place outside business hours")],
    )


def _check_406(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        per_account = T.round_amounts(_history(v), v.params, v.ledger)
        per_client = T.with_holder(per_account, _accounts(v)).groupBy("cust_no").agg(F.sum("n").alias("n"))
        often = per_client.agg(F.count_if(COL("n") >= v.params.round_min_count).alias("n"))
        return explode_metrics(
            per_account.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "AML-406", metric("round_transactions", COL("n"))
        ).unionByName(explode_metrics(often, "AML-406", metric("round_amount_clients", COL("n"))))

    def sample(v: Views) -> DataFrame:
        rows = _with_rating(v, T.with_holder(T.round_amounts(_history(v), v.params, v.ledger), _accounts(v)))
        grouped = rows.groupBy("cust_no", "customer_name", "risk_level").agg(
            F.sum("n").alias("n"), X.exact(F.sum("volume")).alias("volume")
        )
        return top_sample(grouped.filter(COL("n") >= v.params.round_min_count), [COL("n").desc()], 15)

    return Check(
        "AML-406", "Repeated round amounts", metrics=metrics,
        gates=[Gate(HIGH, "round_amount_clients", "{n} clients repeat round amounts")], samples={"": sample},
    )


def _check_407(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        row = T.pass_through(_history(v), v.params).agg(F.count("*").alias("n"))
        return explode_metrics(row, "AML-407", metric("pass_through_accounts", COL("n")))

    def sample(v: Views) -> DataFrame:
        held = T.with_holder(
            T.pass_through(_history(v), v.params), _accounts(v), "acy_curr_balance", "date_last_cr_activity"
        )
        rows = T.with_customer(held, _customers(v)).select(
            "cust_no", "customer_name", "ac_no", X.exact(COL("acy_curr_balance")).alias("balance"),
            F.to_date("date_last_cr_activity").alias("last_credit"),
        )
        return top_sample(rows.distinct(), [down("balance")], 15)

    return Check(
        "AML-407", "Pass-through accounts", metrics=metrics,
        gates=[Gate(HIGH, "pass_through_accounts", "{n} accounts pass money through")], samples={"": sample},
    )


def _check_408(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        busy = T.high_frequency(_history(v), _accounts(v), v.params, v.ledger)
        row = busy.agg(F.count("*").alias("busy"), F.count_if(COL("n") > v.params.very_busy_count).alias("very_busy"))
        return explode_metrics(
            row, "AML-408", metric("busy_clients", COL("busy")), metric("very_busy_clients", COL("very_busy"))
        )

    def sample(v: Views) -> DataFrame:
        rows = _with_rating(v, T.with_holder(T.recent_activity(_history(v), v.params, v.ledger), _accounts(v)))
        grouped = rows.groupBy("cust_no", "customer_name", "risk_level").agg(
            F.sum("n").alias("n"), F.count_distinct("ac_no").alias("n_accounts"), X.exact(F.sum("volume")).alias("volume")
        )
        return top_sample(grouped.filter(COL("n") > v.params.busy_count), [COL("n").desc()], 15)

    return Check(
        "AML-408", "Unusually frequent transactions", metrics=metrics,
        gates=[Gate(HIGH, "busy_clients", "{n} clients transact unusually often")], samples={"": sample},
    )


def _check_409(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        if "aaml_sir_details" not in v.bank:
            row = v.bank.spark.range(1)
            return explode_metrics(row, "AML-409", metric("alert_table_missing", F.lit(1)))
        row = T.alert_ageing(v.bank["aaml_sir_details"], v.params)
        return explode_metrics(
            row, "AML-409", metric("alerts_open_over_limit", COL("late")), metric("alerts_open_over_30_days", COL("stale")),
            metric("alerts_12_months", COL("year")),
        )

    def groups(v: Views) -> DataFrame | None:
        if "aaml_sir_details" not in v.bank:
            return None
        p, alerts = v.params, v.bank["aaml_sir_details"]
        year = COL("sir_date") >= X.ts(p.months_ago(12))
        by_status = alerts.filter(year).groupBy("sir_status").agg(F.count("*").alias("n"))
        by_band = T.alert_delays(alerts, p)
        names = F.array(*map(F.lit, ALERT_BANDS))
        return union_all([
            grouped_metrics(by_status, "AML-409", "alerts_by_status", COL("sir_status"), COL("n")),
            grouped_metrics(by_band, "AML-409", "alerts_by_delay", F.element_at(names, COL("band")), COL("n")),
        ])

    return Check(
        "AML-409", "Suspicion reports not closed in time", metrics=metrics, groups=groups,
        gates=[
            Gate(CRITICAL, "alerts_open_over_limit", "{n} reports exceed the legal delay"),
            Gate(CRITICAL, "alerts_open_over_30_days", "{n} reports are open for more than 30 days"),
            Gate(INFO, "alert_table_missing", "The alert table is absent; check skipped"),
        ],
    )


def _exposed_flows(v: Views) -> DataFrame:
    return T.exposed_flows(_history(v), _accounts(v), _customers(v), v.params, v.ledger)


def _check_410(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        flows = _exposed_flows(v)
        r = v.bank["sttm_kyc_retail"].filter(COL("pep") == "Y").select(COL("kyc_ref_no").alias("_ref"))
        m = v.bank["sttm_kyc_master"].filter(COL("risk_level") == v.params.high_risk_level).select(COL("kyc_ref_no").alias("_ref"))
        zero = F.lit(0)
        pep = flows.join(r, COL("kyc_ref_no") == COL("_ref")).agg(
            F.coalesce(F.sum("n"), zero).alias("n_pep"), F.coalesce(F.sum("volume"), zero).alias("volume")
        )
        high = flows.join(m, COL("kyc_ref_no") == COL("_ref")).agg(F.coalesce(F.sum("n_high"), zero)).scalar()
        row = pep.withColumn("n_high", high)
        return explode_metrics(
            row, "AML-410", metric("exposed_transactions", COL("n_pep"), amount=COL("volume")),
            metric("high_risk_transactions", COL("n_high")), metric("watched_transactions", COL("n_pep") + COL("n_high")),
        )

    def sample(v: Views) -> DataFrame:
        r = v.bank["sttm_kyc_retail"].select(COL("kyc_ref_no").alias("_r"), "pep")
        m = v.bank["sttm_kyc_master"].select(COL("kyc_ref_no").alias("_m"), "risk_level")
        with_pep = lookup(_exposed_flows(v), r, COL("kyc_ref_no"), COL("_r"), COL("ac_no"))
        rows = lookup(with_pep, m, COL("kyc_ref_no"), COL("_m"), COL("ac_no"))
        watched = F.coalesce(COL("pep") == "Y", F.lit(False)) | F.coalesce(
            COL("risk_level") == v.params.high_risk_level, F.lit(False)
        )
        grouped = rows.filter(watched).groupBy("cust_no", "customer_name", "pep", "risk_level").agg(
            F.sum("n").alias("n"), X.exact(F.sum("volume")).alias("volume")
        )
        shown = grouped.select(
            "cust_no", "customer_name", F.when(COL("pep") == "Y", "PEP").alias("profile"),
            F.coalesce("risk_level", F.lit("N/A")).alias("risk_level"), "n", "volume",
        )
        return top_sample(shown, [down("volume")], 15)

    return Check(
        "AML-410", "Large flows of exposed and high-risk clients", metrics=metrics,
        gates=[Gate(FOCUS, "watched_transactions", "Exposed and high-risk clients with large transactions")],
        samples={"": sample},
    )


def _header(v: Views) -> Check:
    def metrics(v: Views) -> DataFrame:
        sizes = [
            explode_metrics(v(alias).agg(F.count("*").alias("n")), "AML-000", metric(name, COL("n")))
            for alias, name in (("c", "clients"), ("a", "accounts"), ("h", "transactions"))
        ]
        return union_all(sizes)

    return Check("AML-000", "Population", metrics=metrics)


# One builder per check: column expressions are made only for the checks a run asks for.
BUILDERS: dict[str, Callable[[Views], Check]] = {
    "AML-000": _header,
    "AML-101": _check_101, "AML-102": _check_102, "AML-103": _check_103, "AML-104": _check_104,
    "AML-105": _check_105, "AML-106": _check_106, "AML-107": _check_107,
    "AML-201": _check_201, "AML-202": _check_202, "AML-203": _check_203, "AML-204": _check_204,
    "AML-205": _check_205, "AML-206": _check_206,
    "AML-301": _check_301, "AML-302": _check_302, "AML-303": _check_303, "AML-304": _check_304,
    "AML-305": _check_305, "AML-306": _check_306,
    "AML-400": _period,
    "AML-401": _check_401, "AML-402": _check_402, "AML-403": _check_403, "AML-404": _check_404,
    "AML-405": _check_405, "AML-406": _check_406, "AML-407": _check_407, "AML-408": _check_408,
    "AML-409": _check_409, "AML-410": _check_410,
}
CHECK_IDS = tuple(BUILDERS)


def all_checks(v: Views) -> list[Check]:
    return [build(v) for build in BUILDERS.values()]


def find_check(v: Views, check_id: str) -> Check:
    return BUILDERS[check_id](v)


def metrics(v: Views, checks: Sequence[Check] | None = None, gated_only: bool = False) -> DataFrame:
    """Metric rows of the checks; counts over the same view share one scan and one aggregate.
    ``gated_only`` leaves out what no finding depends on."""
    checks = list(checks if checks is not None else all_checks(v))
    if gated_only:
        checks = [
            replace(c, groups=None, counts=[n for n in c.counts if n.name in {g.metric for g in c.gates}])
            for c in checks if c.gates
        ]
        # What is left of a check's own plan matters only where a gate is not a declared count.
        checks = [
            replace(c, metrics=None) if {g.metric for g in c.gates} <= {n.name for n in c.counts} else c for c in checks
        ]
    by_view: dict[str, list[tuple[str, Count]]] = {}
    for check in checks:
        for count in check.counts:
            by_view.setdefault(count.view, []).append((check.id, count))
    parts: list[DataFrame] = []
    for view, members in by_view.items():
        cells = []
        for i, (_, count) in enumerate(members):
            cells.append(F.count_if(count.when).alias(f"_n{i}"))
            if count.of is not None:
                cells.append(F.count_if(count.of).alias(f"_t{i}"))
        rows = [
            F.struct(
                F.lit(check_id).alias("check_id"),
                metric(count.name, COL(f"_n{i}"), None if count.of is None else COL(f"_t{i}")).alias("m"),
            )
            for i, (check_id, count) in enumerate(members)
        ]
        parts.append(v(view).agg(*cells).select(F.inline(F.array(*rows))).select("check_id", "m.*"))
    parts += [c.metrics(v) for c in checks if c.metrics is not None]
    parts += [rows for c in checks if c.groups is not None and (rows := c.groups(v)) is not None]
    if not parts:
        return v.bank.spark.createDataFrame([], f"check_id string, {METRIC_FIELDS.split(', ', 1)[1]}")
    return union_all(parts)


def findings(v: Views, metric_rows: DataFrame, checks: Sequence[Check] | None = None) -> DataFrame:
    """(check_id, severity, metric, n, message): gates met by the metrics. The gates are a few
    dozen constant rows, hence the broadcast."""
    checks = list(checks if checks is not None else all_checks(v))
    gates = [(c.id, g.metric, g.when, g.severity, g.message) for c in checks for g in c.gates]
    rules = v.bank.spark.createDataFrame(gates, "check_id string, metric string, rule string, severity string, message string")
    joined = metric_rows.filter(COL("grp").isNull()).join(F.broadcast(rules), ["check_id", "metric"])
    met = (
        (COL("rule") == "always")
        | ((COL("rule") == "positive") & (COL("n") > 0))
        | ((COL("rule") == "all") & (COL("n") == COL("total")))
    )
    text = F.replace("message", F.lit("{n}"), F.coalesce(COL("n").cast("string"), F.lit("")))
    return joined.filter(met).select("check_id", "severity", "metric", "n", text.alias("message"))


def check_sample(v: Views, check_id: str, name: str = "") -> DataFrame:
    return find_check(v, check_id).samples[name](v)
