"""The coherence rules: what each one compares, counts and shows.

A rule over a join view is a predicate; all predicates of a view are counted in one aggregate.
Rules that need grouping, existence tests or flows bring their own count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlens.functions import expressions as X
from tellerlens.operators import flows as FL
from tellerlens.operators.compare import differs, in_category
from tellerlens.operators.conflicts import (
    conflicting_profiles, minority_value, peer_risk_conflict, profile_conflict, shared_identity_conflict,
)
from tellerlens.operators.duplicates import duplicate_groups, ordered_list, shared_values
from tellerlens.operators.ranking import down, top_sample, up, verdict
from tellerlens.operators.relations import lacks_related, lookup, maybe_key, to_many, union_all
from tellerlens.params import (
    BANK_CATEGORIES, CEMAC_COUNTRIES, CORPORATE_CATEGORIES, INDIVIDUAL_CATEGORIES, INTERBANK_MODULES,
    NON_RESIDENT_CATEGORIES, RunParams,
)
from tellerlens.plans.views import Views

COL = F.col
Predicate = Callable[[RunParams], Column]


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    section: int
    count: Callable[[Views], DataFrame] | None = None  # one row, column n
    samples: Mapping[str, Callable[[Views], DataFrame]] = field(default_factory=dict)
    view: str | None = None
    where: Predicate | None = None
    judged: bool = True


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def _ranked_by_balance(df: DataFrame, totals: DataFrame, k: int, key: str = "customer_no") -> DataFrame:
    """Attach the holder's total (0 when there is none) and keep the ``k`` richest."""
    t = totals.select(COL("cust_no").alias("_holder"), "total_balance")
    joined = lookup(df, t, COL(key), COL("_holder"), COL(df.columns[0])).drop("_holder")
    filled = joined.withColumn("total_balance", X.exact(F.coalesce("total_balance", F.lit(0))))
    return top_sample(filled, [down("total_balance")], k)


def _client_rule(
    rule_id: str, title: str, view: str, where: Predicate, show: Mapping[str, Column | Callable[[RunParams], Column]] | None = None,
    open_only: bool = False, k: int = 30,
) -> Rule:
    """Rule at client grain: predicate over a view, sample ranked by the client's total balance."""
    shown = show or {}

    def sample(v: Views) -> DataFrame:
        extra = [(e(v.params) if callable(e) else e).alias(name) for name, e in shown.items()]
        rows = v(view).filter(where(v.params)).select(
            COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"), *extra
        )
        return _ranked_by_balance(rows, v.open_totals if open_only else v.totals, k)

    return Rule(rule_id, title, int(rule_id.split(".")[0]), samples={"": sample}, view=view, where=where)


def _day(name: str) -> Column:
    return F.to_date(name)


def _category() -> Column:
    return COL("c.customer_category")


def _type() -> dict:
    return {"customer_type": COL("c.customer_type")}


# ---- 1: identity fields kept twice ----------------------------------------------------------
def _field_pair(rule_id: str, title: str, view: str, left: str, right: str, kind: str = "text") -> Rule:
    if kind == "date":
        where = lambda p: differs(left, right, "raw")
        show = {"left_value": _day(left), "right_value": _day(right)}
    else:
        where = lambda p: differs(left, right, kind)
        show = {"left_value": F.trim(left), "right_value": F.trim(right)}
    return _client_rule(rule_id, title, view, where, show)


def identity_rules() -> list[Rule]:
    return [
        _field_pair("1.1", "Birth date differs: personal file and retail KYC", "cpr", "p.date_of_birth", "r.birth_date", "date"),
        _field_pair("1.2", "Birth country differs", "cpr", "p.birth_country", "r.birth_country"),
        _field_pair("1.3", "Birth place differs", "cpr", "p.place_of_birth", "r.birth_place", "upper"),
        _field_pair("1.4", "Passport number differs", "cpr", "p.passport_no", "r.passport_no"),
        _field_pair("1.5", "Passport expiry differs", "cpr", "p.ppt_exp_date", "r.passport_expiry_date", "date"),
        _field_pair("1.6", "US residence status differs", "cpr", "p.us_res_status", "r.us_res_status"),
        _field_pair("1.7", "Power of attorney: issued and given differ", "cpr", "p.pa_issued", "r.pa_given"),
        _field_pair("1.8", "Power of attorney holder differs", "cpr", "p.pa_holder_name", "r.pa_holder_name", "upper"),
        _client_rule(
            "1.9", "Residence codes contradict each other", "cpr",
            lambda p: differs("p.resident_status", "r.resident", "code", {"R": "Y", "N": "N"}),
            {"left_value": F.trim("p.resident_status"), "right_value": F.trim("r.resident")},
        ),
        _field_pair("1.10", "Nationality differs: client and retail KYC", "cr", "c.nationality", "r.nationality"),
    ]


# ---- 2: client type against detail files -----------------------------------------------------
def _missing_detail(rule_id: str, title: str, view: str, where: Predicate, detail: str, key: str, show) -> Rule:
    """Clients of a kind without their detail file."""

    def flagged(v: Views) -> DataFrame:
        extra = [e.alias(n) for n, e in show.items()]
        rows = v(view).filter(where(v.params)).select(
            COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
            COL(f"c.{key}").alias("_key"), *extra,
        )
        return lacks_related(rows, v(detail), "_key", f"{detail}.{key}", spread="customer_no").drop("_key")

    return Rule(
        rule_id, title, 2, count=lambda v: _n(flagged(v)),
        samples={"": lambda v: _ranked_by_balance(flagged(v), v.totals, 30)},
    )


def type_rules() -> list[Rule]:
    return [
        _client_rule(
            "2.1", "Client type and KYC type do not correspond", "cm",
            lambda p: X.is_set(COL("c.kyc_ref_no"), "trim")
            & X.maps_to_other(COL("c.customer_type"), COL("m.kyc_cust_type"), {"I": "R", "C": "C", "B": "F"}),
            {"left_value": COL("c.customer_type"), "right_value": COL("m.kyc_cust_type")},
        ),
        _missing_detail(
            "2.2", "Individual without personal file", "c", lambda p: COL("c.customer_type") == "I", "p", "customer_no",
            {**_type(), "category": F.coalesce("c.customer_category", F.lit("-"))},
        ),
        _missing_detail(
            "2.3", "Company with company KYC but no corporate file", "cm",
            lambda p: (COL("c.customer_type") == "C") & (COL("m.kyc_cust_type") == "C"), "k", "kyc_ref_no", _type(),
        ),
        _missing_detail(
            "2.4", "Individual with retail KYC but no retail file", "cm",
            lambda p: (COL("c.customer_type") == "I") & (COL("m.kyc_cust_type") == p.coherence_individual_type),
            "r", "kyc_ref_no", _type(),
        ),
        _client_rule(
            "2.5", "Staff flag outside the staff category", "c",
            lambda p: (COL("c.staff") == "Y") & (COL("c.customer_category") != "STAF"),
            {"left_value": COL("c.staff"), "right_value": COL("c.customer_category")},
        ),
        _client_rule(
            "2.6", "Staff category without staff flag", "c",
            lambda p: (COL("c.customer_category") == "STAF") & X.not_equal_or_null(COL("c.staff"), "Y"),
            {"left_value": COL("c.customer_category"), "right_value": F.coalesce("c.staff", F.lit("NULL"))},
        ),
        _client_rule(
            "2.7", "Exposed-person category without the KYC flag", "cr",
            lambda p: (COL("c.customer_category") == "PEP/FEPS") & X.not_equal_or_null(COL("r.pep"), "Y"),
            {"left_value": COL("c.customer_category"), "right_value": F.coalesce("r.pep", F.lit("NULL"))},
        ),
        _client_rule(
            "2.8", "KYC flags an exposed person outside the category", "cr",
            lambda p: (COL("r.pep") == "Y") & (COL("c.customer_category") != "PEP/FEPS"),
            {"left_value": COL("r.pep"), "right_value": COL("c.customer_category")},
        ),
    ]


# ---- 3: category against age, income and residence ---------------------------------------------
def _age(p: RunParams) -> Column:
    return X.years_since(COL("p.date_of_birth"), p.as_of)


def _age_shown() -> dict:
    return {"age": lambda p: F.floor(_age(p)).cast("bigint"), "date_of_birth": _day("p.date_of_birth")}


def _age_rule(rule_id: str, title: str, category: str, test: Callable[[Column], Column]) -> Rule:
    return _client_rule(rule_id, title, "cp", lambda p: in_category("c.customer_category", category, test(_age(p))), _age_shown())


def _income_rule(rule_id: str, title: str, category: str, test: Callable[[Column], Column]) -> Rule:
    income = COL("r.total_income")
    return _client_rule(
        rule_id, title, "cr", lambda p: in_category("c.customer_category", category, (income > 0) & test(income)),
        {"total_income": income},
    )


# Yearly limits are fifteen monthly salaries.
_PUBLIC_LIMIT, _PRIVATE_LIMIT, _SENIOR_LIMIT = 250_000 * 15, 350_000 * 15, 1_000_000 * 15


def _unknown_category(v: Views) -> DataFrame:
    rows = v("c").filter(_category().isNotNull()).select(
        "customer_no", COL("customer_name1").alias("customer_name"), "customer_category"
    )
    return lacks_related(rows, v("t"), "customer_category", "cust_cat")


def _rich_for_income(v: Views) -> DataFrame:
    rows = v("cmr").filter(COL("r.total_income") > 0).select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        COL("r.total_income").alias("total_income"),
    )
    joined = rows.join(v.totals, COL("customer_no") == COL("cust_no"))
    return joined.filter(COL("total_balance") > COL("total_income") * v.params.income_multiple).select(
        *rows.columns, "total_balance",
        F.round(COL("total_balance") / COL("total_income"), 1).cast("decimal(38,1)").alias("ratio"),
    )


def category_rules() -> list[Rule]:
    return [
        _age_rule("3.1", "Minor category, aged 18 or more", "MINORS", lambda a: a >= 18),
        _client_rule(
            "3.2", "Minor category without minor flag", "cp",
            lambda p: (_category() == "MINORS") & X.not_equal_or_null(COL("p.minor"), "Y"),
            {"minor": F.coalesce("p.minor", F.lit("NULL"))},
        ),
        _client_rule(
            "3.3", "Minor flag outside the minor category", "cp",
            lambda p: (COL("p.minor") == "Y") & (_category() != "MINORS"), {"customer_category": _category()},
        ),
        _age_rule("3.4", "Senior category, younger than 60", "SENIORS", lambda a: a < 60),
        _age_rule("3.5", "Student category, outside 19 to 28", "STUDENTS", lambda a: (a < 19) | (a > 28)),
        _income_rule("3.6", "CSE1 with an income of CSE2", "CSE1", lambda i: i >= _PUBLIC_LIMIT),
        _income_rule("3.7", "CSE2 with an income of CSE1", "CSE2", lambda i: i < _PUBLIC_LIMIT),
        _income_rule("3.8", "PSE1 with an income of PSE2 or more", "PSE1", lambda i: i >= _PRIVATE_LIMIT),
        _income_rule("3.9", "PSE2 with an income outside its band", "PSE2", lambda i: (i < _PRIVATE_LIMIT) | (i > _SENIOR_LIMIT)),
        _income_rule("3.10", "PSE3 with an income below its band", "PSE3", lambda i: i <= _SENIOR_LIMIT),
        _income_rule("3.11", "PFBI with an income below its band", "PFBI", lambda i: i <= _SENIOR_LIMIT),
        _age_rule("3.12", "Pensioner category, younger than 50", "VPFP", lambda a: a < 50),
        _client_rule(
            "3.13", "Individual category on another client type", "c",
            lambda p: _category().isin(*INDIVIDUAL_CATEGORIES) & (COL("c.customer_type") != "I"),
            {"customer_category": _category(), "customer_type": COL("c.customer_type")},
        ),
        _client_rule(
            "3.14", "Company category on another client type", "c",
            lambda p: _category().isin(*CORPORATE_CATEGORIES) & (COL("c.customer_type") != "C"),
            {"customer_category": _category(), "customer_type": COL("c.customer_type")},
        ),
        _client_rule("3.15", "Client without category", "c", lambda p: X.is_blank(_category(), "trim"), _type()),
        Rule(
            "3.16", "Category missing from the reference", 3, count=lambda v: _n(_unknown_category(v)),
            samples={"": lambda v: _ranked_by_balance(_unknown_category(v), v.totals, 30)},
        ),
        _client_rule(
            "3.17", "Under 18 outside the minor category", "cp",
            lambda p: (_age(p) < 18) & X.not_equal_or_null(_category(), "MINORS"),
            {"customer_category": _category(), "age": _age_shown()["age"]},
        ),
        _client_rule(
            "3.18", "Individual of 60 or more outside senior and pensioner", "cp",
            lambda p: (COL("c.customer_type") == "I") & (_age(p) >= 60) & X.not_in_or_null(_category(), ("SENIORS", "VPFP")),
            {"customer_category": _category(), "age": _age_shown()["age"]},
        ),
        _client_rule(
            "3.19", "Non-resident outside the non-resident categories", "cmr",
            lambda p: (COL("r.resident") == "N") & X.not_in_or_null(_category(), NON_RESIDENT_CATEGORIES),
            {"customer_category": _category(), "resident": COL("r.resident")},
        ),
        _client_rule(
            "3.20", "Salaried category without salary", "cmr",
            lambda p: (_category() == "SAL") & X.is_blank(COL("r.salary_income"), "trim"),
            {"customer_category": _category(), "salary_income": COL("r.salary_income")},
        ),
        Rule(
            "3.21", "Total balance above ten declared yearly incomes", 3, count=lambda v: _n(_rich_for_income(v)),
            samples={"": lambda v: top_sample(_rich_for_income(v), [down("total_balance")], 30)},
        ),
    ]


# ---- 4: account against ledger mirror --------------------------------------------------------
def _mirror_rule(rule_id: str, title: str, left: str, right: str, trimmed: bool = False) -> Rule:
    a, b = COL(f"a.{left}"), COL(f"b.{right}")
    where = lambda p: differs(f"a.{left}", f"b.{right}", "text" if trimmed else "raw")
    shown = (F.trim(a), F.trim(b)) if trimmed else (a, b)

    def sample(v: Views) -> DataFrame:
        rows = v("ab").filter(where(v.params)).select(
            COL("a.cust_ac_no").alias("cust_ac_no"), COL("a.cust_no").alias("cust_no"),
            shown[0].alias("left_value"), shown[1].alias("right_value"),
            X.exact(COL("a.acy_curr_balance")).alias("balance"),
        )
        return top_sample(rows, [down("balance")], 30)

    return Rule(rule_id, title, 4, samples={"": sample}, view="ab", where=where)


def _with_flag(v: Views, client: Column, flag: str) -> DataFrame:
    """Clients that pass ``client`` and hold accounts counted by ``flag``."""
    rows = v("c").filter(client).select("customer_no", COL("customer_name1").alias("customer_name"))
    flags = v.flags.filter(COL(flag) > 0).select("cust_no", flag)
    return rows.join(flags, COL("customer_no") == COL("cust_no")).drop("cust_no")


def ledger_rules() -> list[Rule]:
    return [
        _mirror_rule("4.1", "Dormant flag differs", "ac_stat_dormant", "ac_stat_dormant"),
        _mirror_rule("4.2", "Frozen flag differs", "ac_stat_frozen", "ac_stat_frozen"),
        _mirror_rule("4.3", "Block flag differs", "ac_stat_block", "gl_stat_blocked"),
        _mirror_rule("4.4", "No-debit flag differs", "ac_stat_no_dr", "ac_stat_no_dr"),
        _mirror_rule("4.5", "No-credit flag differs", "ac_stat_no_cr", "ac_stat_no_cr"),
        _mirror_rule("4.6", "Stop-payment flag differs", "ac_stat_stop_pay", "ac_stat_stop_pay"),
        _mirror_rule("4.7", "Currency differs", "ccy", "ac_gl_ccy", trimmed=True),
        Rule(
            "4.8", "Frozen client with accounts that are not", 4,
            count=lambda v: _n(_with_flag(v, COL("frozen") == "Y", "n_unfrozen")),
            samples={"": lambda v: _ranked_by_balance(_with_flag(v, COL("frozen") == "Y", "n_unfrozen"), v.totals, 30)},
        ),
        _mirror_rule("4.9", "Record status differs", "record_stat", "ac_gl_rec_status"),
    ]

# ---- 5: countries and addresses -----------------------------------------------------------------
_HOME = lambda p: F.lit(p.home_country)
def country_rules() -> list[Rule]:
    return [
        _field_pair("5.1", "Country differs: client and domicile", "cp", "c.country", "p.d_country"),
        _field_pair("5.2", "Country differs: client and local address", "cr", "c.country", "r.local_addr_country"),
        _field_pair("5.3", "Country differs: domicile and local address", "cpr", "p.d_country", "r.local_addr_country"),
        _field_pair("5.4", "Country differs: permanent and home address", "cpr", "p.p_country", "r.home_addr_country"),
        _client_rule(
            "5.5", "Non-resident living in the home country", "cp",
            lambda p: (COL("p.resident_status") == "N") & (COL("c.country") == _HOME(p)),
            {"customer_category": _category(), "nationality": COL("c.nationality")},
        ),
        _client_rule(
            "5.6", "Non-resident category with resident status", "cp",
            lambda p: _category().isin("NRA1", "NRA2") & (COL("p.resident_status") == "R"),
            {"customer_category": _category(), "country": COL("c.country"), "nationality": COL("c.nationality")},
        ),
        _client_rule(
            "5.7", "Foreigner category with home nationality", "c",
            lambda p: (_category() == "FOREIGN") & (COL("c.nationality") == _HOME(p)), {"country": COL("c.country")},
        ),
    ]


# ---- 6: user-defined fields against tables ---------------------------------------------------------
def _fields_of(v: Views, function_id: str) -> DataFrame:
    return v.bank["cstm_function_userdef_fields"].filter(COL("function_id") == function_id)


def _watched_unfrozen(v: Views) -> DataFrame:
    watched = _fields_of(v, "STDCIF").filter(F.upper(F.trim("field_val_18")) == "Y").select(
        X.key_segment(COL("rec_key"), 1).alias("_client")
    )
    clients = v("c").filter(X.not_equal_or_null(COL("frozen"), "Y")).select(
        "customer_no", COL("customer_name1").alias("customer_name"), F.coalesce("frozen", F.lit("N")).alias("frozen")
    )
    return clients.join(watched, COL("customer_no") == COL("_client")).drop("_client")


def _pep_fields(v: Views) -> DataFrame:
    pep = _fields_of(v, "STDKYCMN").select(
        X.without_last_char(COL("rec_key")).alias("_ref"), F.upper(F.trim("field_val_1")).alias("field_pep")
    )
    return v("r").join(pep, COL("kyc_ref_no") == COL("_ref")).select("kyc_ref_no", "pep", "field_pep")


def _field_only(v: Views) -> DataFrame:
    rows = _pep_fields(v).filter((COL("field_pep") == "Y") & X.not_equal_or_null(COL("pep"), "Y"))
    return rows.select("kyc_ref_no", F.coalesce("pep", F.lit("NULL")).alias("pep"))


def _kyc_only(v: Views) -> DataFrame:
    rows = _pep_fields(v).filter((COL("pep") == "Y") & X.not_equal_or_null(COL("field_pep"), "Y"))
    return rows.select("kyc_ref_no", F.coalesce("field_pep", F.lit("NULL")).alias("field_pep"))


def _with_first_client(v: Views, df: DataFrame) -> DataFrame:
    """Attach one client of the KYC file and its total balance ('-' and 0 where there is none)."""
    joined = df.join(v.first_client, COL("kyc_ref_no") == COL("ref"), "left").drop("ref")
    totals = v.totals.select(COL("cust_no").alias("_holder"), "total_balance")
    both = lookup(joined, totals, COL("customer_no"), COL("_holder"), COL("kyc_ref_no")).drop("_holder")
    return both.select(
        *df.columns,
        F.coalesce("customer_no", F.lit("-")).alias("customer_no"),
        F.coalesce("customer_name", F.lit("-")).alias("customer_name"),
        X.exact(F.coalesce("total_balance", F.lit(0))).alias("total_balance"),
    )


def _orphan_account_fields(v: Views) -> DataFrame:
    rows = _fields_of(v, "STDCUSAC").select(
        "rec_key", X.key_segment(COL("rec_key"), 1).alias("branch"), X.key_segment(COL("rec_key"), 2).alias("account_no")
    )
    return lacks_related(rows, v("a"), "account_no", "cust_ac_no", spread="rec_key")


def _field_coverage(v: Views) -> DataFrame:
    clients = v("c").agg(F.count("*")).scalar()
    return _fields_of(v, "STDCIF").agg(F.count("*").alias("n_fields")).withColumn("n_clients", clients)


def user_field_rules() -> list[Rule]:
    return [
        Rule(
            "6.1", "Watch-listed client that is not frozen", 6, count=lambda v: _n(_watched_unfrozen(v)),
            samples={"": lambda v: _ranked_by_balance(_watched_unfrozen(v), v.totals, 30)},
        ),
        Rule(
            "6.2", "Exposed person by user field only", 6, count=lambda v: _n(_field_only(v)),
            samples={"": lambda v: top_sample(_with_first_client(v, _field_only(v)), [down("total_balance")], 30)},
        ),
        Rule(
            "6.3", "Exposed person by KYC only", 6, count=lambda v: _n(_kyc_only(v)),
            samples={"": lambda v: top_sample(_with_first_client(v, _kyc_only(v)), [down("total_balance")], 30)},
        ),
        Rule(
            "6.4", "Users without e-mail", 6,
            count=lambda v: _fields_of(v, "SMDUSRDF").agg(F.count_if(X.is_blank(COL("field_val_1"), "trim")).alias("n")),
            samples={"": lambda v: _fields_of(v, "SMDUSRDF").agg(
                F.count_if(X.is_blank(COL("field_val_1"), "trim")).alias("n_without_email"), F.count("*").alias("n_users"))},
        ),
        Rule(
            "6.5", "Account fields of an unknown account", 6, count=lambda v: _n(_orphan_account_fields(v)),
            samples={"": lambda v: top_sample(_orphan_account_fields(v), [up("rec_key")], 30)},
        ),
        Rule(
            "6.6", "Client field rows against clients", 6,
            count=lambda v: _field_coverage(v).select(F.abs(COL("n_fields") - COL("n_clients")).alias("n")),
            samples={"": lambda v: _field_coverage(v).select(
                "n_fields", "n_clients", F.abs(COL("n_fields") - COL("n_clients")).alias("gap"))},
        ),
    ]


# ---- 7: KYC, risk, referential integrity -----------------------------------------------------------
def _unknown_file(v: Views) -> DataFrame:
    rows = v("c").filter(X.is_set(COL("kyc_ref_no"), "trim")).select(
        "customer_no", COL("customer_name1").alias("customer_name"), "kyc_ref_no", "customer_category"
    )
    return lacks_related(rows, v("m"), "kyc_ref_no", "m.kyc_ref_no")


def _file_without_client(v: Views) -> DataFrame:
    rows = v("m").select(
        "kyc_ref_no", "kyc_cust_type", F.coalesce("maker_id", F.lit("-")).alias("maker_id"),
        _day("maker_dt_stamp").alias("made_on"),
    )
    return lacks_related(rows, v("c"), "kyc_ref_no", "c.kyc_ref_no")


def _review_rule(rule_id: str, title: str, alias: str) -> Rule:
    where = lambda p: X.expired(COL(f"{alias}.kyc_nxt_review_date"), p.as_of)

    def sample(v: Views) -> DataFrame:
        rows = v(alias).filter(where(v.params)).select("kyc_ref_no", "kyc_nxt_review_date")
        clients = v.bank["sttm_customer"].select(
            COL("kyc_ref_no").alias("_ref"), "customer_no", COL("customer_name1").alias("customer_name")
        )
        joined = to_many(rows, clients, "kyc_ref_no", "_ref")
        totals = v.totals.select(COL("cust_no").alias("_holder"), "total_balance")
        both = lookup(joined, totals, COL("customer_no"), COL("_holder"), COL("kyc_ref_no"))
        shown = both.select(
            F.coalesce("customer_no", F.lit("-")).alias("customer_no"),
            F.coalesce("customer_name", F.lit("-")).alias("customer_name"),
            "kyc_ref_no",
            _day("kyc_nxt_review_date").alias("review_date"),
            X.days_since(COL("kyc_nxt_review_date"), v.params.as_of).alias("days_late"),
            X.exact(F.coalesce("total_balance", F.lit(0))).alias("total_balance"),
        )
        return top_sample(shown, [down("total_balance")], 30)

    return Rule(rule_id, title, 7, samples={"": sample}, view=alias, where=where)


_UNDOCUMENTED = lambda p: (COL("r.pep") == "Y") & X.is_blank(COL("r.pep_remarks"), "trim")


def _orphan_accounts(v: Views) -> DataFrame:
    rows = v("a").select(
        "cust_no", "cust_ac_no", X.exact(COL("acy_curr_balance")).alias("balance"), "ccy", "ac_desc"
    )
    return lacks_related(rows, v("c"), "cust_no", "customer_no", spread="cust_ac_no")


def _moving_without_kyc(v: Views) -> DataFrame:
    """Accounts of clients without KYC, with their transactions counted once per account."""
    clients = v("c").filter(X.is_blank(COL("kyc_ref_no"), "trim")).select(
        "customer_no", COL("customer_name1").alias("customer_name")
    )
    accounts = v("a").select("cust_ac_no", "cust_no", X.exact(COL("acy_curr_balance")).alias("balance"))
    held = accounts.join(clients, COL("cust_no") == COL("customer_no")).drop("customer_no")
    moved = v("h").filter(maybe_key(COL("ac_no"), held, "cust_ac_no")).groupBy("ac_no").agg(F.count("*").alias("n_txn"))
    return held.join(moved, COL("cust_ac_no") == COL("ac_no")).drop("ac_no")


def _self_checked(p: RunParams) -> Column:
    return (COL("m.maker_id") == COL("m.checker_id")) & (COL("m.maker_id") != "MIGRATION")


def _self_checked_sample(v: Views) -> DataFrame:
    rows = v("m").filter(_self_checked(v.params)).select("kyc_ref_no", "maker_id", "maker_dt_stamp")
    shown = _with_first_client(v, rows)
    top = top_sample(shown, [COL("maker_dt_stamp").desc_nulls_last()], 30)
    return top.withColumn("maker_dt_stamp", _day("maker_dt_stamp"))


_PEER_PROFILE = ("profile_value", "profile_nationality")


def _risk_peers(v: Views, view: str, where: Column, value: str, *shown: Column) -> DataFrame:
    """Comparable clients with an open account: filled profile and rating next to what is shown."""
    return v(view).filter(where & COL("o.n_accounts").isNotNull()).select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        COL("c.nationality").alias("nationality"), COL("c.country").alias("country"),
        COL(value).alias(value.split(".")[1]), COL("m.risk_level").alias("risk_level"), *shown,
        X.exact(F.coalesce("o.balance", F.lit(0))).alias("total_balance"),
        F.coalesce(COL(value), F.lit(-1)).alias("profile_value"),
        F.coalesce("c.nationality", F.lit("?")).alias("profile_nationality"),
        F.coalesce("m.risk_level", F.lit("?")).alias("profile_risk"),
    )


def _peer_rule(rule_id: str, title: str, peers: Callable[[Views], DataFrame], value: str) -> Rule:
    def flagged(v: Views) -> DataFrame:
        return peer_risk_conflict(peers(v), _PEER_PROFILE, "profile_risk", "customer_no")

    def sample(v: Views) -> DataFrame:
        rows = flagged(v).drop(*_PEER_PROFILE, "profile_risk")
        return top_sample(rows, [up("nationality"), up(value), up("risk_level"), up("customer_no")], 60)

    def accounts(v: Views) -> DataFrame:
        """Open accounts of the first 60 flagged clients, as one bounded text each."""
        clients = flagged(v).groupBy("customer_no").agg(F.count("*").alias("_copies"))
        first = clients.orderBy("customer_no").limit(60)
        held = v("a").filter(COL("record_stat") == "O").join(F.broadcast(first), COL("cust_no") == COL("customer_no"))
        # Copies of a client (repeated KYC rows) repeat its accounts in the text.
        repeated = held.withColumn("_i", F.explode(F.sequence(F.lit(1), COL("_copies"))))
        whole = F.round("acy_curr_balance", 0).cast("decimal(38,0)")
        text = F.concat(
            F.coalesce("cust_ac_no", F.lit("")), F.lit("("), F.coalesce("ccy", F.lit("")), F.lit(":"),
            F.coalesce(_thousands(whole), F.lit("")), F.lit(")"),
        )
        lists = ordered_list(repeated, ["customer_no"], COL("cust_ac_no"), text, "open_accounts")
        return top_sample(lists, [up("customer_no")], 60)

    return Rule(rule_id, title, 7, count=lambda v: _n(flagged(v)), samples={"": sample, "accounts": accounts})


def _thousands(whole: Column) -> Column:
    """Whole number with a comma between groups of three digits."""
    grouped = F.regexp_replace(F.abs(whole).cast("string"), r"(\d)(?=(\d{3})+$)", "$1,")
    return F.concat(F.when(whole < 0, "-").otherwise(""), grouped)


def _pep_peers(v: Views) -> DataFrame:
    pep, cat = COL("r.pep") == "Y", _category() == "PEP/FEPS"
    source = F.when(pep & cat, "PEP+CAT").when(pep, "KYC_R.PEP").otherwise("CAT.PEP")
    return _risk_peers(v, "cmrxo", pep | cat, "r.total_income", source.alias("source"))


def _turnover_peers(category: str) -> Callable[[Views], DataFrame]:
    nature = F.coalesce(F.substring("k.business_nature", 1, 8), F.lit("-")).alias("business")
    return lambda v: _risk_peers(v, "cmkxo", _category() == category, "k.annual_turnover", nature)


_PROFILE = ("profile_category", "profile_nationality", "profile_pep", "profile_resident", "profile_income", "profile_profession")


def _profiled(v: Views, with_desc: bool) -> DataFrame:
    """Rated individuals with an open account and their filled six-part profile."""
    rows = v("cmrxo").filter(
        (COL("c.customer_type") == "I") & COL("m.risk_level").isNotNull() & COL("o.n_accounts").isNotNull()
    )
    rows = v.with_client_fields(rows)
    desc = []
    if with_desc:
        rows = v.with_category(rows)
        desc = [F.coalesce("t.cust_cat_desc", "c.customer_category").alias("category_desc")]
    fill = lambda col, value: F.coalesce(COL(col), F.lit(value))
    return rows.select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        *desc, COL("m.risk_level").alias("risk_level"), COL("r.total_income").alias("total_income"),
        X.exact(F.coalesce("o.balance", F.lit(0))).alias("total_balance"),
        fill("c.customer_category", "?").alias("profile_category"),
        fill("c.nationality", "?").alias("profile_nationality"),
        fill("r.pep", "N").alias("profile_pep"),
        fill("r.resident", "?").alias("profile_resident"),
        fill("r.total_income", 0).alias("profile_income"),
        fill("uf.profession", "-").alias("profile_profession"),
    )


def _profile_order() -> list[Column]:
    return [up(c) for c in _PROFILE] + [up("risk_level")]


def _profile_sample(v: Views) -> DataFrame:
    rows = profile_conflict(_profiled(v, True), _PROFILE, "risk_level", "customer_no")
    return top_sample(rows, [*_profile_order(), down("total_balance")], 60)


def _minorities(v: Views, with_desc: bool) -> DataFrame:
    return minority_value(_profiled(v, with_desc), _PROFILE, "risk_level", "customer_no", v.params.majority_percent)


def _minority_sample(v: Views) -> DataFrame:
    top = top_sample(_minorities(v, True), _profile_order(), 80)
    return top.withColumn("majority_pct", X.percent_of(COL("majority_count"), COL("profile_count")))


def _same_person(v: Views) -> DataFrame:
    rows = v.with_client_fields(v.with_open(v("cm"), "c.customer_no")).filter(
        COL("c.customer_name1").isNotNull() & X.is_set(COL("uf.tax_id"), "trim")
        & COL("m.risk_level").isNotNull() & COL("o.n_accounts").isNotNull()
    )
    people = rows.select(
        COL("c.customer_no").alias("customer_no"), COL("c.customer_name1").alias("customer_name"),
        F.coalesce("c.local_branch", F.lit("-")).alias("branch"), COL("uf.tax_id").alias("tax_id"),
        COL("m.risk_level").alias("risk_level"), COL("o.n_accounts").alias("n_accounts"),
        X.exact(F.coalesce("o.balance", F.lit(0))).alias("total_balance"),
        F.upper(F.trim("c.customer_name1")).alias("same_name"), F.upper(F.trim("uf.tax_id")).alias("same_tax_id"),
    )
    return shared_identity_conflict(people, ("same_name", "same_tax_id"), "risk_level", "customer_no")


def _list_rule(rule_id: str, title: str, alias: str, key: str) -> Rule:
    return Rule(
        rule_id, title, 7, count=lambda v: _n(shared_values(v.table(alias), key, "trim")),
        samples={"": lambda v: _numbered(duplicate_groups(v.table(alias), key, "customer_no", 30), key)},
    )


def _numbered(groups: DataFrame, key: str) -> DataFrame:
    return top_sample(groups, [COL("n").desc(), up(key)], 30)


def kyc_rules() -> list[Rule]:
    return [
        Rule(
            "7.1", "KYC reference without file", 7, count=lambda v: _n(_unknown_file(v)),
            samples={"": lambda v: _ranked_by_balance(_unknown_file(v), v.totals, 30)},
        ),
        Rule(
            "7.2", "KYC file without client", 7, count=lambda v: _n(_file_without_client(v)),
            samples={"": lambda v: top_sample(_file_without_client(v), [up("kyc_ref_no")], 30)},
        ),
        _client_rule(
            "7.3", "Monitoring required but no KYC reference", "c",
            lambda p: (COL("c.aml_required") == "Y") & X.is_blank(COL("c.kyc_ref_no"), "trim"),
            {"customer_category": _category()},
        ),
        _client_rule(
            "7.4", "KYC verified but no KYC reference", "c",
            lambda p: (COL("c.kyc_details") == "V") & X.is_blank(COL("c.kyc_ref_no"), "trim"),
            {"customer_category": _category()},
        ),
        _review_rule("7.5", "Retail KYC review overdue", "r"),
        _review_rule("7.6", "Corporate KYC review overdue", "k"),
        Rule(
            "7.7", "Exposed person without remarks", 7, view="r", where=_UNDOCUMENTED,
            samples={"": lambda v: top_sample(
                _with_first_client(v, v("r").filter(_UNDOCUMENTED(v.params)).select("kyc_ref_no")), [down("total_balance")], 30)},
        ),
        Rule(
            "7.8", "Account holder missing from the clients", 7,
            count=lambda v: _orphan_accounts(v).agg(F.count_distinct("cust_no").alias("n")),
            samples={"": lambda v: top_sample(_orphan_accounts(v), [down("balance")], 30)},
        ),
        _list_rule("7.9", "National identity shared by several clients", "p", "p_national_id"),
        _list_rule("7.10", "Unique identifier shared by several clients", "c", "unique_id_value"),
        Rule(
            "7.11", "Deceased client with a usable account", 7,
            count=lambda v: _n(_with_flag(v, COL("deceased") == "Y", "n_unrestricted")),
            samples={"": lambda v: _ranked_by_balance(
                _with_flag(v, COL("deceased") == "Y", "n_unrestricted").drop("n_unrestricted"), v.totals, 30)},
        ),
        Rule(
            "7.12", "Moving account of a client without KYC", 7,
            count=lambda v: _moving_without_kyc(v).agg(F.count_distinct("cust_ac_no").alias("n")),
            samples={"": lambda v: top_sample(_moving_without_kyc(v), [down("balance")], 30)},
        ),
        Rule(
            "7.13", "KYC file checked by its maker", 7, view="m", where=_self_checked, samples={"": _self_checked_sample},
        ),
        _peer_rule("7.14", "Exposed persons alike, rated differently", _pep_peers, "total_income"),
        _peer_rule("7.15", "Non-profit clients alike, rated differently", _turnover_peers("NGOs"), "annual_turnover"),
        _peer_rule("7.16", "Religious bodies alike, rated differently", _turnover_peers("REL"), "annual_turnover"),
        Rule(
            "7.17", "Individual profiles with several ratings (profiles)", 7,
            count=lambda v: _n(conflicting_profiles(_profiled(v, False), _PROFILE, "risk_level")),
            samples={"": _profile_sample},
        ),
        Rule(
            "7.18", "Same name and tax number, rated differently", 7, count=lambda v: _n(_same_person(v)),
            samples={"": lambda v: top_sample(
                _same_person(v).drop("same_tax_id"), [up("same_name"), up("tax_id"), up("risk_level")], 60).drop("same_name")},
        ),
        Rule(
            "7.19", "Individual rated against the majority of the profile", 7,
            count=lambda v: _n(_minorities(v, False)), samples={"": _minority_sample},
        ),
    ]

# ---- 8: correspondent banks ----------------------------------------------------------------------
def _is_bank() -> Column:
    return COL("c.customer_type") == "B"


def _has_open() -> Column:
    return COL("o.n_accounts").isNotNull()


def _dash(name: str) -> Column:
    return F.coalesce(COL(name), F.lit("-"))


def _bank_shown() -> dict:
    return {
        "category": _dash("c.customer_category"), "risk_level": _dash("m.risk_level"),
        "nationality": _dash("c.nationality"),
    }


def _bank_rule(rule_id: str, title: str, where: Predicate, show: Mapping, view: str = "co", sample_view: str = "cmxo") -> Rule:
    """Rule over banks with an open account. The count does not need the optional KYC side."""
    test = lambda p: where(p) & _has_open()

    def sample(v: Views) -> DataFrame:
        shown = [(e(v.params) if callable(e) else e).alias(n) for n, e in show.items()]
        rows = v(sample_view).filter(test(v.params)).select(
            COL("c.customer_no").alias("customer_no"), _dash("c.customer_name1").alias("customer_name"), *shown,
            X.exact(F.coalesce("o.balance", F.lit(0))).alias("total_balance"),
        )
        return top_sample(rows, [down("total_balance")], 30)

    return Rule(rule_id, title, 8, samples={"": sample}, view=view, where=test)


def _bank_accounts(v: Views) -> DataFrame:
    return FL.party_accounts(v.bank["sttm_customer"], v.bank["sttm_cust_account"], COL("customer_type") == "B")


def _bank_flows(v: Views, held: DataFrame, months: int = 12, where: Column | None = None, by=()) -> DataFrame:
    return FL.account_flows(v.bank["actb_history"], held, v.params.months_ago(months), where=where, by=by, ledger=v.ledger)


def _with_risk(v: Views, per_bank: DataFrame) -> DataFrame:
    """Attach the bank's rating; a bank with several KYC rows counts once per distinct rating,
    with the flows of the rows that carry it."""
    m = v.bank["sttm_kyc_master"].groupBy(COL("kyc_ref_no").alias("_ref"), "risk_level").agg(F.count("*").alias("_w"))
    joined = lookup(per_bank, m, COL("kyc_ref_no"), COL("_ref"), COL("customer_no"))
    w = F.coalesce("_w", F.lit(1))
    scaled = [(COL(c) * w).cast(t).alias(c) for c, t in (
        ("n_txn", "bigint"), ("total_debit", X.EXACT), ("total_credit", X.EXACT), ("volume", X.EXACT))]
    keep = [c for c in per_bank.columns if c not in ("n_txn", "total_debit", "total_credit", "volume")]
    return joined.select(*keep, "risk_level", *scaled)


def _flow_sample(v: Views, per_bank: DataFrame, order: str, k: int, shown: Sequence[str]) -> DataFrame:
    rows = _with_risk(v, per_bank)
    top = rows.select(
        "customer_no", _dash("customer_name").alias("customer_name"), _dash("nationality").alias("nationality"),
        _dash("risk_level").alias("risk_level"), *[_dash(c).alias(c) for c in shown],
        "n_txn", "total_debit", "total_credit", "volume",
    )
    return top_sample(top, [down(order)], k)


_BANK_KEYS = ("customer_no", "customer_name", "nationality", "swift_code", "kyc_ref_no")


def _yearly_partners(v: Views) -> DataFrame:
    """Banks with funds transfers in each of the years asked for, up to 50 per year by volume."""
    held = _bank_accounts(v)
    years = []
    for year in v.params.flow_years:
        flows = FL.account_flows(
            v.bank["actb_history"], held, datetime(year, 1, 1), datetime(year + 1, 1, 1), COL("module") == "FT", ledger=v.ledger
        )
        per_bank = FL.party_flows(flows, held, *_BANK_KEYS)
        top = _flow_sample(v, per_bank, "volume", 50, ["swift_code"])
        years.append(top.select(F.lit(year).alias("year"), *top.columns))
    return union_all(years)


def _per_bank(v: Views, where: Column | None = None) -> DataFrame:
    held = _bank_accounts(v)
    return FL.party_flows(_bank_flows(v, held, where=where), held, *_BANK_KEYS)


def _outside_cemac(v: Views) -> DataFrame:
    nation = F.coalesce("nationality", F.lit("?"))
    held = _bank_accounts(v).filter(~nation.isin(*CEMAC_COUNTRIES))
    return FL.party_flows(_bank_flows(v, held), held, *_BANK_KEYS)


def _shares(v: Views) -> DataFrame:
    held = _bank_accounts(v)
    per_bank = FL.party_flows(_bank_flows(v, held), held, "customer_no", "customer_name", "nationality")
    return FL.flow_share(per_bank, v.params.credit_share)


def _share_sample(v: Views) -> DataFrame:
    share = F.round(COL("total_credit") * 100 / COL("all_credit"), 1).cast("decimal(18,1)")
    rows = _shares(v).select(
        "customer_no", "customer_name", _dash("nationality").alias("nationality"), "total_credit", "all_credit",
        share.alias("share_pct"),
    )
    return top_sample(rows, [down("total_credit")], 10)


def _interbank() -> Column:
    return COL("module").isin(*INTERBANK_MODULES)


def _per_module(v: Views) -> DataFrame:
    held = _bank_accounts(v)
    flows = _bank_flows(v, held, where=_interbank(), by=("module",))
    per_module = FL.party_flows(flows, held, "customer_no", "customer_name", "module")
    rows = per_module.withColumn("customer_name", _dash("customer_name"))
    return top_sample(rows, [down("volume")], 60)


def _quiet_low(v: Views) -> DataFrame:
    p = v.params
    rows = FL.low_balance_high_flow(
        _bank_accounts(v), v.bank["actb_history"], p.months_ago(6), p.low_balance, p.low_balance_txn, v.ledger
    )
    return rows.select(
        "customer_no", _dash("customer_name").alias("customer_name"), "cust_ac_no",
        X.exact(COL("acy_curr_balance")).alias("balance"), "max_amount", "n_large",
    )


def _idle(v: Views) -> DataFrame:
    rows = FL.idle_accounts(_bank_accounts(v), v.bank["actb_history"], v.params.months_ago(12), v.ledger)
    return rows.select(
        "customer_no", _dash("customer_name").alias("customer_name"), "cust_ac_no",
        _dash("customer_category").alias("category"), _day("ac_open_date").alias("opened_on"),
        X.exact(COL("acy_curr_balance")).alias("balance"),
    )


def _idle_sample(v: Views) -> DataFrame:
    return top_sample(_idle(v).withColumn("_size", F.abs("balance")), [down("_size")], 30).drop("_size")


def _rated_banks(v: Views) -> DataFrame:
    rows = v("mco").filter(
        _is_bank() & COL("c.cust_classification").isNotNull() & COL("c.nationality").isNotNull()
        & COL("m.risk_level").isNotNull() & _has_open()
    ).select(
        COL("c.customer_no").alias("customer_no"), _dash("c.customer_name1").alias("customer_name"),
        COL("c.cust_classification").alias("classification"), COL("m.risk_level").alias("risk_level"),
        COL("c.nationality").alias("nationality"), X.exact(F.coalesce("o.balance", F.lit(0))).alias("total_balance"),
    )
    return profile_conflict(rows, ("nationality", "classification"), "risk_level", "customer_no")


def bank_rules() -> list[Rule]:
    return [
        Rule("8.0", "Banks with funds transfers, per year", 8, judged=False, samples={"": _yearly_partners}),
        _bank_rule(
            "8.1", "Bank without KYC reference", lambda p: _is_bank() & X.is_blank(COL("c.kyc_ref_no"), "trim"),
            {"category": _dash("c.customer_category"), "swift_code": _dash("c.swift_code")}, sample_view="co",
        ),
        _bank_rule("8.2", "Bank without SWIFT code", lambda p: _is_bank() & X.is_blank(COL("c.swift_code"), "trim"), _bank_shown()),
        _bank_rule(
            "8.3", "Bank with an overdue review", lambda p: _is_bank() & X.expired(COL("k.kyc_nxt_review_date"), p.as_of),
            {
                "category": _dash("c.customer_category"), "risk_level": _dash("m.risk_level"),
                "review_date": _day("k.kyc_nxt_review_date"),
                "days_late": lambda p: X.days_since(COL("k.kyc_nxt_review_date"), p.as_of),
            },
            view="cmkxo", sample_view="cmkxo",
        ),
        _bank_rule("8.4", "Bank without classification", lambda p: _is_bank() & X.is_blank(COL("c.cust_classification"), "trim"), _bank_shown()),
        _bank_rule(
            "8.5", "Bank without turnover",
            lambda p: _is_bank() & (COL("k.annual_turnover").isNull() | (COL("k.annual_turnover") == 0)),
            {
                "category": _dash("c.customer_category"), "risk_level": _dash("m.risk_level"),
                "turnover": X.exact(F.coalesce("k.annual_turnover", F.lit(0))),
            },
            view="cmkxo", sample_view="cmkxo",
        ),
        _bank_rule("8.6", "Bank outside the bank categories", lambda p: _is_bank() & X.not_in_or_null(_category(), BANK_CATEGORIES), _bank_shown()),
        _bank_rule(
            "8.7", "Bank category on another client type", lambda p: (_category() == "BANK") & (COL("c.customer_type") != "B"),
            {"customer_type": _dash("c.customer_type"), "risk_level": _dash("m.risk_level"), "nationality": _dash("c.nationality")},
        ),
        Rule(
            "8.8", "Banks alike, rated differently", 8, count=lambda v: _n(_rated_banks(v)),
            samples={"": lambda v: top_sample(
                _rated_banks(v), [up("nationality"), up("classification"), up("risk_level"), down("total_balance")], 40)},
        ),
        _bank_rule("8.9", "Bank exempt from monitoring", lambda p: _is_bank() & (COL("c.aml_required") == "N"), _bank_shown()),
        Rule(
            "8.10", "Busiest banks over twelve months", 8, judged=False,
            samples={"": lambda v: _flow_sample(v, _per_bank(v), "n_txn", 30, [])},
        ),
        Rule(
            "8.11", "Bank outside the monetary union with volume", 8,
            count=lambda v: _n(_outside_cemac(v).groupBy("customer_no").agg(F.sum("volume").alias("v")).filter(COL("v") > 0)),
            samples={"": lambda v: _flow_sample(v, _outside_cemac(v), "volume", 30, [])},
        ),
        Rule(
            "8.12", "Near-empty bank account with large transactions", 8, count=lambda v: _n(_quiet_low(v)),
            samples={"": lambda v: top_sample(_quiet_low(v), [down("max_amount")], 30)},
        ),
        Rule("8.13", "Bank that concentrates interbank credits", 8, count=lambda v: _n(_shares(v)), samples={"": _share_sample}),
        Rule(
            "8.14", "Banks with interbank transactions", 8,
            count=lambda v: _n(_per_bank(v, _interbank()).select("customer_no").distinct()),
            samples={
                "": lambda v: _flow_sample(v, _per_bank(v, _interbank()), "volume", 30, []),
                "modules": _per_module,
            },
        ),
        Rule("8.15", "Open bank account without movement", 8, count=lambda v: _n(_idle(v)), samples={"": _idle_sample}),
    ]

# Rules run per section; section 8 starts at 0.
SECTIONS = {1: 10, 2: 8, 3: 21, 4: 9, 5: 7, 6: 6, 7: 19, 8: 15}
RULE_IDS = tuple(f"{s}.{i}" for s, last in SECTIONS.items() for i in range(0 if s == 8 else 1, last + 1))


def section_rules(section: int) -> list[Rule]:
    """Rules of one section. Built on use: column expressions need a running session."""
    builders = (
        identity_rules, type_rules, category_rules, ledger_rules, country_rules, user_field_rules, kyc_rules, bank_rules,
    )
    return builders[section - 1]()


def all_rules() -> list[Rule]:
    return [rule for section in SECTIONS for rule in section_rules(section)]


def find_rule(rule_id: str) -> Rule:
    return next(r for r in section_rules(int(rule_id.split(".")[0])) if r.id == rule_id)


def rule_counts(views: Views, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(rule_id, n, verdict) of the judged rules. Predicates over the same view share one scan and
    one aggregate; rules without a verdict carry NULL."""
    rules = list(rules or all_rules())
    parts: list[DataFrame] = []
    by_view: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.view and rule.judged:
            by_view.setdefault(rule.view, []).append(rule)
    for view, members in by_view.items():
        row = views(view).agg(*[F.count_if(r.where(views.params)).alias(f"_{i}") for i, r in enumerate(members)])
        cells = [F.struct(F.lit(r.id).alias("rule_id"), COL(f"_{i}").alias("n")) for i, r in enumerate(members)]
        parts.append(row.select(F.inline(F.array(*cells))))
    for rule in rules:
        if rule.count is not None:
            parts.append(rule.count(views).select(F.lit(rule.id).alias("rule_id"), COL("n").cast("bigint")))
    silent = [r.id for r in rules if not r.judged]
    if silent:
        one = views.bank.spark.range(1).select(F.explode(F.array(*map(F.lit, silent))).alias("rule_id"))
        parts.append(one.withColumn("n", F.lit(None).cast("bigint")))
    counts = union_all(parts)
    return counts.withColumn("verdict", F.when(COL("n").isNotNull(), verdict(COL("n"))))


def totals(verdicts: DataFrame) -> DataFrame:
    """One row: rules run and rules with anomalies."""
    return verdicts.agg(
        F.count("*").alias("rules_run"), F.count_if(COL("verdict") == "ANOMALY").alias("rules_with_anomalies")
    )


def rule_sample(views: Views, rule_id: str, name: str = "") -> DataFrame:
    return find_rule(rule_id).samples[name](views)
