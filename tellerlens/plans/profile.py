"""The profiling catalogue: which columns of which table are counted, ranked, measured."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlens.functions import expressions as X
from tellerlens.operators import profiling as P
from tellerlens.operators.accounts import idle_since
from tellerlens.operators.duplicates import shared_values
from tellerlens.operators.relations import has_related, lacks_related, maybe_key, union_all
from tellerlens.params import RunParams
from tellerlens.operators.udf_views import VIEWS, udf_preview
from tellerlens.plans.views import Views
from tellerlens.sources.schemas import VOLUME_TABLES

COL = F.col

# --- fixed values: the columns profiled per table --------------------------------------------
FREQUENCIES: dict[str, str] = {
    "sttm_customer": """customer_type customer_category aml_required kyc_details risk_profile
        cust_classification cif_status auth_stat record_stat credit_rating""",
    "sttm_cust_personal": "sex resident_status pa_issued us_res_status age_proof_submitted cust_comm_mode",
    "sttm_cust_account": "account_type mode_of_operation joint_ac_indicator auth_stat record_stat",
    "sttb_account": "ac_or_gl auth_stat ac_gl_rec_status gl_aclass_type",
    "sttm_kyc_master": "kyc_cust_type risk_level auth_stat record_stat",
    "sttm_kyc_retail": "pep resident us_res_status acc_type declared pa_given kyc_amts_ccy",
    "sttm_kyc_corporate": """company_type salary_mode acc_solicited compliance_clearance business_approval
        local_abroad_brn kyc_amts_ccy""",
    "actb_history": "drcr_ind type category cust_gl aml_exception",
    "sttm_account_class": "ac_class_type dormancy auth_stat",
    "sttm_customer_cat": "auth_stat",
    "cstm_function_userdef_fields": "function_id",
}
TOP_TEN: dict[str, str] = {
    "sttm_customer": "country nationality exposure_country unique_id_name",
    "sttm_cust_personal": "birth_country d_country p_country",
    "sttm_cust_account": "ccy account_class branch_code",
    "sttb_account": "gl_category ac_gl_ccy branch_code",
    "sttm_kyc_master": "maker_id",
    "sttm_kyc_retail": "acc_purpose nationality birth_country local_addr_country home_addr_country",
    "sttm_kyc_corporate": "funds_source parent_cmpny_country business_nature acc_purpose products_traded group_name",
    "actb_history": "ac_ccy trn_code module product ac_branch user_id event",
    "sttm_kyc_corp_keypersons": "relationship nationality address_country",
}
TOP_FIFTEEN = {("sttm_cust_account", "account_class"), ("actb_history", "trn_code")}
ONLY_FILLED = {("sttm_kyc_corporate", "group_name")}
DATE_RANGES = {
    "sttm_customer": ["cif_creation_date"], "sttm_cust_account": ["ac_open_date", "dormancy_date"], "actb_history": ["trn_dt"],
}
INCOME_SOURCES = (
    "salary_income", "rental_income", "investment_income", "business_income", "prof_business_income", "overseas_income",
    "othr_income_sources",
)
ACCOUNT_FLAGS = (
    "ac_stat_dormant", "ac_stat_frozen", "ac_stat_no_dr", "ac_stat_no_cr", "ac_stat_stop_pay", "ac_stat_block",
    "nsf_blacklist_status", "salary_account",
)
CLIENT_FLAGS = (
    "frozen", "deceased", "whereabouts_unknown", "staff", "private_customer", "joint_venture", "crm_customer", "treasury_customer",
)
CLASS_FACILITIES = ("overdraft_facility", "cheque_book_facility", "atm_facility", "passbook_facility")
# --------------------------------------------------------------------------------------------


def frequencies(v: Views, table: str) -> DataFrame:
    return P.frequency(v.bank[table], FREQUENCIES[table].split())


def top_values(v: Views, table: str) -> DataFrame:
    names = TOP_TEN[table].split()
    plain = {n: 15 if (table, n) in TOP_FIFTEEN else 10 for n in names if (table, n) not in ONLY_FILLED}
    out = P.top_n(v.bank[table], plain)
    for name in (n for n in names if (table, n) in ONLY_FILLED):
        filled = v.bank[table].filter(X.is_set(COL(name)))
        out = out.unionByName(P.top_n(filled, {name: 10}))
    return out


def _flags(*names: str) -> dict[str, Column]:
    return {f"{n}_yes": COL(n) == "Y" for n in names}


def _blank_and_set(*names: str) -> dict[str, Column]:
    return {k: t for n in names for k, t in ((f"{n}_blank", X.is_blank(COL(n))), (f"{n}_set", X.is_set(COL(n))))}


def _blanks(*names: str) -> dict[str, Column]:
    return {f"{n}_blank": X.is_blank(COL(n)) for n in names}


def _customer_counts(p: RunParams) -> dict[str, Column]:
    return {**_blank_and_set("kyc_ref_no", "unique_id_value", "introducer"), **_flags(*CLIENT_FLAGS)}


def _personal_counts(p: RunParams) -> dict[str, Column]:
    return {
        **_blanks("p_national_id", "passport_no", "e_mail", "mobile_number", "first_name", "last_name"),
        **_blank_and_set("place_of_birth"),
        "both_addresses_blank": X.is_blank(COL("p_address1")) & X.is_blank(COL("d_address1")),
        "date_of_birth_missing": COL("date_of_birth").isNull(),
        "passport_expired": X.expired(COL("ppt_exp_date"), p.as_of),
        "pa_holder_name_set": X.is_set(COL("pa_holder_name")),
        **_flags("minor"),
    }


def _account_counts(p: RunParams) -> dict[str, Column]:
    return {
        **_flags(*ACCOUNT_FLAGS),
        "overdraft_since_set": COL("overdraft_since").isNotNull(),
        "dormancy_date_set": COL("dormancy_date").isNotNull(),
        **{f"inactive_over_{m}_months": idle_since(p.months_ago(m)) for m in (6, 12, 24)},
    }


def _master_counts(p: RunParams) -> dict[str, Column]:
    return {"maker_is_checker": COL("maker_id") == COL("checker_id"), **_blanks("kyc_desc")}


def _retail_counts(p: RunParams) -> dict[str, Column]:
    pep = COL("pep") == "Y"
    return {
        "visa_expired": X.expired(COL("visa_expiry_date"), p.as_of),
        "passport_expired": X.expired(COL("passport_expiry_date"), p.as_of),
        "review_overdue": X.expired(COL("kyc_nxt_review_date"), p.as_of),
        **{f"{n}_set": X.is_set(COL(n)) for n in INCOME_SOURCES},
        "pep_without_remarks": pep & X.is_blank(COL("pep_remarks")),
        "pep_with_remarks": pep & X.is_set(COL("pep_remarks")),
    }


def _corporate_counts(p: RunParams) -> dict[str, Column]:
    return {
        "review_overdue": X.expired(COL("kyc_nxt_review_date"), p.as_of),
        **_blank_and_set("trade_licence_no", "introducer_dtl"),
        "audit_date_missing": COL("audit_date").isNull(),
        "audit_over_12_months": COL("audit_date") < X.ts(p.months_ago(12)),
    }


def _history_counts(p: RunParams) -> dict[str, Column]:
    rate = COL("exch_rate")
    return {
        "foreign_rate": (rate != 1) & (rate != 0),
        "related_account_set": X.is_set(COL("related_account")),
        "related_customer_set": X.is_set(COL("related_customer")),
    }


def _keyperson_counts(p: RunParams) -> dict[str, Column]:
    share = COL("share_holding")
    return {
        "share_missing_or_zero": share.isNull() | (share == 0), "share_positive": share > 0, **_blank_and_set("tin"),
    }


COUNTS: dict[str, Callable[[RunParams], dict[str, Column]]] = {
    "sttm_customer": _customer_counts,
    "sttm_cust_personal": _personal_counts,
    "sttm_cust_account": _account_counts,
    "sttb_account": lambda p: _flags("ac_stat_dormant", "ac_stat_frozen", "gl_stat_blocked"),
    "sttm_kyc_master": _master_counts,
    "sttm_kyc_retail": _retail_counts,
    "sttm_kyc_corporate": _corporate_counts,
    "actb_history": _history_counts,
    "sttm_account_class": lambda p: _flags(*CLASS_FACILITIES),
    "sttm_kyc_corp_keypersons": _keyperson_counts,
}


def counts(v: Views, table: str) -> DataFrame:
    return P.count_where(v.bank[table], COUNTS[table](v.params))


def keyperson_files(v: Views) -> DataFrame:
    """Key persons and the distinct KYC files they belong to."""
    return v.bank["sttm_kyc_corp_keypersons"].agg(
        F.count("*").alias("n_persons"), F.count_distinct("kyc_ref_no").alias("n_files")
    )


def _none_or_zero(name: str) -> Column:
    return COL(name).isNull() | (COL(name) == 0)


def _with_empties(*names: str) -> dict[str, Column]:
    return {n: _none_or_zero(n) for n in names}


STATS: dict[str, Callable[[], dict[str, Column | None]]] = {
    "sttm_cust_account": lambda: {
        "acy_curr_balance": COL("acy_curr_balance") < 0, "acy_today_tover_dr": None, "acy_today_tover_cr": None,
        "acy_mtd_tover_dr": None, "acy_mtd_tover_cr": None,
    },
    "sttm_kyc_retail": lambda: _with_empties("total_income", "total_net_worth"),
    "sttm_kyc_corporate": lambda: _with_empties("annual_turnover", "employee_number"),
    "actb_history": lambda: {
        "lcy_amount": None,
        "fcy_amount": (COL("fcy_amount") != COL("lcy_amount")) & (COL("fcy_amount") > 0),
    },
    "sttm_kyc_corp_keypersons": lambda: {"share_holding": None},
}


# Balances and booked amounts are shown in cents; declared figures as they were declared.
ROUNDED_ENDS = {"sttm_cust_account", "actb_history"}


def statistics(v: Views, table: str) -> DataFrame:
    df = v.bank[table]
    if table == "sttm_kyc_corp_keypersons":
        df = df.filter(COL("share_holding") > 0)
    return P.stats(df, STATS[table](), round_ends=table in ROUNDED_ENDS)


def date_ranges(v: Views) -> DataFrame:
    parts = [
        P.date_range(v.bank[t], cols).select(F.lit(t).alias("table_name"), "*") for t, cols in DATE_RANGES.items()
    ]
    return union_all(parts)


def volumes(v: Views) -> DataFrame:
    return P.volumetry({t: v.bank[t] for t in VOLUME_TABLES})


def clients_per_year(v: Views) -> DataFrame:
    return P.per_year(v.bank["sttm_customer"], "cif_creation_date")


def transactions_per_year(v: Views) -> DataFrame:
    return P.per_year(v.bank["actb_history"], "trn_dt", "lcy_amount")


def risk_by_type(v: Views) -> DataFrame:
    return P.crosstab(v.bank["sttm_kyc_master"], "kyc_cust_type", "risk_level")


def accounts_per_client(v: Views) -> DataFrame:
    return P.size_histogram(v.bank["sttm_cust_account"], "cust_no")


def keypersons_per_file(v: Views) -> DataFrame:
    return P.size_histogram(v.bank["sttm_kyc_corp_keypersons"], "kyc_ref_no")


def first_classes(v: Views) -> DataFrame:
    return v.bank["sttm_account_class"].select("account_class", "description").orderBy(
        COL("account_class").asc_nulls_last(), COL("description").asc_nulls_last()
    ).limit(10)


def categories(v: Views) -> DataFrame:
    return v.bank["sttm_customer_cat"].select("cust_cat", "cust_cat_desc").orderBy(COL("cust_cat").asc_nulls_last())


def field_previews(v: Views) -> DataFrame:
    """First five rows of every function of the user-defined fields, decoded."""
    return union_all([udf_preview(v("u"), function_id) for function_id in VIEWS])


def cross_checks(v: Views) -> DataFrame:
    """(metric, n): the fourteen cross-table anomaly counts."""
    c, p, a, b = v("c"), v("p"), v("a"), v("b")
    m, r, k, kp, h = v("m"), v("r"), v("k"), v("kp"), v("h")
    number = lambda df: df.agg(F.count("*").alias("n"))
    unreferenced = c.filter(X.is_blank(COL("kyc_ref_no"))).select("customer_no")
    without_kyc = a.select("cust_ac_no", "cust_no").join(unreferenced, COL("cust_no") == COL("customer_no"))

    def holders(flag: Column, counter: str) -> DataFrame:
        marked = v.flags.filter(COL(counter) > 0).select("cust_no")
        return number(has_related(c.filter(flag).select("customer_no"), marked, "customer_no", "cust_no"))

    rows = {
        "clients_without_account": number(lacks_related(c.select("customer_no"), a, "customer_no", "a.cust_no")),
        "individuals_without_personal_file": number(
            lacks_related(c.filter(COL("customer_type") == "I").select("customer_no"), p, "customer_no", "p.customer_no")),
        "monitoring_required_without_kyc": c.agg(
            F.count_if((COL("aml_required") == "Y") & X.is_blank(COL("kyc_ref_no"))).alias("n")),
        "kyc_reference_without_file": number(
            lacks_related(c.filter(X.is_set(COL("kyc_ref_no"))).select("kyc_ref_no"), m, "kyc_ref_no", "m.kyc_ref_no")),
        "accounts_without_ledger_row": number(
            lacks_related(a.select("cust_no", "cust_ac_no"), b, ["cust_no", "cust_ac_no"], ["b.cust_no", "b.pkey"], spread="cust_ac_no")),
        "individual_files_without_retail": number(lacks_related(
            m.filter(COL("kyc_cust_type") == v.params.profiling_individual_type).select("kyc_ref_no"), r, "kyc_ref_no", "r.kyc_ref_no")),
        "company_files_without_corporate": number(
            lacks_related(m.filter(COL("kyc_cust_type") == "C").select("kyc_ref_no"), k, "kyc_ref_no", "k.kyc_ref_no")),
        "corporates_without_keypersons": number(lacks_related(k.select("kyc_ref_no"), kp, "kyc_ref_no", "kp.kyc_ref_no")),
        "frozen_clients_with_unfrozen_account": holders(COL("frozen") == "Y", "n_unfrozen"),
        "deceased_clients_with_live_account": holders(COL("deceased") == "Y", "n_unrestricted"),
        "moving_accounts_without_kyc": has_related(
            without_kyc, h.filter(maybe_key(COL("ac_no"), without_kyc, "cust_ac_no")), "cust_ac_no", "ac_no").agg(
            F.count_distinct("cust_ac_no").alias("n")),
        "shared_national_ids": number(shared_values(p, "p_national_id")),
        "shared_passports": number(shared_values(p, "passport_no")),
        "shared_unique_ids": number(shared_values(c, "unique_id_value")),
    }
    parts = [df.select(F.lit(name).alias("metric"), "n") for name, df in rows.items()]
    return union_all(parts)
