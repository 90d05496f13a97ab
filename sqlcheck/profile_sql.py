"""DuckDB form of the profiling metrics."""

from __future__ import annotations

from sqlcheck.prelude import AS_OF, blank, filled, months_back, day, segment, shorter, with_tables
from tellerlens.operators.udf_views import VIEWS
from tellerlens.plans.profile import (
    ACCOUNT_FLAGS, CLASS_FACILITIES, CLIENT_FLAGS, FREQUENCIES, INCOME_SOURCES, ONLY_FILLED, TOP_FIFTEEN, TOP_TEN,
)
from tellerlens.sources.schemas import VOLUME_TABLES


def frequency_query(table: str) -> str:
    rows = [
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, COUNT(*) AS n FROM {table} GROUP BY {c}"
        for c in FREQUENCIES[table].split()
    ]
    return with_tables(" UNION ALL ".join(rows))


def top_query(table: str) -> str:
    rows = []
    for c in TOP_TEN[table].split():
        k = 15 if (table, c) in TOP_FIFTEEN else 10
        where = f"WHERE {filled(c)}" if (table, c) in ONLY_FILLED else ""
        rows.append(
            f"SELECT '{c}' AS column_name, {c} AS value, n, ROW_NUMBER() OVER (ORDER BY n DESC, {c} ASC NULLS LAST) AS rank"
            f" FROM (SELECT {c}, COUNT(*) AS n FROM {table} {where} GROUP BY {c}) AS g QUALIFY rank <= {k}"
        )
    return with_tables(" UNION ALL ".join(f"SELECT * FROM ({r}) AS t{i}" for i, r in enumerate(rows)))


_yes = lambda *names: {f"{n}_yes": f"{n} = 'Y'" for n in names}
_blanks = lambda *names: {f"{n}_blank": blank(n) for n in names}
_both = lambda *names: {**_blanks(*names), **{f"{n}_set": filled(n) for n in names}}
_idle = lambda m: " AND ".join(
    f"({c} IS NULL OR {c} < {months_back(m)})" for c in ("date_last_cr_activity", "date_last_dr_activity")
)

COUNTS: dict[str, dict[str, str]] = {
    "sttm_customer": {**_both("kyc_ref_no", "unique_id_value", "introducer"), **_yes(*CLIENT_FLAGS)},
    "sttm_cust_personal": {
        **_blanks("p_national_id", "passport_no", "e_mail", "mobile_number", "first_name", "last_name"), **_both("place_of_birth"),
        "both_addresses_blank": f"{blank('p_address1')} AND {blank('d_address1')}", "date_of_birth_missing": "date_of_birth IS NULL",
        "passport_expired": f"ppt_exp_date < {AS_OF}", "pa_holder_name_set": filled("pa_holder_name"), **_yes("minor"),
    },
    "sttm_cust_account": {
        **_yes(*ACCOUNT_FLAGS), "overdraft_since_set": "overdraft_since IS NOT NULL", "dormancy_date_set": "dormancy_date IS NOT NULL",
        **{f"inactive_over_{m}_months": _idle(m) for m in (6, 12, 24)},
    },
    "sttb_account": _yes("ac_stat_dormant", "ac_stat_frozen", "gl_stat_blocked"),
    "sttm_kyc_master": {"maker_is_checker": "maker_id = checker_id", **_blanks("kyc_desc")},
    "sttm_kyc_retail": {
        "visa_expired": f"visa_expiry_date < {AS_OF}", "passport_expired": f"passport_expiry_date < {AS_OF}",
        "review_overdue": f"kyc_nxt_review_date < {AS_OF}", **{f"{n}_set": filled(n) for n in INCOME_SOURCES},
        "pep_without_remarks": f"pep = 'Y' AND {blank('pep_remarks')}", "pep_with_remarks": f"pep = 'Y' AND {filled('pep_remarks')}",
    },
    "sttm_kyc_corporate": {
        "review_overdue": f"kyc_nxt_review_date < {AS_OF}", **_both("trade_licence_no", "introducer_dtl"),
        "audit_date_missing": "audit_date IS NULL", "audit_over_12_months": f"audit_date < {months_back(12)}",
    },
    "actb_history": {
        "foreign_rate": "exch_rate NOT IN (0, 1)", "related_account_set": filled("related_account"),
        "related_customer_set": filled("related_customer"),
    },
    "sttm_account_class": _yes(*CLASS_FACILITIES),
    "sttm_kyc_corp_keypersons": {
        "share_missing_or_zero": "COALESCE(share_holding, 0) = 0", "share_positive": "share_holding > 0", **_both("tin"),
    },
}


def count_query(table: str) -> str:
    rows = [
        f"SELECT '{name}' AS metric, COUNT(*) FILTER ({test}) AS n, COUNT(*) AS total FROM {table}"
        for name, test in COUNTS[table].items()
    ]
    return with_tables(" UNION ALL ".join(rows))


STATS: dict[str, dict[str, str | None]] = {
    "sttm_cust_account": {
        "acy_curr_balance": "acy_curr_balance < 0", "acy_today_tover_dr": None, "acy_today_tover_cr": None,
        "acy_mtd_tover_dr": None, "acy_mtd_tover_cr": None,
    },
    "sttm_kyc_retail": {c: f"COALESCE({c}, 0) = 0" for c in ("total_income", "total_net_worth")},
    "sttm_kyc_corporate": {c: f"COALESCE({c}, 0) = 0" for c in ("annual_turnover", "employee_number")},
    "actb_history": {"lcy_amount": None, "fcy_amount": "fcy_amount <> lcy_amount AND fcy_amount > 0"},
    "sttm_kyc_corp_keypersons": {"share_holding": None},
}


def stats_query(table: str) -> str:
    source = f"{table} WHERE share_holding > 0" if table == "sttm_kyc_corp_keypersons" else table
    rows = []
    for c, test in STATS[table].items():
        cast = lambda e: f"CAST(CAST(ROUND({e}, 2) AS DECIMAL(38,2)) AS DOUBLE)"
        end = cast if table in ("sttm_cust_account", "actb_history") else (lambda e: f"CAST({e} AS DOUBLE)")
        flagged = f"COUNT(*) FILTER ({test})" if test else "CAST(NULL AS BIGINT)"
        rows.append(
            f"SELECT '{c}' AS column_name, {end(f'MIN({c})')} AS min_value, {end(f'MAX({c})')} AS max_value,"
            f" {cast(f'CAST(SUM({c}) AS DOUBLE) / COUNT({c})')} AS avg_value, {cast(f'SUM({c})')} AS sum_value, {flagged} AS n_flagged FROM {source}"
        )
    return with_tables(" UNION ALL ".join(rows))


_CF = "c.kyc_ref_no"
_NOREF = blank(_CF)
_shared = lambda t, c: f"SELECT COUNT(*) AS n FROM (SELECT {c} FROM {t} WHERE {filled(c)} GROUP BY 1 HAVING COUNT(*) > 1) AS g"
CROSS = {
    "clients_without_account": "SELECT COUNT(*) AS n FROM sttm_customer c WHERE NOT EXISTS (FROM sttm_cust_account a WHERE a.cust_no = c.customer_no)",
    "individuals_without_personal_file": "SELECT COUNT(*) AS n FROM sttm_customer c WHERE c.customer_type = 'I' AND c.customer_no NOT IN (SELECT customer_no FROM sttm_cust_personal)",
    "monitoring_required_without_kyc": f"SELECT COUNT(*) AS n FROM sttm_customer c WHERE c.aml_required = 'Y' AND {_NOREF}",
    "kyc_reference_without_file": f"SELECT COUNT(*) AS n FROM sttm_customer c WHERE {filled(_CF)} AND c.kyc_ref_no NOT IN (SELECT kyc_ref_no FROM sttm_kyc_master)",
    "accounts_without_ledger_row": "SELECT COUNT(*) AS n FROM sttm_cust_account a ANTI JOIN sttb_account b ON b.cust_no = a.cust_no AND b.pkey = a.cust_ac_no",
    "individual_files_without_retail": "SELECT COUNT(*) AS n FROM sttm_kyc_master m ANTI JOIN sttm_kyc_retail r USING (kyc_ref_no) WHERE m.kyc_cust_type = 'I'",
    "company_files_without_corporate": "SELECT COUNT(*) AS n FROM sttm_kyc_master m ANTI JOIN sttm_kyc_corporate k USING (kyc_ref_no) WHERE m.kyc_cust_type = 'C'",
    "corporates_without_keypersons": "SELECT COUNT(*) AS n FROM sttm_kyc_corporate k ANTI JOIN sttm_kyc_corp_keypersons p USING (kyc_ref_no)",
    "frozen_clients_with_unfrozen_account": "SELECT COUNT(*) AS n FROM sttm_customer c WHERE c.frozen = 'Y' AND EXISTS (FROM sttm_cust_account a WHERE a.cust_no = c.customer_no AND a.ac_stat_frozen <> 'Y')",
    "deceased_clients_with_live_account": "SELECT COUNT(*) AS n FROM sttm_customer c WHERE c.deceased = 'Y' AND EXISTS (FROM sttm_cust_account a WHERE a.cust_no = c.customer_no AND a.ac_stat_block <> 'Y' AND a.ac_stat_frozen <> 'Y')",
    "moving_accounts_without_kyc": f"SELECT COUNT(DISTINCT h.ac_no) AS n FROM actb_history h JOIN sttm_cust_account a ON a.cust_ac_no = h.ac_no JOIN sttm_customer c ON c.customer_no = a.cust_no WHERE {_NOREF}",
    "shared_national_ids": _shared("sttm_cust_personal", "p_national_id"),
    "shared_passports": _shared("sttm_cust_personal", "passport_no"),
    "shared_unique_ids": _shared("sttm_customer", "unique_id_value"),
}


def udf_query(function_id: str) -> str:
    keys, names = VIEWS[function_id]
    part = lambda n: "rec_key" if n is None else shorter("rec_key") if n == 0 else segment("rec_key", n)
    cols = [f"{part(n)} AS {name}" for name, n in keys]
    cols += [f"field_val_{i} AS {name}" for i, name in enumerate(names.split(), 1)]
    return with_tables(f"SELECT {', '.join(cols)} FROM cstm_function_userdef_fields WHERE function_id = '{function_id}'")


def preview_query(k: int = 5) -> str:
    """First rows of every function, decoded, one row per key part and field."""
    parts = []
    for function_id, (keys, names) in VIEWS.items():
        part = lambda n: "rec_key" if n is None else shorter("rec_key") if n == 0 else segment("rec_key", n)
        cols = [(name, part(n)) for name, n in keys] + [(name, f"field_val_{i}") for i, name in enumerate(names.split(), 1)]
        used = ", ".join(f"field_val_{i}" for i in range(1, len(names.split()) + 1))
        first = (
            f"SELECT ROW_NUMBER() OVER (ORDER BY rec_key NULLS LAST, {used}) AS rank, * FROM cstm_function_userdef_fields"
            f" WHERE function_id = '{function_id}' QUALIFY rank <= {k}"
        )
        for i, (name, value) in enumerate(cols, 1):
            parts.append(f"SELECT '{function_id}' AS function_id, rank, rec_key, {i} AS position, '{name}' AS name, {value} AS value FROM ({first}) AS f")
    return with_tables(" UNION ALL ".join(parts))


_RANGE = lambda t, c: (
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {day(f'MIN({c})')} AS first_value, {day(f'MAX({c})')} AS last_value FROM {t}"
)
OTHERS: dict[str, str] = {
    "volumes": " UNION ALL ".join(
        f"SELECT {i} AS ord, '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for i, t in enumerate(VOLUME_TABLES, 1)),
    "date_ranges": " UNION ALL ".join(
        _RANGE(t, c) for t, c in (
            ("sttm_customer", "cif_creation_date"), ("sttm_cust_account", "ac_open_date"), ("sttm_cust_account", "dormancy_date"), ("actb_history", "trn_dt"))),
    "clients_per_year": "SELECT YEAR(cif_creation_date) AS year, COUNT(*) AS n FROM sttm_customer WHERE cif_creation_date IS NOT NULL GROUP BY 1",
    "transactions_per_year": "SELECT YEAR(trn_dt) AS year, COUNT(*) AS n, CAST(SUM(lcy_amount) AS DOUBLE) AS total_amount FROM actb_history GROUP BY 1",
    "risk_by_type": "SELECT kyc_cust_type, risk_level, COUNT(*) AS n FROM sttm_kyc_master GROUP BY ALL",
    "accounts_per_client": "SELECT s AS group_size, COUNT(*) AS n_groups FROM (SELECT COUNT(*) AS s FROM sttm_cust_account GROUP BY cust_no) AS g GROUP BY s",
    "keypersons_per_file": "SELECT s AS group_size, COUNT(*) AS n_groups FROM (SELECT COUNT(*) AS s FROM sttm_kyc_corp_keypersons GROUP BY kyc_ref_no) AS g GROUP BY s",
    "keyperson_files": "SELECT COUNT(*) AS n_persons, COUNT(DISTINCT kyc_ref_no) AS n_files FROM sttm_kyc_corp_keypersons",
    "first_classes": "SELECT account_class, description FROM sttm_account_class ORDER BY account_class LIMIT 10",
    "categories": "SELECT cust_cat, cust_cat_desc FROM sttm_customer_cat",
    "cross_checks": " UNION ALL ".join(f"SELECT '{n}' AS metric, n FROM ({q}) AS q_{n}" for n, q in CROSS.items()),
}


def other_query(name: str) -> str:
    return with_tables(OTHERS[name])
