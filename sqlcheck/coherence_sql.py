"""DuckDB form of the coherence rules: counts and samples."""

from __future__ import annotations

from sqlcheck.prelude import (
    AS_OF, birthday, blank, cents, codes, day, filled, first_segment, months_back, num, segment, shorter, top, with_tables,
)
from tellerlens.params import BANK_CATEGORIES, CEMAC_COUNTRIES, CORPORATE_CATEGORIES, INDIVIDUAL_CATEGORIES, NON_RESIDENT_CATEGORIES

C = "FROM sttm_customer c"
CP = f"{C} JOIN sttm_cust_personal p USING (customer_no)"
CR = f"{C} JOIN sttm_kyc_retail r USING (kyc_ref_no)"
CM = f"{C} JOIN sttm_kyc_master m USING (kyc_ref_no)"
CPR = f"{CP} JOIN sttm_kyc_retail r USING (kyc_ref_no)"
CMR = f"{CM} JOIN sttm_kyc_retail r USING (kyc_ref_no)"
CMX = f"{C} LEFT JOIN sttm_kyc_master m USING (kyc_ref_no)"
CMKX = f"{CM} LEFT JOIN sttm_kyc_corporate k USING (kyc_ref_no)"
CMRX = f"{CM} LEFT JOIN sttm_kyc_retail r USING (kyc_ref_no)"
AB = "FROM sttm_cust_account a JOIN sttb_account b ON b.ac_gl_no = a.cust_ac_no AND b.branch_code = a.branch_code"
BAL = cents("COALESCE((SELECT bal FROM acct_all WHERE cust_no = c.customer_no), 0)")
BAL_OPEN = cents("COALESCE((SELECT bal FROM acct_open WHERE cust_no = c.customer_no), 0)")
OPEN = "c.customer_no IN (SELECT cust_no FROM acct_open)"
WHO = {"customer_no": "c.customer_no", "customer_name": "c.customer_name1"}
RICHEST = ["total_balance DESC NULLS FIRST"]
CAT = {"customer_category": "c.customer_category"}
AGE = f"DATE_SUB('year', p.date_of_birth, {AS_OF})"

RULES: dict[str, dict] = {}


def _client(rule: str, body: str, where: str, show: dict | None = None, k: int = 30, bal: str = BAL, who: dict = WHO) -> None:
    columns = {**who, **(show or {}), "total_balance": bal}
    RULES[rule] = {
        "count": f"SELECT COUNT(*) AS n {body} WHERE {where}",
        "": top(columns, f"{body} WHERE {where}", RICHEST, k),
    }


def _pair(rule: str, body: str, a: str, b: str, kind: str = "text") -> None:
    if kind == "date":
        return _client(rule, body, f"{a} <> {b}", {"left_value": day(a), "right_value": day(b)})
    f = (lambda x: f"UPPER(TRIM({x}))") if kind == "upper" else (lambda x: f"TRIM({x})")
    _client(
        rule, body, f"{filled(a, 'trim')} AND {filled(b, 'trim')} AND {f(a)} <> {f(b)}",
        {"left_value": f"TRIM({a})", "right_value": f"TRIM({b})"},
    )


_pair("1.1", CPR, "p.date_of_birth", "r.birth_date", "date")
_pair("1.2", CPR, "p.birth_country", "r.birth_country")
_pair("1.3", CPR, "p.place_of_birth", "r.birth_place", "upper")
_pair("1.4", CPR, "p.passport_no", "r.passport_no")
_pair("1.5", CPR, "p.ppt_exp_date", "r.passport_expiry_date", "date")
_pair("1.6", CPR, "p.us_res_status", "r.us_res_status")
_pair("1.7", CPR, "p.pa_issued", "r.pa_given")
_pair("1.8", CPR, "p.pa_holder_name", "r.pa_holder_name", "upper")
_client(
    "1.9", CPR,
    f"{filled('r.resident', 'trim')} AND CASE TRIM(p.resident_status) WHEN 'R' THEN TRIM(r.resident) <> 'Y'"
    " WHEN 'N' THEN TRIM(r.resident) <> 'N' ELSE FALSE END",
    {"left_value": "TRIM(p.resident_status)", "right_value": "TRIM(r.resident)"},
)
_pair("1.10", CR, "c.nationality", "r.nationality")

_client(
    "2.1", CM,
    f"{filled('c.kyc_ref_no', 'trim')} AND CASE c.customer_type WHEN 'I' THEN m.kyc_cust_type <> 'R'"
    " WHEN 'C' THEN m.kyc_cust_type <> 'C' WHEN 'B' THEN m.kyc_cust_type <> 'F' ELSE FALSE END",
    {"left_value": "c.customer_type", "right_value": "m.kyc_cust_type"},
)
_KIND = {"customer_type": "c.customer_type"}
_client(
    "2.2", C, "c.customer_type = 'I' AND c.customer_no NOT IN (SELECT customer_no FROM sttm_cust_personal)",
    {**_KIND, "category": "COALESCE(c.customer_category, '-')"},
)
for _rule, _type, _kyc, _detail in (("2.3", "C", "C", "sttm_kyc_corporate"), ("2.4", "I", "R", "sttm_kyc_retail")):
    _client(
        _rule, CM,
        f"c.customer_type = '{_type}' AND m.kyc_cust_type = '{_kyc}'"
        f" AND NOT EXISTS (FROM {_detail} d WHERE d.kyc_ref_no = c.kyc_ref_no)", _KIND,
    )
_client("2.5", C, "c.staff = 'Y' AND c.customer_category <> 'STAF'", {"left_value": "c.staff", "right_value": "c.customer_category"})
_client(
    "2.6", C, "c.customer_category = 'STAF' AND COALESCE(c.staff, '-') <> 'Y'",
    {"left_value": "c.customer_category", "right_value": "COALESCE(c.staff, 'NULL')"},
)
_client(
    "2.7", CR, "c.customer_category = 'PEP/FEPS' AND COALESCE(r.pep, '-') <> 'Y'",
    {"left_value": "c.customer_category", "right_value": "COALESCE(r.pep, 'NULL')"},
)
_client("2.8", CR, "r.pep = 'Y' AND c.customer_category <> 'PEP/FEPS'", {"left_value": "r.pep", "right_value": "c.customer_category"})

_AGES = {"age": AGE, "date_of_birth": day("p.date_of_birth")}
_REACHED = lambda n: f"p.date_of_birth <= {birthday(n)}"
_YOUNGER = lambda n: f"p.date_of_birth > {birthday(n)}"
_client("3.1", CP, f"c.customer_category = 'MINORS' AND {_REACHED(18)}", _AGES)
_client("3.2", CP, "c.customer_category = 'MINORS' AND COALESCE(p.minor, '-') <> 'Y'", {"minor": "COALESCE(p.minor, 'NULL')"})
_client("3.3", CP, "p.minor = 'Y' AND c.customer_category <> 'MINORS'", CAT)
_client("3.4", CP, f"c.customer_category = 'SENIORS' AND {_YOUNGER(60)}", _AGES)
_client("3.5", CP, f"c.customer_category = 'STUDENTS' AND ({_YOUNGER(19)} OR p.date_of_birth < {birthday(28)})", _AGES)
for _rule, _code, _test in (
    ("3.6", "CSE1", ">= 3750000"), ("3.7", "CSE2", "< 3750000"), ("3.8", "PSE1", ">= 5250000"),
    ("3.9", "PSE2", "NOT BETWEEN 5250000 AND 15000000"), ("3.10", "PSE3", "<= 15000000"), ("3.11", "PFBI", "<= 15000000"),
):
    _client(
        _rule, CR, f"c.customer_category = '{_code}' AND r.total_income > 0 AND r.total_income {_test}",
        {"total_income": num("r.total_income")},
    )
_client("3.12", CP, f"c.customer_category = 'VPFP' AND {_YOUNGER(50)}", _AGES)
for _rule, _list, _type in (("3.13", INDIVIDUAL_CATEGORIES, "I"), ("3.14", CORPORATE_CATEGORIES, "C")):
    _client(_rule, C, f"c.customer_category IN {codes(*_list)} AND c.customer_type <> '{_type}'", {**CAT, **_KIND})
_client("3.15", C, blank("c.customer_category", "trim"), _KIND)
_client("3.16", C, "c.customer_category IS NOT NULL AND c.customer_category NOT IN (SELECT cust_cat FROM sttm_customer_cat)", CAT)
_client("3.17", CP, f"{_YOUNGER(18)} AND COALESCE(c.customer_category, '-') <> 'MINORS'", {**CAT, "age": AGE})
_client(
    "3.18", CP, f"c.customer_type = 'I' AND {_REACHED(60)} AND COALESCE(c.customer_category, '-') NOT IN ('SENIORS', 'VPFP')",
    {**CAT, "age": AGE},
)
_client(
    "3.19", CMR, f"r.resident = 'N' AND COALESCE(c.customer_category, '-') NOT IN {codes(*NON_RESIDENT_CATEGORIES)}",
    {**CAT, "resident": "r.resident"},
)
_client("3.20", CMR, f"c.customer_category = 'SAL' AND {blank('r.salary_income', 'trim')}", {**CAT, "salary_income": "r.salary_income"})
_RICH = f"{CMR} JOIN acct_all t ON t.cust_no = c.customer_no WHERE r.total_income > 0 AND t.bal > 10 * r.total_income"
RULES["3.21"] = {
    "count": f"SELECT COUNT(*) AS n {_RICH}",
    "": top(
        {**WHO, "total_income": num("r.total_income"), "total_balance": cents("t.bal"),
         "ratio": "ROUND(CAST(t.bal AS DOUBLE) / CAST(r.total_income AS DOUBLE), 1)"}, _RICH, RICHEST, 30),
}

for _rule, _a, _b, _trim in (
    ("4.1", "ac_stat_dormant", "ac_stat_dormant", False), ("4.2", "ac_stat_frozen", "ac_stat_frozen", False),
    ("4.3", "ac_stat_block", "gl_stat_blocked", False), ("4.4", "ac_stat_no_dr", "ac_stat_no_dr", False),
    ("4.5", "ac_stat_no_cr", "ac_stat_no_cr", False), ("4.6", "ac_stat_stop_pay", "ac_stat_stop_pay", False),
    ("4.7", "ccy", "ac_gl_ccy", True), ("4.9", "record_stat", "ac_gl_rec_status", False),
):
    _l, _r = (f"TRIM(a.{_a})", f"TRIM(b.{_b})") if _trim else (f"a.{_a}", f"b.{_b}")
    _where = f"{_l} <> {_r}" + (f" AND {_l} <> '' AND {_r} <> ''" if _trim else "")
    RULES[_rule] = {
        "count": f"SELECT COUNT(*) AS n {AB} WHERE {_where}",
        "": top(
            {"cust_ac_no": "a.cust_ac_no", "cust_no": "a.cust_no", "left_value": _l, "right_value": _r,
             "balance": cents("a.acy_curr_balance")}, f"{AB} WHERE {_where}", ["balance DESC NULLS FIRST"], 30),
    }
_UNFROZEN = "(SELECT COUNT(*) FROM sttm_cust_account a WHERE a.cust_no = c.customer_no AND a.ac_stat_frozen <> 'Y')"
_client("4.8", C, f"c.frozen = 'Y' AND {_UNFROZEN} > 0", {"n_unfrozen": _UNFROZEN})

_pair("5.1", CP, "c.country", "p.d_country")
_pair("5.2", CR, "c.country", "r.local_addr_country")
_pair("5.3", CPR, "p.d_country", "r.local_addr_country")
_pair("5.4", CPR, "p.p_country", "r.home_addr_country")
_client("5.5", CP, "p.resident_status = 'N' AND c.country = 'CMR'", {**CAT, "nationality": "c.nationality"})
_client(
    "5.6", CP, "c.customer_category IN ('NRA1', 'NRA2') AND p.resident_status = 'R'",
    {**CAT, "country": "c.country", "nationality": "c.nationality"},
)
_client("5.7", C, "c.customer_category = 'FOREIGN' AND c.nationality = 'CMR'", {"country": "c.country"})

U = "cstm_function_userdef_fields u"
_client(
    "6.1", f"FROM {U} JOIN sttm_customer c ON c.customer_no = {first_segment('u.rec_key')}",
    "u.function_id = 'STDCIF' AND UPPER(TRIM(u.field_val_18)) = 'Y' AND COALESCE(c.frozen, '-') <> 'Y'",
    {"frozen": "COALESCE(c.frozen, 'N')"},
)
_REF = "LEFT JOIN one_client oc ON oc.ref = {0}.kyc_ref_no LEFT JOIN acct_all t ON t.cust_no = oc.customer_no"
_FIRST = {
    "customer_no": "COALESCE(oc.customer_no, '-')", "customer_name": "COALESCE(oc.customer_name, '-')",
    "total_balance": cents("COALESCE(t.bal, 0)"),
}
_FIELD = f"FROM sttm_kyc_retail r JOIN {U} ON {shorter('u.rec_key')} = r.kyc_ref_no AND u.function_id = 'STDKYCMN'"
_UP = "UPPER(TRIM(u.field_val_1))"
for _rule, _where, _show in (
    ("6.2", f"{_UP} = 'Y' AND COALESCE(r.pep, '-') <> 'Y'", {"pep": "COALESCE(r.pep, 'NULL')"}),
    ("6.3", f"r.pep = 'Y' AND COALESCE({_UP}, '-') <> 'Y'", {"field_pep": f"COALESCE({_UP}, 'NULL')"}),
):
    RULES[_rule] = {
        "count": f"SELECT COUNT(*) AS n {_FIELD} WHERE {_where}",
        "": top({"kyc_ref_no": "r.kyc_ref_no", **_show, **_FIRST}, f"{_FIELD} {_REF.format('r')} WHERE {_where}", RICHEST, 30),
    }
_MAILS = f"COUNT(*) FILTER ({blank('u.field_val_1', 'trim')})"
RULES["6.4"] = {
    "count": f"SELECT {_MAILS} AS n FROM {U} WHERE u.function_id = 'SMDUSRDF'",
    "": f"SELECT {_MAILS} AS n_without_email, COUNT(*) AS n_users FROM {U} WHERE u.function_id = 'SMDUSRDF'",
}
_ACC = segment("u.rec_key", 2)
_LOST = f"FROM {U} WHERE u.function_id = 'STDCUSAC' AND NOT EXISTS (FROM sttm_cust_account a WHERE a.cust_ac_no = {_ACC})"
RULES["6.5"] = {
    "count": f"SELECT COUNT(*) AS n {_LOST}",
    "": top({"rec_key": "u.rec_key", "branch": first_segment("u.rec_key"), "account_no": _ACC}, _LOST, ["rec_key ASC NULLS LAST"], 30),
}
_NF = f"(SELECT COUNT(*) FROM {U} WHERE u.function_id = 'STDCIF')"
_NC = "(SELECT COUNT(*) FROM sttm_customer)"
RULES["6.6"] = {
    "count": f"SELECT ABS({_NF} - {_NC}) AS n",
    "": f"SELECT {_NF} AS n_fields, {_NC} AS n_clients, ABS({_NF} - {_NC}) AS gap",
}

_client(
    "7.1", C, f"{filled('c.kyc_ref_no', 'trim')} AND c.kyc_ref_no NOT IN (SELECT kyc_ref_no FROM sttm_kyc_master)",
    {"kyc_ref_no": "c.kyc_ref_no", **CAT},
)
_NOBODY = "FROM sttm_kyc_master m WHERE NOT EXISTS (FROM sttm_customer c WHERE c.kyc_ref_no = m.kyc_ref_no)"
RULES["7.2"] = {
    "count": f"SELECT COUNT(*) AS n {_NOBODY}",
    "": top(
        {"kyc_ref_no": "m.kyc_ref_no", "kyc_cust_type": "m.kyc_cust_type", "maker_id": "COALESCE(m.maker_id, '-')",
         "made_on": day("m.maker_dt_stamp")}, _NOBODY, ["kyc_ref_no ASC NULLS LAST"], 30),
}
_client("7.3", C, f"c.aml_required = 'Y' AND {blank('c.kyc_ref_no', 'trim')}", CAT)
_client("7.4", C, f"c.kyc_details = 'V' AND {blank('c.kyc_ref_no', 'trim')}", CAT)
for _rule, _t in (("7.5", "sttm_kyc_retail"), ("7.6", "sttm_kyc_corporate")):
    _late = f"d.kyc_nxt_review_date < {AS_OF}"
    RULES[_rule] = {
        "count": f"SELECT COUNT(*) AS n FROM {_t} d WHERE {_late}",
        "": top(
            {"customer_no": "COALESCE(c.customer_no, '-')", "customer_name": "COALESCE(c.customer_name1, '-')",
             "kyc_ref_no": "d.kyc_ref_no", "review_date": day("d.kyc_nxt_review_date"),
             "days_late": f"DATE_SUB('day', d.kyc_nxt_review_date, {AS_OF})", "total_balance": cents("COALESCE(t.bal, 0)")},
            f"FROM {_t} d LEFT JOIN sttm_customer c ON c.kyc_ref_no = d.kyc_ref_no"
            f" LEFT JOIN acct_all t ON t.cust_no = c.customer_no WHERE {_late}", RICHEST, 30),
    }
_MUTE = f"r.pep = 'Y' AND {blank('r.pep_remarks', 'trim')}"
RULES["7.7"] = {
    "count": f"SELECT COUNT(*) AS n FROM sttm_kyc_retail r WHERE {_MUTE}",
    "": top({"kyc_ref_no": "r.kyc_ref_no", **_FIRST}, f"FROM sttm_kyc_retail r {_REF.format('r')} WHERE {_MUTE}", RICHEST, 30),
}
_NOHOLDER = "FROM sttm_cust_account a WHERE NOT EXISTS (FROM sttm_customer c WHERE c.customer_no = a.cust_no)"
RULES["7.8"] = {
    "count": f"SELECT COUNT(DISTINCT a.cust_no) AS n {_NOHOLDER}",
    "": top(
        {"cust_no": "a.cust_no", "cust_ac_no": "a.cust_ac_no", "balance": cents("a.acy_curr_balance"), "ccy": "a.ccy",
         "ac_desc": "a.ac_desc"}, _NOHOLDER, ["balance DESC NULLS FIRST"], 30),
}
_LISTED = lambda text, order: f"RTRIM(LEFT(STRING_AGG({text} || ', ', '' ORDER BY {order}), 200), ', ')"
for _rule, _t, _key in (("7.9", "sttm_cust_personal", "p_national_id"), ("7.10", "sttm_customer", "unique_id_value")):
    _grp = (
        f"SELECT {_key}, COUNT(*) AS n, {_LISTED('customer_no', 'customer_no')} AS members FROM {_t}"
        f" WHERE {filled(_key, 'trim')} GROUP BY {_key} HAVING COUNT(*) > 1"
    )
    RULES[_rule] = {
        "count": f"SELECT COUNT(*) AS n FROM ({_grp}) AS g",
        "": top({_key: _key, "n": "n", "members": "members"}, f"FROM ({_grp}) AS g", ["n DESC"], 30),
    }
_client(
    "7.11", C, "c.deceased = 'Y' AND EXISTS (FROM sttm_cust_account a WHERE a.cust_no = c.customer_no"
    " AND a.ac_stat_block <> 'Y' AND a.ac_stat_frozen <> 'Y')",
)
_NOKYC = (
    f"FROM sttm_cust_account a JOIN sttm_customer c ON c.customer_no = a.cust_no WHERE {blank('c.kyc_ref_no', 'trim')}"
    " AND a.cust_ac_no IN (SELECT ac_no FROM actb_history)"
)
RULES["7.12"] = {
    "count": f"SELECT COUNT(DISTINCT a.cust_ac_no) AS n {_NOKYC}",
    "": top(
        {"cust_ac_no": "a.cust_ac_no", "cust_no": "a.cust_no", "balance": cents("a.acy_curr_balance"),
         "customer_name": "c.customer_name1", "n_txn": "(SELECT COUNT(*) FROM actb_history h WHERE h.ac_no = a.cust_ac_no)"},
        _NOKYC, ["balance DESC NULLS FIRST"], 30),
}
_SELF = "m.maker_id = m.checker_id AND m.maker_id <> 'MIGRATION'"
RULES["7.13"] = {
    "count": f"SELECT COUNT(*) AS n FROM sttm_kyc_master m WHERE {_SELF}",
    "": top(
        {"kyc_ref_no": "m.kyc_ref_no", "maker_id": "m.maker_id", "maker_dt_stamp": day("m.maker_dt_stamp"), **_FIRST},
        f"FROM sttm_kyc_master m {_REF.format('m')} WHERE {_SELF}", ["maker_dt_stamp DESC NULLS LAST"], 30),
}


def _peers(rule: str, body: str, where: str, value: str, show: dict) -> None:
    """Pairwise form: another client with the same value and nationality but another rating."""
    cte = (
        f"peers AS (SELECT c.customer_no, c.customer_name1, c.nationality, c.country, {value} AS val, m.risk_level,"
        f" {', '.join(f'{e} AS {n}' for n, e in show.items())} {body} WHERE {where} AND {OPEN})"
    )
    other = (
        "EXISTS (FROM peers d WHERE d.customer_no <> c.customer_no AND COALESCE(d.val, -1) = COALESCE(c.val, -1)"
        " AND COALESCE(d.nationality, '?') = COALESCE(c.nationality, '?')"
        " AND COALESCE(d.risk_level, '?') <> COALESCE(c.risk_level, '?'))"
    )
    name = value.split(".")[1]
    columns = {
        **WHO, "nationality": "c.nationality", "country": "c.country", name: num("c.val"), "risk_level": "c.risk_level",
        **{n: f"c.{n}" for n in show}, "total_balance": BAL_OPEN,
    }
    order = ["nationality ASC NULLS LAST", f"{name} ASC NULLS LAST", "risk_level ASC NULLS LAST", "customer_no ASC NULLS LAST"]
    text = (
        "COALESCE(a.cust_ac_no, '') || '(' || COALESCE(a.ccy, '') || ':' ||"
        " COALESCE(FORMAT('{:,}', CAST(ROUND(a.acy_curr_balance, 0) AS BIGINT)), '') || ')'"
    )
    lists = (
        f"SELECT c.customer_no, {_LISTED(text, f'a.cust_ac_no, {text}')} AS open_accounts FROM peers c JOIN sttm_cust_account a"
        f" ON a.cust_no = c.customer_no AND a.record_stat = 'O' WHERE {other} GROUP BY c.customer_no"
    )
    RULES[rule] = {
        "cte": cte,
        "count": f"SELECT COUNT(*) AS n FROM peers c WHERE {other}",
        "": top(columns, f"FROM peers c WHERE {other}", order, 60),
        "accounts": top({"customer_no": "customer_no", "open_accounts": "open_accounts"}, f"FROM ({lists}) AS l", ["customer_no ASC"], 60),
    }


_peers(
    "7.14", CMRX, "(COALESCE(r.pep, '') = 'Y' OR COALESCE(c.customer_category, '') = 'PEP/FEPS')", "r.total_income",
    {"source": "CASE WHEN r.pep = 'Y' AND c.customer_category = 'PEP/FEPS' THEN 'PEP+CAT' WHEN r.pep = 'Y' THEN 'KYC_R.PEP' ELSE 'CAT.PEP' END"},
)
for _rule, _code in (("7.15", "NGOs"), ("7.16", "REL")):
    _peers(_rule, CMKX, f"c.customer_category = '{_code}'", "k.annual_turnover", {"business": "COALESCE(LEFT(k.business_nature, 8), '-')"})

_CIF = f"LEFT JOIN {U} ON u.function_id = 'STDCIF' AND u.rec_key = c.customer_no || '~'"
_PROFILE_COLS = {
    "profile_category": "COALESCE(c.customer_category, '?')", "profile_nationality": "COALESCE(c.nationality, '?')",
    "profile_pep": "COALESCE(r.pep, 'N')", "profile_resident": "COALESCE(r.resident, '?')",
    "profile_income": num("COALESCE(r.total_income, 0)"), "profile_profession": "COALESCE(u.field_val_1, '-')",
}
_PK = ", ".join(_PROFILE_COLS)
_BASE = (
    "base AS (SELECT c.customer_no, c.customer_name1, COALESCE(t.cust_cat_desc, c.customer_category) AS category_desc,"
    f" m.risk_level, {num('r.total_income')} AS total_income, {BAL_OPEN} AS total_balance,"
    f" {', '.join(f'{e} AS {n}' for n, e in _PROFILE_COLS.items())} {CMRX} {_CIF}"
    f" LEFT JOIN sttm_customer_cat t ON t.cust_cat = c.customer_category WHERE c.customer_type = 'I' AND m.risk_level IS NOT NULL AND {OPEN})"
)
_SHOWN = {
    **WHO, "category_desc": "c.category_desc", "risk_level": "c.risk_level", "total_income": "c.total_income",
    "total_balance": "c.total_balance", **{n: f"c.{n}" for n in _PROFILE_COLS},
}
_PORDER = [f"{n} ASC NULLS LAST" for n in _PROFILE_COLS] + ["risk_level ASC NULLS LAST"]
_MIXED = f"SELECT {_PK} FROM base GROUP BY ALL HAVING COUNT(DISTINCT risk_level) > 1"
RULES["7.17"] = {
    "cte": _BASE,
    "count": f"SELECT COUNT(*) AS n FROM ({_MIXED}) AS g",
    "": top(_SHOWN, f"FROM base c SEMI JOIN ({_MIXED}) AS g USING ({_PK})", [*_PORDER, "total_balance DESC NULLS FIRST"], 60),
}
_SAME = (
    "people AS (SELECT c.customer_no, c.customer_name1, COALESCE(c.local_branch, '-') AS branch, u.field_val_6 AS tax_id, m.risk_level,"
    f" (SELECT n FROM acct_open WHERE cust_no = c.customer_no) AS n_accounts, {BAL_OPEN} AS total_balance,"
    f" UPPER(TRIM(c.customer_name1)) AS same_name, UPPER(TRIM(u.field_val_6)) AS same_tax {CM} {_CIF}"
    f" WHERE c.customer_name1 IS NOT NULL AND {filled('u.field_val_6', 'trim')} AND m.risk_level IS NOT NULL AND {OPEN})"
)
_TWINS = (
    "FROM people c SEMI JOIN (SELECT same_name, same_tax FROM people GROUP BY ALL"
    " HAVING COUNT(DISTINCT customer_no) > 1 AND COUNT(DISTINCT risk_level) > 1) AS g USING (same_name, same_tax)"
)
RULES["7.18"] = {
    "cte": _SAME,
    "count": f"SELECT COUNT(*) AS n {_TWINS}",
    "": top(
        {**WHO, "branch": "c.branch", "tax_id": "c.tax_id", "risk_level": "c.risk_level", "n_accounts": "c.n_accounts",
         "total_balance": "c.total_balance", "same_name": "c.same_name"}, _TWINS,
        ["same_name ASC", "tax_id ASC", "risk_level ASC"], 60, hide=("same_name",)),
}
_MAJ = (
    f"levels AS (SELECT {_PK}, risk_level, COUNT(*) AS n FROM base GROUP BY ALL),"
    f" tops AS (SELECT {_PK}, MAX(n) AS majority_count, SUM(n) AS profile_count, COUNT(*) AS n_levels FROM levels GROUP BY ALL),"
    f" majority AS (SELECT {', '.join(f't.{n}' for n in _PROFILE_COLS)}, MAX(l.risk_level) AS majority_value, t.majority_count,"
    f" CAST(t.profile_count AS BIGINT) AS profile_count FROM tops t JOIN levels l USING ({_PK}) WHERE l.n = t.majority_count"
    " AND t.n_levels > 1 AND 2 * t.majority_count >= t.profile_count GROUP BY ALL)"
)
_MINOR = f"FROM base c JOIN majority g USING ({_PK}) WHERE c.risk_level <> g.majority_value"
RULES["7.19"] = {
    "cte": f"{_BASE}, {_MAJ}",
    "count": f"SELECT COUNT(*) AS n {_MINOR}",
    "": top(
        {**_SHOWN, "majority_value": "g.majority_value", "majority_count": "g.majority_count", "profile_count": "g.profile_count",
         "majority_pct": "CAST(CAST(ROUND(g.majority_count * 100.0 / g.profile_count, 1) AS DECIMAL(18,1)) AS DOUBLE)"},
        _MINOR, _PORDER, 80),
}

# ---- 8 ------------------------------------------------------------------------------------------
_BW = {"customer_no": "c.customer_no", "customer_name": "COALESCE(c.customer_name1, '-')"}
_BC = {"category": "COALESCE(c.customer_category, '-')"}
_BR = {"risk_level": "COALESCE(m.risk_level, '-')"}
_BN = {"nationality": "COALESCE(c.nationality, '-')"}


def _bank(rule: str, where: str, show: dict, body: str = CMX, count_body: str = C) -> None:
    full = f"{where} AND {OPEN}"
    RULES[rule] = {
        "count": f"SELECT COUNT(*) AS n {count_body} WHERE {full}",
        "": top({**_BW, **show, "total_balance": BAL_OPEN}, f"{body} WHERE {full}", RICHEST, 30),
    }


_B = "c.customer_type = 'B'"
_bank("8.1", f"{_B} AND {blank('c.kyc_ref_no', 'trim')}", {**_BC, "swift_code": "COALESCE(c.swift_code, '-')"}, body=C)
_bank("8.2", f"{_B} AND {blank('c.swift_code', 'trim')}", {**_BC, **_BR, **_BN})
_bank(
    "8.3", f"{_B} AND k.kyc_nxt_review_date < {AS_OF}",
    {**_BC, **_BR, "review_date": day("k.kyc_nxt_review_date"), "days_late": f"DATE_SUB('day', k.kyc_nxt_review_date, {AS_OF})"},
    CMKX, CMKX,
)
_bank("8.4", f"{_B} AND {blank('c.cust_classification', 'trim')}", {**_BC, **_BR, **_BN})
_bank("8.5", f"{_B} AND COALESCE(k.annual_turnover, 0) = 0", {**_BC, **_BR, "turnover": cents("COALESCE(k.annual_turnover, 0)")}, CMKX, CMKX)
_bank("8.6", f"{_B} AND COALESCE(c.customer_category, '-') NOT IN {codes(*BANK_CATEGORIES)}", {**_BC, **_BR, **_BN})
_bank("8.7", "c.customer_category = 'BANK' AND c.customer_type <> 'B'", {"customer_type": "COALESCE(c.customer_type, '-')", **_BR, **_BN})
_RATED = (
    f"rated AS (SELECT c.customer_no, COALESCE(c.customer_name1, '-') AS customer_name, c.cust_classification AS classification,"
    f" m.risk_level, c.nationality, {BAL_OPEN} AS total_balance {CM} WHERE {_B} AND c.cust_classification IS NOT NULL"
    f" AND c.nationality IS NOT NULL AND m.risk_level IS NOT NULL AND {OPEN})"
)
_ODD = (
    "FROM rated r WHERE (SELECT COUNT(DISTINCT s.risk_level) FROM rated s WHERE s.nationality = r.nationality"
    " AND s.classification = r.classification) > 1"
)
RULES["8.8"] = {
    "cte": _RATED,
    "count": f"SELECT COUNT(*) AS n {_ODD}",
    "": top(
        {n: f"r.{n}" for n in ("customer_no", "customer_name", "classification", "risk_level", "nationality", "total_balance")},
        _ODD, ["nationality ASC", "classification ASC", "risk_level ASC", "total_balance DESC NULLS FIRST"], 40),
}
_bank("8.9", f"{_B} AND c.aml_required = 'N'", {**_BC, **_BR, **_BN})

_HELD = f"{C} JOIN sttm_cust_account a ON a.cust_no = c.customer_no AND a.record_stat = 'O'"
_FLOW = f"{_HELD} JOIN actb_history h ON h.ac_no = a.cust_ac_no"
_SUMS = {
    "n_txn": "COUNT(h.trn_ref_no)",
    "total_debit": cents("SUM(CASE WHEN h.drcr_ind = 'D' THEN h.lcy_amount ELSE 0 END)"),
    "total_credit": cents("SUM(CASE WHEN h.drcr_ind = 'C' THEN h.lcy_amount ELSE 0 END)"),
    "volume": cents("SUM(h.lcy_amount)"),
}
_YEAR12 = f"h.trn_dt >= {months_back(12)}"


def _flows(where: str, order: str, k: int, extra: dict | None = None) -> str:
    keys = {**_BW, **_BN, **_BR, **(extra or {})}
    body = f"{_FLOW} LEFT JOIN sttm_kyc_master m ON m.kyc_ref_no = c.kyc_ref_no WHERE {_B} AND {where}"
    grouped = ", ".join(f"{e} AS {n}" for n, e in {**keys, **_SUMS}.items())
    inner = f"SELECT {grouped} {body} GROUP BY {', '.join(keys.values())}"
    names = [*keys, *_SUMS]
    return top({n: n for n in names}, f"FROM ({inner}) AS f", [f"{order} DESC NULLS FIRST"], k)


_SWIFT = {"swift_code": "COALESCE(c.swift_code, '-')"}
RULES["8.0"] = {
    "": " UNION ALL ".join(
        f"SELECT {y} AS year, * FROM ({_flows(f'''h.module = 'FT' AND YEAR(h.trn_dt) = {y}''', 'volume', 50, _SWIFT)}) AS y{y}"
        for y in (2024, 2025)
    ),
}
RULES["8.10"] = {"": _flows(_YEAR12, "n_txn", 30)}
_FAR = f"COALESCE(c.nationality, '?') NOT IN {codes(*CEMAC_COUNTRIES)}"
RULES["8.11"] = {
    "count": f"SELECT COUNT(*) AS n FROM (SELECT c.customer_no {_FLOW} WHERE {_B} AND {_FAR} AND {_YEAR12} GROUP BY c.customer_no HAVING SUM(h.lcy_amount) > 0) AS g",
    "": _flows(f"{_FAR} AND {_YEAR12}", "volume", 30),
}
_M6 = f"FROM actb_history h WHERE h.ac_no = a.cust_ac_no AND h.trn_dt >= {months_back(6)}"
_LOW = f"{_HELD} WHERE {_B} AND ABS(a.acy_curr_balance) < 1000 AND (SELECT MAX(h.lcy_amount) {_M6}) > 1000000"
RULES["8.12"] = {
    "count": f"SELECT COUNT(*) AS n {_LOW}",
    "": top(
        {**_BW, "cust_ac_no": "a.cust_ac_no", "balance": cents("a.acy_curr_balance"),
         "max_amount": cents(f"(SELECT MAX(h.lcy_amount) {_M6})"), "n_large": f"(SELECT COUNT(*) {_M6} AND h.lcy_amount > 1000000)"},
        _LOW, ["max_amount DESC NULLS FIRST"], 30),
}


def shares(limit: str) -> dict[str, str]:
    cte = (
        "per_bank AS (SELECT c.customer_no, c.customer_name1 AS customer_name, c.nationality,"
        " SUM(CASE WHEN h.drcr_ind = 'C' THEN h.lcy_amount ELSE 0 END) AS credit"
        f" {_FLOW} WHERE {_B} AND {_YEAR12} GROUP BY ALL), overall AS (SELECT SUM(credit) AS all_credit FROM per_bank)"
    )
    body = f"FROM per_bank b CROSS JOIN overall t WHERE t.all_credit > 0 AND b.credit > t.all_credit * {limit}"
    return {
        "cte": cte,
        "count": f"SELECT COUNT(*) AS n {body}",
        "": top(
            {"customer_no": "b.customer_no", "customer_name": "b.customer_name", "nationality": "COALESCE(b.nationality, '-')",
             "total_credit": cents("b.credit"), "all_credit": cents("t.all_credit"),
             "share_pct": "ROUND(CAST(b.credit AS DOUBLE) * 100 / CAST(t.all_credit AS DOUBLE), 1)"},
            body, ["total_credit DESC NULLS FIRST"], 10),
    }


RULES["8.13"] = shares("0.5")
_FTX = f"h.module IN ('FT', 'FX', 'FS') AND {_YEAR12}"
_MODKEYS = {**_BW, "module": "h.module"}
RULES["8.14"] = {
    "count": f"SELECT COUNT(DISTINCT c.customer_no) AS n {_FLOW} WHERE {_B} AND {_FTX}",
    "": _flows(_FTX, "volume", 30),
    "modules": top(
        {n: n for n in [*_MODKEYS, *_SUMS]},
        f"FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in {**_MODKEYS, **_SUMS}.items())} {_FLOW} WHERE {_B} AND {_FTX}"
        f" GROUP BY {', '.join(_MODKEYS.values())}) AS f", ["volume DESC NULLS FIRST"], 60),
}
_IDLE = f"{_HELD} WHERE {_B} AND NOT EXISTS (FROM actb_history h WHERE h.ac_no = a.cust_ac_no AND {_YEAR12})"
RULES["8.15"] = {
    "count": f"SELECT COUNT(*) AS n {_IDLE}",
    "": top(
        {**_BW, "cust_ac_no": "a.cust_ac_no", **_BC, "opened_on": day("a.ac_open_date"), "balance": cents("a.acy_curr_balance"),
         "size": "ABS(a.acy_curr_balance)"}, _IDLE, ["size DESC NULLS FIRST"], 30, hide=("size",)),
}


def rule_query(rule: str, sample: str = "") -> str:
    spec = RULES[rule]
    return with_tables(spec[sample], spec.get("cte", ""))


def count_query(rules: tuple[str, ...]) -> str:
    """One row per rule, each from its own complete query."""
    rows = []
    for rule in rules:
        spec = RULES[rule]
        if "count" not in spec:
            rows.append(f"SELECT '{rule}' AS rule_id, CAST(NULL AS BIGINT) AS n")
        elif "cte" in spec:
            rows.append(f"SELECT '{rule}' AS rule_id, n FROM (WITH {spec['cte']} {spec['count']}) AS q")
        else:
            rows.append(f"SELECT '{rule}' AS rule_id, n FROM ({spec['count']}) AS q")
    return with_tables(
        "SELECT rule_id, n, CASE WHEN n > 0 THEN 'ANOMALY' WHEN n = 0 THEN 'OK' END AS verdict FROM ("
        + " UNION ALL ".join(rows) + ") AS v"
    )


def with_share(limit: float) -> str:
    """Rule 8.13 at another threshold."""
    spec = shares(str(limit))
    return with_tables(spec[""], spec["cte"])
