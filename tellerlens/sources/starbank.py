"""Banking tables derived from the star-schema test tables.

Every column is a deterministic expression over an input row, written in the SQL subset that
Spark and DuckDB share, so the engine and the SQL checks see exactly the same rows. NULLs,
blanks, padding, orphans, duplicates and contradictions are put in on purpose: the inputs have
none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tellerlens.operators.relations import union_all
from tellerlens.sources.bank import Bank
from tellerlens.sources.schemas import MONEY, SCHEMAS, STAMP, WHOLE

K = "c_custkey"


def _idiv(a: str, n: int) -> str:
    return f"CAST(({a} - {a} % {n}) / {n} AS BIGINT)"


def _txt(a: str) -> str:
    return f"CAST({a} AS STRING)"


def _pick(index: str, *values: str | None) -> str:
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v + chr(39)}" for i, v in enumerate(values)
    )
    return f"CASE {index} {arms} END"


def _yn(test: str) -> str:
    return f"CASE WHEN {test} THEN 'Y' ELSE 'N' END"


def _on(start: str, days: str) -> str:
    return f"CAST(DATE '{start}' + CAST({days} AS INT) AS TIMESTAMP)"


def _cents(a: str) -> str:
    return f"CAST({a} AS DECIMAL(18,2))"


KYC = f"'K' || {_txt(K)}"
NATION = _pick("c_nationkey % 8", "CMR", "GAB", "FRA", "NGA", "IR", "SY", "TCD", None)
COUNTRY = _pick(f"(c_nationkey + {K}) % 8", "CMR", "GAB", "FRA", "NGA", "IR", "SY", "TCD", None)
BIRTH = _on("1940-01-01", f"(37 * {K}) % 29000")
CUST_TYPE = (
    f"CASE WHEN {K} % 97 = 13 THEN NULL WHEN {K} % 25 = 0 THEN 'B' WHEN {K} % 5 = 0 THEN 'C' ELSE 'I' END"
)

CUSTOMER = {
    "customer_no": _txt(K),
    "customer_name1": f"CASE WHEN {K} % 20 < 2 THEN 'Shared#' || {_txt(_idiv(K, 20))} ELSE c_name END",
    "customer_type": CUST_TYPE,
    "customer_category": (
        f"CASE WHEN {K} % 41 = 0 THEN NULL WHEN {K} % 43 = 1 THEN '  '"
        f" WHEN {K} % 25 = 0 THEN {_pick(f'{K} % 3', 'BANK', 'OFI', 'CORP')}"
        f" WHEN {K} % 95 = 5 THEN 'SAL'"
        f" WHEN {K} % 5 = 0 THEN {_pick(f'{K} % 4', 'CORP', 'NGOs', 'REL', 'BANK')}"
        f" WHEN {K} % 37 = 2 THEN 'STAF' WHEN {K} % 37 = 4 THEN 'NRA1' WHEN {K} % 37 = 6 THEN 'NRA2'"
        f" WHEN {K} % 37 = 8 THEN 'GAMING' WHEN {K} % 37 = 10 THEN 'SME'"
        f" ELSE {_pick(f'{K} % 13', 'MINORS', 'STUDENTS', 'SENIORS', 'CSE1', 'CSE2', 'PSE1', 'PSE2', 'PSE3', 'PFBI', 'VPFP', 'SAL', 'PEP/FEPS', 'FOREIGN')} END"
    ),
    "aml_required": f"CASE {K} % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'Y' ELSE NULL END",
    "kyc_details": _pick(f"{K} % 7", "V", "N", None, "V", "P", "V", "V"),
    "kyc_ref_no": (
        f"CASE WHEN {K} % 17 = 0 THEN NULL WHEN {K} % 19 = 0 THEN ' ' WHEN {K} % 23 = 0 THEN 'X' || {_txt(K)}"
        f" WHEN {K} % 101 = 7 THEN 'K' || {_txt(f'({K} - 1)')} ELSE {KYC} END"
    ),
    "frozen": f"CASE WHEN {K} % 43 = 0 THEN 'Y' WHEN {K} % 6 = 1 THEN NULL ELSE 'N' END",
    "deceased": _yn(f"{K} % 53 = 0"),
    "whereabouts_unknown": _yn(f"{K} % 71 = 3"),
    "risk_profile": _pick(f"{K} % 10", "LOW", "LOW", "HIGH", None, " ", "MED", "LOW", None, "MED", "LOW"),
    "country": COUNTRY,
    "nationality": NATION,
    "exposure_country": _pick(f"{K} % 5", "CMR", "FRA", None, "NGA", "GAB"),
    "cust_classification": _pick(f"{K} % 4", "C1", "C2", None, "C3"),
    "cif_status": _pick(f"{K} % 3", "A", "B", None),
    "auth_stat": _pick(f"{K} % 9", "U", *["A"] * 8),
    "record_stat": _pick(f"{K} % 8", "C", *["O"] * 7),
    "staff": f"CASE WHEN {K} % 47 = 0 THEN 'Y' WHEN {K} % 37 = 2 AND {K} % 2 = 0 THEN 'Y' WHEN {K} % 9 = 4 THEN NULL ELSE 'N' END",
    "private_customer": _yn(f"{K} % 15 = 2"),
    "joint_venture": _yn(f"{K} % 77 = 5"),
    "crm_customer": _yn(f"{K} % 3 = 1"),
    "treasury_customer": _yn(f"{K} % 31 = 9"),
    "unique_id_value": (
        f"CASE WHEN {K} % 11 = 0 THEN NULL WHEN {K} % 11 = 1 THEN ' ' ELSE 'U' || {_txt(_idiv(K, 2))} END"
    ),
    "unique_id_name": _pick(f"{K} % 6", "CNI", "NIU", "RCCM", None, "PASS", "CNI"),
    "introducer": f"CASE WHEN {K} % 5 = 3 THEN 'I' || {_txt(f'{K} % 12')} WHEN {K} % 5 = 4 THEN ' ' ELSE NULL END",
    "credit_rating": _pick(f"{K} % 6", "A", "B", "C", None, "A", "D"),
    "local_branch": f"CASE WHEN {K} % 12 = 5 THEN NULL ELSE '00' || {_txt(f'({K} % 5 + 1)')} END",
    "swift_code": f"CASE WHEN {K} % 3 = 0 THEN 'SW' || {_txt(K)} WHEN {K} % 3 = 1 THEN ' ' ELSE NULL END",
    "cif_creation_date": f"CASE WHEN {K} % 59 = 1 THEN NULL ELSE {_on('2015-01-01', f'({K} * 13) % 3300')} END",
}

PERSONAL = {
    "customer_no": _txt(K),
    "p_national_id": (
        f"CASE WHEN {K} % 7 = 1 THEN NULL WHEN {K} % 7 = 2 THEN ' ' WHEN {K} % 40 = 3 THEN 'N-POOL' ELSE 'N' || {_txt(_idiv(K, 3))} END"
    ),
    "passport_no": (
        f"CASE WHEN {K} % 6 = 1 THEN NULL WHEN {K} % 6 = 2 THEN ' ' WHEN {K} % 8 = 0 THEN ' P' || {_txt(_idiv(K, 4))} || ' '"
        f" ELSE 'P' || {_txt(_idiv(K, 4))} END"
    ),
    "e_mail": f"CASE WHEN {K} % 9 = 2 THEN NULL WHEN {K} % 9 = 3 THEN ' ' ELSE 'c' || {_txt(K)} || '@bank.test' END",
    "mobile_number": f"CASE WHEN {K} % 13 = 2 THEN NULL WHEN {K} % 13 = 3 THEN ' ' ELSE '6' || {_txt(f'({K} + 10000000)')} END",
    "telephone": f"CASE WHEN {K} % 3 = 0 THEN '2' || {_txt(f'({K} + 20000000)')} ELSE NULL END",
    "p_address1": f"CASE WHEN {K} % 4 = 1 THEN NULL WHEN {K} % 4 = 2 THEN ' ' ELSE 'Street ' || {_txt(f'{K} % 100')} END",
    "d_address1": f"CASE WHEN {K} % 6 = 1 THEN NULL WHEN {K} % 6 = 2 THEN ' ' ELSE 'Road ' || {_txt(f'{K} % 90')} END",
    "sex": _pick(f"{K} % 3", "M", "F", None),
    "minor": f"CASE WHEN {K} % 13 = 0 AND {K} % 2 = 0 THEN 'Y' WHEN {K} % 29 = 4 THEN 'Y' WHEN {K} % 10 = 9 THEN NULL ELSE 'N' END",
    "resident_status": _pick(f"{K} % 12", "N", "R", "R", None, "R", "R", "R", " ", "R", "R", "R ", "N "),
    "birth_country": _pick(f"{K} % 8", "CMR ", "CMR", "GAB", None, "FRA", " ", "TCD", "NGA"),
    "place_of_birth": f"CASE WHEN {K} % 10 = 4 THEN NULL WHEN {K} % 10 = 5 THEN ' ' WHEN {K} % 8 = 0 THEN '  town ' || {_txt(f'{K} % 40')} ELSE 'Town ' || {_txt(f'{K} % 40')} END",
    "d_country": _pick(f"(c_nationkey + {K}) % 9", "CMR", "GAB", "FRA", "NGA", "IR", "SY", "TCD", None, "CMR"),
    "p_country": _pick(f"{K} % 7", "CMR", "GAB", " ", "FRA", None, "TCD", "CMR"),
    "pa_issued": _pick(f"{K} % 8", "N", "N", "Y", None, "N", " ", "N", "N"),
    "pa_holder_name": f"CASE WHEN {K} % 8 = 2 THEN 'Agent ' || {_txt(f'{K} % 30')} WHEN {K} % 16 = 5 THEN ' ' ELSE NULL END",
    "pa_holder_nationalty": _pick(f"{K} % 3", "CMR", "FRA", None),
    "us_res_status": _pick(f"{K} % 11", "N", "N", "Y", None, "N", "N", " ", "N", "N", "N", "N"),
    "age_proof_submitted": _pick(f"{K} % 4", "Y", "N", None, "Y"),
    "cust_comm_mode": _pick(f"{K} % 4", "M", "E", None, "F"),
    "first_name": f"CASE WHEN {K} % 21 = 2 THEN NULL WHEN {K} % 21 = 3 THEN ' ' ELSE 'First' || {_txt(f'{K} % 50')} END",
    "last_name": f"CASE WHEN {K} % 26 = 2 THEN NULL WHEN {K} % 26 = 3 THEN ' ' ELSE 'Last' || {_txt(f'{K} % 70')} END",
    "date_of_birth": f"CASE WHEN {K} % 46 = 3 THEN NULL WHEN {K} % 33 = 0 THEN {_on('1940-01-02', f'(37 * {K}) % 29000')} ELSE {BIRTH} END",
    "ppt_exp_date": f"CASE WHEN {K} % 5 = 1 THEN NULL ELSE {_on('2022-06-01', f'({K} * 17) % 2000')} END",
}

MASTER = {
    "kyc_ref_no": KYC,
    "kyc_cust_type": (
        f"CASE WHEN {K} % 25 = 0 THEN 'F' WHEN {K} % 5 = 0 THEN 'C' WHEN {K} % 31 = 0 THEN 'C' WHEN {K} % 61 = 7 THEN 'I' ELSE 'R' END"
    ),
    "risk_level": f"CASE WHEN {K} % 73 = 0 THEN NULL ELSE 'Level' || {_txt(f'(1 + ({K} % 7) % 3)')} END",
    "auth_stat": _pick(f"{K} % 11", "U", *["A"] * 10),
    "record_stat": _pick(f"{K} % 13", "C", *["O"] * 12),
    "maker_id": f"CASE WHEN {K} % 61 = 0 THEN 'MIGRATION' ELSE 'U' || {_txt(f'{K} % 9')} END",
    "checker_id": f"CASE WHEN {K} % 61 = 0 THEN 'MIGRATION' WHEN {K} % 30 = 4 THEN NULL ELSE 'U' || {_txt(f'{K} % 7')} END",
    "kyc_desc": f"CASE WHEN {K} % 6 = 0 THEN NULL WHEN {K} % 6 = 1 THEN ' ' ELSE 'File ' || {_txt(K)} END",
    "maker_dt_stamp": f"CASE WHEN {K} % 14 = 3 THEN NULL ELSE {_on('2016-01-01', f'({K} * 7) % 2900')} END",
}

RETAIL = {
    "kyc_ref_no": KYC,
    "pep": _pick(f"{K} % 9", "Y", None, *["N"] * 7),
    "resident": f"CASE WHEN {K} % 11 = 0 THEN 'N' WHEN {K} % 22 = 1 THEN ' ' WHEN {K} % 22 = 3 THEN NULL ELSE 'Y' END",
    "acc_purpose": _pick(f"{K} % 5", "SAVINGS", "SALARY", None, "BUSINESS", "SAVINGS"),
    "us_res_status": _pick(f"{K} % 10", "N", "Y", "N", "N", None, "N", " ", "N", "N", "N"),
    "salary_income": f"CASE WHEN {K} % 4 = 0 THEN NULL WHEN {K} % 4 = 1 THEN '  ' ELSE {_txt(f'({K} % 50 * 10000)')} END",
    "rental_income": f"CASE WHEN {K} % 9 = 1 THEN '250000' WHEN {K} % 9 = 2 THEN ' ' ELSE NULL END",
    "investment_income": f"CASE WHEN {K} % 14 = 1 THEN '90000' ELSE NULL END",
    "business_income": f"CASE WHEN {K} % 6 = 1 THEN '400000' ELSE NULL END",
    "prof_business_income": f"CASE WHEN {K} % 21 = 1 THEN '120000' WHEN {K} % 21 = 2 THEN ' ' ELSE NULL END",
    "overseas_income": f"CASE WHEN {K} % 33 = 1 THEN '700000' ELSE NULL END",
    "othr_income_sources": f"CASE WHEN {K} % 16 = 1 THEN 'family' ELSE NULL END",
    "nationality": _pick(f"(c_nationkey + CASE WHEN {K} % 27 = 1 THEN 1 ELSE 0 END) % 8", "CMR ", "GAB", "FRA", "NGA", "IR", "SY", "TCD", " "),
    "birth_country": _pick(f"{K} % 8", "CMR", "CMR", "GAB", "FRA", "NGA", "CMR", "TCD", None),
    "acc_type": _pick(f"{K} % 3", "S", "C", None),
    "declared": _pick(f"{K} % 4", "Y", "Y", "N", None),
    "pa_given": _pick(f"{K} % 12", "N", "N", "N", None, "N", "N", "N", "N", "N", "N", "Y", "N"),
    "pep_remarks": f"CASE WHEN {K} % 27 = 0 THEN 'minister ' || {_txt(K)} WHEN {K} % 27 = 9 THEN ' ' WHEN {K} % 54 = 18 THEN '   ' ELSE NULL END",
    "kyc_amts_ccy": _pick(f"{K} % 5", "XAF", "XAF", "USD", None, "EUR"),
    "local_addr_country": _pick(f"(c_nationkey + {K}) % 10", "CMR", "GAB", "FRA", "NGA", "IR", "SY", "TCD", None, " ", "FRA"),
    "home_addr_country": _pick(f"{K} % 5", "CMR", "GAB", "FRA", None, "TCD"),
    "passport_no": f"CASE WHEN {K} % 12 = 3 THEN NULL WHEN {K} % 12 = 5 THEN 'Q' || {_txt(K)} ELSE 'P' || {_txt(_idiv(K, 4))} END",
    "birth_place": f"CASE WHEN {K} % 15 = 4 THEN NULL WHEN {K} % 15 = 6 THEN 'TOWN 99' ELSE 'TOWN ' || {_txt(f'{K} % 40')} END",
    "pa_holder_name": f"CASE WHEN {K} % 24 = 2 THEN 'OTHER AGENT' WHEN {K} % 8 = 2 THEN ' AGENT ' || {_txt(f'{K} % 30')} ELSE NULL END",
    "total_income": (
        f"CAST(CASE WHEN {K} % 53 = 1 THEN NULL WHEN {K} % 53 = 2 THEN 100 WHEN {K} % 10 = 3 THEN ({K} % 6) * 4000000"
        f" ELSE ({K} % 13) % 6 * 3000000 END AS DECIMAL(22,3))"
    ),
    "total_net_worth": f"CAST(CASE WHEN {K} % 6 = 1 THEN NULL ELSE ({K} % 40) * 500000 END AS DECIMAL(22,3))",
    "visa_expiry_date": f"CASE WHEN {K} % 4 = 1 THEN {_on('2023-01-01', f'({K} * 5) % 1000')} ELSE NULL END",
    "passport_expiry_date": f"CASE WHEN {K} % 12 = 3 THEN NULL WHEN {K} % 7 = 0 THEN {_on('2022-06-02', f'({K} * 17) % 2000')} ELSE {_on('2022-06-01', f'({K} * 17) % 2000')} END",
    "kyc_nxt_review_date": f"CASE WHEN {K} % 18 = 1 THEN NULL ELSE {_on('2021-01-01', f'({K} * 19) % 1900')} END",
    "birth_date": f"CASE WHEN {K} % 58 = 1 THEN NULL ELSE {BIRTH} END",
}

CORPORATE = {
    "kyc_ref_no": KYC,
    "company_type": _pick(f"{K} % 4", "SA", "SARL", None, "ETS"),
    "funds_source": _pick(f"{K} % 3", "SALES", "LOANS", None),
    "parent_cmpny_country": _pick(f"{K} % 6", "CMR", "FRA", None, "NGA", "CHN", "CMR"),
    "business_nature": _pick(f"{K} % 4", "TRADING GOODS", "FARMING", None, "CONSTRUCTION"),
    "acc_purpose": _pick(f"{K} % 3", "OPERATIONS", None, "PAYROLL"),
    "products_traded": _pick(f"{K} % 4", "COCOA", "OIL", None, "TIMBER"),
    "salary_mode": _pick(f"{K} % 3", "B", "C", None),
    "acc_solicited": _pick(f"{K} % 3", "Y", "N", None),
    "compliance_clearance": _pick(f"{K} % 4", "Y", "Y", "N", None),
    "business_approval": _pick(f"{K} % 5", "Y", "N", "Y", None, "N"),
    "trade_licence_no": f"CASE WHEN {K} % 3 = 0 THEN NULL WHEN {K} % 3 = 1 THEN ' ' ELSE 'TL' || {_txt(K)} END",
    "introducer_dtl": f"CASE WHEN {K} % 4 = 0 THEN 'Intro ' || {_txt(f'{K} % 9')} WHEN {K} % 4 = 1 THEN ' ' ELSE NULL END",
    "local_abroad_brn": _pick(f"{K} % 3", "L", "A", None),
    "group_name": f"CASE WHEN {K} % 4 = 0 THEN 'Group ' || {_txt(f'{K} % 20')} WHEN {K} % 4 = 1 THEN ' ' ELSE NULL END",
    "kyc_amts_ccy": _pick(f"{K} % 3", "XAF", "EUR", None),
    "annual_turnover": f"CAST(CASE WHEN {K} % 15 = 0 THEN NULL ELSE ({K} % 4) * 1000000 END AS DECIMAL(22,3))",
    "kyc_nxt_review_date": f"CASE WHEN {K} % 12 = 0 THEN NULL ELSE {_on('2022-01-01', f'({K} * 11) % 1500')} END",
    "audit_date": f"CASE WHEN {K} % 6 = 0 THEN NULL ELSE {_on('2022-01-01', f'({K} * 3) % 800')} END",
    "employee_number": f"CAST(CASE WHEN {K} % 10 = 5 THEN NULL ELSE {K} % 40 END AS BIGINT)",
}

_ORDER_CUST = f"CASE WHEN o_orderkey % 211 = 0 THEN 'Z' || {_txt('o_custkey')} ELSE {_txt('o_custkey')} END"


def _account(key: str, no: str, owner: str, balance: str, status: str, opened: str, last_cr: str, last_dr: str) -> dict:
    return {
        "cust_ac_no": no,
        "cust_no": owner,
        "ccy": _pick(f"{key} % 7", "XAF", "XAF", "XAF ", "EUR", "USD", None, "XAF"),
        "account_class": f"'CL' || {_txt(f'({key} % 25)')}",
        "ac_stat_dormant": _yn(f"{key} % 19 = 0"),
        "ac_stat_frozen": f"CASE WHEN {key} % 43 = 0 AND {key} % 2 = 0 THEN 'Y' WHEN {key} % 67 = 1 THEN NULL ELSE 'N' END",
        "ac_stat_no_dr": _yn(f"{key} % 31 = 0"),
        "ac_stat_no_cr": _yn(f"{key} % 37 = 0"),
        "ac_stat_stop_pay": _yn(f"{key} % 41 = 0"),
        "ac_stat_block": f"CASE WHEN {key} % 47 = 0 THEN 'Y' WHEN {key} % 71 = 2 THEN NULL ELSE 'N' END",
        "nsf_blacklist_status": _yn(f"{key} % 91 = 0"),
        "branch_code": f"'00' || {_txt(f'({key} % 5 + 1)')}",
        "account_type": _pick(f"{key} % 4", "S", "U", "S", None),
        "mode_of_operation": _pick(f"{key} % 3", "S", "J", None),
        "joint_ac_indicator": _pick(f"{key} % 5", "S", "S", "J", None, "S"),
        "salary_account": _yn(f"{key} % 6 = 1"),
        "auth_stat": _pick(f"{key} % 10", "U", *["A"] * 9),
        "record_stat": status,
        "ac_desc": f"'Account ' || {_txt(f'{key} % 100')}",
        "acy_curr_balance": f"CASE WHEN {key} % 71 = 0 THEN NULL ELSE {_cents(balance)} END",
        "acy_today_tover_dr": f"CAST({key} % 17 * 100 AS DECIMAL(18,2))",
        "acy_today_tover_cr": f"CAST({key} % 13 * 150 AS DECIMAL(18,2))",
        "acy_mtd_tover_dr": f"CAST({key} % 170 * 1000 AS DECIMAL(18,2))",
        "acy_mtd_tover_cr": f"CASE WHEN {key} % 9 = 0 THEN NULL ELSE CAST({key} % 130 * 1500 AS DECIMAL(18,2)) END",
        "overdraft_since": f"CASE WHEN {key} % 23 = 0 THEN {_on('2023-03-01', f'{key} % 300')} ELSE NULL END",
        "ac_open_date": opened,
        "date_last_cr_activity": last_cr,
        "date_last_dr_activity": last_dr,
        "dormancy_date": f"CASE WHEN {key} % 19 = 0 THEN {_on('2022-01-01', f'{key} % 500')} ELSE NULL END",
    }


_ORDER_ACCOUNT = _account(
    "o_orderkey", f"'A' || {_txt('o_orderkey')}", _ORDER_CUST, "o_totalprice",
    "CASE WHEN o_orderstatus = 'F' THEN 'C' ELSE 'O' END", "o_orderdate",
    f"CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN {_on('2023-04-10', 'o_orderkey % 11')} ELSE {_on('2022-09-01', 'o_orderkey % 400')} END",
    f"CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE {_on('2022-10-01', 'o_orderkey % 500')} END",
)
_BASE_ACCOUNT = _account(
    K, f"'E' || {_txt(K)}", _txt(K), "c_acctbal", f"CASE WHEN {K} % 12 = 0 THEN 'C' ELSE 'O' END",
    f"CASE WHEN {K} % 38 = 1 THEN NULL ELSE {_on('2014-01-01', f'({K} * 29) % 3500')} END",
    f"CASE {K} % 3 WHEN 0 THEN NULL WHEN 1 THEN {_on('2023-01-15', '0')} ELSE {_on('2024-01-10', '0')} END",
    f"CASE {K} % 5 WHEN 0 THEN NULL WHEN 1 THEN {_on('2022-11-05', '0')} ELSE {_on('2023-02-20', '0')} END",
)


def _mirror(account: dict, key: str) -> dict:
    flip = lambda col, n: f"CASE WHEN {key} % {n} = 0 THEN CASE WHEN ({account[col]}) = 'Y' THEN 'N' ELSE 'Y' END ELSE {account[col]} END"
    return {
        "ac_gl_no": account["cust_ac_no"],
        "branch_code": f"CASE WHEN {key} % 73 = 5 THEN '999' ELSE {account['branch_code']} END",
        "cust_no": account["cust_no"],
        "pkey": account["cust_ac_no"],
        "ac_stat_dormant": flip("ac_stat_dormant", 97),
        "ac_stat_frozen": flip("ac_stat_frozen", 101),
        "gl_stat_blocked": flip("ac_stat_block", 103),
        "ac_stat_no_dr": flip("ac_stat_no_dr", 107),
        "ac_stat_no_cr": flip("ac_stat_no_cr", 109),
        "ac_stat_stop_pay": flip("ac_stat_stop_pay", 113),
        "ac_or_gl": _pick(f"{key} % 8", "G", *["A"] * 7),
        "gl_category": _pick(f"{key} % 5", "1", "2", "3", None, "4"),
        "auth_stat": account["auth_stat"],
        "ac_gl_rec_status": f"CASE WHEN {key} % 127 = 0 THEN 'X' ELSE {account['record_stat']} END",
        "ac_gl_ccy": f"CASE WHEN {key} % 131 = 0 THEN 'GBP' ELSE {account['ccy']} END",
        "gl_aclass_type": _pick(f"{key} % 3", "S", "U", None),
    }


_KEYPERSON = {
    "kyc_ref_no": f"'K' || {_txt('(5 * (s_suppkey % 40))')}",
    "relationship": _pick("s_suppkey % 4", "DIRECTOR", "OWNER", None, "SIGNATORY"),
    "nationality": _pick("s_nationkey % 5", "CMR", "FRA", "NGA", None, "CHN"),
    "address_country": _pick("s_nationkey % 4", "CMR", "FRA", "GAB", None),
    "tin": f"CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN ' ' ELSE 'TIN' || {_txt('s_suppkey')} END",
    "share_holding": "CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 60 END AS DECIMAL(22,3))",
}

_EVENT_AMOUNT = (
    "CASE WHEN event_id % 997 = 3 THEN NULL WHEN event_id % 10 = 0 THEN CAST(1000000 * (1 + event_id % 7) AS DECIMAL(18,2))"
    f" ELSE CAST({_cents('value')} * 100000 AS DECIMAL(18,2)) END"
)
_EVENT_TXN = {
    "trn_ref_no": f"CASE WHEN event_id % 1009 = 7 THEN NULL ELSE 'V' || {_txt('event_id')} END",
    "ac_no": f"'E' || {_txt('user_id')}",
    "drcr_ind": "CASE WHEN event_id % 499 = 5 THEN NULL WHEN event_type IN ('purchase', 'view') THEN 'D' ELSE 'C' END",
    "ac_ccy": _pick("event_id % 6", "XAF", "XAF", "EUR", "USD", "XAF", None),
    "trn_code": _pick("event_id % 4", "CASH", "CDEP", "SWIFT", "POSX"),
    "module": _pick("event_id % 4", "FT", "FX", "FS", "DE"),
    "product": _pick("event_id % 9", "P1", "P2", "P3", None, "P4", "P5", "P1", "P2", "P6"),
    "ac_branch": f"'00' || {_txt('(event_id % 6 + 1)')}",
    "type": _pick("event_id % 3", "A", "B", None),
    "category": _pick("event_id % 5", "1", "2", None, "3", "1"),
    "cust_gl": _pick("event_id % 7", "G", *["A"] * 6),
    "aml_exception": _pick("event_id % 50", "Y", None, *["N"] * 48),
    "user_id": f"'OP' || {_txt('(event_id % 23)')}",
    "event": _pick("event_id % 4", "INIT", "LIQD", None, "BOOK"),
    "related_account": f"CASE WHEN event_id % 8 = 0 THEN 'E' || {_txt('(user_id + 1)')} WHEN event_id % 8 = 1 THEN ' ' ELSE NULL END",
    "related_customer": f"CASE WHEN event_id % 6 = 0 THEN {_txt('((7 * user_id + event_id) % 1500)')} WHEN event_id % 6 = 1 THEN ' ' ELSE NULL END",
    "lcy_amount": _EVENT_AMOUNT,
    "fcy_amount": f"CASE WHEN event_id % 11 = 2 THEN NULL WHEN event_id % 6 IN (2, 3) THEN CAST({_cents('value')} * 150 AS DECIMAL(18,2)) ELSE {_EVENT_AMOUNT} END",
    "exch_rate": "CAST(CASE event_id % 6 WHEN 2 THEN 655.957 WHEN 3 THEN 600.5 WHEN 5 THEN NULL WHEN 4 THEN 0 ELSE 1 END AS DECIMAL(22,3))",
    "trn_dt": "ts",
}
_LINE_TXN = {
    "trn_ref_no": f"'L' || {_txt('l_orderkey')} || '-' || {_txt('l_linenumber')}",
    "ac_no": f"'A' || {_txt('l_orderkey')}",
    "drcr_ind": "CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'C' END",
    "ac_ccy": "'XAF'",
    "trn_code": "l_linestatus || l_returnflag",
    "module": _pick("l_partkey % 4", "FT", "FX", "FS", "DE"),
    "product": f"'P' || {_txt('(l_partkey % 12)')}",
    "ac_branch": f"'00' || {_txt('(l_suppkey % 6 + 1)')}",
    "type": "'A'",
    "category": "'1'",
    "cust_gl": "'A'",
    "aml_exception": "'N'",
    "user_id": f"'OP' || {_txt('(l_suppkey % 23)')}",
    "event": "'INIT'",
    "lcy_amount": _cents("l_extendedprice"),
    "fcy_amount": _cents("l_extendedprice"),
    "exch_rate": "CAST(1 AS DECIMAL(22,3))",
    "trn_dt": "l_shipdate",
}


def _fields(function: str, key: str, **fields: str) -> dict:
    return {"function_id": f"'{function}'", "rec_key": key, **fields}


def _numbered(prefix: str, key: str, count: int, skip: int) -> dict:
    return {
        f"field_val_{i}": f"CASE WHEN ({key} + {i}) % {skip} = 0 THEN NULL ELSE '{prefix}{i}-' || {_txt(f'({key} % {i + 3})')} END"
        for i in range(1, count + 1)
    }


_USER_FIELDS = [
    ("customer", "TRUE", _fields(
        "STDCIF", f"CASE WHEN {K} % 67 = 0 THEN {_txt(K)} ELSE {_txt(K)} || '~' END",
        **{**_numbered("S", K, 31, 6),
           "field_val_1": f"CASE WHEN {K} % 9 = 5 THEN NULL ELSE 'P' || {_txt(f'{K} % 2')} END",
           "field_val_6": f"CASE WHEN {K} % 20 < 2 THEN CASE WHEN {K} % 20 = 1 THEN 't' ELSE ' T' END || {_txt(_idiv(K, 20))} WHEN {K} % 20 = 2 THEN ' ' ELSE NULL END",
           "field_val_18": f"CASE WHEN {K} % 21 = 0 THEN 'y ' WHEN {K} % 43 = 0 THEN 'Y' ELSE 'N' END"})),
    ("customer", f"{K} % 6 <> 1", _fields(
        "STDKYCMN", f"{KYC} || '~'",
        **{**_numbered("Q", K, 8, 5),
           "field_val_1": f"CASE WHEN {K} % 18 = 0 THEN ' y' WHEN {K} % 14 = 2 THEN 'Y' WHEN {K} % 9 = 3 THEN NULL ELSE 'N' END"})),
    ("orders", "o_orderkey % 3 = 0", _fields(
        "STDCUSAC",
        f"CASE WHEN o_orderkey % 83 = 0 THEN '001~Q' || {_txt('o_orderkey')} || '~' WHEN o_orderkey % 89 = 1 THEN '001~A' || {_txt('o_orderkey')}"
        f" ELSE '001~A' || {_txt('o_orderkey')} || '~' END",
        **_numbered("R", "o_orderkey", 11, 4))),
    ("orders", "o_orderkey % 50 = 1", _fields(
        "STDSTCHN", f"'A' || {_txt('o_orderkey')} || '~00' || {_txt('(o_orderkey % 5 + 1)')} || '~' || {_txt('(20200101 + o_orderkey % 28)')} || '~'",
        **_numbered("H", "o_orderkey", 3, 4))),
    ("part", "TRUE", _fields("GEDCOLLT", f"'COL' || {_txt('p_partkey')} || '~'", **_numbered("C", "p_partkey", 19, 6))),
    ("part", "p_partkey % 4 = 0", _fields(
        "GEDFACLT", f"CASE WHEN p_partkey % 40 = 0 THEN 'FAC' || {_txt('p_partkey')} ELSE 'FAC' || {_txt('p_partkey')} || '~X~' END",
        **_numbered("F", "p_partkey", 2, 5))),
    ("supplier", "TRUE", _fields("GEDMLIAB", f"'LIA' || {_txt('s_suppkey')} || '~'", **_numbered("L", "s_suppkey", 2, 4))),
    ("supplier", "TRUE", _fields(
        "SMDUSRDF", f"'USR' || {_txt('s_suppkey')} || '~'",
        field_val_1=f"CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN '  ' ELSE 'u' || {_txt('s_suppkey')} || '@bank.test' END",
        field_val_2=f"'ST' || {_txt('s_suppkey')}")),
    ("nation", "TRUE", _fields("GLDCHACC", f"'GL' || {_txt('n_nationkey')} || '~'", **_numbered("G", "n_nationkey", 1, 4))),
    ("nation", "TRUE", _fields("SMDROLDF", f"'ROLE' || {_txt('n_nationkey')} || '~'", **_numbered("O", "n_nationkey", 2, 4))),
    ("nation", "TRUE", _fields("STDBRANC", f"'0' || {_txt('n_nationkey')} || '~'", **_numbered("B", "n_nationkey", 1, 4))),
    ("region", "TRUE", _fields("STDACCLS", f"'CL' || {_txt('r_regionkey')} || '~'", **_numbered("A", "r_regionkey", 1, 4))),
]

_CLASS = {
    "account_class": f"'CL' || {_txt('n_nationkey')}",
    "ac_class_type": _pick("n_nationkey % 3", "S", "U", None),
    "overdraft_facility": _yn("n_nationkey % 3 = 0"),
    "cheque_book_facility": _yn("n_nationkey % 4 = 0"),
    "atm_facility": _yn("n_nationkey % 2 = 0"),
    "passbook_facility": _yn("n_nationkey % 5 = 0"),
    "dormancy": _pick("n_nationkey % 3", "Y", "N", None),
    "auth_stat": _pick("n_nationkey % 6", "U", *["A"] * 5),
    "description": "'Class ' || n_name",
}
_CATEGORY = {
    "cust_cat": _pick(
        "n_nationkey", "MINORS", "STUDENTS", "SENIORS", "CSE1", "CSE2", "PSE1", "PSE2", "PSE3", "PFBI", "VPFP",
        "SAL", "PEP/FEPS", "FOREIGN", "STAF", "NRA1", "NRA2", "GAMING", "BANK", "CORP", "NGOs", "REL", "BDC",
        "WALKIN", "FIN_INT", "INDV"),
    "cust_cat_desc": "CASE WHEN n_nationkey % 8 = 3 THEN NULL ELSE 'Category ' || n_name END",
    "auth_stat": _pick("n_nationkey % 7", "U", *["A"] * 6),
}
_ALERT = {
    "sir_status": _pick("event_id % 6", "OPEN", "CLOSED", "FILED", "REJECTED", None, "REVIEW"),
    "sir_date": "ts",
    "close_date": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) + CAST(event_id % 40 AS INT) AS TIMESTAMP) END",
}

# table -> parts; a part is (input table, row condition, column -> expression)
PARTS: dict[str, list[tuple[str, str, dict[str, str]]]] = {
    "sttm_customer": [("customer", "TRUE", CUSTOMER)],
    "sttm_cust_personal": [("customer", f"{K} % 5 <> 0 AND {K} % 59 <> 0", PERSONAL)],
    "sttm_cust_account": [
        ("orders", "o_custkey % 30 <> 7", _ORDER_ACCOUNT),
        ("customer", f"{K} % 30 <> 7", _BASE_ACCOUNT),
    ],
    "sttb_account": [
        ("orders", "o_custkey % 30 <> 7 AND o_orderkey % 89 <> 0", _mirror(_ORDER_ACCOUNT, "o_orderkey")),
        ("customer", f"{K} % 30 <> 7 AND {K} % 83 <> 0", _mirror(_BASE_ACCOUNT, K)),
    ],
    "sttm_kyc_master": [("customer", f"{K} % 79 <> 6", MASTER)],
    "sttm_kyc_retail": [("customer", f"{K} % 5 <> 0 AND {K} % 37 <> 0", RETAIL)],
    "sttm_kyc_corporate": [("customer", f"{K} % 5 = 0 AND {K} % 35 <> 0", CORPORATE)],
    "sttm_kyc_corp_keypersons": [("supplier", "TRUE", _KEYPERSON)],
    "actb_history": [("events", "TRUE", _EVENT_TXN), ("lineitem", "TRUE", _LINE_TXN)],
    "sttm_account_class": [("nation", "TRUE", _CLASS)],
    "sttm_customer_cat": [("nation", "TRUE", _CATEGORY)],
    "cstm_function_userdef_fields": _USER_FIELDS,
    "aaml_sir_details": [("events", "event_type = 'error'", _ALERT)],
}

# Declared columns of the input tables: no file is opened to infer them.
INPUTS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}

_SQL_TYPES = {MONEY: "DECIMAL(22,3)", STAMP: "TIMESTAMP", WHOLE: "BIGINT"}


def select_list(table: str, exprs: dict[str, str]) -> list[str]:
    """One cast expression per declared column, in declared order."""
    out = []
    for field in SCHEMAS[table].fields:
        kind = _SQL_TYPES.get(field.dataType, "STRING")
        expr = exprs.get(field.name, "NULL")
        plain = expr.isidentifier()
        typed = expr if (plain and kind == "TIMESTAMP") or (kind == "STRING" and expr != "NULL") else f"CAST({expr} AS {kind})"
        out.append(f"{typed} AS {field.name}")
    return out


def _derive(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    parts = [
        spark.read.schema(INPUTS[source]).parquet(f"{sf_dir.rstrip('/')}/{source}.parquet")
        .where(condition)
        .selectExpr(*[e.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)") for e in select_list(table, exprs)])
        for source, condition, exprs in PARTS[table]
    ]
    return union_all(parts)


def star_bank(spark: SparkSession, sf_dir: str) -> Bank:
    return Bank(spark, {t: (lambda t=t: _derive(spark, sf_dir, t)) for t in PARTS})
