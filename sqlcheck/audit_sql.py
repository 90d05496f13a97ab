"""DuckDB form of the audit checks: metric rows and samples."""

from __future__ import annotations

from sqlcheck.coherence_sql import C, CM, CMR, CP, CPR, CR, OPEN
from sqlcheck.prelude import AS_OF, birthday, blank, cents, codes, day, days_back, filled, months_back, top, with_tables
from tellerlens.params import CASH_CODES, RISK_COUNTRIES, SENSITIVE_CATEGORIES, TRANSFER_CODES

CHECKS: dict[str, dict] = {}
P = "FROM sttm_cust_personal p"
P_OPEN = "p.customer_no IN (SELECT cust_no FROM acct_open)"
R = "FROM sttm_kyc_retail r"
O = "LEFT JOIN acct_open o ON o.cust_no = c.customer_no"
HAS_O = "o.cust_no IS NOT NULL"
LATE_24, LATE_12 = months_back(24), months_back(12)


def count(metric: str, body: str, where: str = "TRUE", total: str | None = None) -> str:
    """Metric row of a filtered count; ``total`` is a scalar query."""
    n = f"(SELECT COUNT(*) {body} WHERE {where})"
    return scalar(metric, n, total=total)


def scalar(metric: str, n: str, amount: str = "NULL", total: str | None = None) -> str:
    pct = f"CAST(CAST(ROUND({n} * 100.0 / NULLIF({total}, 0), 1) AS DECIMAL(18,1)) AS DOUBLE)" if total else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{metric}' AS metric, CAST(NULL AS VARCHAR) AS grp, CAST({n} AS BIGINT) AS n,"
        f" CAST({amount} AS DOUBLE) AS amount, CAST({total or 'NULL'} AS BIGINT) AS total, {pct} AS pct"
    )


def grouped(metric: str, group: str, body: str, amount: str = "NULL", tail: str = "") -> str:
    return (
        f"SELECT '{metric}' AS metric, CAST(g AS VARCHAR) AS grp, n, CAST(amount AS DOUBLE) AS amount,"
        " CAST(NULL AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS pct FROM"
        f" (SELECT {group} AS g, COUNT(*) AS n, {amount} AS amount {body} GROUP BY 1 {tail})"
    )


def check(check_id: str, metrics: list[str], cte: str = "", **samples: str) -> None:
    rows = " UNION ALL ".join(f"SELECT * FROM ({m}) AS m{i}" for i, m in enumerate(metrics))
    spec = {"cte": cte, **{name.replace("sample", ""): sql for name, sql in samples.items()}}
    if metrics:
        spec["metrics"] = f"SELECT '{check_id}' AS check_id, * FROM ({rows}) AS rows_"
    CHECKS[check_id] = spec


CLIENT = {
    "customer_no": "c.customer_no", "customer_name": "c.customer_name1", "customer_type": "c.customer_type",
    "customer_category": "c.customer_category", "n_accounts": "o.n", "balance": cents("o.bal"),
    "last_activity": day("o.last_act"), "first_opened": day("o.first_open"),
}
RICH = ["balance DESC NULLS FIRST"]
_all = lambda table: f"(SELECT COUNT(*) FROM {table})"


def clients(body: str, where: str, k: int, columns: dict | None = None, inner: bool = True) -> str:
    join = O.replace("LEFT JOIN", "JOIN") if inner else O
    return top(columns or CLIENT, f"{body} {join} WHERE {where}", RICH, k)


check("AML-000", [count("clients", C), count("accounts", "FROM sttm_cust_account"), count("transactions", "FROM actb_history")])

_B = blank("c.kyc_ref_no")
check(
    "AML-101",
    [
        count("clients_without_kyc", C, _B, _all("sttm_customer")),
        count("without_kyc_with_open_account", C, f"{_B} AND {OPEN}"),
        count("without_kyc_without_open_account", C, f"{_B} AND NOT {OPEN}"),
    ],
    sample=clients(C, _B, 20),
)
_U = "COALESCE(c.kyc_details, '-') <> 'V'"
_NEW = f"c.cif_creation_date >= {LATE_12}"
check(
    "AML-102",
    [
        count("clients_unverified", C, _U, _all("sttm_customer")),
        count("unverified_with_open_account", C, f"{_U} AND {OPEN}"),
        count("recent_unverified_with_open_account", C, f"{_U} AND {_NEW} AND {OPEN}"),
        grouped("clients_by_kyc_status", "kyc_details", C),
    ],
    sample=clients(C, f"{_U} AND {_NEW}", 15),
)
_DUE = "kyc_nxt_review_date"
_L3 = f"m.risk_level = 'Level3' AND r.{_DUE} < {AS_OF}"
check(
    "AML-103",
    [
        count("retail_overdue", R, f"{_DUE} < {AS_OF}"),
        count("corporate_overdue", "FROM sttm_kyc_corporate", f"{_DUE} < {AS_OF}"),
        count("retail_overdue_over_24_months", R, f"{_DUE} < {LATE_24}"),
        count("retail_overdue_12_to_24_months", R, f"{_DUE} < {LATE_12} AND {_DUE} >= {LATE_24}"),
        count("retail_overdue_under_12_months", R, f"{_DUE} < {AS_OF} AND {_DUE} >= {LATE_12}"),
        count("high_risk_overdue_with_open_account", CMR, f"{_L3} AND {OPEN}"),
    ],
    sample=clients(CMR, _L3, 20),
)
_NOID = f"{blank('p.p_national_id')} AND {blank('p.passport_no')}"
_ALLP = _all("sttm_cust_personal")
check(
    "AML-104",
    [
        count("without_birth_date", P, "p.date_of_birth IS NULL", _ALLP),
        count("without_identity_document", P, _NOID, _ALLP),
        count("without_full_name", P, f"{blank('p.first_name')} OR {blank('p.last_name')}", _ALLP),
        count("without_address", P, f"{blank('p.p_address1')} AND {blank('p.d_address1')}", _ALLP),
        count("without_telephone", P, f"{blank('p.mobile_number')} AND {blank('p.telephone')}", _ALLP),
        count("without_birth_country_and_place", P, f"{blank('p.birth_country')} AND {blank('p.place_of_birth')}", _ALLP),
        count("without_identity_with_open_account", P, f"{_NOID} AND {P_OPEN}"),
    ],
    sample=clients(CP, _NOID, 15),
)
_CPRX = f"{C} LEFT JOIN sttm_cust_personal p ON p.customer_no = c.customer_no LEFT JOIN sttm_kyc_retail r ON r.kyc_ref_no = c.kyc_ref_no"
check(
    "AML-105",
    [
        count("expired_passports_personal", P, f"p.ppt_exp_date < {AS_OF}"),
        count("expired_passports_kyc", R, f"r.passport_expiry_date < {AS_OF}"),
        count("expired_visas", R, f"r.visa_expiry_date < {AS_OF}"),
    ],
    sample=clients(
        _CPRX, f"(p.ppt_exp_date < {AS_OF} OR r.passport_expiry_date < {AS_OF})", 15,
        {"customer_no": "c.customer_no", "customer_name": "c.customer_name1", "passport_no": "COALESCE(p.passport_no, r.passport_no)",
         "expiry_date": day("LEAST(p.ppt_exp_date, r.passport_expiry_date)"), "n_accounts": "o.n", "balance": cents("o.bal")}),
)
_NR = blank("c.risk_profile")
check(
    "AML-106",
    [
        count("clients_without_risk_profile", C, _NR, _all("sttm_customer")),
        grouped("files_by_risk_level", "risk_level", "FROM sttm_kyc_master"),
        count("clients_without_any_risk", C, f"{_NR} AND NOT EXISTS (FROM sttm_kyc_master m WHERE m.kyc_ref_no = c.kyc_ref_no)"),
    ],
)
_ACTIVE = f"a.record_stat = 'O' AND (a.date_last_cr_activity >= {LATE_12} OR a.date_last_dr_activity >= {LATE_12})"
check(
    "AML-107",
    [scalar("active_accounts_without_kyc",
            f"(SELECT COUNT(DISTINCT a.cust_ac_no) FROM sttm_cust_account a JOIN sttm_customer c ON c.customer_no = a.cust_no WHERE {_ACTIVE} AND {_B})")],
    cte=(
        "in_use AS (SELECT a.cust_no, COUNT(*) AS n, SUM(a.acy_curr_balance) AS bal,"
        " GREATEST(MAX(a.date_last_cr_activity), MAX(a.date_last_dr_activity)) AS last_act, MIN(a.ac_open_date) AS first_open"
        f" FROM sttm_cust_account a WHERE {_ACTIVE} GROUP BY a.cust_no)"
    ),
    sample=top(CLIENT, f"{C} JOIN in_use o ON o.cust_no = c.customer_no WHERE {_B}", RICH, 20),
)

_PEP = "r.pep = 'Y'"
check(
    "AML-201",
    [count("exposed_persons", R, _PEP, _all("sttm_kyc_retail")), count("exposed_persons_with_open_account", CR, f"{_PEP} AND {OPEN}")],
    sample=clients(
        CR, _PEP, 25,
        {"customer_no": "c.customer_no", "customer_name": "c.customer_name1", "customer_category": "c.customer_category",
         "nationality": "r.nationality", "n_accounts": "o.n", "balance": cents("o.bal"), "last_activity": day("o.last_act"),
         "documented": f"CASE WHEN {filled('r.pep_remarks')} THEN 'Y' ELSE 'N' END"}),
)
_MUTE = f"{_PEP} AND {blank('r.pep_remarks')}"
_LOOSE = {**CLIENT, "n_accounts": "COALESCE(o.n, 0)", "balance": cents("COALESCE(o.bal, 0)")}
check("AML-202", [count("exposed_without_remarks", R, _MUTE)], sample=clients(CR, _MUTE, 20, _LOOSE, inner=False))
_HR = "m.risk_level = 'Level3'"
check(
    "AML-203",
    [
        count("high_risk_files", "FROM sttm_kyc_master m", _HR),
        count("high_risk_with_open_account", CM, f"{_HR} AND {OPEN}"),
        grouped("high_risk_by_type", "kyc_cust_type", f"FROM sttm_kyc_master m WHERE {_HR}"),
    ],
    sample=clients(CM, _HR, 20),
)
_AWAY = "r.resident = 'N'"
check(
    "AML-204",
    [
        count("non_residents_kyc", R, _AWAY),
        count("non_residents_personal", P, "p.resident_status = 'N'"),
        count("non_residents_with_open_account", CR, f"{_AWAY} AND {OPEN}"),
        grouped("non_residents_by_nationality", "nationality", f"{R} WHERE {_AWAY} AND {filled('r.nationality')}", tail="ORDER BY n DESC, g LIMIT 10"),
    ],
    sample=clients(CR, _AWAY, 15),
)
_POA = "p.pa_issued = 'Y'"
check(
    "AML-205",
    [
        count("attorney_given_kyc", R, "r.pa_given = 'Y'"),
        count("attorney_issued_personal", P, _POA),
        count("attorney_issued_with_open_account", P, f"{_POA} AND {P_OPEN}"),
    ],
    sample=clients(
        CP, _POA, 20,
        {"customer_no": "c.customer_no", "customer_name": "c.customer_name1", "holder_name": "p.pa_holder_name",
         "holder_nationality": "p.pa_holder_nationalty", "n_accounts": "o.n", "balance": cents("o.bal"), "last_activity": day("o.last_act")}),
)
check(
    "AML-206", [],
    sample=top(
        {"cust_cat": "t.cust_cat", "cust_cat_desc": "t.cust_cat_desc",
         "n_clients": "(SELECT COUNT(*) FROM sttm_customer c WHERE c.customer_category = t.cust_cat)",
         "n_with_open_account": f"(SELECT COUNT(*) FROM sttm_customer c WHERE c.customer_category = t.cust_cat AND {OPEN})"},
        f"FROM sttm_customer_cat t WHERE t.cust_cat IN {codes(*SENSITIVE_CATEGORIES)}", ["n_clients DESC"], 15),
)


def _shared(check_id: str, table: str, body: str, key: str, show: dict) -> None:
    name = key.split(".")[1]
    dup = f"SELECT {name} FROM {table} WHERE {filled(name)} GROUP BY 1 HAVING COUNT(*) > 1"
    check(
        check_id,
        [scalar("shared_values", f"(SELECT COUNT(*) FROM ({dup}) AS d)"), count("clients_involved", f"FROM {table}", f"{name} IN ({dup})")],
        sample=top({name: key, **show}, f"{body} {O} WHERE {key} IN ({dup})", [f"{name} ASC NULLS LAST", "balance DESC NULLS FIRST"], 20),
    )


_SHOW = {
    "customer_no": "c.customer_no", "customer_name": "c.customer_name1", "n_accounts": "COALESCE(o.n, 0)",
    "balance": cents("COALESCE(o.bal, 0)"),
}
_shared("AML-301", "sttm_cust_personal", CP, "p.p_national_id", {**_SHOW, "customer_type": "c.customer_type", "last_activity": day("o.last_act")})
_shared("AML-302", "sttm_customer", C, "c.unique_id_value", {**_SHOW, "unique_id_name": "c.unique_id_name"})
_PPT = lambda t: f"(SELECT COUNT(*) FROM (SELECT passport_no FROM {t} WHERE {filled('passport_no')} GROUP BY 1 HAVING COUNT(*) > 1) AS d)"
check("AML-303", [scalar("shared_passports_personal", _PPT("sttm_cust_personal")), scalar("shared_passports_kyc", _PPT("sttm_kyc_retail"))])
_CPX = f"{C} LEFT JOIN sttm_cust_personal p ON p.customer_no = c.customer_no"
_ANON = f"c.customer_type = 'I' AND {blank('c.unique_id_value')} AND {_NOID}"
check(
    "AML-304",
    [
        count("individuals_unidentified", _CPX, _ANON, "(SELECT COUNT(*) FROM sttm_customer WHERE customer_type = 'I')"),
        count("unidentified_with_open_account", _CPX, f"{_ANON} AND {OPEN}"),
    ],
    sample=clients(_CPX, _ANON, 15),
)
_DOB = "p.date_of_birth <> r.birth_date"
check(
    "AML-305", [count("birth_date_mismatches", CPR, _DOB)],
    sample=clients(
        CPR, _DOB, 15, {**{n: _SHOW[n] for n in ("customer_no", "customer_name")}, "birth_date_personal": day("p.date_of_birth"),
                        "birth_date_kyc": day("r.birth_date"), "n_accounts": _SHOW["n_accounts"], "balance": _SHOW["balance"]}, inner=False),
)
_KID = f"p.date_of_birth > {birthday(18)}"
check(
    "AML-306",
    [
        count("minors_by_flag", P, "p.minor = 'Y'"), count("minors_by_age", P, _KID),
        count("minors_with_open_account", P, f"(p.minor = 'Y' OR {_KID}) AND {P_OPEN}"),
    ],
    sample=clients(CP, f"(p.minor = 'Y' OR {_KID})", 15),
)

H = "FROM actb_history h"
HA = f"{H} JOIN sttm_cust_account a ON a.cust_ac_no = h.ac_no"
HAC = f"{HA} JOIN sttm_customer c ON c.customer_no = a.cust_no"
D90 = f"h.trn_dt >= {days_back(90)}"
VOL = cents("COALESCE(SUM(h.lcy_amount), 0)")
check(
    "AML-400",
    [
        count("transactions", H, D90), scalar("active_accounts", f"(SELECT COUNT(DISTINCT h.ac_no) {H} WHERE {D90})"),
        scalar("credit_volume", "NULL", f"(SELECT {VOL} {H} WHERE {D90} AND h.drcr_ind = 'C')"),
    ],
)


def counted(metric: str, body: str, where: str) -> str:
    return scalar(metric, f"(SELECT COUNT(*) {body} WHERE {where})", f"(SELECT {VOL} {body} WHERE {where})")


def distinct_clients(metric: str, where: str) -> str:
    return scalar(metric, f"(SELECT COUNT(DISTINCT a.cust_no) {HA} WHERE {where})")


_CASH = f"{D90} AND h.trn_code IN {codes(*CASH_CODES)}"
_BIG = f"{_CASH} AND h.lcy_amount >= 5000000"
check(
    "AML-401",
    [counted("large_cash_operations", H, _BIG), distinct_clients("large_cash_clients", _BIG), grouped("large_cash_by_side", "h.drcr_ind", f"{H} WHERE {_BIG}", VOL)],
    sample=top(
        {"cust_no": "a.cust_no", "customer_name": "c.customer_name1", "ac_no": "h.ac_no", "drcr_ind": "h.drcr_ind",
         "amount": cents("h.lcy_amount"), "trn_dt": "strftime(h.trn_dt, '%Y-%m-%d %H:%M:%S')"},
        f"{HAC} WHERE {_BIG}", ["amount DESC NULLS FIRST"], 20),
)
_SMALL = f"{_CASH} AND h.lcy_amount > 500000 AND h.lcy_amount < 5000000"
_DAYS = lambda key, body: (
    f"SELECT {key}, CAST(h.trn_dt AS DATE) AS day {body} WHERE {_SMALL} GROUP BY ALL HAVING COUNT(*) >= 3 AND SUM(h.lcy_amount) >= 5000000"
)
_STRUCT = (
    f"SELECT a.cust_no, c.customer_name1 AS customer_name, h.ac_no, {day('h.trn_dt')} AS day, COUNT(*) AS n, {cents('SUM(h.lcy_amount)')} AS total"
    f" {HAC} WHERE {_SMALL} GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 3 AND SUM(h.lcy_amount) >= 5000000"
)
check(
    "AML-402",
    [
        scalar("suspicious_account_days", f"(SELECT COUNT(*) FROM ({_DAYS('h.ac_no', H)}) AS d)"),
        scalar("suspicious_client_days", f"(SELECT COUNT(*) FROM ({_DAYS('a.cust_no', HA)}) AS d)"),
        scalar("suspicious_clients", f"(SELECT COUNT(DISTINCT cust_no) FROM ({_DAYS('a.cust_no', HA)}) AS d)"),
    ],
    sample=top({n: n for n in ("cust_no", "customer_name", "ac_no", "day", "n", "total")}, f"FROM ({_STRUCT}) AS s", ["total DESC"], 15),
)


def dormant(as_of: str) -> None:
    """Run at an earlier date of reference than the rest: the window has to hold transactions."""
    back = f"({as_of} - INTERVAL 12 MONTH)"
    d30 = f"h.trn_dt >= {as_of} - INTERVAL 30 DAY"
    asleep = (
        f"a.record_stat = 'O' AND (a.date_last_cr_activity IS NULL OR a.date_last_cr_activity < {back})"
        f" AND (a.date_last_dr_activity IS NULL OR a.date_last_dr_activity < {back})"
    )
    vol = f"(SELECT SUM(h.lcy_amount) {H} WHERE h.ac_no = a.cust_ac_no AND {d30})"
    used = f"{asleep} AND EXISTS ({H} WHERE h.ac_no = a.cust_ac_no AND {d30})"
    check(
        "AML-403",
        [
            count("reactivated_accounts", "FROM sttm_cust_account a", used),
            scalar("reactivated_volume", "NULL",
                   f"(SELECT {VOL} {H} WHERE {d30} AND h.ac_no IN (SELECT a.cust_ac_no FROM sttm_cust_account a WHERE {asleep}))"),
        ],
        sample=top(
            {"cust_no": "a.cust_no", "customer_name": "c.customer_name1", "cust_ac_no": "a.cust_ac_no",
             "last_before": day("GREATEST(a.date_last_cr_activity, a.date_last_dr_activity)"), "volume": cents(f"COALESCE({vol}, 0)"),
             "n": f"(SELECT COUNT(*) {H} WHERE h.ac_no = a.cust_ac_no AND {d30})"},
            f"FROM sttm_cust_account a JOIN sttm_customer c ON c.customer_no = a.cust_no WHERE {used}", ["volume DESC NULLS FIRST"], 15),
    )


EARLY = "TIMESTAMP '2024-02-01 00:00:00'"
dormant(EARLY)
_LIST = codes(*RISK_COUNTRIES)
_WIRE = (
    f"{HAC} LEFT JOIN sttm_customer rc ON rc.customer_no = h.related_customer WHERE {D90} AND h.trn_code IN {codes(*TRANSFER_CODES)}"
    f" AND (c.country IN {_LIST} OR rc.country IN {_LIST})"
)
check(
    "AML-404",
    [
        scalar("risk_country_transfers", f"(SELECT COUNT(*) {_WIRE})", f"(SELECT {VOL} {_WIRE})"),
        grouped("transfers_by_country", f"CASE WHEN c.country IN {_LIST} THEN c.country ELSE rc.country END", _WIRE, VOL, "ORDER BY n DESC, g LIMIT 10"),
    ],
)
_NIGHT = f"{D90} AND h.lcy_amount >= 500000 AND (HOUR(h.trn_dt) >= 22 OR HOUR(h.trn_dt) < 6)"
check(
    "AML-405",
    [counted("night_transactions", H, _NIGHT), grouped("night_by_hour", "HOUR(h.trn_dt)", f"{H} WHERE {_NIGHT}", VOL), distinct_clients("night_clients", _NIGHT)],
)
_ROUND = f"{D90} AND h.lcy_amount >= 1000000 AND h.lcy_amount % 1000000 = 0"
_KM = "LEFT JOIN sttm_kyc_master m ON m.kyc_ref_no = c.kyc_ref_no"


def _rated(where: str, having: str, extra: dict | None = None) -> str:
    cols = {"n": "COUNT(*)", **(extra or {}), "volume": cents("SUM(h.lcy_amount)")}
    return (
        f"SELECT a.cust_no, c.customer_name1 AS customer_name, m.risk_level, {', '.join(f'{e} AS {n}' for n, e in cols.items())}"
        f" {HAC} {_KM} WHERE {where} GROUP BY 1, 2, 3 HAVING {having}"
    )


check(
    "AML-406",
    [
        count("round_transactions", H, _ROUND),
        scalar("round_amount_clients", f"(SELECT COUNT(*) FROM (SELECT a.cust_no {HA} WHERE {_ROUND} GROUP BY 1 HAVING COUNT(*) >= 5) AS g)"),
    ],
    sample=top({n: n for n in ("cust_no", "customer_name", "risk_level", "n", "volume")}, f"FROM ({_rated(_ROUND, 'COUNT(*) >= 5')}) AS g", ["n DESC"], 15),
)
_CREDIT = f"{D90} AND h.drcr_ind = 'C' AND h.lcy_amount >= 1000000"
_THROUGH = (
    f"{_CREDIT} AND EXISTS (FROM actb_history d WHERE d.ac_no = h.ac_no AND d.drcr_ind = 'D' AND d.trn_dt > h.trn_dt"
    " AND d.trn_dt <= h.trn_dt + INTERVAL 48 HOUR AND d.lcy_amount >= 0.8 * h.lcy_amount)"
)
check(
    "AML-407",
    [scalar("pass_through_accounts", f"(SELECT COUNT(DISTINCT h.ac_no) {H} WHERE {_THROUGH})")],
    sample=top(
        {n: n for n in ("cust_no", "customer_name", "ac_no", "balance", "last_credit")},
        f"FROM (SELECT DISTINCT a.cust_no, c.customer_name1 AS customer_name, h.ac_no, {cents('a.acy_curr_balance')} AS balance,"
        f" {day('a.date_last_cr_activity')} AS last_credit {HAC} WHERE {_THROUGH}) AS g", RICH, 15),
)


def frequent(as_of: str, busy: int, very_busy: int) -> None:
    d30 = f"h.trn_dt >= {as_of} - INTERVAL 30 DAY"
    per = lambda n: f"(SELECT COUNT(*) FROM (SELECT a.cust_no {HA} WHERE {d30} GROUP BY 1 HAVING COUNT(*) > {n}) AS g)"
    check(
        "AML-408",
        [scalar("busy_clients", per(busy)), scalar("very_busy_clients", per(very_busy))],
        sample=top(
            {n: n for n in ("cust_no", "customer_name", "risk_level", "n", "n_accounts", "volume")},
            f"FROM ({_rated(d30, f'COUNT(*) > {busy}', {'n_accounts': 'COUNT(DISTINCT h.ac_no)'})}) AS g", ["n DESC"], 15),
    )


frequent(EARLY, 60, 75)
_A = "FROM aaml_sir_details s"
_PENDING = "s.sir_status NOT IN ('CLOSED', 'FILED', 'REJECTED')"
_YEAR = f"s.sir_date >= {LATE_12}"
_BAND = (
    "CASE WHEN s.close_date <= s.sir_date + INTERVAL 3 DAY THEN 'within 3 days' WHEN s.close_date <= s.sir_date + INTERVAL 7 DAY THEN '4 to 7 days'"
    " WHEN s.close_date <= s.sir_date + INTERVAL 30 DAY THEN '8 to 30 days' ELSE 'more than 30 days' END"
)
check(
    "AML-409",
    [
        count("alerts_open_over_limit", _A, f"{_PENDING} AND s.sir_date < {days_back(3)}"),
        count("alerts_open_over_30_days", _A, f"{_PENDING} AND s.sir_date < {days_back(30)}"),
        count("alerts_12_months", _A, _YEAR),
        grouped("alerts_by_status", "s.sir_status", f"{_A} WHERE {_YEAR}"),
        grouped("alerts_by_delay", _BAND, f"{_A} WHERE {_YEAR} AND s.sir_status IN ('CLOSED', 'FILED') AND s.close_date IS NOT NULL"),
    ],
)
_M1 = f"{D90} AND h.lcy_amount >= 1000000"
_HP = f"{HAC} JOIN sttm_kyc_retail r ON r.kyc_ref_no = c.kyc_ref_no"
_HM = f"{HAC} JOIN sttm_kyc_master m ON m.kyc_ref_no = c.kyc_ref_no"
_W1, _W2 = f"{_M1} AND r.pep = 'Y'", f"{D90} AND h.lcy_amount >= 5000000 AND m.risk_level = 'Level3'"
_WATCH = (
    f"SELECT a.cust_no, c.customer_name1 AS customer_name, r.pep, m.risk_level, COUNT(*) AS n, {cents('SUM(h.lcy_amount)')} AS volume"
    f" {HAC} LEFT JOIN sttm_kyc_retail r ON r.kyc_ref_no = c.kyc_ref_no {_KM} WHERE {_M1}"
    " AND (COALESCE(r.pep, 'N') = 'Y' OR COALESCE(m.risk_level, 'N/A') = 'Level3') GROUP BY 1, 2, 3, 4"
)
check(
    "AML-410",
    [
        counted("exposed_transactions", _HP, _W1), count("high_risk_transactions", _HM, _W2),
        scalar("watched_transactions", f"((SELECT COUNT(*) {_HP} WHERE {_W1}) + (SELECT COUNT(*) {_HM} WHERE {_W2}))"),
    ],
    sample=top(
        {"cust_no": "cust_no", "customer_name": "customer_name", "profile": "CASE WHEN pep = 'Y' THEN 'PEP' END",
         "risk_level": "COALESCE(g.risk_level, 'N/A')", "n": "n", "volume": "volume"}, f"FROM ({_WATCH}) AS g", ["volume DESC NULLS FIRST"], 15),
)


def check_query(check_id: str, part: str) -> str:
    spec = CHECKS[check_id]
    return with_tables(spec[part], spec["cte"])


# Findings: check, severity, scalar metric, when, message.
FINDINGS = (
    ("AML-101", "CRITIQUE", "without_kyc_with_open_account", "n > 0", "{n} clients without KYC hold open accounts"),
    ("AML-102", "CRITIQUE", "recent_unverified_with_open_account", "n > 0", "{n} recent clients operate with unverified KYC"),
    ("AML-103", "FOCUS", "high_risk_overdue_with_open_account", "TRUE", "High-risk clients with an overdue review and open accounts"),
    ("AML-104", "FOCUS", "without_identity_with_open_account", "TRUE", "Clients without identity document and with open accounts"),
    ("AML-105", "FOCUS", "expired_passports_personal", "TRUE", "Expired passports (both sources) with open accounts"),
    ("AML-106", "CRITIQUE", "clients_without_risk_profile", "n = total", "No client has a risk profile"),
    ("AML-106", "NOTE", "clients_without_risk_profile", "n = total", "Risk read from the KYC files instead"),
    ("AML-107", "CRITIQUE", "active_accounts_without_kyc", "n > 0", "{n} accounts operate without KYC file"),
    ("AML-202", "ELEVEE", "exposed_without_remarks", "n > 0", "{n} exposed persons carry no remark"),
    ("AML-301", "ELEVEE", "shared_values", "n > 0", "{n} national identity numbers are shared"),
    ("AML-302", "ELEVEE", "shared_values", "n > 0", "{n} unique identifiers are shared"),
    ("AML-304", "CRITIQUE", "unidentified_with_open_account", "n > 0", "{n} individuals operate accounts without identification"),
    ("AML-305", "MOYENNE", "birth_date_mismatches", "n > 0", "{n} birth dates differ between the personal and the KYC file"),
    ("AML-401", "CRITIQUE", "large_cash_operations", "n > 0", "{n} cash operations reach the reporting threshold"),
    ("AML-402", "CRITIQUE", "suspicious_account_days", "n > 0", "{n} account-days look like structuring"),
    ("AML-404", "CRITIQUE", "risk_country_transfers", "n > 0", "{n} transfers involve a listed country"),
    ("AML-405", "MOYENNE", "night_transactions", "n > 0", "{n} large transactions took place outside business hours"),
    ("AML-406", "ELEVEE", "round_amount_clients", "n > 0", "{n} clients repeat round amounts"),
    ("AML-407", "ELEVEE", "pass_through_accounts", "n > 0", "{n} accounts pass money through"),
    ("AML-409", "CRITIQUE", "alerts_open_over_limit", "n > 0", "{n} reports exceed the legal delay"),
    ("AML-409", "CRITIQUE", "alerts_open_over_30_days", "n > 0", "{n} reports are open for more than 30 days"),
    ("AML-410", "FOCUS", "watched_transactions", "n > 0", "Exposed and high-risk clients with large transactions"),
)


def findings_query() -> str:
    """All findings at the common date of reference (403 and 408 find nothing there)."""
    rows = []
    for i, (check_id, severity, metric, when, message) in enumerate(FINDINGS):
        spec = CHECKS[check_id]
        rows.append(
            f"SELECT check_id, '{severity}' AS severity, metric, n, REPLACE('{message}', '{{n}}', CAST(n AS VARCHAR)) AS message"
            f" FROM ({spec['metrics']}) AS f{i} WHERE metric = '{metric}' AND grp IS NULL AND {when}"
        )
    return with_tables(" UNION ALL ".join(rows))
