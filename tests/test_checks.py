"""Checks on hand-made banks: fan-out, gates, optional tables, invariants."""

from datetime import datetime
from decimal import Decimal

from tellerlens.plans import audit, coherence
from tellerlens.plans.views import Views
from tests.conftest import bank_of


def metrics(views, check_id):
    found = audit.metrics(views, [audit.find_check(views, check_id)]).collect()
    return {(r["metric"], r["grp"]): r for r in found}


def n_of(views, rule_id):
    return coherence.rule_counts(views, [coherence.find_rule(rule_id)]).collect()[0]


def test_with_and_without_account_make_the_total(spark, params):
    customers = [{"customer_no": str(i), "kyc_ref_no": k} for i, k in enumerate([None, " ", "   ", "K", ""])]
    accounts = [{"cust_ac_no": "A", "cust_no": "0", "record_stat": "O"}, {"cust_ac_no": "B", "cust_no": "1", "record_stat": "C"}]
    v = Views(bank_of(spark, sttm_customer=customers, sttm_cust_account=accounts), params)
    got = metrics(v, "AML-101")
    assert got[("clients_without_kyc", None)]["n"] == 3 and float(got[("clients_without_kyc", None)]["pct"]) == 60.0
    assert got[("without_kyc_with_open_account", None)]["n"] == 1
    assert got[("without_kyc_without_open_account", None)]["n"] == 2
    rows = audit.metrics(v, [audit.find_check(v, "AML-101")])
    assert [r["severity"] for r in audit.findings(v, rows).collect()] == ["CRITIQUE"]


def test_repeated_kyc_rows_multiply_matches(spark, params):
    customers = [{"customer_no": str(i), "kyc_ref_no": "K", "customer_category": "PEP/FEPS"} for i in range(2)]
    retail = [{"kyc_ref_no": "K", "pep": "N"}, {"kyc_ref_no": "K", "pep": None}, {"kyc_ref_no": "K", "pep": "Y"}]
    v = Views(bank_of(spark, sttm_customer=customers, sttm_kyc_retail=retail), params)
    assert n_of(v, "2.7")["n"] == 4
    assert n_of(v, "2.8")["n"] == 0 and n_of(v, "2.8")["verdict"] == "OK"


def test_null_flags_are_dropped_or_kept_as_each_rule_says(spark, params):
    customers = [{"customer_no": str(i), "staff": s, "customer_category": c} for i, (s, c) in enumerate(
        [("Y", None), ("Y", "CORP"), ("Y", "STAF"), (None, "STAF"), ("N", "STAF")])]
    v = Views(bank_of(spark, sttm_customer=customers), params)
    assert n_of(v, "2.5")["n"] == 1
    assert n_of(v, "2.6")["n"] == 2


def test_month_bounds_of_overdue_reviews(spark, params):
    p = params.with_(as_of=datetime(2024, 2, 29, 12))
    dates = [datetime(2022, 2, 28, 11), datetime(2022, 2, 28, 12), datetime(2023, 2, 28, 11), datetime(2023, 2, 28, 12),
             datetime(2024, 2, 29, 11), datetime(2024, 2, 29, 12), None]
    v = Views(bank_of(spark, sttm_kyc_retail=[{"kyc_ref_no": str(i), "kyc_nxt_review_date": d} for i, d in enumerate(dates)]), p)
    got = {k[0]: r["n"] for k, r in metrics(v, "AML-103").items()}
    assert (got["retail_overdue"], got["retail_overdue_over_24_months"], got["retail_overdue_12_to_24_months"],
            got["retail_overdue_under_12_months"]) == (5, 1, 2, 2)


def test_risk_profile_gate_needs_every_client(spark, params):
    all_blank = Views(bank_of(spark, sttm_customer=[{"customer_no": "1"}, {"customer_no": "2", "risk_profile": " "}]), params)
    some = Views(bank_of(spark, sttm_customer=[{"customer_no": "1"}, {"customer_no": "2", "risk_profile": "LOW"}]), params)
    for v, expected in ((all_blank, ["CRITIQUE", "NOTE"]), (some, [])):
        rows = audit.metrics(v, [audit.find_check(v, "AML-106")])
        assert sorted(r["severity"] for r in audit.findings(v, rows).collect()) == expected


def test_missing_alert_table_is_reported(spark, params):
    v = Views(bank_of(spark), params)
    rows = audit.metrics(v, [audit.find_check(v, "AML-409")])
    assert [(r["severity"], r["metric"]) for r in audit.findings(v, rows).collect()] == [("INFO", "alert_table_missing")]


def test_alert_delays(spark, params):
    start = datetime(2024, 1, 1, 8)
    ends = [datetime(2024, 1, 4, 8), datetime(2024, 1, 4, 8, 0, 1), datetime(2024, 1, 8, 8), datetime(2024, 1, 31, 8), datetime(2024, 3, 1), None]
    alerts = [{"sir_status": "CLOSED", "sir_date": start, "close_date": e} for e in ends] + [{"sir_status": None, "sir_date": start}]
    v = Views(bank_of(spark, aaml_sir_details=alerts), params)
    got = {k[1]: r["n"] for k, r in metrics(v, "AML-409").items() if k[0] == "alerts_by_delay"}
    assert got == {"within 3 days": 1, "4 to 7 days": 2, "8 to 30 days": 1, "more than 30 days": 1}
    assert metrics(v, "AML-409")[("alerts_open_over_limit", None)]["n"] == 0


def test_ledger_keys_differ_between_rule_and_profile(spark, params):
    accounts = [{"cust_ac_no": "A", "cust_no": "1", "branch_code": "001", "ac_stat_frozen": f, "acy_curr_balance": Decimal(1)} for f in ("Y", None)]
    mirror = [{"ac_gl_no": "A", "branch_code": "001", "cust_no": "2", "pkey": "A", "ac_stat_frozen": "N"}]
    v = Views(bank_of(spark, sttm_cust_account=accounts, sttb_account=mirror), params)
    assert n_of(v, "4.2")["n"] == 1
    from tellerlens.plans.profile import cross_checks

    assert {r["metric"]: r["n"] for r in cross_checks(v).collect()}["accounts_without_ledger_row"] == 2


def test_catalogue_has_ninety_six_rules_and_stable_totals(spark, params):
    rules = coherence.all_rules()
    assert len(rules) == 96 and [r.id for r in rules] == list(coherence.RULE_IDS)
    assert len([c for c in audit.CHECK_IDS if c not in ("AML-000", "AML-400")]) == 29
    v = Views(bank_of(spark), params)
    counted = coherence.rule_counts(v, coherence.section_rules(3))
    total = coherence.totals(counted).collect()[0]
    assert (total["rules_run"], total["rules_with_anomalies"]) == (21, 0)
