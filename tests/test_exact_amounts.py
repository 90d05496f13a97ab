"""Amounts in their declared scale decide; cents are only shown. No transaction is shuffled for section 8."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tellerlens.operators.relations import maybe_key
from tellerlens.plans import audit, coherence, profile
from tellerlens.plans.views import Views
from tellerlens.sources.bank import Bank
from tellerlens.sources.starbank import star_bank
from tests.conftest import DATA, bank_of

DAY = datetime(2024, 4, 10, 12)


def cash(*amounts, ac="A1", **more):
    return [
        {"trn_ref_no": f"T{ac}{i}", "ac_no": ac, "drcr_ind": "C", "trn_code": "CASH", "module": "FT", "lcy_amount": Decimal(a), "trn_dt": DAY, **more}
        for i, a in enumerate(amounts)
    ]


def views(spark, params, history, balances=("1.000",)):
    accounts = [
        {"cust_ac_no": f"A{i}", "cust_no": f"C{i}", "branch_code": "1", "record_stat": "O", "acy_curr_balance": Decimal(b)} for i, b in enumerate(balances, 1)
    ]
    clients = [{"customer_no": f"C{i}", "customer_name1": f"N{i}", "customer_type": "B", "nationality": "US"} for i in range(1, len(balances) + 1)]
    return Views(bank_of(spark, actb_history=history, sttm_cust_account=accounts, sttm_customer=clients), params)


def named(df):
    return {r["metric"]: r for r in df.collect() if r["grp"] is None}


@pytest.mark.parametrize("last,hit", [("1666666.664", 0), ("1666666.668", 1)])
def test_structuring_bound_is_exact(spark, params, last, hit):
    v = views(spark, params, cash("1666666.666", "1666666.666", last))  # 4,999,999.996 is shown as 5,000,000.00
    assert [named(audit.metrics(v, [audit.find_check(v, "AML-402")]))[m]["n"] for m in ("suspicious_account_days", "suspicious_client_days", "suspicious_clients")] == [hit] * 3
    rows = audit.check_sample(v, "AML-402").collect()
    assert [r["total"] for r in rows] == [Decimal("5000000.00")] * hit


def test_totals_add_exact_groups(spark, params):
    history = cash("6000000.004", "6000000.004") + cash("6000000.004", ac="A1", drcr_ind="D")
    v = views(spark, params, history)
    got = named(audit.metrics(v, [audit.find_check(v, "AML-401")]))["large_cash_operations"]
    assert got["amount"] == Decimal("18000000.01") and got["n"] == 3


def test_samples_rank_exact_amounts(spark, params):
    v = views(spark, params, cash("6000000.001", "6000000.004", "6000000.002"), ("5.001", "5.004", "5.003"))
    rows = audit.check_sample(v, "AML-401").collect()
    assert {r["amount"] for r in rows} == {Decimal("6000000.00")}
    banks = coherence.rule_sample(v, "8.1").orderBy("rank").collect()
    assert [r["customer_no"] for r in banks] == ["C2", "C3", "C1"] and banks[0]["total_balance"] == Decimal("5.00")


def test_key_filter_keeps_all_partners(spark):
    keys = spark.createDataFrame([(f"K{i}",) for i in range(0, 3000, 3)] + [(None,)], "key string")
    rows = spark.createDataFrame([(f"K{i}",) for i in range(3000)] + [(None,)], "ac_no string")
    for bits in (1 << 8, 1 << 20):
        passed = rows.filter(maybe_key(F.col("ac_no"), keys, "key", bits))
        assert keys.filter("key IS NOT NULL").exceptAll(passed.select("ac_no")).count() == 0
        assert passed.filter("ac_no IS NULL").count() == 0
    assert rows.filter(maybe_key(F.col("ac_no"), keys, "key")).count() < 1100
    assert rows.filter(maybe_key(F.col("ac_no"), keys.limit(0), "key")).count() == 0


def children(node):
    return [node.children().apply(i) for i in range(node.children().size())]


def raw_exchanges(node, part):
    """Exchanges, in subqueries too, below which the scan of ``part`` is reached without a partial aggregate."""

    def reaches(n):
        if "Aggregate" in n.nodeName():
            return False
        if n.nodeName().startswith("Scan"):
            return part in n.metadata().get("Location").get()
        return any(map(reaches, children(n)))

    found = [node] if "Exchange" in node.nodeName() and reaches(node) else []
    subqueries = [node.subqueries().apply(i).child() for i in range(node.subqueries().size())]
    for n in children(node) + subqueries:
        found += raw_exchanges(n.initialPlan() if n.nodeName().startswith("Adaptive") else n, part)
    return found


@pytest.fixture(scope="module")
def stored_views(spark, params, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bank"))
    bank = star_bank(spark, DATA)
    for name in ("actb_history", "sttm_customer", "sttm_cust_account", "sttm_kyc_master", "sttm_cust_personal", "sttb_account", "sttm_kyc_retail", "sttm_kyc_corporate", "sttm_kyc_corp_keypersons"):
        bank[name].write.parquet(f"{root}/{name}")
    return Views(Bank.from_parquet(spark, root), params)


@pytest.mark.parametrize("rule", ["8.0", "8.10", "8.11", "8.12", "8.13", "8.14", "8.15", "7.12", "anomaly"])
def test_no_transaction_is_shuffled(spark, stored_views, rule):
    df = profile.cross_checks(stored_views) if rule == "anomaly" else coherence.rule_sample(stored_views, rule)
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.initialPlan() if plan.nodeName().startswith("Adaptive") else plan
    assert "actb_history" in plan.toString()
    assert not raw_exchanges(plan, "actb_history")
