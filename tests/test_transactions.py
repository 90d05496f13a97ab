import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tellerlens.operators import transactions as T
from tests.conftest import table

T0 = datetime(2024, 4, 10, 12, 0, 0)


def history(spark, txns):
    """(account, moment, side, amount[, code]) tuples."""
    return table(spark, "actb_history", [
        {"ac_no": a, "trn_dt": t, "drcr_ind": s, "lcy_amount": None if m is None else Decimal(str(m)), "trn_code": (c or ["CASH"])[0]}
        for a, t, s, m, *c in txns
    ])


def flagged(spark, params, txns):
    return sorted(r["ac_no"] for r in T.pass_through(history(spark, txns), params).collect())


@pytest.mark.parametrize(
    "delay, debit, hit",
    [
        (timedelta(0), 1_000_000, False),
        (timedelta(microseconds=1), 800_000, True),
        (timedelta(microseconds=1), 799_999.999, False),
        (timedelta(hours=5), 800_000, True),
        (timedelta(hours=47, minutes=30), 900_000, True),
        (timedelta(hours=48), 800_000, True),
        (timedelta(hours=48, microseconds=1), 1_000_000, False),
        (timedelta(hours=-1), 1_000_000, False),
    ],
)
def test_pass_through_bounds(spark, params, delay, debit, hit):
    txns = [("A", T0, "C", 1_000_000), ("A", T0 + delay, "D", debit), ("B", T0 + timedelta(minutes=1), "D", 5_000_000)]
    assert flagged(spark, params, txns) == (["A"] if hit else [])


def test_pass_through_ignores_small_and_old_credits(spark, params):
    old = params.days_ago(90) - timedelta(microseconds=1)
    txns = [("A", T0, "C", 999_999.99), ("A", T0 + timedelta(hours=1), "D", 5_000_000),
            ("B", old, "C", 2_000_000), ("B", old + timedelta(hours=1), "D", 2_000_000)]
    assert flagged(spark, params, txns) == []


def test_pass_through_equals_pairwise_search(spark, params):
    rng = random.Random(11)
    txns = []
    for i in range(1500):
        account = "HOT" if i % 3 == 0 else f"A{rng.randrange(60)}"
        moment = datetime(2024, 3, 1) + timedelta(minutes=rng.randrange(60 * 24 * 40), microseconds=rng.choice([0, 0, 1, 999_999]))
        txns.append((account, moment, rng.choice("CD"), rng.choice([500_000, 900_000, 1_000_000, 1_500_000, 4_000_000])))
    # spread thin: otherwise every account has a hit
    thin = [t for t in txns if t[0] == "HOT" or rng.random() < 0.2]
    credits = [t for t in thin if t[2] == "C" and t[3] >= 1_000_000]
    expected = sorted({
        c[0] for c in credits for d in thin
        if d[0] == c[0] and d[2] == "D" and timedelta(0) < d[1] - c[1] <= timedelta(hours=48) and d[3] >= 0.8 * c[3]
    })
    assert 1 < len(expected) < len({t[0] for t in thin})
    assert flagged(spark, params, thin) == expected


def test_structuring_bounds_are_open_below_and_above(spark, params):
    day = datetime(2024, 4, 1, 10)
    txns = [("A", day + timedelta(hours=i), "C", 1_700_000) for i in range(3)]
    txns += [("B", day, "C", 500_000), ("B", day, "C", 4_999_999.99), ("B", day, "C", 500_000.01)]
    txns += [("C", day, "C", 5_000_000), ("C", day, "C", 2_600_000), ("C", day, "C", 2_600_000)]
    txns += [("D", day, "C", 2_000_000), ("D", day, "C", 2_000_000), ("D", day + timedelta(days=1), "C", 2_000_000)]
    txns += [("E", day, "C", 2_000_000, "POSX") for _ in range(3)]
    got = [(r["ac_no"], r["n"]) for r in T.structuring(history(spark, txns), params).collect()]
    assert got == [("A", 3)]


def test_client_days_add_up_over_accounts(spark, params):
    day = datetime(2024, 4, 1, 10)
    txns = [("A", day, "C", 2_000_000), ("B", day, "C", 2_000_000), ("B", day, "C", 2_000_000), ("X", day, "C", 2_000_000)]
    accounts = table(spark, "sttm_cust_account", [{"cust_ac_no": a, "cust_no": c} for a, c in (("A", "1"), ("B", "1"), ("X", "2"))])
    h = history(spark, txns)
    assert T.structuring(h, params).count() == 0
    assert [r["cust_no"] for r in T.structuring_client_days(h, accounts, params).collect()] == ["1"]


def test_large_cash_is_inclusive(spark, params):
    txns = [("A", T0, "C", 5_000_000), ("A", T0, "C", 4_999_999.99), ("A", T0, "C", None), ("A", T0, "C", 9_000_000, "SWIFT"),
            ("A", params.days_ago(90), "D", 6_000_000), ("A", params.days_ago(90) - timedelta(microseconds=1), "D", 6_000_000)]
    assert T.large_cash(history(spark, txns), params).count() == 2


def test_night_hours(spark, params):
    stamps = [(21, 59, 59), (22, 0, 0), (5, 59, 59), (6, 0, 0)]
    txns = [("A", datetime(2024, 4, 1, *s), "C", 500_000) for s in stamps] + [("A", datetime(2024, 4, 1, 23), "C", 499_999)]
    assert sorted(r["hour_of_day"] for r in T.off_hours(history(spark, txns), params).collect()) == [5, 22]


def test_round_amounts(spark, params):
    txns = [("A", T0, "C", m) for m in (1_000_000, 2_000_000, 1_000_000.5, 500_000, 0, None)]
    assert [(r["n"], float(r["volume"])) for r in T.round_amounts(history(spark, txns), params).collect()] == [(2, 3_000_000.0)]


def test_listed_countries_count_holder_first(spark, params):
    customers = table(spark, "sttm_customer", [{"customer_no": n, "country": c} for n, c in (("1", "IR"), ("2", "FRA"), ("3", "SY"))])
    accounts = table(spark, "sttm_cust_account", [{"cust_ac_no": f"A{n}", "cust_no": n} for n in ("1", "2")])
    rows = [("A1", "3"), ("A2", "3"), ("A2", None), ("A2", "404"), ("A1", None)]
    h = table(spark, "actb_history", [
        {"ac_no": a, "related_customer": r, "trn_code": "SWIFT", "trn_dt": T0, "lcy_amount": Decimal(10)} for a, r in rows])
    got = {r["risk_country"]: (r["n"], float(r["volume"])) for r in T.risky_transfers(h, accounts, customers, params).collect()}
    assert got == {"IR": (2, 20.0), "SY": (1, 10.0)}
