"""Pass-through search against brute force, with hot seconds and marks right at the bounds."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tellerlens.operators.transactions import pass_through
from tests.conftest import table

BASE = datetime(2024, 3, 1, 10, 59, 59)


def brute(rows, params):
    share = Decimal(params.pass_through_percent) / 100
    out = set()
    for ac, side, amount, at in rows:
        if side == "C" and amount >= params.pass_through_credit:
            if any(a == ac and s == "D" and x >= amount * share and at < t <= at + timedelta(hours=params.pass_through_hours) for a, s, x, t in rows):
                out.add(ac)
    return out


def found(spark, rows, params):
    history = table(spark, "actb_history", [
        {"trn_ref_no": str(i), "ac_no": ac, "drcr_ind": side, "lcy_amount": amount, "trn_dt": at} for i, (ac, side, amount, at) in enumerate(rows)])
    got = [r[0] for r in pass_through(history, params).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("spread", [1, 400, 5_000, 3_000_000, 7_200_000_000, 200_000_000_000])
def test_pass_through_equals_brute_force(spark, params, spread):
    rng = random.Random(spread)
    rows = []
    for k in range(150):
        for _ in range(rng.choice([2, 3, 6])):
            at = BASE + timedelta(microseconds=rng.randrange(spread))
            rows.append((f"A{k}", rng.choice("CD"), Decimal(rng.choice([1_000_000, 1_200_000, 2_000_000, 799_999, 800_000, 960_000])), at))
        if k % 5 == 0:  # right at the deadline, right before and after it
            rows.append((f"B{k}", "C", Decimal(1_000_000), BASE))
            rows.append((f"B{k}", "D", Decimal(800_000), BASE + timedelta(hours=48, microseconds=rng.choice([-1, 0, 1]))))
    want = brute(rows, params)
    assert found(spark, rows, params) == want and (want or spread == 1)


def test_one_account_with_all_rows_in_one_second(spark, params):
    debits = [("A", "D", Decimal(800_000), BASE + timedelta(microseconds=i)) for i in range(3000)]
    credit = ("A", "C", Decimal(1_000_000), BASE + timedelta(microseconds=2999))
    assert found(spark, [*debits, credit], params) == set()
    assert found(spark, [*debits, ("A", "C", Decimal(1_000_000), BASE + timedelta(microseconds=2998))], params) == {"A"}
