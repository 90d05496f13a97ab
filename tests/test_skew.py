import random
from datetime import datetime
from statistics import median

import pytest
from pyspark.sql import functions as F

from tellerlens.operators import skew
from tellerlens.operators.skew import dealt, spread_join
from tellerlens.params import RunParams
from tellerlens.plans import audit
from tellerlens.plans.views import Views
from tests.conftest import bank_of

C = F.col
PARAMS = RunParams(as_of=datetime(2024, 4, 15, 9, 30))


def hot_keys(df, keys, parts=None, slice_rows=None):
    """Measured however small the table is."""
    return skew.hot_keys(df, keys, parts, slice_rows, small_bytes=-1)


def sides(spark, seed=3):
    """A side with a third of its rows under one key, and NULL and rare keys; keys repeat on both sides."""
    rng = random.Random(seed)
    left = [(i, "HOT" if i % 3 == 0 else None if i % 7 == 0 else f"k{rng.randrange(200)}") for i in range(3000)]
    right = [(i, "HOT" if i % 11 == 0 else None if i % 5 == 0 else f"k{rng.randrange(260)}") for i in range(400)]
    return (spark.createDataFrame(left, "id int, key string").repartition(4),
            spark.createDataFrame(right, "other int, ref string").repartition(3))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_hot_keys_are_measured(spark):
    left, _ = sides(spark)
    got = {r["_hot"]: r["_slices"] for r in hot_keys(left, "key", parts=16, slice_rows=1).collect()}
    counted = left.filter("key IS NOT NULL").groupBy(F.xxhash64("key").alias("h")).count().collect()
    total = sum(r["count"] for r in counted)
    assert got == {r["h"]: -(-r["count"] * 16 // total) for r in counted if r["count"] * 16 > total} and len(got) == 1
    assert hot_keys(left, "key").count() == 0, "no slice of so few rows"
    assert skew.hot_keys(spark.range(1000), "id", slice_rows=1) is None, "what one task can hold is not even measured"
    assert hot_keys(left.limit(0), "key", slice_rows=1).count() == 0
    assert hot_keys(left.filter("key IS NULL"), "key", slice_rows=1).count() == 0


@pytest.mark.parametrize("parts", [1, 16])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_result_is_that_of_a_plain_join(spark, how, parts):
    left, right = sides(spark)
    want = rows(left.join(right, C("key") == C("ref"), how))
    hot = hot_keys(left, "key", parts, 1)
    assert rows(spread_join(left, right, [C("key")], [C("ref")], C("id"), hot, how)) == want
    if how == "inner":
        other = hot_keys(right, "ref", parts, 1)
        grid = spread_join(left, right, [C("key")], [C("ref")], C("id"), hot, how, C("other"), other)
        assert rows(grid) == want
        assert rows(spread_join(left, right, [C("key")], [C("ref")], C("id"), None, how, C("other"), other)) == want


def test_unmeasured_sides_are_joined_plainly(spark):
    left, right = sides(spark)
    for how in ("inner", "left", "left_anti"):
        got = spread_join(left, right, [C("key")], [C("ref")], C("id"), None, how, cond=C("other") > 50)
        assert rows(got) == rows(left.join(right, (C("key") == C("ref")) & (C("other") > 50), how))


def test_one_slice_a_row(spark):
    left, right = (side.limit(400) for side in sides(spark))
    got = spread_join(left, right, [C("key")], [C("ref")], C("id"), hot_keys(left, "key", slice_rows=1), "left")
    assert rows(got) == rows(left.join(right, C("key") == C("ref"), "left"))


def test_wrong_or_stale_measures_do_not_change_the_result(spark):
    left, right = sides(spark)
    strange = left.select(F.xxhash64("key").alias("_hot"), (F.abs(F.xxhash64("key")) % 5 + 2).cast("int").alias("_slices"))
    strange = strange.filter("_hot % 2 = 0").distinct()
    want = rows(left.join(right, C("key") == C("ref"), "left"))
    assert rows(spread_join(left, right, [C("key")], [C("ref")], C("id"), strange, "left")) == want


def test_several_keys_with_a_condition(spark):
    left, right = sides(spark)
    left, right = left.withColumn("two", C("id") % 2), right.withColumn("pair", C("other") % 2)
    near = C("other") > 100
    hot = hot_keys(left, ["key", "two"], 8, 1)
    got = spread_join(left, right, [C("key"), C("two")], [C("ref"), C("pair")], C("id"), hot, "left", cond=near)
    assert rows(got) == rows(left.join(right, (C("key") == C("ref")) & (C("two") == C("pair")) & near, "left"))


def test_no_task_holds_twice_the_median(spark):
    n, tasks = 120_000, 16
    key = F.when(C("id") % 3 == 0, F.lit("HOT")).when(C("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), C("id")))
    left = spark.range(n).select("id", key.alias("key"))
    cells = dealt(left, [C("key")], C("id"), hot_keys(left, "key", slice_rows=1), None, ("_i", "_j"))
    sizes = [r["count"] for r in cells.repartition(tasks, "key", "_i", "_j").groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert sum(sizes) == n and len(sizes) == tasks
    assert max(sizes) <= 2 * median(sizes)


def test_keys_of_two_types_are_refused(spark):
    left, right = sides(spark)
    hot = hot_keys(left, "key", 8, 1)
    with pytest.raises(ValueError, match="different types"):
        spread_join(left, right, [C("key")], [C("other")], C("id"), hot)
    with pytest.raises(ValueError, match="inner joins only"):
        spread_join(left, right, [C("key")], [C("ref")], C("id"), hot, "left", C("other"), hot)


def crowded_bank(spark):
    """A third of the clients name the blank reference and share an identity; one counterparty and one account are hot."""
    from decimal import Decimal
    clients = [
        {"customer_no": f"C{i}", "customer_name1": f"N{i}", "customer_type": "I", "kyc_ref_no": " " if i % 3 == 0 else f"R{i}" if i % 5 else None,
         "unique_id_value": "SAME" if i % 3 == 1 else f"U{i}", "country": "IR" if i % 10 == 0 else "FR"} for i in range(150)
    ]
    files = [{"kyc_ref_no": r, "risk_level": "L2"} for r in [" ", " ", *[f"R{i}" for i in range(0, 150, 2)]]]
    retail = [{"kyc_ref_no": r, "passport_expiry_date": datetime(2020, 1, 1)} for r in [" ", *[f"R{i}" for i in range(0, 150, 4)]]]
    accounts = [{"cust_ac_no": f"A{i}", "cust_no": f"C{i if i % 2 else 0}", "record_stat": "O"} for i in range(150)]
    moves = [
        {"ac_no": "A1" if i % 3 == 0 else f"A{i % 150}", "related_customer": "C10" if i % 3 == 1 else None if i % 2 else f"C{i % 150}",
         "trn_code": PARAMS.transfer_codes[0], "lcy_amount": Decimal(i), "trn_dt": datetime(2024, 4, 1)} for i in range(600)
    ]
    return bank_of(spark, sttm_customer=clients, sttm_kyc_master=files, sttm_kyc_retail=retail, sttm_cust_account=accounts,
                   sttb_account=[], actb_history=moves)


@pytest.mark.parametrize("check_id", ["AML-105", "AML-106", "AML-302", "AML-404"])
def test_checks_do_not_depend_on_the_split(spark, monkeypatch, check_id):
    bank = crowded_bank(spark)

    def results():
        v = Views(bank, PARAMS)
        check = audit.find_check(v, check_id)
        return [rows(audit.metrics(v, [check])), *[rows(audit.check_sample(v, check_id, n)) for n in check.samples]]

    plain = results()
    monkeypatch.setattr(skew, "SMALL_BYTES", -1)
    monkeypatch.setattr(skew, "SLICE_ROWS", 1)
    monkeypatch.setattr(skew, "PARTS", 32)
    assert results() == plain and any(r for r in plain)
