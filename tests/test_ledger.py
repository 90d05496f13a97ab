"""The account-day ledger: only new and changed days are read again; results equal those over the history."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tellerlens.operators.ledger import DayLedger, measure
from tellerlens.operators.transactions import since
from tellerlens.plans import audit, coherence
from tellerlens.plans.views import Views
from tellerlens.sources.bank import Bank
from tellerlens.sources.starbank import star_bank
from tests.conftest import DATA

AS_OF = datetime(2024, 2, 1, 9, 30)  # within the derived transactions


@pytest.fixture(scope="module")
def stored_bank(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ledger"))
    bank = star_bank(spark, DATA)
    history = bank["actb_history"].filter(F.col("trn_dt") >= F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("trn_day", F.to_date("trn_dt"))
    history.repartition(2).write.partitionBy("trn_day").parquet(f"{root}/bank/actb_history")
    frames = {n: (lambda n=n: bank[n]) for n in ("sttm_customer", "sttm_cust_account", "sttm_kyc_master", "sttm_kyc_retail")}
    return root, lambda: Bank(spark, {**frames, "actb_history": Bank.from_parquet(spark, f"{root}/bank", ["actb_history"])._loaders["actb_history"]})


def rows(df):
    return sorted(map(repr, df.collect()))


def test_second_refresh_reads_only_changed_days(spark, params, stored_bank):
    root, bank = stored_bank
    ledger = DayLedger(bank()["actb_history"], params, f"{root}/ledger")
    days = sorted(r[0] for r in bank()["actb_history"].select("trn_day").distinct().collect())
    assert ledger.refresh() == days and ledger.refresh() == []
    one = days[3]
    extra = bank()["actb_history"].filter(F.col("trn_day") == F.lit(one)).limit(3)
    extra.drop("trn_day").write.mode("append").parquet(f"{root}/bank/actb_history/trn_day={one}")
    new = days[-1] + timedelta(1)
    extra.drop("trn_day").withColumn("trn_dt", F.lit(datetime(new.year, new.month, new.day, 8)).cast("timestamp_ntz")).write.parquet(f"{root}/bank/actb_history/trn_day={new}")
    ledger = DayLedger(bank()["actb_history"], params, f"{root}/ledger")
    scan = next(x for x in ledger._rows_of([one, new])._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "PartitionFilters: [" in scan and "trn_day" in scan.split("PartitionFilters: [")[1]
    assert ledger.refresh() == [one, new] and ledger.refresh() == []
    gens = {g for _, g in ledger._manifest().values()}
    assert gens == {1, 2} and {d for d, (_, g) in ledger._manifest().items() if g == 2} == {one, new}
    whole = datetime(1990, 1, 1)
    assert rows(ledger.window(whole)) == rows(measure(bank()["actb_history"], params).select(*ledger.window(whole).columns))


def test_windows_with_parts_of_days_equal_the_history(spark, params, stored_bank):
    root, bank = stored_bank
    history = bank()["actb_history"]
    ledger = DayLedger(history, params, f"{root}/ledger")
    ledger.refresh()
    for start, end in (
        (datetime(2024, 1, 5, 9, 30), None), (datetime(2024, 1, 5), datetime(2024, 1, 9)), (datetime(2024, 1, 5, 9, 30), datetime(2024, 1, 9, 7)),
        (datetime(2024, 1, 5, 9), datetime(2024, 1, 5, 17)), (datetime(2024, 1, 5, 9), datetime(2024, 1, 6)), (datetime(2030, 1, 1, 5), None),
    ):
        got = ledger.window(start, end)
        assert rows(got) == rows(measure(since(history, start, end), params).select(*got.columns)), (start, end)


def test_unpublished_generation_is_not_seen(spark, params, stored_bank, tmp_path):
    _, bank = stored_bank
    ledger = DayLedger(bank()["actb_history"], params, str(tmp_path))
    ledger.history.limit(5).write.parquet(ledger._data(1))  # a driver lost before it published
    assert ledger._manifest() == {} and ledger.refresh()
    assert ledger.window(datetime(2000, 1, 1)).agg(F.sum("n")).first()[0] == ledger.history.count()
    assert DayLedger(ledger.history, params.with_(cash_threshold=1), str(tmp_path))._manifest() == {}


def test_history_without_files(spark, params, tmp_path):
    rows_ = [("T1", "A1", datetime(2024, 1, 1, 5)), ("T2", "A1", datetime(2024, 1, 2, 5)), ("T3", None, None)]
    make = lambda r: spark.createDataFrame(r, "trn_ref_no string, ac_no string, trn_dt timestamp_ntz").select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("drcr_ind", "string"), ("trn_code", "string"), ("module", "string"), ("lcy_amount", "decimal(22,3)"))])
    assert DayLedger(make(rows_), params, str(tmp_path)).refresh() == [date(2024, 1, 1), date(2024, 1, 2)]
    assert DayLedger(make(rows_), params, str(tmp_path)).refresh() == []
    changed = [*rows_[:1], ("T2b", "A1", datetime(2024, 1, 2, 5))]
    assert DayLedger(make(changed), params, str(tmp_path)).refresh() == [date(2024, 1, 2)]
    assert DayLedger(make(changed[:1]), params, str(tmp_path)).refresh() == []
    assert DayLedger(make(changed[:1]), params, str(tmp_path)).window(datetime(2024, 1, 1)).count() == 1


@pytest.mark.parametrize("check", ["AML-400", "AML-402", "AML-403", "AML-406", "AML-408", "AML-410"])
def test_checks_by_ledger_equal_direct_checks(spark, params, stored_bank, check):
    root, bank = stored_bank
    p = params.with_(as_of=AS_OF, busy_count=5)
    direct, by_ledger = Views(bank(), p), Views(bank(), p)
    by_ledger.ledger = DayLedger(bank()["actb_history"], p, f"{root}/ledger")
    by_ledger.ledger.refresh()
    want = rows(audit.metrics(direct, [audit.find_check(direct, check)]))
    assert rows(audit.metrics(by_ledger, [audit.find_check(by_ledger, check)])) == want and want
    for name in audit.find_check(direct, check).samples:
        assert rows(audit.check_sample(by_ledger, check, name)) == rows(audit.check_sample(direct, check, name))


@pytest.mark.parametrize("rule,name", [("8.0", ""), ("8.10", ""), ("8.12", ""), ("8.13", ""), ("8.14", "modules"), ("8.15", "")])
def test_rules_by_ledger_equal_direct_rules(spark, params, stored_bank, rule, name):
    root, bank = stored_bank
    p = params.with_(as_of=AS_OF)
    direct, by_ledger = Views(bank(), p), Views(bank(), p)
    by_ledger.ledger = DayLedger(bank()["actb_history"], p, f"{root}/ledger")
    by_ledger.ledger.refresh()
    assert rows(coherence.rule_sample(by_ledger, rule, name)) == rows(coherence.rule_sample(direct, rule, name))
