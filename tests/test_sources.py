"""Stored banks by any name; JDBC tables split by their size, without a server: a stand-in answers the reader."""

import re

import pytest

from tellerlens.plans import audit
from tellerlens.plans.views import Views
from tellerlens.sources.bank import Bank
from tellerlens.sources.schemas import OPTIONAL_TABLES, SCHEMAS


def test_folders_in_any_case_and_files(spark, tmp_path):
    cats = spark.createDataFrame([("A", "first")], "CUST_CAT string, CUST_CAT_DESC string")
    cats.write.parquet(str(tmp_path / "STTM_CUSTOMER_CAT"))
    spark.createDataFrame([("C1",)], "customer_no string").write.parquet(str(tmp_path / "Sttm_Customer.parquet"))
    spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "notes"))
    bank = Bank.from_parquet(spark, str(tmp_path))
    assert bank["sttm_customer_cat"].first()["cust_cat"] == "A" and bank["sttm_customer"].first()["customer_no"] == "C1"
    assert "notes" not in bank and "sttm_kyc_master" not in bank
    cats.write.parquet(str(tmp_path / "sttm_customer_cat.parquet"))
    with pytest.raises(ValueError, match="twice"):
        Bank.from_parquet(spark, str(tmp_path))


class StandIn:
    """Answers counts, bounds and reads, and notes what it was asked."""

    def __init__(self, spark, rows, missing=(), bounds=(1, 1000)):
        self.spark, self.rows, self.missing, self.bounds, self.reads = spark, rows, missing, bounds, []

    def __call__(self, source, options):
        if any(m in source for m in self.missing):
            raise RuntimeError("ORA-00942: table or view does not exist")
        if source.startswith("("):
            if "MIN(" in source:
                return self.spark.createDataFrame([(self.rows, *self.bounds)], "N long, LOW long, HIGH long")
            return self.spark.createDataFrame([(0 if "1 = 0" in source else self.rows,)], "n long")
        self.reads.append((source, dict(options)))
        name = re.sub(r".*\.", "", source)
        return self.spark.createDataFrame([], SCHEMAS[name])


def test_jdbc_tables_are_split_by_size(spark):
    small = StandIn(spark, 50)
    Bank.from_jdbc(spark, "jdbc:x", schema="core", read=small)["sttm_customer"]
    assert small.reads == [("core.sttm_customer", {})]
    large = StandIn(spark, 1001)
    Bank.from_jdbc(spark, "jdbc:x", split={"actb_history": "ac_entry_sr_no"}, rows_per_task=100, read=large)["actb_history"]
    assert large.reads == [("actb_history", {"partitionColumn": "ac_entry_sr_no", "lowerBound": "1", "upperBound": "1000", "numPartitions": "11"})]
    with pytest.raises(ValueError, match="one task"):
        Bank.from_jdbc(spark, "jdbc:x", rows_per_task=100, read=large)["sttm_customer"]
    with pytest.raises(ValueError, match="always NULL"):
        Bank.from_jdbc(spark, "jdbc:x", split={"actb_history": "k"}, rows_per_task=100, read=StandIn(spark, 1001, bounds=(None, None)))["actb_history"]
    own = {"partitionColumn": "k", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    Bank.from_jdbc(spark, "jdbc:x", split={"actb_history": own}, rows_per_task=100, read=large)["actb_history"]
    assert large.reads[-1] == ("actb_history", own)


def test_absent_optional_table_over_jdbc(spark, params):
    bank = Bank.from_jdbc(spark, "jdbc:x", read=StandIn(spark, 5, missing=OPTIONAL_TABLES))
    assert not any(n in bank for n in OPTIONAL_TABLES) and "sttm_customer" in bank
    v = Views(bank, params)
    check = audit.find_check(v, "AML-409")
    found = audit.findings(v, audit.metrics(v, [check]), [check]).collect()
    assert [(r["severity"], r["metric"]) for r in found] == [("INFO", "alert_table_missing")]
    assert all(n in Bank.from_jdbc(spark, "jdbc:x", read=StandIn(spark, 5)) for n in OPTIONAL_TABLES)

    def broken(source, options):
        raise RuntimeError("connection refused")

    with pytest.raises(RuntimeError, match="refused"):
        Bank.from_jdbc(spark, "jdbc:x", read=broken)
