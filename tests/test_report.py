import os

import pytest

from tellerlens.plans import audit, coherence
from tellerlens.plans.report import Run, Section, shared_folder
from tellerlens.plans.views import Views
from tellerlens.sources.bank import Bank
from tellerlens.sources.starbank import star_bank
from tests.conftest import DATA


def key(r):
    return (r["check_id"], r["metric"], r["grp"] or "", r["n"] or 0, float(r["amount"] or 0))


def test_audit_run_writes_what_the_checks_compute(spark, params, tmp_path):
    bank = star_bank(spark, DATA)
    run = Run(bank, params, str(tmp_path / "work")).prepare()
    out = str(tmp_path / "out")
    run.write_audit(out)
    written = spark.read.parquet(f"{out}/audit_metrics")
    direct = audit.metrics(Views(star_bank(spark, DATA), params))
    assert sorted(map(key, written.collect())) == sorted(map(key, direct.collect()))
    assert spark.read.parquet(f"{out}/audit_findings").count() > 10
    samples = spark.read.parquet(f"{out}/audit_samples")
    assert {"check_id", "sample", "rank", "row"} <= set(samples.columns) and samples.count() > 100
    assert "trn_day" in run.recent_views.bank["actb_history"].columns


def test_lost_run_goes_on_where_it_stopped(spark, params, tmp_path):
    """A run that dies in the middle and is begun anew equals an unbroken one, and repeats no finished section."""
    bank = star_bank(spark, DATA)
    wanted = ["profile_volumes", "profile_categories", "profile_field_previews", "audit_metrics", "audit_findings"]
    cheap = lambda v: audit.metrics(v, [audit.find_check(v, c) for c in ("AML-101", "AML-402", "AML-408")])

    def sections(run, root):
        run.audit_metrics = lambda: cheap(run.recent_views)
        found = {s.name: s for s in [*run.profile_sections(), *run.audit_sections(root)]}
        return [found[n] for n in wanted]

    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    one = Run(bank, params, str(tmp_path / "work1"), str(tmp_path / "ledger"))
    assert one.write(whole, sections(one, whole)) == wanted

    lost = Run(bank, params, str(tmp_path / "work2"))
    parts = sections(lost, broken)

    def dies():
        raise RuntimeError("driver lost")

    with pytest.raises(RuntimeError):
        lost.write(broken, [*parts[:3], Section(parts[3].name, parts[3].kind, dies)])
    # Half-written rows stand where the lost driver left them: beside the result, not in it.
    spark.range(3).write.parquet(f"{broken}/_staging/{lost.key}/audit_metrics")
    kept = os.path.getmtime(f"{lost.folder}/totals/_SUCCESS")
    again = Run(bank, params, str(tmp_path / "work2"))
    assert again.finished(broken) == sorted(wanted[:3])
    assert again.write(broken, sections(again, broken)) == wanted[3:]
    assert os.path.getmtime(f"{again.folder}/totals/_SUCCESS") == kept
    assert again.write(broken, sections(again, broken)) == []
    for kind in wanted:
        rows = [sorted(map(repr, spark.read.parquet(f"{root}/{kind}").collect())) for root in (whole, broken)]
        assert rows[0] == rows[1] and rows[0]
    again.close()
    assert not os.path.exists(again.folder)
    other = Run(bank, params.with_(busy_count=7), str(tmp_path / "work2"))
    assert other.finished(broken) == [] and other.write(broken, sections(other, broken)[:1]) == wanted[:1]
    assert again.finished(broken) == []  # replaced by the run with other thresholds


def test_write_all_closes_the_run(spark, params, tmp_path, monkeypatch):
    bank = star_bank(spark, DATA)
    for name in ("profile_sections", "audit_sections", "coherence_sections"):
        whole = getattr(Run, name)
        monkeypatch.setattr(Run, name, lambda self, *a, whole=whole: [s for s in whole(self, *a) if s.name in ("profile_volumes", "profile_cross_checks", "audit_samples-0", "coherence_samples-1")])
    run = Run(bank, params, str(tmp_path / "work"))
    out = str(tmp_path / "out")
    assert run.write_all(out) == ["profile_volumes", "profile_cross_checks", "audit_samples-0", "coherence_samples-1"]
    assert not os.path.exists(run.folder) and not os.path.exists(f"{out}/_staging/{run.key}")
    assert run.write_all(out) == []
    names = {(r["check_id"], r["sample"]) for r in spark.read.parquet(f"{out}/coherence_samples").collect()}
    assert names <= {(r.id, n) for r in coherence.all_rules() for n in r.samples} and names
    assert run.restart(out).finished(out) == []


def test_machine_local_folder_is_refused_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    for folder in ("/tmp/x", "file:///tmp/x"):
        with pytest.raises(ValueError):
            shared_folder(Session, folder)
    assert shared_folder(Session, "hdfs://name/x/") == "hdfs://name/x"


def test_bank_round_trip_through_parquet(spark, params, tmp_path):
    bank = star_bank(spark, DATA)
    for name in ("sttm_customer", "sttm_cust_account"):
        bank[name].write.parquet(str(tmp_path / "bank" / name))
    again = Bank.from_parquet(spark, str(tmp_path / "bank"))
    assert "sttm_customer" in again and "aaml_sir_details" not in again
    assert again["sttm_customer"].dtypes == bank["sttm_customer"].dtypes
    assert again["sttm_cust_account"].exceptAll(bank["sttm_cust_account"]).count() == 0


def test_missing_columns_and_empty_text_become_null(spark, tmp_path):
    spark.createDataFrame([("", "C1", 7)], "CUST_CAT string, CUST_CAT_DESC string, extra int").write.parquet(
        str(tmp_path / "sttm_customer_cat"))
    row = Bank.from_parquet(spark, str(tmp_path))["sttm_customer_cat"].collect()[0]
    assert row.asDict() == {"cust_cat": None, "cust_cat_desc": "C1", "auth_stat": None}
