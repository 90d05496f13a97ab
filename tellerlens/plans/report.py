"""Whole runs: profiling, user-field, audit and coherence results written to a folder.

What many checks share is computed once and written to the cluster's shared folder before the
checks read it: the account summaries per holder, and the slice of the history that dated checks
look at. A lost executor then costs a re-read, not a recomputation, and plans stay short.

A run is a list of sections. Each is written beside its place, moved there whole, and then marked as
finished, so a run whose driver was lost goes on with the first section that is not marked. Shared
tables are found again the same way. What a finished run kept for itself is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellerlens.operators.accounts import holder_totals, open_summary
from tellerlens.operators.ledger import DayLedger
from tellerlens.operators.relations import union_all
from tellerlens.operators.transactions import since
from tellerlens.params import RunParams
from tellerlens.plans import audit, coherence, profile
from tellerlens.plans.views import Views
from tellerlens.sources.bank import Bank
from tellerlens.sources.schemas import DAY_COLUMN
from tellerlens.sources.sinks import as_sample_rows, committed, exists, list_names, publish, remove, touch

SHARED_DIR = "spark.checkpoint.dir"
HISTORY_COLUMNS = (
    "trn_ref_no", "ac_no", "drcr_ind", "trn_code", "module", "related_customer", "lcy_amount", "trn_dt",
)


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder the cluster shares between executors; ``fallback`` is for single-machine use."""
    folder = spark.conf.get(SHARED_DIR, None) or fallback
    if not folder:
        raise ValueError(f"{SHARED_DIR} is not set and no fallback folder was given")
    single = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not spark.conf.get(SHARED_DIR, None) and not single and ("://" not in folder or folder.startswith("file:")):
        raise ValueError(f"{folder} is local to a machine: set {SHARED_DIR} to a folder that the cluster shares")
    return folder.rstrip("/")


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors, and of the driver."""
    path = f"{folder}/{name}"
    if not committed(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dated_slice(bank: Bank, params: RunParams) -> DataFrame:
    """Columns and rows of the history that dated checks can reach, with their day."""
    start = min(params.months_ago(12), params.days_ago(max(params.window_days, params.short_window_days)))
    recent = since(bank["actb_history"], start).select(*HISTORY_COLUMNS)
    return recent.withColumn(DAY_COLUMN, F.to_date("trn_dt"))


@dataclass(frozen=True)
class Section:
    """One result of a run: its name, its folder below the root, and how its rows are built (only when needed)."""

    name: str
    kind: str
    build: Callable[[], DataFrame]


class Run:
    """One analysis run over a bank. ``work_folder`` holds its intermediate tables where the cluster names no
    shared folder. With a ``ledger_folder``, dated checks add up the account-day ledger kept there."""

    def __init__(self, bank: Bank, params: RunParams, work_folder: str | None = None, ledger_folder: str | None = None):
        self.bank, self.params = bank, params
        self.run_id = f"{params.as_of:%Y%m%dT%H%M%S}"
        #: Runs with the same date but other thresholds do not take over each other's sections.
        self.key = f"{self.run_id}-{hashlib.md5(repr(params).encode()).hexdigest()[:8]}"
        self.folder = f"{shared_folder(bank.spark, work_folder)}/run-{self.key}"
        self.ledger_folder = ledger_folder
        self.views = Views(bank, params)
        self.recent_views = self.views
        self._prepared = False

    def prepare(self) -> "Run":
        """Compute what the checks share. The dated slice is laid out by day, so each window
        reads only its days."""
        if self._prepared:
            return self
        accounts = self.bank["sttm_cust_account"]
        opened = stored(open_summary(accounts), self.folder, "open_accounts")
        totals = stored(holder_totals(accounts), self.folder, "totals")
        hot_refs = self.views.hot_refs
        if hot_refs is not None:
            hot_refs = stored(hot_refs, self.folder, "hot_refs")
        path = f"{self.folder}/recent_history"
        if not committed(self.bank.spark, path):
            # A day's rows go to a bounded number of tasks, so that a day has few files and no day just one writer.
            slices = dated_slice(self.bank, self.params).repartition(DAY_COLUMN, F.pmod(F.hash("ac_no"), F.lit(8)))
            slices.write.mode("overwrite").partitionBy(DAY_COLUMN).parquet(path)
        recent = self.bank.spark.read.parquet(path)
        ledger = None
        if self.ledger_folder:
            ledger = DayLedger(self.bank["actb_history"], self.params, self.ledger_folder)
            ledger.refresh()
        for views in (self.views, Views(self.bank.replacing(actb_history=recent), self.params)):
            views.keep("open_accounts", opened)
            views.keep("totals", totals)
            views.keep("hot_refs", hot_refs)
            views.ledger = ledger
            self.recent_views = views
        self._prepared = True
        return self

    # -- sections ------------------------------------------------------------------------------
    def audit_metrics(self) -> DataFrame:
        dated = [c for c in audit.CHECK_IDS if c.startswith("AML-4")]
        other = [c for c in audit.CHECK_IDS if c not in dated]
        parts = [
            audit.metrics(v, [audit.find_check(v, c) for c in ids])
            for v, ids in ((self.views, other), (self.recent_views, dated))
        ]
        return union_all(parts)

    def _audit_views(self, check_id: str) -> Views:
        return self.recent_views if check_id.startswith("AML-4") else self.views

    def audit_sections(self, root: str) -> Iterator[Section]:
        yield Section("audit_metrics", "audit_metrics", self.audit_metrics)
        yield Section("audit_findings", "audit_findings", lambda: audit.findings(self.views, self._written(root, "audit_metrics")))
        names = [(c, n) for c in audit.CHECK_IDS for n in audit.find_check(self.views, c).samples]
        yield from _batches("audit_samples", names, lambda c, n: audit.check_sample(self._audit_views(c), c, n))

    def verdicts(self) -> DataFrame:
        rules = coherence.all_rules()
        banks = [r for r in rules if r.section == 8]
        others = [r for r in rules if r.section != 8]
        counted = union_all([
            coherence.rule_counts(self.views, others), coherence.rule_counts(self.recent_views, banks),
        ])
        titles = self.bank.spark.createDataFrame(
            [(r.id, r.section, r.title) for r in rules], "rule_id string, section int, title string"
        )
        return counted.join(F.broadcast(titles), "rule_id")

    def coherence_sections(self, root: str) -> Iterator[Section]:
        yield Section("coherence_verdicts", "coherence_verdicts", self.verdicts)
        yield Section("coherence_totals", "coherence_totals", lambda: coherence.totals(self._written(root, "coherence_verdicts")))
        names = [(r.id, n) for r in coherence.all_rules() for n in r.samples]
        # Rule 8.0 looks at whole calendar years, which may begin before the dated slice.
        views = lambda rule: self.recent_views if rule.startswith("8.") and rule != "8.0" else self.views
        yield from _batches("coherence_samples", names, lambda r, n: coherence.rule_sample(views(r), r, n))

    def profile_sections(self) -> Iterator[Section]:
        v = self.views

        def tagged(build, tables):
            return lambda: union_all([build(v, t).select(F.lit(t).alias("table_name"), "*") for t in tables])

        for name, build, tables in (
            ("frequencies", profile.frequencies, profile.FREQUENCIES), ("top_values", profile.top_values, profile.TOP_TEN),
            ("counts", profile.counts, profile.COUNTS), ("statistics", profile.statistics, profile.STATS),
        ):
            yield Section(f"profile_{name}", f"profile_{name}", tagged(build, tables))
        for name, build in (
            ("volumes", profile.volumes), ("date_ranges", profile.date_ranges), ("cross_checks", profile.cross_checks),
            ("clients_per_year", profile.clients_per_year), ("transactions_per_year", profile.transactions_per_year),
            ("risk_by_type", profile.risk_by_type), ("accounts_per_client", profile.accounts_per_client),
            ("keypersons_per_file", profile.keypersons_per_file), ("keyperson_files", profile.keyperson_files),
            ("first_classes", profile.first_classes), ("categories", profile.categories),
            ("field_previews", profile.field_previews),
        ):
            yield Section(f"profile_{name}", f"profile_{name}", lambda build=build: build(v))

    # -- writing -------------------------------------------------------------------------------
    def _target(self, root: str, kind: str) -> str:
        return f"{root.rstrip('/')}/{kind}/run_id={self.run_id}"

    def _written(self, root: str, kind: str) -> DataFrame:
        return self.bank.spark.read.parquet(self._target(root, kind))

    def _marks(self, root: str) -> str:
        return f"{root.rstrip('/')}/_runs/{self.key}"

    def finished(self, root: str) -> list[str]:
        """Names of the sections that are in place."""
        return [n.removesuffix(".done") for n in list_names(self.bank.spark, self._marks(root)) if n.endswith(".done")]

    def restart(self, root: str) -> "Run":
        """Forget what was finished: the next write does it all again, shared tables too."""
        remove(self.bank.spark, self._marks(root))
        self.close()
        return self

    def write(self, root: str, sections: Iterator[Section]) -> list[str]:
        """Write the sections that are not finished; returns their names."""
        spark, wrote = self.bank.spark, []
        for other in list_names(spark, f"{root.rstrip('/')}/_runs"):
            if other.startswith(f"{self.run_id}-") and other != self.key:
                remove(spark, f"{root.rstrip('/')}/_runs/{other}")  # this run replaces what they wrote
        for section in sections:
            mark = f"{self._marks(root)}/{section.name}.done"
            if exists(spark, mark):
                continue
            self.prepare()
            publish(section.build(), self._target(root, section.kind), f"{root.rstrip('/')}/_staging/{self.key}/{section.name}")
            touch(spark, mark)
            wrote.append(section.name)
        return wrote

    def write_audit(self, root: str) -> list[str]:
        return self.write(root, self.audit_sections(root))

    def write_coherence(self, root: str) -> list[str]:
        return self.write(root, self.coherence_sections(root))

    def write_profile(self, root: str) -> list[str]:
        return self.write(root, self.profile_sections())

    def write_all(self, root: str) -> list[str]:
        """Everything that is missing; then the run's own tables go."""
        wrote = self.write_profile(root) + self.write_audit(root) + self.write_coherence(root)
        self.close()
        remove(self.bank.spark, f"{root.rstrip('/')}/_staging/{self.key}")
        return wrote

    def close(self) -> None:
        """Remove the run's own tables; a later write makes them again."""
        remove(self.bank.spark, self.folder)
        self._prepared, self.views = False, Views(self.bank, self.params)
        self.recent_views = self.views


def _batches(kind: str, names: list[tuple[str, str]], build: Callable[[str, str], DataFrame], size: int = 12) -> Iterator[Section]:
    """Samples are small but their plans are not: a section holds a dozen."""
    for i in range(0, len(names), size):
        own = names[i : i + size]
        yield Section(
            f"{kind}-{i // size}", f"{kind}/part={i // size}",
            lambda own=own: union_all([as_sample_rows(build(c, n), c, n) for c, n in own]),
        )
