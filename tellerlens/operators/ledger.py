"""Account-day ledger: what the dated checks add up, kept per account, module and day between runs.

A refresh compares a mark of every day of the history with the marks of the last refresh and rebuilds
only days that are new or changed. Marks come from the files that hold a day (path, size, time) where
the history is read from files, so that nothing but dates is read to make them; otherwise from the rows.

Each refresh writes its days as a generation and then publishes a manifest that says which generation
holds which day. A manifest counts only once Spark has committed it, so a driver that is lost in
between leaves the last one in force and the next refresh does the same work again.

A window that begins or ends within a day takes its whole days from the ledger and measures the rows
of the first and last day directly: results equal those over the history.
"""

from __future__ import annotations

import hashlib
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellerlens.functions.expressions import exact, ts
from tellerlens.operators.relations import union_all
from tellerlens.params import RunParams
from tellerlens.sources.schemas import DAY_COLUMN
from tellerlens.sources.sinks import committed, list_names

KEYS = ("ac_no", "module", DAY_COLUMN)
#: Generations after which a refresh writes the whole ledger anew.
MOST_GENERATIONS = 30


def measure(rows: DataFrame, params: RunParams) -> DataFrame:
    """Counts and sums per account, module and day. Map-side combine leaves one row per group and task."""
    amount, side = F.col("lcy_amount"), F.col("drcr_ind")
    small = F.col("trn_code").isin(*params.cash_codes) & (amount > params.structuring_floor) & (amount < params.cash_threshold)
    even = (amount >= params.round_unit) & (amount % params.round_unit == 0)
    exposed = amount >= params.exposed_amount
    total = lambda col: exact(F.sum(col))
    return rows.groupBy("ac_no", "module", F.to_date("trn_dt").alias(DAY_COLUMN)).agg(
        F.count("*").alias("n"), total(amount).alias("volume"), F.count("trn_ref_no").alias("n_refs"),
        total(F.when(side == "D", amount).otherwise(0)).alias("debit"), total(F.when(side == "C", amount).otherwise(0)).alias("credit"),
        exact(F.max(amount)).alias("max_amount"), F.count_if(amount > params.low_balance_txn).alias("n_over"),
        F.count_if(small).alias("n_small"), total(F.when(small, amount)).alias("small"),
        F.count_if(even).alias("n_even"), total(F.when(even, amount)).alias("even"),
        F.count_if(exposed).alias("n_exposed"), total(F.when(exposed, amount)).alias("exposed"),
        F.count_if(exposed & (amount >= params.high_risk_amount)).alias("n_high"),
    )


def _rules(params: RunParams) -> str:
    """The thresholds and codes that the measures hold; another set of them has another ledger."""
    parts = (params.cash_codes, params.structuring_floor, params.cash_threshold, params.round_unit, params.exposed_amount, params.high_risk_amount, params.low_balance_txn)
    return hashlib.md5(repr(parts).encode()).hexdigest()[:12]


def day_marks(history: DataFrame) -> DataFrame:
    """(day, mark): one number per day that changes when the day's files, or else its rows, change."""
    day = (F.col(DAY_COLUMN) if DAY_COLUMN in history.columns else F.to_date("trn_dt")).alias("day")
    try:
        files = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        per_file = history.select(day, files.alias("file")).groupBy("day", "file").agg(F.count("*").alias("n"))
        return per_file.groupBy("day").agg(F.bit_xor(F.xxhash64("file", "n")).alias("mark"))
    except AnalysisException:  # no files below: a join, a union, another kind of source
        rows = history.select(day, F.xxhash64(*[c for c in history.columns]).alias("row"))
        low = F.pmod("row", F.lit(1 << 31)).cast("decimal(38,0)")
        return rows.groupBy("day").agg(F.xxhash64(F.count("*"), F.bit_xor("row"), F.sum(low)).alias("mark"))


class DayLedger:
    """The ledger of one history below ``folder``, for one set of thresholds."""

    def __init__(self, history: DataFrame, params: RunParams, folder: str):
        self.history, self.params, self.spark = history, params, history.sparkSession
        self.folder = f"{folder.rstrip('/')}/rules={_rules(params)}"

    def _generations(self) -> list[int]:
        names = list_names(self.spark, f"{self.folder}/manifest")
        found = sorted(int(n.split("=")[1]) for n in names if n.startswith("gen="))
        return [g for g in found if committed(self.spark, f"{self.folder}/manifest/gen={g}")]

    def _manifest(self) -> dict[date, tuple[int, int]]:
        """day: (mark, generation that holds it). One row per day reaches the driver."""
        last = self._generations()[-1:]
        if not last:
            return {}
        return {r["day"]: (r["mark"], r["held_by"]) for r in self.spark.read.parquet(f"{self.folder}/manifest/gen={last[0]}").collect()}

    def _rows_of(self, days: list[date]) -> DataFrame:
        first, last = days[0], days[-1]
        rows = self.history.filter((F.col("trn_dt") >= ts(_midnight(first))) & (F.col("trn_dt") < ts(_midnight(last + timedelta(1)))))
        if DAY_COLUMN in rows.columns:  # prunes folders
            rows = rows.filter(F.col(DAY_COLUMN).isin(days))
        return rows.filter(F.to_date("trn_dt").isin(days))

    def refresh(self) -> list[date]:
        """Rebuild new and changed days; returns them. Days that left the history leave the ledger."""
        marks = {r["day"]: r["mark"] for r in day_marks(self.history).collect() if r["day"] is not None}
        known, gens = self._manifest(), self._generations()
        changed = sorted(d for d, m in marks.items() if known.get(d, (None,))[0] != m)
        if not changed and set(known) == set(marks):
            return []
        gen = gens[-1] + 1 if gens else 1
        held = {d: g for d, (_, g) in known.items() if d in marks and d not in changed}
        fresh = [measure(self._rows_of(changed), self.params)] if changed else []
        if len({*held.values()}) >= MOST_GENERATIONS:
            fresh.append(self._stored(held))
            held = {}
        if fresh:
            # A day's rows go to a bounded number of files, and no day has just one writer.
            spread = union_all(fresh).repartition(DAY_COLUMN, F.pmod(F.hash("ac_no"), F.lit(8)))
            spread.write.mode("overwrite").partitionBy(DAY_COLUMN).parquet(self._data(gen))
        rows = [(d, m, held.get(d, gen)) for d, m in sorted(marks.items())]
        manifest = self.spark.createDataFrame(rows, "day date, mark bigint, held_by int")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/gen={gen}")
        return changed

    def _data(self, gen: int) -> str:
        return f"{self.folder}/days/gen={gen}"

    def _stored(self, held: dict[date, int]) -> DataFrame:
        """Rows of the days, each from its generation."""
        schema = measure(self.history, self.params).schema
        by_gen: dict[int, list[date]] = {}
        for d, g in held.items():
            by_gen.setdefault(g, []).append(d)
        parts = [
            self.spark.read.schema(schema).parquet(self._data(g)).filter(F.col(DAY_COLUMN).isin(sorted(days))).select(*schema.names)
            for g, days in sorted(by_gen.items())
        ]
        return union_all(parts) if parts else self.spark.createDataFrame([], schema)

    def window(self, start: datetime, end: datetime | None = None) -> DataFrame:
        """Ledger rows of the transactions from ``start`` on (and before ``end``)."""
        first = start.date() if start == _midnight(start.date()) else start.date() + timedelta(1)
        held = {d: g for d, (_, g) in self._manifest().items()}
        if end is not None and end <= _midnight(first):
            return measure(self._between(start, end), self.params)
        whole = {d: g for d, g in held.items() if d >= first and (end is None or d < end.date())}
        parts = [self._stored(whole)]
        if start < _midnight(first):
            parts.append(measure(self._between(start, _midnight(first)), self.params))
        if end is not None and end > _midnight(end.date()):
            parts.append(measure(self._between(_midnight(end.date()), end), self.params))
        return union_all([p.select(*parts[0].columns) for p in parts])

    def _between(self, start: datetime, end: datetime) -> DataFrame:
        rows = self.history.filter((F.col("trn_dt") >= ts(start)) & (F.col("trn_dt") < ts(end)))
        if DAY_COLUMN in rows.columns:
            rows = rows.filter(F.col(DAY_COLUMN).between(F.lit(start.date()), F.lit(end.date())))
        return rows

    def activity(self, start: datetime, n: str = "n", volume: str = "volume", *more: str) -> DataFrame:
        """(ac_no, n, volume, *more) of one kind of transactions since ``start``."""
        rows = self.window(start).filter(F.col(n) > 0)
        return rows.groupBy("ac_no").agg(
            F.sum(n).alias("n"), exact(F.sum(volume)).alias("volume"), *[F.sum(c).alias(c) for c in more]
        )


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day)
