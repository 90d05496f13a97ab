"""Join views that checks and rules select from.

Each view joins exactly the tables its rules join, so that repeated KYC references multiply rows
the way the rules expect; nothing is assumed unique. Views are named by their table aliases:
c customer, p personal, m KYC master, r KYC retail, k KYC corporate, a account, b ledger mirror,
o open-account summary, u user-defined fields, t category reference. A trailing x marks an outer side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellerlens.operators.accounts import holder_flags, holder_totals, open_summary
from tellerlens.operators.ledger import DayLedger
from tellerlens.operators.relations import lookup
from tellerlens.operators.skew import hot_keys, spread_join
from tellerlens.operators.udf_views import client_fields
from tellerlens.params import RunParams
from tellerlens.sources.bank import Bank

_ALIASES = {
    "c": "sttm_customer", "p": "sttm_cust_personal", "m": "sttm_kyc_master", "r": "sttm_kyc_retail",
    "k": "sttm_kyc_corporate", "a": "sttm_cust_account", "b": "sttb_account", "h": "actb_history",
    "u": "cstm_function_userdef_fields", "t": "sttm_customer_cat", "kp": "sttm_kyc_corp_keypersons",
    "ac": "sttm_account_class",
}


class Views:
    def __init__(self, bank: Bank, params: RunParams):
        self.bank, self.params = bank, params
        self._kept: dict[str, DataFrame | None] = {}
        #: Answers what dated checks add up, where a run keeps one.
        self.ledger: DayLedger | None = None

    def table(self, alias: str) -> DataFrame:
        return self.bank[_ALIASES[alias]].alias(alias)

    def __call__(self, name: str) -> DataFrame:
        """A view by name: one table alias, or one of the joins below."""
        if name in _ALIASES:
            return self.table(name)
        return getattr(self, f"_{name}")()

    def keep(self, name: str, df: DataFrame | None) -> None:
        """Answer ``name`` from a stored copy from now on (before its first use)."""
        self._kept[name] = df

    # -- per-holder facts ---------------------------------------------------------------------
    @cached_property
    def open_accounts(self) -> DataFrame:
        return self._kept.get("open_accounts", open_summary(self.bank["sttm_cust_account"]))

    @cached_property
    def totals(self) -> DataFrame:
        return self._kept.get("totals", holder_totals(self.bank["sttm_cust_account"]))

    @cached_property
    def open_totals(self) -> DataFrame:
        return self.open_accounts.select("cust_no", F.col("balance").alias("total_balance"))

    @cached_property
    def flags(self) -> DataFrame:
        return holder_flags(self.bank["sttm_cust_account"])

    @cached_property
    def hot_refs(self) -> DataFrame | None:
        """KYC references that many clients name (a blank one, say): these clients meet their files in slices."""
        if "hot_refs" in self._kept:
            return self._kept["hot_refs"]
        return hot_keys(self.bank["sttm_customer"], "kyc_ref_no")

    # -- inner joins along the client ---------------------------------------------------------
    def _join(self, left: DataFrame, alias: str, on: str, how: str = "inner") -> DataFrame:
        key, other = on, f"{alias}.{on.split('.')[1]}"
        return left.join(self.table(alias), F.col(key) == F.col(other), how)

    def by_reference(self, left: DataFrame, alias: str, key: str = "c.kyc_ref_no", how: str = "inner") -> DataFrame:
        """Clients with a KYC table, hot references in slices."""
        on = [F.col(key)], [F.col(f"{alias}.kyc_ref_no")]
        return spread_join(left, self.table(alias), *on, F.col("c.customer_no"), self.hot_refs, how)

    def _cp(self) -> DataFrame:
        return self._join(self.table("c"), "p", "c.customer_no")

    def _cr(self) -> DataFrame:
        return self.by_reference(self.table("c"), "r")

    def _cm(self) -> DataFrame:
        return self.by_reference(self.table("c"), "m")

    def _cpr(self) -> DataFrame:
        return self.by_reference(self._cp(), "r")

    def _cmr(self) -> DataFrame:
        return self.by_reference(self._cm(), "r", "m.kyc_ref_no")

    def _ab(self) -> DataFrame:
        on = (F.col("b.ac_gl_no") == F.col("a.cust_ac_no")) & (F.col("b.branch_code") == F.col("a.branch_code"))
        return self.table("a").join(self.table("b"), on)

    # -- with the open-account summary (NULL when the client has none) -------------------------
    def with_open(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(self.open_accounts.alias("o"), F.col("o.cust_no") == F.col(key), "left")

    def _co(self) -> DataFrame:
        return self.with_open(self.table("c"), "c.customer_no")

    def _po(self) -> DataFrame:
        return self.with_open(self.table("p"), "p.customer_no")

    def _rco(self) -> DataFrame:
        return self.with_open(self._cr(), "c.customer_no")

    def _mco(self) -> DataFrame:
        return self.with_open(self._cm(), "c.customer_no")

    def _mrco(self) -> DataFrame:
        return self.with_open(self._cmr(), "c.customer_no")

    def _pco(self) -> DataFrame:
        return self.with_open(self._cp(), "c.customer_no")

    def _prco(self) -> DataFrame:
        return self.with_open(self._cpr(), "c.customer_no")

    def _cpxo(self) -> DataFrame:
        left = self.table("c").join(self.table("p"), F.col("p.customer_no") == F.col("c.customer_no"), "left")
        return self.with_open(left, "c.customer_no")

    # -- optional sides ------------------------------------------------------------------------
    def optional(self, df: DataFrame, alias: str, key: str = "c.kyc_ref_no") -> DataFrame:
        return self.by_reference(df, alias, key, "left")

    def _cmxo(self) -> DataFrame:
        return self.optional(self._co(), "m")

    def _cmkxo(self) -> DataFrame:
        joined = self.optional(self._cm(), "k", "m.kyc_ref_no")
        return self.with_open(joined, "c.customer_no")

    def _cmrxo(self) -> DataFrame:
        joined = self.optional(self._cm(), "r", "m.kyc_ref_no")
        return self.with_open(joined, "c.customer_no")

    def _cprxo(self) -> DataFrame:
        left = self.table("c").join(self.table("p"), F.col("p.customer_no") == F.col("c.customer_no"), "left")
        return self.with_open(self.optional(left, "r"), "c.customer_no")

    def with_client_fields(self, df: DataFrame) -> DataFrame:
        uf = client_fields(self.bank["cstm_function_userdef_fields"]).alias("uf")
        return df.join(uf, F.concat(F.col("c.customer_no"), F.lit("~")) == F.col("uf.client_key"), "left")

    def with_category(self, df: DataFrame) -> DataFrame:
        cats = self.bank["sttm_customer_cat"].select("cust_cat", "cust_cat_desc").alias("t")
        return lookup(df, cats, F.col("c.customer_category"), F.col("t.cust_cat"), F.col("c.customer_no"))

    # -- derived lookups -------------------------------------------------------------------------
    @cached_property
    def first_client(self) -> DataFrame:
        """(ref, customer_no, customer_name): one client per KYC reference, the lowest number."""
        c = self.bank["sttm_customer"].filter(F.col("kyc_ref_no").isNotNull())
        pick = F.min(F.struct("customer_no", F.col("customer_name1").alias("customer_name")))
        return c.groupBy(F.col("kyc_ref_no").alias("ref")).agg(pick.alias("_c")).select(
            "ref", "_c.customer_no", "_c.customer_name"
        )


ViewSource = str | Callable[[Views], DataFrame]
