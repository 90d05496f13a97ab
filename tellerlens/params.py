"""Run parameters: the date of reference, thresholds and code lists of every check."""

from __future__ import annotations

import calendar
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

# --- fixed values: codes used by the core-banking system -----------------------------------
CASH_CODES = ("CASH", "CASD", "CAWT", "CADT", "CDEP", "CWIT", "CSHD", "CSHC", "CTLR")
TRANSFER_CODES = ("FTRN", "SWIFT", "TT", "RTGS", "WIRE", "FTTF", "FTTR", "TTIN", "TTOT", "IBFT")
RISK_COUNTRIES = (
    "IR", "KP", "SY", "YE", "LY", "SO", "SD", "MM", "AF", "IQ",
    "VE", "ZW", "CU", "HT", "LA", "BI", "ET", "GN", "CF", "SS",
)
SENSITIVE_CATEGORIES = (
    "PEP/FEPS", "BDC", "FOREIGN", "NRA1", "NRA2", "WALKIN", "GATEKEEPER", "WATCH CUST",
    "GAMING", "ECOMMERCE", "CRYPTRADE", "HIGHVALUE", "IMTO", "FTZ", "UNKNOWN",
)
INDIVIDUAL_CATEGORIES = (
    "INDV", "MINORS", "STUDENTS", "SENIORS", "CSE1", "CSE2", "PSE1", "PSE2", "PSE3", "PFBI",
    "VPFP", "SAL", "STAF", "RSA", "RSA1", "ABWP", "PEP/FEPS", "NRA1", "NRA2",
)
CORPORATE_CATEGORIES = (
    "CORP", "SME", "NGOs", "GOVT", "GOVT INST", "INSURANCE", "CONSTRUCTN", "HOSPITALIT",
    "OIL&GAS", "FIN_INT",
)
BANK_CATEGORIES = ("BANK", "FIN_INT", "OFI", "BDC")
NON_RESIDENT_CATEGORIES = ("NRA1", "NRA2", "FOREIGN")
CEMAC_COUNTRIES = ("CMR", "TCD", "GAB", "COG", "CAF", "GNQ")
CLOSED_ALERT_STATES = ("CLOSED", "FILED", "REJECTED")
SETTLED_ALERT_STATES = ("CLOSED", "FILED")
INTERBANK_MODULES = ("FT", "FX", "FS")
# --------------------------------------------------------------------------------------------


def shift_months(moment: datetime, months: int) -> datetime:
    """Calendar shift that keeps the time of day and maps a month end to a month end."""
    index = moment.year * 12 + moment.month - 1 + months
    year, month = divmod(index, 12)
    month += 1
    last = calendar.monthrange(year, month)[1]
    at_month_end = moment.day == calendar.monthrange(moment.year, moment.month)[1]
    return moment.replace(year=year, month=month, day=last if at_month_end else min(moment.day, last))


@dataclass(frozen=True)
class RunParams:
    """All values a run depends on besides the data. Bounds are computed once, on the driver,
    so that they reach the scans as literals."""

    as_of: datetime
    window_days: int = 90
    short_window_days: int = 30
    cash_threshold: int = 5_000_000
    structuring_floor: int = 500_000
    structuring_min_count: int = 3
    night_threshold: int = 500_000
    night_from_hour: int = 22
    night_to_hour: int = 6
    round_unit: int = 1_000_000
    round_min_count: int = 5
    pass_through_credit: int = 1_000_000
    pass_through_hours: int = 48
    pass_through_percent: int = 80
    busy_count: int = 100
    very_busy_count: int = 300
    exposed_amount: int = 1_000_000
    high_risk_amount: int = 5_000_000
    high_risk_level: str = "Level3"
    home_country: str = "CMR"
    alert_days: int = 3
    stale_alert_days: int = 30
    low_balance: int = 1_000
    low_balance_txn: int = 1_000_000
    credit_share: float = 0.5
    flow_years: tuple[int, ...] = (2024, 2025)
    majority_percent: int = 50
    income_multiple: int = 10
    cash_codes: tuple[str, ...] = CASH_CODES
    transfer_codes: tuple[str, ...] = TRANSFER_CODES
    risk_countries: tuple[str, ...] = RISK_COUNTRIES
    sensitive_categories: tuple[str, ...] = SENSITIVE_CATEGORIES
    profiling_individual_type: str = "I"
    coherence_individual_type: str = "R"

    def with_(self, **changes) -> "RunParams":
        return replace(self, **changes)

    def days_ago(self, days: int) -> datetime:
        return self.as_of - timedelta(days=days)

    def months_ago(self, months: int) -> datetime:
        return shift_months(self.as_of, -months)
