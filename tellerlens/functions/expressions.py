"""Column expressions shared by all operators. All of them stay in generated JVM code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

#: Amounts before they are shown: the scale in which they are declared.
EXACT = DecimalType(38, 3)


def ts(moment: datetime) -> Column:
    """Zone-free timestamp literal (foldable, so comparisons with it reach the scan)."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def is_blank(col: Column, mode: str = "space") -> Column:
    """``space``: NULL, empty or one space. ``trim``: NULL, empty or spaces only."""
    if mode == "space":
        return col.isNull() | col.isin("", " ")
    return col.isNull() | (F.trim(col) == "")


def is_set(col: Column, mode: str = "space") -> Column:
    if mode == "space":
        return col.isNotNull() & ~col.isin("", " ")
    return col.isNotNull() & (F.trim(col) != "")


def not_equal_or_null(col: Column, value: str) -> Column:
    return col.isNull() | (col != value)


def not_in_or_null(col: Column, values) -> Column:
    return col.isNull() | ~col.isin(*values)


def trimmed_differ(left: Column, right: Column, upper: bool = False) -> Column:
    """Both texts carry something and differ once padding (and case) is ignored."""
    a, b = F.trim(left), F.trim(right)
    if upper:
        a, b = F.upper(a), F.upper(b)
    return is_set(left, "trim") & is_set(right, "trim") & (a != b)


def maps_to_other(left: Column, right: Column, code_map: dict[str, str]) -> Column:
    """``left`` holds a mapped code and ``right`` is not its counterpart."""
    expected = F.create_map(*[F.lit(x) for pair in code_map.items() for x in pair])
    return right != expected[left]


def years_since(col: Column, as_of: datetime) -> Column:
    """Fractional age in years; two month ends, or two equal days, give whole months."""
    return F.months_between(ts(as_of), col, False) / 12


def days_since(col: Column, as_of: datetime) -> Column:
    """Whole days elapsed, time of day included. A zone-free difference is an interval."""
    return F.extract(F.lit("DAY"), ts(as_of) - col).cast("bigint")


def hour_index(col: Column) -> Column:
    """Hours since the epoch, read off the calendar fields (no zone involved)."""
    return F.unix_date(F.to_date(col)).cast("bigint") * 24 + F.hour(col)


def micro_index(col: Column) -> Column:
    """Microseconds since the epoch, read off the calendar fields."""
    seconds = hour_index(col) * 3600 + F.minute(col) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("bigint")


def expired(col: Column, as_of: datetime) -> Column:
    return col.isNotNull() & (col < ts(as_of))


def key_segment(key: Column, n: int, sep: str = "~") -> Column:
    """``n``-th piece of a separated key that is itself closed by a separator; NULL when the key
    has fewer separators or the piece is empty."""
    piece = F.split_part(key, F.lit(sep), F.lit(n))
    enough = F.length(key) - F.length(F.replace(key, F.lit(sep), F.lit(""))) >= n
    return F.when(enough & (piece != ""), piece)


def without_last_char(key: Column) -> Column:
    cut = F.substring(key, F.lit(1), F.length(key) - 1)
    return F.when(F.length(key) > 1, cut)


def percent_of(n: Column, total: Column) -> Column:
    """Share in percent, one decimal, halves rounded up, by integer steps; NULL on an empty total."""
    tenths = F.call_function("div", n * 2000 + total, total * 2)
    return F.when(total > 0, (tenths.cast("decimal(18,0)") / 10).cast("decimal(18,1)"))


def money(col: Column) -> Column:
    return col.cast("decimal(38,2)")


def exact(col: Column) -> Column:
    """An amount in the declared scale, for partial sums and comparisons; ``money`` is for what is shown."""
    return col.cast(EXACT)
