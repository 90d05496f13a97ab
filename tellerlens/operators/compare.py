"""Fields kept twice, categories against facts, and overdue dates: the predicates behind most
rules, and the row filters made of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellerlens.functions.expressions import is_set, maps_to_other, trimmed_differ, ts
from tellerlens.params import RunParams


def differs(left: str, right: str, kind: str = "text", code_map: Mapping[str, str] | None = None) -> Column:
    """Both sides carry a value and the values contradict each other. ``raw`` compares as they
    are, ``text`` without padding, ``upper`` without padding and case, ``code`` through a map."""
    a, b = F.col(left), F.col(right)
    if kind == "raw":
        return a != b
    if kind == "code":
        return is_set(b, "trim") & maps_to_other(F.trim(a), F.trim(b), dict(code_map or {}))
    return trimmed_differ(a, b, upper=kind == "upper")


def mismatch(
    left: DataFrame, right: DataFrame, keys: Mapping[str, str], a: str, b: str, kind: str = "text",
    code_map: Mapping[str, str] | None = None,
) -> DataFrame:
    """Joined rows whose fields ``a`` and ``b`` differ; ``keys`` maps left to right key columns."""
    on = F.lit(True)
    for l, r in keys.items():
        on = on & (F.col(l) == F.col(r))
    return left.join(right, on).filter(differs(a, b, kind, code_map))


def in_category(column: str, category: str | tuple[str, ...], test: Column) -> Column:
    """A client of the category (or of one of several) for whom the test holds."""
    wanted = (category,) if isinstance(category, str) else category
    col = F.col(column)
    member = col == wanted[0] if len(wanted) == 1 else col.isin(*wanted)
    return member & test


def category_rule(df: DataFrame, column: str, category: str | tuple[str, ...], test: Column) -> DataFrame:
    return df.filter(in_category(column, category, test))


def overdue_bands(date: str, params: RunParams, months: tuple[int, ...] = (12, 24)) -> dict[str, Column]:
    """Predicates: overdue at all, overdue by more than the last bound, between the bounds, and by
    less than the first."""
    col = F.col(date)
    bounds = [params.as_of, *[params.months_ago(m) for m in months]]
    late = {"overdue": col < ts(bounds[0]), f"over_{months[-1]}_months": col < ts(bounds[-1])}
    edges = [0, *months]
    for i in range(len(months) - 1, -1, -1):
        name = f"under_{months[i]}_months" if i == 0 else f"{edges[i]}_to_{edges[i + 1]}_months"
        late[name] = (col < ts(bounds[i])) & (col >= ts(bounds[i + 1]))
    return late


def overdue(df: DataFrame, date: str, params: RunParams, months: tuple[int, ...] = (12, 24)) -> DataFrame:
    """(band, n) of overdue rows, in one scan."""
    bands = overdue_bands(date, params, months)
    row = df.agg(*[F.count_if(test).alias(name) for name, test in bands.items()])
    return row.unpivot([], list(bands), "band", "n")
