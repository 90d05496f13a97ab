"""Shared pieces of the DuckDB checks: the derived banking tables as CTEs, dates, formatting.

The checks are written in the direct relational form (EXISTS, correlated sums, pairwise
comparison) rather than in the form the Spark plans use, so that the two can disagree.
"""

from __future__ import annotations

import re

from tellerlens.sources.starbank import PARTS, select_list

AS_OF = "TIMESTAMP '2024-04-15 09:30:00'"


def months_back(n: int) -> str:
    return f"({AS_OF} - INTERVAL {n} MONTH)"


def days_back(n: int) -> str:
    return f"({AS_OF} - INTERVAL {n} DAY)"


def birthday(age: int) -> str:
    """Latest birth date of somebody who has reached ``age``."""
    return f"TIMESTAMP '{2024 - age}-04-15 00:00:00'"


def table_cte(table: str) -> str:
    parts = [
        f"SELECT {', '.join(select_list(table, exprs))} FROM {source} WHERE {cond}"
        for source, cond, exprs in PARTS[table]
    ]
    return f"{table} AS ({' UNION ALL '.join(parts)})"


_HELPERS = {
    "acct_open": (
        "SELECT cust_no, COUNT(*) AS n, SUM(acy_curr_balance) AS bal,"
        " GREATEST(MAX(date_last_cr_activity), MAX(date_last_dr_activity)) AS last_act,"
        " MIN(ac_open_date) AS first_open FROM sttm_cust_account WHERE record_stat = 'O' GROUP BY cust_no"
    ),
    "acct_all": "SELECT cust_no, SUM(acy_curr_balance) AS bal FROM sttm_cust_account GROUP BY cust_no",
    "one_client": (
        "SELECT kyc_ref_no AS ref, MIN(customer_no) AS customer_no,"
        " ARG_MIN(customer_name1, customer_no) AS customer_name FROM sttm_customer GROUP BY kyc_ref_no"
    ),
}


def with_tables(sql: str, extra: str = "") -> str:
    """Prepend the CTEs that ``sql`` mentions."""
    needed: list[str] = []
    text = extra + " " + sql
    helpers = [h for h in _HELPERS if re.search(rf"\b{h}\b", text)]
    text += " ".join(_HELPERS[h] for h in helpers)
    needed = [table_cte(t) for t in PARTS if re.search(rf"\b{t}\b", text)]
    needed += [f"{h} AS ({_HELPERS[h]})" for h in helpers]
    if extra:
        needed.append(extra)
    return f"WITH {', '.join(needed)} {sql}"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def num(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def cents(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,2)) AS DOUBLE)"


def blank(col: str, mode: str = "space") -> str:
    return f"({col} IS NULL OR {col} IN ('', ' '))" if mode == "space" else f"(COALESCE(TRIM({col}), '') = '')"


def filled(col: str, mode: str = "space") -> str:
    return f"(NOT {blank(col, mode)})"


def codes(*values: str) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def top(columns: dict[str, str], body: str, order: list[str], k: int, hide: tuple[str, ...] = ()) -> str:
    """Ranked sample: ``columns`` name -> expression over ``body``; all columns close the sort."""
    inner = ", ".join(f"{e} AS {n}" for n, e in columns.items())
    keys = ", ".join([*order, *[f"{n} ASC NULLS LAST" for n in columns]])
    shown = ", ".join(n for n in columns if n not in hide)
    return (
        f"SELECT rank, {shown} FROM (SELECT ROW_NUMBER() OVER (ORDER BY {keys}) AS rank, * FROM"
        f" (SELECT {inner} {body}) AS x) AS y WHERE rank <= {k}"
    )


def first_segment(key: str) -> str:
    return f"CASE WHEN INSTR({key}, '~') > 1 THEN SUBSTR({key}, 1, INSTR({key}, '~') - 1) END"


def segment(key: str, n: int) -> str:
    """``n``-th closed piece: NULL unless the key holds at least ``n`` separators."""
    return f"CASE WHEN LEN(STRING_SPLIT({key}, '~')) > {n} THEN NULLIF(STRING_SPLIT({key}, '~')[{n}], '') END"


def shorter(key: str) -> str:
    return f"CASE WHEN LENGTH({key}) > 1 THEN LEFT({key}, LENGTH({key}) - 1) END"
