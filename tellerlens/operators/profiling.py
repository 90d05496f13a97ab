"""Profiling: one pass over a table whatever the number of columns asked for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tellerlens.functions.expressions import is_blank, percent_of
from tellerlens.operators.relations import union_all


def volumetry(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(ord, table_name, n_rows), in the order given."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(i).alias("ord"), F.lit(name).alias("table_name"), "n_rows"
        )
        for i, (name, df) in enumerate(tables.items(), 1)
    ]
    return union_all(counts)


def frequency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) for all columns in one scan and one shuffle: rows are unfolded and
    combined map-side, so each task ships one row per distinct value it saw."""
    texts = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]
    unfolded = df.select(*texts).unpivot([], list(columns), "column_name", "value")
    return unfolded.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def top_n(df: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Most frequent values per column, ties by value, with their rank. The rank filter is applied
    per task before the exchange, so no column collects all of its values in one place."""
    order = W.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    wanted = F.create_map(*[x for c, k in limits.items() for x in (F.lit(c), F.lit(k))])
    ranked = frequency(df, list(limits)).withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= max(limits.values()))
    return ranked.filter(F.col("rank") <= wanted[F.col("column_name")])


def crosstab(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.groupBy(first, second).agg(F.count("*").alias("n"))


def size_histogram(df: DataFrame, key: str) -> DataFrame:
    """(group_size, n_groups): how many keys have how many rows. A NULL key is one group."""
    sizes = df.groupBy(key).agg(F.count("*").alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count("*").alias("n_groups"))


def count_where(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """(metric, n, total): all filtered counts of a table in one scan."""
    names = list(predicates)
    counts = [F.count_if(predicates[name]).alias(f"_c{i}") for i, name in enumerate(names)]
    row = df.agg(F.count("*").alias("_total"), *counts)
    structs = [
        F.struct(F.lit(name).alias("metric"), F.col(f"_c{i}").alias("n"), F.col("_total").alias("total"))
        for i, name in enumerate(names)
    ]
    return row.select(F.inline(F.array(*structs)))


def completeness(df: DataFrame, columns: Sequence[str], mode: str = "space") -> DataFrame:
    """(metric, n, total, pct) of blank values per column."""
    rows = count_where(df, {c: is_blank(F.col(c), mode) for c in columns})
    return rows.withColumn("pct", percent_of(F.col("n"), F.col("total")))


def stats(df: DataFrame, specs: Mapping[str, Column | None], round_ends: bool = True) -> DataFrame:
    """(column_name, min, max, avg, sum, n_flagged); ``specs`` maps a column to the predicate that
    ``n_flagged`` counts (none: NULL). Averages and sums are rounded to 2, and so are the lowest
    and the highest value unless ``round_ends`` is off."""
    cells = []
    for i, (name, flag) in enumerate(specs.items()):
        col = F.col(name)
        cells += [F.min(col).alias(f"_n{i}"), F.max(col).alias(f"_x{i}"), F.sum(col).alias(f"_s{i}"), F.count(col).alias(f"_k{i}")]
        cells.append((F.count_if(flag) if flag is not None else F.max(F.lit(None).cast("bigint"))).alias(f"_f{i}"))
    row = df.agg(*cells)
    two = "decimal(38,2)"
    end = lambda name: (F.round(name, 2) if round_ends else F.col(name)).cast("decimal(38,3)")
    structs = [
        F.struct(
            F.lit(name).alias("column_name"),
            end(f"_n{i}").alias("min_value"),
            end(f"_x{i}").alias("max_value"),
            F.round(F.col(f"_s{i}") / F.nullif(F.col(f"_k{i}"), F.lit(0)), 2).cast(two).alias("avg_value"),
            F.round(F.col(f"_s{i}"), 2).cast(two).alias("sum_value"),
            F.col(f"_f{i}").alias("n_flagged"),
        )
        for i, name in enumerate(specs)
    ]
    return row.select(F.inline(F.array(*structs)))


def date_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, first_value, last_value)."""
    row = df.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    structs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_min_{c}").alias("first_value"),
            F.col(f"_max_{c}").alias("last_value"),
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*structs)))


def per_year(df: DataFrame, date: str, amount: str | None = None) -> DataFrame:
    """(year, n[, total_amount]) over rows that carry a date."""
    aggs = [F.count("*").alias("n")]
    if amount:
        aggs.append(F.round(F.sum(amount), 2).cast("decimal(38,2)").alias("total_amount"))
    return df.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(*aggs)
