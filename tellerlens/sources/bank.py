"""Where the banking tables come from: Parquet folders, JDBC, or the session catalog."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellerlens.sources.schemas import DAY_COLUMN, OPTIONAL_TABLES, SCHEMAS
from tellerlens.sources.sinks import list_names


class Bank:
    """Lazy access by table name. A loader runs when its table is first asked for, so a check
    only ever opens the tables it reads."""

    def __init__(self, spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._opened: dict[str, DataFrame] = {}

    def __contains__(self, name: str) -> bool:
        return name in self._loaders

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            if name not in self._loaders:
                kind = "optional" if name in OPTIONAL_TABLES else "required"
                raise KeyError(f"{kind} table {name} is not available")
            self._opened[name] = self._loaders[name]()
        return self._opened[name]

    def without(self, *names: str) -> "Bank":
        return Bank(self.spark, {k: v for k, v in self._loaders.items() if k not in names})

    def replacing(self, **frames: DataFrame) -> "Bank":
        """The same bank with some tables answered by other frames."""
        return Bank(self.spark, {**self._loaders, **{n: (lambda df=df: df) for n, df in frames.items()}})

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: Mapping[str, DataFrame]) -> "Bank":
        return cls(spark, {name: (lambda df=df: df) for name, df in frames.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, tables=None) -> "Bank":
        """One folder or file per table below ``root``, named like the table in any case, with or
        without ``.parquet``. A history partitioned by ``trn_day`` keeps that column for pruning;
        other undeclared columns are not selected."""

        def reader(name: str, entry: str) -> Callable[[], DataFrame]:
            return lambda: normalise(spark.read.parquet(f"{root.rstrip('/')}/{entry}"), name)

        found = _existing(spark, root)
        names = tables if tables is not None else found
        return cls(spark, {n: reader(n, found.get(n, n)) for n in names})

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str | None = None) -> "Bank":
        prefix = f"{schema}." if schema else ""
        found = [n for n in SCHEMAS if spark.catalog.tableExists(f"{prefix}{n}")]
        return cls(
            spark, {n: (lambda n=n: normalise(spark.table(f"{prefix}{n}"), n)) for n in found}
        )

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        tables=tuple(SCHEMAS),
        schema: str | None = None,
        split: Mapping[str, str | dict] | None = None,
        rows_per_task: int = 2_000_000,
        read: "JdbcReader | None" = None,
        **options: str,
    ) -> "Bank":
        """Tables of a database, read by as many tasks as their size asks for.

        ``split`` names, per table, the column to split by: a number or a date, spread evenly, or
        the JDBC partitioning options themselves. The column's bounds and the number of rows are
        asked for first, and ranges of about ``rows_per_task`` rows are made of them. A table above
        that size without such a column is refused rather than read by one task. Optional tables
        are asked for when the bank is opened and are absent if the database does not know them.
        """
        fetch = read or _jdbc(spark, url, options)
        names = [n for n in tables if n not in OPTIONAL_TABLES or _known(fetch, _qualified(schema, n))]

        def reader(name: str) -> Callable[[], DataFrame]:
            return lambda: normalise(_split_read(fetch, _qualified(schema, name), (split or {}).get(name), rows_per_task), name)

        return cls(spark, {n: reader(n) for n in names})


JdbcReader = Callable[[str, Mapping[str, str]], DataFrame]


def _jdbc(spark: SparkSession, url: str, options: Mapping[str, str]) -> JdbcReader:
    """(table or subquery, further options) to a frame."""
    base = {"url": url, "preferTimestampNTZ": "true", **options}
    return lambda source, more: spark.read.format("jdbc").options(**base).options(**more).option("dbtable", source).load()


def _qualified(schema: str | None, name: str) -> str:
    return f"{schema}.{name}" if schema else name


def _known(fetch: JdbcReader, source: str) -> bool:
    """Whether the database has the table: asking for no row of it is enough. Other errors are raised."""
    try:
        fetch(f"(SELECT COUNT(*) AS n FROM {source} WHERE 1 = 0) t", {}).collect()
        return True
    except Exception as error:  # drivers have their own errors for unknown tables
        if any(word in str(error).lower() for word in ("not exist", "not found", "unknown table", "ora-00942", "no such table", "doesn't exist", "invalid object")):
            return False
        raise


def _split_read(fetch: JdbcReader, source: str, split: str | dict | None, rows_per_task: int) -> DataFrame:
    if isinstance(split, Mapping):
        return fetch(source, split)
    bounds = f", MIN({split}) AS low, MAX({split}) AS high" if split else ""
    found = fetch(f"(SELECT COUNT(*) AS n{bounds} FROM {source}) t", {}).first().asDict()
    facts = {k.lower(): v for k, v in found.items()}
    tasks = -(-int(facts["n"]) // rows_per_task)
    if tasks <= 1:
        return fetch(source, {})
    if not split:
        raise ValueError(f"{source} has {facts['n']} rows: name a column to split it by, or it would be read by one task")
    if facts["low"] is None:
        raise ValueError(f"{source}.{split} is always NULL and cannot split the table")
    return fetch(source, {"partitionColumn": split, "lowerBound": str(facts["low"]), "upperBound": str(facts["high"]), "numPartitions": str(tasks)})


def normalise(df: DataFrame, name: str) -> DataFrame:
    """Declared names and types; absent columns become NULL, and so does empty text. Only casts
    that change a type are written, so plain columns still push their filters down."""
    present = {c.lower(): c for c in df.columns}
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    out = []
    for field in SCHEMAS[name].fields:
        if field.name not in present:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        col = F.col(f"`{present[field.name]}`")
        if types[field.name] != field.dataType:
            col = col.cast(field.dataType)
        if isinstance(field.dataType, T.StringType) and field.name not in _KEYS:
            col = F.nullif(col, F.lit(""))
        out.append(col.alias(field.name))
    if name == "actb_history" and DAY_COLUMN in present:
        out.append(F.col(present[DAY_COLUMN]).cast("date").alias(DAY_COLUMN))
    return df.select(*out)


# Codes that filter big scans stay bare columns, so that those filters are pushed down. They are
# only ever compared with non-empty codes, or counted by value with '' folded into NULL.
_KEYS = frozenset({"trn_code", "module", "function_id"})


def _existing(spark: SparkSession, root: str) -> dict[str, str]:
    """table: the name of its folder or file below ``root``."""
    found: dict[str, str] = {}
    for entry in list_names(spark, root):
        name = entry.lower().removesuffix(".parquet")
        if name in SCHEMAS:
            if name in found:
                raise ValueError(f"{root} holds the table {name} twice: {found[name]} and {entry}")
            found[name] = entry
    return found
