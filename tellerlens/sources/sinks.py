"""Where results go: one folder per result kind, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none where it is missing."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has written the folder to its end."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def touch(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.create(where, True).close()


def publish(df: DataFrame, target: str, staging: str, fmt: str = "parquet") -> None:
    """Write beside the target and move the finished folder there, in place of an earlier one: readers see a whole
    result or none."""
    spark = df.sparkSession
    df.write.mode("overwrite").format(fmt).save(staging)
    remove(spark, target)
    fs, where = _at(spark, target)
    fs.mkdirs(where.getParent())
    if not fs.rename(_at(spark, staging)[1], where):
        raise OSError(f"could not move {staging} to {target}")


def append_result(df: DataFrame, root: str, kind: str, run_id: str, fmt: str = "parquet") -> None:
    """Append rows under ``root/kind/run_id=…``. Results are small; a rerun of the same run id
    replaces its own partition only."""
    target = f"{root.rstrip('/')}/{kind}/run_id={run_id}"
    df.write.mode("overwrite").format(fmt).save(target)


def as_sample_rows(df: DataFrame, check_id: str, name: str) -> DataFrame:
    """Samples of all checks in one shape: their own columns travel as JSON."""
    columns = [c for c in df.columns if c != "rank"]
    rank = F.col("rank") if "rank" in df.columns else F.lit(1)
    return df.select(
        F.lit(check_id).alias("check_id"), F.lit(name).alias("sample"), rank.cast("int").alias("rank"),
        F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"),
    )
