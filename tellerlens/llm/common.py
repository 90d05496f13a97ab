"""What the operators share: the word pattern, scratch tables, row keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a machine-local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Spark's own switch: the shuffle files of a statement go when it has ended. What ``stored`` returns no longer needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files that a task may hold open at once: with no more values than that, ``by`` needs no sort of the rows.
WRITERS, AT_ONCE = "spark.sql.maxConcurrentOutputFileWriters", "4"


def stored(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: survives lost executors, cuts lineage.

    The folder goes when the driver's JVM ends, or by ``discard``; the shuffle files of the write go with its end.
    ``by`` names a column whose values become folders of their own.
    """
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    switches = {CLEANUP: "true"} | ({WRITERS: AT_ONCE} if by else {})
    before = {k: spark.conf.get(k, None) for k in switches}
    for k, v in switches.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of stored steps that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of rows that Spark hands to a Python worker at once. Spark's own limit is ten thousand rows: some 50 MB of
#: whole texts or their pieces, which the JVM and the worker hold several times over.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application, as ``--py-files`` would; bound the batches that it
    gets, unless the session sets a bound itself."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    folder = tempfile.mkdtemp(prefix="llm-ship-")  # on the driver alone: Spark serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"llm_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"{os.path.basename(top)}/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"{os.path.basename(top)}/{os.path.basename(here)}/{name}")
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that stand for a row's id and text. Rows with equal id and text are one document."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.when(text.isNull(), "|").otherwise(F.lit(":")), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(whole))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
