"""Session settings the plans are designed for; a cluster's own settings always win."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions and splits skewed join partitions, also where the
# split costs one more exchange: identity keys such as a blank KYC reference can be very hot.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "tellerlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    given, active = SparkConf(), SparkSession.getActiveSession()
    for key, value in DEFAULTS.items():
        if not given.contains(key) and not (active and active.conf.get(key, None) is not None):
            builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

