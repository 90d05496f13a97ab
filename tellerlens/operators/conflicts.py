"""Clients whose risk rating disagrees with that of comparable clients.

None of these forms compares clients pair by pair: profiles are aggregated first and clients are
checked against the aggregate, so a profile shared by a third of all clients (missing income,
missing nationality) stays linear.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellerlens.operators.relations import salted_group_join


def peer_risk_conflict(peers: DataFrame, profile: Sequence[str], value: str, member: str) -> DataFrame:
    """Peers for whom another member with the same profile has another value. Profile and value
    columns are already filled. Per (profile, value) the lowest and the highest member are enough:
    a peer conflicts when a different value is carried by somebody else."""
    per_value = peers.groupBy(*profile, value).agg(
        F.min(member).alias("_lo"), F.max(member).alias("_hi")
    )
    others = per_value.withColumnRenamed(value, "_value")
    conflict = (F.col("_g__value") != F.col(value)) & (
        (F.col("_g__lo") != F.col(member)) | (F.col("_g__hi") != F.col(member))
    )
    return salted_group_join(peers, others, profile, F.col(member), conflict)


def conflicting_profiles(df: DataFrame, profile: Sequence[str], value: str) -> DataFrame:
    """Profiles with more than one distinct (non-NULL) value: lowest and highest differ."""
    spread = df.groupBy(*profile).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return spread.filter(F.col("_lo") != F.col("_hi")).select(*profile)


def profile_conflict(df: DataFrame, profile: Sequence[str], value: str, member: str) -> DataFrame:
    """Rows whose profile carries more than one value."""
    return salted_group_join(df, conflicting_profiles(df, profile, value), profile, F.col(member))


def shared_identity_conflict(df: DataFrame, identity: Sequence[str], value: str, member: str) -> DataFrame:
    """Rows whose identity is used by several members that disagree on the value."""
    spread = df.groupBy(*identity).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.min(member).alias("_first"), F.max(member).alias("_last"),
    )
    groups = spread.filter((F.col("_lo") != F.col("_hi")) & (F.col("_first") != F.col("_last")))
    return salted_group_join(df, groups.select(*identity), identity, F.col(member))


def profile_majorities(df: DataFrame, profile: Sequence[str], value: str, min_percent: int = 50) -> DataFrame:
    """(profile, majority_value, majority_count, profile_count) for profiles with at least two
    values whose most frequent one (ties: the greatest value) reaches ``min_percent``."""
    per_value = df.groupBy(*profile, value).agg(F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_n"), F.col(value).alias("_v")))
    majority = per_value.groupBy(*profile).agg(
        best.alias("_best"), F.sum("_n").alias("profile_count"), F.count("*").alias("_values")
    )
    kept = (F.col("_values") > 1) & (F.col("_best._n") * 100 >= F.col("profile_count") * min_percent)
    return majority.filter(kept).select(
        *profile,
        F.col("_best._v").alias("majority_value"),
        F.col("_best._n").alias("majority_count"),
        "profile_count",
    )


def minority_value(df: DataFrame, profile: Sequence[str], value: str, member: str, min_percent: int = 50) -> DataFrame:
    """Rows whose value is not their profile's majority, with the majority facts."""
    majority = profile_majorities(df, profile, value, min_percent)
    joined = salted_group_join(
        df, majority, profile, F.col(member), F.col("_g_majority_value") != F.col(value), how="inner"
    )
    for name in ("majority_value", "majority_count", "profile_count"):
        joined = joined.withColumnRenamed(f"_g_{name}", name)
    return joined
