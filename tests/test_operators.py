import random

from pyspark.sql import functions as F

from tellerlens.operators import conflicts as C
from tellerlens.operators import duplicates as D
from tellerlens.operators import profiling as P
from tellerlens.operators.ranking import down, top_sample
from tellerlens.operators.relations import has_related, lacks_related, lookup, salted_group_join


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_samples_put_missing_balances_first_and_settle_ties(spark):
    df = spark.createDataFrame([("d", 5.0), ("a", None), ("c", 5.0), ("b", -1.0), ("e", None)], "id string, balance double")
    got = [tuple(r) for r in top_sample(df, [down("balance")], 4).orderBy("rank").collect()]
    assert got == [(1, "a", None), (2, "e", None), (3, "c", 5.0), (4, "d", 5.0)]


def test_lookup_keeps_rows_without_key_and_fans_out(spark):
    left = spark.createDataFrame([(1, "k"), (2, None), (3, "x"), (4, None)], "id int, ref string")
    right = spark.createDataFrame([("k", "one"), ("k", "two"), (None, "never")], "key string, val string")
    got = lookup(left, right, F.col("ref"), F.col("key"), F.col("id")).select("id", "val")
    assert rows(got) == [(1, "one"), (1, "two"), (2, None), (3, None), (4, None)]


def test_existence_tests_treat_null_keys_as_unmatched(spark):
    left = spark.createDataFrame([(1, "k"), (2, None), (3, "x")], "id int, ref string")
    right = spark.createDataFrame([("k",), ("k",), (None,)], "key string")
    assert rows(has_related(left, right, "ref", "key").select("id")) == [(1,)]
    assert rows(lacks_related(left, right, "ref", "key").select("id")) == [(2,), (3,)]
    assert rows(lacks_related(left, right, "ref", "key", spread="id").select("id")) == [(2,), (3,)]


def test_salted_join_equals_plain_join_on_a_hot_group(spark):
    data = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(300)]
    df = spark.createDataFrame(data, "id int, g string")
    groups = df.groupBy("g").agg(F.count("*").alias("n"))
    plain = df.join(groups, "g").select("id", "g", "n")
    salted = salted_group_join(df, groups, ["g"], F.col("id"), how="inner").select("id", "g", F.col("_g_n").alias("n"))
    assert rows(plain) == rows(salted)
    big = groups.filter("n > 20").select("g")
    assert rows(df.join(big, "g", "left_semi").select("id", "g")) == rows(salted_group_join(df, big, ["g"], F.col("id")))


def test_peer_conflict_equals_pairwise_comparison(spark):
    rng = random.Random(7)
    data = [
        (str(rng.randrange(60)), rng.choice(["a", "b", "?", "c"]) if i % 3 else "?", rng.choice(["L1", "L2", "L3", "?"]) if i % 5 else "L1")
        for i in range(150)
    ]
    peers = spark.createDataFrame(data, "id string, profile string, risk string")
    expected = sorted(
        [p for p in data if any(q[0] != p[0] and q[1] == p[1] and q[2] != p[2] for q in data)], key=repr)
    assert rows(C.peer_risk_conflict(peers, ["profile"], "risk", "id")) == expected


def test_same_member_with_two_values_is_no_conflict(spark):
    peers = spark.createDataFrame([("1", "p", "L1"), ("1", "p", "L2")], "id string, profile string, risk string")
    assert C.peer_risk_conflict(peers, ["profile"], "risk", "id").count() == 0
    two = peers.union(spark.createDataFrame([("2", "p", "L2")], peers.schema))
    assert rows(C.peer_risk_conflict(two, ["profile"], "risk", "id")) == [("1", "p", "L1"), ("2", "p", "L2")]


def test_majority_tie_takes_the_greatest_value(spark):
    data = [("a", "tie", "L1"), ("b", "tie", "L2"), ("c", "two", "L1"), ("d", "two", "L1"), ("e", "two", "L3"),
            ("f", "one", "L2"), ("g", "flat", "L1"), ("h", "flat", "L2"), ("i", "flat", "L3")]
    df = spark.createDataFrame(data, "id string, p string, risk string")
    got = rows(C.minority_value(df, ["p"], "risk", "id").select("id", "majority_value", "majority_count", "profile_count"))
    assert got == [("a", "L2", 1, 2), ("e", "L1", 2, 3)]


def test_conflicts_within_profiles_and_identities(spark):
    df = spark.createDataFrame(
        [("1", "n", "L1"), ("1", "n", "L2"), ("2", "m", "L1"), ("3", "m", "L2"), ("4", "o", "L1"), ("5", "o", "L1")],
        "id string, p string, risk string")
    assert rows(C.profile_conflict(df, ["p"], "risk", "id").select("id")) == [("1",), ("1",), ("2",), ("3",)]
    assert rows(C.shared_identity_conflict(df, ["p"], "risk", "id").select("id")) == [("2",), ("3",)]


def test_member_lists_are_cut_at_two_hundred_characters(spark):
    data = [("hot", f"{i:05d}") for i in range(500)] + [("pair", "b"), ("pair", "a"), ("solo", "x"), ("  ", "y"), ("  ", "z"), (None, "q")]
    df = spark.createDataFrame(data, "key string, id string")
    got = {r["key"]: (r["n"], r["members"]) for r in D.duplicate_groups(df, "key", "id", 30).collect()}
    assert set(got) == {"hot", "pair"}
    assert got["pair"] == (2, "a, b")
    assert got["hot"] == (500, ", ".join(f"{i:05d}" for i in range(500))[:200].rstrip(", "))
    assert set(r["key"] for r in D.shared_values(df, "key", "space").collect()) == {"hot", "pair", "  "}


def test_list_of_short_elements_reaches_the_cut(spark):
    df = spark.createDataFrame([("k", str(i % 10)) for i in range(400)], "key string, id string")
    got = D.ordered_list(df, ["key"], F.col("id"), F.col("id"), "ids").collect()[0]["ids"]
    assert got == ", ".join(sorted(str(i % 10) for i in range(400)))[:200].rstrip(", ")


def test_frequency_and_top_values(spark):
    data = [("x", "1"), ("x", None), ("y", "1"), (None, "2"), ("", "3")]
    df = spark.createDataFrame(data, "a string, b string")
    got = rows(P.frequency(df, ["a", "b"]))
    assert got == sorted([("a", "x", 2), ("a", "y", 1), ("a", None, 2), ("b", "1", 2), ("b", "2", 1), ("b", "3", 1), ("b", None, 1)], key=repr)
    top = rows(P.top_n(df, {"a": 1, "b": 2}).select("column_name", "value", "n", "rank"))
    assert top == sorted([("a", "x", 2, 1), ("b", "1", 2, 1), ("b", "2", 1, 2)], key=repr)


def test_counts_statistics_and_histograms(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", None), ("l", -3.0), (None, 0.0)], "k string, v double").withColumn(
        "v", F.col("v").cast("decimal(22,3)"))
    got = {r["metric"]: (r["n"], r["total"]) for r in P.count_where(df, {"neg": F.col("v") < 0, "none": F.col("v").isNull()}).collect()}
    assert got == {"neg": (1, 4), "none": (1, 4)}
    s = P.stats(df, {"v": F.col("v") < 0}).collect()[0]
    assert [float(s[c]) for c in ("min_value", "max_value", "avg_value", "sum_value")] == [-3.0, 1.0, -0.67, -2.0] and s["n_flagged"] == 1
    assert rows(P.size_histogram(df, "k")) == [(1, 2), (2, 1)]
    assert rows(P.completeness(df, ["k"]).select("metric", "n", "total")) == [("k", 1, 4)]


def test_field_comparison_by_kind(spark):
    from tellerlens.operators.compare import category_rule, mismatch

    a = spark.createDataFrame([(1, " x", "R"), (2, "X", "N"), (3, " ", "R"), (4, "y", "Z")], "id int, va string, ca string")
    b = spark.createDataFrame([(1, "X ", "N"), (2, "X", "N"), (3, "x", None), (4, "z", "Y")], "key int, vb string, cb string")
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(mismatch(a, b, {"id": "key"}, "va", "vb")) == [1, 4]
    assert ids(mismatch(a, b, {"id": "key"}, "va", "vb", "upper")) == [4]
    assert ids(mismatch(a, b, {"id": "key"}, "va", "vb", "raw")) == [1, 3, 4]
    assert ids(mismatch(a, b, {"id": "key"}, "ca", "cb", "code", {"R": "Y", "N": "N"})) == [1]
    assert ids(category_rule(a, "ca", ("R", "Z"), F.col("id") > 1)) == [3, 4]


def test_overdue_bands_partition_the_overdue(spark, params):
    from datetime import datetime

    from tellerlens.operators.compare import overdue

    stamps = [datetime(2021, 1, 1), datetime(2023, 4, 1), datetime(2023, 4, 15, 9, 30), datetime(2024, 4, 15, 9, 30), None]
    df = spark.createDataFrame([(s,) for s in stamps], "due timestamp_ntz")
    got = {r["band"]: r["n"] for r in overdue(df, "due", params).collect()}
    assert got == {"overdue": 3, "over_24_months": 1, "12_to_24_months": 1, "under_12_months": 1}
