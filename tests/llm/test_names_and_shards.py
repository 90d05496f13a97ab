"""User columns named like the operators' own; slot maps with uneven slots; even key ranges."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tellerlens.llm import jaccard_join, line_dedup, mixing, nearsets, sharding

from .conftest import PROSE, long_text

NAMES = (
    "own_key gone_key gone_lines all_lines left_lines rest_lines given given_key kept_row kept_key set_id mix_key mix_text mix_source taken_key times copy copies "
    "key node root first n bands line line_no raw parts size spot target ranges cut start words named"
).split()


@pytest.fixture(scope="module")
def named_docs(spark):
    rows = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in NAMES]) for i, t in enumerate([PROSE + "\n" + long_text(40, 1), PROSE + "\n" + long_text(40, 2), long_text(80, 3), long_text(80, 3), ""])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))


@pytest.mark.parametrize("stage", [line_dedup.dedup_lines, jaccard_join.keep_one, mixing.mixed])
def test_user_columns_come_back(named_docs, stage):
    out = stage(named_docs)
    assert out.columns == named_docs.columns
    rows = out.collect()
    assert len({r.doc_id for r in rows}) >= 3
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES)


def test_growth_moves_slots_only_into_new_shards():
    for seed in range(30):
        rng = random.Random(seed)
        totals = [(int(rng.paretovariate(0.8) * 10) if rng.random() < 0.8 else 0, 1) for _ in range(rng.choice([16, 64, 400]))]
        old = sharding.plan(totals, 4)
        new = sharding.rebalance(old, totals, 6)
        moved = [(a, b) for a, b in zip(old.shard, new.shard, strict=True) if a != b]
        assert all(b >= 4 for _, b in moved) and new.version == 2
        if sum(b > 0 for b, _ in totals) >= 12:
            assert set(new.shard[i] for i, (b, _) in enumerate(totals) if b) >= {4, 5}
        same = sharding.rebalance(old, totals, 4)
        load = lambda m: max(sum(t[0] for t, x in zip(totals, m.shard, strict=True) if x == s) for s in range(4))
        assert load(same) <= load(old)


def test_stored_map_and_rows_without_ids(spark, tmp_path):
    rows = [(i if i % 3 else None, f"text {i} " + "x" * (i % 7)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed, slot_map = sharding.shard_documents(docs, 8, folder=str(tmp_path / "map"))
    assert sharding.load(spark, str(tmp_path / "map"), 1) == slot_map
    got = placed.collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by_shard = Counter(r.shard for r in got)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.05 * min(size.values())
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s, n in by_shard.items() for k in range(n))


def test_key_ranges_stay_even(spark):
    text = "# " * 30 + "word"  # the least weight
    docs = spark.createDataFrame([(i, text, "s") for i in range(4000)] + [(None, f"plain {i}", "s") for i in range(2000)], "doc_id long, text string, source string")
    rows = mixing.sized(docs).withColumn("cut", F.floor(F.col("spot") * 30))
    assert max(r["count"] for r in rows.groupBy("cut").count().collect()) <= 4.5 * 6000 / 30


def test_bit_table_lets_all_members_pass(spark):
    values = spark.range(5000).select((F.col("id") * 1_000_003 - 2_000_000_000).alias("node"))
    members = values.filter("node % 7 = 0")
    passed = values.filter(nearsets.maybe_in(F.col("node"), members, 1 << 14))
    assert members.exceptAll(passed).count() == 0 and passed.count() < 2000
    assert values.filter(nearsets.maybe_in(F.col("node"), members.limit(0))).count() == 0
