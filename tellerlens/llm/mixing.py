"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A document's size is its number of words, its weight a quality score. Sources get word targets by weight, none above
``max_epochs`` times its size; the excess is shared again by weight (water filling). A source takes whole epochs of
all its documents first and then documents in the order of exponential keys ``-ln(u) / weight`` until the rest of its
target is met; the document at the edge is taken if that brings the sum nearer. ``u`` is hashed from id and seed, so
reruns agree.

The running sum within a source is cut into key ranges: sums per (source, range) give each range its start, and a
window inside the range does the rest. The number of ranges grows with the source, so a source with most of the rows is
spread over as many tasks as others; no range holds more than 1 / ``LEAST_WEIGHT`` times the average.

Rows: a null text has size 0 and weight 1, a null source is a source of its own and comes last; equal rows
are taken like any others. A source without words has target 0. Other columns of the input are kept aside: the result
has only its own columns. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
LEAST_WEIGHT = 0.25
#: Documents in a key range of a source, on average.
RANGE_ROWS = 4000


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, down to ``LEAST_WEIGHT`` as symbols become as frequent as words."""
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    return F.when(size > 0, 1.0 - (1.0 - LEAST_WEIGHT) * F.least(F.lit(1.0), symbols / size)).otherwise(1.0)


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of the MD5 of id (where it is null, of the text) and seed."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(text)))
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**52)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size, sampling key, and ``spot``: the key on a scale from 0 to 1 that cuts into even ranges."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), text.alias("body"))
    rows = rows.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"), F.col("body"), seed)) / quality_weight(F.col("body"), F.col("size"))).alias("key"))
    # By the least weight: even for documents of that weight, and never more than its inverse times as dense for others.
    return rows.withColumn("spot", 1.0 - F.exp(-LEAST_WEIGHT * F.col("key")))


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per source: its size, target and number of key ranges. The only unpartitioned windows run over these rows."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("most", max_epochs * F.col("source_size"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    # The first source, in order of filling, that its level doesn't fill: that level holds for it and all after it.
    level = F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(whole)["level"]
    return per.select(
        "source", "source_size", F.coalesce(F.least(F.col("most"), level * F.col("weight")), F.col("most")).alias("target"),
        F.ceil(F.col("n") / range_rows).alias("ranges"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED, range_rows: int = RANGE_ROWS, **cols: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), copies (whole documents)."""
    rows = stored(sized(docs, seed=seed, **cols))
    targets = source_targets(rows, weights, share, max_epochs, range_rows)
    known = stored(targets)
    rows = rows.join(known, rows["source"].eqNullSafe(known["source"])).select(
        "doc_id", rows["source"], "size", "key", "source_size", "target",
        F.least(F.floor(F.col("spot") * F.col("ranges")), F.col("ranges") - 1).alias("cut"),
    )
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))  # one column that is never null
    rows = stored(rows.withColumn("named", named))
    sums = rows.groupBy("named", "cut").agg(F.sum("size").alias("words"))
    starts = sums.select("named", "cut", (F.sum("words").over(Window.partitionBy("named").orderBy("cut")) - F.col("words")).alias("start"))
    inside = Window.partitionBy("named", "cut").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(starts, ["named", "cut"]).withColumn("ahead", F.col("start") + F.sum("size").over(inside) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    chosen = (rest > 0) & (F.col("ahead") + F.col("size") / 2.0 <= rest)
    copies = epochs + F.when(chosen, 1).otherwise(0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The documents, all columns, each as often as the mix takes it. Rows with equal id and text are told apart by
    number only: together they come as often as taken together."""
    keyed = docs.select(F.struct("*").alias("given"), F.hex(row_key(F.col(id_col), F.col(text_col))).alias("mix_key"), F.col(text_col).alias("mix_text"), F.col(source_col).alias("mix_source"))
    taken = mix(keyed, id_col="mix_key", text_col="mix_text", source_col="mix_source", **options)
    times = taken.groupBy(F.col("doc_id").alias("taken_key")).agg(F.sum("copies").cast("int").alias("times")).filter("times > 0")
    joined = keyed.join(times, F.col("mix_key") == F.col("taken_key")).dropDuplicates(["mix_key"])
    return joined.select("given", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*[F.col("given").getField(c).alias(c) for c in docs.columns])
