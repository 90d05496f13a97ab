"""Prefix trie of conversations from range minima over sorted LCPs.

Conversations are rows of turn digests. Spark sorts them, so that every prefix is one interval of places, and each place
gets the number of turns it shares with the place before (its LCP). A candidate prefix is a place and a depth that its
conversation has and the one before hasn't, or just shares. It finds the left and the right end of its interval on its
own, by binary search with minima over powers of two (a sparse table); no stack and no order of prefixes is involved.

The sparse tables are made per block of ``BLOCK`` places. A search that leaves its block goes on over the minima of the
blocks (the same search, one level up, again in blocks) and ends inside the block that stops it. Searches of one block
at one depth leave it as one. So a task never holds more than a block, however many conversations share a first turn.

Nodes sorted by first place and depth are in pre-order: sums over subtrees are differences of running sums.

Rows: null turns come first, ties go by role and then by the text's SHA-256; a null role or text is empty; equal rows
are turns like others; rows without a conv_id belong to no conversation. A conversation is one row of 32 bytes a turn,
as a text is. Other columns are ignored. An empty table has no nodes. Digests are SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ship, stored

#: Places in one block of a sparse table.
BLOCK = 512
NONE = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq (array of turn digest and number of words, in order)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), F.sha2(text, 256).alias("told"),
            F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_key"),
            F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("at"))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["turn_key"].alias("turn_key"), t["words"].alias("words"))).alias("seq"))


def rebuilt(seqs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation begun by the first h turns of the one at the multiple of ``every`` below it; h by its id's CRC."""
    heads = seqs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    joined = seqs.withColumn("from_", F.col("conv_id") - F.col("conv_id") % every).join(heads, F.col("from_") == F.col("base"), "left")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast(seqs.schema["seq"].dataType)), F.lit(1), h)
    rest = F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("seq"))


def _shared(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _with_lcp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns shared with the row before; of a partition's first row, none are known (-1). Partitions are sorted."""
    part, place, before = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        keys = batch.column("keys").to_pylist()
        lcp = np.empty(len(keys), np.int32)
        for i, k in enumerate(keys):
            lcp[i] = -1 if before is None else _shared(before, k)
            before = k
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n, dtype=np.int64)), batch.column("conv_id"), pa.array(lcp), batch.column("keys"), batch.column("words")],
            names=["part", "row", "conv_id", "lcp", "keys", "words"])
        place += n


def placed(convs: DataFrame) -> tuple[DataFrame, int]:
    """(place, conv_id, lcp, words) of the sorted conversations, and their number. The first place has the LCP -1."""
    ship(convs.sparkSession)
    flat = convs.select("conv_id", F.transform("seq", lambda t: t["turn_key"]).alias("keys"), F.transform("seq", lambda t: t["words"]).alias("words"))
    by_order = flat.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    rows = stored(by_order.mapInArrow(_with_lcp, "part int, row bigint, conv_id bigint, lcp int, keys array<binary>, words array<int>"))
    # One row per partition: where it starts, and what its first row shares with the last row of the one before.
    edges = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by("keys", "row").alias("first"), F.max_by("keys", "row").alias("last"))
    by_part = Window.orderBy("part")
    edges = edges.withColumns({"start": F.sum("n").over(by_part) - F.col("n"), "before": F.lag("last").over(by_part)})
    same = F.arrays_zip(F.col("first").alias("first"), F.col("before").alias("before"))
    differ = F.array_position(F.transform(same, lambda z: ~z["first"].eqNullSafe(z["before"])), True)
    shared = F.when(F.col("before").isNull(), -1).otherwise(F.when(differ > 0, differ - 1).otherwise(F.size("first")))
    edges = stored(edges.select("part", "n", "start", shared.cast("int").alias("edge")))
    total = edges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = rows.join(F.broadcast(edges.select("part", "start", "edge")), "part").select(
        (F.col("start") + F.col("row")).alias("place"), "conv_id", F.when(F.col("row") == 0, F.col("edge")).otherwise(F.col("lcp")).alias("lcp"), "words")
    return stored(known), total


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima over 1, 2, 4, ... values from each place on."""
    levels, span = [values], 1
    while 2 * span <= len(values):
        levels.append(np.minimum(levels[-1][:-span], levels[-1][span:]))
        span *= 2
    return levels


def range_min(levels: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Least value from each start to before each stop; the greatest long of an empty range."""
    out = np.full(len(start), np.iinfo(np.int64).max)
    size = stop - start
    for k, level in enumerate(levels):
        hit = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
        out[hit] = np.minimum(level[start[hit]], level[stop[hit] - (1 << k)])
    return out


def first_below(levels: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place from each start on with a value below the depth, by halving jumps; the number of values if none."""
    at, n = start.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        room = at + (1 << k) <= n
        jump = room & (levels[k][np.where(room, at, 0)] >= depth)
        at = np.where(jump, at + (1 << k), at)
    return at


class Block:
    """Sparse tables of a block of gaps (LCPs) and the ids beside them, both ways. Gap i lies between places i - 1 and i."""

    def __init__(self, gap: np.ndarray, right_id: np.ndarray, left_id: np.ndarray) -> None:
        self.n = len(gap)
        self.tables = {True: (sparse_table(gap), sparse_table(right_id)), False: (sparse_table(gap[::-1]), sparse_table(left_id[::-1]))}

    def search(self, start: np.ndarray, depth: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From gap ``start`` on, to the right or to the left: the gap below the depth that ends the search, whether there
        is one in the block, and the least id passed."""
        gaps, ids = self.tables[right]
        first = start if right else self.n - 1 - start
        at = first_below(gaps, first, depth)
        return at if right else self.n - 1 - at, at < self.n, range_min(ids, first, at)


def _blocks(gaps: DataFrame, block: int) -> DataFrame:
    return gaps.withColumn("block", F.floor(F.col("i") / block))


_FOUND = "block bigint, i bigint, depth int, toright boolean, stop bigint, least bigint"


def searched(gaps: DataFrame, asked: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """i, depth, toright, stop, least for each row of ``asked`` (distinct i, depth, toright): the first gap from i on, in its
    direction, with a value below the depth, or n, and the least id passed on the way. ``gaps``: i (0 to n - 1), gap,
    right_id, left_id. The gap 0 must stop every search to the left."""
    inside = stored(_inside(_blocks(gaps, block), asked.withColumn("block", F.floor(F.col("i") / block)), block))
    ended = inside.filter("stop IS NOT NULL").select("i", "depth", "toright", "stop", "least")
    if n <= block:  # no search can go further: to the right they end at n
        return ended.unionAll(inside.filter("stop IS NULL").select("i", "depth", "toright", F.lit(n).cast("long"), "least"))
    left = inside.filter("stop IS NULL").select("i", "depth", "toright", F.col("block") + F.when(F.col("toright"), 1).otherwise(-1).alias("next"), F.col("least").alias("own")).toDF("i", "depth", "toright", "next", "own")
    blocks = -(-n // block)
    up = stored(_blocks(gaps, block).groupBy("block").agg(F.min("gap").alias("gap"), F.min("right_id").alias("right_id"), F.min("left_id").alias("left_id")).withColumnRenamed("block", "i"))
    ask = stored(left.select(F.col("next").alias("i"), "depth", "toright").filter(F.col("i") < blocks).distinct())
    above = stored(searched(up, ask, blocks, block).select(F.col("i").alias("next"), "depth", "toright", F.col("stop").alias("end"), F.col("least").alias("between")))
    # In the block that stops a search it ends inside, coming from the block's near edge.
    enter = F.when(F.col("toright"), F.col("end") * block).otherwise(F.least((F.col("end") + 1) * block, F.lit(n)) - 1)
    entry = above.filter(F.col("end") < blocks).select(enter.alias("i"), "depth", "toright", F.col("end").alias("block")).distinct()
    last = _inside(_blocks(gaps, block), entry, block).select(F.col("block").alias("end"), "depth", "toright", "stop", F.col("least").alias("inside"))
    whole = above.join(last, ["end", "depth", "toright"], "left").select("next", "depth", "toright", F.coalesce("stop", F.lit(n).cast("long")).alias("stop"), F.least("between", "inside").alias("far"))
    rest = left.join(whole, ["next", "depth", "toright"], "left").select("i", "depth", "toright", F.coalesce("stop", F.lit(n).cast("long")).alias("stop"), F.least("own", "far").alias("least"))
    return ended.unionAll(rest)


def _inside(gaps: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """The searches as far as they go in their block; stop is null where they leave it."""

    def run(key: tuple, values: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({c: [] for c in ("block", "i", "depth", "toright", "stop", "least")})
        values, first = values.sort_values("i"), int(key[0]) * block
        table = Block(*(values[c].to_numpy() for c in ("gap", "right_id", "left_id")))
        parts = []
        for right in (True, False):
            q = asked[asked["toright"] == right]
            stop, found, least = table.search(q["i"].to_numpy() - first, q["depth"].to_numpy(), right)
            parts.append(q.assign(stop=pd.array(stop + first, "Int64").copy(), least=least))
            parts[-1].loc[~found, "stop"] = pd.NA
        return pd.concat(parts)[["block", "i", "depth", "toright", "stop", "least"]]

    return gaps.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(run, _FOUND)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order: only one digest is open at a time."""
    open_, digest = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for first, ids in zip(batch.column("first").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if first != open_:
                if open_ is not None:
                    done.append((open_, digest.hexdigest()))
                open_, digest = first, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["first", "ends_sha256"])
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["first", "ends_sha256"])


def trie(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """first and last (the node's interval of places in sorted order), conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node over ``convs`` (conv_id, seq)."""
    rows, n = placed(convs)
    before = F.lag("conv_id").over(Window.partitionBy("block").orderBy("i"))
    # The id left of a block's first gap is its neighbour's last: taken from there, as the block's window cannot see it.
    ends = rows.filter(F.col("place") % block == block - 1).select((F.col("place") + 1).alias("i"), F.col("conv_id").alias("beyond"))
    gaps = _blocks(rows.select(F.col("place").alias("i"), F.col("lcp").alias("gap"), "conv_id"), block).withColumn("left_id", before)
    gaps = stored(gaps.join(ends, "i", "left").select("i", "gap", F.col("conv_id").alias("right_id"), F.coalesce("left_id", "beyond", F.lit(2**63 - 1)).alias("left_id")))
    depths = F.sequence(F.greatest("lcp", F.lit(0)), F.size("words"))
    candidates = rows.select("place", "conv_id", "lcp", F.size("words").alias("turns"), "words", F.explode(depths).alias("depth")).withColumn(
        "words", F.when(F.col("depth") > 0, F.try_element_at("words", F.col("depth"))).otherwise(0))
    candidates = stored(candidates)
    asked = candidates.select(F.col("place").alias("i"), "depth", F.lit(False).alias("toright")).unionAll(
        candidates.filter(F.col("place") + 1 < n).select((F.col("place") + 1).alias("i"), "depth", F.lit(True).alias("toright")))
    found = stored(searched(gaps, asked, n, block))
    left = found.filter("NOT toright").select(F.col("i").alias("place"), "depth", F.col("stop").alias("first"), F.col("least").alias("least_left"))
    right = found.filter("toright").select((F.col("i") - 1).alias("place"), "depth", (F.col("stop") - 1).alias("last"), F.col("least").alias("least_right"))
    spans = candidates.join(left, ["place", "depth"]).join(right, ["place", "depth"], "left").select(
        "place", "depth", F.col("conv_id").alias("own"), "lcp", "turns", "words", "first", F.coalesce("last", "place").alias("last"), F.least("conv_id", "least_left", "least_right").alias("least"))
    spans = stored(spans)
    chain = Window.partitionBy("place").orderBy("depth")  # a conversation's own candidates, from the shared one down
    nodes = spans.withColumns({"parent_conv_id": F.lag("least").over(chain), "parent_first": F.lag("first").over(chain)}).filter("depth > lcp")
    children = nodes.filter("parent_first IS NOT NULL").groupBy(F.col("parent_first").alias("place"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["place", "depth"], "left").withColumns({
        "n_convs": F.col("last") - F.col("place") + 1, "n_children": F.coalesce("n_children", F.lit(0)), "block": F.floor(F.col("place") / block)})
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saves": (F.col("n_convs") - 1) * F.col("words")})
    nodes = stored(nodes.select("place", "depth", "last", "least", "parent_conv_id", "n_convs", "n_children", "block", "leaf", "saves"))
    # Running sums before each node, in pre-order: inside its block, and over the blocks before (one row each).
    ahead = Window.partitionBy("block").orderBy("place", "depth").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.groupBy("block").agg(F.sum("leaf").alias("l"), F.sum("saves").alias("s"))
    sums = sums.select("block", F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    zero = F.lit(0)
    run = nodes.withColumns({"l1": F.coalesce(F.sum("leaf").over(ahead), zero), "s1": F.coalesce(F.sum("saves").over(ahead), zero)}).join(sums, "block")
    run = stored(run.withColumns({"leaves": F.col("l0") + F.col("l1"), "saved": F.col("s0") + F.col("s1")}).drop("l0", "l1", "s0", "s1"))
    all_leaves, all_saved = run.agg(F.coalesce(F.sum("leaf"), zero), F.coalesce(F.sum("saves"), zero)).first()
    after = run.groupBy(F.col("place").alias("next_place")).agg(F.min("leaves").alias("next_leaves"), F.min("saved").alias("next_saved"))
    whole = run.join(after, F.col("last") + 1 == F.col("next_place"), "left")
    # Members that end at a node: pieces of one block each, hashed one after another.
    pieces = spans.filter("depth = turns").groupBy("first", F.floor(F.col("place") / block).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("own")), lambda x: x.cast("string")), ",").alias("ids"))
    digests = pieces.repartition("first").sortWithinPartitions("first", "block").select("first", "ids").mapInArrow(_digests, "first bigint, ends_sha256 string")
    ends_at = spans.filter("depth = turns").select("first", "depth").distinct().join(digests, "first").select(F.col("first").alias("place"), "depth", "ends_sha256")
    return whole.join(ends_at, ["place", "depth"], "left").select(
        F.col("place").alias("first"), "last", F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"),
        (F.coalesce("next_leaves", F.lit(all_leaves)) - F.col("leaves")).alias("n_leaves"), (F.coalesce("next_saved", F.lit(all_saved)) - F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))
