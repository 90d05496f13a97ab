"""Hard negatives by secondary sort.

Anchors meet all rows in blocks: a block of anchors (at most ``ANCHORS``, a bound on what is broadcast) and, in every
task, slices of its rows, whose scores are one matrix product. A task keeps what can still be needed, not pairs: first
its best ``POSITIVES`` rows of the anchor's label, then, once the windows of scores below the block's positives are
known, its best ``NEGATIVES`` rows of other labels per window. Both are exact: the first of all rows are among the first
of each task.

The kept pairs are packed into keys (anchor, descending score, negative, id). Spark deals them out by anchor and sorts
inside the partitions (``repartition`` and ``sortWithinPartitions``: the DataFrame form of
``repartitionAndSortWithinPartitions``). An iterator reads a partition once: a positive opens its window, a negative is
returned for every open window it lies in, until the window has its number. It holds a handful of windows, never an
anchor's rows. At equal scores positives come before negatives, so that a window is open when its negatives arrive.

Scores are exact integers: matrix products in doubles below 2**53, Python's integers beyond (kept within 64 bits).

Rows: rows with a null id, label or vector, or a null or non-finite component, take no part; equal rows count once;
other rows with one id stay apart, ties between them go by a hash of label and vector. A row is never its own anchor's
partner, nor is any with the anchor's id. Vectors are compared with those of equal length. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_dir, ship, stored

POSITIVES, NEGATIVES = 5, 3
#: A window reaches from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Anchors that are broadcast at a time, and rows in one matrix product.
ANCHORS, SLICE = 8192, 512
SCALE = 256
_EXACT = float(2**53)


def label_of(vec_id: Column, label: Column) -> Column:
    """Labels with the noise that the ids divisible by 7 get."""
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(rows: DataFrame) -> DataFrame:
    """id, label, vector, tie of the rows that take part."""
    double = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), double.alias("vector")).filter(F.coalesce(finite, F.lit(False)))
    return kept.select("id", label_of(F.col("id"), F.col("label")).alias("label"), "vector", F.xxhash64("label", "vector").alias("tie"))


class Anchors:
    """A block of anchors: their vectors, one matrix per length."""

    def __init__(self, rows: list) -> None:
        self.id = np.array([r["id"] for r in rows], np.int64)
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(r["vector"]) for r in rows])
        for size in set(sizes.tolist()):
            at = np.flatnonzero(sizes == size)
            self.by_size[size] = at, np.floor(SCALE * np.array([rows[i]["vector"] for i in at], float).reshape(len(at), size))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, whole numbers, exactly: doubles where they hold them, else Python integers."""
    most = np.abs(a).sum(axis=1).max(initial=0) * np.abs(b).max(initial=0)
    if most < _EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    found = whole(a) @ whole(b).T
    return np.minimum(np.maximum(found, -(2**63)), 2**63 - 1)


class Best:
    """The first ``k`` (score, id, tie) of every slot, of all that were offered."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id, self.tie = np.array([], np.int64), np.array([]), np.array([], np.int64), np.array([], np.int64)
        #: Of a full slot, the score and id of its last; scores below it cannot enter.
        self.least = np.full(slots, -np.inf)
        self.last_id = np.full(slots, np.iinfo(np.int64).max)

    def room(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which of score (a row per slot, a column per id) may still enter."""
        least = self.least[slots][:, None]
        return (score > least) | ((score == least) & (ids[None, :] <= self.last_id[slots][:, None]))

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, tie: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids, tie = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, ids), (self.tie, tie)))
        order = np.lexsort((tie, ids, -score, slot))
        slot, score, ids, tie = slot[order], score[order], ids[order], tie[order]
        new = np.ones(len(slot), bool)  # equal rows count once
        new[1:] = (slot[1:] != slot[:-1]) | (ids[1:] != ids[:-1]) | (tie[1:] != tie[:-1])
        slot, score, ids, tie = slot[new], score[new], ids[new], tie[new]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.append(starts, len(slot))))
        keep = rank < self.k
        self.slot, self.score, self.id, self.tie = slot[keep], score[keep], ids[keep], tie[keep]
        full = rank == self.k - 1
        self.least[slot[full]], self.last_id[slot[full]] = score[full], ids[full]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels, ties and whole-number vectors of rows of one length, a slice at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            lists = batch.column("vector")
            size = np.diff(lists.offsets.to_numpy())
            flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
            start = np.concatenate([[0], np.cumsum(size)])
            for n in np.unique(size):
                own = np.flatnonzero(size == n)
                x = flat[start[own][:, None] + np.arange(n)[None, :]]
                yield *(batch.column(c).to_numpy()[own] for c in ("id", "label", "tie")), x


def _kept(best: Best, per: int, negative: bool) -> pa.RecordBatch:
    n = len(best.slot)
    score = pa.array([int(s) for s in best.score], pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array((best.slot // per).astype(np.int32)), score, pa.array(np.full(n, negative)), pa.array(best.id), pa.array(best.tie)], names=["anchor", "score", "negative", "id", "tie"])


_PAIRS = "anchor int, score bigint, negative boolean, id bigint, tie bigint"


def best_positives(rows: DataFrame, anchors: Anchors, k: int = POSITIVES) -> DataFrame:
    """Per task and anchor, the first rows of its label."""
    given = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = given.value
        best = Best(len(a.id), k)
        for ids, labels, ties, x in _slices(batches):
            if x.shape[1] not in a.by_size:
                continue
            slots, q = a.by_size[x.shape[1]]
            score = products(q, x)
            fits = best.room(slots, score, ids) & (a.label[slots][:, None] == labels[None, :]) & (a.id[slots][:, None] != ids[None, :])
            i, j = np.nonzero(fits)
            best.offer(slots[i], score[i, j], ids[j], ties[j])
        yield _kept(best, 1, False)

    return rows.mapInArrow(run, _PAIRS)


def windows(scores: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score (as a double or integer that compares exactly) of each anchor's windows; none: empty."""
    low, high = np.full((len(scores), k), np.inf), np.full((len(scores), k), -np.inf)
    exact = all(abs(s) * 100 < _EXACT for own in scores for s in own)
    if not exact:
        low, high = low.astype(object), high.astype(object)
    for i, own in enumerate(scores):
        for j, s in enumerate(own):
            lo, hi = -((-LOW * s) // 100), (HIGH * s) // 100  # whole scores between LOW % and HIGH %
            low[i, j], high[i, j] = lo, hi
    return low, high


def best_negatives(rows: DataFrame, anchors: Anchors, scores: list[list[int]], k: int = POSITIVES, n: int = NEGATIVES) -> DataFrame:
    """Per task, anchor and window, the first rows of other labels."""
    given = rows.sparkSession.sparkContext.broadcast((anchors, windows(scores, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (low, high) = given.value
        best = Best(len(a.id) * k, n)
        for ids, labels, ties, x in _slices(batches):
            if x.shape[1] not in a.by_size:
                continue
            slots, q = a.by_size[x.shape[1]]
            score = products(q, x)
            other = (a.label[slots][:, None] != labels[None, :]) & (a.id[slots][:, None] != ids[None, :])
            for w in range(k):
                fits = other & (score >= low[slots, w][:, None]) & (score <= high[slots, w][:, None])
                i, j = np.nonzero(fits & best.room(slots * k + w, score, ids))
                best.offer(slots[i] * k + w, score[i, j], ids[j], ties[j])
        yield _kept(best, k, True)

    return rows.mapInArrow(run, _PAIRS)


def packed(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out by anchor and sorted by key inside the partitions: anchor, descending score, positives first, id."""
    return pairs.repartition("anchor").sortWithinPartitions("anchor", F.col("score").desc(), "negative", "id", "tie")


def mined(batches: Iterator[pa.RecordBatch], n_positives: int, n_negatives: int) -> Iterator[tuple[int, tuple[int, int] | None, int, tuple[int, int]]]:
    """(anchor, positive (score, id), rank, negative (score, id)) from sorted pairs; rank 0 and no negative for a positive."""
    anchor, before, open_ = None, None, []
    seen = 0
    for batch in batches:
        for key in zip(*(batch.column(c).to_pylist() for c in ("anchor", "score", "negative", "id", "tie")), strict=True):
            if key == before:
                continue
            before = key
            if key[0] != anchor:
                anchor, open_, seen = key[0], [], 0
            _, score, negative, id_, _ = key
            if not negative:
                if seen < n_positives:
                    seen += 1
                    open_.append([score, id_, 0])
                    yield anchor, (score, id_), 0, (0, 0)
                continue
            # A window is done when it is full, or when scores have fallen below it.
            open_ = [w for w in open_ if w[2] < n_negatives and LOW * w[0] <= 100 * score]
            for w in open_:
                if 100 * score <= HIGH * w[0]:
                    w[2] += 1
                    yield anchor, (w[0], w[1]), w[2], (score, id_)


def _table(found: list[tuple[int, tuple[int, int], int, tuple[int, int]]], anchor_ids: np.ndarray) -> pa.RecordBatch:
    columns = [[int(anchor_ids[f[0]]) for f in found], [f[1][1] for f in found], [f[2] for f in found], [f[3][1] for f in found], [f[1][0] for f in found], [f[3][0] for f in found]]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(rows: DataFrame, is_anchor: Column, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor`` is over ``id``."""
    spark = rows.sparkSession
    ship(spark)
    good = usable(rows)
    if good.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # few files: deal the rows out
        good = good.repartition(2 * spark.sparkContext.defaultParallelism, "id", "tie")
    good = stored(good)
    chosen = good.filter(is_anchor).dropDuplicates(["id", "label", "tie"])
    blocks = -(-chosen.count() // anchors)
    if not blocks:
        return spark.createDataFrame([], SCHEMA)
    dealt = chosen.withColumn("part", F.pmod(F.xxhash64("id", "tie", F.lit(5)), F.lit(2 * blocks if blocks > 1 else 1)))
    path = scratch_dir(spark)
    parts = 2 * blocks if blocks > 1 else 1  # by hash, so half of the bound on average
    for part in range(parts):
        block = dealt.filter(F.col("part") == part).select("id", "label", "vector").collect()
        for at in range(0, len(block), anchors):
            _mine_block(good, Anchors(block[at : at + anchors]), f"{path}/block={part}-{at}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/{name}" for name in _names(spark, path)])


def _names(spark, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


def _mine_block(good: DataFrame, anchors: Anchors, path: str) -> None:
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(a, s, i) for a, (s, i), _, _ in mined(batches, POSITIVES, NEGATIVES)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["anchor", "score", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for f in mined(batches, POSITIVES, NEGATIVES):
            if f[2]:
                found.append(f)
            if len(found) == 10_000:
                yield _table(found, anchor_ids)
                found = []
        yield _table(found, anchor_ids)

    spark, anchor_ids = good.sparkSession, anchors.id
    # At most POSITIVES rows per anchor of the block reach the driver.
    top = packed(best_positives(good, anchors)).mapInArrow(first, "anchor int, score bigint, id bigint").collect()
    scores: list[list[int]] = [[] for _ in anchor_ids]
    for r in top:
        scores[r["anchor"]].append(r["score"])
    positives = spark.createDataFrame([(r["anchor"], r["score"], False, r["id"], n) for n, r in enumerate(top)], _PAIRS)
    packed(positives.unionAll(best_negatives(good, anchors, scores))).mapInArrow(run, SCHEMA).write.parquet(path)
