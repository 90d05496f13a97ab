"""Approximate nearest neighbours by learned partitions.

A bounded sample of the vectors (a documented parameter) is linked to its nearest neighbours. The graph is cut into
balanced parts with few links between them: halves by principal direction first, then moves of single vectors to the
part that most of their neighbours are in, while sizes allow. A small classifier learns, from a vector, how its
neighbours spread over the parts. It gives every row its part, and every query the most probable parts, as many as
calibration on the sample needs for the wanted recall. All rows of those parts are reranked exactly.

Nearness is the inner product of the original vectors in double precision, added from the first component to the last;
ties go to the smaller id. Parts are cut into blocks of bounded size by hash, and so are the queries of a part, so that
a part with a third of all rows, or many copies of a vector, is spread over many tasks.

Rows: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
rows without an id neither. Rows with equal id and vector count once. Fewer rows than asked for give all there are; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored

#: Most rows that graph and classifier are fitted on; of them, those that calibrate the number of parts.
SAMPLE_ROWS = 12_000
CALIBRATION_ROWS = 1_000
WANTED_RECALL = 0.95
GRAPH_NEIGHBOURS = 20
#: Most rows of a part, and most queries, that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 2_048


@dataclass(frozen=True)
class Router:
    """Weights of the classifier, number of parts, and how many a query visits."""

    centre: np.ndarray
    scale: float
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    probes: int
    recall: float

    @property
    def parts(self) -> int:
        return len(self.out_bias)

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.centre) / self.scale) @ self.hidden + self.hidden_bias, 0)
        return h @ self.out + self.out_bias


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    x = F.col("vec")
    good: Column = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    out = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).filter(F.coalesce(good, F.lit(False)))
    length = out.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return out.filter(F.size("vec") == (length[0][0] if length else 0)).dropDuplicates(["vec_id", "vec"])


def _neighbours(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest rows of x for the given places, without themselves."""
    out = np.empty((len(queries), min(k, len(x) - 1)), np.int64)
    for s in range(0, len(queries), 512):
        at = queries[s : s + 512]
        near = x[at] @ x.T
        near[np.arange(len(at)), at] = -np.inf
        out[s : s + 512] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 8) -> np.ndarray:
    """Part of every vector: halves by principal direction, then moves along the links within the sizes allowed."""
    label = np.zeros(len(x), np.int64)
    for _ in range(int(np.log2(parts))):
        new = label * 2
        for p in np.unique(label):
            own = np.flatnonzero(label == p)
            y = x[own] - x[own].mean(axis=0)
            axis = np.linalg.eigh(y.T @ y)[1][:, -1]
            new[own[np.argsort(y @ axis, kind="stable")[len(own) // 2 :]]] += 1
        label = new
    most = slack * len(x) / parts
    size = np.bincount(label, minlength=parts)
    for _ in range(sweeps):
        links = np.zeros((len(x), parts), np.float32)
        np.add.at(links, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
        np.add.at(links, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = links.argmax(axis=1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] + 1 <= most:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def _train(x: np.ndarray, target: np.ndarray, width: int, epochs: int, seed: int) -> list[np.ndarray]:
    """One hidden layer, cross entropy with the neighbours' parts, Adam steps."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], width)), np.zeros(width), rng.normal(0, width**-0.5, (width, target.shape[1])), np.zeros(target.shape[1])]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[at] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[at]) / len(at)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def fit(rows: DataFrame, parts: int = 32, k: int = 20, sample_rows: int = SAMPLE_ROWS, wanted: float = WANTED_RECALL, seed: int = 5) -> Router | None:
    """Learn from a hash sample of ``usable`` rows; None for fewer rows than an index is worth."""
    n = rows.count()
    picked = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_rows / max(1, n))
    x = np.array([r[0] for r in rows.filter(picked).orderBy("vec_id").limit(2 * sample_rows).select("vec").collect()])
    if len(x) < 4 * parts:
        return None
    graph = _neighbours(x, np.arange(len(x)), GRAPH_NEIGHBOURS)
    label = balanced_parts(x, graph, parts)
    spread = np.zeros((len(x), parts))
    np.add.at(spread, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.ravel()]), 1)
    np.add.at(spread, (np.arange(len(x)), label), graph.shape[1] / 4)
    spread /= spread.sum(axis=1, keepdims=True)
    centre, scale = x.mean(axis=0), float(x.std()) or 1.0
    # Calibrate on vectors the classifier hasn't seen: it is fitted on the others first and on all of them then.
    rng = np.random.default_rng(seed)
    held = np.sort(rng.permutation(len(x))[: min(CALIBRATION_ROWS, len(x) // 5)])
    seen = np.setdiff1d(np.arange(len(x)), held)
    make = lambda at: Router(centre, scale, *_train((x[at] - centre) / scale, spread[at], 128, 25, seed), parts, 1.0)
    trial = make(seen)
    place = trial.logits(x).argmax(axis=1)
    order = np.argsort(-trial.logits(x[held]), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(held), 0), axis=1)
    found = np.take_along_axis(rank, place[_neighbours(x, held, k)], axis=1)
    recall = [(found < m).mean() for m in range(1, parts + 1)]
    probes = next(i + 1 for i, r in enumerate(recall) if r >= wanted or i + 1 == parts)
    final = make(np.arange(len(x)))
    return Router(centre, scale, final.hidden, final.hidden_bias, final.out, final.out_bias, probes, float(recall[probes - 1]))


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, id and score of each query's k nearest rows of a block."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rough = queries @ vectors.T
    edge = 1e-9 * (np.abs(queries).sum(axis=1) * np.abs(vectors).max() + 1e-300)
    for i, q in enumerate(query_ids):
        row = np.where(ids == q, -np.inf, rough[i])
        cut = np.partition(row, -k)[-k] - edge[i] if len(row) > k else -np.inf
        near = np.flatnonzero((row >= cut) & (ids != q))
        exact = np.zeros(len(near))
        for j in range(vectors.shape[1]):  # one component after another, whatever the block
            exact += queries[i, j] * vectors[near, j]
        best = np.lexsort((ids[near], -exact))[:k]
        out.append((np.full(len(best), q), ids[near][best], exact[best]))
    if not out:
        return np.array([], np.int64), np.array([], np.int64), np.array([])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def search(rows: DataFrame, is_query: Column, router: Router | None, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``usable`` that ``is_query`` marks, its k nearest other rows."""
    spark = rows.sparkSession
    ship(spark)

    def place(frames):
        for f in frames:
            if router is None or f.empty:
                routed = [[0]] * len(f)
            else:
                routed = np.argsort(-router.logits(np.stack(f["vec"])), axis=1, kind="stable")[:, : router.probes].tolist()
            yield f.assign(routed=routed)

    placed = stored(rows.withColumn("query", is_query).mapInPandas(place, "vec_id bigint, vec array<double>, query boolean, routed array<int>"))
    base = placed.withColumn("part", F.col("routed")[0])
    asked = placed.filter("query").select("vec_id", "vec", F.explode("routed").alias("part"))
    n_base = {r[0]: r[1] for r in base.groupBy("part").count().collect()}  # one row per part
    n_asked = {r[0]: r[1] for r in asked.groupBy("part").count().collect()}
    sizes = [(p, -(-n_base[p] // BLOCK_ROWS), max(1, -(-n_asked.get(p, 0) // BLOCK_QUERIES))) for p in n_base]
    cuts = F.broadcast(spark.createDataFrame(sizes, "part int, blocks int, chunks int"))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = base.join(cuts, "part").select("part", of("blocks").alias("block"), each("chunks").alias("chunk"), "vec_id", "vec")
    asked = asked.join(cuts, "part").select("part", each("blocks").alias("block"), of("chunks").alias("chunk"), F.col("vec_id").alias("query_id"), F.col("vec").alias("asked"))

    def rerank(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
        q, i, s = _nearest(queries["query_id"].to_numpy(), np.stack(queries["asked"]), block["vec_id"].to_numpy(), np.stack(block["vec"]), k)
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    key = ["part", "block", "chunk"]
    found = asked.groupBy(key).cogroup(base.groupBy(key)).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("near"))
    return best.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, parts: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit, route and rerank."""
    known = stored(usable(rows, id_col, vector_col))
    return search(known, is_query, fit(known, parts, k), k)
