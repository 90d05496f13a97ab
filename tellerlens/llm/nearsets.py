"""Pairs of similar sets without listing pairs: bands to candidate groups, groups to blocks, blocks to exact links.

Sets whose signatures agree in a band are joined by star edges to the least of them; connected sets form a candidate
group. A group is cut into blocks of bounded size by hash. Each pair of blocks goes to one task, which compares its sets
and returns, per set, how many links it has there and the root of its tree of links: rows grow with sets, not pairs.
Where only trees are asked for, sets already in one tree are not compared, nor those whose hashed elements differ too much.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .components import components

BLOCK = 256
#: Cells of one 0/1 matrix; pairs of sets up to which no matrix is made; rows of a product of matrices.
CELLS, FEW, STRIPE = 4_000_000, 16, 256
#: Pairs of a band's value and a node that a task holds at a time.
PAIRS = 1 << 20
#: Bits of ``maybe_in``'s table for each member, and of the whole table at least and at most.
SPOTS, LEAST_BITS, MOST_BITS = 16, 1 << 22, 1 << 26
#: Characters of text in a block.
CHARACTERS = 1_000_000


#: Nodes of a batch and, one row for each, their values of every band.
Banded = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def _stars(values: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the least node of each, and edges a, b from its other nodes to that one."""
    order = np.argsort(values)
    values, nodes = values[order], nodes[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    least = np.minimum.reduceat(nodes, start)
    centre = np.repeat(least, np.diff(start, append=len(values)))
    other = nodes != centre
    a, b = _distinct(nodes[other], centre[other])
    return values[start], least, a, b


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _pieces(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of x between its cuts."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def band_edges(rows: DataFrame, bands: Banded) -> DataFrame:
    """Edges a, b between sets that share a value of a band, star by star. A node may come in several rows.

    Values are shuffled packed, in parts of their range. A task settles ``PAIRS`` of them at a time: of each value, only
    its least node goes on, the other nodes' edges to it are found there. So a hot value is no more than a pair for each
    of these, wherever its nodes meet.
    """
    parts = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, nodes, held = [], [], 0

        def packed() -> pa.RecordBatch:
            v, node, a, b = _stars(np.concatenate(values), np.concatenate(nodes))
            at = np.searchsorted((v >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
            also = np.linspace(0, len(a), parts + 1).astype(np.int64)
            every = [pa.array(np.arange(parts, dtype=np.int32)), *(_pieces(x, cuts) for x, cuts in ((v, at), (node, at), (a, also), (b, also)))]
            return pa.RecordBatch.from_arrays(every, names=["part", "v", "node", "a", "b"]).filter(pa.array((np.diff(at) > 0) | (np.diff(also) > 0)))

        for batch in batches:
            for own, v in bands(batch):
                if v.size:
                    values.append(np.ascontiguousarray(v).ravel().view(np.uint64))
                    nodes.append(np.repeat(own, v.shape[1]))
                    held += v.size
                if held >= PAIRS:
                    yield packed()
                    values, nodes, held = [], [], 0
        if held:
            yield packed()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, done, n = None, [], [], 0

        def close() -> None:
            v, node, a, b = (np.concatenate([np.frombuffer(x[k], kind) for x in held]) for k, kind in enumerate((np.uint64, np.int64, np.int64, np.int64)))
            if len(v):
                more = _stars(v, node)
                a, b = np.concatenate([a, more[2]]), np.concatenate([b, more[3]])
            done.append(_distinct(a, b))
            held.clear()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in done] or [np.zeros(0, np.int64)])) for k in (0, 1)], names=["a", "b"])
            done.clear()
            return made

        for batch in batches:
            for p, *x in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if p != part and held:
                    close()
                    if (n := n + len(done[-1][0])) > PAIRS:
                        yield flush()
                        n = 0
                part = p
                held.append(x)
        if held:
            close()
        yield flush()

    ship(rows.sparkSession)
    dealt = rows.mapInArrow(pack, "part int, v binary, node binary, a binary, b binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "a bigint, b bigint")


def listed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and values of a batch with columns ``node`` and ``bands``, lists of one length."""
    if batch.num_rows:
        yield batch.column("node").to_numpy(), batch.column("bands").flatten().to_numpy().reshape(batch.num_rows, -1)


def candidate_groups(rows: DataFrame, bands: Banded = listed) -> DataFrame:
    """node, root of every set that shares a band with another."""
    return components(band_edges(rows, bands))


def maybe_in(value: Column, members: DataFrame, bits: int | None = None) -> Column:
    """False only where ``value`` is none of ``members`` (one column of longs): a table of bits, by default in proportion
    to the members within bounds, reaches each task as a scalar subquery. A filter before an exchange; the join that
    follows decides."""
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPOTS * members.count()).bit_length()))
    spot = lambda x: F.pmod(F.xxhash64(x, F.lit(11)), F.lit(bits))
    own = spot(F.col(members.columns[0]))
    words = members.select(F.call_function("div", own, F.lit(64)).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (own % 64).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("word"))
    every = members.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("at"), "left")
    table = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))), lambda w: w["word"])).scalar()
    return F.getbit(F.element_at(table, (F.call_function("div", spot(value), F.lit(64)) + 1).cast("int")), (spot(value) % 64).cast("int")) == 1


def least_matches(steps: list[int], threshold: float, tolerance: float) -> list[int]:
    """For each number of compared hashes, the fewest matches at which the similarity reaches the threshold with a
    posterior probability of at least ``tolerance``, from a uniform prior."""
    out = []
    for n in steps:
        tail, m = 0.0, 0
        # P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m)
        while True:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance or m == n:
                break
            m += 1
        out.append(m)
    return out


Shingler = Callable[[list[str]], list[np.ndarray]]
Signer = Callable[[list[np.ndarray]], np.ndarray]


def _alive(sig_a: np.ndarray, sig_b: np.ndarray, threshold: float, tolerance: float, step: int = 20) -> np.ndarray:
    """Pairs that survive the comparison of their MinHash values, some more at a time."""
    steps = list(range(step, sig_a.shape[1] + 1, step))
    alive = np.ones((len(sig_a), len(sig_b)), bool)
    matches = np.zeros((len(sig_a), len(sig_b)), np.int32)
    for n, least in zip(steps, least_matches(steps, threshold, tolerance), strict=True):
        if alive.mean() > 0.05:
            for k in range(n - step, n):
                matches += sig_a[:, k][:, None] == sig_b[:, k][None, :]
        else:
            i, j = np.nonzero(alive)
            matches[i, j] += (sig_a[i, n - step : n] == sig_b[j, n - step : n]).sum(axis=1)
        alive &= matches >= least
        if not alive.any():
            break
    return alive


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Common elements of a sorted set with each of others."""
    cat = np.concatenate(others)
    at = np.searchsorted(one, cat)
    at[at == len(one)] = 0
    return np.add.reduceat((one[at] == cat).astype(np.int64), np.cumsum([0] + [len(o) for o in others[:-1]]))


def _common(a: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Common elements of every two sets, as products of 0/1 matrices of bounded size. Elements of one set alone are left out."""
    sets = a if other is a else a + other
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
    every = every[order]
    same = every[1:] == every[:-1]
    new = np.concatenate([[True], ~same])
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    owner, element = owner[shared], np.cumsum(new[shared]) - 1
    out = np.zeros((len(a), len(other)), np.int64)
    if not len(element):
        return out
    width = max(1, CELLS // len(sets))
    for at in range(0, int(element[-1]) + 1, width):
        lo, hi = np.searchsorted(element, [at, at + width])
        has = np.zeros((len(sets), min(width, int(element[-1]) + 1 - at)), np.float32)
        has[owner[lo:hi], element[lo:hi] - at] = 1
        left = has[: len(a)]
        out += (left @ (left if other is a else has[len(a) :]).T).astype(np.int64)
    return out


def _few_links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, list[int]]]:
    """``block_links`` of a handful of sets, without matrices; two sorted sets merge, and equal neighbours are common."""
    least = round(10_000 * threshold)
    for i, x in enumerate(a):
        near = []
        for j, y in enumerate(a if b is None else b):
            if (b is None and j <= i) or min(len(x), len(y)) < threshold * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            if 10_000 * common >= least * (len(x) + len(y) - common):
                near.append(j)
        if near:
            yield i, near


def block_links(a: list[np.ndarray], b: list[np.ndarray] | None, sign: Signer | None, threshold: float, tolerance: float) -> Iterator[tuple[int, list[int]]]:
    """For each set of block a, its places in b (in a itself beyond it, if b is None) with a Jaccard of the threshold."""
    other = a if b is None else b
    if sign is None and len(a) * len(other) <= FEW:
        yield from _few_links(a, b, threshold)
        return
    if sign is not None:
        sig = sign(a)
        alive = _alive(sig, sig if b is None else sign(other), threshold, tolerance)
    else:
        alive = np.ones((len(a), len(other)), bool)
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in other])
    alive &= np.minimum(size_a[:, None], size_b[None, :]) >= threshold * np.maximum(size_a[:, None], size_b[None, :])
    if b is None:
        alive &= np.triu(np.ones_like(alive), 1)
    every = _common(a, other) if sign is None else None
    for i in np.flatnonzero(alive.any(axis=1)):
        near = np.flatnonzero(alive[i])
        common = _overlaps(a[i], [other[j] for j in near]) if every is None else every[i, near]
        # In whole numbers of ten thousandths, so that a similarity of exactly the threshold counts.
        linked = 10_000 * common >= round(10_000 * threshold) * (size_a[i] + size_b[near] - common)
        if linked.any():
            yield int(i), near[linked].tolist()


def _merge(tree: np.ndarray, links: np.ndarray, rows: np.ndarray, others: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Joins trees by a matrix of links between rows and others, places in ``tree``; gives the links that joined some."""
    for k, i in enumerate(rows):
        new = others[links[k] & (tree[others] != tree[i])]
        if len(new):
            tree[np.isin(tree, tree[new])] = tree[i]
            yield int(i), new


def tree_links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, list[int]]]:
    """As many of ``block_links`` as connect all that these connect.

    Elements are hashed to spots. A spot that one set has alone holds an element that it has alone, so products of spots
    bound what two sets share. Sets that this may connect are compared exactly, apart from the others.
    """
    other = a if b is None else b
    if len(a) * len(other) <= FEW:
        yield from _few_links(a, b, threshold)
        return
    sets, off = (a, 0) if b is None else (a + b, len(a))
    size = np.array([len(x) for x in sets])
    least = round(10_000 * threshold)
    bits = int(min(max(256, 2 * size.mean()), max(256, CELLS / len(sets)))).bit_length()
    spots = np.concatenate(sets).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
    has = np.zeros((len(sets), 1 << bits), np.float32)
    has[np.repeat(np.arange(len(sets)), size), spots.astype(np.int64)] = 1
    hidden, sizes = (size - has.sum(axis=1)).astype(np.float32), size.astype(np.float32)
    places = np.arange(len(sets))
    part = places.copy()
    for at in range(0, len(a), STRIPE):
        rows = places[at : min(at + STRIPE, len(a))]
        most = has[rows] @ has[off:].T
        most += np.minimum(hidden[rows, None], hidden[None, off:])
        # The similarity grows with what is common; sums are taken for less by more than floats lose.
        may = (10_000 + least) * most >= least * np.float32(1 - 1e-5) * (sizes[rows, None] + sizes[None, off:])
        for _ in _merge(part, may, rows, places[off:]):
            pass
    del has
    tree = places.copy()
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        rows, cols = own[own < len(a)], own[own >= off]
        if len(own) < 2 or not len(rows) or not len(cols):
            continue
        one, two = [sets[k] for k in rows], [sets[k] for k in cols]
        if len(one) * len(two) <= FEW:
            for i, near in _few_links(one, None if b is None else two, threshold):
                yield int(rows[i]), (cols[near] - off).tolist()
            continue
        common = _common(one, one if b is None else two)
        linked = 10_000 * common >= least * (size[rows, None] + size[None, cols] - common)
        for i, near in _merge(tree, linked, rows, cols):
            yield i, (near - off).tolist()


def linked(members: DataFrame, groups: DataFrame, shingles: Shingler, sign: Signer | None, threshold: float, tolerance: float = 1e-7, block: int = BLOCK) -> DataFrame:
    """node, tree, n: links of each set in each pair of blocks, and the least node of its tree there.

    ``members``: root, node, text; one row per distinct set of a candidate group; ``groups``: their node and root alone,
    for the sizes, with the text's length as ``size`` if blocks are to be bounded by that too. Sets without a link give no
    row. Without ``sign``, only links that connect trees are sought, and n counts those.
    """
    ship(members.sparkSession)
    n = F.count(F.lit(1))
    blocks = F.ceil(n / block) if "size" not in groups.columns else F.least(n, F.ceil(F.greatest(n / block, F.sum("size") / CHARACTERS)))
    # Groups of one block are most by far, the others no more than one for so many sets.
    sizes = groups.groupBy("root").agg(blocks.cast("int").alias("blocks")).filter("blocks > 1")
    cut = members.join(F.broadcast(sizes), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "text")
    dealt = cut.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "own", "node")

    def task(nodes: list[int], own: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
        split = next((k for k, o in enumerate(own) if o != own[0]), len(own))
        n, tree = [0] * len(nodes), list(range(len(nodes)))

        def top(x: int) -> int:
            while tree[x] != x:
                tree[x] = tree[tree[x]]
                x = tree[x]
            return x

        crossing = split < len(own)
        one, two = sets[:split], sets[split:] if crossing else None
        for i, near in tree_links(one, two, threshold) if sign is None else block_links(one, two, sign, threshold, tolerance):
            for j in near:
                j += split if crossing else 0
                n[i] += 1
                n[j] += 1
                tree[top(j)] = top(i)
        least: dict[int, int] = {}
        for k in range(len(nodes)):
            least[top(k)] = min(least.get(top(k), nodes[k]), nodes[k])
        hit = [k for k in range(len(nodes)) if n[k]]
        return [nodes[k] for k in hit], [least[top(k)] for k in hit], [n[k] for k in hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, own, sets = None, [], [], []
        out: tuple[list[int], list[int], list[int]] = ([], [], [])

        def close() -> None:
            # A pair of different blocks is whole only with rows of both; one block alone is compared in its own pair.
            if len(nodes) > 1 and (group[1] == group[2] or own[0] != own[-1]):
                for have, more in zip(out, task(nodes, own, sets), strict=True):
                    have.extend(more)

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["node", "tree", "n"])
            for x in out:
                x.clear()
            return made

        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            made = shingles(batch.column("text").to_pylist())
            for root, i, j, o, node, x in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "own", "node")), made, strict=True):
                if (root, i, j) != group:
                    close()
                    group, nodes, own, sets = (root, i, j), [], [], []
                nodes.append(node)
                own.append(o)
                sets.append(x)
            if len(out[0]) > 10_000:
                yield flush()
        close()
        yield flush()

    return stored(dealt.mapInArrow(run, "node bigint, tree bigint, n bigint"))
