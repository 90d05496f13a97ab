"""N-gram Jaccard join with Bayesian pruning of candidates.

A document is the set of its five-word shingles. Equal sets collapse to one class first. MinHash bands give candidate
groups (``nearsets``). Inside a group, pairs compare their MinHash values 20 at a time and drop out once the posterior
probability of reaching the threshold falls below the tolerance (uniform prior); the rest are verified exactly. The
result is one row per document, with its class and number of links, so copies are never expanded into pairs.

Recall: a pair of Jaccard 0.8 shares one of 20 bands of 5 values with probability 0.9997, and pairs of one candidate
group are compared even without a common band. A true pair falls below the tolerance with a probability near 1e-7.

Rows: words are runs of non-blank ASCII; a text of one to four words is one shingle. A text without words, or null,
links to nothing and is its own class. Rows with equal id and text are one document. Null ids count as unknown: a class
of them alone has a null class id. Other columns are ignored by ``join`` and kept by ``keep_one``. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearsets
from .common import row_key, ship, stored
from .components import components

WIDTH, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS = 20, 5
_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    import xxhash

    column = pc.ascii_trim_whitespace(pc.fill_null(pa.array(texts, pa.string()), ""))
    words = pc.ascii_split_whitespace(column)
    offsets = words.offsets.to_numpy().astype(np.int64)
    found = pc.dictionary_encode(words.flatten())
    names = found.dictionary.to_pylist()
    h = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64)[found.indices.to_numpy()] if names else np.array([], np.uint64)
    grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        grams = mix(grams + h[k : k + len(grams)])
    out = []
    for i, empty in enumerate(pc.equal(column, "").to_pylist()):
        start, n = offsets[i], offsets[i + 1] - offsets[i]
        if empty:
            out.append(np.array([], np.uint64))
        elif n < width:
            g = np.uint64(n)
            for x in h[start : start + n]:
                g = mix(np.array([g + x]))[0]
            out.append(np.array([g], np.uint64))
        else:
            out.append(np.unique(grams[start : start + n - width + 1]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per set."""
    out = np.full((len(sets), BANDS * ROWS), np.uint64(2**64 - 1))
    for i, s in enumerate(sets):
        for at in range(0, len(s), 4096):
            np.minimum(out[i], (s[at : at + 4096, None] * _MULTIPLY + _ADD).min(axis=0), out=out[i])
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    """One value per band, each band's on its own scale."""
    v = np.zeros((len(sig), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        v = mix(v + mix(sig[:, k::ROWS][:, :BANDS]))
    return v.view(np.int64)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with key and class of equal sets, those classes with their near-duplicate class and links, docs by key)."""
    ship(docs.sparkSession)
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    sets = shingle_sets(batch.column("text").to_pylist())
                    ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                    bands = band_values(signatures(sets)).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key"), batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "doc_id", "set_id", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(keyed.mapInArrow(measure, f"key binary, doc_id {kind}, set_id binary, bands array<bigint>"))
    sets = rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("key").alias("key"), F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"))
    sets = stored(sets.withColumn("node", F.xxhash64("set_id")))
    groups = nearsets.candidate_groups(sets.select("node", "bands"))
    wanted = sets.join(groups, "node").select("root", "node", F.col("key").alias("wanted"))
    members = keyed.join(wanted, F.col("key") == F.col("wanted")).dropDuplicates(["key"]).select("root", "node", "text")

    def shingles(texts: list[str]) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            return shingle_sets(texts)

    def sign(s: list[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return signatures(s)

    links = nearsets.linked(members, groups, shingles, sign, THRESHOLD, TOLERANCE)
    near = components(links.select(F.col("node").alias("a"), F.col("tree").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    classes = sets.drop("bands").join(near, "node", "left").join(counts, "node", "left").select(
        "set_id", "key", "copy_of", "n_copies", F.coalesce("root", "node").alias("near"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.drop("bands"), classes, keyed


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of its near-duplicate class), copy_of (least id with the same shingles), n_copies
    (documents with the same shingles), n_links (different shingle sets of the join's similarity)."""
    rows, classes, _ = _classes(docs, id_col, text_col)
    classes = stored(classes)
    least = classes.groupBy("near").agg(F.min("copy_of").alias("class_id"))
    known = classes.join(least, "near").select("set_id", "class_id", "copy_of", "n_copies", "n_links")
    return rows.join(known, "set_id", "left").select(
        "doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least id, with all columns; documents without words stay."""
    rows, classes, _ = _classes(docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    firsts = rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min(order).alias("first"))
    kept = classes.select("set_id", "near").join(firsts, "set_id").groupBy("near").agg(F.min("first").alias("first")).select(F.col("first.key").alias("kept_key"))
    kept = stored(kept.unionAll(rows.filter("set_id IS NULL").select("key").distinct()))
    given = docs.select(F.struct("*").alias("given"), row_key(F.col(id_col), F.col(text_col)).alias("given_key"))
    one = given.join(kept, F.col("given_key") == F.col("kept_key")).dropDuplicates(["given_key"])
    return one.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])
