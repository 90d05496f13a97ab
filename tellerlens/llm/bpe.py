"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

Spark splits whole texts into pre-tokens and deals them out. In a task, the distinct pre-tokens of a batch become
token-position rows, bytes at first. A recursive query joins them with the merge table and contracts the leftmost pair
of lowest rank of every word until no word has a pair left. Ordered aggregation gives each word's ids and, from the
ids, its bytes; texts are put together from their words. A database keeps the words it has seen, up to a bound, and
is closed with its task, so that a worker's next stage finds its memory free.

Words of over ``LONG`` bytes would take as many rounds as they have bytes; a heap gives them the same merges.

Rows: a null text is empty: no ids, no bytes. Equal rows get equal results, null ids stay, other columns are ignored,
an empty table gives an empty result. Special strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import pretokens

LONG = 256
#: Words in one recursive query, which holds the rows of all its rounds, and words kept by a worker's database before it
#: starts anew.
BLOCK = 10_000
KEPT = 200_000

#: A pair's key is left id * 2**20 + right id. ``best`` packs rank, place and length of the left token: its minimum is
#: the leftmost pair of lowest rank. The row after the pair becomes the merged token; the row before learns its neighbour.
ENCODE = """
WITH RECURSIVE state(step, w, pos, len, tok, nxt) AS (
    SELECT 0, w, pos, 1, tok, nxt FROM bytes_
  UNION ALL
    SELECT s.step + 1, s.w,
           CASE WHEN s.pos = b.q THEN b.p ELSE s.pos END,
           CASE WHEN s.pos = b.q THEN s.pos + s.len - b.p ELSE s.len END,
           CASE WHEN s.pos = b.q THEN b.merged ELSE s.tok END,
           CASE WHEN s.pos + s.len = b.p THEN b.merged ELSE s.nxt END
    FROM state s JOIN (
        SELECT w, ((best >> 10) & 1023)::INTEGER AS p, (((best >> 10) & 1023) + (best & 1023))::INTEGER AS q, (best >> 20)::INTEGER AS merged
        FROM (SELECT t.w, min((m.merged << 20) + (t.pos << 10) + t.len) AS best
              FROM state t JOIN merges m ON m.pair = ((t.tok::BIGINT << 20) + t.nxt) WHERE t.nxt >= 0 GROUP BY t.w)
    ) b ON b.w = s.w
    WHERE s.pos <> b.p
), last AS (SELECT w, max(step) AS step FROM state GROUP BY w)
SELECT s.w, count(*) AS n, string_agg(v.name, ',' ORDER BY s.pos) AS ids, string_agg(v.bytes, '' ORDER BY s.pos) AS back
FROM state s JOIN last USING (w, step) JOIN vocab v ON v.id = s.tok GROUP BY s.w
"""


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def heap_merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of a long word: pairs wait in a heap by rank and place; tokens are linked."""
    n = len(word)
    ends, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def push(i: int) -> None:
        if i >= 0 and ends[i] < n and (r := rank.get(word[i : ends[ends[i]]])) is not None:
            heapq.heappush(heap, (r, i, ends[i], ends[ends[i]]))

    for i in range(n):
        push(i)
    gone = bytearray(n)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if gone[i] or ends[i] != mid or ends[mid] != end:
            continue
        gone[mid], ends[i] = 1, end
        if end < n:
            before[end] = i
        push(i)
        push(before[i])
    return [rank[word[i : ends[i]]] for i in range(n) if not gone[i]]


class Coder:
    """A worker's database: vocabulary, merge table and the words encoded so far."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.rank = ranks(path)
        self.first = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.by_id = {r: t for t, r in self.rank.items()}
        # Spills, should it come to that, go to the worker's own folder, which ends with the executor.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": tempfile.gettempdir()})
        cuts = [(a << 20 | b, r) for t, r in self.rank.items() for i in range(1, len(t))
                if (a := self.rank.get(t[:i])) is not None and (b := self.rank.get(t[i:])) is not None]
        merges_ = pa.table({"pair": pa.array([p for p, _ in cuts], pa.int64()), "merged": pa.array([r for _, r in cuts], pa.int64())})
        vocab_ = pa.table({"id": pa.array(self.by_id, pa.int32()), "name": [str(i) for i in self.by_id], "bytes": [t.hex() for t in self.by_id.values()]})
        for name, table in (("merges", merges_), ("vocab", vocab_)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.forget()

    def forget(self) -> None:
        self.db.execute("CREATE OR REPLACE TABLE known(word VARCHAR, n BIGINT, ids VARCHAR, back VARCHAR)")
        self.n_known = 0

    def encode(self, words: pa.Array) -> pa.Table:
        """n, ids (joined by commas), back (hexadecimal bytes) of distinct words, in their order."""
        if self.n_known > KEPT:
            self.forget()
        self.db.register("asked", pa.table({"place": pa.array(np.arange(len(words)), pa.int64()), "word": words}))
        new = self.db.sql("SELECT word FROM asked ANTI JOIN known USING (word)").to_arrow_table().column("word").combine_chunks()
        for start in range(0, len(new), BLOCK):
            self._add(new.slice(start, BLOCK))
        return self.db.sql("SELECT n, ids, back FROM asked JOIN known USING (word) ORDER BY place").to_arrow_table()

    def _add(self, words: pa.Array) -> None:
        data = words.cast(pa.binary())
        size = pc.binary_length(data).to_numpy(zero_copy_only=False)
        long = np.flatnonzero(size > LONG)
        short = words.filter(pa.array(size <= LONG))
        size = size[size <= LONG].astype(np.int64)
        raw = np.frombuffer(b"".join(short.cast(pa.binary()).to_pylist()), np.uint8)
        start = np.cumsum(size) - size
        w = np.repeat(np.arange(len(size), dtype=np.int32), size)
        tok = self.first[raw]
        nxt = np.append(tok[1:], -1)[: len(tok)].astype(np.int32)
        nxt[(start + size - 1)[size > 0]] = -1
        pos = (np.arange(len(raw)) - start[w]).astype(np.int32)
        self.db.register("bytes_", pa.table({"w": w, "pos": pos, "tok": tok, "nxt": nxt}))
        self.db.register("names_", pa.table({"w": pa.array(np.arange(len(size)), pa.int32()), "word": short}))
        self.db.execute(f"INSERT INTO known SELECT word, n, ids, back FROM ({ENCODE}) JOIN names_ USING (w)")
        for i in long.tolist():
            ids = heap_merge(data[i].as_py(), self.rank)
            row = [words[i].as_py(), len(ids), ",".join(map(str, ids)), b"".join(self.by_id[x] for x in ids).hex()]
            self.db.execute("INSERT INTO known VALUES (?, ?, ?, ?)", row)
        self.n_known += len(words)


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def close(path: str) -> None:
    if coder.cache_info().currsize:
        coder(path).db.close()
    coder.cache_clear()
    ranks.cache_clear()
    pa.default_memory_pool().release_unused()


def joined(words: pa.Array, index: np.ndarray, offsets: np.ndarray, by: str) -> list[str]:
    """Per text, the strings of its words in order."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(index)))
    return pc.binary_join(lists, by).to_pylist()


def _encoded_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[pa.RecordBatch, list[int], list[str], list[str]]]:
    try:
        for whole in batches:
            # A few MB of texts at a time: neither many nor very long ones fill the task's memory.
            for batch in _slices(whole):
                offsets, index, words = pretokens.encoded(batch, pattern)
                found = coder(path).encode(words)
                total = np.concatenate([[0], np.cumsum(found["n"].to_numpy()[index])])
                ids = joined(found["ids"].combine_chunks(), index, offsets, ",")
                back = joined(found["back"].combine_chunks(), index, offsets, "")
                yield batch, (total[offsets[1:]] - total[offsets[:-1]]).tolist(), ids, back
    finally:
        close(path)


def _slices(batch: pa.RecordBatch, pieces: int = 500_000) -> Iterator[pa.RecordBatch]:
    ends, start = batch.column("pieces").offsets.to_numpy(), 0
    for i in range(1, batch.num_rows + 1):
        if i == batch.num_rows or ends[i + 1] - ends[start] > pieces:
            yield batch.slice(start, i - start)
            start = i


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array), decoded (bytes, from the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, ids, back in _encoded_batches(batches, path, pattern):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([[int(x) for x in t.split(",")] if t else [] for t in ids], pa.list_(pa.int32())),
                 pa.array([bytes.fromhex(x) for x in back], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = pretokens.rows_with_pieces(docs, id_col, text_col, pattern, None)
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_texts``, with SHA-256 digests for the ids and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n, ids, back in _encoded_batches(batches, path, pattern):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in ids]),
                 pa.array([hashlib.sha256(bytes.fromhex(x)).hexdigest() for x in back])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = pretokens.rows_with_pieces(docs, id_col, text_col, pattern, None)
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of its ids: id rows join the vocabulary and aggregate in order. Ids outside it give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from decoded(batches)
        finally:
            close(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            db = coder(path).db
            lists = batch.column("ids")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            db.register("given_", pa.table({"i": owner, "pos": np.arange(len(owner)), "id": lists.flatten()}))
            found = dict(db.execute(
                "SELECT i, CASE WHEN count(*) = count(v.id) THEN string_agg(v.bytes, '' ORDER BY pos) END FROM given_ g LEFT JOIN vocab v USING (id) GROUP BY i").fetchall())
            back = [bytes.fromhex(x) if (x := found.get(i, "")) is not None else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.binary())], names=["doc_id", "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.selectExpr(f"`{id_col}` AS doc_id", f"coalesce(`{ids_col}`, array()) AS ids").mapInArrow(run, f"doc_id {kind}, decoded binary")
