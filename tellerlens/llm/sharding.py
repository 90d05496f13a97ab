"""Shards by fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes are summed per slot, and a versioned map, one row per
slot, names each slot's shard. Rebalancing edits the map: only slots whose shard changes move. The map has as many
rows as there are slots (a parameter, thousands), whatever the input, so it is planned on the driver.

Rows: null ids and null texts are records like others; a null text has no bytes. Rows without an id go by their text, so
they spread. Equal rows share a slot. Rows are placed one by one: equal texts with different ids may lie in different
shards, and their ``text_crc32`` tells which rows to compare.
An empty table gives an empty result and a map over empty slots. Columns other than id and text are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots; fixed for the lifetime of a data set.
SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version and, per slot, its shard and the bytes and rows it had when the map was made."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        start, offset = [0] * self.n_shards, []
        for s, n in zip(self.shard, self.rows, strict=True):
            offset.append(start[s])
            start[s] += n
        table = [(self.n_shards, i, s, b, n, o, self.version) for i, (s, b, n, o) in enumerate(zip(self.shard, self.size, self.rows, offset, strict=True))]
        return spark.createDataFrame(table, "n_shards int, virtual_slot int, shard int, slot_bytes long, slot_rows long, first_slot long, version int")


def slotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, virtual_slot of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("null"), text)).otherwise(F.xxhash64(F.col(id_col))), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> list[tuple[int, int]]:
    """(bytes, rows) per slot; ``slots`` rows at most reach the driver."""
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    return [found.get(i, (0, 0)) for i in range(slots)]


def plan(totals: list[tuple[int, int]], n_shards: int) -> SlotMap:
    """First map: largest slot first, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(n_shards)]
    shard = [0] * len(totals)
    for i in sorted(range(len(totals)), key=lambda i: (-totals[i][0], i)):
        load, s = heapq.heappop(heap)
        shard[i] = s
        heapq.heappush(heap, (load + totals[i][0], s))
    return SlotMap(1, n_shards, tuple(shard), tuple(b for b, _ in totals), tuple(n for _, n in totals))


def rebalance(old: SlotMap, totals: list[tuple[int, int]], n_shards: int) -> SlotMap:
    """Next version of the map for new totals or more shards.

    With more shards, slots move into the new ones only: largest first, from shards above the mean, as long as they fit.
    A new shard that nothing fits gets one slot from the fullest shard that has several. With as many shards as before,
    shards above the mean give slots to the one with the fewest bytes. Every other slot stays."""
    if n_shards < old.n_shards:
        raise ValueError("shards can be added, not removed")
    shard, load = list(old.shard), [0] * n_shards
    for s, (b, _) in zip(shard, totals, strict=True):
        load[s] += b
    mean = sum(load) / n_shards
    into = range(old.n_shards, n_shards) if n_shards > old.n_shards else range(n_shards)

    def move(i: int, to: int) -> None:
        b, s = totals[i][0], shard[i]
        shard[i], load[s], load[to] = to, load[s] - b, load[to] + b

    by_size = sorted((i for i, (b, _) in enumerate(totals) if b), key=lambda i: (-totals[i][0], i))
    for i in by_size:
        b, s = totals[i][0], shard[i]
        to = min(into, key=lambda t: (load[t], t))
        if to != s and s not in (into if n_shards > old.n_shards else ()) and load[s] - b >= mean - b / 2 and load[to] + b <= mean + b / 2:
            move(i, to)
    for to in into:
        if n_shards > old.n_shards and not load[to]:
            held: dict[int, list[int]] = {}
            for i in by_size:
                held.setdefault(shard[i], []).append(i)
            givers = [s for s, own in held.items() if len(own) > 1]
            if givers:
                giver = max(givers, key=lambda s: (load[s], -s))
                move(next((i for i in held[giver] if 2 * totals[i][0] <= load[giver]), held[giver][-1]), to)
    return SlotMap(old.version + 1, n_shards, tuple(shard), tuple(b for b, _ in totals), tuple(n for _, n in totals))


def save(slot_map: SlotMap, spark: SparkSession, folder: str) -> None:
    """Store the map as one version below ``folder``; versions are never overwritten."""
    slot_map.to_frame(spark).coalesce(1).write.parquet(f"{folder}/version={slot_map.version}")


def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
    """A stored version; one row per slot reaches the driver."""
    rows = sorted(spark.read.parquet(f"{folder}/version={version}").collect(), key=lambda r: r["virtual_slot"])
    if [r["virtual_slot"] for r in rows] != list(range(len(rows))):
        raise ValueError(f"version {version} of the slot map is incomplete")
    return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows), tuple(r["slot_bytes"] for r in rows), tuple(r["slot_rows"] for r in rows))


def assign(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Each row's shard and its place in it, gapless from 0: the slot's first place plus the row's rank in the slot.
    Ranks are per virtual slot, so no task holds a shard. The map is broadcast: one row per slot."""
    m = F.broadcast(slot_map.to_frame(rows.sparkSession).select("version", "virtual_slot", "shard", "first_slot"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.join(m, "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - 1).alias("slot"), "virtual_slot", "version"
    )


def shard_documents(docs: DataFrame, n_shards: int = 8, slots: int = SLOTS, folder: str | None = None, **cols: str) -> tuple[DataFrame, SlotMap]:
    """The rows with their shard, and the map they were assigned by; with a ``folder``, the map is stored there and read back."""
    rows = slotted(docs, slots=slots, **cols)
    totals = slot_totals(rows, slots)
    slot_map = plan(totals, n_shards)
    if folder:
        save(slot_map, docs.sparkSession, folder)
        slot_map = load(docs.sparkSession, folder, slot_map.version)
    return assign(rows, slot_map), slot_map
