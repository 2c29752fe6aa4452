"""Sharding by fixed virtual slots.

A record's virtual slot is a hash and never changes. Bytes are summed per slot
(a fixed number of rows, whatever the input), and a versioned slot map says
which shard holds each slot. Growing or rebalancing edits the map: only moved
slots' records move.

The map (``n_slots`` entries, a fixed bound) is the only thing on the driver;
in the plan it is an array literal indexed by slot, so no join is needed. A
record's place in its shard is its rank in its slot plus the sizes of its
shard's earlier slots, so no task ever sorts a whole shard.

Edge cases: a null text has no bytes and so size 1 and CRC 0; a null doc_id
hashes like any value, mixed with the text's CRC so that many nulls spread.
Repeated rows share a slot and get different places. Empty tables give no rows.
Other columns are not carried.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """shards[slot] is the slot's shard; an edit gives the next version."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def fresh(sizes: list[int], n_shards: int) -> SlotMap:
        """Largest slot first, each to the shard with least so far."""
        heap, shards = [(0, s) for s in range(n_shards)], [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            load, shard = heapq.heappop(heap)
            shards[slot] = shard
            heapq.heappush(heap, (load + sizes[slot], shard))
        return SlotMap(1, n_shards, tuple(shards))

    def rebalanced(self, sizes: list[int], n_shards: int) -> SlotMap:
        """Move slots from the fullest to the emptiest shard while that narrows the gap; shards beyond n_shards are emptied."""
        shards, loads = list(self.shards), [0] * max(n_shards, self.n_shards)
        held: list[list[tuple[int, int]]] = [[] for _ in loads]
        for slot, shard in enumerate(shards):
            loads[shard] += sizes[slot]
            held[shard].append((sizes[slot], slot))
        for own in held:
            own.sort()

        def move(i: int, a: int, b: int) -> None:
            size, slot = held[a].pop(i)
            shards[slot] = b
            loads[a] -= size
            loads[b] += size
            held[b].append((size, slot))
            held[b].sort()

        for gone in range(n_shards, len(loads)):
            while held[gone]:
                move(-1, gone, min(range(n_shards), key=lambda s: loads[s]))
        for _ in range(4 * len(shards)):
            b = min(range(n_shards), key=lambda s: loads[s])
            for a in sorted(range(n_shards), key=lambda s: -loads[s]):  # one slot may be all that the fullest holds
                if fits := [i for i, (size, _) in enumerate(held[a]) if 0 < size < loads[a] - loads[b]]:
                    break
            else:
                break
            half = (loads[a] - loads[b]) / 2
            move(min(fits, key=lambda i: abs(held[a][i][0] - half)), a, b)
        return SlotMap(self.version + 1, n_shards, tuple(shards))

    def to_df(self, spark: SparkSession) -> DataFrame:
        """version, slot, shard: one row a slot, made to be appended to a table of versions."""
        return spark.range(len(self.shards), numPartitions=1).select(F.lit(self.version).alias("version"), F.col("id").cast("int").alias("slot"), F.element_at(F.lit(list(self.shards)), (F.col("id") + 1).cast("int")).alias("shard"))

    @staticmethod
    def from_df(versions: DataFrame, version: int | None = None) -> SlotMap:
        """The map stored last, or the one of a version."""
        if version is None:
            version = versions.agg(F.max("version")).first()[0]
        rows = sorted((r["slot"], r["shard"]) for r in versions.filter(F.col("version") == version).select("slot", "shard").collect())
        return SlotMap(version, max(s for _, s in rows) + 1, tuple(s for _, s in rows))


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot; the text itself goes no further."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))


def slot_stats(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: n_slots numbers each."""
    sizes, counts = [0] * n_slots, [0] * n_slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("c")).collect():
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["b"], r["c"]
    return sizes, counts


def shard(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, slot_map: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Rows with virtual_slot, shard and place (gapless from 0 in each shard), and the map that was used."""
    rows = slotted(docs, n_slots)
    sizes, counts = slot_stats(rows, n_slots)
    slot_map = slot_map or SlotMap.fresh(sizes, n_shards)
    begun, before = [0] * slot_map.n_shards, [0] * n_slots
    for slot, at in enumerate(slot_map.shards):
        before[slot] = begun[at]
        begun[at] += counts[slot]
    pick = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), F.col("virtual_slot") + 1)
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = rows.select("*", pick(list(slot_map.shards), "int").alias("shard"), (rank - 1 + pick(before, "bigint")).cast("long").alias("place"))
    return out, slot_map
