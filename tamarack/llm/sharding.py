"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes and rows are summed per slot (so the driver sees thousands of numbers,
whatever the corpus holds); a versioned map sends slots to shards, and rebalancing edits the map, never the hash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarack.llm.common import free_name, fresh_path

SLOTS = 4096
SHARDS = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; each edit makes the next version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def save(self, spark: SparkSession, folder: str) -> str:
        """Write the map under its version; an earlier version is never overwritten."""
        path = f"{folder}/v{self.version:06d}"
        spark.createDataFrame([(self.version, self.shards, k, s) for k, s in enumerate(self.shard_of)], "version int, shards int, slot int, shard int").coalesce(1).write.parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> SlotMap:
        rows = spark.read.parquet(path).orderBy("slot").collect()
        return SlotMap(rows[0]["version"], rows[0]["shards"], tuple(r["shard"] for r in rows))


def slot_of(id_col: str, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(slots)).cast("int")


def slot_totals(docs: DataFrame, slot: Column, size: Column, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: an aggregate of at most ``slots`` rows."""
    total, rows = [0] * slots, [0] * slots
    for r in docs.groupBy(slot.alias("s")).agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect():
        total[r["s"]], rows[r["s"]] = r["b"], r["n"]
    return total, rows


def balanced_map(slot_bytes: list[int], shards: int = SHARDS) -> SlotMap:
    """Version 1: the largest slot first, each to the lightest shard."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(slot_bytes)
    for k in sorted(range(len(slot_bytes)), key=lambda k: (-slot_bytes[k], k)):
        load, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (load + slot_bytes[k], s))
    return SlotMap(1, shards, tuple(out))


def rebalanced(old: SlotMap, slot_bytes: list[int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move from the heaviest shard to the lightest until all are within ``tolerance`` of the mean, or no move helps."""
    shards = shards or old.shards
    out, load = list(old.shard_of), [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for k, s in enumerate(out):
        s = s if s < shards else k % shards
        out[k] = s
        load[s] += slot_bytes[k]
        held[s].add(k)
    mean = sum(load) / shards
    for _ in range(4 * len(out)):
        hi, lo = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[hi] - load[lo]
        if load[hi] <= mean * (1 + tolerance) and load[lo] >= mean * (1 - tolerance):
            break
        fit = [k for k in held[hi] if 0 < slot_bytes[k] < gap]
        if not fit:
            break
        k = min(fit, key=lambda k: (abs(slot_bytes[k] - gap / 2), k))
        held[hi].remove(k)
        held[lo].add(k)
        out[k] = lo
        load[hi] -= slot_bytes[k]
        load[lo] += slot_bytes[k]
    return SlotMap(old.version + 1, shards, tuple(out))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", slot_map: SlotMap | None = None) -> DataFrame:
    """id, size, text_crc32, law, shard, slot (the row's place in its shard, gapless from 0), grown_shard, virtual_slot, map_version.

    Null text has no bytes, so its size is 1. The law is ``bytes``: shards have near equal sizes, so grown_shard is null.
    Rows that repeat an id are each placed; a null id hashes like any value. An empty table gives an empty result.
    Rows are numbered within virtual slots, whose offsets in their shards come from the slots' counts, so no task
    holds a whole shard.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    thin = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(id_col, slots).alias("virtual_slot"))
    total, rows = slot_totals(thin, F.col("virtual_slot"), F.col("size"), slots)
    if slot_map is None:
        slot_map = balanced_map(total, shards)
        slot_map.save(spark, fresh_path(spark, "slot-map"))
    base, filled = [0] * slots, [0] * slot_map.shards
    for k, s in enumerate(slot_map.shard_of):
        base[k] = filled[s]
        filled[s] += rows[k]
    places = spark.createDataFrame([(k, s, base[k]) for k, s in enumerate(slot_map.shard_of)], "virtual_slot int, shard int, base long")
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")) - 1
    placed = thin.withColumn(free_name(thin.columns, "nth"), nth).join(F.broadcast(places), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
