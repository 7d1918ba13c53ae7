"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of ``SLOTS`` virtual slots; bytes and rows are summed per slot, and a map of at most ``SLOTS``
entries says which shard holds which slot. Records never move between slots: rebalancing edits the map only and writes the
edit as a new version. The first map deals slots, heaviest first, to the shard that has the fewest bytes, so shards come
out near equal in bytes (law ``bytes``); growing gives slots to the new shard only, and moves none between old ones.

Inside a shard, records are numbered from 0 without gaps: cells (``CELLS`` to a slot, by another hash) are numbered in
order by their row counts, and only the rows of one cell are ordered in one task.

A null text counts ``OVERHEAD`` bytes and the checksum of no bytes. A null id is hashed like any other value.
Repeated rows share a cell and get different numbers. An empty table gives no rows and an even map.
The map is built in the driver from ``SLOTS`` sums, however many records there are."""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from playbill.llm.common import written

SLOTS, CELLS = 4096, 16
SHARDS = 40
OVERHEAD = 16
MAP = "version int, slot int, shard int, shards int"


def text_bytes(text) -> F.Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def slotted(records: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """The records with their virtual slot and cell, both from one hash of the key."""
    h = F.xxhash64(F.col(key))
    return records.withColumns({
        "virtual_slot": F.pmod(h, F.lit(slots)).cast("int"),
        "cell": F.pmod(F.shiftrightunsigned(h, 40), F.lit(CELLS)).cast("int"),
    })


def slot_loads(records: DataFrame, size: str = "size") -> DataFrame:
    """Bytes and rows by virtual slot: at most one row a slot leaves each task."""
    return records.groupBy("virtual_slot").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def deal(loads: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """A first map: the heaviest slot goes to the lightest shard, ties to the shard with fewer slots, then the lower number."""
    heap = [(0, 0, s) for s in range(shards)]
    placed = {}
    for slot in sorted(range(slots), key=lambda v: (-loads.get(v, 0), v)):
        load, n, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), n + 1, shard))
    return placed


def grow(placed: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The map with one more shard (number ``shards``): the heaviest old shard gives slots away until the new one has its share."""
    return _even(placed, loads, shards + 1, takers={shards})


def rebalance(placed: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for new loads: slots move from the heaviest to the lightest shard while that narrows their gap."""
    return _even(placed, loads, shards, takers=set(range(shards)))


def _even(placed: dict[int, int], loads: dict[int, int], shards: int, takers: set[int]) -> dict[int, int]:
    edited = dict(placed)
    total = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in placed.items():
        total[shard] += loads.get(slot, 0)
        held[shard].add(slot)
    for _ in range(len(placed)):
        giver = max(range(shards), key=lambda s: (total[s], s))
        taker = min(takers, key=lambda s: (total[s], s))
        gap = total[giver] - total[taker]
        movable = [v for v in held[giver] if 0 < loads.get(v, 0) < gap]
        if giver == taker or not movable:
            break
        slot = min(movable, key=lambda v: (abs(gap - 2 * loads[v]), v))
        edited[slot] = taker
        held[giver].remove(slot)
        held[taker].add(slot)
        total[giver] -= loads[slot]
        total[taker] += loads[slot]
    return edited


def append_version(spark: SparkSession, path: str, placed: dict[int, int], shards: int) -> int:
    """Write the map as the next version of the map table at ``path``; returns its number."""
    try:
        last = spark.read.schema(MAP).parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        last = None
    version = 0 if last is None else last + 1
    rows = [(version, slot, shard, shards) for slot, shard in sorted(placed.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)
    return version


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(path).where(F.col("version") == version)


def assign(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """The slotted records with ``shard`` and their gapless number ``slot`` in it. Both joined tables are bounded
    (``SLOTS`` and ``SLOTS * CELLS`` rows), so they are broadcast at any input size."""
    slot_map = slot_map.select(F.col("slot").alias("virtual_slot"), "shard", F.col("version").alias("map_version"))
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        records.groupBy("virtual_slot", "cell").agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(slot_map), "virtual_slot")
        .select("virtual_slot", "cell", "shard", "map_version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    in_cell = Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "size", "text_crc32")
    return (
        records.withColumn("number", F.row_number().over(in_cell)).join(F.broadcast(cells), ["virtual_slot", "cell"])
        .withColumn("slot", (F.col("start") + F.col("number") - 1).cast("long")).drop("number", "start")
    )


def shard_records(documents: DataFrame, map_path: str, shards: int = SHARDS) -> DataFrame:
    """Documents (doc_id, text) in shards: sizes and checksums are written once, without the texts; slot bytes decide the
    first map, stored at ``map_path``; the map then places every row."""
    spark = documents.sparkSession
    narrow = slotted(documents.select(
        "doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    ), "doc_id")
    narrow = written(narrow, "shard-records")
    loads = {r.virtual_slot: r.bytes for r in slot_loads(narrow).toLocalIterator()}
    version = append_version(spark, map_path, deal(loads, shards), shards)
    return assign(narrow, read_version(spark, map_path, version))


def digest(documents: DataFrame, map_path: str) -> DataFrame:
    return shard_records(documents, map_path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot", "map_version")
