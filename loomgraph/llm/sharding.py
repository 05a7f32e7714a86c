"""Sharding through fixed virtual slots.

Every record hashes into one of `n_slots` slots, for good. Bytes are aggregated per slot, and a versioned table maps
slots to shards. Balancing and growing edit that table alone; a record's slot never changes. The table has `n_slots`
rows (a parameter, thousands), so the driver edits it and joins broadcast it whatever the size of the data.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 8192


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16; a null text has none), text_crc32 and virtual_slot of every row.

    A null text has the checksum of the empty text. The slot hashes id, checksum and size, so rows that share an id still
    spread; a row without an id is known by nothing, and its place in the input stands for one, so that no group of such
    rows is one slot. Other columns are left behind.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return rows.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", nameless), F.lit(n_slots)).cast("int"))


def slot_loads(slotted: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: at most `n_slots` rows."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def balanced_map(loads: dict[int, int], n_shards: int) -> dict[int, int]:
    """The first version: slots by falling size, each to the lightest shard so far; then refined."""
    heap = [(0, shard) for shard in range(n_shards)]
    made = {}
    for slot, size in sorted(loads.items(), key=lambda item: (-item[1], item[0])):
        held, shard = heapq.heappop(heap)
        made[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return rebalanced(made, loads, n_shards)


def rebalanced(current: dict[int, int], loads: dict[int, int], n_shards: int, rounds: int = 2000) -> dict[int, int]:
    """The next version: single slots move, or two trade places, between the heaviest and the lightest shard while
    that narrows their gap. Slots of shards beyond `n_shards` go to the lightest first; new shards start empty."""
    made = {slot: shard for slot, shard in current.items() if shard < n_shards}
    held = [0] * n_shards
    inside: list[set[int]] = [set() for _ in range(n_shards)]
    for slot, shard in made.items():
        held[shard] += loads.get(slot, 0)
        inside[shard].add(slot)
    for slot in sorted(set(current) | set(loads), key=lambda slot: (-loads.get(slot, 0), slot)):
        if slot not in made:
            shard = min(range(n_shards), key=lambda number: (held[number], number))
            made[slot] = shard
            held[shard] += loads.get(slot, 0)
            inside[shard].add(slot)
    for _ in range(rounds + len(made) * (max(current.values(), default=0) + 1 < n_shards)):
        high = max(range(n_shards), key=lambda number: (held[number], -number))
        low = min(range(n_shards), key=lambda number: (held[number], number))
        gap = held[high] - held[low]
        moved = _best_move(inside[high], inside[low], loads, gap)
        if moved is None:
            break
        out, back = moved
        for slot, source, target in ((out, high, low), (back, low, high)):
            if slot is not None:
                made[slot] = target
                inside[source].remove(slot)
                inside[target].add(slot)
                held[source] -= loads.get(slot, 0)
                held[target] += loads.get(slot, 0)
    return made


def _best_move(high: set[int], low: set[int], loads: dict[int, int], gap: int) -> tuple[int, int | None] | None:
    """The move whose size comes closest to half the gap."""
    offers = sorted([(0, -1)] + [(loads.get(slot, 0), slot) for slot in low])
    sizes = [size for size, _ in offers]
    best, found = gap, None
    for slot in sorted(high):
        size = loads.get(slot, 0)
        at = bisect.bisect_left(sizes, size - gap / 2)
        for size_back, back in offers[max(0, at - 1): at + 1]:
            left = abs(gap - 2 * (size - size_back))
            if 0 < size - size_back < gap and left < best:
                best, found = left, (slot, None if back < 0 else back)
    return found


def save_map(spark: SparkSession, slot_map: dict[int, int], folder: str, version: int) -> None:
    """One folder per version; a version, once written, never changes."""
    rows = spark.createDataFrame(sorted(slot_map.items()), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the map, the last by default."""
    versions = spark.read.schema("virtual_slot int, shard int, version int").parquet(folder)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version)


def grow(spark: SparkSession, folder: str, loads: DataFrame, n_shards: int) -> int:
    """Edit the last version of the map in `folder` for `n_shards` shards and today's loads, save it as the next, and say
    which that is. Slots move only as far as shards gain or lose by it; nothing but the map, `n_slots` rows, is read."""
    last = load_map(spark, folder).collect()
    version = last[0]["version"] + 1
    by_slot = {row["virtual_slot"]: 0 for row in last} | {row["virtual_slot"]: row["bytes"] for row in loads.collect()}
    save_map(spark, rebalanced({row["virtual_slot"]: row["shard"] for row in last}, by_slot, n_shards), folder, version)
    return version


def place(slotted: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard and slot (a row's place in its shard, gapless from 0) of every row.

    Rows are numbered within their virtual slot, by id and checksum; the slots of a shard follow each other. So no
    shard is gathered in a task: the groups are the virtual slots, and they carry no text.
    """
    first = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        loads.join(slot_map, "virtual_slot")
        .withColumn("_first", F.coalesce(F.sum("rows").over(first), F.lit(0)))
        .select("virtual_slot", "shard", "_first", F.col("version").alias("map_version"))
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        slotted.withColumn("_row", F.row_number().over(within))
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", (F.col("_first") + F.col("_row") - 1).cast("long"))
        .drop("_first", "_row")
    )


def shard_documents(docs: DataFrame, folder: str, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    n_slots: int = N_SLOTS) -> DataFrame:
    """Place all rows by bytes: slot loads, map version 1 in `folder`, positions.

    Null ids and texts, repeated rows and empty texts are placed like others; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slotted = with_slots(docs, id_col, text_col, n_slots)
    loads = slot_loads(slotted)
    rows = loads.collect()  # at most n_slots
    by_slot = {slot: 0 for slot in range(n_slots)} | {row["virtual_slot"]: row["bytes"] for row in rows}
    save_map(spark, balanced_map(by_slot, n_shards), folder, 1)
    known = spark.createDataFrame(
        [(row["virtual_slot"], row["bytes"], row["rows"]) for row in rows], "virtual_slot int, bytes long, rows long"
    )
    return place(slotted, known, load_map(spark, folder))
