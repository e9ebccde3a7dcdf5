"""Sharding over fixed virtual slots.

A record's hash (of its doc_id and its text's CRC) names one of ``n_slots`` virtual slots. Bytes and rows are summed
per slot (a few thousand rows whatever the input), and a versioned slot-to-shard map sends slots to shards. Rebalancing
edits the map: it moves whole slots and stores the next version. A record keeps its slot as long as its text stays; an
edited text is a new record. ``shard_by_bytes`` stores the first version, reads it back, edits it where a shard is too
heavy, and places all records by what the store then holds.

Defined results: a null text has no bytes (size 1, the CRC of the empty string); a null ``doc_id`` hashes like any
value, with the text's CRC; repeated rows are placed one by one and get consecutive positions; an empty table gives
no rows. Columns of ``docs`` other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import fresh_path
from .common import inline_rows

N_SLOTS = 4096
#: A shard may exceed the mean by this share before ``rebalance`` moves a slot away from it.
TOLERANCE = 0.001
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, first_row long"


def measured(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of every record; the text goes no further."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn(
        "virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int")
    )


def slot_loads(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows), at most one entry for each slot: bounded by ``n_slots``."""
    loads = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return sorted((r[0], r[1], r[2]) for r in loads.collect())


def _numbered(version: int, placed: list[tuple[int, int, int, int]]) -> list[dict]:
    """Map entries with the position in its shard at which each slot's rows begin."""
    begins: dict[int, int] = {}
    entries = []
    for slot, size, rows, shard in sorted(placed):
        entries.append({"version": version, "slot": slot, "shard": shard, "bytes": size, "rows": rows, "first_row": begins.get(shard, 0)})
        begins[shard] = begins.get(shard, 0) + rows
    return entries


def first_map(loads: list[tuple[int, int, int]], n_shards: int) -> list[dict]:
    """Version 1: the heaviest slot that is left goes to the lightest shard."""
    heap = [(0, s) for s in range(n_shards)]
    placed = []
    for slot, size, rows in sorted(loads, key=lambda x: (-x[1], x[0])):
        held, shard = heapq.heappop(heap)
        placed.append((slot, size, rows, shard))
        heapq.heappush(heap, (held + size, shard))
    return _numbered(1, placed)


def rebalance(current: list[dict], loads: list[tuple[int, int, int]], n_shards: int, tolerance: float = TOLERANCE) -> list[dict]:
    """The next version: slots leave shards that are over the mean for the lightest shard, and no others move.

    ``loads`` are fresh sums (new slots may appear); shards beyond the map's start empty, shards past ``n_shards``
    are emptied.
    """
    old = {e["slot"]: e["shard"] for e in current}
    held = [0] * n_shards
    slots: list[list[tuple[int, int, int]]] = [[] for _ in range(n_shards)]
    adrift = []
    for slot, size, rows in loads:
        shard = old.get(slot, -1)
        if 0 <= shard < n_shards:
            held[shard] += size
            slots[shard].append((size, slot, rows))
        else:
            adrift.append((size, slot, rows))
    limit = (1 + tolerance) * sum(x[1] for x in loads) / n_shards
    for s in range(n_shards):
        slots[s].sort(reverse=True)
        for item in list(slots[s]):
            if held[s] <= limit:
                break
            if held[s] - item[0] >= limit * (1 - tolerance) ** 2 or held[s] - limit >= item[0] / 2:
                slots[s].remove(item)
                held[s] -= item[0]
                adrift.append(item)
    for item in sorted(adrift, reverse=True):
        s = min(range(n_shards), key=lambda k: (held[k], k))
        slots[s].append(item)
        held[s] += item[0]
    version = 1 + max((e["version"] for e in current), default=0)
    return _numbered(version, [(slot, size, rows, s) for s in range(n_shards) for size, slot, rows in slots[s]])


def map_table(spark: SparkSession, entries: list[dict]) -> DataFrame:
    return inline_rows(spark, json.dumps(entries), MAP_SCHEMA)


def store_map(spark: SparkSession, entries: list[dict], path: str) -> None:
    """Add one version to the map at ``path``; earlier versions stay.

    A version is a folder of its own that must not exist yet, so a second editor of the same version fails.
    """
    version = entries[0]["version"]
    map_table(spark, entries).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def stored_map(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a map."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[dict]:
    """A stored version, the latest by default: at most ``n_slots`` entries."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).orderBy("slot").collect()
    return [{k: int(r[k]) for k in ("version", "slot", "shard", "bytes", "rows", "first_row")} for r in rows]


def place(records: DataFrame, entries: list[dict]) -> DataFrame:
    """Shard and gapless position in it for every record.

    Rows are ordered inside a virtual slot, so the sort is spread over thousands of keys and never over the few
    shards; the slot's first position comes with the map, which has at most ``n_slots`` rows and is broadcast.
    """
    table = map_table(records.sparkSession, entries).select(F.col("slot").alias("virtual_slot"), "shard", "first_row", F.col("version").alias("map_version"))
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(table), "virtual_slot")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_row") + F.col("inside")).cast("long").alias("slot"), "virtual_slot", "map_version")
    )


def current_map(spark: SparkSession, loads: list[tuple[int, int, int]], n_shards: int, path: str) -> list[dict]:
    """The map at ``path`` brought up to date with ``loads``: started where there are no slots yet, else edited; a
    version is stored only when a slot moves, appears or holds other rows."""
    if not stored_map(spark, path):
        store_map(spark, first_map(loads, n_shards), path)
    held = load_map(spark, path)
    edited = rebalance(held, loads, n_shards)
    facts = lambda entries: [(e["slot"], e["shard"], e["rows"], e["bytes"]) for e in entries]
    if facts(edited) != facts(held):
        store_map(spark, edited, path)
    return load_map(spark, path)


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Records with shard, position in the shard (``slot``) and virtual slot; shards have near-equal bytes.

    The map is stored at ``path``, by default in a new folder of the shared one.
    """
    spark, records = docs.sparkSession, measured(docs, n_slots)
    loads = slot_loads(records)
    if not loads:
        return place(records, [])
    return place(records, current_map(spark, loads, n_shards, path or fresh_path(spark, "slot-map")))


def write_shards(docs: DataFrame, entries: list[dict], path: str, n_slots: int = N_SLOTS) -> None:
    """The documents as one folder for each shard; many tasks write into a shard, each for some of its slots."""
    slot = F.pmod(F.xxhash64("doc_id", F.crc32(F.coalesce("text", F.lit("")))), F.lit(n_slots)).cast("int")
    table = map_table(docs.sparkSession, entries).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    docs.withColumn("__slot", slot).join(F.broadcast(table), "__slot").drop("__slot").write.partitionBy("__shard").parquet(path)
