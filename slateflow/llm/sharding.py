"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots (thousands). Bytes are summed per slot, and a versioned
map gives each slot its shard. The map, not the hash, is edited when shards are rebalanced or added,
so that a record moves only when its slot does.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slateflow.sources.versions import versions

from .common import materialize, new_path

N_SLOTS = 4096
#: Each slot's places are numbered in this many lanes, so that no slot has to be sorted by one task.
LANES = 16

MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("vslot", T.IntegerType()), T.StructField("shard", T.IntegerType())])


class SlotMap:
    """Versions of the slot-to-shard map, kept as a Parquet table with one folder for each version.

    A path that holds a map already is opened at its newest complete version, and edits go on from there.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "slotmap")
        found = versions(spark, self.path)
        self.version = found[-1] if found else -1
        self.shards: list[int] = [r["shard"] for r in self.load().orderBy("vslot").collect()] if found else []

    def save(self, shards: list[int]) -> int:
        """Store `shards` (by slot) as the next version. Rows: one for each slot, N_SLOTS at most."""
        self.version += 1
        self.shards = list(shards)
        rows = [(self.version, s, d) for s, d in enumerate(shards)]
        self.spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={self.version}")
        return self.version

    def load(self, version: int | None = None) -> DataFrame:
        v = self.version if version is None else version
        return self.spark.read.schema(MAP_SCHEMA).parquet(f"{self.path}/v={v}")

    def rebalance(self, weight: list[int], n_shards: int) -> int:
        """Store a version whose shards have near-equal weight, moving few slots.

        Slots leave overfull shards, heaviest that still helps first, for the lightest shard, until no
        single move or swap of two slots narrows the gap between the heaviest and the lightest shard.
        """
        shard = [s if s < n_shards else -1 for s in self.shards]
        load = [0] * n_shards
        held: list[list[int]] = [[] for _ in range(n_shards)]
        loose = []
        for slot, s in enumerate(shard):
            if s < 0:
                loose.append(slot)
            else:
                load[s] += weight[slot]
                held[s].append(slot)
        mean = sum(weight) / n_shards
        for s in range(n_shards):  # shed what exceeds the mean, largest slots first
            held[s].sort(key=lambda x: (weight[x], x))
            keep = []
            for slot in reversed(held[s]):
                if load[s] - weight[slot] >= mean:
                    load[s] -= weight[slot]
                    loose.append(slot)
                else:
                    keep.append(slot)
            held[s] = keep
        heap = [(load[s], s) for s in range(n_shards)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda x: (-weight[x], x)):
            _, s = heapq.heappop(heap)
            load[s] += weight[slot]
            held[s].append(slot)
            heapq.heappush(heap, (load[s], s))
        for _ in range(4 * n_shards * n_shards):  # even out by single moves and swaps
            hi, lo = max(range(n_shards), key=lambda s: (load[s], -s)), min(range(n_shards), key=lambda s: (load[s], s))
            gap = load[hi] - load[lo]
            best = None
            under = sorted((weight[x], x) for x in held[lo])
            for x in held[hi]:
                for w, y in [(0, None), *_near(under, weight[x] - gap / 2)]:
                    d = weight[x] - w
                    if 0 < d < gap and (best is None or abs(gap - 2 * d) < best[0]):
                        best = (abs(gap - 2 * d), x, y)
            if best is None or best[0] >= gap:
                break
            _, x, y = best
            held[hi].remove(x)
            held[lo].append(x)
            load[hi] -= weight[x]
            load[lo] += weight[x]
            if y is not None:
                held[lo].remove(y)
                held[hi].append(y)
                load[lo] -= weight[y]
                load[hi] += weight[y]
        for s in range(n_shards):
            for slot in held[s]:
                shard[slot] = s
        return self.save(shard)


def _near(pairs: list[tuple[int, int]], value: float) -> list[tuple[int, int]]:
    from bisect import bisect_left

    i = bisect_left(pairs, (value, -1))
    return pairs[max(0, i - 1) : i + 1]


def shard(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS, slot_map: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """Each row of `docs` (doc_id, text) with its virtual slot, its shard and its place in the shard; the map used.

    Slots are hashes of doc_id, or of the text where the id is null, so that a hot source or a group of equal
    texts with ids of their own fills none. An id, or a text without id, that repeats on more rows than an
    average slot has is salted by row over all slots. Null text has size 1 and the checksum of the empty
    string. Repeated rows are numbered apart. An empty table gives no rows. Other columns are ignored.
    Collected to the driver: one sum for each slot and lane, `n_slots` times LANES at most; broadcast: those,
    and hot keys, `n_slots` at most.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("doc_id").isNull(), text)).alias("_h"),
        F.monotonically_increasing_id().alias("_row"),
    )
    base = materialize(base, "rows")  # rows keep their numbers
    total = base.count()
    hot = base.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") * n_slots > F.lit(total)).where("_n > 1").select("_h", F.lit(True).alias("_hot"))
    salted = F.when(F.col("_hot"), F.xxhash64("_h", "_row")).otherwise(F.col("_h"))
    base = base.join(F.broadcast(hot), "_h", "left").withColumn("_h", salted).select(
        "doc_id", "size", "text_crc32",
        F.pmod("_h", F.lit(n_slots)).cast("int").alias("vslot"),
        F.pmod(F.shiftright("_h", 32), F.lit(LANES)).cast("int").alias("lane"),
    )
    base = materialize(base, "shard")
    lanes = base.groupBy("vslot", "lane").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    weight = [0] * n_slots
    for r in lanes:
        weight[r["vslot"]] += r["bytes"]
    if slot_map is None:
        slot_map = SlotMap(spark)
    if not slot_map.shards:
        slot_map.save([s % n_shards for s in range(n_slots)])
    slot_map.rebalance(weight, n_shards)
    # First place of each lane in its shard: a table of n_slots * LANES rows at most.
    first, at = [], [0] * n_shards
    for r in sorted(lanes, key=lambda r: (r["vslot"], r["lane"])):
        s = slot_map.shards[r["vslot"]]
        first.append((r["vslot"], r["lane"], s, at[s]))
        at[s] += r["n"]
    places = spark.createDataFrame(first, "vslot int, lane int, shard int, place long").coalesce(1)
    w = Window.partitionBy("vslot", "lane").orderBy("doc_id", "text_crc32", "size")
    out = base.withColumn("rn", F.row_number().over(w)).join(F.broadcast(places), ["vslot", "lane"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("rn") - 1).alias("slot"), "vslot"), slot_map


def op3_virtual_slots(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out, _ = shard(docs, 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"),
    )
