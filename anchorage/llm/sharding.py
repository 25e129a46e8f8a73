"""Sharding by fixed virtual slots.

Records are hashed by id into a fixed number of slots, bytes and rows are
summed per slot, and a versioned map says which shard holds each slot.  A
rebalance edits the map: where shards are out of balance, it moves whole slots
from shards above their share to shards below it and appends the next version,
so history stays readable and rows move only with their slot.  The map is
stored beside the data, one folder a version, and records are placed by what
is read back from there.  Data-sized work is one narrow aggregation and
one narrow window per slot; only the per-slot sums, of a fixed count, reach the
driver.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorage.llm.common import delete_at_exit, shared_folder, stash, utf8

N_SLOTS = 8192
#: Moves a shard that a rebalance may make only to even out what larger moves leave.
FINE_SLOTS = 8
#: Shards are in balance where the largest and the smallest differ by no more than this part of the mean.
TOLERANCE = 0.001


@dataclass(frozen=True)
class SlotMap:
    """Slot-to-shard maps by version; the last is current."""

    n_slots: int
    n_shards: int
    versions: tuple[tuple[int, ...], ...] = field(default=())

    @classmethod
    def initial(cls, n_slots: int, n_shards: int) -> SlotMap:
        """Version 0: slots dealt to shards in turn."""
        return cls(n_slots, n_shards, (tuple(slot % n_shards for slot in range(n_slots)),))

    @property
    def current(self) -> tuple[int, ...]:
        return self.versions[-1]

    def rebalanced(self, slot_bytes: dict[int, int], n_shards: int | None = None) -> SlotMap:
        """Append a version in which every shard's bytes are near the mean; the same map if they are already.

        Shards above the mean give up slots, largest first, as long as they
        stay at or above it, and those of shards that are no more go, too; each
        goes to the shard with the fewest bytes.  Then single slots move from
        the largest to the smallest shard while that brings the two together.
        All other slots stay where they are.
        """
        n = n_shards or self.n_shards
        loads = [0] * n
        held: list[dict[int, int]] = [{} for _ in range(n)]
        pool: list[tuple[int, int]] = []
        for slot, shard in enumerate(self.current):
            size = slot_bytes.get(slot, 0)
            if shard >= n:
                pool.append((size, slot))
            else:
                loads[shard] += size
                held[shard][slot] = size
        mean = sum(slot_bytes.values()) / n
        if n == self.n_shards and max(loads) - min(loads) <= TOLERANCE * mean:
            return self
        for shard in range(n):
            for slot, size in sorted(held[shard].items(), key=lambda x: (-x[1], x[0])):
                if 0 < size <= loads[shard] - mean:
                    loads[shard] -= held[shard].pop(slot)
                    pool.append((size, slot))
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for size, slot in sorted(pool, key=lambda x: (-x[0], x[1])):
            load, shard = heapq.heappop(heap)
            held[shard][slot] = size
            loads[shard] = load + size
            heapq.heappush(heap, (load + size, shard))
        for _ in range(FINE_SLOTS * n):
            low, high = min(range(n), key=lambda s: (loads[s], s)), max(range(n), key=lambda s: (loads[s], -s))
            gap = loads[high] - loads[low]
            fitting = [(abs(gap - 2 * size), slot) for slot, size in held[high].items() if 0 < size < gap]
            if gap <= TOLERANCE * mean or not fitting:
                break
            slot = min(fitting)[1]
            size = held[low][slot] = held[high].pop(slot)
            loads[high], loads[low] = loads[high] - size, loads[low] + size
        shards = list(self.current)
        for shard, slots in enumerate(held):
            for slot in slots:
                shards[slot] = shard
        return SlotMap(self.n_slots, n, (*self.versions, tuple(shards)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """All versions as rows (version, virtual_slot, shard)."""
        rows = [(v, slot, shard) for v, shards in enumerate(self.versions) for slot, shard in enumerate(shards)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str, first: int = 0) -> None:
        """Store the versions from ``first`` on as Parquet, a folder each; a version that is there already is written anew."""
        for version in range(first, len(self.versions)):
            one = self.frame(spark).filter(F.col("version") == version).drop("version")
            one.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        """Read what ``save`` stored."""
        by_version: dict[int, dict[int, int]] = {}
        for row in spark.read.parquet(path).select("version", "virtual_slot", "shard").collect():
            by_version.setdefault(row[0], {})[row[1]] = row[2]
        versions = tuple(tuple(by_version[v][s] for s in range(len(by_version[v]))) for v in sorted(by_version))
        return cls(len(versions[0]), max(versions[-1]) + 1, versions)

    @staticmethod
    def stored(spark: SparkSession, path: str) -> bool:
        """Whether ``path`` holds a map."""
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def with_slots(records: DataFrame, id_column: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """Add ``virtual_slot``: a hash of the id alone, so equal texts spread like others.  A null id hashes like any value."""
    return records.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(id_column)), F.lit(n_slots)).cast("int"))


def shard_records(records: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS, map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Assign records (doc_id, size, ...) to shards of near equal ``size`` sums.

    The map stored at ``map_path`` is loaded, edited if these records are out of
    balance under it, stored again and read back; where there is none, version 0
    is stored first.  Without a path, the map lies in the shared folder for
    the time of the session.  Returns the records with ``virtual_slot``,
    ``shard``, ``slot`` (position in the shard, gapless from 0, slots one after
    the other and ids in order) and the map used.  Repeated rows take a position
    each; no rows give no rows.
    """
    spark = records.sparkSession
    placed = stash(with_slots(records, n_slots=n_slots))
    path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4()}"
    if not SlotMap.stored(spark, path):
        SlotMap.initial(n_slots, n_shards).save(spark, path)
        if not map_path:
            delete_at_exit(spark, path)
    before_edit = SlotMap.load(spark, path)
    if before_edit.n_slots != n_slots:
        raise ValueError(f"the map at {path} has {before_edit.n_slots} slots, not {n_slots}")
    # One row a slot: its count is fixed by n_slots, whatever the input holds.
    sums = {r[0]: (r[1], r[2]) for r in placed.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    before_edit.rebalanced({slot: size for slot, (size, _) in sums.items()}, n_shards).save(spark, path, len(before_edit.versions))
    slot_map = SlotMap.load(spark, path)
    before, rows = [0] * n_shards, []
    for slot, shard in enumerate(slot_map.current):
        rows.append((slot, shard, before[shard]))
        before[shard] += sums.get(slot, (0, 0))[1]
    current = spark.createDataFrame(rows, "virtual_slot int, shard int, before long")
    order = Window.partitionBy("virtual_slot").orderBy(*[c for c in placed.columns if c != "virtual_slot"])
    ranked = placed.withColumn("rank", F.row_number().over(order) - 1)
    out = ranked.join(F.broadcast(current), "virtual_slot").withColumn("slot", F.col("before") + F.col("rank"))
    return out.drop("before", "rank"), slot_map


def shard_documents(documents: DataFrame, n_shards: int = 16, n_slots: int = N_SLOTS) -> DataFrame:
    """Digest of the sharded ``documents``: sizes are UTF-8 bytes plus 1.

    A null or empty text has size 1, a null id hashes like any value.  Other
    columns are ignored; no rows give no rows.
    """
    records = documents.select(
        "doc_id",
        (F.octet_length(utf8("text")).cast("long") + 1).alias("size"),
        F.crc32(utf8("text")).alias("text_crc32"),
    )
    out, slot_map = shard_records(records, n_shards, n_slots)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(len(slot_map.versions) - 1).alias("map_version"),
    )
