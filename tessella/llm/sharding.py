"""Sharding by fixed virtual slots, with DataFrame functions only.

Records are hashed into thousands of slots, whose number never changes. Bytes are summed per
slot; a slot-to-shard map places the slots, heaviest first, on the lightest shard. The map is
a small versioned table that is written before it is used, and what rows and documents are given
is read from it. With a map that has versions already the latest is taken, and edited into the
next where the loads or the number of shards have outgrown it: only slots whose shard is over the
allowed load move. Without one named, a new map is begun in the shared folder.

The map has one row per slot, so it is broadcast whatever the corpus size, and the fold that
places slots reads that many values.

Equal texts (a group) with different ids are spread over slots and shards on purpose: a group may
hold a third of all rows, and shards would not be even if it stayed together.

Edge cases: a null text counts 1 byte and has CRC 0, as an empty one; a very long text is one record
of its size; null and repeated ids are hashed with the text's CRC and size, so only identical rows
must share a slot, and these are numbered as one row with a count; ties of load go to the lowest
shard, ties of bytes to the lowest slot; slots without bytes are dealt in turn; columns of the input
that are called shard or virtual_slot are replaced, others are kept; an empty table gives an empty
result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoint import shared_folder
from .common import documents, stash

SLOTS, SHARDS, TOLERANCE = 8192, 16, 0.01


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")


def slot_of(doc_id: Column, crc: Column, size: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, crc, size), F.lit(slots)).cast("int")


def slot_bytes(sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(v_slot, bytes, n) from rows with v_slot and size; a row for every slot."""
    used = sized.groupBy("v_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = sized.sparkSession.range(slots).select(F.col("id").cast("int").alias("v_slot"))
    return every.join(used, "v_slot", "left").select("v_slot", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes", "n")])


def place(loads: DataFrame, n_shards: int = SHARDS, old: DataFrame | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """Map (v_slot, shard) for slot loads (v_slot, bytes).

    Slots are folded heaviest first over an array of n_shards loads. With an old map
    (v_slot, shard) a slot stays where it was while that shard exists and its load stays
    within (1 + tolerance) of the mean; else, and without one, it goes to the lightest shard, or
    in turn if it has no bytes.
    """
    rows = loads.select("v_slot", "bytes")
    rows = rows.join(old.select("v_slot", F.col("shard").alias("was")), "v_slot", "left") if old is not None else rows.withColumn("was", F.lit(None).cast("int"))
    rows = rows.withColumn("was", F.when(F.col("was") < n_shards, F.col("was")))
    one = rows.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "v_slot", "was"))).alias("items"),
        (F.sum("bytes") / n_shards * (1 + tolerance)).alias("most"),
    )

    def step(acc: Column, item: Column) -> Column:
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        stays = item["was"].isNotNull() & (F.get(acc["loads"], item["was"]) - item["minus"] <= F.col("most"))
        in_turn = F.when(item["minus"] == 0, F.coalesce(item["was"], F.pmod(item["v_slot"], F.lit(n_shards))))
        to = F.coalesce(F.when(stays, item["was"]), in_turn, lightest)
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == to, x - item["minus"]).otherwise(x)).alias("loads"),
            F.concat(acc["shards"], F.array(to)).alias("shards"),
        )

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"), F.array().cast("array<int>").alias("shards"))
    folded = one.select("items", F.aggregate("items", zero, step)["shards"].alias("shards"))
    pairs = folded.select(F.explode(F.arrays_zip("items", "shards")).alias("z"))
    return pairs.select(F.col("z.items.v_slot").alias("v_slot"), F.col("z.shards").alias("shard"))


class SlotMap:
    """The versioned map under a folder: version=1, 2, ... each a table (v_slot, shard)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, placed: DataFrame, version: int) -> DataFrame:
        placed.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def latest(self) -> int:
        """The last version's number, 0 without any."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)

    def rebalance(self, loads: DataFrame, version: int, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
        """Edits the given version for new loads or another shard count; writes the next."""
        return self.write(place(loads, n_shards, self.read(version), tolerance), version + 1)

    def serve(self, loads: DataFrame, n_shards: int, tolerance: float = TOLERANCE) -> DataFrame:
        """The map for these loads: the latest version if no slot need move, else the next one."""
        version = self.latest()
        if not version:
            return self.write(place(loads, n_shards, None, tolerance), 1)
        old = self.read(version)
        moved = place(loads, n_shards, old, tolerance).join(old.withColumnRenamed("shard", "was"), "v_slot", "left").where(~F.col("shard").eqNullSafe(F.col("was")))
        return old if moved.isEmpty() else self.rebalance(loads, version, n_shards, tolerance)


def new_map(spark: SparkSession) -> SlotMap:
    return SlotMap(spark, f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")


def sized_rows(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    thin = docs.select("doc_id", text_bytes(F.col("text")).alias("size"), text_crc(F.col("text")).alias("text_crc32"))
    return thin.withColumn("v_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), slots))


def shard_rows(thin: DataFrame, n_shards: int = SHARDS, store: SlotMap | None = None) -> DataFrame:
    """Adds shard and slot, a gapless position in the shard from 0, to rows (doc_id, size,
    text_crc32, v_slot). The position is the sum of the counts of the shard's lower slots and the
    row's number within its own, so no task orders a whole shard."""
    loads = stash(slot_bytes(thin), "slot-loads")
    placed = loads.join(F.broadcast((store or new_map(thin.sparkSession)).serve(loads, n_shards)), "v_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("v_slot").rowsBetween(Window.unboundedPreceding, -1))
    known = stash(placed.select("v_slot", "shard", F.coalesce(before, F.lit(0)).alias("base")), "slot-bases")
    alike = thin.groupBy("v_slot", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("alike"))
    lower = Window.partitionBy("v_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = alike.withColumn("in_slot", F.coalesce(F.sum("alike").over(lower), F.lit(0))).join(F.broadcast(known), "v_slot")
    first = F.col("base") + F.col("in_slot")
    slot = F.explode(F.sequence(first.cast("long"), (first + F.col("alike") - 1).cast("long"))).alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", "v_slot", "shard", slot)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, store: SlotMap | None = None) -> DataFrame:
    """docs with the columns shard and virtual_slot (replacing any of those names); the texts
    are not shuffled, as each row finds its shard in the broadcast map."""
    kept = [c for c in docs.columns if c not in ("shard", "virtual_slot")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("s_row"), "doc_id", "text")
    row = row.withColumn("s_size", text_bytes(F.col("text")))
    row = row.withColumn("v_slot", slot_of(F.col("doc_id"), text_crc(F.col("text")), F.col("s_size")))
    loads = stash(slot_bytes(row.select("v_slot", F.col("s_size").alias("size"))), "slot-loads")
    known = (store or new_map(docs.sparkSession)).serve(loads, n_shards)
    out = row.join(F.broadcast(known), "v_slot")
    return out.select("s_row.*", "shard", F.col("v_slot").alias("virtual_slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = stash(sized_rows(documents(spark, sf_dir)), "shard-thin")
    out = shard_rows(thin)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("v_slot").alias("virtual_slot")
    )
