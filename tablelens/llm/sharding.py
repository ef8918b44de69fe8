"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed number of slots. A map, kept in versions, says which shard each slot belongs
to. Bytes are summed by slot, and rebalancing edits the map: each shard keeps its largest slots up to the mean load and
gives up the rest, which go, largest first, to the shard that is lightest then. Records never change slots, so an edit
of the map moves whole slots and nothing else.

The map is stored, a folder for each version, and records are placed by the version that is read back. Placing records
on a stored map begins with its latest version and adds the next.

Nulls: a null key hashes like an empty string; a null text has no bytes. Empty tables give an empty result. Repeated
rows are placed one by one. Columns other than the key and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.common import exists, materialise, new_path, only

#: The map is broadcast, so the number of its rows is bounded.
MAX_SLOTS = 65536
ROW_OVERHEAD = 8


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key, from 32 bits of an MD5 digest."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(slots)


def first_map(spark: SparkSession, slots: int, shards: int) -> DataFrame:
    """Version 1: slots dealt to shards in turn. Columns: version, vslot, shard."""
    if not 0 < shards <= slots <= MAX_SLOTS:
        raise ValueError(f"need 0 < shards <= slots <= {MAX_SLOTS}")
    return spark.range(slots, numPartitions=1).select(
        F.lit(1).alias("version"), F.col("id").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard")
    )


def slot_loads(sized: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; partial sums come before the shuffle."""
    return sized.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for ``shards`` shards, with as few slots moved as the mean load allows.

    Slots of shards that no longer exist count as given up. All work is on one row per slot (at most ``MAX_SLOTS``).
    """
    m = slot_map.join(loads, "vslot", "left").select(
        "version", "vslot", "shard", F.coalesce("slot_bytes", F.lit(0)).cast("long").alias("b")
    )
    everything = Window.partitionBy(F.lit(0))
    running = Window.partitionBy("shard").orderBy(F.desc("b"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    m = m.select(
        "*",
        (F.sum("b").over(everything) / F.lit(float(shards))).alias("mean"),
        F.sum("b").over(running).alias("load"),
    ).withColumn("kept", (F.col("load") <= F.col("mean")) & (F.col("shard") < shards))
    one = m.groupBy().agg(
        (F.max("version") + 1).alias("version"),
        F.collect_list(F.when(F.col("kept"), F.struct("vslot", "shard", "b"))).alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("kept"), F.struct((-F.col("b")).alias("minus"), "vslot", "shard")))).alias("pool"),
        F.max("mean").alias("mean"),
    )
    summed = F.aggregate(
        F.col("kept"),
        F.array_repeat(F.lit(0).cast("long"), shards),
        lambda acc, x: F.transform(acc, lambda v, i: F.when(i == x["shard"], v + x["b"]).otherwise(v)),
    )
    start = F.struct(
        summed.alias("loads"), F.expr("cast(array() as array<struct<vslot:bigint,shard:int>>)").alias("moves")
    )

    def put(acc: Column, x: Column) -> Column:
        lightest = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        # A slot that still fits where it was stays there.
        fits = (x["shard"] < shards) & (F.get(acc["loads"], x["shard"]) - x["minus"] <= F.col("mean"))
        return _let(
            F.when(fits, x["shard"]).otherwise(lightest),
            lambda k: F.struct(
                F.transform(acc["loads"], lambda v, i: F.when(i == k, v - x["minus"]).otherwise(v)).alias("loads"),
                F.concat(acc["moves"], F.array(F.struct(x["vslot"].alias("vslot"), k.alias("shard")))).alias("moves"),
            ),
        )

    placed = F.aggregate("pool", start, put)["moves"]
    stays = F.transform("kept", lambda x: F.struct(x["vslot"].alias("vslot"), x["shard"].alias("shard")))
    return one.select("version", F.explode(F.concat(stays, placed)).alias("m")).select("version", "m.vslot", "m.shard")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add the map's versions to the stored map; one folder per version."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    stored = spark.read.parquet(path).select("version", "vslot", "shard")
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def size_records(df: DataFrame, key: str, text: str, slots: int) -> DataFrame:
    """key, size, text_crc32 and vslot of every record."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return only(df, key, text).select(
        F.col(key).alias("key"),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        slot_of(F.col(key), slots).alias("vslot"),
    )


def place(sized: DataFrame, loads: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Shard and gapless place in it for every sized record: the slot's offset in its shard plus the place in the slot."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slot_map.join(loads, "vslot", "left")
        .select("version", "vslot", "shard", F.coalesce("slot_rows", F.lit(0)).alias("n"))
        .select(F.col("version").alias("map_version"), "vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("offset"))
    )
    inside = Window.partitionBy("vslot").orderBy("key", "text_crc32", "size")
    return sized.join(F.broadcast(offsets), "vslot").select(
        "key", "size", "text_crc32", "vslot", "shard", (F.col("offset") + F.row_number().over(inside) - 1).alias("slot"), "map_version"
    )


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, slots: int = 8192, map_path: str | None = None) -> DataFrame:
    """Place every record of ``df``: key, size, text_crc32, vslot, shard, slot, map_version.

    ``map_path`` is where the map's versions are kept; without it they are written for this run alone. The number of
    slots is that of the stored map.
    """
    spark = df.sparkSession
    path = map_path or new_path(spark, "slot-map")
    if not exists(spark, path):
        save_map(first_map(spark, slots, shards), path)
    old = load_map(spark, path)
    slots = old.count()
    sized = materialise(size_records(df, key, text, slots), "sized")
    loads = materialise(slot_loads(sized), "slot-loads")
    save_map(rebalance(old, loads, shards), path)
    return place(sized, loads, load_map(spark, path))
