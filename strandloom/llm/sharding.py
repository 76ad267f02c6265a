"""Sharding over fixed virtual slots, with a versioned slot-to-shard map that rebalancing edits."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.text import text_of
from strandloom.session import scratch_dir, stored

#: Fixed for the life of a data set. Every table of slots has at most so many rows.
SLOTS = 4096
#: Copies of a row that one task counts out at a time.
COPIES = 10_000


def distinct_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 and copies, how many rows of docs are alike in these."""
    text = text_of(F.col("text"))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))


def slot_of(slots: int) -> Column:
    """The slot that a row's doc_id, checksum and number among its copies hash to."""
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text_crc32", "copy")
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A row for each copy in distinct_rows(), numbered from 0 in column copy, with its virtual_slot.

    Copies of a row go to different slots. Those of a row with very many are first dealt out in runs to all tasks.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = rows.filter(F.col("copies") <= COPIES).select("doc_id", "size", "text_crc32", numbers(F.col("copies")).alias("copy"))
    many = rows.filter(F.col("copies") > COPIES)
    runs = many.select("*", numbers(F.ceil(F.col("copies") / COPIES)).alias("run")).repartition("doc_id", "size", "text_crc32", "run")
    inside = numbers(F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("run") * COPIES))
    many = runs.select("doc_id", "size", "text_crc32", "run", inside.alias("i"))
    many = many.select("doc_id", "size", "text_crc32", (F.col("run") * COPIES + F.col("i")).alias("copy"))
    return few.unionByName(many).withColumn("virtual_slot", slot_of(slots))


def slot_weights(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt out in turn, whatever they hold."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        F.lit(1).alias("version"), slot.alias("virtual_slot"), F.pmod(slot, F.lit(shards)).alias("shard")
    )


def rebalance(slot_map: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version of slot_map: shards keep slots up to the mean load, the rest move to the least loaded shard.

    Works on the slot table alone, whose rows are bounded by the number of slots. A shard keeps its largest slots
    first; the slots over the mean are taken largest first, ties to the smaller slot, and each goes to the shard with
    the least bytes so far, ties to the smaller shard. Shards numbered at or over `shards` give up all their slots.
    """
    w = slot_map.join(weights, "virtual_slot", "left").fillna(0, ["bytes", "rows"])
    by_shard = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    mean = F.sum("bytes").over(Window.partitionBy()) / shards
    fits = (F.sum("bytes").over(by_shard) <= mean) | (F.col("bytes") == 0)  # moving an empty slot helps nobody
    held = w.withColumn("stays", fits & (F.col("shard") < shards))
    kept = held.filter("stays").groupBy("shard").agg(F.sum("bytes").alias("load"))
    loads = (
        held.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
        .join(kept, "shard", "left")
        .agg(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))).alias("l"))
        .select(F.transform("l", lambda x: x["load"]).alias("loads"))
    )
    moving = held.filter(~F.col("stays")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot"))).alias("moving")
    )

    def place(state, slot):
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda v, i: F.when(i == least, v - slot["minus"]).otherwise(v)).alias("loads"),
            F.concat(state["to"], F.array(least)).alias("to"),
        )

    start = F.struct(F.col("loads"), F.array().cast("array<int>").alias("to"))
    moved = (
        moving.crossJoin(loads)  # one row each
        .select("moving", F.aggregate("moving", start, place)["to"].alias("to"))
        .select(F.explode(F.arrays_zip("moving", "to")).alias("m"))
        .select(F.col("m.moving.virtual_slot").alias("virtual_slot"), F.col("m.to").alias("shard"))
    )
    version = F.lit(1) + F.max("version").over(Window.partitionBy())
    edited = held.filter("stays").select("virtual_slot", "shard").unionByName(moved)
    return slot_map.select(version.alias("version"), "virtual_slot").join(edited, "virtual_slot")


def save_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Append one version of the map to the table at path and return that version read back."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return load_map(slot_map.sparkSession, path)


def load_map(spark, path: str) -> DataFrame | None:
    """The last version of the map at path; None where there is none."""
    try:
        saved = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
        return saved.filter(F.col("version") == saved.agg(F.max("version")).first()[0])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def spread(slot_map: DataFrame, weights: DataFrame, shards: int) -> float:
    """Bytes of the largest shard less those of the smallest; without end where a slot is in none of the shards."""
    held = slot_map.join(weights, "virtual_slot", "left").groupBy("shard").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    every = slot_map.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(held, "shard", "full").select(F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.col("shard") >= shards).alias("gone"))
    most, least, gone = loads.agg(F.max("bytes"), F.min("bytes"), F.count_if("gone")).first()
    return float("inf") if gone else most - least


def edited_map(spark, path: str, weights: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """The map at path, rebalanced where its shards differ by more than the largest slot and a new version is more even."""
    current = load_map(spark, path)
    if current is None:
        current = save_map(first_map(spark, shards, slots), path)
    if current.count() != slots:
        raise ValueError(f"the map at {path} has not {slots} slots")
    uneven = spread(current, weights, shards)
    if uneven <= (weights.agg(F.max("bytes")).first()[0] or 0):
        return current
    edited = stored(rebalance(current, weights, shards), "slot-map")
    return save_map(edited, path) if spread(edited, weights, shards) < uneven else current


def shard_documents(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot (the place in the shard, gapless from 0).

    A null text has size 1 and the checksum of no bytes; a null doc_id hashes like any value; rows that are alike are
    counted, then dealt to slots and places one by one, so many copies of a row spread over all shards; other columns take
    no part; an empty table gives an empty table. Shards' bytes differ by about a row's size, so one row that is larger
    than a shard's fair share, which can't be split, makes them uneven. With map_path the map there is used and edited.
    """
    spark = docs.sparkSession
    path = map_path or f"{scratch_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    slotted = with_slots(stored(distinct_rows(docs), "rows"), slots)
    weights = stored(slot_weights(slotted), "weights")
    current = edited_map(spark, path, weights, shards, slots)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = current.join(weights, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("from")
    )
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    return (
        slotted.withColumn("nth", F.row_number().over(in_slot))
        .join(F.broadcast(places), "virtual_slot")  # at most `slots` rows
        .select(
            "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("from") + F.col("nth") - 1).alias("slot")
        )
    )


def op7_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """Law: bytes."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
