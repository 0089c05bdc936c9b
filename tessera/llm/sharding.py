"""Sharding by jump consistent hashing, with DataFrame functions only.

A key walks through candidate buckets: from bucket b it jumps to floor((b + 1) / u), where u in (0, 1] is a
uniform value that (key, b) alone decide, and stops in the last bucket below the shard count. There is no ring
table, and one more shard takes just the keys whose next jump lands on it.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

_LANES = 1024


def _next_bucket(key: Column, bucket: Column) -> Column:
    """Where the key jumps to from bucket; above it always."""
    draw = F.shiftrightunsigned(F.xxhash64(key, bucket), 33) + F.lit(1).cast("long")  # 1 .. 2**31
    return F.floor((bucket + 1) * F.lit(float(1 << 31)) / draw).cast("long")


def _walk(key: Column, start: Column, shards: int, steps: int) -> Column:
    def step(bucket: Column, _: Column) -> Column:
        jump = _next_bucket(key, bucket)
        return F.when(jump < shards, jump).otherwise(bucket)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a key (int). A null key hashes as a value of its own.

    A walk takes about ln(shards) jumps. Four times that many are tried at once; the rare key that has not come
    to rest walks on for as many steps as there are shards, which always suffices.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    if shards == 1:
        return F.lit(0)
    short = min(shards - 1, 8 + 4 * ceil(log(shards)))
    near = _walk(key, F.lit(0).cast("long"), shards, short)
    if short < shards - 1:
        near = F.when(_next_bucket(key, near) >= shards, near).otherwise(_walk(key, near, shards, shards))
    return near.cast("int")


def shard_rows(df: DataFrame, key: str, shards: int, keep: list[Column]) -> DataFrame:
    """keep, plus shard, grown_shard (with one more shard) and slot (gapless from 0 in each shard), one row per row of df.

    Rows of one key, copies included, share a shard; their slots differ. Nulls are a key like any other. An
    empty df gives no rows. Slots are counted in lanes, which take the rows of every shard in turn, so that no
    shard and no repeated key is numbered by one task: each lane is numbered alone and starts after the rows
    of the lanes before it. The rows are written once, so that both uses see the same row numbers.
    """
    k = F.col(key)
    placed = stored(
        df.select(*keep, jump_shard(k, shards).alias("shard"), F.monotonically_increasing_id().alias("_row")).withColumn(
            "grown_shard", _grown(k, F.col("shard"), shards)
        ),
        "shards",
    ).withColumn("_lane", F.pmod("_row", F.lit(_LANES)))
    ahead = placed.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("shard", "_lane").orderBy("_row"))
    return (
        placed.withColumn("_own", own)
        .join(ahead, ["shard", "_lane"])
        .withColumn("slot", F.col("_ahead") + F.col("_own") - 1)
        .drop("_own", "_ahead", "_lane", "_row")
    )


def _grown(key: Column, shard: Column, shards: int) -> Column:
    """The walk has rested below shards; with one more shard it goes there or stays."""
    return F.when(_next_bucket(key, shard.cast("long")) == shards, F.lit(shards)).otherwise(shard).cast("int")


def op6_jump_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``key``: doc_id and the shard count decide.

    A null text has size 1 and the checksum of no bytes (0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    ]
    out = shard_rows(table(spark, sf_dir, "documents"), "doc_id", 16, keep)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
