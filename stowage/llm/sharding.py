"""Sharding by jump consistent hashing (Lamping and Veach, 2014), with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism

#: Multiplier of the published generator.
JUMP_MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"
#: Repeats of one row that one task writes out from a single counted row.
STRETCH = 1 << 16


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a 64-bit ``key`` (null: as 0), equal to the published jump hash.

    The 64-bit generator runs in 38-digit decimals, so nothing overflows under ANSI mode.  A key makes about
    ln(shards) jumps; the fold's further steps change nothing.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def after(k: Column) -> Column:
        product = k * F.lit(JUMP_MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
        return (product % F.lit(TWO_64).cast("decimal(20,0)")).cast("decimal(20,0)")

    wide = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(wide < 0, (wide + F.lit(TWO_64).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), after(unsigned).alias("k"))

    def jump(s: Column, _: Column) -> Column:
        # the top 31 bits decide; integral division keeps them exact
        draw = (F.call_function("div", s["k"], F.lit("8589934592").cast("decimal(20,0)")) + 1).cast("double")
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / draw)).cast("long")
        moved = F.struct(s["j"].alias("b"), to.alias("j"), after(s["k"]).alias("k"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda s: s["b"].cast("int"))


def counted(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, copies): rows that repeat all three, counted."""
    told = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(told) + 8).cast("long").alias("size"),
        F.crc32(told.cast("binary")).alias("text_crc32"),
    )
    return rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))


def shard(documents: DataFrame, shards: int = 24, *, key: str = "doc_id", text: str = "text", pieces: int | None = None) -> DataFrame:
    """Put every row into one of ``shards`` shards by its key; one more shard takes rows only into itself.

    Returns (key, size, text_crc32, law, shard, slot, grown_shard).  size: UTF-8 bytes of the text plus 8, a null
    text counting as none (checksum of no bytes: 0).  A null key hashes as 0.  slot numbers a shard's rows from 0
    without gaps, in order of key, size and checksum.  Rows that repeat all of these are counted before the shuffle and
    told apart only by their slots; more than STRETCH repeats are dealt out to tasks in stretches.  No task numbers a whole shard: each shard is ranked in ``pieces`` hash
    pieces (default: the session's shuffle partitions, 64 at least), whose sizes give the offsets.
    An empty table gives an empty result; further columns are ignored.
    """
    pieces = pieces or max(64, parallelism(documents.sparkSession))
    # kept as a table, so that the sizes and both kinds of runs do not read the texts again
    same = materialize(counted(documents, key=key, text=text)).select(
        "*",
        jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(pieces)).cast("int").alias("piece"),
    )
    sizes = same.groupBy("shard", "piece").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("prior", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(offsets, ["shard", "piece"])
    first = F.col("offset") + F.col("prior")
    runs = ranked.select("doc_id", "size", "text_crc32", "shard", "grown_shard", first.alias("first"), (first + F.col("copies") - 1).alias("last"))
    long_run = F.col("last") - F.col("first") >= STRETCH
    starts = runs.filter(long_run).withColumn("first", F.explode(F.sequence("first", "last", F.lit(STRETCH).cast("long"))))
    stretches = starts.withColumn("last", F.least(F.col("last"), F.col("first") + STRETCH - 1)).repartition(pieces, "first", "shard")
    return runs.filter(~long_run).unionByName(stretches).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("first", "last")).alias("slot"), "grown_shard"
    )
