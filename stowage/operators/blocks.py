"""Contents by blocks: cutting chunks anew at aligned borders, digests of digests, sampled windows and their signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import HASH_BLOCK

#: Bytes of a sampled window; windows begin at multiples of ALIGN in a member.
SAMPLE, ALIGN = 64 << 10, 8


def chunk_offsets(chunks: DataFrame, keys: list[str], order: str, size: Column, width: int = 4096) -> DataFrame:
    """Adds ``offset``: bytes of the same file before a chunk, chunks lying in ``order`` (long).

    A file is added up in stretches of ``width`` numbers first, so that no task sorts a whole file.
    """
    rows = chunks.withColumns({"_size": size.cast("long"), "_stretch": F.floor(F.col(order) / F.lit(width))})
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select(*keys, "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(begins, [*keys, "_stretch"])
    return rows.withColumn("offset", F.col("_begin") + F.col("_inside")).drop("_size", "_stretch", "_begin", "_inside")


def block_digests(chunks: DataFrame, keys: list[str], order: str, content: str = "content", block: int = HASH_BLOCK) -> DataFrame:
    """(keys, block, length, digest): SHA-256 of each aligned block of files that are stored as rows of bytes, whatever the rows' lengths.

    Chunks are cut at the blocks' borders where they are, and only their pieces are shuffled; a task's group is one block.
    """
    placed = chunk_offsets(chunks, keys, order, F.octet_length(content)).filter(F.octet_length(content) > 0)
    first, last = F.floor(F.col("offset") / F.lit(block)), F.floor((F.col("offset") + F.octet_length(content) - 1) / F.lit(block))
    each = placed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block - F.col("offset"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("offset"), F.octet_length(content).cast("long"))
    pieces = each.select(*keys, "block", F.col("offset"), F.substring(content, (begin + 1).cast("int"), (end - begin).cast("int")).alias("piece"))
    whole = pieces.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("offset", "piece"))).alias("p"), F.sum(F.octet_length("piece")).alias("length"))
    joined = F.array_join(F.transform("p", lambda p: F.hex(p["piece"])), "")
    return whole.select(*keys, "block", "length", F.sha2(F.unhex(joined), 256).alias("digest"))


def digest_of_digests(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content_hash): SHA-256 of the blocks' digests in order; a file's 64 hex digits a block meet in one row."""
    ordered = F.sort_array(F.collect_list(F.struct("block", "digest")))
    found = blocks.groupBy(*keys).agg(ordered.alias("b"))
    return found.select(*keys, F.sha2(F.unhex(F.array_join(F.transform("b", lambda b: b["digest"]), "")), 256).alias("content_hash"))


def windows(size: Column, samples: int, width: int = SAMPLE) -> Column:
    """Array of (k, at, length): up to ``samples`` windows inside a content of ``size`` bytes, its first and last among them; all of a small one."""
    one = lambda k, at, length: F.struct(k.cast("int").alias("k"), at.cast("long").alias("at"), length.cast("long").alias("length"))
    zero = F.lit(0)
    if samples <= 1:
        return F.array(one(zero, zero, F.least(size, F.lit(width))))
    at = lambda k: F.call_function("div", F.call_function("div", (size - width) * k, F.lit(samples - 1)), F.lit(ALIGN)) * ALIGN
    return F.when(size <= width, F.array(one(zero, zero, size))).otherwise(F.transform(F.sequence(zero, F.lit(samples - 1)), lambda k: one(k, at(k), F.lit(width))))


def window_digests(contents: DataFrame, keys: list[str], content: str = "content", samples: int = 4, width: int = SAMPLE) -> DataFrame:
    """(keys, k, digest) of the sampled windows of contents that stand in rows."""
    each = contents.select(*keys, content, F.explode(windows(F.octet_length(content), samples, width)).alias("w"))
    return each.select(*keys, "w.k", F.sha2(F.substring(content, (F.col("w.at") + 1).cast("int"), F.col("w.length").cast("int")), 256).alias("digest"))


def signatures(digests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, signature): the tuple of a content's window digests, in order, as one digest."""
    found = digests.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "digest"))).alias("d"))
    return found.select(*keys, F.sha2(F.array_join(F.transform("d", lambda d: d["digest"]), ","), 256).alias("signature"))
