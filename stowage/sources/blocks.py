"""Bytes of files by ranges, as Spark data sources and jobs: digests of aligned blocks, and of samples of archive members.

A file is dealt out in spans of whole blocks, so that one of hundreds of GB is hashed by many tasks, each of which holds one block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.values import HASH_BLOCK
from ..operators import blocks as B
from .store import Reader, Stored
from .tar import Parts

#: Blocks of a partition.
SPAN = 16
#: Bytes of an archive whose samples one task reads, in order.
STRETCH = 1 << 30
BLOCKS = "path string, block long, length long, digest string"


class Span(InputPartition):
    def __init__(self, path: str, size: int, first: int, last: int):
        self.path, self.size, self.first, self.last = path, size, first, last


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.block, self.span = json.loads(options["files"]), int(options.get("block", HASH_BLOCK)), int(options.get("span", SPAN))

    def partitions(self) -> list[InputPartition]:
        made = []
        for path, size in self.files:
            count = -(-size // self.block)
            made += [Span(path, size, n, min(n + self.span, count)) for n in range(0, count, self.span)]
        return made

    def read(self, partition: Span) -> Iterator[tuple]:
        reader = Reader()
        try:
            for n in range(partition.first, partition.last):
                length = min(self.block, partition.size - n * self.block)
                yield partition.path, n, length, hashlib.sha256(reader.fetch(partition.path, n * self.block, length)).hexdigest()
        finally:
            reader.close()


class FileBlocks(DataSource):
    """SHA-256 of each block of files: options ``files`` (JSON list of [path or URI, size]), ``block`` and ``span``."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def content_hashes(spark: SparkSession, files: list[Stored], block: int = HASH_BLOCK) -> DataFrame:
    """(path, content_hash): the digest of the digests of each file's blocks, in order; an empty file has that of nothing."""
    spark.dataSource.register(FileBlocks)
    told = spark.read.format("file_blocks").option("files", json.dumps([[f.path, f.size] for f in files])).option("block", block).load()
    every = spark.createDataFrame([(f.path,) for f in files], "path string")
    return every.join(B.digest_of_digests(told, ["path"]), "path", "left").select("path", F.coalesce("content_hash", F.lit(hashlib.sha256(b"").hexdigest())).alias("content_hash"))


def member_digests(members: DataFrame, archives: list[dict], samples: int = 4, width: int = B.SAMPLE) -> DataFrame:
    """(archive_id, hdr_offset, k, digest) of ``samples`` windows of each member (see ``operators.blocks.windows``).

    archives: as for ``sources.tar``.  Windows that lie near each other in an archive are read by one task in order.  The parts' names and
    sizes go to every task, no bytes go through the driver.
    """
    parts = {a["archive_id"]: (a["parts"], a.get("sizes")) for a in archives}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, archive = None, None
        for batch in batches:
            digests = []
            for archive_id, at, length in zip(*(batch.column(c).to_pylist() for c in ("archive_id", "at", "length"))):
                if archive_id != now:
                    now, archive = archive_id, Parts(*parts[archive_id])
                got = archive.fetch(at, length)
                if len(got) != length:
                    raise OSError(f"archive {archive_id} ends before {at + length}")
                digests.append(hashlib.sha256(got).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("archive_id", "hdr_offset", "k")), pa.array(digests, pa.string())], ["archive_id", "hdr_offset", "k", "digest"])

    each = members.select("archive_id", "hdr_offset", "data_offset", F.explode(B.windows(F.col("size"), samples, width)).alias("w"))
    each = each.select("archive_id", "hdr_offset", "w.k", (F.col("data_offset") + F.col("w.at")).alias("at"), "w.length")
    dealt = each.withColumn("stretch", F.floor(F.col("at") / F.lit(STRETCH))).repartition("archive_id", "stretch").sortWithinPartitions("archive_id", "at")
    return dealt.mapInArrow(read, "archive_id long, hdr_offset long, k int, digest string")


def signed(members: DataFrame, archives: list[dict], samples: int = 4, width: int = B.SAMPLE, scope: int = 0) -> DataFrame:
    """Members that share name and size with another, with ``scope`` (the first steps of their folder) and ``signature``: equal where all sampled windows are.

    Equal signatures make equal contents likely, different ones settle that they differ; a member of at most ``width`` bytes is read whole.
    """
    head = F.array_join(F.slice(F.split("dir", "/"), 1, scope), "/") if scope else F.lit("")
    rows = members.filter(F.col("type").isin("0", "\0", "7") & (F.col("size") > 0)).withColumn("scope", head)
    shared = rows.groupBy("archive_id", "scope", "name", "size").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    some = rows.join(shared, ["archive_id", "scope", "name", "size"])
    found = B.signatures(member_digests(some, archives, samples, width), ["archive_id", "hdr_offset"])
    return some.join(found, ["archive_id", "hdr_offset"])
