"""Listing sources: pages of JSON entries, in batch or as a resumable stream, and a second listing to compare with."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import store

ENTRY = "shard_id long, seq long, tag string, id string, name string, path string, size long, rev string, content_hash string, client_modified string, server_modified string, downloadable boolean, modified_by string"
PAGE = "entries array<struct<`.tag`:string,tag:string,id:string,name:string,path_display:string,size:long,rev:string,content_hash:string,client_modified:string,server_modified:string,is_downloadable:boolean,sharing_info:struct<modified_by:string>>>, cursor string, has_more boolean"


class ListingError(Exception):
    """A page that a lister could not give."""


class Retry(ListingError):
    """Worth another try, after ``seconds``."""

    def __init__(self, message: str, seconds: float = 1.0):
        super().__init__(message)
        self.seconds = seconds


class Reset(ListingError):
    """The cursor is no longer valid: the folder is to be listed from its start."""


class Gone(ListingError):
    """The folder is not there."""


class Refused(ListingError):
    """The credentials are not accepted."""


def classify_answer(status: int, body: str, retry_after: str | None = None) -> ListingError | None:
    """What an HTTP answer of a paged listing service means; None if it is a page."""
    if status == 200:
        return None
    if status == 429:
        try:
            return Retry("rate limited", float(retry_after or 1))
        except ValueError:
            return Retry("rate limited")
    if status in (401, 403):
        return Refused(f"{status}: {body[:200]}")
    if status == 409:
        if "reset" in body:
            return Reset(body[:200])
        return Gone(body[:200]) if "not_found" in body else ListingError(f"409: {body[:200]}")
    if status >= 500:
        return Retry(f"{status}: {body[:200]}", 5.0)
    return ListingError(f"{status}: {body[:200]}")


def read_pages(spark: SparkSession, path: str, shard_id: int = 0) -> DataFrame:
    """Entries of stored pages (JSON, one a line), in the columns of ENTRY; seq is the page's file order and the place in the page."""
    pages = spark.read.schema(PAGE).json(path).withColumn("page", F.col("_metadata.file_name"))
    e = pages.select("page", F.posexplode("entries").alias("k", "e"))
    number = F.coalesce(F.regexp_extract("page", r"(\d+)", 1).try_cast("long"), F.lit(0))
    return e.select(
        F.lit(shard_id).cast("long").alias("shard_id"), (number * 1_000_000 + F.col("k")).alias("seq"), F.coalesce(F.col("e.`.tag`"), "e.tag").alias("tag"), "e.id", "e.name", F.col("e.path_display").alias("path"), "e.size", "e.rev",
        "e.content_hash", "e.client_modified", "e.server_modified", F.col("e.is_downloadable").alias("downloadable"), F.col("e.sharing_info.modified_by").alias("modified_by"),
    )


def read_second_listing(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {Path, Size} as (path, size)."""
    return spark.read.schema("Path string, Size long").json(path, multiLine=True).select(F.col("Path").alias("path"), F.col("Size").alias("size"))


@dataclass
class Page(InputPartition):
    """One stored page, read by one task."""

    number: int


class PageStream(DataSourceStreamReader):
    """Pages 00000000.json, 00000001.json, ... of a folder, as a lister leaves them; the offset is the next page's number.

    The driver only looks which pages are there; each page is a partition of its batch, so entries go through tasks only.
    """

    def __init__(self, options: dict):
        self.folder, self.shard = options["path"], int(options.get("shard_id", "0"))
        self.next = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        while store.exists(f"{self.folder}/{self.next:08d}.json"):
            self.next += 1
        return {"page": self.next}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        entries = json.loads(store.read(f"{self.folder}/{partition.number:08d}.json"))["entries"]
        for k, e in enumerate(entries):
            by = (e.get("sharing_info") or {}).get("modified_by")
            yield (self.shard, partition.number * 1_000_000 + k, e.get(".tag") or e.get("tag"), e.get("id"), e.get("name"), e.get("path_display"), e.get("size"), e.get("rev"), e.get("content_hash"), e.get("client_modified"), e.get("server_modified"), e.get("is_downloadable"), by)


class ListingPages(DataSource):
    """A stream of listing entries from stored pages."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return ENTRY

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingPages)
