"""Turning pages of listing entries into a catalog: relational forms of what the streaming sink does for each batch.

Entries: (shard_id, seq, tag, id, name, path, size, rev, content_hash, client_modified, server_modified, downloadable,
modified_by); tag is file, folder or deleted; seq orders all entries of a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values


def sort_out(entries: DataFrame, shard_path: str = "") -> dict[str, DataFrame]:
    """files, folders and events of a batch.

    An entry without a path goes right below the shard's folder and is logged; a bad hash becomes null and is logged; a
    deleted entry is only logged.
    """
    fallback = F.concat(F.lit(shard_path.rstrip("/") + "/"), F.coalesce("name", F.lit("")))
    rows = entries.withColumn("at", F.coalesce("path", fallback)).withColumn("digest", values.hash_bytes(F.col("content_hash")))
    files = rows.filter("tag = 'file'").select(
        "shard_id", "seq", "id", paths.parent(F.col("at")).alias("folder"), F.lower(paths.parent(F.col("at"))).alias("folder_lower"), F.coalesce("name", paths.basename(F.col("at"))).alias("name"),
        paths.extension(F.coalesce("name", paths.basename(F.col("at")))).alias("ext"), F.coalesce("size", F.lit(0)).alias("size"), F.lower(F.hex("digest")).alias("content_hash"), "rev",
        values.epoch(F.col("client_modified")).alias("modified"), values.epoch(F.col("server_modified")).alias("server_modified"), "downloadable", "modified_by",
    )
    folders = rows.filter("tag = 'folder'").select("shard_id", "seq", "id", F.col("at").alias("folder"))
    event = F.when(F.col("tag") == "deleted", "deleted").when(F.col("path").isNull(), "no_path").when(F.col("digest").isNull() & (F.coalesce("content_hash", F.lit("")) != ""), "bad_hash")
    events = rows.select("shard_id", "seq", event.alias("kind"), F.substring(F.coalesce("path", "name", F.lit("")), 1, 500).alias("detail")).filter("kind is not null")
    return {"files": files, "folders": folders, "events": events}


def upsert(current: DataFrame, batch: DataFrame | None, key: str = "id", order: str = "seq", keep_first: tuple[str, ...] = ("downloadable",)) -> DataFrame:
    """Last write wins by ``key``, except for the columns in ``keep_first``, whose first value stays.  Without a batch, the rows of ``current`` count."""
    both = current if batch is None else current.unionByName(batch)
    columns = [c for c in both.columns if c != key]
    last = F.max_by(F.struct(*columns), F.col(order))
    first = F.min_by(F.struct(*keep_first), F.col(order)) if keep_first else None
    grouped = both.groupBy(key).agg(last.alias("l"), *([first.alias("f")] if keep_first else []))
    return grouped.select(*[F.col(key) if c == key else F.col("f")[c].alias(c) if c in keep_first else F.col("l")[c].alias(c) for c in current.columns])


def derive_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, parent, depth, id): every folder above a file or folder entry, with the id of its own entry once that is listed."""
    seen = files.select("folder").unionByName(folders.select("folder")).distinct()
    every = seen.select(F.explode(paths.ancestors(F.col("folder"))).alias("folder")).filter("folder <> ''").distinct()
    named = folders.groupBy("folder").agg(F.max_by("id", "seq").alias("id"))
    return every.join(named, "folder", "left").select("folder", paths.parent(F.col("folder")).alias("parent"), paths.depth(F.col("folder")).alias("depth"), "id")


def restate(files: DataFrame, shards: DataFrame) -> DataFrame:
    """Files without those of the shards that are to be listed anew; folders stay."""
    return files.join(shards.select("shard_id").distinct(), "shard_id", "left_anti")


def should_split(listed: DataFrame, least: int = 20, share: float = 0.1) -> DataFrame:
    """(parent, leafy): whether the folders listed so far below a parent hardly hold folders, so the others are listed one by one.

    listed(path, had_folders); known once ``least`` of them are listed.
    """
    by = listed.groupBy(paths.parent(F.col("path")).alias("parent")).agg(F.count("*").alias("n"), F.count_if("had_folders").alias("m"))
    return by.filter(F.col("n") >= least).select("parent", (F.col("m") <= share * F.col("n")).alias("leafy"))
