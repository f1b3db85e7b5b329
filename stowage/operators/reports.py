"""Reports over a listing: files(folder, name, ext, size, content_hash, modified), modified in epoch seconds.

Every function returns a DataFrame and leaves ordering ties to stated columns.  A null hash is no
duplicate of anything, a null date never old.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, values
from .tree import rollup


def inside(files: DataFrame, folder: str) -> Column:
    """Whether a file is at or below a folder, without case; reaches the scan if the listing stores ``folder_lower``."""
    return paths.in_subtree(F.col("folder_lower") if "folder_lower" in files.columns else F.lower("folder"), folder)


def under(files: DataFrame, folder: str | None) -> DataFrame:
    """Files at or below a folder; all for None."""
    return files if folder is None else files.filter(inside(files, folder))


def reconcile(files: DataFrame, reported: int) -> DataFrame:
    """Listed bytes against what the account reports as used."""
    live = F.coalesce(F.sum("size"), F.lit(0)).cast("long")
    return files.agg(live.alias("live_bytes")).select("live_bytes", F.lit(reported).cast("long").alias("reported_bytes"), (F.lit(reported) - F.col("live_bytes")).cast("long").alias("residual_bytes"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Per content that occurs more than once: copies, size, and the bytes that one copy less each would free."""
    return (
        files.filter(F.col("content_hash").isNotNull()).groupBy("content_hash")
        .agg(
            F.count("*").alias("copies"), F.max("size").alias("size"), F.sum("size").alias("total"),
            F.min(paths.full_path(F.col("folder"), F.col("name"))).alias("example"),
        )
        .filter("copies > 1")
        .select("content_hash", "copies", "size", (F.col("total") - F.col("size")).alias("reclaimable"), "example")
    )


def duplicates_top(files: DataFrame, limit: int = 50) -> DataFrame:
    return duplicate_groups(files).orderBy(F.desc("reclaimable"), "content_hash").limit(limit)


def duplicates_total(files: DataFrame) -> DataFrame:
    groups = files.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("copies"), F.max("size").alias("most"), F.sum("size").alias("total"))
    return groups.filter("copies > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("total") - F.col("most")), F.lit(0)).cast("long").alias("reclaimable"))


def cold_by_year(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Files and bytes by the UTC year they were last changed in."""
    dated = under(files, folder).filter(F.col("modified").isNotNull())
    return dated.groupBy(values.utc_year(F.col("modified")).alias("year")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def older_than(files: DataFrame, years: list[float], as_of: int, folder: str | None = None) -> DataFrame:
    """Files and bytes last changed strictly before each number of years ago, in one pass."""
    rows = under(files, folder).filter(values.older_than(F.col("modified"), min(years), as_of))
    ages = F.array(*[F.when(values.older_than(F.col("modified"), y, as_of), F.lit(float(y))) for y in years])
    each = rows.select("size", F.explode(F.filter(ages, lambda y: y.isNotNull())).alias("years"))
    return each.groupBy("years").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """Files and bytes of each folder with all below it."""
    own = files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return rollup(own, ["files", "bytes"])


def top_folders(files: DataFrame, limit: int = 50) -> DataFrame:
    return folder_rollup(files).orderBy(F.desc("bytes"), "folder").limit(limit)


def top_level(files: DataFrame, root: str = "") -> DataFrame:
    """The rollup of the folders right below ``root``."""
    level = root.rstrip("/").count("/") + 1
    at = F.array_join(F.slice(F.split("folder", "/"), 1, level + 1), "/")
    below = under(files, root) if root.rstrip("/") else files
    deep = below.filter(paths.depth(F.col("folder")) >= level)
    return deep.groupBy(at.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def hotspots(files: DataFrame, min_files: int = 100_000, max_mean: float = 65_536, limit: int = 50) -> DataFrame:
    """Folders that hold very many small files themselves."""
    own = files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.avg("size").alias("mean"))
    found = own.filter((F.col("files") >= min_files) & (F.col("mean") <= max_mean))
    return found.orderBy(F.desc("files"), "folder").limit(limit)


def extension_profile(files: DataFrame, limit: int = 40, folder: str | None = None) -> DataFrame:
    ext = F.coalesce(F.when(F.col("ext") != "", F.col("ext")), F.lit("(none)")).alias("ext")
    found = under(files, folder).groupBy(ext).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return found.orderBy(F.desc("bytes"), "ext").limit(limit)


def stats(files: DataFrame, shards: DataFrame) -> DataFrame:
    """One row: files, bytes, and shards by state."""
    names = ("pending", "running", "done", "error")
    ours = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    theirs = shards.agg(F.count("*").alias("shards"), *[F.count_if(F.col("state") == s).alias(s) for s in names])
    both = ours.unionByName(theirs, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def errors_preview(shards: DataFrame, limit: int = 5) -> DataFrame:
    return shards.filter("state = 'error'").orderBy("id").limit(limit)


def oldest_copy(files: DataFrame) -> DataFrame:
    """Adds ``oldest``: the earliest date of any copy of the same content (the own date without a hash); taken over the whole listing."""
    groups = files.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("modified").alias("oldest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return files.join(groups, "content_hash", "left").withColumn("oldest", F.coalesce("oldest", "modified"))
