"""Whole catalogs: comparing listings and snapshots, importing one index into another, forgetting, keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def verify_listing(ours: DataFrame, theirs: DataFrame, under: str = "") -> DataFrame:
    """(path, status, our_size, their_size) of every difference: missing there, missing here, or of another size.

    ours: files(folder, name, size); theirs: (path, size) relative to ``under``.  Paths that repeat collapse first, as a listing is keyed by path.
    """
    full = paths.full_path(F.col("folder"), F.col("name"))
    inside = ours.filter(paths.in_subtree(F.lower("folder"), under)) if under else ours
    left = inside.select(paths.below(full, under).alias("path"), F.col("size").alias("our_size")).groupBy("path").agg(F.max("our_size").alias("our_size"))
    right = theirs.groupBy("path").agg(F.max("size").alias("their_size"))
    both = left.join(right, "path", "full_outer")
    status = F.when(F.col("their_size").isNull(), "missing there").when(F.col("our_size").isNull(), "missing here").when(F.col("our_size") != F.col("their_size"), "size differs")
    return both.withColumn("status", status).filter("status is not null").select("path", "status", "our_size", "their_size")


def verify_counts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Rows in either, in both, and in both with another size."""
    both = ours.select("path", F.col("size").alias("a")).join(theirs.select("path", F.col("size").alias("b")), "path", "full_outer")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(F.count_if(a & ~b).alias("only_ours"), F.count_if(b & ~a).alias("only_theirs"), F.count_if(a & b).alias("in_both"), F.count_if(a & b & (F.col("a") != F.col("b"))).alias("size_differs"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, change, old_path, new_path): what was added, removed, moved or changed between two snapshots of (key, path, size, content_hash)."""
    a = old.select(key, F.col("path").alias("old_path"), F.struct("size", "content_hash").alias("a"))
    b = new.select(key, F.col("path").alias("new_path"), F.struct("size", "content_hash").alias("b"))
    both = a.join(b, key, "full_outer")
    moved, changed = F.col("old_path") != F.col("new_path"), ~F.col("a").eqNullSafe(F.col("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(moved & changed, "moved and changed").when(moved, "moved").when(changed, "changed")
    return both.select(key, change.alias("change"), "old_path", "new_path").filter("change is not null")


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Equal names and types in equal order."""
    return [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]


def rows_not_in(rows: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without an equal one (nulls equal nulls) in ``other``, by ``columns``."""
    pairs = [F.struct(*columns).alias("_k")]
    mine = rows.withColumn("_k", pairs[0])
    theirs = other.select(pairs[0]).distinct()
    return mine.join(theirs, mine["_k"].eqNullSafe(theirs["_k"]), "left_anti").drop("_k")


def forget(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The archive catalog's tables without the archives of ``ids(archive_id)``."""
    return {name: t.join(ids.select(F.col("archive_id").alias("id")), "id", "left_anti") if name == "archives" else t.join(ids.select("archive_id"), "archive_id", "left_anti") for name, t in tables.items()}


def import_catalog(mine: dict[str, DataFrame], theirs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One archive catalog with another's archives added; where both have the same parts (set_hash), theirs replaces mine.

    Imported archives get new ids above all of mine, in the order of theirs; of the registrations of a name and folder all but the latest live one become stale.
    """
    from .archives import mark_superseded

    for name in mine:
        if not same_schema(mine[name], theirs[name]):
            raise ValueError(f"the catalogs' tables {name} differ")
    replaced = mine["archives"].join(theirs["archives"].select("set_hash"), "set_hash", "left_semi").select(F.col("id").alias("archive_id"))
    kept = forget(mine, replaced)
    shift = mine["archives"].agg(F.coalesce(F.max("id"), F.lit(0)).alias("shift"))
    out = {}
    for name, t in theirs.items():
        key = "id" if name == "archives" else "archive_id"
        moved = t.withColumn(key, F.col(key) + shift.scalar()).select(*mine[name].columns)
        out[name] = kept[name].select(*mine[name].columns).unionByName(moved)
    out["archives"] = mark_superseded(out["archives"])
    return out


def lookup(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows with any of the wanted keys; Spark broadcasts the keys if they are few."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def find_folder(folders: DataFrame, path: str) -> DataFrame:
    """A folder by its path, without case or slashes at the end."""
    return folders.filter(F.lower(paths.trimmed(F.col("folder"))) == path.rstrip("/").lower())


def missing_partner(rows: DataFrame, others: DataFrame, on: str) -> DataFrame:
    return rows.join(others.select(on).distinct(), on, "left_anti")


def dimension(values: DataFrame, column: str, known: DataFrame | None = None, pieces: int = 256) -> DataFrame:
    """Surrogate keys (id, value) of a column's values: those known keep theirs, new ones get the next numbers without gaps.

    New values are ranked in hash pieces whose sizes give the offsets, so no task ranks them all.
    """
    new = values.select(F.col(column).alias("value")).filter("value is not null").distinct()
    last = values.sparkSession.range(1).select(F.lit(0).cast("long").alias("last"))
    if known is not None:
        new = new.join(known.select("value"), "value", "left_anti")
        last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = new.withColumn("piece", F.pmod(F.xxhash64("value"), F.lit(pieces)))
    sizes = new.groupBy("piece").agg(F.count("*").alias("n"))
    before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # at most ``pieces`` rows
    offsets = sizes.select("piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("piece").orderBy("value"))
    fresh = new.withColumn("nth", nth).join(F.broadcast(offsets), "piece")
    fresh = fresh.select((last.scalar() + F.col("offset") + F.col("nth")).cast("long").alias("id"), "value")
    return fresh if known is None else known.select("id", "value").unionByName(fresh)


def hash_key(column: Column) -> Column:
    """A surrogate key without any ordering, for dimensions too large to number."""
    return F.xxhash64(column)
