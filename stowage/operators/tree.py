"""Aggregation over a folder tree.

Folders are paths.  A figure is summed per folder first and only then spread to the folder's ancestors, so the
exploded side has a row per folder and level, not one per file; partial aggregation keeps the root from being a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def spread_up(per_folder: DataFrame, folder: str = "folder", to: str = "ancestor") -> DataFrame:
    """Each row once for its folder and each folder above it."""
    return per_folder.withColumn(to, F.explode(paths.ancestors(F.col(folder))))


def rollup(per_folder: DataFrame, sums: list[str], *, maxima: list[str] = (), folder: str = "folder") -> DataFrame:
    """Sums (and maxima) of each folder with all below it."""
    up = spread_up(per_folder, folder, "_at")
    aggregates = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    return up.groupBy(F.col("_at").alias(folder)).agg(*aggregates)


def per_folder(files: DataFrame, *aggregates: Column, folder: str = "folder") -> DataFrame:
    return files.groupBy(folder).agg(*aggregates)


def folders_of(files: DataFrame, folder: str = "folder") -> DataFrame:
    """All folders that hold a file or a folder: path, parent and depth."""
    found = files.select(folder).distinct().select(F.explode(paths.ancestors(F.col(folder))).alias("folder")).distinct()
    return found.select("folder", paths.parent(F.col("folder")).alias("parent"), paths.depth(F.col("folder")).alias("depth"))


def nearest_shown(rows: DataFrame, shown: DataFrame, *, folder: str = "folder") -> DataFrame:
    """Adds ``shown``: the deepest folder of ``shown(folder)`` that is the row's folder or above it; rows without one go."""
    folders = rows.select(folder).distinct()
    found = (
        spread_up(folders, folder, "_at").join(shown.select(F.col("folder").alias("_at")).distinct(), "_at", "left_semi")
        .groupBy(folder).agg(F.max_by("_at", F.length("_at")).alias("shown"))
    )
    return rows.join(found, folder)
