"""Helpers that the corpus operators share: durable intermediate tables, connected components, held-out rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (master ``local``) gets a folder of its own; on a cluster that
    folder would be some machine's, so the call is refused.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {sc.master} share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="stowage-"))
    return sc.getCheckpointDir()


def _at(spark: SparkSession, path: str):
    """A path of the shared folder, and its file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that survives lost executors; it goes by :func:`discard`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stowage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, store = _at(spark, path)
    store.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    at, store = _at(table.sparkSession, table.stored_at)
    store.delete(at, True)


def held_out(key: Column) -> Column:
    """True where crc32 of the key as text is divisible by 5 (a missing key: as empty text): such rows teach nothing."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(u long, v long)`` as ``(id, component)``; component: its smallest id.

    Alternating stars (Kiveris et al., 2014): a large star moves each vertex's larger neighbours to its smallest
    one, a small star its smaller neighbours, until every vertex hangs on its component's smallest; a chain of n
    vertices takes about log2 n rounds.  Each round stores its edges and deletes the round before.  Only minima (combined
    before the shuffle) and equi-joins (which AQE splits if a vertex is hot) are used.  Self-loops, repeated edges and an empty
    table are fine; vertices that occur only in self-loops are not returned.
    """
    # a: the larger end of an edge, b: the smaller one
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    mark = None
    while True:
        # the same edges as a round before: nothing moves any more
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(found) or not found[0]:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        mark = tuple(found)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(before)
