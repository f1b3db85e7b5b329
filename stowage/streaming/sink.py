"""Exactly-once ingestion of listing pages: a batch is written under its own number, and a replay overwrites it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import ingest
from . import shards


def write_batch(root: str, shard_path: str = ""):
    """A foreachBatch function: files, folders and events of batch N replace whatever a failed try of batch N left."""

    def write(entries: DataFrame, batch: int) -> None:
        entries.persist()
        try:
            for name, df in ingest.sort_out(entries, shard_path).items():
                df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
        finally:
            entries.unpersist()

    return write


def ingest_stream(entries: DataFrame, root: str, checkpoint: str, shard_path: str = "", once: bool = True, fresh: bool = False) -> StreamingQuery:
    """Start the ingestion of a stream of entries; ``once``: of all that is there, then stop.  Restarting with the same checkpoint resumes.

    ``fresh``: pages that come again in a later batch are dropped by state (to be started within ``shards.with_rocksdb``).
    """
    entries = shards.fresh(entries) if fresh else entries
    writer = entries.writeStream.foreachBatch(write_batch(root, shard_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


TABLES = ("files", "folders", "events")


def last_batch(spark: SparkSession, root: str) -> int:
    """Number of the last batch that all three tables have finished; -1 if there is none.

    Batches come in order, so all before it are finished too.  A batch that is being written anew after a failure is not finished.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = []
    for name in TABLES:
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/batch=*/_SUCCESS")
        found = at.getFileSystem(conf).globStatus(at) or []
        done.append(max((int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found), default=-1))
    return min(done)


def _commits(spark: SparkSession, root: str) -> list[int]:
    """Last batches of the finished snapshots, ascending."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots/upto=*/_COMMITTED")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("upto=")) for f in found)


def _stored(spark: SparkSession, root: str, last: int) -> dict[str, DataFrame]:
    """Rows of each table: of the newest snapshot and of the batches after it, up to ``last``; with their batch."""
    upto = max((n for n in _commits(spark, root) if n <= last), default=-1)
    out = {}
    for name in TABLES:
        snapshot = spark.read.parquet(f"{root}/snapshots/upto={upto}/{name}") if upto >= 0 else None
        later = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}").filter((F.col("batch") <= last) & (F.col("batch") > upto)) if last > upto else None
        both = [df for df in (snapshot, later) if df is not None]
        out[name] = both[0] if len(both) == 1 else both[0].unionByName(both[1].select(both[0].columns))
    return out


def _latest(files: DataFrame) -> DataFrame:
    """The last row of each id with the first ``downloadable``, and the place (batch, seq) of that last row."""
    return ingest.upsert(files.withColumn("order", F.struct("batch", "seq")), None, "id", "order").drop("order")


def read_catalog(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The catalog as of the last batch that all tables have finished, so that they agree while a later one is being written.

    The last entry of each id wins, folders are derived, events are all kept.  What a snapshot (see :func:`compact`) holds is not
    read from its batches again; later ones are merged with it.
    """
    last = max(last_batch(spark, root), max(_commits(spark, root), default=-1))
    if last < 0:
        raise FileNotFoundError(f"{root}: no batch is finished (finished ones have a file _SUCCESS in each of {', '.join(TABLES)})")
    stored = _stored(spark, root, last)
    files = _latest(stored["files"]).drop("batch")
    return {"files": files, "folders": ingest.derive_folders(files, stored["folders"]), "events": stored["events"]}


def compact(spark: SparkSession, root: str, remove: bool = False) -> int:
    """Write a snapshot of all finished batches, and return the last of them.

    Readers take a snapshot once its mark is there, which is made after all its tables; one that was cut off is written anew.
    A batch in a snapshot may be replayed, as that changes nothing that is read.  ``remove``: batches in it, and snapshots
    before the last but one, are then deleted; a reader that has begun with an earlier snapshot can finish with that one.
    """
    last, done = last_batch(spark, root), _commits(spark, root)
    if last < 0 or last in done:
        return max(done, default=-1)
    stored = _stored(spark, root, last)
    order = F.struct("batch", "seq")
    named = stored["folders"].groupBy("folder").agg(F.max_by(F.struct(*[c for c in stored["folders"].columns if c != "folder"]), order).alias("l"))
    tables = {"files": _latest(stored["files"]), "folders": named.select("folder", "l.*"), "events": stored["events"]}
    at = f"{root}/snapshots/upto={last}"
    for name, df in tables.items():
        df.select(stored[name].columns).write.mode("overwrite").parquet(f"{at}/{name}")
    jvm = spark.sparkContext._jvm
    store = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.create(jvm.org.apache.hadoop.fs.Path(f"{at}/_COMMITTED")).close()
    if remove:
        batches = [f.getPath() for name in TABLES for f in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/batch=*")) or [] if int(f.getPath().getName().removeprefix("batch=")) <= last]
        for path in [*batches, *(jvm.org.apache.hadoop.fs.Path(f"{root}/snapshots/upto={n}") for n in done[:-1])]:
            store.delete(path, True)
    return last
