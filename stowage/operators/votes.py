"""Votes over repeated reads of the same ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(reads: DataFrame, keys: list[str], tries: int = 6, lead: int = 2, *, attempt: str = "attempt", digest: str = "digest") -> DataFrame:
    """(keys, digest, attempts, versions): the version that is first to lead every other by ``lead`` votes, and the reads that took.

    The first read and ``tries`` further ones count, in order of ``attempt``; where none leads by then, digest is null and attempts is
    the number of reads there are.  A range has ``tries`` + 1 rows at most once Spark has ranked them (before the shuffle, so a range
    with very many reads sends few).  A read without a digest counts as an attempt only.
    """
    order = Window.partitionBy(*keys).orderBy(attempt)
    rows = reads.select(*keys, F.col(digest).alias("d"), F.row_number().over(order).alias("n")).filter(F.col("n") <= tries + 1)
    told = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("n", "d"))).alias("reads"))
    none = F.struct(F.create_map().cast("map<string,int>").alias("votes"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("int").alias("at"))

    def count(s, r):
        # only the version just read can gain the lead
        others = F.map_filter(s["votes"], lambda k, _: k != r["d"])
        own = F.coalesce(F.try_element_at(s["votes"], r["d"]), F.lit(0)) + 1
        ahead = own - F.coalesce(F.array_max(F.map_values(others)), F.lit(0)) >= lead
        won = s["digest"].isNull() & ahead
        after = F.struct(
            F.map_concat(others, F.create_map(r["d"], own)).alias("votes"), F.when(won, r["d"]).otherwise(s["digest"]).alias("digest"), F.when(won, r["n"]).otherwise(s["at"]).alias("at")
        )
        return F.when(r["d"].isNull() | s["digest"].isNotNull(), s).otherwise(after)

    done = told.withColumn("s", F.aggregate("reads", none, count))
    return done.select(*keys, F.col("s.digest").alias("digest"), F.coalesce("s.at", F.size("reads")).cast("int").alias("attempts"), F.size("s.votes").cast("int").alias("versions"))
