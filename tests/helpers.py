"""Small listings and archives for tests."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from stowage.functions import paths

FILES = "id string, folder string, name string, size long, content_hash string, modified long"


def at(year, month=1, day=1):
    return int(datetime(year, month, day, tzinfo=UTC).timestamp())


def files(spark, rows):
    """(path, size, content or None, modified or None)"""
    made = [(str(i), *p.rpartition("/")[::2], size, content, modified) for i, (p, size, content, modified) in enumerate(rows)]
    return spark.createDataFrame(made, FILES).withColumn("ext", paths.extension(F.col("name")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
