"""Listing reports on cases worked out by hand."""

import csv
import glob

from pyspark.sql import functions as F

from stowage.functions import paths, values
from stowage.operators import reports as R
from stowage.sources import sinks

from .helpers import at, files, rows


def test_duplicates(spark):
    f = files(spark, [("/R/a", 100, "x", None), ("/R/b", 100, "x", None), ("/R/c", 100, "x", None), ("/R/d", 7, "y", None), ("/R/e", 9, None, None), ("/R/f", 9, None, None)])
    assert rows(R.duplicates_top(f), "copies", "size", "reclaimable", "example") == [(3, 100, 200, "/R/a")]
    assert rows(R.duplicates_total(f), "groups", "reclaimable") == [(1, 200)]
    assert rows(R.duplicates_total(f.limit(0)), "groups", "reclaimable") == [(0, 0)]


def test_ages(spark):
    f = files(spark, [("/R/a", 10, None, at(2015, 5)), ("/R/b", 20, None, at(2026, 1)), ("/R/c", 5, None, None)])
    assert rows(R.cold_by_year(f), "year", "files", "bytes") == [(2015, 1, 10), (2026, 1, 20)]
    now = at(2026, 6)
    assert rows(R.older_than(f, [5.0, 0.1], now), "years", "files", "bytes") == [(0.1, 2, 30), (5.0, 1, 10)]
    edge = files(spark, [("/R/a", 1, None, int(now - 2 * values.YEAR_SECONDS))])
    assert R.older_than(edge, [2.0], now).count() == 0  # strictly


def test_rollups(spark):
    f = files(spark, [("/R/sub/x", 5, None, None), ("/R/sub/deeper/y", 7, None, None)])
    assert rows(R.folder_rollup(f), "folder", "files", "bytes") == [("/R", 2, 12), ("/R/sub", 2, 12), ("/R/sub/deeper", 1, 7)]
    g = files(spark, [("/R/alice/x", 5, None, None), ("/R/bob/deep/y", 7, None, None), ("/R/top", 3, None, None)])
    assert rows(R.top_level(g, "/R"), "folder", "bytes") == [("/R/alice", 5), ("/R/bob", 7)]


def test_reconcile(spark):
    f = files(spark, [("/R/a", 100, None, None)])
    assert rows(R.reconcile(f, 250), "live_bytes", "reported_bytes", "residual_bytes") == [(100, 250, 150)]
    assert rows(R.reconcile(f.limit(0), 1), "live_bytes", "residual_bytes") == [(0, 1)]


def test_hotspots_and_extensions(spark):
    f = files(spark, [(f"/R/junk/{i}", 1, None, None) for i in range(10)] + [("/R/ok/big", 10_000_000, None, None)])
    assert rows(R.hotspots(f, 5, 100), "folder", "files") == [("/R/junk", 10)]
    g = files(spark, [("/R/a.tar", 1000, None, None), ("/R/c.tar", 500, None, None), ("/R/b.txt", 5, None, None), ("/R/noext", 1, None, None)])
    assert [tuple(r) for r in R.extension_profile(g).select("ext", "files", "bytes").collect()] == [("tar", 2, 1500), ("txt", 1, 5), ("(none)", 1, 1)]


def test_subtree(spark):
    f = files(spark, [("/R/Keep/a.tar", 100, None, at(2015)), ("/R/Keep/deeper/b.tar", 7, None, at(2016)), ("/R/Keeper/c.tar", 9, None, at(2017))]).withColumn("folder", F.lower("folder"))
    assert rows(R.cold_by_year(f, "/R/keep"), "year", "bytes") == [(2015, 100), (2016, 7)]
    assert rows(R.extension_profile(f, folder="/R/Keep/"), "ext", "files", "bytes") == [("tar", 2, 107)]


def test_subtree_reaches_the_scan(spark, tmp_path):
    files(spark, [("/r/a/x", 1, None, None)]).write.parquet(f"{tmp_path}/f")
    df = spark.read.parquet(f"{tmp_path}/f").filter(paths.in_subtree(F.col("folder"), "/R/A")).select("size")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(folder,/r/a)" in plan and "ReadSchema: struct<folder:string,size:bigint>" in plan


def test_top_k_plan(spark):
    plan = R.duplicates_top(files(spark, [("/R/a", 1, "x", None)]))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_export(spark, tmp_path):
    f = files(spark, [('/R/we, "they"/a', 1, "x", at(2020)), ("/R/b", 1, "x", None)])
    sinks.export_listing(f, str(tmp_path))
    with open(glob.glob(f"{tmp_path}/top_dirs/part*.csv")[0], newline="") as g:
        told = list(csv.DictReader(g))
    assert {r["folder"] for r in told} == {"/R", '/R/we, "they"'}


def test_path_functions(spark):
    df = spark.createDataFrame([("/a/b/c.TAR",), ("x",), (".hidden",), ("end.",), ("a.b.verylongextension",), ("n.é",)], "p string")
    got = df.select("p", paths.extension(paths.basename(F.col("p"))).alias("e"), paths.raw_extension(paths.basename(F.col("p"))).alias("r"), paths.depth(F.col("p")).alias("d"), paths.parent(F.col("p")).alias("u"), paths.ancestors(F.col("p")).alias("a")).collect()
    assert [(r["e"], r["r"], r["d"], r["u"]) for r in got] == [("tar", "TAR", 3, "/a/b"), ("", "", 0, ""), ("", "hidden", 0, ""), ("", "", 0, ""), ("", "verylongextension", 0, ""), ("é", "é", 0, "")]
    assert got[0]["a"] == ["/a", "/a/b", "/a/b/c.TAR"] and got[1]["a"] == ["x"]
    assert [paths.suffix_text(v, 2, n) for v, n in ((0, False), (675, False), (7, True))] == ["aa", "zz", "07"]


def test_value_functions(spark):
    df = spark.createDataFrame([("2024-02-29T12:00:00Z", "ab" * 32), ("bad", "zz"), (None, None)], "s string, h string")
    got = df.select(values.epoch(F.col("s")).alias("e"), values.hash_bytes(F.col("h")).alias("b")).collect()
    assert got[0]["e"] == at(2024, 2, 29) + 43200 and bytes(got[0]["b"]) == bytes.fromhex("ab" * 32)
    assert got[1]["e"] is got[1]["b"] is got[2]["e"] is got[2]["b"] is None
    import hashlib

    data = bytes(range(256)) * 40
    want = hashlib.sha256(b"".join(hashlib.sha256(data[i : i + 1000]).digest() for i in range(0, len(data), 1000))).hexdigest()
    made = spark.createDataFrame([(data,), (b"",)], "c binary").select(values.block_hash(F.col("c"), 1000).alias("h")).collect()
    assert [r["h"] for r in made] == [want, hashlib.sha256(b"").hexdigest()]
    modes = spark.createDataFrame([(420,), (0o100644,), (7,)], "m long").select(values.octal_mode(F.col("m")).alias("o")).collect()
    assert [r["o"] for r in modes] == ["0644", "100644", "0007"]
    assert spark.createDataFrame([(0,), (1,), (512,), (513,)], "n long").select(values.tar_padded(F.col("n")).alias("p")).toPandas()["p"].tolist() == [0, 512, 512, 1024]
    assert [values.human_bytes(n) for n in (0, 1023, 1536, 5 << 30)] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB"]
    assert [values.parse_size(t) for t in ("12", "1.5K", "2GiB", "3 MB", "7B")] == [12, 1536, 2 << 30, 3 << 20, 7]
    assert [values.human_duration(s) for s in (5, 65, 3725, 90000)] == ["5s", "1m 5s", "1h 2m", "1d 1h"]
    heads = spark.createDataFrame([(bytes.fromhex("1f8b08"),), (b"plain",)], "b binary").select(values.compression(F.col("b")).alias("c")).collect()
    assert [r["c"] for r in heads] == ["gzip", None]
