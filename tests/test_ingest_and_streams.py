"""Ingestion from pages, exactly once, and event queries over streams and tables."""

import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from stowage import cli
from stowage.operators import ingest
from stowage.sources import listing
from stowage.streaming import events, sink

from .helpers import rows

H = "ab" * 32


def entry(tag="file", **kw):
    return {".tag": tag, "client_modified": "2024-01-01T00:00:00Z", "is_downloadable": True, **kw}


def pages(folder, made):
    for i, entries in enumerate(made):
        (folder / f"{i:08d}.json").write_text(json.dumps({"entries": entries, "cursor": str(i), "has_more": i + 1 < len(made)}))


MADE = [
    [entry("folder", id="d1", name="Sub", path_display="/R/Sub"), entry(id="f1", name="a.txt", path_display="/R/Sub/a.txt", size=5, content_hash=H), entry(id="f2", name="b", path_display="/R/Other/deep/b", size=7, content_hash="zz")],
    [entry(id="f1", name="a2.txt", path_display="/R/Sub/a2.txt", size=6, content_hash=H, is_downloadable=False), entry("deleted", name="gone", path_display="/R/gone"), entry(id="f3", name="lost", size=1)],
]


def ingested(spark, tmp_path, made):
    (tmp_path / "pages").mkdir(exist_ok=True)
    pages(tmp_path / "pages", made)
    listing.register(spark)
    stream = spark.readStream.format("listing_pages").option("path", str(tmp_path / "pages")).load()
    q = sink.ingest_stream(stream, f"{tmp_path}/catalog", f"{tmp_path}/ck", "/R", once=False)
    q.processAllAvailable()
    q.stop()
    return sink.read_catalog(spark, f"{tmp_path}/catalog")


def test_pages_become_a_catalog(spark, tmp_path):
    c = ingested(spark, tmp_path, MADE)
    assert rows(c["files"], "id", "folder", "name", "size", "downloadable") == [("f1", "/R/Sub", "a2.txt", 6, True), ("f2", "/R/Other/deep", "b", 7, True), ("f3", "/R", "lost", 1, True)]
    assert [tuple(r) for r in c["folders"].orderBy("folder").select("folder", "id").collect()] == [("/R", None), ("/R/Other", None), ("/R/Other/deep", None), ("/R/Sub", "d1")]
    assert rows(c["events"], "kind") == [("bad_hash",), ("deleted",), ("no_path",)]
    # more pages: goes on from the last one, and nothing comes twice
    c = ingested(spark, tmp_path, [*MADE, [entry(id="f4", name="z", path_display="/R/z", size=9)]])
    assert [r[0] for r in rows(c["files"], "id")] == ["f1", "f2", "f3", "f4"]
    assert c["events"].count() == 3


def test_replayed_batch(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    pages(tmp_path / "pages", MADE)
    batch = listing.read_pages(spark, str(tmp_path / "pages"))
    write = sink.write_batch(f"{tmp_path}/c", "/R")
    for _ in range(3):
        write(batch, 0)
    c = sink.read_catalog(spark, f"{tmp_path}/c")
    assert c["files"].count() == 3 and c["events"].count() == 3


def test_reads_end_at_the_last_finished_batch(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    pages(tmp_path / "pages", MADE)
    batch = listing.read_pages(spark, str(tmp_path / "pages"))
    write = sink.write_batch(f"{tmp_path}/c", "/R")
    write(batch, 0)
    write(batch, 1)
    assert sink.last_batch(spark, f"{tmp_path}/c") == 1
    # as if batch 1 were still being written: its files are there, its events are not finished
    (tmp_path / "c/events/batch=1/_SUCCESS").unlink()
    c = sink.read_catalog(spark, f"{tmp_path}/c")
    assert sink.last_batch(spark, f"{tmp_path}/c") == 0 and c["files"].count() == 3 and c["events"].count() == 3
    for mark in (tmp_path / "c").glob("*/batch=0/_SUCCESS"):
        mark.unlink()
    with pytest.raises(FileNotFoundError):
        sink.read_catalog(spark, f"{tmp_path}/c")


def test_restate_keeps_other_shards(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "shard_id long, id string")
    assert rows(ingest.restate(f, spark.createDataFrame([(1,)], "shard_id long")), "id") == [("b",)]


def test_answers():
    kind = lambda *a: type(listing.classify_answer(*a)).__name__
    assert [kind(200, ""), kind(429, "", "7"), kind(401, ""), kind(409, "reset/"), kind(409, "path/not_found/"), kind(503, ""), kind(418, "")] == ["NoneType", "Retry", "Refused", "Reset", "Gone", "Retry", "ListingError"]
    assert listing.classify_answer(429, "", "7").seconds == 7


def test_second_listing(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"Path": "a/b", "Size": 3}, {"Path": "c", "Size": 4}]))
    assert rows(listing.read_second_listing(spark, str(tmp_path / "l.json")), "path", "size") == [("a/b", 3), ("c", 4)]


def stream_of(spark, tmp_path, df, name):
    df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")


def drained(spark, stream, name, mode="complete"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_tables(spark, tmp_path):
    e = spark.range(400).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97)).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), (F.col("id") % 5).alias("user_id"))
    s = stream_of(spark, tmp_path, e, "e")
    for length, slide in (("1 hour", None), ("1 hour", "20 minutes")):
        got = drained(spark, events.windowed_counts(s, length, slide), f"w{slide is None}")
        assert rows(got, *got.columns) == rows(events.windowed_counts(e, length, slide), *got.columns)
    got = drained(spark, events.sessions(s, "7 minutes"), "sess")
    assert rows(got, *got.columns) == rows(events.sessions(e, "7 minutes"), *got.columns)


def test_overloads(spark, tmp_path):
    data = [("a", 0.0, 5.0), ("a", 3.0, 5.0), ("a", 7.9, 0.0), ("a", 8.5, 0.0), ("a", 9.2, 0.0), ("a", 9.6, 0.0), ("b", 1.0, 0.0)]
    s = stream_of(spark, tmp_path, spark.createDataFrame(data, "source string, ts double, retry_after double"), "o")
    got = drained(spark, events.overloads(s), "over", "append")
    assert rows(got, "source", "overload", "ts") == [("a", 1, 0.0), ("a", 2, 8.5), ("a", 3, 9.6), ("b", 1, 1.0)]


def test_last_hour(spark):
    e = spark.createDataFrame([(100.0, "r"), (3701.0, "r"), (3701.0, "q"), (100.1, "r")], "ts double, kind string")
    assert rows(events.last_hour(e, "r", 3700.0), "n") == [(2,)]


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "pages").mkdir()
    pages(tmp_path / "pages", MADE)
    cat = f"{tmp_path}/cat"
    run = lambda *a: cli.main(list(a), spark)
    assert run("run", cat, "--pages", str(tmp_path / "pages"), "--shard-path", "/R") == 0
    assert run("status", cat) == 0 and run("report", cat) == 0 and run("kinds", cat, "--as-of", "1800000000") == 0
    assert run("tree", cat, "--root", "/R/", "--out", f"{tmp_path}/t.html", "--min-size", "1") == 0
    assert run("export", cat, "--out", f"{tmp_path}/csv") == 0
    assert run("sql", cat, "select sum(size) as s from files") == 0
    assert "14" in capsys.readouterr().out
    (tmp_path / "l.json").write_text(json.dumps([{"Path": "Sub/a2.txt", "Size": 6}]))
    assert run("verify", cat, "--other", str(tmp_path / "l.json"), "--under", "/R") == 1
    assert run("kinds", cat, "--rules", f"{tmp_path}/none.toml") == 2


def test_archive_commands(spark, tmp_path, capsys):
    from .test_archives import build

    names, _ = build(tmp_path, [(f"d/f{i}", bytes([i]) * 900) for i in range(9)], 5000)
    run = lambda *a: cli.main(list(a), spark)
    arch, glob_ = f"{tmp_path}/arch", f"{tmp_path}/a.tar.*"
    assert run("archive-index", arch, "--parts", glob_, "--name", "a.tar", "--hash") == 0
    assert run("archive-index", arch, "--parts", f"{tmp_path}/none*", "--name", "a.tar") == 2
    assert spark.read.parquet(f"{arch}/members").count() == 9
    assert run("archive-status", arch) == 0 and run("archive-report", arch, "--id", "1") == 0
    assert run("archive-cat", arch, "--id", "1", "--parts", glob_, "--out", f"{tmp_path}/x", "d/f4") == 0
    assert open(f"{tmp_path}/x", "rb").read() == bytes([4]) * 900
    assert run("archive-cat", arch, "--id", "1", "--parts", glob_, "--out", f"{tmp_path}/x", "d/none") == 1
    assert run("archive-forget", arch, "--id", "1", "--out", f"{tmp_path}/arch2") == 0
    assert spark.read.parquet(f"{tmp_path}/arch2/members").count() == 0


def test_everything_else_works_without_the_corpus_operators():
    code = "import sys\nclass No:\n def find_spec(self, name, path=None, target=None):\n  if name.startswith('stowage.llm') or name == 'corpus_pipeline': raise ImportError(name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'folder_rollup' in e.queries() and not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


def test_overloads_of_a_table_against_a_loop(spark):
    """Pauses of less than a second, long ones, ties, and a source that holds most rows and seldom pauses."""
    r = random.Random(0)
    data = []
    for source, n, step in (("hot", 4000, 0.4), ("calm", 300, 20.0), ("burst", 300, 0.01)):
        t = 0.0
        for _ in range(n):
            t += r.choice([0.0, r.random() * step, step, 30 * step if r.random() < 0.02 else 0.0])
            data.append((source, t, r.choice([0.0, 0.3, 1.0, 2.5, 5.0])))
    want = []
    for source in ("hot", "calm", "burst"):
        until, k = float("-inf"), 0
        for _, t, retry in sorted(d for d in data if d[0] == source):
            if t >= until:
                k += 1
                want.append((source, k, t))
                until = t + max(retry, 1.0)
            else:
                until = max(until, t + retry)
    r.shuffle(data)
    df = spark.createDataFrame(data, "source string, ts double, retry_after double")
    for width in (3600.0, 25.0, 1.0):
        assert rows(events.overloads_of(df, width), "source", "overload", "ts") == sorted(want)
    assert events.overloads_of(df.limit(0)).count() == 0


def test_rates_in_stretches(spark):
    r = random.Random(1)
    ticks = [(run, t, r.randrange(1000)) for run, n in (("hot", 500), ("b", 5), ("c", 1)) for t in sorted(r.randrange(3000) for _ in range(n))]
    df = spark.createDataFrame(ticks, "run string, ts_s long, files long")
    want = []
    for run in ("hot", "b", "c"):
        own = sorted((t, f) for k, t, f in ticks if k == run)
        want += [(run, *own[i], (own[i][1] - own[i - 1][1]) / (own[i][0] - own[i - 1][0]) if i and own[i][0] > own[i - 1][0] else None) for i in range(len(own))]
    for width in (86400, 100, 7):
        assert sorted(map(str, rows2(events.rates(df, width=width)))) == sorted(map(str, want))


def rows2(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("remove", [False, True])
def test_compaction(spark, tmp_path, remove):
    """A catalog reads the same before and after its batches are put together, and goes on from there."""
    r = random.Random(2)
    write, c = sink.write_batch(f"{tmp_path}/c", "/R"), f"{tmp_path}/c"
    (tmp_path / "p").mkdir()

    def batch(n):
        made = [entry(id=f"f{r.randrange(12)}", name=f"n{n}", path_display=f"/R/{r.choice('ab')}/n{n}", size=n, is_downloadable=bool(r.randrange(2))) for _ in range(6)]
        made += [entry("folder", id=f"d{n % 3}", name="a", path_display=f"/R/{'ab'[n % 2]}"), entry("deleted", name="x", path_display=f"/R/x{n}")]
        (tmp_path / "p" / f"{n:08d}.json").write_text(json.dumps({"entries": made}))
        write(listing.read_pages(spark, f"{tmp_path}/p/{n:08d}.json"), n)
        return made

    def told():
        return {name: sorted(map(str, df.drop("batch", "shard_id").collect())) for name, df in sink.read_catalog(spark, c).items()}

    made = [batch(n) for n in range(3)]
    first = {}
    for b in made:
        for e in b:
            if e[".tag"] == "file":
                first.setdefault(e["id"], e["is_downloadable"])
    before = told()
    assert sink.compact(spark, c, remove) == 2 and sink.compact(spark, c, remove) == 2
    assert told() == before and dict(rows(sink.read_catalog(spark, c)["files"], "id", "downloadable")) == first
    assert len(list((tmp_path / "c/files").glob("batch=*"))) == (0 if remove else 3)
    files_read = sink.read_catalog(spark, c)["files"].inputFiles()
    assert all("snapshots" in f for f in files_read)
    # later batches are merged with the snapshot; the one that was compacted last may be replayed
    if not remove:
        write(listing.read_pages(spark, f"{tmp_path}/p/{2:08d}.json"), 2)
    for n in (3, 4):
        made.append(batch(n))
    for e in made[3] + made[4]:
        if e[".tag"] == "file":
            first.setdefault(e["id"], e["is_downloadable"])
    whole = told()
    assert dict(rows(sink.read_catalog(spark, c)["files"], "id", "downloadable")) == first
    last = {e["id"]: e["name"] for b in made for e in b if e[".tag"] == "file"}
    assert dict(rows(sink.read_catalog(spark, c)["files"], "id", "name")) == last and len(whole["events"]) == 5
    # a snapshot that was cut off is not read
    assert sink.compact(spark, c, remove) == 4
    (tmp_path / "c/snapshots/upto=4/_COMMITTED").unlink()
    if not remove:
        assert told() == whole
    assert cli.main(["compact", c, *(["--remove"] if remove else [])], spark) == 0


def test_run_indexes_all_candidates_of_a_listing(spark, tmp_path, capsys):
    """Every archive that a listing holds, once, largest first; a second run finds nothing to do, a new archive is taken up."""
    import hashlib

    from .test_archives import build

    listed = []

    def add(folder, members, part, **kw):
        at = tmp_path / "base" / folder
        at.mkdir(parents=True)
        for path in build(at, members, part, **kw)[0]:
            data = open(path, "rb").read()
            listed.append(entry(id=path, name=path.rsplit("/", 1)[1], path_display=f"/{folder}/{path.rsplit('/', 1)[1]}", size=len(data), content_hash=hashlib.sha256(data).hexdigest()))

    def ingest_all(n):
        (tmp_path / "p").mkdir(exist_ok=True)
        (tmp_path / "p" / f"{n:08d}.json").write_text(json.dumps({"entries": listed}))
        sink.write_batch(f"{tmp_path}/c", "/")(listing.read_pages(spark, f"{tmp_path}/p/{n:08d}.json"), n)

    add("x", [(f"d/f{i}", bytes([i]) * 900) for i in range(9)], 5000)
    add("copy", [(f"d/f{i}", bytes([i]) * 900) for i in range(9)], 5000)
    add("y", [("big", bytes(30_000))], 20_000)
    ingest_all(0)
    run = lambda *a: cli.main(["archive-run", f"{tmp_path}/c", f"{tmp_path}/arch", "--base", f"{tmp_path}/base", *a], spark)
    assert run("--limit", "1") == 0
    assert rows(spark.read.parquet(f"{tmp_path}/arch/archives"), "id", "folder", "name", "state") == [(1, "/y", "a.tar", "complete")]
    assert run() == 0 and run() == 0
    told = capsys.readouterr().out
    assert "done\t1" in told and "copy\t1" in told and "done\t2" in told
    assert rows(spark.read.parquet(f"{tmp_path}/arch/archives"), "id", "folder") == [(1, "/y"), (2, "/copy")]
    assert spark.read.parquet(f"{tmp_path}/arch/members").groupBy("archive_id").count().orderBy("archive_id").collect() == [(1, 1), (2, 9)]
    add("z", [("f", bytes(3000))], 100_000, cut=2000)
    ingest_all(1)
    assert run() == 1
    assert rows(spark.read.parquet(f"{tmp_path}/arch/archives"), "id", "folder", "state")[2] == (3, "/z", "truncated")
    # a part that is no longer what the listing says
    add("v", [("f", bytes(3000))], 100_000)
    listed[-1]["size"] += 1
    ingest_all(2)
    assert run() == 1 and rows(spark.read.parquet(f"{tmp_path}/arch/archives"), "id", "folder", "state")[3] == (4, "/v", "stale")
    # the catalog can be imported into itself: equal archives replace each other
    assert cli.main(["archive-import", f"{tmp_path}/arch", "--other", f"{tmp_path}/arch", "--out", f"{tmp_path}/both"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/both/archives").count() == 4
    assert cli.main(["archive-run", f"{tmp_path}/c", f"{tmp_path}/other", "--base", f"{tmp_path}/nowhere"], spark) == 2


def test_catalogs_that_are_none_are_refused(spark, tmp_path, capsys):
    assert cli.main(["archive-verify", f"{tmp_path}/none", "--id", "1", "--parts", "x"], spark) == 2
    assert "holds no archive index" in capsys.readouterr().err
    for name in ("archives", "parts", "segments", "members"):
        spark.createDataFrame([(1,)], "id long").write.parquet(f"{tmp_path}/c/{name}")
    assert cli.main(["archive-verify", f"{tmp_path}/c", "--id", "1", "--parts", "x"], spark) == 2
    assert "has no column folder, name, state, total_size" in capsys.readouterr().err
