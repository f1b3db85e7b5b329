"""A listing's state in streams, against plain loops; every stream is stopped in the middle and started again."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stowage.operators import ingest
from stowage.sources import listing
from stowage.streaming import shards, sink

from .helpers import rows

ANSWERS = "shard string, seq long, status int, body string, retry_after string, has_more boolean, ts timestamp"
START = datetime(2024, 1, 1, tzinfo=UTC)
MORE, LAST, BUSY, RESET, GONE, FAIL, AUTH, ODD = (200, "", True), (200, "", False), (429, "", True), (409, "reset/..", True), (409, "path/not_found/.", True), (500, "oops", True), (401, "expired", True), (418, "", True)


def in_parts(spark, tmp_path, name, data, schema, run, cuts):
    """Writes data in several files; the stream is started anew for each."""
    folder, out = tmp_path / name, f"{tmp_path}/{name}-out"
    for n, part in enumerate(cuts(data)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        with shards.with_rocksdb(spark):
            q = run(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start()
            q.awaitTermination()
    return spark.read.parquet(out)


def halves(data):
    yield data[: len(data) // 2]
    yield data[len(data) // 2 :]


def answers(of):
    made = [(shard, n, status, body, "7" if status == 429 else None, more, START + timedelta(seconds=n)) for shard, told in of.items() for n, (status, body, more) in enumerate(told)]
    return sorted(made, key=lambda r: r[1])  # so that every shard is cut in the middle


def plain(told):
    """The rules in a loop of their own."""
    mode, cursor, fails, gen, state, out = "recursive", False, 0, 0, "open", []
    for n, (status, body, more) in enumerate(told):
        if state == "done":
            continue
        if state == "error":
            gen, cursor, fails, state = gen + 1, False, 0, "open"
        if status == 200:
            fails, cursor, event = 0, more, "page" if more else "last page"
            state = "open" if more else "done"
        elif status == 429:
            event = "rate_limited"
        elif status == 409 and "reset" in body:
            gen, cursor, event = gen + 1, False, "cursor_reset"
        elif status == 409:
            event, state = "path_gone", "done"
        elif status in (500, 401):
            fails += 1
            if status == 500 and mode == "recursive" and fails >= (3 if cursor else 2):
                mode, gen, cursor, fails, event = "split", gen + 1, False, 0, "split_after_failure"
            elif fails >= 3:
                event, state = "failed", "error"
            else:
                event = "transient" if status == 500 else "auth_expired"
        else:
            event, state = "failed", "error"
        out.append((n, event, mode, gen, fails))
    return out


CASES = {
    "reset": [MORE, RESET, MORE, MORE, LAST, MORE],  # a reset restates the shard
    "busy": [MORE, BUSY, BUSY, BUSY, BUSY, LAST],  # a rate limit is no failure
    "gone": [GONE, MORE],
    "split": [FAIL, FAIL, MORE, LAST],  # a full listing is split at its second failure,
    "once": [FAIL, MORE, FAIL, MORE, LAST],  # not at one,
    "late": [MORE, FAIL, FAIL, FAIL, MORE, LAST],  # and after its first page only where it would fail
    "fails": [FAIL, FAIL, FAIL, FAIL, FAIL, MORE, LAST],  # one level fails too, and the next answer starts over
    "auth": [MORE, AUTH, AUTH, AUTH, MORE, LAST],
    "odd": [MORE, ODD, MORE, LAST],
}


def test_shards_follow_the_rules(spark, tmp_path):
    r = random.Random(0)
    of = CASES | {f"r{i}": [r.choice([MORE, MORE, MORE, LAST, BUSY, RESET, GONE, FAIL, FAIL, FAIL, AUTH, ODD]) for _ in range(r.randrange(1, 25))] for i in range(60)}
    log = in_parts(spark, tmp_path, "a", answers(of), ANSWERS, shards.follow, halves)
    want = sorted((s, *x) for s, told in of.items() for x in plain(told))
    assert rows(log, "shard", "seq", "event", "mode", "generation", "attempts") == want
    standing = {s: [n for k, n in rows(shards.standing_pages(log), "shard", "seq") if k == s] for s in CASES}
    assert standing["reset"] == [2, 3, 4] and standing["split"] == [2, 3] and standing["late"] == [4, 5] and standing["once"] == [1, 3, 4] and standing["gone"] == []
    waits = {(s, n): w for s, n, w in rows(log, "shard", "seq", "wait")}
    assert waits["busy", 1] == 7.0 and waits["once", 0] == 2.0 and waits["late", 2] == 4.0


def test_shards_that_are_due(spark, tmp_path):
    """A shard without an answer after its pause is reported once the watermark has passed it; one that has answered is not."""
    of = {"a": [MORE, BUSY], "b": [MORE, BUSY, MORE], "other": [MORE] * 120}
    log = in_parts(spark, tmp_path, "d", answers(of), ANSWERS, lambda s: shards.follow(s, "1 second"), lambda d: (d[:8], d[8:60], d[60:100], d[100:]))
    assert [(s, n) for s, n, e in rows(log, "shard", "seq", "event") if e == "due"] == [("a", 0)]


def plain_siblings(had, least, share):
    listed = folders = 0
    out = []
    for n, h in enumerate(had):
        before = listed >= least and folders <= share * listed
        listed, folders = listed + 1, folders + h
        if before != (listed >= least and folders <= share * listed):
            out.append((n, "one_level_off" if before else "one_level_on", listed, folders))
    return out


def test_siblings_teach_while_they_are_listed(spark, tmp_path):
    r = random.Random(4)
    of = {"/R/wide": [0] * 30, "/R/full": [1] * 30, "/R/turns": [0] * 20 + [1, 1, 1] + [0] * 40, "/R/few": [0] * 19} | {f"/R/r{i}": [int(r.random() < 0.1) for _ in range(r.randrange(5, 90))] for i in range(20)}
    data = [(f"{p}/c{n:02}", n, bool(h), True) for p, had in of.items() for n, h in enumerate(had)]
    data += [(f"/R/few/resumed{n}", 100 + n, False, False) for n in range(5)]  # resumed from a cursor: no proof of anything
    data.sort(key=lambda x: x[1])
    got = in_parts(spark, tmp_path, "s", data, "path string, seq long, had_folders boolean, from_start boolean", shards.learn, halves)
    assert rows(got, "parent", "seq", "event", "listed", "with_folders") == sorted((p, *x) for p, had in of.items() for x in plain_siblings(had, 20, 0.1))
    assert [x for x in rows(got, "parent", "seq", "event") if x[0] == "/R/turns"][:2] == [("/R/turns", 19, "one_level_on"), ("/R/turns", 22, "one_level_off")]
    last = spark.createDataFrame(data, "path string, seq long, had_folders boolean, from_start boolean").filter("from_start")
    leafy = {p for p, y in rows(ingest.should_split(last), "parent", "leafy") if y}
    assert leafy == {p for p, had in of.items() if len(had) >= 20 and sum(had) <= 0.1 * len(had)}


def test_pages_that_come_again(spark, tmp_path):
    """A page in a later batch, after a restart, or twice in one batch, counts once."""
    page = lambda shard, n: [(shard, n * 10 + k, f"{shard}-{n}-{k}") for k in range(4)]
    batches = [page(1, 0) + page(2, 0) + page(1, 0), page(1, 0) + page(1, 1), page(2, 0) + page(2, 1) + page(1, 1), page(1, 2)]
    got = in_parts(spark, tmp_path, "f", batches, "shard_id long, seq long, id string", shards.fresh, lambda b: b)
    want = {x for b in batches for x in b}
    assert rows(got, "shard_id", "seq", "id") == sorted(want)


def test_ingestion_drops_pages_that_come_again(spark, tmp_path):
    """The second try of a lister stores a page under another name; its events are not doubled."""
    import json

    (tmp_path / "p").mkdir()
    entry = {".tag": "deleted", "name": "gone", "path_display": "/R/gone"}
    for n in range(3):
        (tmp_path / "p" / f"{n:08d}.json").write_text(json.dumps({"entries": [entry, {".tag": "file", "id": f"f{n}", "name": "a", "path_display": f"/R/{n}/a", "size": 1}]}))
    listing.register(spark)
    for _ in range(2):  # the lister's folder is read by two streams into one catalog
        stream = spark.readStream.format("listing_pages").option("path", f"{tmp_path}/p").load()
        both = stream.unionByName(spark.readStream.format("listing_pages").option("path", f"{tmp_path}/p").load())
        with shards.with_rocksdb(spark):
            q = sink.ingest_stream(both, f"{tmp_path}/c", f"{tmp_path}/ck", "/R", once=False, fresh=True)
            q.processAllAvailable()
            q.stop()
    c = sink.read_catalog(spark, f"{tmp_path}/c")
    assert c["events"].count() == 3 and c["files"].count() == 3
