"""Archive analytics: part sets, segments, range joins, and the tar source against Python's tarfile."""

import io
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from stowage.operators import archives as A
from stowage.operators import catalogs as C
from stowage.operators import ranges
from stowage.sources import sinks, tar

from .helpers import files, rows


def candidates(spark, names):
    """{folder: (status, detail)} of a listing {path: content}."""
    got = A.candidate_sets(files(spark, [(p, 10 + len(h), h, None) for p, h in names]))
    return {f: (s, d) for f, s, d in rows(got, "folder", "status", "detail")}


def test_part_sets(spark):
    got = candidates(spark, [
        ("/ok/a.tar.aa", "1"), ("/ok/a.tar.ab", "2"), ("/copy/a.tar.aa", "1"), ("/copy/a.tar.ab", "2"), ("/gap/a.tar.aa", "1"), ("/gap/a.tar.ac", "2"), ("/late/a.tar.ab", "1"),
        ("/wide/a.tar.aa", "1"), ("/wide/a.tar.aaa", "2"), ("/style/a.tar.aa", "1"), ("/style/a.tar.00", "2"), ("/one/b.tar", "3"), ("/both/b.tar", "3"), ("/both/b.tar.aa", "4"),
        ("/odd/a.tar.aa", "1"), ("/odd/a.tar.md5sum!", "2"), ("/sep/a.tar.aa/a.tar.aa", "9"), ("/from1/a.tar.01", "5"), ("/from1/a.tar.02", "6"), ("/part/a.tar.part00", "7"),
    ])
    status = {f: s for f, (s, _) in got.items()}
    assert status == {"/ok": "copy", "/copy": "ok", "/gap": "refused", "/late": "refused", "/wide": "refused", "/style": "refused", "/one": "ok", "/both": "refused", "/odd": "refused", "/sep/a.tar.aa": "refused", "/from1": "ok", "/part": "ok"}
    assert got["/ok"][1] == "copy of /copy/a.tar" and "missing" in got["/gap"][1] and "first" in got["/late"][1] and "separate" in got["/sep/a.tar.aa"][1]


def test_skipped(spark):
    f = files(spark, [("/a/x.tar.gz", 5, None, None), ("/a/x.tgz", 6, None, None), ("/a/X.TAR", 7, None, None), ("/a/x.tar", 8, None, None), ("/a/n.txt", 1, None, None)])
    assert rows(A.skipped(f), "what", "files", "bytes") == [("compressed", 2, 11), ("other", 1, 7)]


def test_segment_chain(spark):
    s = spark.createDataFrame([(1, 0, "crossed", 0, 10), (1, 1, "crossed", 10, 20), (1, 2, "crossed", 21, 30), (1, 3, "complete", 30, 40)], "archive_id long, idx int, state string, first_header long, exit_offset long")
    assert rows(A.segment_chain(s), "idx", "joined") == [(0, True), (1, True), (2, False), (3, False)]
    assert rows(A.chain_ending(s), "idx", "state") == [(3, "complete")]


def test_range_joins(spark):
    r = random.Random(2)
    points = [(k, r.randrange(1000)) for k in range(3) for _ in range(80)]
    spans = [(k, i, a, a + r.randint(1, 300)) for k in range(3) for i, a in enumerate(r.randrange(1000) for _ in range(15))]
    p, s = spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(spans, "k int, i int, b long, e long")
    got = rows(ranges.binned_range_join(p, s, at="at", begin="b", end="e", keys=["k"], width=64), "k", "at", "i")
    assert got == sorted((k, x, i) for k, x in points for j, i, a, e in spans if j == k and a <= x < e)
    marks = [(k, x, n) for n, (k, x) in enumerate(dict.fromkeys((r.randrange(3), r.randrange(1000)) for _ in range(40)))]
    found = rows(ranges.as_of_join(p, spark.createDataFrame(marks, "k int, m long, n int"), at="at", mark="m", keys=["k"], values=["n"]), "k", "at", "n")
    want = [(k, x, max(((m, n) for j, m, n in marks if j == k and m <= x), default=(0, None))[1]) for k, x in points]
    assert sorted(map(str, found)) == sorted(map(str, want))
    cut = ranges.as_of_join(p, spark.createDataFrame(marks, "k int, m long, n int"), at="at", mark="m", keys=["k"], values=["n"], bucket=lambda t: F.floor(t / 37))
    assert sorted(map(str, rows(cut, "k", "at", "n"))) == sorted(map(str, want))


def test_slices(spark):
    parts = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 0), (1, 2, 10, 25), (1, 3, 35, 5)], "archive_id long, idx int, offset long, size long")
    reads = spark.createDataFrame([(1, 5, 12), (1, 0, 40), (1, 39, 9)], "archive_id long, offset long, length long")
    got = rows(ranges.slices(reads, parts, keys=["archive_id"], width=8), "offset", "length", "idx", "part_offset", "slice_length")
    assert got == [(0, 40, 0, 0, 10), (0, 40, 2, 0, 25), (0, 40, 3, 0, 5), (5, 12, 0, 5, 5), (5, 12, 2, 0, 7), (39, 9, 3, 4, 1)]


def build(folder, members, part, fmt=tarfile.GNU_FORMAT, cut=None, spoil=None):
    """A tar of (name, bytes, attributes), in parts of ``part`` bytes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        for name, data, *more in members:
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.uname, info.gname = len(data), 1_600_000_000, "u", "g"
            for k, v in (more[0] if more else {}).items():
                setattr(info, k, v)
            t.addfile(info, io.BytesIO(data))
    data = bytearray(out.getvalue()[:cut])
    for at, value in (spoil or {}).items():
        data[at] = value
    names = []
    for i in range(0, len(data), part):
        names.append(str(folder / f"a.tar.{i // part:05d}"))
        with open(names[-1], "wb") as f:
            f.write(data[i : i + part])
    return names, bytes(data)


def load(spark, names):
    return tar.index(spark, [{"archive_id": 1, "parts": names}])


def random_members(seed):
    r = random.Random(seed)
    out = []
    for i in range(60):
        name = "/".join(["d" * r.randint(1, 60)] * r.randint(0, 3) + [f"f{i}" + "n" * r.choice([0, 120])])
        out.append((name, r.randbytes(r.choice([0, 1, 511, 512, 513, 5000, 20_000]))))
    out += [("folder", b"", {"type": tarfile.DIRTYPE}), ("link", b"", {"type": tarfile.SYMTYPE, "linkname": "t" * 150})]
    return out


@pytest.mark.parametrize("part", [4096, 30_000, 10_000_000, 7777])
def test_tar_source_equals_tarfile(spark, tmp_path, part):
    names, data = build(tmp_path, random_members(part), part)
    members, segments = load(spark, names)
    got = {(r["dir"] + "/" + r["name"]).lstrip("/"): r for r in members.collect()}
    want = {m.name: m for m in tarfile.open(fileobj=io.BytesIO(data))}
    assert set(got) == set(want)
    assert rows(A.chain_ending(segments), "state") == [("complete",)]
    for name, r in got.items():
        m = want[name]
        assert (r["size"], r["mtime"], r["uname"], r["linkname"], r["data_offset"]) == (m.size, m.mtime, m.uname, m.linkname, m.offset_data)
        if m.isfile():
            assert tar.read_member(names, r["hdr_offset"], dir=r["dir"], name=r["name"], size=r["size"]) == tarfile.open(fileobj=io.BytesIO(data)).extractfile(m).read()


def test_tar_verdicts(spark, tmp_path):
    members = [(f"f{i}", bytes([i]) * 700) for i in range(10)]
    whole, data = build(tmp_path, members, 1 << 30)
    for kw, state in (({}, "complete"), ({"cut": 5000}, "truncated"), ({"spoil": {1536 * 3 + 150: 65}}, "corrupt"), ({"fmt": tarfile.PAX_FORMAT}, "unsupported")):
        folder = tmp_path / state
        folder.mkdir()
        more = [("é" * 80, b"x")] if state == "unsupported" else []
        names, _ = build(folder, more + members, 1 << 30, **kw)
        _, s = load(spark, names)
        assert rows(s, "state") == [(state,)]
    with pytest.raises(ValueError):
        tar.read_member(whole, 0, dir="", name="other", size=1)
    m, _ = load(spark, whole)
    archive = [{"archive_id": 1, "parts": whole}]
    assert tar.verify_headers(m, archive).count() == 0
    assert tar.verify_headers(m.withColumn("size", F.when(F.col("name") == "f3", 5).otherwise(F.col("size"))), archive).count() == 1


def nested(count):
    """Members that are tars themselves, longer than a part, so that parts begin inside them."""
    inner = []
    for i in range(count):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
            for j in range(6):
                info = tarfile.TarInfo(f"inner{i}_{j}")
                info.size = 700
                t.addfile(info, io.BytesIO(b"x" * 700))
        inner.append((f"m{i}.tar", out.getvalue()))
    return inner


def test_parts_inside_nested_tars_take_few_rounds(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    names, data = build(tmp_path / "parts", nested(30), 5120)
    members, segments = tar.index(spark, [{"archive_id": 4, "parts": names}], f"{tmp_path}/store")
    assert rows(members, "name", "size") == sorted((m.name, m.size) for m in tarfile.open(fileobj=io.BytesIO(data)))
    assert rows(A.chain_ending(segments), "archive_id", "state") == [(4, "complete")] and segments.filter("joined").count() == segments.filter("state <> 'beyond'").count()
    rounds = list((tmp_path / "store").glob("*/*"))
    assert len(names) > 60 and len(rounds) <= 3


def test_cut_off_index_goes_on(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    names, data = build(tmp_path / "parts", random_members(3), 30_000)
    archives = [{"archive_id": 1, "parts": names}]
    store = tmp_path / "store"
    want = rows(tar.index(spark, archives, str(store), at_once=2)[0], "hdr_offset", "name")
    assert want and len(want) == len(tarfile.open(fileobj=io.BytesIO(data)).getmembers())
    jobs = {p: p.stat().st_mtime_ns for p in store.glob("*/*/_SUCCESS")}
    lost = sorted(jobs)[1]
    lost.unlink()
    assert rows(tar.index(spark, archives, str(store), at_once=2)[0], "hdr_offset", "name") == want
    assert {p for p, at in jobs.items() if p.stat().st_mtime_ns != at} == {lost}
    # a part that changed begins anew
    with open(names[0], "ab") as f:
        f.write(b"")
    os.utime(names[0], ns=(1, 1))
    tar.index(spark, archives, str(store), at_once=2)
    assert len(list(store.iterdir())) == 2


def member_rows(spark):
    data = [(1, 0, 512, 100, "0", 420, 10, "u", "g", "run/fault_a/x", "a.bb", ""), (1, 1024, 1536, 50, "0", 420, 20, "u", "h", "run/fault_b", 'b, "q".txt', ""), (1, 2048, 2560, 7, "0", 420, 30, "v", "g", "", "root", ""), (1, 3072, 3584, 0, "5", 420, 40, "v", "g", "", "dir", "")]
    return spark.createDataFrame(data, "archive_id long, hdr_offset long, data_offset long, size long, type string, mode long, mtime long, uname string, gname string, dir string, name string, linkname string")


def test_summary(spark, tmp_path):
    m = member_rows(spark)
    got = {(s, k): (n, b) for s, k, n, b in rows(A.summary(m), "section", "key", "members", "bytes")}
    assert got["total", ""] == (4, 157) and got["dir1", "run"] == (2, 150) and got["dir1", "(root)"] == (1, 7)
    assert got["dir2", "run/fault_a"] == (1, 100) and got["dir3", "run/fault_b"] == (1, 50) and got["owner", "u:g"] == (1, 100) and got["ext", "(none)"] == (1, 7) and got["type", "5"] == (1, 0)
    sinks.export_archive(m, 1, str(tmp_path))
    back = spark.read.options(header=True, quote='"', escape='"').csv(f"{tmp_path}/manifest")
    assert ('run/fault_b/b, "q".txt', "0644") in rows(back, "path", "mode")


def test_catalog_import_and_forget(spark):
    def catalog(rows_, members):
        a = spark.createDataFrame(rows_, "id long, name string, folder string, state string, set_hash string, created_at long")
        return {"archives": a, "members": spark.createDataFrame(members, "archive_id long, name string")}

    mine = catalog([(1, "a", "/x", "complete", "h1", 1), (2, "b", None, "complete", "h2", 1)], [(1, "m1"), (2, "m2")])
    theirs = catalog([(1, "b", None, "complete", "h3", 5), (7, "a", "/x", "complete", "h1", 9)], [(1, "n1"), (7, "n7")])
    got = C.import_catalog(mine, theirs)
    assert rows(got["archives"], "id", "name", "state") == [(2, "b", "stale"), (3, "b", "complete"), (9, "a", "complete")]
    assert rows(got["members"], "archive_id", "name") == [(2, "m2"), (3, "n1"), (9, "n7")]
    assert rows(C.forget(mine, spark.createDataFrame([(1,)], "archive_id long"))["members"], "name") == [("m2",)]
    with pytest.raises(ValueError):
        C.import_catalog(mine, {"archives": theirs["archives"].drop("state"), "members": theirs["members"]})


def test_changed_parts(spark):
    parts = spark.createDataFrame([(1, 0, "n0", "id0", 5, "h"), (1, 1, "n1", "id1", 5, "h"), (1, 2, "n2", "", 5, "h"), (1, 3, "n3", "id3", 5, "h")], "archive_id long, idx int, name string, file_id string, size long, content_hash string")
    live = spark.createDataFrame([("id0", "moved", 5, "h"), ("id9", "n1", 6, "h"), ("x", "n2", 5, "g")], "id string, name string, size long, content_hash string")
    assert rows(A.changed_parts(parts, live), "idx", "change") == [(1, "resized"), (2, "rewritten"), (3, "missing")]


def test_parts_whose_names_repeat(spark):
    """One row a part, whatever namesakes lie elsewhere."""
    parts = spark.createDataFrame([(1, 0, "n", "", 5, "h"), (2, 0, "n", "", 6, "h"), (3, 0, "n", "", 9, None)], "archive_id long, idx int, name string, file_id string, size long, content_hash string")
    live = spark.createDataFrame([("", "/a", "n", 5, "h"), ("", "/b", "n", 6, "g"), ("", "/c", "n", 5, "h"), ("", "/d", "n", 9, None)], "id string, folder string, name string, size long, content_hash string")
    assert rows(A.changed_parts(parts, live), "archive_id", "change") == [(2, "resized")]
    placed = parts.withColumn("folder", F.element_at(F.array(F.lit("/b"), F.lit("/b"), F.lit("/none")), F.col("archive_id").cast("int")))
    assert rows(A.changed_parts(placed, live), "archive_id", "change") == [(1, "resized"), (2, "rewritten"), (3, "missing")]


def test_copies_of_one_set(spark):
    """A third of all sets are copies of one; the first by size, folder and name stays."""
    made = [(f"/d{i:03}/a.tar", 7, "h") for i in range(60)] + [(f"/e{i:03}/b.tar", 7, f"x{i}") for i in range(60)] + [("/z/a.tar.ab", 3, "q")]
    c = A.candidate_sets(files(spark, [(p, s, h, 0) for p, s, h in made]))
    status = {(f, n): (st, d) for f, n, st, d in rows(c, "folder", "name", "status", "detail")}
    assert status["/d000", "a.tar"] == ("ok", "") and all(status[f"/d{i:03}", "a.tar"] == ("copy", "copy of /d000/a.tar") for i in range(1, 60))
    assert all(status[f"/e{i:03}", "b.tar"] == ("ok", "") for i in range(60)) and status["/z", "a.tar"][0] == "refused"
    none = spark.createDataFrame([], "id long, set_hash string, state string")
    plan = A.run_plan(c, none, spark.createDataFrame([], "archive_id long"))
    assert {(j, n) for j, n in rows(plan.filter("folder = '/d000'"), "job", "copies")} == {("new", 59)}
    assert rows(A.copies_of(c), "folder", "copy")[0] == ("/d000", "/d001/a.tar") and A.copies_of(c).count() == 59


def test_refused_sets_are_not_one_task(spark, monkeypatch):
    """Every set goes by a key of its own to the join with the first of its identity, refused ones too; tasks change nothing."""
    listed = [(f"/d{i}/x.tar.ab", 10, str(i), 1) for i in range(50)] + [(f"/e{i}/x.tar.aa", 10, "same", 1) for i in range(3)]
    seen = []
    kind = type(spark.range(1))
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: seen.append((self, on)) or join(self, other, on, how))
    want = rows(A.candidate_sets(files(spark, listed)), "folder", "status", "detail")
    left, on = seen[-1]
    assert left.select(on).distinct().count() == 51
    monkeypatch.undo()
    assert [s for _, s, _ in want].count("refused") == 50 and [s for _, s, _ in want].count("copy") == 2
    assert rows(A.candidate_sets(files(spark, listed), 7), "folder", "status", "detail") == want


def test_order_archives_keep_a_tasks_rows(spark):
    """As many tasks as the table has rows for, and each scan is shuffled once by archive."""
    from stowage.plans import adapters, queries

    sf = "/root/testdata/sf0.01"
    assert adapters.tasks(spark, sf, "lineitem") == 4
    for name, most in (("coverage", 2), ("archive_summary", 1)):
        found = queries.QUERIES[name](spark, sf)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, plan
