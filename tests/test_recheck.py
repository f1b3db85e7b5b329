"""Asking verdicts again: the rules on tables, and walks that begin amid an archive."""

import io
import tarfile

from stowage import cli
from stowage.operators import archives as A
from stowage.operators import recheck
from stowage.sources import tar

from .helpers import rows
from .test_archives import build

SEGMENTS = "archive_id long, idx int, scan_from long, stop_at long, first_header long, exit_offset long, state string, members long, joined boolean, detail string"
BASE = [(1, 0, 0, 100, 0, 120, "crossed", 1, True, ""), (1, 1, 100, 200, 120, 210, "crossed", 2, True, ""), (1, 2, 200, 300, 210, 280, "corrupt", 1, True, "junk"), (1, 3, 300, 400, 300, 400, "crossed", 1, False, ""), (1, 4, 400, None, 420, 500, "complete", 1, False, "")]


def asked(spark, segments, notes=(), state="corrupt"):
    s = spark.createDataFrame(segments, SEGMENTS)
    return s, recheck.questions(s, spark.createDataFrame([(1, state)], "id long, state string"), spark.createDataFrame(list(notes), recheck.NOTES))


def note(q):
    return [tuple(r) for r in q.drop("further").collect()]


def test_steps_back_while_the_verdict_stays(spark):
    s, q = asked(spark, BASE)
    assert rows(q, "idx", "again", "further") == [(2, 1, False)]
    assert rows(recheck.restated(s, q), "idx", "state", "first_header", "joined", "exit_offset", "members") == [
        (0, "crossed", 0, True, 120, 1), (1, "pending", 120, True, None, 0), (2, "pending", 210, False, None, 0), (3, "beyond", None, False, None, 0), (4, "beyond", None, False, None, 0),
    ]
    members = spark.createDataFrame([(1, n, o) for n, o in ((0, 0), (1, 120), (1, 150), (2, 210), (4, 420))] + [(2, 3, 9)], "archive_id long, segment int, hdr_offset long")
    assert rows(recheck.standing(members, q), "archive_id", "hdr_offset") == [(1, 0), (2, 9)]
    _, q2 = asked(spark, BASE, note(q))
    assert rows(q2, "idx", "again", "further") == [(2, 0, True)]
    _, q3 = asked(spark, BASE, note(q2))
    assert rows(q3, "again") == [(0,)]  # there is nothing further back
    other = [*BASE[:2], (1, 2, 200, 300, 210, 290, "corrupt", 2, True, "junk"), *BASE[3:]]
    assert rows(asked(spark, other, note(q2))[1], "again", "further") == [(1, False)]  # another verdict is asked from the segment before it
    first = [(1, 0, 0, 100, 0, 60, "corrupt", 1, True, ""), *BASE[1:]]
    assert rows(asked(spark, first)[1], "idx", "again") == [(0, 0)]
    assert asked(spark, BASE, state="stale")[1].count() == 0


def test_crossing_into_retired_segments_puts_them_back(spark):
    s = spark.createDataFrame([(1, 0, 0, 1, 0, 1, "crossed", 1, True, "")] + [(1, n, n, n + 1, None, None, "beyond", 0, False, "") for n in range(1, 5)] + [(2, 3, 0, 1, None, None, "beyond", 0, False, "")], SEGMENTS)
    got = recheck.rearmed(s, spark.createDataFrame([(1, 2)], "archive_id long, idx int"))
    assert rows(got, "archive_id", "idx", "state") == [(1, 0, "crossed"), (1, 1, "beyond"), (1, 2, "pending"), (1, 3, "pending"), (1, 4, "pending"), (2, 3, "beyond")]


def test_an_archive_read_wrongly_is_mended_by_asking_again(spark, tmp_path, capsys):
    """A part's bytes are wrong while the archive is indexed and right afterwards, with the same name, size and time."""
    import os

    (tmp_path / "p").mkdir()
    names, data = build(tmp_path / "p", [(f"f{i:02}", bytes([i]) * 3000) for i in range(20)], 9000)
    at = next(m.offset for m in tarfile.open(fileobj=io.BytesIO(data)) if m.name == "f09")
    i, inside, _ = next(iter(tar.Parts(names).slices(at, 1)))
    right, stamp = open(names[i], "rb").read(), os.stat(names[i]).st_mtime_ns
    with open(names[i], "r+b") as f:
        f.seek(inside + 148)
        f.write(b"9")
    os.utime(names[i], ns=(stamp, stamp))
    run = lambda *a: cli.main(list(a), spark)
    parts = f"{tmp_path}/p/a.tar.*"
    assert run("archive-index", f"{tmp_path}/a0", "--parts", parts, "--name", "a.tar") == 1
    ask = lambda n, out: run("archive-recheck", f"{tmp_path}/a{n}", "--id", "1", "--parts", parts, "--out", f"{tmp_path}/a{out}")
    # as long as the bytes are wrong the verdict stays, and each question goes one segment further back
    assert ask(0, 1) == 1 and ask(1, 2) == 1
    told = capsys.readouterr().out
    assert f"from segment {i - 1}: corrupt" in told and f"from segment {max(i - 2, 0)} (further back" in told
    before = spark.read.parquet(f"{tmp_path}/a2/members")
    assert rows(before, "name") == [(f"f{k:02}",) for k in range(9)]
    open(names[i], "wb").write(right)
    os.utime(names[i], ns=(stamp, stamp))
    assert ask(2, 3) == 0
    assert rows(spark.read.parquet(f"{tmp_path}/a3/members"), "name", "hdr_offset") == sorted((m.name, m.offset) for m in tarfile.open(fileobj=io.BytesIO(data)))
    assert rows(A.chain_ending(spark.read.parquet(f"{tmp_path}/a3/segments")), "state") == [("complete",)]
    assert ask(3, 4) == 2  # a complete archive has no verdict to ask again
