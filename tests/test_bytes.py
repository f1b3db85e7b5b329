"""Bytes by ranges: stores, block hashes, sampled members, confirmed and streamed reads."""

import hashlib
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stowage import cli
from stowage.operators import archives as A
from stowage.operators import blocks as B
from stowage.operators import votes
from stowage.sources import blocks, confirm, store, tar

from .helpers import rows
from .test_archives import build



def plain_hash(data, block=4 << 20):
    return hashlib.sha256(b"".join(hashlib.sha256(data[i : i + block]).digest() for i in range(0, len(data), block))).hexdigest()


def test_patterns_and_sizes(tmp_path):
    for name in ("a/x.tar.aa", "a/x.tar.ab", "a/y", "b/x.tar.aa", "b/c/x.tar.aa"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = lambda p: [f.path.removeprefix(str(tmp_path)) for f in store.matching(p)]
    assert found(f"{tmp_path}/a/x.tar.*") == ["/a/x.tar.aa", "/a/x.tar.ab"]
    assert found(f"{tmp_path}/?/x.tar.a[a]") == ["/a/x.tar.aa", "/b/x.tar.aa"]
    assert found(f"{tmp_path}/a/y") == ["/a/y"] and found(f"{tmp_path}/a/z") == [] and found(f"{tmp_path}/none/*") == []
    uri = f"file://{tmp_path}/a/x.tar.*"
    assert [f.path for f in store.matching(uri)] == [f"file://{tmp_path}/a/x.tar.aa", f"file://{tmp_path}/a/x.tar.ab"]
    assert [f.size for f in store.files_at([f"{tmp_path}/a/y", f"file://{tmp_path}/b/c/x.tar.aa"])] == [3, 12]
    with pytest.raises(FileNotFoundError):
        store.files_at([f"{tmp_path}/a/none"])
    reader = store.Reader()
    assert reader.fetch(f"file://{tmp_path}/a/y", 1, 2) == b"/y" and reader.fetched == 2
    with pytest.raises(OSError, match="1 of 5 bytes"):
        reader.fetch(f"{tmp_path}/a/y", 2, 5)


def test_block_hashes_of_a_file_beyond_2_gib(spark, tmp_path):
    """A sparse file of 3 GiB and some bytes against a plain loop; no task reads more than its range."""
    big = tmp_path / "big"
    with open(big, "wb") as f:
        f.seek((3 << 30) + 12_345)
        f.write(b"end")
        for at in (0, (4 << 20) - 2, (2 << 30) + 77):
            f.seek(at)
            f.write(random.Random(at).randbytes(5000))
    digest = hashlib.sha256()
    with open(big, "rb") as f:
        while block := f.read(4 << 20):
            digest.update(hashlib.sha256(block).digest())
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    files = store.matching(f"{tmp_path}/*")
    got = dict(rows(blocks.content_hashes(spark, files), "path", "content_hash"))
    assert got == {str(big): digest.hexdigest(), f"{tmp_path}/small": plain_hash(b"abc"), f"{tmp_path}/empty": hashlib.sha256(b"").hexdigest()}
    reader = blocks.BlockReader({"files": f'[["{big}", {big.stat().st_size}]]'})
    spans = reader.partitions()
    assert len(spans) == 49 and all(s.last - s.first <= blocks.SPAN for s in spans) and spans[-1].last == 769
    assert sum(n for _, _, n, _ in reader.read(spans[-1])) == big.stat().st_size - spans[-1].first * (4 << 20)


def test_chunks_are_cut_anew(spark):
    r = random.Random(3)
    chunks, whole = [], {}
    for name, count in (("hot", 300), ("a", 20), ("none", 1)):
        parts = [r.randbytes(r.choice([0, 1, 99, 100, 101, 950])) for _ in range(count)] if name != "none" else [b""]
        whole[name] = b"".join(parts)
        chunks += [(name, 7 * i - 50, p) for i, p in enumerate(parts)]
    r.shuffle(chunks)
    df = spark.createDataFrame(chunks + [("null", 1, None)], "file string, n long, content binary")
    told = B.block_digests(df, ["file"], "n", block=100)
    want = sorted((k, i // 100, len(d[i : i + 100]), hashlib.sha256(d[i : i + 100]).hexdigest()) for k, d in whole.items() for i in range(0, len(d), 100))
    assert rows(told, "file", "block", "length", "digest") == want
    assert rows(B.digest_of_digests(told, ["file"]), "file", "content_hash") == sorted((k, plain_hash(d, 100)) for k, d in whole.items() if d)


def test_windows_stay_inside(spark):
    sizes = [0, 1, 63, 64, 65, 100, 1000, 12_345]
    df = spark.createDataFrame([(s,) for s in sizes], "size long")
    for n in (1, 2, 4, 7):
        for s, w in df.select("size", B.windows(F.col("size"), n, 64).alias("w")).collect():
            if s <= 64:
                want = [(0, 0, s)]
            elif n == 1:
                want = [(0, 0, 64)]
            else:
                want = [(i, ((s - 64) * i // (n - 1)) // 8 * 8, 64) for i in range(n)]
            assert [tuple(x) for x in w] == want


def sampled_tar(tmp_path):
    r = random.Random(8)
    body = r.randbytes(400_000)
    late = body[:-5] + b"later"
    members = [(f"run{i}/model.bin", body if i != 2 else late) for i in range(4)] + [(f"run{i}/note.txt", b"equal") for i in range(3)] + [("run9/note.txt", b"other"), ("run1/alone.bin", body)]
    members += [("run1/sub/small.txt", b"s" * 100), ("run2/sub/small.txt", b"s" * 100)]
    return build(tmp_path, members, 300_001)


def test_same_content_by_sampled_windows(spark, tmp_path, capsys):
    names, _ = sampled_tar(tmp_path)
    members, _ = tar.index(spark, [{"archive_id": 1, "parts": names}])
    found = A.same_content(blocks.signed(members, [{"archive_id": 1, "parts": names}], 4), ["archive_id"])
    assert rows(found, "name", "members", "contents", "redundant") == [("model.bin", 4, 2, 2), ("note.txt", 4, 2, 2), ("small.txt", 2, 1, 1)]
    # one window at the beginning does not see the late difference
    first = A.same_content(blocks.signed(members, [{"archive_id": 1, "parts": names}], 1), ["archive_id"])
    assert ("model.bin", 4, 1, 3) in rows(first, "name", "members", "contents", "redundant")
    scoped = blocks.signed(members, [{"archive_id": 1, "parts": names}], 4, scope=1)
    assert scoped.count() == 0
    run = lambda *a: cli.main(list(a), spark)
    arch, parts = f"{tmp_path}/arch", f"{tmp_path}/a.tar.*"
    assert run("archive-index", arch, "--parts", parts, "--name", "a.tar", "--hash") == 0
    assert rows(spark.read.parquet(f"{arch}/parts"), "idx", "content_hash") == [(i, plain_hash(open(p, "rb").read())) for i, p in enumerate(names)]
    capsys.readouterr()
    assert run("archive-same", arch, "--id", "1", "--parts", parts) == 1
    assert "model.bin\t400000\t4\t2\t2" in capsys.readouterr().out
    assert run("archive-verify", arch, "--id", "1", "--parts", parts) == 0
    with open(names[0], "r+b") as f:
        f.write(b"zzz")
    assert run("archive-verify", arch, "--id", "1", "--parts", parts) == 1


def test_walk_reads_headers_only(spark, tmp_path):
    """Headers far apart cost a small window each; small members next to each other share windows that double."""
    names, data = build(tmp_path, [(f"big{i}", bytes(2_000_000)) for i in range(10)], 5_000_000)
    parts = tar.Parts(names)
    seen = list(tar.follow(parts, 0, None, 1, 0))
    assert len(seen) == 10 and parts.reader.fetched <= 12 * tar.WINDOW[0]
    (tmp_path / "s").mkdir()
    names, data = build(tmp_path / "s", [(f"f{i}", b"x" * 100) for i in range(3000)], 1 << 30)
    parts = tar.Parts(names)
    assert len(list(tar.follow(parts, 0, None, 1, 0))) == 3000 and parts.reader.fetched <= 1.3 * len(data) + tar.WINDOW[1]


class Flaky:
    """A store that answers some reads with other bytes: ``lies`` maps the number of a read to what it gives."""

    def __init__(self, data, lies=(), every=0):
        self.data, self.lies, self.every, self.reads = data, dict(lies), every, 0

    def fetch(self, at, n):
        self.reads += 1
        got = self.data[at : at + n]
        if self.reads in self.lies or self.every and self.reads % self.every == 0:
            other = self.lies.get(self.reads) or bytes((b + 1) % 256 for b in got)
            return (other * (n // max(len(other), 1) + 1))[:n]
        return got


def test_ambiguous_bytes():
    assert confirm.ambiguous(b"") and confirm.ambiguous(random.Random(0).randbytes(511)) and confirm.ambiguous(bytes(100_000))
    assert not confirm.ambiguous(random.Random(0).randbytes(512))
    for data in (b"ab" * 5000, random.Random(1).randbytes(5000), b"".join(b"%d," % i for i in range(2000))):
        assert confirm.ambiguous(data) == (len(zlib.compress(data, 1)) * 8 < len(data))


def test_settle_needs_a_lead_of_two():
    say = lambda *v: iter([x.encode() for x in v]).__next__
    assert confirm.settle(b"a", say("a"), 6) == b"a"
    assert confirm.settle(b"x", say("a", "a", "a"), 6) == b"a"
    assert confirm.settle(b"a", say("x", "x", "a", "a", "a"), 6) == b"a"
    with pytest.raises(confirm.Unsettled):
        confirm.settle(b"a", say("b", "a", "b", "a", "b", "a"), 6)
    with pytest.raises(confirm.Unsettled):
        confirm.settle(b"a", say(), 0)


@pytest.mark.parametrize("kind", ["random", "zeros", "short"])
def test_confirmed_chunks_survive_wrong_answers(kind):
    data = {"random": random.Random(5).randbytes(200_000), "zeros": bytes(200_000), "short": b"short"}[kind]
    for n in range(1, 12):
        flaky = Flaky(data, {n: None})
        assert b"".join(confirm.chunks(flaky.fetch, 0, len(data), 30_000, 6)) == data
    calm = Flaky(data)
    assert b"".join(confirm.chunks(calm.fetch, 0, len(data), 30_000, 6)) == data
    # overlaps vouch for random bytes, each read of zeros is made twice
    assert calm.reads == {"random": 8, "zeros": 16, "short": 2}[kind]
    assert b"".join(confirm.chunks(calm.fetch, 7, 0, 30_000, 6)) == b"" and b"".join(confirm.chunks(calm.fetch, 0, len(data), 999, 0)) == data
    with pytest.raises(confirm.Unsettled):
        b"".join(confirm.chunks(Flaky(data, every=2).fetch, 0, len(data), 30_000, 6))


def test_member_is_streamed_and_checked(spark, tmp_path, capsys):
    members = [("d/a", random.Random(1).randbytes(100_000)), ("d/b", bytes(70_000)), ("d/a", b"again"), ("d/last", b"z" * 700)]
    names, data = build(tmp_path, members, 40_000)
    found = list(tar.follow(tar.Parts(names), 0, None, 1, 0))
    for m, (_, body) in zip(found, members):
        parts = tar.Parts(names)
        got = [*tar.stream_member(parts, m[2], dir=m[10], name=m[11], size=m[4], chunk=30_000)]
        assert b"".join(got) == body and max(map(len, got)) <= 30_000
        assert b"".join(tar.stream_member(tar.Parts(names), m[2], dir=m[10], name=m[11], size=m[4], chunk=30_000, tries=6)) == body
    run = lambda *a: cli.main(list(a), spark)
    arch, parts, out = f"{tmp_path}/arch", f"{tmp_path}/a.tar.*", f"{tmp_path}/out"
    assert run("archive-index", arch, "--parts", parts, "--name", "a.tar") == 0
    assert run("archive-cat", arch, "--id", "1", "--parts", parts, "--out", out, "d/a") == 2
    assert f"--offset {found[2][2]}  size=5" in capsys.readouterr().err and not os.path.exists(out)
    assert run("archive-cat", arch, "--id", "1", "--parts", parts, "--out", out, "--offset", "999", "d/a") == 2 and "--offset 0 " in capsys.readouterr().err
    assert run("archive-cat", arch, "--id", "1", "--parts", parts, "--out", out, "--offset", str(found[2][2]), "--tries", "6", "d/a") == 0
    assert open(out, "rb").read() == b"again"
    # what follows the second member is no header any more: nothing is left of the output
    after = found[1][3] + 70_144
    i, at, _ = next(iter(tar.Parts(names).slices(after, 1)))
    with open(names[i], "r+b") as f:
        f.seek(at)
        f.write(b"spoilt" * 20)
    assert run("archive-cat", arch, "--id", "1", "--parts", parts, "--out", f"{tmp_path}/gone", "d/b") == 2
    assert "followed by no header" in capsys.readouterr().err and not os.path.exists(f"{tmp_path}/gone")


def plain_vote(reads, tries):
    counts = Counter()
    for n, d in enumerate(reads[: tries + 1], 1):
        if d is not None:
            counts[d] += 1
            top = counts.most_common(2) + [(None, 0)]
            if top[0][1] - top[1][1] >= 2:
                return top[0][0], n, len(counts)
    return None, min(len(reads), tries + 1), len(counts)


def test_votes_against_a_loop(spark):
    r = random.Random(2)
    reads = {i: [r.choice(["a", "a", "b", "c", None]) for _ in range(r.randrange(1, 12))] for i in range(300)}
    reads[999] = ["a", "b"] * 2000  # a hot range that never settles
    df = spark.createDataFrame([(k, n, d) for k, v in reads.items() for n, d in enumerate(v)], "range_id long, attempt int, digest string")
    got = {x["range_id"]: (x["digest"], x["attempts"], x["versions"]) for x in votes.settled(df, ["range_id"]).collect()}
    assert got == {k: plain_vote(v, 6) for k, v in reads.items()}
    assert votes.settled(df.limit(0), ["range_id"]).count() == 0


def test_windows_off_the_grid(spark, tmp_path, capsys):
    """A tar whose second half is shifted by some bytes, and floats that begin at an odd place, against a plain look at every offset."""
    import numpy as np

    from stowage.sources import windows

    r = random.Random(3)
    _, data = build(tmp_path, [(f"f{i}", r.randbytes(r.randrange(1, 3000))) for i in range(40)], 1 << 30)
    half = len(data) // 2 // 512 * 512
    (tmp_path / "w").mkdir()
    shifted = data[:half] + b"\x07" * 77 + data[half:]
    (tmp_path / "w/a").write_bytes(shifted)
    floats = np.random.default_rng(0).uniform(0.5, 50, 20_000).astype("<f4").tobytes()
    (tmp_path / "w/b").write_bytes(b"\x01" + floats)
    (tmp_path / "w/c").write_bytes(b"")
    found = windows.report(spark, store.matching(f"{tmp_path}/w/*"), 8192)
    got = {(p.rsplit("/", 1)[1], at): (m, on, off, first, z) for p, at, m, on, off, first, z in rows(found.fillna(-1, ["first_unaligned"]), "path", "at", "magic", "aligned", "unaligned", "first_unaligned", "zeros")}
    for at in range(0, len(shifted), 8192):
        begins = [k for k in range(at, min(at + 8192, len(shifted))) if tar.valid(shifted[k : k + 512])]
        on, off = [k for k in begins if k % 512 == 0], [k for k in begins if k % 512]
        m, n_on, n_off, first, zeros = got["a", at]
        assert (n_on, n_off, first, zeros) == (len(on), len(off), off[0] if off else -1, shifted[at : at + 8192].count(0)) and m >= len(begins)
    assert sum(v[1] + v[2] for k, v in got.items() if k[0] == "a") == 40 and ("c", 0) not in got
    told = found.filter(F.col("path").endswith("/b")).orderBy("at").collect()
    assert all(t["best_phase"] == 1 and t["best_share"] > 0.99 for t in told)
    assert all(s == 77 for (s,) in rows(found.filter("unaligned > 0"), "shift"))
    assert windows.phases(bytes(15)) == [None] * 4 and windows.phases(bytes(400)) == [1.0] * 4
    assert cli.main(["archive-diagnose", "--parts", f"{tmp_path}/w/a", "--window", "8192"], spark) == 1
    assert cli.main(["archive-diagnose", "--parts", f"{tmp_path}/a.tar*"], spark) == 0
