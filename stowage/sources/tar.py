"""Tar members as a Spark data source that reads headers only.

``spark.read.format("tar_members").option("parts", json)`` takes archives as a JSON list of
``{"archive_id": 1, "parts": [path or URI, ...]}``, parts in order, and ``"sizes"`` if they are known.  Every part is one partition: its task looks for the first header
in its part (the first part's begins at 0) and follows the chain of headers to the part's end, across the border if a member's data
cross it.  ``format("tar_segments")`` runs the same walk and returns a row for each part: where its chain began, where it left
off and how it ended; ``operators.archives.segment_chain`` then says how far the chain is proven.  ``format("tar_walk")``, which
``index`` uses, gives both from one walk, and all chains of a part: where one ends inside it, the next header after that begins another.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
from collections.abc import Generator, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import recheck
from ..operators.archives import segment_chain
from ..session import work_dir
from . import confirm
from . import store as files

BLOCK = 512
#: Bytes read at once while looking for a header, and the least and most read for headers.
SCAN, WINDOW = 1 << 20, (1 << 16, 1 << 22)
#: Bytes of a member that are held at once.
CHUNK = 4 << 20

MEMBERS = "archive_id long, segment int, hdr_offset long, data_offset long, size long, type string, mode long, mtime long, uname string, gname string, dir string, name string, linkname string"
SEGMENTS = "archive_id long, idx int, scan_from long, stop_at long, first_header long, exit_offset long, state string, members long, detail string"
#: A member, or (``state`` not null) the row that ends its chain; ``chain``: offset at which the chain begins, null if the part has none.
WALK = f"{MEMBERS}, chain long, state string, exit_offset long, members long, detail string"
#: Parts that one job walks; a walk that was cut off goes on with the first job that is not finished.
AT_ONCE = 1024


class Unsupported(Exception):
    """The archive uses something that its headers alone do not settle."""


class Parts:
    """Files end to end as one range of bytes; a window around the last read is kept, and doubles while reads go on from it."""

    def __init__(self, paths: list[str], sizes: list[int] | None = None):
        self.paths = paths
        self.sizes = [f.size for f in files.files_at(paths)] if sizes is None else sizes
        self.begins = [0, *itertools.accumulate(self.sizes)][: len(paths)]
        self.total = sum(self.sizes)
        self.reader = files.Reader()
        self._at, self._held, self._next = 0, b"", WINDOW[0]

    def locate(self, offset: int) -> int:
        """Number of the part that holds ``offset``; empty parts hold nothing."""
        i = bisect.bisect_right(self.begins, offset) - 1
        return i

    def slices(self, offset: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(part, offset in it, length) that make up a range."""
        end = min(offset + length, self.total)
        while offset < end:
            i = self.locate(offset)
            n = min(end, self.begins[i] + self.sizes[i]) - offset
            yield i, offset - self.begins[i], n
            offset += n

    def forget(self) -> None:
        """What is read next is read anew."""
        self._at, self._held = 0, b""

    def fetch(self, offset: int, length: int) -> bytes:
        out = []
        for i, at, n in self.slices(offset, length):
            out.append(self.reader.fetch(self.paths[i], at, n))
        return b"".join(out)

    def read(self, offset: int, length: int) -> bytes:
        """Up to ``length`` bytes; fewer only at the end."""
        if not (self._at <= offset and offset + length <= self._at + len(self._held)):
            near = self._at <= offset <= self._at + len(self._held) + WINDOW[0]
            self._next = min(self._next * 2, WINDOW[1]) if near else WINDOW[0]
            self._at, self._held = offset, self.fetch(offset, max(length, self._next))
        return self._held[offset - self._at : offset - self._at + length]


def number(field: bytes) -> int:
    """Octal digits, or base 256 if the first bit is set."""
    if field[:1] and field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big") if field[0] != 0xFF else int.from_bytes(field, "big", signed=True)
    digits = field.split(b"\0", 1)[0].strip()
    return int(digits, 8) if digits else 0


def text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def valid(block: bytes) -> bool:
    """A header whose checksum fits."""
    if len(block) < BLOCK or block[257:262] != b"ustar":
        return False
    try:
        told = number(block[148:156])
    except ValueError:
        return False
    return told == sum(block[:148]) + sum(block[156:]) + 8 * 32


@dataclass
class Walk:
    """What a chain of headers came to."""

    exit_offset: int
    state: str
    members: int = 0
    detail: str = ""


def first_header(parts: Parts, begin: int, stop: int | None) -> int | None:
    """Offset of the first valid header on the block grid from ``begin`` on."""
    at = -(-begin // BLOCK) * BLOCK
    end = parts.total if stop is None else min(stop, parts.total)
    while at < end:
        data = parts.fetch(at, SCAN)
        k = data.find(b"ustar", 257)
        while k >= 0:
            if (k - 257) % BLOCK == 0 and at + k - 257 < end and valid(data[k - 257 : k - 257 + BLOCK]):
                return at + k - 257
            k = data.find(b"ustar", k + 1)
        at += SCAN
    return None


def follow(parts: Parts, begin: int, stop: int | None, archive_id: int, segment: int) -> Generator[tuple, None, Walk]:
    """Walk headers from ``begin`` until ``stop`` is passed (crossed) or the archive ends; yields members, returns what it came to."""
    at, seen = begin, 0
    long_name = long_link = None
    first = at
    while True:
        if stop is not None and at >= stop and long_name is None and long_link is None:
            return Walk(at, "crossed", seen)
        block = parts.read(at, BLOCK)
        if long_name is None and long_link is None:
            first = at
        if len(block) < BLOCK:
            return Walk(first, "truncated", seen, "the archive ends without its closing blocks")
        if not any(block):
            rest = parts.read(at + BLOCK, BLOCK)
            if len(rest) == BLOCK and any(rest):
                return Walk(first, "corrupt", seen, "one empty block amid members")
            return Walk(at, "complete", seen)
        if not valid(block):
            return Walk(first, "corrupt", seen, "no valid header")
        kind = block[156:157].decode("latin-1")
        size = number(block[124:136])
        data = at + BLOCK
        after = data + -(-size // BLOCK) * BLOCK
        if kind in "xg":
            raise Unsupported("pax headers")
        if kind in "LK":
            if data + size > parts.total:
                return Walk(first, "truncated", seen, "the archive ends in a long name")
            told = text(parts.read(data, size))
            long_name, long_link = (told, long_link) if kind == "L" else (long_name, told)
            at = after
            continue
        if kind == "S":
            raise Unsupported("sparse members")
        has_data = kind in "0\x007"
        name = long_name if long_name is not None else text(block[0:100])
        if long_name is None and block[257:263] == b"ustar\0" and (prefix := text(block[345:500])):
            name = prefix + "/" + name
        folder, _, base = name.rstrip("/").rpartition("/")
        yield (archive_id, segment, first, data, size, kind, number(block[100:108]), number(block[136:148]), text(block[265:297]), text(block[297:329]), folder, base, long_link if long_link is not None else text(block[157:257]))
        seen += 1
        long_name = long_link = None
        at = after if has_data else data
        if has_data and data + size > parts.total:
            return Walk(first, "truncated", seen, "the archive ends in a member's data")


class SegmentPartition(InputPartition):
    def __init__(self, archive_id: int, paths: list[str], segment: int, sizes: list[int] | None = None):
        self.archive_id, self.paths, self.segment, self.sizes = archive_id, paths, segment, sizes


def scan(p: SegmentPartition, start: int | None = None, every: bool = False) -> Iterator[tuple[tuple | None, tuple | None]]:
    """(member, None) for each member of a part, (None, (chain, state, exit, members, detail)) at the end of each chain.

    ``start``: where the chain is known to enter the part.  ``every``: after a chain that ends inside the part (a tar within a
    member's data does), the next header begins another one.
    """
    parts = Parts(p.paths, p.sizes)
    stop = parts.begins[p.segment + 1] if p.segment + 1 < len(p.paths) else None
    known = start is not None or p.segment == 0
    head = start if start is not None else 0 if p.segment == 0 else first_header(parts, parts.begins[p.segment], stop)
    if head is None:  # all of the part is a member's data, or what follows the end
        yield None, (None, "beyond", None, 0, "")
    while head is not None:
        walk = follow(parts, head, stop, p.archive_id, p.segment)
        try:
            while True:
                yield next(walk), None
        except StopIteration as end:
            w = end.value
        except Unsupported as e:
            yield None, (head, "unsupported", None, 0, str(e))
            return
        yield None, (head, w.state, w.exit_offset, w.members, w.detail)
        head = None if known or not every or w.state == "crossed" else first_header(parts, w.exit_offset + BLOCK, stop)


class TarReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.archives, self.kind = json.loads(options["parts"]), kind
        # [archive, part, offset or null]: the only parts to walk, and where the chain enters them
        self.only = {(a, i): at for a, i, at in json.loads(options["only"])} if "only" in options else None

    def partitions(self) -> list[InputPartition]:
        sized = [(a, a.get("sizes") or [f.size for f in files.files_at(a["parts"])]) for a in self.archives]
        found = [(n, SegmentPartition(a["archive_id"], a["parts"], i, sizes)) for a, sizes in sized for i, n in enumerate(sizes)]
        wanted = [(n, p) for n, p in found if self.only is None or (p.archive_id, p.segment) in self.only]
        return [p for _, p in sorted(wanted, key=lambda x: -x[0])]  # the largest start first

    def read(self, partition: SegmentPartition) -> Iterator[tuple]:
        key = (partition.archive_id, partition.segment)
        chain = None
        for member, end in scan(partition, (self.only or {}).get(key), every=self.kind == "walk"):
            if self.kind == "members":
                if member:
                    yield member
            elif self.kind == "segments":
                if end:
                    yield segment_row(*key, Parts(partition.paths, partition.sizes), *end)
            elif member:
                chain = member[2] if chain is None else chain
                yield (*member, chain, None, None, None, None)
            else:
                yield (*key, *[None] * 11, *end)
                chain = None


def segment_row(archive_id: int, idx: int, parts: Parts, head: int | None, state: str, exit_offset: int | None, members: int, detail: str) -> tuple:
    stop = parts.begins[idx + 1] if idx + 1 < len(parts.paths) else None
    return archive_id, idx, parts.begins[idx], stop, head, exit_offset, state, members, detail


class TarMembers(DataSource):
    """Members of tar archives in parts: of each part's first chain, up to a header that is not supported."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options, "members")


class TarSegments(DataSource):
    """How the walk of each part ended."""

    @classmethod
    def name(cls) -> str:
        return "tar_segments"

    def schema(self) -> str:
        return SEGMENTS

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options, "segments")


class TarWalk(DataSource):
    """Members and the ends of their chains from one walk."""

    @classmethod
    def name(cls) -> str:
        return "tar_walk"

    def schema(self) -> str:
        return WALK

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options, "walk")


def register(spark: SparkSession) -> None:
    for source in (TarMembers, TarSegments, TarWalk):
        spark.dataSource.register(source)


def _joined(parts: Parts, archive_id: int, found: dict[int, dict[int | None, tuple]], begin: tuple[int, int] = (0, 0)) -> tuple[list[tuple], dict[int, int]]:
    """The segment rows of one archive as far as the walked chains join, and {part: offset} of what has to be walked from there.

    A part without a chain at that offset is taken to leave off where its last chain does, so that the wrong parts behind it
    are found in the same round.
    """
    begins, rows, wrong = parts.begins, [], {}
    first_part, want = begin
    for i in range(first_part, len(begins)):
        chains = found[i]
        first = next(iter(chains))
        if want is not None and i + 1 < len(begins) and want >= begins[i + 1]:  # all of it is a member's data
            end = (want, "crossed", want, 0, "")
        elif want is None or want in chains:
            end = (first if want is None else want, *chains[first if want is None else want])
        else:
            wrong[i] = want
            last = list(chains)[-1]
            end = (last, *chains[last])
        rows.append(segment_row(archive_id, i, parts, *end))
        want = end[2] if want is not None and end[1] == "crossed" else None
    return rows, wrong


def index(spark: SparkSession, archives: list[dict], store: str | None = None, at_once: int = AT_ONCE, begin: dict[int, tuple[int, int]] | None = None, ask: int = 0) -> tuple[DataFrame, DataFrame]:
    """Members and segments of archives once their chains are joined.

    A part's first valid header may lie in a member's data, or behind a long name that begins in the part before.  So all chains
    of a part are walked, and a part none of whose chains begins where the one before left off is walked anew from there, all such
    parts of a round together.  Walks are written below ``store`` (a shared folder), ``at_once`` parts a job; called again with the same store and
    unchanged parts (path, size, time), finished jobs are not repeated.  ``begin``: for some archives the part to begin with and the offset at which the chain
    enters it; earlier parts are not read.  ``ask``: a number for each time that an archive is to be read anew.  Only the chains that join are returned.  The driver
    holds the chains' ends, not the members.
    """
    register(spark)
    of = {a["archive_id"]: files.files_at(a["parts"]) for a in archives}
    told = json.dumps([a | {"sizes": [f.size for f in of[a["archive_id"]]]} for a in archives])
    marks = [[f.path, f.size, f.mtime_ns] for own in of.values() for f in own]
    begin = begin or {}
    root = f"{store or work_dir(spark)}/{_digest([archives, marks, at_once, *([sorted(begin.items()), ask] if begin or ask else [])])}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    walked: list[str] = []

    def walk(parts: list[list]) -> DataFrame:
        """[archive, part, offset or null] in jobs of at_once parts, each in a folder of its own that a replay overwrites."""
        new = []
        for n in range(0, len(parts), at_once):
            only = json.dumps(parts[n : n + at_once])
            new.append(f"{root}/{_digest(only)}")
            mark = jvm.org.apache.hadoop.fs.Path(new[-1] + "/_SUCCESS")
            if not mark.getFileSystem(conf).exists(mark):
                spark.read.format("tar_walk").option("parts", told).option("only", only).load().write.mode("overwrite").parquet(new[-1])
        walked.extend(new)
        return spark.read.schema(WALK).parquet(*new) if new else spark.createDataFrame([], WALK)

    found: dict[int, dict[int, dict]] = {a["archive_id"]: {i: {} for i in range(len(a["parts"]))} for a in archives}
    start = {k: begin.get(k, (0, 0)) for k in of}
    todo = [[k, i, start[k][1] if i == start[k][0] and k in begin else None] for k, own in of.items() for i in range(start[k][0], len(own))]
    while todo:
        ends = walk(todo).filter("state is not null").select("archive_id", "segment", "hdr_offset", "chain", "state", "exit_offset", "members", "detail").collect()
        for r in sorted(ends, key=lambda r: (r["chain"] is None, r["chain"])):
            found[r["archive_id"]][r["segment"]][r["chain"]] = (r["state"], r["exit_offset"], r["members"], r["detail"])
        joined = {k: _joined(Parts([f.path for f in own], [f.size for f in own]), k, found[k], start[k]) for k, own in of.items()}
        todo = [[k, i, at] for k, (_, wrong) in joined.items() for i, at in wrong.items()]
    segments = segment_chain(spark.createDataFrame([r for rows, _ in joined.values() for r in rows] if archives else [], SEGMENTS))
    # the first segment that was walked is taken to be entered where it was said to be
    proven = segments.filter("joined and state <> 'unsupported'").select("archive_id", F.col("idx").alias("segment"), F.col("first_header").alias("chain"))
    stored = spark.read.schema(WALK).parquet(*walked) if walked else spark.createDataFrame([], WALK)
    members = stored.filter("state is null").join(proven, ["archive_id", "segment", "chain"], "left_semi")
    return members.select(*MEMBERS.replace(",", "").split()[::2]), segments


def ask_again(spark: SparkSession, archives: list[dict], members: DataFrame, segments: DataFrame, asked: DataFrame, store: str | None = None, ask: int = 1) -> tuple[DataFrame, DataFrame]:
    """Members and segments of archives after another walk from the segments that ``asked`` (see ``operators.recheck``) says; the rest of the tables stays.

    archives: those that are asked.  The bytes are read anew, whatever earlier walks have stored.
    """
    told = asked.select("archive_id", F.col("again").alias("idx")).join(segments.select("archive_id", "idx", "first_header"), ["archive_id", "idx"]).collect()  # a row for each archive that is asked
    begin = {r["archive_id"]: (r["idx"], r["first_header"] or 0) for r in told}
    new_members, new_segments = index(spark, [a for a in archives if a["archive_id"] in begin], store, begin=begin, ask=ask)
    before = segments.join(asked.select("archive_id", "again"), "archive_id", "left").filter("again is null or idx < again").select(*new_segments.columns)
    return recheck.standing(members, asked).select(*new_members.columns).unionByName(new_members), before.unionByName(new_segments)


def forget_walks(spark: SparkSession, store: str) -> None:
    """Delete the walks below ``store`` once what came of them is written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _digest(told) -> str:
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()[:24]


def stream_member(parts: Parts, hdr_offset: int, *, dir: str, name: str, size: int, chunk: int = CHUNK, tries: int = 0) -> Iterator[bytes]:
    """Content of one member, ``chunk`` bytes at a time.

    Refused if the header there is not the one that was indexed, before the first byte is given; or afterwards, if it no longer is, or
    if what follows the padded data is neither a header, nor the empty blocks of the end, nor the end itself.  With ``tries`` each
    chunk is confirmed by further reads (see ``confirm.chunks``), that many at most.
    """

    def indexed() -> int:
        parts.forget()
        found = list(follow(parts, hdr_offset, hdr_offset + 1, 0, 0))
        if not found or (found[0][10], found[0][11], found[0][4]) != (dir, name, size):
            raise ValueError(f"another member than {dir}/{name} is at {hdr_offset}")
        return found[0][3]

    data = indexed()
    if data + size > parts.total:
        raise ValueError(f"{name} is cut off")
    yield from confirm.chunks(parts.fetch, data, size, chunk, tries)
    if indexed() != data:
        raise ValueError(f"{name} has moved")
    after = parts.fetch(data + -(-size // BLOCK) * BLOCK, BLOCK)
    if after and any(after) and not valid(after):
        raise ValueError(f"{name} is followed by no header")


def read_member(paths: list[str], hdr_offset: int, *, dir: str, name: str, size: int) -> bytes:
    """Content of one small member, refused if its surroundings are not those that were indexed."""
    return b"".join(stream_member(Parts(paths), hdr_offset, dir=dir, name=name, size=size))


def verify_headers(members, archives: list[dict]):
    """Members (DataFrame) whose header no longer says what the index does, read on the executors part by part."""
    of = {a["archive_id"]: (a["parts"], a.get("sizes")) for a in archives}
    columns = MEMBERS.replace(",", "").split()[::2]

    def check(batches):
        import pandas as pd

        for pdf in batches:
            wrong = []
            for archive_id, rows in pdf.groupby("archive_id"):
                parts = Parts(*of[archive_id])
                for i, row in rows.iterrows():
                    found: list[tuple] = []
                    try:
                        found = list(follow(parts, int(row["hdr_offset"]), int(row["hdr_offset"]) + 1, archive_id, int(row["segment"])))
                    except Unsupported:
                        pass
                    wrong.append((i, not found or [*found[0]] != [row[c] for c in columns]))
            bad = pd.Series(dict(wrong), dtype=bool)
            yield pdf[bad.reindex(pdf.index)] if len(pdf) else pdf

    return members.select(*columns).mapInPandas(check, MEMBERS)
