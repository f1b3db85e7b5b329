"""Archives in parts: finding them in a listing, their parts and segments, and reports on their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, values
from .ranges import cumulative_offset

# Names of parts and of compressed archives.
PART = r"^(.*\.tar)\.(?:part[-_]?)?([a-z]{2,}|\d{2,})$"
COMPRESSED = r"\.(tgz|tar\.(gz|bz2|xz|zst|lz4|lzma|z))$"
SEGMENT_DONE = ("crossed", "complete", "truncated", "corrupt")


def candidate_files(files: DataFrame) -> DataFrame:
    """Files whose names look like tar archives, each with its base name and what it is: whole, part, compressed or other."""
    looks = F.lower("name").rlike(r"\.tar$|\.tar\.|\.tgz$")
    base = F.regexp_extract("name", PART, 1)
    kind = F.when(F.lower("name").rlike(COMPRESSED), "compressed").when(F.endswith("name", F.lit(".tar")), "whole").when(base != "", "part").otherwise("other")
    return files.filter(looks).withColumn("what", kind).withColumn("base", F.when(F.col("what") == "whole", F.col("name")).when(F.col("what") == "part", base))


def skipped(files: DataFrame) -> DataFrame:
    """Files and bytes that were passed over: compressed archives, and other names with ".tar" in them."""
    return candidate_files(files).filter(F.col("what").isin("compressed", "other")).groupBy("what").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def part_rows(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every file that belongs to a candidate (folder, base), with suffix, its number, and the part's offset; in ``tasks`` partitions, if given.

    A file belongs to every base in its folder that its name begins with; those that are no well-formed part are marked ``foreign``.
    """
    found = candidate_files(files).filter("base is not null").select("folder", "base")
    found = (found.repartition(tasks, "folder", "base") if tasks else found).distinct()
    # names that begin with a base have it up to ".tar", so bases are looked up by equality
    stems = F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\.tar", -1)) - 1), lambda n: F.concat(F.array_join(F.slice(F.split("name", r"\.tar", -1), 1, n), ".tar"), F.lit(".tar")))
    tarred = files.filter(F.contains("name", F.lit(".tar"))).withColumn("base", F.explode(F.array_distinct(stems)))
    if tasks:
        tarred = tarred.repartition(tasks, "folder", "base")
    rows = tarred.join(found, ["folder", "base"])
    rest = F.expr("substring(name, length(base) + 1)")
    suffix = F.regexp_extract(rest, r"^\.(?:part[-_]?)?([a-z]{2,}|\d{2,})$", 1)
    rows = rows.withColumn("suffix", suffix).withColumn("whole", F.col("name") == F.col("base"))
    rows = rows.withColumn("foreign", ~F.col("whole") & (F.col("suffix") == "")).withColumn("number", paths.suffix_value(F.col("suffix")))
    return rows.withColumn("offset", cumulative_offset([F.col("number"), F.col("name")], ["folder", "base"]))


def candidate_sets(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(folder, name, size, n_parts, set_hash, status, detail): archives that the listing holds, whole or in parts.

    ``tasks``: of the steps that bring a set's parts together, for listings that are too large for the session's usual number.
    status: ok, copy (of an earlier one in order of size, folder and name with the same parts) or refused, with the reason.
    """
    rows = part_rows(files, tasks)
    entry = F.struct("number", "name", F.coalesce(F.lower("content_hash"), F.lit("")).alias("content_hash"), "size")
    length, digits = F.when(~F.col("whole"), F.length("suffix")), F.when(~F.col("whole"), F.col("suffix").rlike(r"^\d+$"))
    sets = rows.groupBy("folder", "base").agg(
        F.sum("size").alias("size"), F.count("*").cast("int").alias("n_parts"), F.count_if("whole").alias("wholes"), F.count_if("foreign").alias("foreigns"),
        F.min(length).alias("narrow"), F.max(length).alias("wide"), F.min(digits).alias("style"), F.max(digits).alias("other_style"),
        F.min("number").alias("first"), F.max("number").alias("last"), F.min("suffix").alias("lowest"), F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    numbers = F.size(F.array_distinct(F.transform("entries", lambda e: e["number"])))
    holder = F.regexp_extract(F.substring_index("folder", "/", -1), PART, 1)
    reason = (
        F.when(holder == F.col("base"), "its parts are in separate folders")
        .when((F.col("wholes") > 0) & (F.col("n_parts") > 1), "it exists alongside other files of its name")
        .when(F.col("wholes") > 0, F.lit(None).cast("string"))
        .when(F.col("foreigns") > 0, "a file is not a part of it")
        .when(F.col("narrow") < F.col("wide"), "mixed suffix widths")
        .when(F.col("style") != F.col("other_style"), "mixed suffix styles")
        .when(F.col("first") > F.when(F.col("lowest").rlike(r"^\d"), 1).otherwise(0), "its first part is missing")
        .when(F.col("last") - F.col("first") + 1 != numbers, "a part is missing")
    )
    # kept as a table would be: the first of each identity is found by a minimum, so copies of one set need no task of their own
    judged = sets.withColumn("reason", reason).withColumn("set_hash", F.when(F.col("reason").isNull(), values.set_hash(F.col("entries"))).otherwise("")).drop("entries")
    fine = F.col("reason").isNull()
    path = F.concat("folder", F.lit("/"), "base")
    first = judged.filter(fine).groupBy("set_hash").agg(F.min(F.struct((-F.col("size")).alias("s"), "folder", "base")).alias("first"))
    first = first.select(F.col("set_hash").alias("same"), F.concat("first.folder", F.lit("/"), "first.base").alias("lead"))
    copy = fine & (F.col("lead") != path)
    # refused sets have no hash in common with any: each goes by its path, which has a "/", so they are not all one task's
    judged = judged.withColumn("same", F.when(fine, F.col("set_hash")).otherwise(path))
    return judged.join(first, "same", "left").select(
        "folder", F.col("base").alias("name"), "size", "n_parts", "set_hash",
        F.when(~fine, "refused").when(copy, "copy").otherwise("ok").alias("status"),
        F.when(~fine, F.col("reason")).when(copy, F.concat(F.lit("copy of "), "lead")).otherwise("").alias("detail"),
    )


def part_gaps(parts: DataFrame, keys: list[str], number: str = "number") -> DataFrame:
    """Parts before which at least one number is missing: ``missing_from`` and ``missing`` of them."""
    order = Window.partitionBy(*keys).orderBy(number)
    before = F.lag(number).over(order)
    return parts.withColumn("missing_from", before + 1).withColumn("missing", F.col(number) - before - 1).filter("missing > 0")


def seed_segments(parts: DataFrame, keep: list[str] = []) -> DataFrame:
    """A segment for each part: from its offset to the next part's; the last one has no stop.  Columns to ``keep`` follow."""
    order = Window.partitionBy("archive_id").orderBy("idx")
    return parts.select("archive_id", "idx", F.col("offset").alias("scan_from"), F.lead("offset").over(order).alias("stop_at"), F.lit("pending").alias("state"), *keep)


def segment_chain(segments: DataFrame) -> DataFrame:
    """Adds ``joined``: the chain of headers is proven from the first segment to this one.

    A link holds if the segment's first header is where the one before, itself crossed, left off; the first segment holds by itself.
    """
    order = Window.partitionBy("archive_id").orderBy("idx")
    link = F.when(F.row_number().over(order) == 1, True).otherwise(F.coalesce((F.lag("state").over(order) == "crossed") & (F.col("first_header") == F.lag("exit_offset").over(order)), F.lit(False)))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("_link", link).withColumn("joined", F.min("_link").over(running)).drop("_link")


def chain_ending(segments: DataFrame) -> DataFrame:
    """Per archive its first segment that was not crossed, and the state that decides the archive's."""
    open_ = segments.filter("state <> 'crossed'")
    return open_.groupBy("archive_id").agg(F.min("idx").alias("idx"), F.min_by("state", "idx").alias("state"))


def coverage(segments: DataFrame, archives: DataFrame) -> DataFrame:
    """Bytes of each archive that its segments have been read to; a segment counts no further than its end, and nothing if retired."""
    end = F.coalesce(F.col("stop_at"), F.col("total_size"))
    reached = F.when(F.col("state") == "beyond", F.col("scan_from")).when(F.col("state").isin("crossed", "complete", "truncated"), end).otherwise(F.coalesce("cursor_offset", "scan_from"))
    part = F.greatest(F.least(reached, end) - F.col("scan_from"), F.lit(0))
    sized = segments.join(archives.select(F.col("id").alias("archive_id"), "total_size"), "archive_id")
    return sized.groupBy("archive_id").agg(F.sum(part).cast("long").alias("covered"))


def repeated_paths(members: DataFrame) -> DataFrame:
    """Members whose path occurs more than once in their archive."""
    n = F.count("*").over(Window.partitionBy("archive_id", "dir", "name"))
    return members.withColumn("times", n).filter("times > 1")


def follows(members: DataFrame, width: int = 1 << 30) -> DataFrame:
    """Adds ``next_header``, and ``contiguous``: whether it is where this member's padded data ends.

    An archive is sorted in stretches of ``width`` bytes; a stretch's last member is followed by the first of the next stretch that has any.
    """
    rows = members.withColumn("_stretch", F.floor(F.col("hdr_offset") / F.lit(width)))
    firsts = rows.groupBy("archive_id", "_stretch").agg(F.min("hdr_offset").alias("_first"))
    firsts = firsts.select("archive_id", "_stretch", F.lead("_first").over(Window.partitionBy("archive_id").orderBy("_stretch")).alias("_after"))
    inside = F.lead("hdr_offset").over(Window.partitionBy("archive_id", "_stretch").orderBy("hdr_offset"))
    rows = rows.withColumn("_inside", inside).join(firsts, ["archive_id", "_stretch"]).withColumn("next_header", F.coalesce("_inside", "_after"))
    rows = rows.withColumn("contiguous", F.col("next_header") == F.col("data_offset") + values.tar_padded(F.col("size")))
    return rows.select(*members.columns, "next_header", "contiguous")


def extended_headers(members: DataFrame) -> DataFrame:
    """Members whose header takes more than one block."""
    return members.filter((F.col("data_offset") - F.col("hdr_offset")) > values.TAR_BLOCK)


def summary(members: DataFrame) -> DataFrame:
    """(archive_id, section, key, members, bytes): totals by folder to three depths, extension, owner and type, from one scan.

    Members are counted by all their keys together first; each of these rows is then expanded to its key in every section.
    """
    owner = F.concat(F.coalesce("uname", F.lit("")), F.lit(":"), F.coalesce("gname", F.lit("")))
    ext = F.coalesce(F.nullif(paths.extension(F.col("name")), F.lit("")), F.lit("(none)"))
    is_file = F.coalesce((F.col("size") > 0) & F.col("type").isin("0", "\0", "7"), F.lit(False))
    of_file = {f"dir{n}": paths.dir_prefix(F.col("dir"), n) for n in (1, 2, 3)} | {"ext": ext}
    keys = {"owner": owner, "type": F.coalesce("type", F.lit(""))} | {k: F.when(is_file, c) for k, c in of_file.items()}
    told = members.select("archive_id", "size", is_file.alias("is_file"), *[c.alias(k) for k, c in keys.items()])
    told = told.groupBy("archive_id", "is_file", *keys).agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))
    pair = lambda s, k: F.struct(F.lit(s).alias("section"), k.alias("key"))
    always = F.array(pair("total", F.lit("")), *[pair(k, F.col(k)) for k in ("owner", "type")])
    every = F.when(F.col("is_file"), F.concat(always, F.array(*[pair(k, F.col(k)) for k in of_file]))).otherwise(always)
    told = told.select("archive_id", "members", "bytes", F.explode(every).alias("k"))
    return told.groupBy("archive_id", "k.section", "k.key").agg(F.sum("members").alias("members"), F.sum("bytes").alias("bytes"))


def time_span(members: DataFrame) -> DataFrame:
    return members.groupBy("archive_id").agg(F.min("mtime").alias("first"), F.max("mtime").alias("last"))


def largest_members(members: DataFrame, k: int = 25) -> DataFrame:
    """Per archive its k largest members; ties by where they lie."""
    order = Window.partitionBy("archive_id").orderBy(F.desc("size"), "hdr_offset")
    return members.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def manifest(members: DataFrame) -> DataFrame:
    """A line for each member, in order, in the form of the export."""
    path = paths.full_path(F.col("dir"), F.col("name"))
    return members.orderBy("archive_id", "hdr_offset").select("archive_id", path.alias("path"), "type", "size", values.octal_mode(F.col("mode")).alias("mode"), values.iso(F.col("mtime")).alias("mtime"), "uname", "gname", "hdr_offset", "data_offset", "linkname")


def by_state(archives: DataFrame) -> DataFrame:
    return archives.groupBy("state").agg(F.count("*").alias("archives"), F.sum("total_size").alias("bytes"))


def latest_live(archives: DataFrame, keys: list[str]) -> DataFrame:
    """Per name (and folder): the newest registration that is not stale, or the newest of all if every one is."""
    order = Window.partitionBy(*keys).orderBy(F.col("state") == "stale", F.desc("id"))
    return archives.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def mark_superseded(archives: DataFrame) -> DataFrame:
    """All but the latest live registration of the same name and folder (null folders are equal) become stale."""
    order = Window.partitionBy("name", "folder").orderBy(F.col("state") == "stale", F.desc("created_at"), F.desc("id"))
    return archives.withColumn("state", F.when(F.row_number().over(order) > 1, "stale").otherwise(F.col("state")))


def latest_event(events: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    return events.filter(F.col("kind") == kind).groupBy(*keys).agg(F.max("ts").alias("ts"), F.max_by("detail", F.struct("ts", "detail")).alias("detail"))


def changed_parts(parts: DataFrame, listing: DataFrame) -> DataFrame:
    """Registered parts against what lies there now, matched by id or else by name: (archive_id, idx, change), one row for each part.

    change: missing, resized or rewritten; unchanged parts are left out.  If both tables have a ``folder``, names are those of one folder.
    Where a name is listed more than once, a part that any of these equals is unchanged; else the one of the smallest size (then hash) is what it changed to.
    """
    name = ["folder", "name"] if "folder" in parts.columns and "folder" in listing.columns else ["name"]
    state = F.struct("size", F.col("content_hash").alias("hash"))
    by_id = listing.filter("id is not null and id <> ''").groupBy(F.col("id").alias("file_id")).agg(F.min(state).alias("of_id"))
    by_name = listing.groupBy(*name).agg(F.min(state).alias("of_name"))
    equal = listing.select(*name, "size", F.coalesce("content_hash", F.lit("")).alias("_hash")).distinct().withColumn("_equal", F.lit(True))
    rows = parts.withColumn("_hash", F.coalesce("content_hash", F.lit(""))).join(by_id, "file_id", "left").join(by_name, name, "left").join(equal, [*name, "size", "_hash"], "left")
    found = F.coalesce("of_id", "of_name")
    change = (
        F.when(found.isNull(), "missing").when(F.col("of_id").isNull() & F.col("_equal"), None).when(found["size"] != F.col("size"), "resized")
        .when(~found["hash"].eqNullSafe(F.col("content_hash")), "rewritten")
    )
    return rows.select("archive_id", "idx", change.alias("change")).filter("change is not null")


def run_plan(candidates: DataFrame, archives: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidates with what is to be done: new, resume, done, copy or refused; largest first, each with its segments and the number of its copies.

    The copies themselves are the rows of status copy with the same set_hash (see :func:`copies_of`).
    """
    counted = segments.groupBy(F.col("archive_id").alias("id")).agg(F.count("*").alias("segments"))
    known = latest_live(archives, ["set_hash"]).join(counted, "id", "left").select("set_hash", "state", F.coalesce("segments", F.lit(0)).alias("segments"))
    copies = candidates.filter("status = 'copy'").groupBy("set_hash").agg(F.count("*").alias("copies"))
    own = candidates.join(known, "set_hash", "left").join(copies, "set_hash", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    job = F.when(F.col("status") != "ok", F.col("status")).when(F.col("state").isin("complete", "truncated", "corrupt", "unsupported"), "done").when(F.col("state").isNotNull(), "resume").otherwise("new")
    return own.withColumn("job", job).orderBy(F.desc("size"), "folder", "name")


def copies_of(candidates: DataFrame) -> DataFrame:
    """(folder, name, copy): every copy beside the set of its identity that stays, one row for each."""
    first = candidates.filter("status = 'ok'").select("set_hash", "folder", "name")
    return candidates.filter("status = 'copy'").select("set_hash", F.concat("folder", F.lit("/"), "name").alias("copy")).join(first, "set_hash").select("folder", "name", "copy")


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("job").agg(F.count("*").alias("jobs"), F.sum("size").alias("bytes"))


def same_content(members: DataFrame, keys: list[str] = ["archive_id"]) -> DataFrame:
    """Groups of members of one name and size, with their clusters of equal ``signature`` and the copies that are redundant."""
    clusters = members.groupBy(*keys, "name", "size", "signature").agg(F.count("*").alias("n"))
    return clusters.groupBy(*keys, "name", "size").agg(F.sum("n").alias("members"), F.count("*").alias("contents"), F.sum(F.col("n") - 1).alias("redundant")).filter("members > 1")
