"""Bytes by kind: loose files, tarballs judged by name, and tarballs shared out over the members that an index lists.

Tables: files as in reports; archives(id, name, folder, state, total_size); parts(archive_id, content_hash in hex);
members(archive_id, type, dir, name, size, mtime).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions import paths, values
from ..session import stored
from .reports import under as at_or_below
from .tree import nearest_shown, spread_up

FINISHED = ("complete", "truncated")
#: Share of a folder's bytes from which on it is said to be of one group.
BADGE_SHARE = 0.5


def regular(members: DataFrame) -> DataFrame:
    """Members that are files with content."""
    return members.filter((F.col("size") > 0) & F.col("type").isin("0", "\0", "7"))


def archive_trust(archives: DataFrame, members: DataFrame) -> DataFrame:
    """archives with ``listed`` bytes, ``finished`` and ``trusted``: a finished walk, or at least half the bytes listed, and any at all."""
    listed = regular(members).groupBy(F.col("archive_id").alias("id")).agg(F.sum("size").alias("listed"))
    known = archives.join(listed, "id", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    finished = F.col("state").isin(*FINISHED)
    trusted = (F.col("listed") > 0) & (finished | (F.col("listed") * 2 >= F.col("total_size")))
    return known.withColumns({"finished": finished, "trusted": trusted})


def part_owners(trust: DataFrame, parts: DataFrame) -> DataFrame:
    """Per content hash the archive that owns it: a trusted one first, then a finished one, then the latest."""
    digest = F.lower("content_hash")
    valid = parts.filter(values.hash_bytes(F.col("content_hash")).isNotNull())
    ranked = valid.select(F.col("archive_id").alias("id"), digest.alias("content_hash")).join(trust.select("id", "trusted", "finished"), "id")
    return ranked.groupBy("content_hash").agg(F.max_by("id", F.struct("trusted", "finished", "id")).alias("archive_id"))


def walk(
    files: DataFrame, rules: K.RuleWords | None = None, archives: DataFrame | None = None, parts: DataFrame | None = None, members: DataFrame | None = None, under: str | None = None,
    by_folder: bool = True, tasks: int | None = None,
) -> DataFrame:
    """(folder, kind, size double, how, date): every byte of the listing once.

    A file that is a part of a trusted archive is shared out over that archive's members by their size, dated by their own times;
    one of an untrusted archive, and any tarball, is judged by name with its own date; every other file is dated by its oldest copy, wherever that lies.
    Without ``by_folder`` there is no column ``folder``, for sums over a whole listing.  ``tasks``: among which archives and members are dealt,
    where they are too many for the session's usual number.
    """
    at = ["folder"] if by_folder else []
    # judged where they are read: folders and names are not shuffled for it, and a content is known by 128 bits of its hash
    rows = at_or_below(files, under).withColumn("facts", K.folder_facts(F.lower("folder"), rules)).withColumn("low", F.lower("name"))
    rows = rows.withColumn("own_kind", K.classify(F.col("facts"), F.col("low"), paths.raw_extension(F.col("low"))))
    rows = rows.withColumn("kind", F.when((F.col("own_kind") == "vm") & F.col("facts.keep"), "vm_kept").otherwise(F.col("own_kind")))
    named = (F.col("kind") == "lf_mix") | F.col("low").rlike(K.TARLIKE)
    hashed = files.filter(F.col("content_hash").isNotNull())
    if archives is None:
        k1, k2 = content_key(F.col("content_hash"))
        # files without a hash have no second key, so they meet nothing, and a first one that deals them out
        rows = rows.select(*at, "size", "modified", "kind", named.alias("named"), F.coalesce(k1, F.xxhash64("folder", "name")).alias("k1"), k2.alias("k2"))
        contents = hashed.select(k1.alias("k1"), k2.alias("k2"), "modified").groupBy("k1", "k2").agg(F.min("modified").alias("oldest"))
        date = F.when(F.col("named"), F.col("modified")).otherwise(F.coalesce("oldest", "modified"))
        return shared_by_kind(rows.join(contents, ["k1", "k2"], "left").select(*at, "kind", "size", F.when(F.col("named"), "name").otherwise("loose").alias("how"), date.alias("date")))
    if tasks:
        archives = archives.repartition(tasks, "id")
    trust = archive_trust(archives, members)
    by_name = K.archive_kind(K.folder_facts(F.lower(F.coalesce("folder", F.lit(""))), rules), F.lower("name"))
    # parts have their hashes in either case: all meet by the lower one, dealt out once, and ``cased`` tells a listing's others apart
    k1, k2 = content_key(F.lower("content_hash"))
    cased = F.when(F.col("content_hash") != F.lower("content_hash"), F.xxhash64("content_hash")).otherwise(F.lit(0)).cast("long")
    valid = parts.filter(values.hash_bytes(F.col("content_hash")).isNotNull()).select(F.col("archive_id").alias("id"), k1.alias("k1"), k2.alias("k2"))
    owner = F.max_by(F.struct("id", "trusted", "by_name"), F.struct("trusted", "finished", "id")).alias("owner")
    owners = valid.join(trust.select("id", "trusted", "finished", by_name.alias("by_name")), "id").groupBy("k1", "k2").agg(owner)
    contents = hashed.select(k1.alias("k1"), k2.alias("k2"), cased.alias("c"), "modified").join(owners, ["k1", "k2"], "left").groupBy("k1", "k2", "c").agg(F.min("modified").alias("oldest"), F.any_value("owner").alias("owner"))
    rows = rows.select(*at, "size", "modified", "kind", named.alias("named"), F.coalesce(k1, F.xxhash64("folder", "name")).alias("k1"), k2.alias("k2"), cased.alias("cased"))
    # a third key would have both sides shuffled again; an equality over both sides is none
    same = (rows["k1"] == contents["k1"]) & (rows["k2"] == contents["k2"]) & (F.col("cased").bitwiseXOR(F.col("c")) == 0)
    owned = F.col("owner").isNotNull()
    by_own = owned | F.col("named")
    known = stored(rows.join(contents, same, "left").select(
        *at, "size", F.when(owned, F.col("owner.by_name")).otherwise(F.col("kind")).alias("kind"), F.when(by_own, "name").otherwise("loose").alias("how"),
        F.when(by_own, F.col("modified")).otherwise(F.coalesce("oldest", "modified")).alias("date"), F.when(F.col("owner.trusted"), F.col("owner.id")).alias("archive_id"),
    ))
    loose = shared_by_kind(known.filter("archive_id is null").drop("archive_id"))
    aside = known.filter("archive_id is not null").groupBy("archive_id", *at).agg(F.sum("size").alias("held"))
    # only members of archives that hold something; those of one kind and date count together
    each = archives.groupBy(F.col("id").alias("archive_id")).agg(F.max(F.struct(F.col("name").alias("a_name"), F.col("folder").alias("a_folder"))).alias("a")).join(aside, "archive_id", "left_semi")
    inside = regular(members).select("archive_id", "dir", "name", "size", "mtime")
    if tasks:
        inside = inside.repartition(tasks, "archive_id")
    place = F.lower(F.concat(F.coalesce("a.a_folder", F.lit("")), F.lit("/"), F.col("a.a_name"), F.lit("::"), F.coalesce("dir", F.lit(""))))
    inside = inside.join(each, "archive_id").withColumns({"low": F.lower(F.substring_index("name", "/", -1)), "facts": K.folder_facts(place, rules)})
    grouped = inside.withColumn("kind", K.classify(F.col("facts"), F.col("low"))).groupBy("archive_id", "kind", "mtime").agg(F.sum("size").alias("size"))
    listed = regular(members).groupBy("archive_id").agg(F.sum("size").alias("listed"))
    shared = grouped.join(aside.join(listed, "archive_id"), "archive_id")
    return loose.unionByName(shared_by_kind(shared.select(*at, "kind", (F.col("held") * F.col("size") / F.col("listed")).alias("size"), F.lit("members").alias("how"), F.col("mtime").alias("date"))))


def content_key(content_hash: Column) -> tuple[Column, Column]:
    """128 bits of a hash of whatever form, as two numbers; null for null."""
    known = content_hash.isNotNull()
    return F.when(known, F.xxhash64(content_hash)), F.when(known, F.xxhash64(F.lit("-"), content_hash))


def shared_by_kind(rows: DataFrame) -> DataFrame:
    """Rows of mixed kinds shared out over these."""
    # never empty; outer, or its CASE would be pushed down as a filter
    return rows.withColumn("s", F.explode_outer(K.shares(F.col("kind")))).select(*[c for c in rows.columns if c == "folder"], F.col("s.kind").alias("kind"), (F.col("size") * F.col("s.share")).alias("size"), "how", "date")


def tally(rows: DataFrame, listed: int) -> DataFrame:
    """The cube of a walk in long form: (kind, how, month, age, size) with the sums that all breakdowns need.

    age is the number of years in AGES that the date is strictly older than; rows without bytes are left out.
    """
    ages = sum((F.when(values.older_than(F.col("date"), y, listed), 1).otherwise(0) for y in K.AGES), F.lit(0))
    stamp = F.timestamp_seconds("date")
    months = (F.year(stamp) * 12 + F.month(stamp) - 1).alias("months")  # a number now, text once the sums are few
    cube = rows.filter("size > 0").groupBy("kind", "how", months, ages.alias("age")).agg(F.sum("size").alias("size"))
    year, month = F.call_function("div", F.col("months"), F.lit(12)), F.col("months") % 12 + 1
    return cube.select("kind", "how", F.concat_ws("-", F.when(year.isNotNull(), F.lpad(year.cast("string"), 4, "0")), F.lpad(month.cast("string"), 2, "0")).alias("month"), "age", "size").withColumn("month", F.when(F.col("month") != "", F.col("month")))


def kinds_table(cube: DataFrame) -> DataFrame:
    """Per kind: bytes in loose files and in tarballs."""
    loose = F.when(F.col("how") == "loose", F.col("size")).otherwise(0.0)
    return cube.groupBy("kind").agg(F.sum(loose).alias("loose"), F.sum(F.col("size") - loose).alias("tarred"))


def kinds_by_group(cube: DataFrame) -> DataFrame:
    return kinds_table(cube).groupBy(K.group_of(F.col("kind")).alias("grp")).agg(F.sum("loose").alias("loose"), F.sum("tarred").alias("tarred")).filter(F.col("loose") + F.col("tarred") > 0)


def kinds_by_month(cube: DataFrame) -> DataFrame:
    # dropped by an aggregate: a filter on the month would be pushed below the walk, with its whole CASE
    found = cube.groupBy("kind", "month").agg(F.sum("size").alias("size"), F.count("month").alias("dated"))
    return found.filter("dated > 0").drop("dated")


def kinds_by_year(cube: DataFrame) -> DataFrame:
    """Per group and year: bytes; a year is null where there is no date."""
    year = F.substring("month", 1, 4)
    return cube.groupBy(K.group_of(F.col("kind")).alias("grp"), year.alias("year")).agg(F.sum("size").alias("size"))


def kinds_older(cube: DataFrame) -> DataFrame:
    """Per kind and age in years: bytes strictly older, loose and in tarballs."""
    years = F.explode_outer(F.slice(F.array(*[F.lit(y) for y in K.AGES]), 1, F.col("age"))).alias("years")
    loose = F.when(F.col("how") == "loose", F.col("size")).otherwise(0.0)
    return cube.select("kind", years, loose.alias("loose"), (F.col("size") - loose).alias("tarred")).filter("years is not null").groupBy("kind", "years").agg(F.sum("loose").alias("loose"), F.sum("tarred").alias("tarred"))


def kinds_totals(cube: DataFrame) -> DataFrame:
    """All bytes, and those placed by members, by a tarball's name, and without a date."""
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0.0))
    return cube.agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("total"), of(F.col("how") == "members").alias("members"), of(F.col("how") == "name").alias("by_name"), of(F.col("month").isNull()).alias("undated"))


def folder_kinds(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Per shown folder: bytes by group with all below it, and ``main``: whether it is the largest (ties: the earlier group)."""
    by_folder = rows.filter("size > 0").groupBy("folder", K.group_of(F.col("kind")).alias("grp")).agg(F.sum("size").alias("size"))
    placed = nearest_shown(by_folder, shown).groupBy("shown", "grp").agg(F.sum("size").alias("size"))
    up = spread_up(placed, "shown", "at").groupBy(F.col("at").alias("folder"), "grp").agg(F.sum("size").alias("size")).join(shown.select("folder").distinct(), "folder", "left_semi")
    best = up.groupBy("folder").agg(F.max_by("grp", F.struct("size", -K.group_rank(F.col("grp")))).alias("best"))
    return up.join(best, "folder").select("folder", "grp", "size", (F.col("grp") == F.col("best")).alias("main"))


def badges(rows: DataFrame, shown: DataFrame, share: float = BADGE_SHARE) -> DataFrame:
    """(folder, grp, size, total): shown folders of which one group makes up at least ``share`` of the bytes."""
    found = folder_kinds(rows, shown)
    whole = found.groupBy("folder").agg(F.sum("size").alias("total"))
    return found.filter("main").join(whole, "folder").filter(F.col("size") >= share * F.col("total")).select("folder", "grp", "size", "total")
