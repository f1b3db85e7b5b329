"""Figures of each folder for the tree page: sizes, dates, bytes held elsewhere, and what is picked from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, values
from ..session import stored
from .reports import inside
from .tree import folders_of, rollup, spread_up

# Shares and sizes that decide what is shown.
COLD_YEARS = 2.0
DUP_SHARE, COLD_SHARE = 0.5, 0.9
TINY_FILES, TINY_MEAN = 100_000, 1 << 20
TABLE_ROWS = 25


def folder_figures(files: DataFrame, listed: int) -> DataFrame:
    """Per folder: own_files, files, folders below, kids, size, newest (not after ``listed``) and cold bytes."""
    old = values.older_than(F.col("modified"), COLD_YEARS, listed)
    own = files.groupBy("folder").agg(
        F.count("*").alias("own_files"),
        F.count("*").alias("files"),
        F.sum("size").alias("size"),
        F.max(F.when(F.col("modified") <= listed, F.col("modified"))).alias("newest"),
        F.sum(F.when(old, F.col("size")).otherwise(0)).alias("cold"),
    )
    up = rollup(own.drop("own_files"), ["files", "size", "cold"], maxima=["newest"])
    tree = folders_of(files)
    kids = tree.groupBy(F.col("parent").alias("folder")).agg(F.count("*").alias("kids"))
    below = rollup(tree.select("folder", F.lit(1).alias("folders")), ["folders"]).select("folder", (F.col("folders") - 1).alias("folders"))
    return (
        up.join(below, "folder").join(kids, "folder", "left").join(own.select("folder", "own_files"), "folder", "left")
        .select("folder", F.coalesce("own_files", F.lit(0)).alias("own_files"), "files", "folders", F.coalesce("kids", F.lit(0)).alias("kids"), "size", "newest", "cold")
    )


def with_copies(files: DataFrame, least: int = 1) -> DataFrame:
    """Adds ``copies``: how many files of at least ``least`` bytes hold the same content; 1 without a hash or below that size."""
    counts = files.filter(F.col("content_hash").isNotNull() & (F.col("size") >= least)).groupBy("content_hash").agg(F.count("*").alias("copies")).filter("copies > 1")
    joined = files.join(counts, "content_hash", "left")
    return joined.withColumn("copies", F.when(F.col("size") >= least, F.coalesce("copies", F.lit(1))).otherwise(F.lit(1)))


def common_folder(low: Column, high: Column) -> Column:
    """Deepest folder that is, or is above, both of two paths that each end in "/"; null if there is none."""
    both = F.filter(paths.ancestors(low), lambda a: (a != "") & F.startswith(high, F.concat(a, F.lit("/"))))
    return F.when(low == high, F.regexp_replace(low, "/$", "")).otherwise(F.try_element_at(both, F.lit(-1)))


def held_elsewhere(files: DataFrame, least: int = 1) -> DataFrame:
    """Per folder: bytes of the copies in it whose content also exists outside it.

    A content lies in a folder with all its copies from their deepest common folder upwards, and nowhere below.  So a folder
    holds elsewhere what lies in it, less the whole of each content whose common folder is in it.  The first and the last path of a content
    (with a "/" at the end, so that what stands between two paths of a folder is in that folder) have the common folder of all, so a content is
    one row, and only sums of folders are spread to the ancestors.
    """
    sized = files.filter(F.col("content_hash").isNotNull() & (F.col("size") >= least)).select("content_hash", "folder", "size")
    end = F.concat("folder", F.lit("/"))
    whole = sized.groupBy("content_hash").agg(F.min(end).alias("low"), F.max(end).alias("high"), F.sum("size").alias("held"), F.count("*").alias("n"))
    credit = sized.groupBy("folder").agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    debit = whole.withColumn("folder", common_folder(F.col("low"), F.col("high"))).filter("folder is not null").groupBy("folder").agg((-F.sum("held")).alias("held"), (-F.sum("n")).alias("n"))
    return rollup(credit.unionByName(debit), ["held", "n"]).filter("n > 0").select("folder", "held")


def page_reclaimable(files: DataFrame, folder: str) -> DataFrame:
    """Bytes that could go from below ``folder``: of each content all copies there, less one if there is none elsewhere."""
    here = inside(files, folder)
    groups = (
        files.filter(F.col("content_hash").isNotNull() & (F.col("size") > 0)).groupBy("content_hash")
        .agg(F.count("*").alias("n"), F.count_if(here).alias("m"), F.sum(F.when(here, F.col("size"))).alias("bytes"), F.max(F.when(here, F.col("size"))).alias("most"))
        .filter("n > 1 and m > 0")
    )
    kept = F.when(F.col("m") == F.col("n"), F.col("most")).otherwise(0)
    return groups.agg(F.coalesce(F.sum(F.col("bytes") - kept), F.lit(0)).cast("long").alias("reclaimable"))


def counterparts(files: DataFrame, chosen: DataFrame, floor: int = 1) -> DataFrame:
    """Per chosen folder: the place that holds most of the bytes it also holds, and those bytes.

    ``chosen(folder)`` is an antichain.  A place is the copy's ancestor one level below where the two paths part, no
    shallower than ``floor``; a content's bytes count once for each different place.  Ties go to the first path.
    The paths of a copy and of a chosen folder part at a folder above the chosen one.  So a content is known by the few folders right below one of
    these that hold it, and only they are joined with the chosen folders that hold it, however many folders its copies lie in.
    """
    sized = files.filter(F.col("content_hash").isNotNull() & (F.col("size") > 0))
    mine_folder = chosen.select(F.col("folder").alias("mine")).distinct()
    # what depends on folders only is worked out once for each, not for each file
    folders = sized.select("folder").distinct()
    owners = spread_up(folders, "folder", "mine").join(mine_folder, "mine", "left_semi")
    mine = sized.join(owners, "folder").groupBy("content_hash", "mine").agg(F.sum("size").alias("bytes"))
    # where another path may leave a chosen folder's: at any folder above it, and at the top; next: the chosen folder's own step from there
    up = paths.ancestors(F.col("mine"))
    forks = mine_folder.select("mine", F.posexplode(F.concat(F.array(F.lit("")), up)).alias("k", "fork")).filter(F.col("fork") != F.col("mine"))
    forks = forks.select("mine", "fork", F.element_at(up, F.col("k") + 1).alias("next"))
    there = paths.ancestors(F.col("folder"))
    steps = F.transform(there, lambda a, i: F.struct(F.when(i == 0, "").otherwise(F.element_at(there, F.greatest(i, F.lit(1)))).alias("fork"), a.alias("step"), F.coalesce(F.try_element_at(there, F.greatest(i + 1, F.lit(floor))), F.col("folder")).alias("place")))
    # a copy right in a folder above a chosen one has no step of its own
    steps = F.concat(steps, F.array(F.struct(F.col("folder").alias("fork"), F.lit("").alias("step"), F.col("folder").alias("place"))))
    spots_of = folders.select("folder", F.explode(steps).alias("s")).select("folder", "s.*").join(forks.select("fork").distinct(), "fork", "left_semi")
    # a spot and what it tells a chosen folder are few, and a content's rows have a number for the spot instead of three paths
    spots_of = spots_of.withColumn("spot", F.xxhash64("fork", "step", "place"))
    spots = sized.select("content_hash", "folder").join(spots_of.select("folder", "spot"), "folder").select("content_hash", "spot").distinct()
    told = spots_of.select("spot", "fork", "step", "place").distinct().join(forks, "fork").filter("step <> next").select("spot", "mine", "place")
    credit = (
        mine.join(spots, "content_hash").join(told, ["spot", "mine"])
        .select("content_hash", "mine", "bytes", "place").distinct().groupBy("mine", "place").agg(F.sum("bytes").alias("bytes"))
    )
    best = Window.partitionBy("mine").orderBy(F.desc("bytes"), "place")
    return credit.withColumn("r", F.row_number().over(best)).filter("r = 1").select(F.col("mine").alias("folder"), "place", "bytes")


def _apart(taken: list[str]):
    """Folders that are neither one of ``taken``, nor inside or above one."""
    apart = F.lit(True)
    for t in filter(None, taken):
        above = (F.col("folder") != "") & F.lit(t).startswith(F.concat(F.col("folder"), F.lit("/")))
        apart = apart & (F.col("folder") != t) & ~F.startswith(F.col("folder"), F.lit(t + "/")) & ~above
    return apart & (F.col("folder") != "") if "" in taken else apart


def choose(ranked: DataFrame, limit: int = TABLE_ROWS, at_once: int = 4) -> list:
    """Take rows (with a ``folder``) in their order, skipping folders inside or above one taken, until ``limit`` are.

    The choice depends on its order, so the driver makes it, from the best ``at_once * limit`` rows; if those do not fill
    the table, the executors drop all rows inside or above one taken and give the best of the rest.  A round takes one row at
    least, so there are at most ``limit`` rounds, and the driver never holds more than one round's rows.
    """
    taken: list = []
    inside: set[str] = set()
    above: set[str] = set()
    while True:
        batch = ranked.filter(_apart([r["folder"] for r in taken])).limit(at_once * limit).collect()
        for row in batch:
            steps = row["folder"].split("/")
            chain = ["/".join(steps[:n]) for n in range(2 if row["folder"].startswith("/") else 1, len(steps) + 1)]
            if row["folder"] in above or any(c in inside for c in chain):
                continue
            taken.append(row)
            inside.add(row["folder"])
            above.update(chain)
            if len(taken) == limit:
                return taken
        if len(batch) < at_once * limit:
            return taken


def is_tiny(files: str = "files", size: str = "size"):
    """Very many small files, subfolders included."""
    return (F.col(files) >= TINY_FILES) & (F.col(size) <= F.col(files) * TINY_MEAN)


def ranked_tables(figures: DataFrame, held: DataFrame, threshold: int = 0, dup_share: float = DUP_SHARE) -> dict[str, DataFrame]:
    """Candidates of the tables of duplicated, cold and tiny folders, best first."""
    rows = figures.join(held, "folder", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    big = rows.filter(F.col("size") >= threshold)
    return {
        "dup": big.filter((F.col("held") > 0) & (F.col("held") >= dup_share * F.col("size"))).orderBy(F.desc("held"), "folder"),
        "cold": big.filter((F.col("cold") > 0) & (F.col("cold") >= COLD_SHARE * F.col("size"))).orderBy(F.desc("cold"), "folder"),
        "tiny": rows.filter(is_tiny()).orderBy(F.desc("files"), "folder"),
    }


def layout(files: DataFrame, figures: DataFrame, root: str, threshold: int, max_rows: int) -> tuple[int, DataFrame]:
    """Threshold and rows of the tree page below ``root``: (kind, parent, name, size, files, folders, entries).

    Folders and files of at least the threshold get a row; what is left out of a shown folder folds into one.  The
    threshold doubles until the page fits.  Each entry's size says up to which step it is shown, so the counts for all
    steps come from one pass, and the driver sees one row per step.
    """
    ladder = [threshold]
    for _ in range(64):
        ladder.append(max(ladder[-1] * 2, 1))
    figures = stored(figures)

    def level(size):
        """Last step at which an entry of this size is shown; -1 for none.  Steps double, so it is a number of binary digits."""
        whole = F.length(F.bin(F.call_function("div", size.cast("long"), F.lit(max(threshold, 1)))))
        return F.when(size >= max(threshold, 1), whole - (1 if threshold > 0 else 0)).when(size >= threshold, 0).otherwise(-1)

    dirs = figures.filter(inside(figures, root)).withColumns({"parent": paths.parent(F.col("folder")), "level": level(F.col("size"))})
    dirs = dirs.withColumn("level", F.when(F.lower("folder") == root.lower(), len(ladder)).otherwise(F.col("level")))
    own = files.filter(inside(files, root)).select("folder", "name", "size", level(F.col("size")).alias("level"))
    children = dirs.filter(F.lower("folder") != root.lower()).select(F.col("parent").alias("folder"), "level").unionByName(own.select("folder", "level"))
    least = children.groupBy("folder").agg(F.min("level").alias("least"))
    # a shown folder has a fold at a step once one of its entries is not shown there
    each = dirs.join(least, "folder", "left")
    counts = each.select(F.col("level").alias("shown"), F.coalesce("least", F.lit(len(ladder))).alias("least")).groupBy("shown", "least").agg(F.count("*").alias("n")).collect()
    own_counts = {r["level"]: r["n"] for r in own.groupBy("level").agg(F.count("*").alias("n")).collect()}
    top = figures.filter(F.lower("folder") == root.lower()).select("size").first()
    step = 0
    for step in range(len(ladder)):
        rows = sum(r["n"] * (1 + (r["least"] < step)) for r in counts if r["shown"] >= step) + sum(n for at, n in own_counts.items() if at >= step)
        if rows <= max_rows or ladder[step] > (top["size"] if top else 0):
            break
    shown_dirs, shown_files = dirs.filter(F.col("level") >= step), own.filter(F.col("level") >= step)
    dir_rows = shown_dirs.select(F.lit("dir").alias("kind"), F.when(F.lower("folder") == root.lower(), F.lit(None)).otherwise(F.col("parent")).alias("parent"), F.col("folder").alias("name"), "size", "files", "folders", F.lit(0).cast("long").alias("entries"))
    file_rows = shown_files.select(F.lit("file").alias("kind"), F.col("folder").alias("parent"), "name", "size", F.lit(1).cast("long").alias("files"), F.lit(0).cast("long").alias("folders"), F.lit(0).cast("long").alias("entries"))
    taken = (
        dir_rows.filter("parent is not null").select("parent", "size", "files", (F.col("folders") + 1).alias("folders"), F.lit(1).alias("n"))
        .unionByName(file_rows.select("parent", "size", "files", "folders", F.lit(1).alias("n")))
        .groupBy("parent").agg(*[F.sum(c).alias("t_" + c) for c in ("size", "files", "folders", "n")])
    )
    rest = shown_dirs.join(taken, shown_dirs["folder"] == taken["parent"], "left").select(
        F.lit("fold").alias("kind"), F.col("folder").alias("parent"), F.lit("").alias("name"),
        *[(F.col(c) - F.coalesce("t_" + c, F.lit(0))).cast("long").alias(c) for c in ("size", "files", "folders")],
        (F.col("kids") + F.col("own_files") - F.coalesce("t_n", F.lit(0))).cast("long").alias("entries"),
    ).filter("entries > 0")
    return ladder[step], dir_rows.unionByName(file_rows).unionByName(rest)
