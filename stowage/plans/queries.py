"""Registered queries over the adapters, each with the same question in DuckDB's SQL where SQL can put it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinds as KF
from ..functions import paths, values
from ..operators import archives as A
from ..operators import catalogs as C
from ..operators import figures as G
from ..operators import blocks as B
from ..operators import ingest, ranges, recheck, votes
from ..operators import kinds as K
from ..operators import reports as R
from ..operators import tree as T
from ..session import work_dir
from ..streaming import events as E
from ..streaming import shards as S
from .adapters import ARCHIVES_SQL, FILES_SQL, LISTED, MEMBERS_SQL, SAMPLE_ROWS_SQL, SAMPLE_RULES, archives, files, members, sample_files, sample_index, table, tasks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def listing(rest: str) -> str:
    return f"WITH {FILES_SQL} {rest}"


YEAR = 365.25 * 86400


# ---- listing reports


@query(listing("SELECT ancestor AS folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files JOIN up USING (folder) GROUP BY 1"))
def folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.folder_rollup(files(spark, sf_dir))


@query(listing("SELECT ancestor AS folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files JOIN up USING (folder) GROUP BY 1 ORDER BY bytes DESC, folder LIMIT 20"))
def top_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_folders(files(spark, sf_dir), 20)


@query(listing("SELECT ancestor AS folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files JOIN up USING (folder) WHERE len(string_split(ancestor, '/')) = 2 GROUP BY 1"))
def top_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_level(files(spark, sf_dir))


@query(listing("SELECT CAST(sum(size) AS BIGINT) AS live_bytes, CAST(1000000000000 AS BIGINT) AS reported_bytes, CAST(1000000000000 - sum(size) AS BIGINT) AS residual_bytes FROM files"))
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile(files(spark, sf_dir), 1_000_000_000_000)


GROUPS_SQL = """SELECT content_hash, count(*) AS copies, max(size) AS size, CAST(sum(size) - max(size) AS BIGINT) AS reclaimable, min(folder || '/' || name) AS example
  FROM files WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""


@query(listing(GROUPS_SQL + " ORDER BY reclaimable DESC, content_hash LIMIT 50"))
def duplicates_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates_top(files(spark, sf_dir))


@query(listing(f"SELECT count(*) AS groups, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS reclaimable FROM ({GROUPS_SQL})"))
def duplicates_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicates_total(files(spark, sf_dir))


@query(listing("SELECT CAST(year(make_timestamp(modified * 1000000)) AS INTEGER) AS year, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1"))
def cold_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cold_by_year(files(spark, sf_dir))


@query(listing(f"SELECT CAST(y AS DOUBLE) AS years, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files, unnest([2.0, 5.0, 10.0]) AS t(y) WHERE modified < {LISTED} - y * {YEAR} GROUP BY 1"))
def older_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.older_than(files(spark, sf_dir), [2.0, 5.0, 10.0], LISTED)


@query(listing("SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, avg(size) AS mean FROM files GROUP BY 1 HAVING count(*) >= 50 AND avg(size) <= 700000 ORDER BY files DESC, folder LIMIT 25"))
def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.hotspots(files(spark, sf_dir), 50, 700_000, 25)


@query(listing("SELECT coalesce(nullif(ext, ''), '(none)') AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY 1 ORDER BY bytes DESC, ext LIMIT 40"))
def extension_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extension_profile(files(spark, sf_dir))


@query(listing("SELECT coalesce(nullif(ext, ''), '(none)') AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE folder = '/asia' OR (folder >= '/asia/' AND folder < '/asia0') GROUP BY 1"))
def subtree_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.extension_profile(files(spark, sf_dir), folder="/Asia/")


@query(listing("""SELECT f.id, coalesce(o.oldest, f.modified) AS oldest FROM files f LEFT JOIN (
  SELECT content_hash, min(modified) AS oldest FROM files WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1) o USING (content_hash)"""))
def oldest_copy_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.oldest_copy(files(spark, sf_dir)).select("id", "oldest")


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return o.select(F.col("o_orderkey").alias("id"), state.alias("state"), F.floor("o_totalprice").cast("long").alias("bytes"), F.col("o_custkey").alias("n_files"), F.lit(1).cast("long").alias("n_dirs"), F.lit(2).cast("long").alias("pages"))


@query("""SELECT count(*) AS shards, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed,
  CAST(sum(o_custkey) AS BIGINT) AS n_files, count(*) AS n_dirs, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes, 2 * count(*) AS pages FROM orders""")
def shard_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.progress(_shards(spark, sf_dir))


@query(listing("""SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, (SELECT count(*) FROM orders) AS shards, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS pending,
  CAST(0 AS BIGINT) AS running, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) AS error FROM files"""))
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stats(files(spark, sf_dir), _shards(spark, sf_dir))


@query("SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders WHERE o_orderstatus NOT IN ('F', 'O') ORDER BY o_orderkey LIMIT 5")
def error_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.errors_preview(_shards(spark, sf_dir).dropDuplicates(["id"])).select("id", "bytes")


# ---- tree figures


@query(listing(f"""
, own AS (SELECT folder, count(*) AS own_files, CAST(sum(size) AS BIGINT) AS size, max(CASE WHEN modified <= {LISTED} THEN modified END) AS newest,
    CAST(sum(CASE WHEN modified < {LISTED} - 2 * {YEAR} THEN size ELSE 0 END) AS BIGINT) AS cold FROM files GROUP BY 1),
tree AS (SELECT DISTINCT ancestor AS folder, regexp_replace(ancestor, '/[^/]*$', '') AS parent FROM up),
pairs AS (SELECT a.folder, b.folder AS below FROM tree a JOIN tree b ON starts_with(b.folder, a.folder || '/')),
deep AS (SELECT folder, count(*) AS n FROM pairs GROUP BY 1), kid AS (SELECT parent AS folder, count(*) AS n FROM tree GROUP BY 1)
SELECT t.folder, coalesce(max(o2.own_files), 0) AS own_files, CAST(sum(o.own_files) AS BIGINT) AS files, coalesce(max(d.n), 0) AS folders, coalesce(max(k.n), 0) AS kids,
  CAST(sum(o.size) AS BIGINT) AS size, max(o.newest) AS newest, CAST(sum(o.cold) AS BIGINT) AS cold
FROM tree t JOIN up u ON u.ancestor = t.folder JOIN own o ON o.folder = u.folder LEFT JOIN own o2 ON o2.folder = t.folder LEFT JOIN deep d ON d.folder = t.folder LEFT JOIN kid k ON k.folder = t.folder
GROUP BY t.folder"""))
def folder_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.folder_figures(files(spark, sf_dir), LISTED)


HELD_SQL = """, whole AS (SELECT content_hash, count(*) AS copies FROM files WHERE content_hash IS NOT NULL AND size >= 1 GROUP BY 1 HAVING count(*) > 1),
inside AS (SELECT content_hash, ancestor AS folder, count(*) AS n, sum(size) AS bytes, max(copies) AS copies FROM files JOIN whole USING (content_hash) JOIN up USING (folder) GROUP BY 1, 2),
held AS (SELECT folder, CAST(sum(bytes) AS BIGINT) AS held FROM inside WHERE n < copies GROUP BY 1)"""


@query(listing(HELD_SQL + " SELECT folder, held FROM held"))
def held_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.held_elsewhere(files(spark, sf_dir))


@query(listing("""SELECT CAST(sum(bytes - CASE WHEN m = n THEN most ELSE 0 END) AS BIGINT) AS reclaimable FROM (
  SELECT content_hash, count(*) AS n, count(*) FILTER (here) AS m, sum(size) FILTER (here) AS bytes, max(size) FILTER (here) AS most
  FROM (SELECT *, folder = '/europe' OR starts_with(folder, '/europe/') AS here FROM files WHERE content_hash IS NOT NULL AND size > 0) GROUP BY 1) WHERE n > 1 AND m > 0"""))
def page_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_reclaimable(files(spark, sf_dir), "/europe")


@query(listing("""SELECT id, CASE WHEN content_hash IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY content_hash) END AS copies FROM files"""))
def copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_copies(files(spark, sf_dir)).select("id", F.col("copies").cast("long").alias("copies"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name")).alias("folder"))


@query(listing(""", chosen AS (SELECT '/' || lower(r_name) || '/' || lower(n_name) AS mine FROM nation JOIN region ON n_regionkey = r_regionkey),
many AS (SELECT content_hash FROM files WHERE content_hash IS NOT NULL AND size > 0 GROUP BY 1 HAVING count(*) > 1),
own AS (SELECT f.content_hash, f.folder, f.size, u.ancestor AS mine FROM files f JOIN many USING (content_hash) JOIN up u ON u.folder = f.folder JOIN chosen c ON c.mine = u.ancestor WHERE f.size > 0),
mine AS (SELECT content_hash, mine, sum(size) AS bytes FROM own GROUP BY 1, 2),
pair AS (SELECT m.content_hash, m.mine, m.bytes, o.folder AS there, string_split(m.mine, '/') AS a, string_split(o.folder, '/') AS b FROM mine m JOIN (SELECT DISTINCT content_hash, folder, mine FROM own) o ON o.content_hash = m.content_hash AND o.mine <> m.mine),
spot AS (SELECT DISTINCT content_hash, mine, bytes, CASE WHEN a[2] <> b[2] THEN '/' || b[2] ELSE '/' || b[2] || '/' || b[3] END AS place FROM pair),
credit AS (SELECT mine, place, CAST(sum(bytes) AS BIGINT) AS bytes FROM spot GROUP BY 1, 2)
SELECT mine AS folder, place, bytes FROM (SELECT *, row_number() OVER (PARTITION BY mine ORDER BY bytes DESC, place) AS r FROM credit) WHERE r = 1"""))
def copy_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.counterparts(files(spark, sf_dir), _nations(spark, sf_dir))


@query(listing(HELD_SQL + """, sized AS (SELECT ancestor AS folder, CAST(sum(size) AS BIGINT) AS size FROM files JOIN up USING (folder) GROUP BY 1)
SELECT folder, size, held FROM sized JOIN held USING (folder) WHERE held >= 0.3 * size ORDER BY held DESC, folder LIMIT 100"""))
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return G.ranked_tables(G.folder_figures(f, LISTED), G.held_elsewhere(f), dup_share=0.3)["dup"].select("folder", "size", "held").limit(100)


@query("WITH RECURSIVE " + listing(HELD_SQL + """, sized AS (SELECT ancestor AS folder, CAST(sum(size) AS BIGINT) AS size FROM files JOIN up USING (folder) GROUP BY 1),
ranked AS (SELECT row_number() OVER (ORDER BY held DESC, folder) AS k, folder, size, held FROM sized JOIN held USING (folder) WHERE held >= 0.3 * size),
walk AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken
  UNION ALL
  SELECT r.k, CASE WHEN len(w.taken) >= 25 OR len(list_filter(w.taken, lambda t: t = r.folder OR starts_with(r.folder, t || '/') OR starts_with(t, r.folder || '/'))) > 0 THEN w.taken ELSE list_append(w.taken, r.folder) END
  FROM walk w JOIN ranked r ON r.k = w.k + 1)
SELECT folder, size, held FROM ranked WHERE list_contains((SELECT arg_max(taken, k) FROM walk), folder)""").removeprefix("WITH "))
def chosen_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    ranked = G.ranked_tables(G.folder_figures(f, LISTED), G.held_elsewhere(f), dup_share=0.3)["dup"].select("folder", "size", "held")
    return spark.createDataFrame([tuple(r) for r in G.choose(ranked)], ranked.schema)


@query(listing(""", here AS (SELECT * FROM files WHERE folder = '/asia' OR starts_with(folder, '/asia/')),
tree AS (SELECT DISTINCT u.ancestor AS folder, regexp_replace(u.ancestor, '/[^/]*$', '') AS parent FROM here JOIN up u ON u.folder = here.folder WHERE u.ancestor = '/asia' OR starts_with(u.ancestor, '/asia/')),
own AS (SELECT folder, count(*) AS n, sum(size) AS size FROM here GROUP BY 1),
dirs AS (SELECT t.folder, t.parent, CAST(sum(o.size) AS BIGINT) AS size, CAST(sum(o.n) AS BIGINT) AS files, (SELECT count(*) FROM tree b WHERE starts_with(b.folder, t.folder || '/')) AS folders, (SELECT count(*) FROM tree b WHERE b.parent = t.folder) + coalesce((SELECT n FROM own WHERE own.folder = t.folder), 0) AS entries
  FROM tree t JOIN up u ON u.ancestor = t.folder JOIN own o ON o.folder = u.folder GROUP BY t.folder, t.parent),
steps AS (SELECT k, CAST(1048576 * CAST(power(2, k) AS BIGINT) AS BIGINT) AS t FROM unnest(range(0, 40)) AS r(k)),
inside AS (SELECT parent AS folder, size FROM dirs WHERE folder <> '/asia' UNION ALL SELECT folder, size FROM here),
least AS (SELECT folder, min(size) AS size FROM inside GROUP BY 1),
of_dirs AS (SELECT k, count(*) + count(*) FILTER (l.size < t) AS n FROM steps, dirs d LEFT JOIN least l ON l.folder = d.folder WHERE d.size >= t OR d.folder = '/asia' GROUP BY 1),
of_files AS (SELECT k, count(*) AS n FROM steps, here WHERE size >= t GROUP BY 1),
at_ AS (SELECT min(t) AS t FROM steps LEFT JOIN of_dirs USING (k) LEFT JOIN of_files USING (k) WHERE coalesce(of_dirs.n, 0) + coalesce(of_files.n, 0) <= 500 OR t > (SELECT size FROM dirs WHERE folder = '/asia')),
shown AS (SELECT dirs.* FROM dirs, at_ WHERE size >= t OR folder = '/asia'), loose AS (SELECT here.* FROM here, at_ WHERE size >= t),
taken AS (SELECT parent, sum(size) AS size, sum(files) AS files, sum(folders) AS folders, count(*) AS n FROM (SELECT parent, size, files, folders + 1 AS folders FROM shown WHERE folder <> '/asia' UNION ALL SELECT folder, size, 1, 0 FROM loose) GROUP BY 1)
SELECT 'dir' AS kind, CASE WHEN folder <> '/asia' THEN parent END AS parent, folder AS name, size, files, folders, CAST(0 AS BIGINT) AS entries FROM shown
UNION ALL SELECT 'file', folder, name, size, 1, 0, 0 FROM loose
UNION ALL SELECT 'fold', s.folder, '', CAST(s.size - coalesce(t.size, 0) AS BIGINT), CAST(s.files - coalesce(t.files, 0) AS BIGINT), CAST(s.folders - coalesce(t.folders, 0) AS BIGINT), CAST(s.entries - coalesce(t.n, 0) AS BIGINT) FROM shown s LEFT JOIN taken t ON t.parent = s.folder WHERE s.entries - coalesce(t.n, 0) > 0"""))
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return G.layout(f, G.folder_figures(f, LISTED), "/asia", 1 << 20, 500)[1]


# ---- kinds

KINDS_SQL = """, kinded AS (SELECT folder, content_hash, size, modified, CASE
    WHEN ext = 'bb' THEN 'wf_nc_bb' WHEN ext = 'tar' THEN 'unknown_archive' WHEN ext = 'csv' THEN 'im' ELSE 'other' END AS kind, CASE WHEN ext = 'tar' THEN 'name' ELSE 'loose' END AS how FROM files),
oldest AS (SELECT content_hash, min(modified) AS oldest FROM files WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
rows_ AS (SELECT k.folder, k.kind, k.how, k.size, CASE WHEN how = 'name' THEN modified ELSE coalesce(o.oldest, k.modified) END AS date FROM kinded k LEFT JOIN oldest o USING (content_hash) WHERE size > 0),
grouped AS (SELECT *, CASE kind WHEN 'wf_nc_bb' THEN 'simulated waveforms' WHEN 'im' THEN 'IM and hazard results' ELSE 'other' END AS grp FROM rows_)"""


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tally(K.walk(files(spark, sf_dir)), LISTED)


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.bround(c).cast("long") for c in columns})


@query(listing(KINDS_SQL + " SELECT grp, CAST(sum(CASE WHEN how = 'loose' THEN size ELSE 0 END) AS BIGINT) AS loose, CAST(sum(CASE WHEN how <> 'loose' THEN size ELSE 0 END) AS BIGINT) AS tarred FROM grouped GROUP BY 1"))
def kinds_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(K.kinds_by_group(_cube(spark, sf_dir)), "loose", "tarred")


@query(listing(KINDS_SQL + " SELECT kind, strftime(make_timestamp(date * 1000000), '%Y-%m') AS month, CAST(sum(size) AS BIGINT) AS size FROM rows_ GROUP BY 1, 2"))
def kinds_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(K.kinds_by_month(_cube(spark, sf_dir)), "size")


@query(listing(KINDS_SQL + f""" SELECT kind, CAST(y AS DOUBLE) AS years, CAST(sum(CASE WHEN how = 'loose' THEN size ELSE 0 END) AS BIGINT) AS loose, CAST(sum(CASE WHEN how <> 'loose' THEN size ELSE 0 END) AS BIGINT) AS tarred
  FROM rows_, unnest([0.5, 1, 2, 3, 5, 10]) AS t(y) WHERE date < {LISTED} - y * {YEAR} GROUP BY 1, 2"""))
def kinds_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(K.kinds_older(_cube(spark, sf_dir)), "loose", "tarred")


@query(listing(KINDS_SQL + " SELECT CAST(sum(size) AS BIGINT) AS total, CAST(0 AS BIGINT) AS members, CAST(sum(size) FILTER (how = 'name') AS BIGINT) AS by_name, CAST(0 AS BIGINT) AS undated FROM rows_"))
def kinds_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(K.kinds_totals(_cube(spark, sf_dir)), "total", "members", "by_name", "undated")


@query(listing(KINDS_SQL + """, spread AS (SELECT ancestor AS folder, grp, sum(size) AS size FROM grouped JOIN up USING (folder) WHERE len(string_split(ancestor, '/')) <= 3 GROUP BY 1, 2)
SELECT folder, grp, CAST(size AS BIGINT) AS size, row_number() OVER (PARTITION BY folder ORDER BY size DESC, list_position(['simulated waveforms', 'IM and hazard results', 'other'], grp)) = 1 AS main FROM spread"""))
def folder_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    shown = f.select("folder").distinct().select(F.explode(paths.ancestors(F.col("folder"))).alias("folder")).filter(paths.depth(F.col("folder")) <= 2).distinct()
    return _whole(K.folder_kinds(K.walk(f), shown), "size")


@query(f"""WITH {ARCHIVES_SQL}, {MEMBERS_SQL}, listed AS (SELECT archive_id AS id, sum(size) AS listed FROM members WHERE size > 0 AND type IN ('0', chr(0), '7') GROUP BY 1)
SELECT id, CAST(coalesce(listed, 0) AS BIGINT) AS listed, state IN ('complete', 'truncated') AS finished, coalesce(listed, 0) > 0 AND (state IN ('complete', 'truncated') OR coalesce(listed, 0) * 2 >= total_size) AS trusted
FROM archives LEFT JOIN listed USING (id)""")
def archive_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.archive_trust(archives(spark, sf_dir), members(spark, sf_dir)).select("id", "listed", "finished", "trusted")


@query(f"""WITH {ARCHIVES_SQL}, {MEMBERS_SQL}, parts AS (SELECT DISTINCT o_orderkey AS archive_id, o_custkey AS content_key FROM orders),
listed AS (SELECT archive_id AS id, sum(size) AS listed FROM members WHERE size > 0 AND type IN ('0', chr(0), '7') GROUP BY 1),
trust AS (SELECT id, state IN ('complete', 'truncated') AS finished, coalesce(listed, 0) > 0 AND (state IN ('complete', 'truncated') OR coalesce(listed, 0) * 2 >= total_size) AS trusted FROM archives LEFT JOIN listed USING (id))
SELECT content_key, archive_id FROM (SELECT content_key, archive_id, row_number() OVER (PARTITION BY content_key ORDER BY trusted DESC, finished DESC, id DESC) AS r FROM parts JOIN trust ON archive_id = id) WHERE r = 1""")
def part_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archives(spark, sf_dir)
    digest = F.sha2(F.col("o_custkey").cast("string"), 256)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("archive_id"), digest.alias("content_hash"), F.col("o_custkey").alias("content_key"))
    found = K.part_owners(K.archive_trust(a, members(spark, sf_dir)), o)
    return found.join(o.select("content_hash", "content_key").distinct(), "content_hash").select("content_key", "archive_id")


@query(listing(f""", {ARCHIVES_SQL}, {MEMBERS_SQL}, listed AS (SELECT archive_id, sum(size) AS listed FROM members WHERE size > 0 AND type = '0' GROUP BY 1),
aside AS (SELECT o_orderkey AS archive_id, '/held' || CAST(o_custkey % 7 AS VARCHAR) AS folder, sum(CAST(floor(o_totalprice) AS BIGINT)) AS held FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT a.folder, CASE WHEN m.name LIKE '%.bb' THEN 'wf_nc_bb' ELSE 'other' END AS kind, round(sum(a.held * m.size / l.listed), 0) AS size
FROM members m JOIN listed l USING (archive_id) JOIN aside a USING (archive_id) WHERE m.size > 0 AND m.type = '0' GROUP BY 1, 2"""))
def shared_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole archives shared out over their members."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    held = o.select(F.concat(F.lit("/held"), (F.col("o_custkey") % 7).cast("string")).alias("folder"), F.lit("a.tar").alias("name"), F.floor("o_totalprice").cast("long").alias("size"), digest.alias("content_hash"), F.lit(0).cast("long").alias("modified"))
    parts = o.select(F.col("o_orderkey").alias("archive_id"), digest.alias("content_hash"))
    a = archives(spark, sf_dir).filter("state = 'complete'").withColumns({"name": F.lit("a.tar"), "folder": F.lit("/x")}).dropDuplicates(["id"])
    rows = K.walk(held, archives=a, parts=parts, members=members(spark, sf_dir)).filter("how = 'members'")
    return rows.groupBy("folder", "kind").agg(F.round(F.sum("size"), 0).alias("size"))


def _sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.walk(sample_files(spark, sf_dir), SAMPLE_RULES, **sample_index(spark, sf_dir), by_folder=False, tasks=tasks(spark, sf_dir, "lineitem"))


@query(f"WITH {SAMPLE_ROWS_SQL} SELECT kind, how, strftime(make_timestamp(date * 1000000), '%Y-%m') AS month, CAST(round(sum(size)) AS BIGINT) AS size FROM rows_ GROUP BY 1, 2, 3")
def kinds_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over loose files, tarballs by name and archives shared out over their members, with a file for every rule."""
    cube = K.tally(_sample_rows(spark, sf_dir), LISTED).groupBy("kind", "how", "month").agg(F.sum("size").alias("size"))
    return cube.withColumn("size", F.round("size").cast("long"))


@query(f"""WITH {SAMPLE_ROWS_SQL} SELECT kind, CAST(y AS DOUBLE) AS years, CAST(round(sum(CASE WHEN how = 'loose' THEN size ELSE 0 END)) AS BIGINT) AS loose, CAST(round(sum(CASE WHEN how <> 'loose' THEN size ELSE 0 END)) AS BIGINT) AS tarred
  FROM rows_, unnest([0.5, 1, 2, 3, 5, 10]) AS t(y) WHERE date < {LISTED} - y * {YEAR} GROUP BY 1, 2""")
def kinds_indexed_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = K.kinds_older(K.tally(_sample_rows(spark, sf_dir), LISTED))
    return older.withColumns({c: F.round(c).cast("long") for c in ("loose", "tarred")})


# ---- comparing catalogs


@query(listing(""", ours AS (SELECT substr(folder, 2) || '/' || name AS path, max(size) AS a FROM files GROUP BY 1),
theirs AS (SELECT substr(folder, 2) || '/' || name AS path, max(CASE WHEN l_linenumber = 2 THEN size + 1 ELSE size END) AS b FROM (SELECT f.*, CAST(string_split(id, '-')[2] AS INTEGER) AS l_linenumber FROM files f) WHERE l_linenumber <> 3 GROUP BY 1)
SELECT path, CASE WHEN b IS NULL THEN 'missing there' WHEN a IS NULL THEN 'missing here' ELSE 'size differs' END AS status, a AS our_size, b AS their_size FROM ours FULL JOIN theirs USING (path) WHERE a IS NULL OR b IS NULL OR a <> b"""))
def verify_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    line = F.split("id", "-")[1].cast("int")
    theirs = f.filter(line != 3).select(F.substring(F.concat("folder", F.lit("/"), "name"), 2, 1 << 30).alias("path"), F.when(line == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return C.verify_listing(f.withColumn("folder", F.substring("folder", 2, 1 << 30)), theirs)


@query("""WITH a AS (SELECT c_custkey AS id, '/' || c_mktsegment || '/' || c_custkey AS old_path, c_nationkey AS x FROM customer WHERE c_custkey % 10 <> 1),
b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN '/moved/' ELSE '/' || c_mktsegment || '/' END || c_custkey AS new_path, CASE WHEN c_custkey % 15 = 3 THEN c_nationkey + 1 ELSE c_nationkey END AS y FROM customer WHERE c_custkey % 10 <> 2)
SELECT id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN old_path <> new_path AND x <> y THEN 'moved and changed' WHEN old_path <> new_path THEN 'moved' ELSE 'changed' END AS change, old_path, new_path
FROM a FULL JOIN b USING (id) WHERE a.id IS NULL OR b.id IS NULL OR old_path <> new_path OR x <> y""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    path = lambda head: F.concat(head, k.cast("string")).alias("path")
    home = F.concat(F.lit("/"), F.col("c_mktsegment"), F.lit("/"))
    old = c.filter(k % 10 != 1).select(k.alias("id"), path(home), F.col("c_nationkey").alias("size"), F.lit("h").alias("content_hash"))
    size = F.when(k % 15 == 3, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    new = c.filter(k % 10 != 2).select(k.alias("id"), path(F.when(k % 10 == 3, "/moved/").otherwise(home)), size.alias("size"), F.lit("h").alias("content_hash"))
    return C.snapshot_diff(old, new)


@query("SELECT doc_id, lang, source FROM documents ANTI JOIN labels USING (doc_id)")
def antijoin_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing_partner(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_quantity > 10 AND r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber AND r.l_partkey = l.l_partkey)")
def rows_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")  # noqa: E741
    return C.rows_not_in(l.drop("l_quantity"), l.filter("l_quantity > 10"), ["l_orderkey", "l_linenumber", "l_partkey"])


@query(ORACLES["rows_not_in"])
def rows_not_in_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows_not_in`` by the name it had when that one read a part of the lines."""
    return rows_not_in(spark, sf_dir)


@query(listing("SELECT lower(ancestor) AS folder FROM (SELECT DISTINCT ancestor FROM up) WHERE lower(ancestor) = '/asia'"))
def find_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.find_folder(T.folders_of(files(spark, sf_dir)), "/ASIA/").select("folder")


@query("SELECT lang || '/' || source AS folder, count(*) AS copies, CAST(sum(n_chars) - max(n_chars) AS BIGINT) AS reclaimable, min(doc_id) AS first FROM documents GROUP BY sha256(text), 1 HAVING count(*) > 1")
def document_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("folder"), F.sha2("text", 256).alias("h"), "n_chars", "doc_id")
    return d.groupBy("h", "folder").agg(F.count("*").alias("copies"), (F.sum("n_chars") - F.max("n_chars")).alias("reclaimable"), F.min("doc_id").alias("first")).filter("copies > 1").drop("h")


@query(r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, length(html) AS size FROM pages),
f AS (SELECT host || regexp_replace(path, '/[^/]*$', '') AS folder, size FROM p), s AS (SELECT folder, size, string_split(folder, '/') AS w FROM f),
u AS (SELECT array_to_string(list_slice(w, 1, n), '/') AS folder, size FROM s, unnest(range(1, 10)) AS t(n) WHERE n <= len(w))
SELECT folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM u GROUP BY 1""")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host, path = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return R.folder_rollup(p.select(F.concat(host, F.regexp_replace(path, "/[^/]*$", "")).alias("folder"), F.length("html").alias("size")))


# ---- archives


def _part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of some orders as parts a.tar.aa, a.tar.ab, ... in a folder for each order."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").repartition(tasks(spark, sf_dir, "lineitem"), "l_orderkey")  # noqa: E741
    l = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_partkey").alias("p"))  # noqa: E741
    name = F.concat(F.lit("a.tar.a"), F.char((F.col("l_linenumber") + 96).cast("int")))
    return l.select(F.concat(F.lit("/o/"), F.col("l_orderkey").cast("string")).alias("folder"), name.alias("name"), F.col("q").alias("size"), F.concat_ws(":", (F.col("p") % 5).cast("string"), F.col("q").cast("string")).alias("content_hash"), "l_orderkey", F.col("l_linenumber").alias("number"))


PARTS_SQL = """parts AS (SELECT l_orderkey, l_linenumber AS number, CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, max(l_partkey) % 5 AS p FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {PARTS_SQL}, sets AS (SELECT l_orderkey, sum(size) AS size, count(*) AS n, min(number) AS lo, max(number) AS hi, string_agg(p || ':' || size || ':' || size || chr(10), '' ORDER BY number) AS body FROM parts GROUP BY 1),
judged AS (SELECT '/o/' || l_orderkey AS folder, 'a.tar' AS name, CAST(size AS BIGINT) AS size, CAST(n AS INTEGER) AS n_parts, lo = 1 AND hi = n AS fine, CASE WHEN lo > 1 THEN 'its first part is missing' ELSE 'a part is missing' END AS why, sha256(body) AS h FROM sets),
ranked AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN fine THEN h ELSE '' END, fine ORDER BY size DESC, folder) AS k, first_value(folder) OVER (PARTITION BY CASE WHEN fine THEN h ELSE '' END, fine ORDER BY size DESC, folder) AS lead FROM judged)
SELECT folder, name, size, n_parts, CASE WHEN fine THEN h ELSE '' END AS set_hash, CASE WHEN NOT fine THEN 'refused' WHEN k > 1 THEN 'copy' ELSE 'ok' END AS status,
  CASE WHEN NOT fine THEN why WHEN k > 1 THEN 'copy of ' || lead || '/a.tar' ELSE '' END AS detail FROM ranked""")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidate_sets(_part_files(spark, sf_dir).drop("l_orderkey", "number"), tasks(spark, sf_dir, "lineitem"))


@query(f"WITH {PARTS_SQL} SELECT l_orderkey, number, CAST(coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM parts")
def part_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part_files(spark, sf_dir)
    return p.select("l_orderkey", "number", ranges.cumulative_offset([F.col("number")], ["l_orderkey"]).alias("offset_"))


@query(f"WITH {PARTS_SQL} SELECT * FROM (SELECT l_orderkey, number, lag(number) OVER w + 1 AS missing_from, number - lag(number) OVER w - 1 AS missing FROM parts WINDOW w AS (PARTITION BY l_orderkey ORDER BY number)) WHERE missing > 0")
def part_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.part_gaps(_part_files(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "number", "missing_from", "missing")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part_files(spark, sf_dir).withColumn("offset", ranges.cumulative_offset([F.col("number")], ["l_orderkey"]))
    sized = A.seed_segments(p.select(F.col("l_orderkey").alias("archive_id"), F.col("number").alias("idx"), "offset", "size"), ["size"])
    last = F.col("stop_at").isNull()
    state = F.when(last, "complete").when(F.col("size") % 9 == 0, "corrupt").otherwise("crossed")
    exit_ = F.col("scan_from") + F.col("size") + F.when(F.col("size") % 11 == 0, 1).otherwise(0)
    return sized.withColumns({"state": state, "first_header": F.col("scan_from"), "exit_offset": exit_, "cursor_offset": F.col("scan_from") + F.call_function("div", F.col("size"), F.lit(2))})


SEGMENTS_SQL = PARTS_SQL + """, laid AS (SELECT l_orderkey AS archive_id, number AS idx, size, CAST(coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan_from FROM parts),
segments AS (SELECT *, lead(scan_from) OVER (PARTITION BY archive_id ORDER BY idx) AS stop_at, CASE WHEN lead(scan_from) OVER (PARTITION BY archive_id ORDER BY idx) IS NULL THEN 'complete' WHEN size % 9 = 0 THEN 'corrupt' ELSE 'crossed' END AS state,
  scan_from + size + CASE WHEN size % 11 = 0 THEN 1 ELSE 0 END AS exit_offset, scan_from + size // 2 AS cursor_offset FROM laid)"""


@query(f"""WITH {SEGMENTS_SQL}, links AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN true ELSE coalesce(lag(state) OVER w = 'crossed' AND scan_from = lag(exit_offset) OVER w, false) END AS link FROM segments WINDOW w AS (PARTITION BY archive_id ORDER BY idx))
SELECT archive_id, idx, bool_and(link) OVER (PARTITION BY archive_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS joined FROM links""")
def segment_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segment_chain(_segments(spark, sf_dir)).select("archive_id", "idx", "joined")


@query(f"WITH {SEGMENTS_SQL} SELECT archive_id, min(idx) AS idx, arg_min(state, idx) AS state FROM segments WHERE state <> 'crossed' GROUP BY 1")
def chain_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chain_ending(_segments(spark, sf_dir))


@query(f"""WITH {SEGMENTS_SQL}, whole AS (SELECT archive_id, sum(size) AS total FROM segments GROUP BY 1)
SELECT archive_id, CAST(sum(greatest(least(CASE WHEN state IN ('crossed', 'complete') THEN coalesce(stop_at, total) ELSE cursor_offset END, coalesce(stop_at, total)) - scan_from, 0)) AS BIGINT) AS covered FROM segments JOIN whole USING (archive_id) GROUP BY 1""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir)
    return A.coverage(s, s.groupBy(F.col("archive_id").alias("id")).agg(F.sum("size").alias("total_size")))


@query(f"""WITH {MEMBERS_SQL}, ends AS (SELECT archive_id, max(hdr_offset) // 4096 AS last FROM members GROUP BY 1), spans AS (SELECT archive_id, k AS idx, k * 4096 AS begin_, (k + 1) * 4096 AS end_ FROM ends, unnest(range(0, last + 1)) AS t(k))
SELECT archive_id, idx, count(*) AS members FROM members JOIN spans USING (archive_id) WHERE hdr_offset >= begin_ AND hdr_offset < end_ GROUP BY 1, 2""")
def range_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by the span they begin in, with spans up to each archive's last header."""
    m = members(spark, sf_dir).select("archive_id", "hdr_offset")
    k = F.col("idx")
    spans = m.groupBy("archive_id").agg(F.max("hdr_offset").alias("last"))
    spans = spans.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 4096)))).select("archive_id", "idx", (k * 4096).alias("begin_"), ((k + 1) * 4096).alias("end_"))
    found = ranges.binned_range_join(m, spans, at="hdr_offset", begin="begin_", end="end_", keys=["archive_id"], width=4096)
    return found.groupBy("archive_id", "idx").agg(F.count("*").alias("members"))


@query(f"WITH {MEMBERS_SQL} SELECT archive_id, CAST(hdr_offset // 4096 AS BIGINT) AS idx, count(*) AS members FROM members GROUP BY 1, 2")
def range_locate_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``range_locate`` by the name it had when that one read eight spans; the SQL divides instead of joining."""
    return range_locate(spark, sf_dir)


@query("""SELECT event_id, e.user_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey AS user_id, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o
  ON e.user_id = o.user_id AND e.ts >= o.o_orderdate""")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey"))
    return ranges.as_of_join(e, o, at="ts", mark="o_orderdate", keys=["user_id"], values=["o_orderkey"], bucket=lambda t: F.year(t)).drop("ts")


@query(ORACLES["as_of"])
def as_of_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``as_of`` by the name it had when that one read a part of the events."""
    return as_of(spark, sf_dir)


@query(f"""WITH {MEMBERS_SQL}, x AS (SELECT *, size > 0 AND type IN ('0', chr(0), '7') AS f, coalesce(nullif(regexp_extract(lower(name), '^.+\\.([^.]{{1,12}})$', 1), ''), '(none)') AS e FROM members),
k AS (SELECT archive_id, size, 'total' AS section, '' AS key FROM x UNION ALL SELECT archive_id, size, 'owner', uname || ':' || gname FROM x UNION ALL SELECT archive_id, size, 'type', type FROM x UNION ALL SELECT archive_id, size, 'ext', e FROM x WHERE f
UNION ALL SELECT archive_id, size, 'dir' || n, CASE WHEN dir = '' THEN '(root)' ELSE array_to_string(list_slice(string_split(dir, '/'), 1, n), '/') END FROM x, unnest([1, 2, 3]) AS t(n) WHERE f)
SELECT archive_id, section, key, count(*) AS members, CAST(sum(size) AS BIGINT) AS bytes FROM k GROUP BY 1, 2, 3""")
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few members to an archive here, so all its sums are made where its members are
    return A.summary(members(spark, sf_dir).repartition(tasks(spark, sf_dir, "lineitem"), "archive_id"))


@query(f"WITH {MEMBERS_SQL} SELECT archive_id, hdr_offset, size, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY size DESC, hdr_offset) AS place FROM members) WHERE place <= 3")
def largest_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.largest_members(members(spark, sf_dir), 3).select("archive_id", "hdr_offset", "size", "place")


@query(f"WITH {MEMBERS_SQL} SELECT archive_id, hdr_offset, times FROM (SELECT *, count(*) OVER (PARTITION BY archive_id, dir, name) AS times FROM members) WHERE times > 1")
def repeated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated_paths(members(spark, sf_dir)).select("archive_id", "hdr_offset", "times")


@query(f"WITH {MEMBERS_SQL} SELECT archive_id, hdr_offset, lead(hdr_offset) OVER w AS next_header, lead(hdr_offset) OVER w = data_offset + (size + 511) // 512 * 512 AS contiguous FROM members WINDOW w AS (PARTITION BY archive_id ORDER BY hdr_offset)")
def member_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.follows(members(spark, sf_dir), 8192).select("archive_id", "hdr_offset", "next_header", "contiguous")


@query(f"""WITH {MEMBERS_SQL} SELECT archive_id, CASE WHEN dir = '' THEN name ELSE dir || '/' || name END AS path, type, size, '0644' AS mode, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS mtime, hdr_offset FROM members""")
def archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.manifest(members(spark, sf_dir).withColumn("linkname", F.lit(""))).select("archive_id", "path", "type", "size", "mode", "mtime", "hdr_offset")


@query(f"WITH {ARCHIVES_SQL} SELECT state, count(*) AS archives, CAST(sum(total_size) AS BIGINT) AS bytes FROM archives GROUP BY 1")
def archives_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_state(archives(spark, sf_dir))


@query(f"WITH {ARCHIVES_SQL} SELECT name, id, state FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY state = 'stale', id DESC) AS r FROM archives) WHERE r = 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest_live(archives(spark, sf_dir), ["name"]).select("name", "id", "state")


@query(f"WITH {ARCHIVES_SQL} SELECT id, CASE WHEN row_number() OVER (PARTITION BY name, folder ORDER BY state = 'stale', created_at DESC, id DESC) > 1 THEN 'stale' ELSE state END AS state FROM archives")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mark_superseded(archives(spark, sf_dir)).select("id", "state")


@query("SELECT user_id, max(ts) AS ts, arg_max(props, (ts, props)) AS detail FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = e.agg(F.min("event_type")).first()[0]
    return A.latest_event(e.select("user_id", "ts", F.col("event_type").alias("kind"), F.col("props").alias("detail")), kind, ["user_id"])


@query(f"""WITH {ARCHIVES_SQL}, c AS (SELECT id AS k, id % 97 AS h, total_size AS size FROM archives), known AS (SELECT 2 * (id % 97) AS h, arg_max(state, (CASE WHEN state = 'stale' THEN 0 ELSE 1 END, id)) AS state FROM archives GROUP BY 1)
SELECT CASE WHEN state IN ('complete', 'truncated', 'corrupt', 'unsupported') THEN 'done' WHEN state IS NOT NULL THEN 'resume' ELSE 'new' END AS job, count(*) AS jobs, CAST(sum(size) AS BIGINT) AS bytes FROM c LEFT JOIN known USING (h) GROUP BY 1""")
def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive as a candidate against every archive as a registered one, whose parts are others for odd hashes."""
    a = archives(spark, sf_dir).withColumn("set_hash", F.col("id") % 97)
    c = a.select("folder", "name", F.col("total_size").alias("size"), "set_hash", F.lit("ok").alias("status"))
    segments = a.select(F.col("id").alias("archive_id"))
    return A.plan_counts(A.run_plan(c, a.withColumn("set_hash", 2 * F.col("set_hash")), segments))


@query(f"""WITH {MEMBERS_SQL}, c AS (SELECT name, size, mtime % 4 AS signature, count(*) AS n FROM members GROUP BY 1, 2, 3)
SELECT name, size, CAST(sum(n) AS BIGINT) AS members, count(*) AS contents, CAST(sum(n - 1) AS BIGINT) AS redundant FROM c GROUP BY 1, 2 HAVING sum(n) > 1""")
def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.same_content(members(spark, sf_dir).withColumn("signature", F.col("mtime") % 4), [])


@query("""SELECT o_orderkey AS archive_id, CAST(0 AS INTEGER) AS idx, CASE WHEN o_custkey % 10 = 1 THEN 'missing' WHEN o_custkey % 10 = 2 THEN 'resized' ELSE 'rewritten' END AS change FROM orders WHERE o_custkey % 10 IN (1, 2, 3)""")
def changed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    last = F.col("o_custkey") % 10
    o = o.select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("size"), F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string")).alias("key"))
    parts = o.select(F.col("o_orderkey").alias("archive_id"), F.lit(0).alias("idx"), F.col("key").alias("name"), F.col("key").alias("file_id"), "size", F.lit("h").alias("content_hash"))
    live = o.filter(last != 1).select(F.when(last == 4, "").otherwise(F.col("key")).alias("id"), F.col("key").alias("name"), F.when(last == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(last == 3, "g").otherwise("h").alias("content_hash"))
    return A.changed_parts(parts, live)


@query(f"WITH {MEMBERS_SQL} SELECT archive_id, min(mtime) AS first, max(mtime) AS last FROM members GROUP BY 1")
def archive_time_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.time_span(members(spark, sf_dir))


@query(f"WITH {MEMBERS_SQL} SELECT archive_id, hdr_offset FROM members WHERE size % 500 = 0")
def extended_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = F.col("data_offset") + F.when(F.col("size") % 500 == 0, 1024).otherwise(0)
    return A.extended_headers(members(spark, sf_dir).withColumn("data_offset", longer)).select("archive_id", "hdr_offset")


@query(f"""WITH {PARTS_SQL}, laid AS (SELECT l_orderkey, number, size, sum(size) OVER (PARTITION BY l_orderkey ORDER BY number ROWS UNBOUNDED PRECEDING) - size AS lo FROM parts WHERE size > 0),
r AS (SELECT DISTINCT o_orderkey AS l_orderkey, o_orderkey % 40 AS a, 25 AS n FROM orders)
SELECT l_orderkey, a AS offset_, number AS idx, CAST(greatest(a, lo) - lo AS BIGINT) AS part_offset, CAST(least(a + n, lo + size) - greatest(a, lo) AS BIGINT) AS slice_length FROM laid JOIN r USING (l_orderkey) WHERE least(a + n, lo + size) > greatest(a, lo)""")
def part_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _part_files(spark, sf_dir).withColumn("offset", ranges.cumulative_offset([F.col("number")], ["l_orderkey"])).select("l_orderkey", F.col("number").alias("idx"), "offset", "size")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 40).alias("offset"), F.lit(25).cast("long").alias("length")).distinct()
    return ranges.slices(r, p, keys=["l_orderkey"], width=64).select("l_orderkey", F.col("offset").alias("offset_"), "idx", "part_offset", "slice_length")


@query(listing("SELECT CASE WHEN ext = 'tar' THEN 'whole' END AS what, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files WHERE ext = 'tar' GROUP BY 1"))
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.candidate_files(files(spark, sf_dir)).groupBy("what").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("SELECT count(*) AS n, min(CASE WHEN k IS NULL THEN 0 ELSE 1 END) AS all_known, CAST(sum(k) AS BIGINT) AS total FROM (SELECT row_number() OVER (ORDER BY c_mktsegment, c_nationkey) AS k FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer))")
def principal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys given in two steps are 1..n without gaps."""
    c = table(spark, sf_dir, "customer").withColumn("who", F.concat_ws("-", "c_mktsegment", "c_nationkey"))
    known = C.dimension(c.filter("c_nationkey < 7"), "who")
    found = C.dimension(c, "who", known)
    old = found.join(known.select("value", F.col("id").alias("old")), "value", "left")
    kept = F.when(F.col("old").isNotNull(), (F.col("old") == F.col("id")).cast("int"))
    return old.agg(F.count("*").alias("n"), F.min(kept).alias("all_known"), F.sum("id").alias("total"))


@query(listing(", shown AS (SELECT DISTINCT ancestor AS folder FROM up WHERE len(string_split(ancestor, '/')) <= 3 AND ancestor NOT LIKE '/asia/%') SELECT u.folder, arg_max(ancestor, length(ancestor)) AS shown FROM up u JOIN shown s ON s.folder = u.ancestor GROUP BY 1"))
def nearest_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("folder").distinct()
    shown = T.folders_of(f).filter((F.col("depth") <= 2) & ~F.startswith("folder", F.lit("/asia/"))).select("folder")
    return T.nearest_shown(f, shown).select("folder", "shown")


@query(listing("SELECT id, substr(folder, 9) AS relative, upper(folder) AS loud FROM files WHERE starts_with(folder, '/europe/')"))
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).filter(paths.in_subtree(F.lower("folder"), "/Europe/"))
    return f.select("id", paths.below(F.col("folder"), "/EUROPE").alias("relative"), F.upper("folder").alias("loud"))


@query(f"""WITH {ARCHIVES_SQL}, mine AS (SELECT DISTINCT ON (id) id, name, folder, state, created_at, id % 900 AS h FROM archives ORDER BY id), theirs AS (SELECT id, name, folder, state, created_at, 2 * h AS h FROM mine),
merged AS (SELECT * FROM mine WHERE h NOT IN (SELECT h FROM theirs) UNION ALL SELECT id + (SELECT max(id) FROM mine), name, folder, state, created_at, h FROM theirs)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY name, folder ORDER BY state = 'stale', created_at DESC, id DESC) > 1 THEN 'stale' ELSE state END AS state FROM merged""")
def catalog_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive into a catalog of every archive; theirs replace those of mine with an even hash below 900."""
    a = archives(spark, sf_dir).dropDuplicates(["id"]).withColumn("set_hash", F.col("id") % 900).drop("total_size")
    return C.import_catalog({"archives": a}, {"archives": a.withColumn("set_hash", 2 * F.col("set_hash"))})["archives"].select("id", "state")


# ---- events


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a streaming query gives once it has read all there is, as Parquet that a replayed batch overwrites."""
    spark = stream.sparkSession
    root = f"{work_dir(spark)}/drained-{uuid.uuid4().hex}"
    written: dict[str, None] = {}

    def write(batch: DataFrame, n: int) -> None:
        # a complete result replaces the one before
        at = f"{root}/{n}"
        if mode == "complete":
            written.clear()
        batch.write.mode("overwrite").parquet(at)
        written[at] = None

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(stream.schema).parquet(*written) if written else spark.createDataFrame([], stream.schema)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2, 3")
def events_hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly counts by a streaming query that reads all there is and stops."""
    stream = _event_stream(spark, sf_dir)
    return _drained(E.windowed_counts(stream.select("ts", F.col("event_type").alias("kind"))), "complete")


@query("""WITH c AS (SELECT CAST(user_id % 20 AS VARCHAR) AS source, epoch_us(ts) / 1e6 AS ts FROM events WHERE event_type = 'click'), m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY source ORDER BY ts) + 30 THEN 0 ELSE 1 END AS b FROM c), n AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT source, CAST(k AS BIGINT) AS overload, ts FROM n WHERE b = 1""")
def rate_limit_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as rate-limit answers that ask for half a minute; all asking for as much, an overload lasts until a pause of that length."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return E.overloads_of(e.select((F.col("user_id") % 20).cast("string").alias("source"), at.alias("ts"), F.lit(30.0).alias("retry_after")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2, 3")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"))
    return E.windowed_counts(e)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM n GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.sessions(table(spark, sf_dir, "events"))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click' AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def events_last_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), F.col("event_type").alias("kind"))
    now = e.agg(F.max("us")).first()[0] / 1e6
    return E.last_hour(e.withColumn("ts", F.col("us") / 1e6), "click", now)


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def events_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), values.seconds(F.col("ts")).alias("ts_s"))
    return E.pace(e).select("event_id", "in_window")


@query("SELECT event_id, round((event_id - lag(event_id) OVER w) / (t - lag(t) OVER w), 6) AS rate FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id) QUALIFY t > lag(t) OVER w")
def events_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run"), (values.seconds(F.col("ts"))).alias("ts_s"), F.col("event_id").alias("files"))
    return E.rates(e).filter("rate is not null").select("event_id", F.round("rate", 6).alias("rate"))


# ---- ingestion


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    path = F.concat(F.lit("/in/"), F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("/f"), (n % 400).cast("string"), F.lit(".dat"))
    return o.select(
        (F.col("o_custkey") % 4).alias("shard_id"), n.alias("seq"), F.when(n % 11 == 0, "deleted").otherwise("file").alias("tag"), F.concat(F.lit("id"), (n % 400).cast("string")).alias("id"),
        F.concat(F.lit("f"), (n % 400).cast("string"), F.lit(".dat")).alias("name"), F.when(n % 13 == 0, None).otherwise(path).alias("path"), F.floor("o_totalprice").cast("long").alias("size"), F.lit("r").alias("rev"),
        F.when(n % 7 == 0, "zz").otherwise(F.sha2(n.cast("string"), 256)).alias("content_hash"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("client_modified"), F.lit("bad").alias("server_modified"), (n % 2 == 0).alias("downloadable"), F.lit("x").alias("modified_by"),
    ).dropDuplicates(["seq"])


ENTRIES_SQL = """e AS (SELECT DISTINCT ON (o_orderkey) o_orderkey AS n, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(epoch(o_orderdate) AS BIGINT) AS modified, '/in/' || lower(substr(o_orderpriority, 3, 20)) AS folder FROM orders ORDER BY o_orderkey)"""


@query(f"""WITH {ENTRIES_SQL}, f AS (SELECT 'id' || n % 400 AS id, n, CASE WHEN n % 13 = 0 THEN '/shard' ELSE folder END AS folder, size, modified, CASE WHEN n % 7 = 0 THEN NULL ELSE sha256(CAST(n AS VARCHAR)) END AS h, n % 2 = 0 AS d FROM e WHERE n % 11 <> 0)
SELECT id, arg_max(folder, n) AS folder, arg_max(size, n) AS size, arg_max(modified, n) AS modified, list_extract(list(h ORDER BY n DESC), 1) AS content_hash, arg_min(d, n) AS downloadable FROM f GROUP BY 1""")
def upserted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.sort_out(_entries(spark, sf_dir), "/shard")["files"]
    return ingest.upsert(found, None).select("id", "folder", "size", "modified", "content_hash", "downloadable")


@query(f"""WITH {ENTRIES_SQL}, k AS (SELECT CASE WHEN n % 11 = 0 THEN 'deleted' WHEN n % 13 = 0 THEN 'no_path' WHEN n % 7 = 0 THEN 'bad_hash' END AS kind FROM e) SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1""")
def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sort_out(_entries(spark, sf_dir), "/shard")["events"].groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {ENTRIES_SQL}, f AS (SELECT DISTINCT CASE WHEN n % 13 = 0 THEN '/shard' ELSE folder END AS folder FROM e WHERE n % 11 <> 0), u AS (SELECT folder FROM f UNION SELECT '/in' FROM f WHERE folder LIKE '/in/%')
SELECT folder, regexp_replace(folder, '/[^/]*$', '') AS parent, CAST(len(folder) - len(replace(folder, '/', '')) AS INTEGER) AS depth FROM u""")
def derived_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.sort_out(_entries(spark, sf_dir), "/shard")
    return ingest.derive_folders(found["files"], found["folders"]).select("folder", "parent", "depth")


@query("""SELECT parent, m <= 0.1 * n AS leafy FROM (SELECT '/' || c_mktsegment AS parent, count(*) AS n, count(*) FILTER (c_nationkey < 3) AS m FROM customer GROUP BY 1) WHERE n >= 20""")
def leafy_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return ingest.should_split(c.select(F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")).alias("path"), (F.col("c_nationkey") < 3).alias("had_folders")))


# ---- functions


@query(r"""SELECT o_orderkey, lower(chr(97 + CAST(o_orderkey % 26 AS INTEGER)) || chr(97 + CAST(o_custkey % 26 AS INTEGER))) AS suffix, (o_orderkey % 26) * 26 + o_custkey % 26 AS number FROM orders""")
def suffix_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = F.concat(F.char((F.col("o_orderkey") % 26 + 97).cast("int")), F.char((F.col("o_custkey") % 26 + 97).cast("int")))
    return o.select("o_orderkey", s.alias("suffix"), paths.suffix_value(s).alias("number"))


@query("SELECT doc_id, sha256(unhex(sha256(text))) AS content_hash FROM documents WHERE text IS NOT NULL AND length(text) > 0")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null and length(text) > 0")
    return d.select("doc_id", values.block_hash(F.encode("text", "utf-8")).alias("content_hash"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(lower(f), '^.+\.([^.]{1,12})$', 1), ''), '(none)') AS ext, CASE WHEN strpos(f, '.') > 0 THEN list_extract(string_split(f, '.'), -1) ELSE '' END AS raw FROM (SELECT page_id, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS f FROM pages)")
def page_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.substring_index(F.regexp_replace("url", "[?#].*$", ""), "/", -1)
    ext = F.coalesce(F.nullif(paths.extension(name), F.lit("")), F.lit("(none)"))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), paths.raw_extension(name).alias("raw"))


@query(listing("""SELECT CASE WHEN ext = 'tar' THEN 'unknown_archive' WHEN ext = 'bb' THEN 'wf_nc_bb' WHEN ext = 'csv' THEN 'im' ELSE 'other' END AS kind, count(*) AS n FROM files GROUP BY 1"""))
def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    facts = f.select("folder").distinct().withColumn("facts", KF.folder_facts(F.lower("folder")))
    return f.join(facts, "folder").select(KF.classify(F.col("facts"), F.lower("name")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# ---- asking verdicts again


@query(f"""WITH {SEGMENTS_SQL}, ended AS (SELECT archive_id, min(idx) AS idx FROM segments WHERE state <> 'crossed' GROUP BY 1),
verdict AS (SELECT s.archive_id, s.idx, s.state, s.exit_offset FROM segments s JOIN ended USING (archive_id, idx) WHERE archive_id % 7 <> 0),
asked AS (SELECT archive_id, idx AS ending, greatest(CASE WHEN archive_id % 3 = 0 THEN idx - 2 ELSE idx - 1 END, CASE WHEN archive_id % 3 = 0 AND idx - 1 < 0 THEN -1 ELSE 0 END, 0) AS again FROM verdict)
SELECT s.archive_id, s.idx, CASE WHEN again IS NULL OR s.idx < again THEN s.state WHEN s.idx > ending THEN 'beyond' ELSE 'pending' END AS state, CASE WHEN again IS NULL OR s.idx <= ending THEN scan_from END AS first_header, CASE WHEN again IS NULL OR s.idx < again THEN exit_offset END AS exit_offset
FROM segments s LEFT JOIN asked USING (archive_id)""")
def recheck_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive's verdict asked again, for a third of them the second time, for none that are stale."""
    s = _segments(spark, sf_dir).withColumns({"joined": F.lit(True), "members": F.lit(1).cast("long")})
    state = F.when(F.col("archive_id") % 7 == 0, "stale").otherwise("corrupt")
    found = s.select("archive_id").distinct().select(F.col("archive_id").alias("id"), state.alias("state"))
    none = spark.createDataFrame([], recheck.NOTES)
    first = recheck.questions(s, found, none)
    again = recheck.questions(s, found, first.filter("archive_id % 3 = 0").drop("further"))
    return recheck.restated(s, again).select("archive_id", "idx", "state", "first_header", "exit_offset")


# ---- contents by ranges of bytes

BLOCK, SAMPLED = 1 << 16, 256


@query(f"""WITH whole AS (SELECT source, string_agg(hex(encode(text)), '' ORDER BY doc_id) AS body FROM documents WHERE text IS NOT NULL GROUP BY 1),
blocks AS (SELECT source, k, substr(body, CAST(k * {2 * BLOCK} + 1 AS BIGINT), {2 * BLOCK}) AS piece FROM whole, unnest(range(0, (length(body) + {2 * BLOCK} - 1) // {2 * BLOCK})) AS t(k)),
digests AS (SELECT source, k, length(piece) // 2 AS n, sha256(unhex(piece)) AS digest FROM blocks)
SELECT source, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS bytes, sha256(unhex(string_agg(digest, '' ORDER BY k))) AS content_hash FROM digests GROUP BY 1""")
def block_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each source, end to end, as one file: the digest of the digests of its blocks of 64 KiB."""
    chunks = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").cast("binary").alias("content"))
    told = B.block_digests(chunks, ["source"], "doc_id", block=BLOCK)
    counted = told.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("length").alias("bytes"))
    return counted.join(B.digest_of_digests(told, ["source"]), "source")


@query(f"""WITH d AS (SELECT doc_id, lang, hex(encode(text)) AS body, length(hex(encode(text))) // 2 AS size FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, lang, size, k, CASE WHEN size <= {SAMPLED} THEN body ELSE substr(body, CAST(2 * ((size - {SAMPLED}) * k // 3 // 8 * 8) + 1 AS BIGINT), {2 * SAMPLED}) END AS piece FROM d, unnest(range(0, 4)) AS t(k) WHERE size > {SAMPLED} OR k = 0),
s AS (SELECT doc_id, lang, size, sha256(string_agg(sha256(unhex(piece)), ',' ORDER BY k)) AS signature FROM w GROUP BY 1, 2, 3),
c AS (SELECT lang, size, signature, count(*) AS n FROM s GROUP BY 1, 2, 3)
SELECT lang, size, CAST(sum(n) AS BIGINT) AS members, count(*) AS contents, CAST(sum(n - 1) AS BIGINT) AS redundant FROM c GROUP BY 1, 2 HAVING sum(n) > 1""")
def sampled_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one language and size that seem equal, by four windows of 256 bytes in each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), F.col("text").cast("binary").alias("content")).filter("content is not null")
    told = B.signatures(B.window_digests(d, ["doc_id"], samples=4, width=SAMPLED), ["doc_id"])
    rows = d.select("doc_id", "name", F.octet_length("content").cast("long").alias("size")).join(told, "doc_id")
    return A.same_content(rows, []).select(F.col("name").alias("lang"), "size", "members", "contents", "redundant")


@query("""WITH r AS (SELECT conv_id, CAST(length(text) % 3 AS VARCHAR) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS t FROM conversations),
f AS (SELECT * FROM r WHERE t <= 7), counts AS (SELECT a.conv_id, a.t, b.digest, count(*) AS n FROM f a JOIN f b ON a.conv_id = b.conv_id AND b.t <= a.t GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, t ORDER BY n DESC, digest) AS k FROM counts),
lead_ AS (SELECT a.conv_id, a.t, a.digest, a.n - coalesce(b.n, 0) AS ahead FROM ranked a LEFT JOIN ranked b ON a.conv_id = b.conv_id AND a.t = b.t AND b.k = 2 WHERE a.k = 1),
won AS (SELECT conv_id, min(t) AS t, arg_min(digest, t) AS digest FROM lead_ WHERE ahead >= 2 GROUP BY 1)
SELECT f.conv_id, max(won.digest) AS digest, CAST(coalesce(max(won.t), count(*)) AS INTEGER) AS attempts, CAST(count(DISTINCT f.digest) FILTER (won.t IS NULL OR f.t <= won.t) AS INTEGER) AS versions
FROM f LEFT JOIN won ON won.conv_id = f.conv_id GROUP BY 1""")
def confirmed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as reads of one range: the length modulo 3 that first leads every other by two votes, within seven reads."""
    c = table(spark, sf_dir, "conversations")
    reads = c.select("conv_id", F.struct("turn", "role", "text").alias("attempt"), (F.length("text") % 3).cast("string").alias("digest"))
    return votes.settled(reads, ["conv_id"])


# ---- a running listing's state


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream.  A path with a pattern may name one file or a folder of them, a plain one a folder only."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _turns(rows: DataFrame) -> DataFrame:
    """Turns of conversations as answers that a lister got for a shard; the text's length says which."""
    k = F.length("text") % 12
    status = F.when(k < 5, 200).when(k == 5, 429).when(k == 6, 409).when(k < 10, 503).when(k == 10, 401).otherwise(200)
    return rows.select(F.col("conv_id").cast("string").alias("shard"), F.col("turn").cast("long").alias("seq"), status.alias("status"), F.when(k == 6, "reset").alias("body"), F.lit("3").alias("retry_after"), (k < 11).alias("has_more"), F.lit(0).cast("timestamp").alias("ts"))


@query("""WITH RECURSIVE a AS (SELECT conv_id, turn, length(text) % 12 AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text IS NOT NULL),
run AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS turn, '' AS event, 'recursive' AS mode, false AS cursor_, 0 AS attempts, 0 AS generation, 'open' AS state FROM a
  UNION ALL
  SELECT conv_id, n, turn, event, CASE WHEN event = 'split_after_failure' THEN 'split' ELSE mode END,
    CASE WHEN event IN ('page', 'last page') THEN event = 'page' WHEN event IN ('cursor_reset', 'split_after_failure') THEN false ELSE cursor_ END,
    CASE WHEN event IN ('page', 'last page', 'split_after_failure') THEN 0 WHEN event IN ('transient', 'auth_expired', 'failed') THEN attempts + 1 ELSE attempts END,
    CASE WHEN event IN ('cursor_reset', 'split_after_failure') THEN generation + 1 ELSE generation END,
    CASE WHEN event = 'failed' THEN 'error' WHEN event IN ('last page', 'ignored') THEN 'done' ELSE 'open' END
  FROM (SELECT *, CASE WHEN done THEN 'ignored' WHEN k < 5 THEN 'page' WHEN k = 11 THEN 'last page' WHEN k = 5 THEN 'rate_limited' WHEN k = 6 THEN 'cursor_reset'
      WHEN k < 10 AND mode = 'recursive' AND attempts + 1 >= CASE WHEN cursor_ THEN 3 ELSE 2 END THEN 'split_after_failure' WHEN attempts + 1 >= 3 THEN 'failed' WHEN k < 10 THEN 'transient' ELSE 'auth_expired' END AS event
    FROM (SELECT r.conv_id, a.n, a.turn, a.k, r.mode, r.state = 'done' AS done, r.cursor_ AND r.state <> 'error' AS cursor_, CASE WHEN r.state = 'error' THEN 0 ELSE r.attempts END AS attempts, r.generation + CASE WHEN r.state = 'error' THEN 1 ELSE 0 END AS generation
      FROM run r JOIN a ON a.conv_id = r.conv_id AND a.n = r.n + 1) x) y)
SELECT CAST(conv_id AS VARCHAR) AS shard, CAST(turn AS BIGINT) AS seq, event, mode, generation, attempts FROM run WHERE n > 0 AND event <> 'ignored'""")
def shard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming query that follows each shard through its answers: tried again, restated, split, failed, done."""
    with S.with_rocksdb(spark):
        stream = _turns(_table_stream(spark, sf_dir, "conversations").filter("text is not null"))
        return _drained(S.follow(stream), "append").drop("wait")


@query("""WITH l AS (SELECT doc_id // 100 AS p, doc_id, length(text) % 9 = 0 AS had FROM documents WHERE text IS NOT NULL),
c AS (SELECT p, doc_id, count(*) OVER w AS listed, count(*) FILTER (had) OVER w AS with_folders FROM l WINDOW w AS (PARTITION BY p ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, listed >= 20 AND with_folders <= 0.1 * listed AS leafy FROM c), g AS (SELECT *, coalesce(lag(leafy) OVER (PARTITION BY p ORDER BY doc_id), false) AS was FROM f)
SELECT '/' || CAST(p AS VARCHAR) AS parent, doc_id AS seq, CASE WHEN leafy THEN 'one_level_on' ELSE 'one_level_off' END AS event, listed, with_folders FROM g WHERE leafy <> was""")
def sibling_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming query over documents as folders, a hundred to a parent: when the rest begin or cease to be listed one level at a time."""
    d = _table_stream(spark, sf_dir, "documents").filter("text is not null")
    path = F.concat(F.lit("/"), F.call_function("div", F.col("doc_id"), F.lit(100)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    listed = d.select(path.alias("path"), F.col("doc_id").alias("seq"), (F.length("text") % 9 == 0).alias("had_folders"), F.lit(True).alias("from_start"))
    with S.with_rocksdb(spark):
        return _drained(S.learn(listed), "append")


@query("SELECT conv_id AS shard_id, CAST(turn AS BIGINT) AS seq, role, length(text) AS size FROM conversations")
def fresh_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A streaming query that reads all turns twice, as a lister that stores its pages again, and lets each through once."""
    turns = lambda: _table_stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("shard_id"), F.col("turn").cast("long").alias("seq"), "role", F.length("text").cast("long").alias("size"))
    with S.with_rocksdb(spark):
        return _drained(S.fresh(turns().unionByName(turns())), "append")
