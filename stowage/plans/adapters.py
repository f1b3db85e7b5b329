"""The driver's tables seen as catalogs: pure selections, each with the same selection in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, values
from ..functions.kinds import LF_SHARES, rule_words

#: Time that ages are counted from.
LISTED = 1_009_843_200  # 2002-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that a task of an explicit repartition gets, about.
TASK_ROWS = 250_000


def tasks(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks among which rows of a table go, so that a task's memory does not grow with the table; the count reads footers only."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // TASK_ROWS))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by what their suppliers' folders begin with."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/supplier")).alias("above"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as files: (id, folder, name, ext, size, content_hash, modified)."""
    # one after the other: a join of suppliers has no estimate that lets it be broadcast, so the lines would be shuffled for it
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(nations(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("folder", F.concat("above", F.col("s_suppkey").cast("string")))
    number = F.col("l_linenumber").cast("string")
    ending = F.when(F.col("l_linenumber") % 5 == 1, ".tar").when(F.col("l_linenumber") % 5 == 2, ".bb").when(F.col("l_linenumber") % 5 == 3, ".csv").when(F.col("l_linenumber") % 5 == 4, "").otherwise(".nc")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), number, ending)
    quantity = F.col("l_quantity").cast("long")
    identity = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity)
    return joined.select(
        identity.alias("id"), "folder", name.alias("name"), paths.extension(name).alias("ext"), (quantity * F.col("p_size") * 1024).cast("long").alias("size"),
        F.when(F.col("l_linenumber") != 7, F.concat_ws(":", F.col("l_partkey"), quantity)).alias("content_hash"), values.seconds(F.col("l_shipdate")).alias("modified"),
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as archives: (id, name, folder, state, total_size, created_at)."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "walking").otherwise("stale")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("a"), (F.col("o_custkey") % 50).cast("string"), F.lit(".tar")).alias("name"), F.concat(F.lit("/arch/"), F.lower(F.substring("o_orderpriority", 1, 1))).alias("folder"), state.alias("state"), F.floor("o_totalprice").cast("long").alias("total_size"), values.seconds(F.col("o_orderdate")).alias("created_at"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as members, each where the ones before end."""
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))  # noqa: E741
    size = F.col("l_quantity").cast("long") * 100
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", size)
    step = (512 + F.call_function("div", size + 511, F.lit(512)) * 512).cast("long")
    begin = F.coalesce(F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return l.select(
        F.col("l_orderkey").alias("archive_id"), begin.alias("hdr_offset"), (begin + 512).alias("data_offset"), size.alias("size"), F.when(F.col("l_linenumber") == 6, "5").otherwise("0").alias("type"),
        F.lit(420).cast("long").alias("mode"), values.seconds(F.col("l_shipdate")).alias("mtime"), F.lower("l_returnflag").alias("uname"), F.lower("l_linestatus").alias("gname"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lower("p_brand"), F.lit("/s"), (F.col("l_suppkey") % 3).cast("string"), F.lit("/x/y"))).alias("dir"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("l_linenumber") % 2 == 0, ".bb").otherwise(".txt")).alias("name"),
    )


#: (folder, name, kind): a file for every rule of the classifier, with the kind it must get from SAMPLE_RULES.
SAMPLES = [
    ("", "run1_xyts.e3d", "xyts"), ("", "20120101.mseed", "wf_recorded"), ("/recorded", "sta.000", "wf_recorded"), ("", "vp3dfile.p", "vm"),
    ("", "perturbation_1.bin", "vm_pert"), ("", "sta.bb", "wf_nc_bb"), ("", "sta.lf", "wf_nc_lf"), ("", "r3_hf.h5", "wf_h5_hf"), ("", "broadband.h5", "wf_h5_bb"),
    ("", "run_seis.nc", "wf_seis_nc"), ("", "run_seis-00.e3d", "wf_seis"), ("/conv", "a.nc", "wf_lf_converted"), ("", "run_lf.bin", "wf_bin_lf"),
    ("", "sta.090", "wf_ascii"), ("", "run_hf_1.tar", "wf_bin_hf"), ("", "lf.tar", "lf_mix"), ("", "im.tar", "im"), ("", "srf_all.tar", "src"),
    ("", "vms.tar", "vm"), ("/run_bb", "data.tar", "wf_bin_bb"), ("", "a.tar.aa", "unknown_archive"), ("/vm", "grid.dat", "vm"), ("", "fault.srf", "src"),
    ("/sources", "x.txt", "src"), ("", "out.csv", "im"), ("/im_out", "x.txt", "im"), ("", "readme.txt", "other"),
]
SAMPLE_RULES = rule_words(recorded=("/recorded",), im_folders=("im_out",), lf_converted=("/conv",), keep=("/asia",))
#: (name, kind): tarballs by name.
SAMPLE_ARCHIVES = [("x_bb.tar", "wf_bin_bb"), ("hf_3.tar", "wf_bin_hf"), ("lf.tar", "lf_mix"), ("im.tar", "im"), ("my_source.tar", "src"), ("vm.tar", "vm"), ("a.tar", "unknown_archive"), ("outbin.tar", "lf_mix")]


def sampled(index: Column, samples: list[tuple[str, ...]], field: int) -> Column:
    return F.element_at(F.array(*[F.lit(s[field]) for s in samples]), (index % len(samples) + 1).cast("int"))


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with the samples' folders and names, its contents hashed."""
    f, i = files(spark, sf_dir), F.call_function("div", F.col("size"), F.lit(1024))
    f = f.withColumns({"folder": F.concat("folder", sampled(i, SAMPLES, 0)), "name": sampled(i, SAMPLES, 1), "content_hash": F.sha2("content_hash", 256)})
    return f.withColumn("ext", paths.extension(F.col("name")))


def sample_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders as archives by the samples' names, of one part each, whose members are the samples."""
    content = F.concat_ws(":", F.col("l_partkey"), F.col("l_quantity").cast("long"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition(tasks(spark, sf_dir, "lineitem"), "l_orderkey")
    parts = lines.groupBy(F.col("l_orderkey").alias("archive_id")).agg(F.sha2(F.min(content), 256).alias("content_hash"))
    m, i = members(spark, sf_dir), F.call_function("div", F.col("size"), F.lit(100))
    return {
        "archives": archives(spark, sf_dir).withColumns({"name": sampled(F.col("id"), SAMPLE_ARCHIVES, 0), "folder": F.lit("/arch")}), "parts": parts,
        "members": m.withColumns({"dir": F.concat(F.lit("d"), sampled(i, SAMPLES, 0)), "name": sampled(i, SAMPLES, 1)}),
    }


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(str((i, *r)) for i, r in enumerate(rows))})"


FOLDERS_SQL = """folders AS (
  SELECT s_suppkey, '/' || lower(r_name) || '/' || lower(n_name) || '/supplier' || CAST(s_suppkey AS VARCHAR) AS folder
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FILES_SQL = FOLDERS_SQL + """, named AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, folder, l_shipdate, p_size,
    replace(p_name, ' ', '_') || '_' || CAST(l_linenumber AS VARCHAR) ||
    CASE l_linenumber % 5 WHEN 1 THEN '.tar' WHEN 2 THEN '.bb' WHEN 3 THEN '.csv' WHEN 4 THEN '' ELSE '.nc' END AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN folders ON l_suppkey = s_suppkey
), files AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, q) AS id, folder, name,
    regexp_extract(lower(name), '^.+\\.([^.]{1,12})$', 1) AS ext, CAST(q * p_size * 1024 AS BIGINT) AS size,
    CASE WHEN l_linenumber <> 7 THEN concat_ws(':', l_partkey, q) END AS content_hash, CAST(epoch(l_shipdate) AS BIGINT) AS modified
  FROM named), up AS (
  SELECT DISTINCT folder, array_to_string(list_slice(string_split(folder, '/'), 1, n), '/') AS ancestor
  FROM (SELECT DISTINCT folder FROM files), unnest([2, 3, 4]) AS t(n))""".replace("\\\\", "\\")

ARCHIVES_SQL = """archives AS (
  SELECT o_orderkey AS id, 'a' || CAST(o_custkey % 50 AS VARCHAR) || '.tar' AS name, '/arch/' || lower(substr(o_orderpriority, 1, 1)) AS folder,
    CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'walking' ELSE 'stale' END AS state, CAST(floor(o_totalprice) AS BIGINT) AS total_size, CAST(epoch(o_orderdate) AS BIGINT) AS created_at
  FROM orders)"""

MEMBERS_SQL = """lines AS (
  SELECT *, CAST(l_quantity AS BIGINT) * 100 AS size FROM lineitem JOIN part ON l_partkey = p_partkey
), placed AS (
  SELECT *, CAST(coalesce(sum(512 + (size + 511) // 512 * 512) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hdr_offset FROM lines
), members AS (
  SELECT l_orderkey AS archive_id, hdr_offset, hdr_offset + 512 AS data_offset, size, CASE WHEN l_linenumber = 6 THEN '5' ELSE '0' END AS type,
    420 AS mode, CAST(epoch(l_shipdate) AS BIGINT) AS mtime, lower(l_returnflag) AS uname, lower(l_linestatus) AS gname,
    CASE WHEN l_linenumber = 1 THEN '' ELSE lower(p_brand) || '/s' || CAST(l_suppkey % 3 AS VARCHAR) || '/x/y' END AS dir,
    replace(p_name, ' ', '_') || CASE WHEN l_linenumber % 2 = 0 THEN '.bb' ELSE '.txt' END AS name FROM placed)"""

#: ``walk`` over the samples: rows_(folder, kind, how, size, date).
SAMPLE_ROWS_SQL = f"""{FILES_SQL}, {ARCHIVES_SQL}, {MEMBERS_SQL}, {values_sql("samples", "i, sub, name, kind", SAMPLES)}, {values_sql("tarballs", "i, name, kind", SAMPLE_ARCHIVES)},
split(i, kind, part, share) AS (VALUES {', '.join(str((i, 'lf_mix', *r)) for i, r in enumerate(LF_SHARES.items()))}),
listed AS (SELECT archive_id, sum(size) AS listed FROM members WHERE size > 0 AND type = '0' GROUP BY 1),
trust AS (SELECT id, t.kind AS tar_kind, listed, state = 'complete' AS finished, coalesce(listed, 0) > 0 AND (state = 'complete' OR coalesce(listed, 0) * 2 >= total_size) AS trusted
  FROM archives LEFT JOIN listed ON archive_id = id JOIN tarballs t ON t.i = id % {len(SAMPLE_ARCHIVES)}),
part AS (SELECT l_orderkey AS archive_id, min(concat_ws(':', l_partkey, CAST(l_quantity AS BIGINT))) AS content_hash FROM lineitem GROUP BY 1),
owner AS (SELECT content_hash, archive_id, trusted, tar_kind FROM part JOIN trust ON id = archive_id QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY trusted DESC, finished DESC, id DESC) = 1),
oldest AS (SELECT content_hash, min(modified) AS oldest FROM files WHERE content_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
found AS (SELECT f.folder || s.sub AS folder, f.size, f.modified, oldest, archive_id, coalesce(trusted, false) AS trusted, CASE WHEN archive_id IS NOT NULL THEN tar_kind WHEN s.kind = 'vm' AND starts_with(f.folder, '/asia') THEN 'vm_kept' ELSE s.kind END AS kind,
    archive_id IS NOT NULL OR s.name LIKE '%.tar' OR s.name LIKE '%.tar.%' AS named
  FROM files f JOIN samples s ON s.i = f.size // 1024 % {len(SAMPLES)} LEFT JOIN owner USING (content_hash) LEFT JOIN oldest USING (content_hash)),
whole AS (SELECT folder, kind, CASE WHEN named THEN 'name' ELSE 'loose' END AS how, CAST(size AS DOUBLE) AS size, CASE WHEN named THEN modified ELSE coalesce(oldest, modified) END AS date FROM found WHERE NOT trusted
  UNION ALL SELECT a.folder, s.kind, 'members', a.held * m.size / listed, m.mtime FROM (SELECT archive_id, folder, CAST(sum(size) AS DOUBLE) AS held FROM found WHERE trusted GROUP BY 1, 2) a
    JOIN members m USING (archive_id) JOIN listed USING (archive_id) JOIN samples s ON s.i = m.size // 100 % {len(SAMPLES)} WHERE m.size > 0 AND m.type = '0'),
rows_ AS (SELECT folder, coalesce(part, kind) AS kind, how, size * coalesce(CAST(share AS DOUBLE), 1) AS size, date FROM whole LEFT JOIN split USING (kind) WHERE size > 0)"""
