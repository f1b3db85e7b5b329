"""Commands over catalogs stored as Parquet: ``python -m stowage.cli COMMAND ...``.

A listing catalog is a folder with the tables files and folders (and events), as the ingestion writes it; an archive catalog
one with archives, parts, segments and members.  Exit codes: 0 fine, 1 differences or a failed verdict, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import itertools
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import kinds as KF
from .functions import values
from .operators import archives as A
from .operators import catalogs as C
from .operators import figures as G
from .operators import kinds as K
from .operators import recheck
from .operators import reports as R
from .session import session
from .sources import blocks, listing, sinks, store, tar, windows
from .streaming import sink


#: Members that a message lists.
AMONG = 20


def listing_files(spark: SparkSession, root: str) -> DataFrame:
    return sink.read_catalog(spark, root)["files"]


def show(df: DataFrame, rows: int = 50) -> None:
    found = df.take(rows)
    print("\t".join(df.columns))
    for r in found:
        print("\t".join("" if v is None else str(v) for v in r))


def cmd_run(spark, a) -> int:
    """Ingest stored pages into a catalog; running it again goes on from where it stopped."""
    listing.register(spark)
    entries = spark.readStream.format("listing_pages").option("path", a.pages).option("shard_id", a.shard).load()
    query = sink.ingest_stream(entries, a.catalog, f"{a.catalog}/_checkpoint", a.shard_path, once=False)
    query.processAllAvailable()
    query.stop()
    return 0


def cmd_compact(spark, a) -> int:
    """Put a catalog's batches together, so that later commands need not."""
    print(f"batches up to {sink.compact(spark, a.catalog, a.remove)}")
    return 0


def cmd_status(spark, a) -> int:
    c = sink.read_catalog(spark, a.catalog)
    show(c["files"].agg(F.count("*").alias("files"), F.sum("size").alias("bytes")))
    show(c["events"].groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind"))
    return 0


def cmd_report(spark, a) -> int:
    files = listing_files(spark, a.catalog).persist()
    now = a.as_of or int(time.time())
    for title, df in (
        ("duplicates", R.duplicates_total(files)), ("largest duplicates", R.duplicates_top(files, 20)), ("older than", R.older_than(files, [2.0, 5.0, 10.0], now).orderBy("years")),
        ("by year", R.cold_by_year(files).orderBy("year")), ("largest folders", R.top_folders(files, 20)), ("top level", R.top_level(files, a.root).orderBy(F.desc("bytes"), "folder")),
        ("small files", R.hotspots(files)), ("extensions", R.extension_profile(files)),
    ):
        print(f"\n# {title}")
        show(df)
    files.unpersist()
    return 0


def cmd_export(spark, a) -> int:
    sinks.export_listing(listing_files(spark, a.catalog), a.out)
    return 0


#: Columns without which a table is no archive catalog's.
NEEDED = {
    "archives": {"id", "name", "folder", "state", "total_size"}, "parts": {"archive_id", "idx", "name", "size"},
    "segments": {"archive_id", "idx"}, "members": {"archive_id", "hdr_offset", "data_offset", "size", "type", "dir", "name"},
}


def archive_tables(spark, root: str) -> dict[str, DataFrame]:
    """The archive tables, refused if one is missing or lacks a column; rows of an archive without its own row, which is written last, belong to a try that was cut off."""
    t = {}
    for name, needed in NEEDED.items():
        if not store.exists(f"{root}/{name}"):
            raise ValueError(f"{root} holds no archive index: {name} is missing")
        t[name] = spark.read.parquet(f"{root}/{name}")
        if lacking := sorted(needed - set(t[name].columns)):
            raise ValueError(f"{root}/{name} has no column {', '.join(lacking)}")
    told = t["archives"].select(F.col("id").alias("archive_id"))
    return {n: df if n == "archives" else df.join(told, "archive_id", "left_semi") for n, df in t.items()}


def cmd_kinds(spark, a) -> int:
    t = archive_tables(spark, a.archives) if a.archives else {}
    rows = K.walk(listing_files(spark, a.catalog), KF.load_rules(a.rules), t.get("archives"), t.get("parts"), t.get("members"), a.under)
    cube = K.tally(rows, a.as_of or int(time.time())).persist()
    show(K.kinds_by_group(cube).orderBy(KF.group_rank(F.col("grp"))))
    show(K.kinds_totals(cube))
    if a.out:
        sinks.export_kinds(cube, a.out)
    cube.unpersist()
    return 0


def cmd_tree(spark, a) -> int:
    """The tree page: folders by size, what repeats, is cold or tiny and where its copies are, and kinds of data."""
    rules = KF.load_rules(a.rules)
    t = archive_tables(spark, a.archives) if a.archives else {}
    files = listing_files(spark, a.catalog).persist()
    now = a.as_of or int(time.time())
    figures = G.folder_figures(files, now).persist()
    threshold, rows = G.layout(files, figures, a.root, values.parse_size(a.min_size), a.max_rows)
    rows = rows.persist()
    ranked = G.ranked_tables(figures, G.held_elsewhere(files), threshold)
    chosen = {name: G.choose(df.select("folder", "size", "held")) for name, df in ranked.items()}
    tables = {name: [(r["folder"], values.human_bytes(r["size"])) for r in found] for name, found in chosen.items()}
    if chosen["dup"]:
        mine = spark.createDataFrame([(r["folder"],) for r in chosen["dup"]], "folder string")
        places = {r["folder"]: r for r in G.counterparts(files, mine, paths_depth(a.root) + 2).collect()}
        held = {r["folder"]: r["held"] for r in chosen["dup"]}
        tables["dup"] = [(*row, f"{values.share(places[row[0]]['bytes'], held[row[0]])} of it in {places[row[0]]['place']}" if row[0] in places else "") for row in tables["dup"]]
    walk = K.walk(files, rules, t.get("archives"), t.get("parts"), t.get("members"), a.root or None).persist()
    cube = K.tally(walk, now).persist()
    tables["Where the bytes are, by kind"] = [(r["grp"], values.human_bytes(r["loose"]), values.human_bytes(r["tarred"])) for r in K.kinds_by_group(cube).orderBy(KF.group_rank(F.col("grp"))).collect()]
    tables["Bytes by kind and year"] = [(r["grp"], r["year"], values.human_bytes(r["size"])) for r in K.kinds_by_year(cube).orderBy(KF.group_rank(F.col("grp")), "year").collect()]
    shown = rows.filter("kind = 'dir'").select(F.col("name").alias("folder"))
    badges = {r["folder"]: f"{r['grp']} {values.share(r['size'], r['total'])}" for r in K.badges(walk, shown).collect()}
    saved = G.page_reclaimable(files, a.root).first()["reclaimable"]
    facts = [f"{values.human_bytes(saved)} would go if each content in here were kept once.", "Tarballs are shared out over the members that the archive index lists." if t else "Tarballs are judged by their names; give --archives to look inside them."]
    sinks.render_page(a.out, a.root, threshold, rows.collect(), tables, badges, facts)
    for df in (files, figures, rows, walk, cube):
        df.unpersist()
    print(f"{a.out}: entries of at least {values.human_bytes(threshold)}")
    return 0


def cmd_verify(spark, a) -> int:
    diff = C.verify_listing(listing_files(spark, a.catalog), listing.read_second_listing(spark, a.other), a.under).persist()
    show(diff.orderBy("path"))
    return 1 if diff.take(1) else 0


def cmd_archive_candidates(spark, a) -> int:
    show(A.candidate_sets(listing_files(spark, a.catalog)).orderBy(F.desc("size"), "folder", "name"))
    return 0


#: An archive's row, but for its identity.
ARCHIVE = "id long, name string, folder string, state string, total_size long, created_at long"


def next_archive(spark: SparkSession, root: str) -> int:
    """A number that no row bears, not even one of a try that was cut off."""
    found = [spark.read.parquet(f"{root}/{t}").agg(F.max("id" if t == "archives" else "archive_id")).first()[0] for t in ("archives", "parts", "segments", "members") if store.exists(f"{root}/{t}")]
    return max((n or 0 for n in found), default=0) + 1


def cmd_archive_run(spark, a) -> int:
    """Index the archives that a listing holds and the catalog does not, largest first; 1 if one of them did not reach its end."""
    files = listing_files(spark, a.catalog).persist()
    known = {t: spark.read.parquet(f"{a.archives}/{t}") if store.exists(f"{a.archives}/{t}") else None for t in ("archives", "segments")}
    archives = known["archives"] if known["archives"] is not None else spark.createDataFrame([], f"{ARCHIVE}, set_hash string")
    segments = known["segments"] if known["segments"] is not None else spark.createDataFrame([], "archive_id long")
    plan = A.run_plan(A.candidate_sets(files), archives, segments).persist()
    show(A.plan_counts(plan).orderBy("job"))
    todo = plan.filter(F.col("job").isin("new", "resume")).orderBy(F.desc("size"), "folder", "name")
    todo = (todo.limit(a.limit) if a.limit else todo).select("folder", F.col("name").alias("base"), F.col("size").alias("total"), "set_hash").persist()
    # the names of the parts, no bytes
    rows = A.part_rows(files).join(todo, ["folder", "base"]).orderBy(F.desc("total"), "folder", "base", "number", "name").collect()
    sets: dict[tuple, list] = {}
    for r in rows:
        sets.setdefault((r["folder"], r["base"]), []).append(r)
    if not sets:
        return 0
    first, now = next_archive(spark, a.archives), int(time.time())
    ids = {key: first + n for n, key in enumerate(sets)}
    told = [{"archive_id": ids[key], "parts": [f"{a.base.rstrip('/')}{r['folder']}/{r['name']}" for r in own]} for key, own in sets.items()]
    members, found = tar.index(spark, told, f"{a.archives}/_walk")
    found = found.persist()
    ending = A.chain_ending(found.filter("joined or state <> 'crossed'")).select(F.col("archive_id").alias("id"), F.col("state").alias("how"))
    made = spark.createDataFrame([(ids[key], key[1], key[0], own[0]["total"], now, own[0]["set_hash"]) for key, own in sets.items()], "id long, name string, folder string, total_size long, created_at long, set_hash string")
    # parts that are not what the listing says, now that they have been read, are of no one archive
    lying = {key for key, own in sets.items() if [f.size for f in store.files_at([p for t in told if t["archive_id"] == ids[key] for p in t["parts"]])] != [r["size"] for r in own]}
    changed = F.col("id").isin([ids[key] for key in lying])
    state = F.when(changed, "stale").when(F.col("how").isin("complete", "truncated", "unsupported"), F.col("how")).otherwise("corrupt").alias("state")
    made = made.join(ending, "id", "left").select("id", "name", "folder", state, "total_size", "created_at", "set_hash").persist()
    parts = spark.createDataFrame([(ids[key], n, r["name"], r["size"], r["offset"], r["content_hash"]) for key, own in sets.items() for n, r in enumerate(own)], "archive_id long, idx int, name string, size long, offset long, content_hash string")
    for name, df in (("segments", found), ("members", members), ("parts", parts), ("archives", made)):
        df.write.mode("append").parquet(f"{a.archives}/{name}")
    tar.forget_walks(spark, f"{a.archives}/_walk")
    show(made.select("folder", "name", "state").orderBy("id"))
    wrong = made.filter("state <> 'complete'").take(1)
    for df in (files, plan, todo, found, made):
        df.unpersist()
    return 1 if wrong else 0


def cmd_archive_index(spark, a) -> int:
    """Index the parts of one archive; 1 if the walk did not reach its end.  Cut off, it goes on where it was when called again."""
    parts = store.matching(a.parts)
    if not parts:
        print(f"no files match {a.parts}", file=sys.stderr)
        return 2
    archive_id = next_archive(spark, a.archives)
    members, segments = (df.withColumn("archive_id", F.lit(archive_id).cast("long")) for df in tar.index(spark, [{"archive_id": 0, "parts": [p.path for p in parts]}], f"{a.archives}/_walk"))
    state = ending_state(segments.persist())
    if store.files_at([p.path for p in parts]) != parts:
        state = "stale"  # a part changed while it was read: what the walk found is of no one archive
    total = sum(p.size for p in parts)
    begins = [0, *itertools.accumulate(p.size for p in parts)]
    rows = [(archive_id, i, p.path, os.path.basename(p.path), p.size, begins[i]) for i, p in enumerate(parts)]
    part_df = spark.createDataFrame(rows, "archive_id long, idx int, path string, name string, size long, offset long")
    hashes = blocks.content_hashes(spark, parts) if a.hash else spark.createDataFrame([], "path string, content_hash string")
    part_df = part_df.join(hashes, "path", "left").drop("path").persist()  # the bytes are hashed once
    # without all hashes there is no identity to compare by
    entries = F.sort_array(F.collect_list(F.struct("idx", F.coalesce(F.lower("content_hash"), F.lit("")).alias("content_hash"), "size")))
    identity = part_df.agg(F.when(F.count("content_hash") == F.count("*"), values.set_hash(entries)).otherwise("").alias("set_hash")).first()["set_hash"]
    archive = spark.createDataFrame([(archive_id, a.name, a.folder, state, total, int(time.time()), identity)], f"{ARCHIVE}, set_hash string")
    for name, df in (("segments", segments), ("members", members), ("parts", part_df), ("archives", archive)):
        df.write.mode("append").parquet(f"{a.archives}/{name}")
    tar.forget_walks(spark, f"{a.archives}/_walk")
    print(f"{a.name}: {state}")
    return 0 if state == "complete" else 1


def cmd_archive_recheck(spark, a) -> int:
    """Ask the verdict of an archive again, into a new catalog; each time it stays the same, one segment further back."""
    t = archive_tables(spark, a.archives)
    own = t["archives"].filter(F.col("id") == a.id)
    notes = spark.read.parquet(f"{a.archives}/rechecks") if store.exists(f"{a.archives}/rechecks") else spark.createDataFrame([], recheck.NOTES)
    asked = recheck.questions(t["segments"].filter(F.col("archive_id") == a.id), own.filter(F.col("state").isin("corrupt", "truncated", "unsupported")), notes).persist()
    told = asked.first()
    if not told:
        print(f"archive {a.id} has no verdict to ask again", file=sys.stderr)
        return 2
    parts = [p.path for p in store.matching(a.parts)]
    members, segments = tar.ask_again(spark, [{"archive_id": a.id, "parts": parts}], t["members"], t["segments"], asked, f"{a.out}/_walk", ask=told["again"] + 1)
    state = ending_state(segments.filter(F.col("archive_id") == a.id))
    archives_ = t["archives"].withColumn("state", F.when(F.col("id") == a.id, state).otherwise(F.col("state")))
    new_notes = notes.filter(F.col("archive_id") != a.id).unionByName(asked.drop("further"))
    for name, df in (("segments", segments), ("members", members), ("parts", t["parts"]), ("rechecks", new_notes), ("archives", archives_)):
        df.write.parquet(f"{a.out}/{name}")
    tar.forget_walks(spark, f"{a.out}/_walk")
    asked.unpersist()
    print(f"walked again from segment {told['again']}{' (further back: the verdict was the same)' if told['further'] else ''}: {state}")
    return 0 if state == "complete" else 1


def ending_state(segments: DataFrame) -> str:
    """The state that a walk gives its archive."""
    ending = A.chain_ending(segments.filter("joined or state <> 'crossed'")).first()
    return ending["state"] if ending and ending["state"] in ("complete", "truncated", "unsupported") else "corrupt"


def cmd_archive_status(spark, a) -> int:
    show(A.by_state(spark.read.parquet(f"{a.archives}/archives")).orderBy("state"))
    return 0


def cmd_archive_report(spark, a) -> int:
    members = spark.read.parquet(f"{a.archives}/members").filter(F.col("archive_id") == a.id)
    show(A.summary(members).orderBy("section", F.desc("bytes"), "key"), 500)
    show(A.largest_members(members).select("dir", "name", "size"))
    return 0


def cmd_archive_export(spark, a) -> int:
    sinks.export_archive(spark.read.parquet(f"{a.archives}/members"), a.id, a.out)
    return 0


def cmd_archive_cat(spark, a) -> int:
    """Write one member's content to a file, or refuse.  Of members that share the path the one at ``--offset`` is meant; without it none is."""
    folder, _, name = a.path.rpartition("/")
    members = spark.read.parquet(f"{a.archives}/members").filter((F.col("archive_id") == a.id) & (F.col("dir") == folder) & (F.col("name") == name))
    found = members.filter(F.col("hdr_offset") == a.offset).take(1) if a.offset is not None else members.take(2)
    if len(found) != 1:
        told = members.orderBy("hdr_offset").take(AMONG)
        if not told:
            print(f"{a.path} is not in archive {a.id}", file=sys.stderr)
            return 1
        print(f"{a.path} is not at {a.offset} in archive {a.id}; it is at:" if a.offset is not None else f"{a.path} is in archive {a.id} more than once; name one:", file=sys.stderr)
        for r in told:
            print(f"  --offset {r['hdr_offset']}  size={r['size']}  mtime={r['mtime']}", file=sys.stderr)
        return 2
    parts = store.matching(a.parts)
    whole = tar.Parts([p.path for p in parts], [p.size for p in parts])
    handle, path = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(a.out)))
    try:
        with os.fdopen(handle, "wb") as f:
            for chunk in tar.stream_member(whole, found[0]["hdr_offset"], dir=folder, name=name, size=found[0]["size"], tries=a.tries):
                f.write(chunk)
        os.replace(path, a.out)
    except BaseException:
        os.unlink(path)
        raise
    return 0


def cmd_archive_same(spark, a) -> int:
    """Members of one name and size that seem to hold the same bytes, by windows sampled in each; 1 if any of them differ."""
    parts = store.matching(a.parts)
    archive = [{"archive_id": a.id, "parts": [p.path for p in parts], "sizes": [p.size for p in parts]}]
    members = archive_tables(spark, a.archives)["members"].filter(F.col("archive_id") == a.id)
    groups = A.same_content(blocks.signed(members, archive, a.samples, scope=a.scope), ["archive_id", "scope"]).persist()
    show(groups.select("scope", "name", "size", "members", "contents", "redundant").orderBy(F.desc(F.col("size") * F.col("redundant")), "scope", "name"), 500)
    show(groups.agg(F.count("*").alias("groups"), F.count_if(F.col("contents") > 1).alias("differ"), F.coalesce(F.sum(F.col("size") * F.col("redundant")), F.lit(0)).alias("redundant_bytes")))
    differ = groups.filter("contents > 1").take(1)
    groups.unpersist()
    return 1 if differ else 0


def cmd_archive_diagnose(spark, a) -> int:
    """What windows of the parts hold that walking did not expect: headers off the grid, and numbers off their phase; 1 if there are any."""
    found = windows.report(spark, store.matching(a.parts), a.window).persist()
    odd = found.filter("unaligned > 0 or (best_phase > 0 and best_share >= 0.9)")
    show(odd.orderBy("path", "at").select("path", "at", "aligned", "unaligned", "first_unaligned", "shift", "zeros", "best_phase", "best_share"), 500)
    show(found.agg(F.count("*").alias("windows"), F.sum("aligned").alias("aligned"), F.sum("unaligned").alias("unaligned"), F.sum("zeros").alias("zeros")))
    strange = odd.take(1)
    found.unpersist()
    return 1 if strange else 0


def cmd_archive_verify(spark, a) -> int:
    """Members whose header in the parts no longer says what the index does; 1 if there are any."""
    parts = store.matching(a.parts)
    archive = [{"archive_id": a.id, "parts": [p.path for p in parts], "sizes": [p.size for p in parts]}]
    members = archive_tables(spark, a.archives)["members"].filter(F.col("archive_id") == a.id)
    wrong = tar.verify_headers(members, archive).persist()
    show(wrong.select("hdr_offset", "dir", "name", "size").orderBy("hdr_offset"), 500)
    found = wrong.take(1)
    wrong.unpersist()
    return 1 if found else 0


def cmd_archive_import(spark, a) -> int:
    """Both catalogs as one, in a new folder."""
    merged = C.import_catalog(archive_tables(spark, a.archives), archive_tables(spark, a.other))
    for name, df in merged.items():
        df.write.parquet(f"{a.out}/{name}")
    return 0


def cmd_archive_forget(spark, a) -> int:
    kept = C.forget(archive_tables(spark, a.archives), spark.createDataFrame([(a.id,)], "archive_id long"))
    for name, df in kept.items():
        df.write.parquet(f"{a.out}/{name}")
    return 0


def cmd_sql(spark, a) -> int:
    """Any SQL over the catalog's views files, folders and events."""
    for name, df in sink.read_catalog(spark, a.catalog).items():
        df.createOrReplaceTempView(name)
    show(spark.sql(a.sql), a.rows)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stowage")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for names, kw in options:
            s.add_argument(*names.split(), **kw)

    cat, arch, out = ("catalog", {}), ("archives", {}), ("--out", {"required": True})
    as_of, ident = ("--as-of", {"type": int}), ("--id", {"type": int, "required": True})
    add("run", cmd_run, cat, ("--pages", {"required": True}), ("--shard", {"default": "0"}), ("--shard-path", {"default": ""}))
    add("compact", cmd_compact, cat, ("--remove", {"action": "store_true"}))
    add("status", cmd_status, cat)
    add("report", cmd_report, cat, as_of, ("--root", {"default": ""}))
    add("export", cmd_export, cat, out)
    add("kinds", cmd_kinds, cat, as_of, ("--rules", {}), ("--archives", {}), ("--under", {}), ("--out", {}))
    add("tree", cmd_tree, cat, out, as_of, ("--rules", {}), ("--archives", {}), ("--root", {"required": True}), ("--min-size", {"default": "1G"}), ("--max-rows", {"type": int, "default": 100_000}))
    add("verify", cmd_verify, cat, ("--other", {"required": True}), ("--under", {"default": ""}))
    add("sql", cmd_sql, cat, ("sql", {}), ("--rows", {"type": int, "default": 100}))
    add("archive-candidates", cmd_archive_candidates, cat)
    add("archive-index", cmd_archive_index, arch, ("--parts", {"required": True}), ("--name", {"required": True}), ("--folder", {"default": ""}), ("--hash", {"action": "store_true"}))
    add("archive-run", cmd_archive_run, cat, arch, ("--base", {"default": ""}), ("--limit", {"type": int, "default": 0}))
    add("archive-status", cmd_archive_status, arch)
    add("archive-report", cmd_archive_report, arch, ident)
    add("archive-export", cmd_archive_export, arch, ident, out)
    where = ("--parts", {"required": True})
    add("archive-cat", cmd_archive_cat, arch, ident, out, where, ("--offset", {"type": int}), ("--tries", {"type": int, "default": 0}), ("path", {}))
    add("archive-same", cmd_archive_same, arch, ident, where, ("--samples", {"type": int, "default": 4}), ("--scope", {"type": int, "default": 0}))
    add("archive-recheck", cmd_archive_recheck, arch, ident, where, out)
    add("archive-diagnose", cmd_archive_diagnose, where, ("--window", {"type": int, "default": 1 << 20}))
    add("archive-verify", cmd_archive_verify, arch, ident, where)
    add("archive-import", cmd_archive_import, arch, ("--other", {"required": True}), out)
    add("archive-forget", cmd_archive_forget, arch, ident, out)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if getattr(a, "root", None):
        a.root = paths_root(a.root)
    try:
        return a.run(spark or session("stowage"), a)
    except (KF.RulesError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2


def paths_root(root: str) -> str:
    return root.rstrip("/")


def paths_depth(root: str) -> int:
    """Folders that a path names."""
    return len([step for step in root.split("/") if step])


if __name__ == "__main__":
    sys.exit(main())
