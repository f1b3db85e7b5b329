"""Folder figures, held bytes, layout and kinds on cases worked out by hand and by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import kinds as KF
from stowage.operators import figures as G
from stowage.operators import kinds as K
from stowage.operators import tree as T
from stowage.sources import sinks

from .helpers import at, files, rows

NOW = at(2026, 6)


def held(spark, listing):
    return dict(rows(G.held_elsewhere(files(spark, listing)), "folder", "held"))


def test_held_elsewhere(spark):
    assert held(spark, [("/R/P/A/x/f", 100, "h", None), ("/R/P/B/x/g", 100, "h", None)]) == {"/R/P/A": 100, "/R/P/A/x": 100, "/R/P/B": 100, "/R/P/B/x": 100}
    assert held(spark, [("/R/A/f", 100, "h", None), ("/R/A/g", 100, "h", None)]) == {}
    assert held(spark, [("/R/A/f", 100, "h", None), ("/R/A/s/g", 100, "h", None)]) == {"/R/A/s": 100}
    assert held(spark, [("/R/A/f", 0, "h", None), ("/R/B/g", 0, "h", None), ("/R/C/g", 5, None, None)]) == {}


def test_held_against_brute_force(spark):
    r = random.Random(3)
    listing = [("/R/" + "/".join(r.choice("abc") for _ in range(r.randint(0, 4))) + f"/f{i}", r.randint(1, 9), r.choice("xyzuvw"), None) for i in range(120)]
    listing = [(p.replace("//", "/"), s, h, m) for p, s, h, m in listing]
    folders = {p[: i] for p, *_ in listing for i, c in enumerate(p) if c == "/" and i}
    want = {}
    for d in folders:
        n = sum(s for p, s, h, _ in listing if p.startswith(d + "/") and any(q[2] == h and not q[0].startswith(d + "/") for q in listing))
        if n:
            want[d] = n
    assert held(spark, listing) == want


def by_spreading(sized):
    """The same by counting each content in every folder above its copies."""
    own = sized.groupBy("content_hash", "folder").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    whole = own.groupBy("content_hash").agg(F.sum("n").alias("copies")).filter("copies > 1")
    up = T.spread_up(own.join(whole, "content_hash"), "folder", "at").groupBy("content_hash", "at").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("copies").alias("copies"))
    return up.filter("n < copies").groupBy(F.col("at").alias("folder")).agg(F.sum("bytes").alias("held"))


def shuffled(spark, df):
    """Bytes that the jobs of a query write for shuffles."""

    def stages():
        found = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    before = max(stages(), default=-1)
    df.write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k > before)


def test_held_in_a_deep_tree_with_less_than_half_the_shuffle(spark, tmp_path):
    """60,000 files of 20,000 contents in 1,000 folders of depth 20."""
    n = F.col("id")
    step = lambda k: F.concat(F.lit("/d"), (F.shiftright((n % 1000) * 2654435761, k) % 2).cast("string"))
    sized = spark.range(60_000).select(F.concat(*[step(k) for k in range(20)]).alias("folder"), (n * 7919 % 20_011).cast("string").alias("content_hash"), (n % 97 + 1).alias("size"))
    sized.write.parquet(f"{tmp_path}/files")
    sized = spark.read.parquet(f"{tmp_path}/files")
    assert rows(G.held_elsewhere(sized), "folder", "held") == rows(by_spreading(sized), "folder", "held")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        assert shuffled(spark, G.held_elsewhere(sized)) < 0.5 * shuffled(spark, by_spreading(sized))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_held_at_the_root_and_beside_names_that_sort_before_a_slash(spark):
    listing = [("f", 5, "h", None), ("/a/f", 5, "h", None), ("/b/x", 3, "k", None), ("/b!/x", 3, "k", None), ("/b/c/x", 3, "k", None), ("g", 2, "r", None), ("g2", 2, "r", None)]
    f = files(spark, listing)
    assert rows(G.held_elsewhere(f), "folder", "held") == rows(by_spreading(f.filter("content_hash is not null")), "folder", "held")


def test_counterparts_against_every_pair(spark):
    r = random.Random(9)
    folder = lambda: "/" + "/".join(r.choice("PQ") + r.choice("ab") for _ in range(r.randint(1, 5)))
    listing = [(folder() + f"/f{i}", r.randint(1, 99), r.choice("stuvwxyz"), None) for i in range(150)]
    chosen = ["/Pa/Pb", "/Qa/Qa/Pa", "/Qb", "/Pb/Pa", "/Pa/Qa/Qb"]
    up = lambda p: ["/".join(p.split("/")[:k]) for k in range(2, len(p.split("/")) + 1)]
    home = lambda p: next((c for c in chosen if p == c or p.startswith(c + "/")), None)
    for floor in (1, 2, 3):
        want = []
        for mine in chosen:
            credit = {}
            for content in {h for _, _, h, _ in listing}:
                copies = [(p.rpartition("/")[0], s) for p, s, h, _ in listing if h == content]
                held = sum(s for p, s in copies if home(p) == mine)
                places = set()
                for p in {p for p, _ in copies if home(p) != mine}:
                    shared = len([a for a in up(p) if a in up(mine)])
                    places.add(up(p)[max(shared + 1, floor) - 1] if max(shared + 1, floor) <= len(up(p)) else p)
                for at in places if held else ():
                    credit[at] = credit.get(at, 0) + held
            if credit:
                best = min(credit, key=lambda a: (-credit[a], a))
                want.append((mine, best, credit[best]))
        got = G.counterparts(files(spark, listing), spark.createDataFrame([(c,) for c in chosen], "folder string"), floor)
        assert rows(got, "folder", "place", "bytes") == sorted(want)


def test_page_reclaimable(spark):
    listing = [("/R/A/x1", 100, "x", None), ("/R/A/x2", 100, "x", None), ("/R/B/x3", 100, "x", None), ("/R/A/y1", 7, "y", None), ("/R/A/y2", 7, "y", None)]
    f = files(spark, listing).withColumn("folder", F.lower("folder"))
    assert rows(G.page_reclaimable(f, "/R"), "reclaimable") == [(207,)]
    assert rows(G.page_reclaimable(f, "/R/A"), "reclaimable") == [(207,)]
    assert rows(G.page_reclaimable(f, "/R/B"), "reclaimable") == [(100,)]


def test_figures(spark):
    f = files(spark, [("/R/a/x", 5, None, at(2020)), ("/R/a/b/y", 7, None, at(2030)), ("/R/c/z", 1, None, at(2026))])
    got = {r[0]: r[1:] for r in rows(G.folder_figures(f, NOW), "folder", "own_files", "files", "folders", "kids", "size", "newest", "cold")}
    assert got["/R"] == (0, 3, 3, 2, 13, at(2026), 5)
    assert got["/R/a"] == (1, 2, 1, 1, 12, at(2020), 5)
    assert got["/R/a/b"] == (1, 1, 0, 0, 7, None, 0)


def test_counterparts(spark):
    listing = [("/P/A/f1", 60, "x", None), ("/P/A/f2", 40, "y", None), ("/P/B/g1", 60, "x", None), ("/P/C/g2", 40, "y", None), ("/P/B/g3", 60, "x", None)]
    chosen = spark.createDataFrame([("/P/A",)], "folder string")
    assert rows(G.counterparts(files(spark, listing), chosen), "folder", "place", "bytes") == [("/P/A", "/P/B", 60)]
    deep = [("/S/A/f", 10, "x", None), ("/T/deep/down/g", 10, "x", None)]
    assert rows(G.counterparts(files(spark, deep), spark.createDataFrame([("/S/A",)], "folder string"), floor=2), "place", "bytes") == [("/T/deep", 10)]


def test_choose(spark):
    ranked = spark.createDataFrame([("/A/D", 9), ("/A", 8), ("/A/D/x", 7), ("/Z", 6), ("/A/E", 5)], "folder string, n int").coalesce(1)
    assert [r["folder"] for r in G.choose(ranked)] == ["/A/D", "/Z", "/A/E"]
    assert [r["folder"] for r in G.choose(ranked, 2)] == ["/A/D", "/Z"]


def test_choose_in_rounds(spark):
    # a chain of nested folders hides what comes after it: each round drops it on the executors
    paths = ["/" + "/".join("abcdefgh"[: n + 1]) for n in range(8)]
    order = paths + [f"/x{i}/" + "/".join("pqrst"[: n + 1]) for i in range(3) for n in range(5)] + ["/", "rel", "rel/in", "relative"]
    ranked = spark.createDataFrame(list(enumerate(order)), "r long, folder string").orderBy("r")

    def by_hand(limit):
        taken = []
        for f in order:
            if len(taken) < limit and not any(f == t or f.startswith(t + "/") or t.startswith(f + "/") for t in taken):
                taken.append(f)
        return taken

    for limit in (1, 2, 3, 5, 25):
        assert [r["folder"] for r in G.choose(ranked, limit, at_once=1)] == by_hand(limit)


@pytest.mark.parametrize("max_rows", [6, 12, 1000])
def test_layout_adds_up(spark, tmp_path, max_rows):
    r = random.Random(1)
    f = files(spark, [(f"/r/{r.choice('abc')}/{r.choice('xy')}/f{i}", r.randint(0, 4000), None, None) for i in range(60)])
    figures = G.folder_figures(f, NOW)
    threshold, page = G.layout(f, figures, "/r", 100, max_rows)
    got = page.collect()
    assert len(got) <= max_rows or threshold > 60 * 4000
    below = {}
    for x in got:
        below.setdefault(x["parent"], []).append(x)
    for d in got:
        if d["kind"] == "dir":
            inside = below.get(d["name"], [])
            assert sum(x["size"] for x in inside) == d["size"]
            assert sum(x["files"] for x in inside) == d["files"]
        if d["kind"] != "fold" and d["parent"]:
            assert d["size"] >= threshold
    if max_rows > 6:
        smaller, more = G.layout(f, figures, "/r", threshold // 2, 10_000)
        if threshold > 100:
            assert more.count() > max_rows
    sinks.render_page(f"{tmp_path}/page.html", "/r <x>", threshold, got, {"dup": [("a&b", 1)]})
    text = open(f"{tmp_path}/page.html", encoding="utf-8").read()
    assert "/r &lt;x&gt;" in text and "a&amp;b" in text and text.count("<details") == sum(x["kind"] == "dir" for x in got)


def test_nearest_shown(spark):
    at_ = spark.createDataFrame([("/a/b/c", 1), ("/a/x", 2), ("/q", 3)], "folder string, n int")
    shown = spark.createDataFrame([("/a",), ("/a/b",)], "folder string")
    assert rows(T.nearest_shown(at_, shown), "folder", "shown") == [("/a/b/c", "/a/b"), ("/a/x", "/a")]


CASES = [
    ("/r", "a_xyts.e3d", "xyts"), ("/r", "x.mseed", "wf_recorded"), ("/r/rec", "x.zip", "wf_recorded"), ("/r", "x.zip", "other"), ("/r", "vs3dfile.s", "vm"), ("/r", "velocity_model_1", "vm"),
    ("/r", "a.pertb.b", "vm_pert"), ("/r", "perturbation_1", "vm_pert"), ("/r", "x.bb", "wf_nc_bb"), ("/r", "r12_hf.h5", "wf_h5_hf"), ("/r", "broadband.h5", "wf_h5_bb"), ("/r", "seis1.nc", "wf_seis_nc"),
    ("/r", "a_seis.e3d", "wf_seis"), ("/r/conv", "x.nc", "wf_lf_converted"), ("/r", "x.nc", "other"), ("/r", "a_lf.bin", "wf_bin_lf"), ("/r", "x.000", "wf_ascii"), ("/r/rec", "x.000", "wf_recorded"),
    ("/r", "a_bb.tar", "wf_bin_bb"), ("/r", "x_hf_12.tar.gz", "wf_bin_hf"), ("/r/z_bb", "q.tar", "wf_bin_bb"), ("/r", "x_lf.tar", "lf_mix"), ("/r", "outbin.tar", "lf_mix"), ("/r", "x_im.tar", "im"),
    ("/r", "source1.tar", "src"), ("/r", "x_vms.tar", "vm"), ("/r", "q.tar", "unknown_archive"), ("/r/vm", "x", "vm"), ("/r/b_vm", "x", "vm"), ("/r/mine", "x", "vm"), ("/r", "x.srf", "src"), ("/r/sources", "x", "src"),
    ("/r", "x.csv", "im"), ("/r/hazard", "x", "im"), ("/r", "x.txt", "other"),
]


def test_classifier(spark):
    rules = KF.rule_words(recorded=("REC",), im_folders=("/hazard/",), lf_converted=("conv",), vm_folders=("mine",))
    df = spark.createDataFrame(CASES, "folder string, name string, want string")
    got = df.withColumn("facts", KF.folder_facts(F.col("folder"), rules)).withColumn("kind", KF.classify(F.col("facts"), F.col("name")))
    assert got.filter("kind <> want").select("folder", "name", "want", "kind").collect() == []


def kinds(spark, walked):
    return {(r[0], r[1]): round(r[2], 6) for r in rows(walked.groupBy("kind", "how").agg(F.sum("size").alias("size")), "kind", "how", "size")}


def archive_tables(spark, total, state, members, parts):
    a = spark.createDataFrame([(1, "x.tar", "/R", state, total)], "id long, name string, folder string, state string, total_size long")
    p = spark.createDataFrame([(1, h) for h in parts], "archive_id long, content_hash string")
    m = spark.createDataFrame([(1, "0", d, n, s, t) for d, n, s, t in members], "archive_id long, type string, dir string, name string, size long, mtime long")
    return a, p, m


H1, H2 = "11" * 32, "22" * 32


def test_copies_take_the_oldest_date(spark):
    w = K.walk(files(spark, [("/R/x.txt", 5, H1, at(2020)), ("/R/b/x.txt", 5, H1, at(2025)), ("/R/c/x.txt", 5, H1, None)]))
    assert rows(w, "date") == [(at(2020),)] * 3
    one = K.walk(files(spark, [("/R/x.txt", 5, H1, at(2020)), ("/R/b/x.txt", 5, H1, at(2025))]), under="/R/b")
    assert rows(one, "date") == [(at(2020),)]


def test_members_share_out_their_archive(spark):
    t = archive_tables(spark, 1000, "complete", [("", "faultsz03_bb.bin", 600, at(2023)), ("/vm", "x", 300, at(2021))], [H1])
    w = K.walk(files(spark, [("/R/x.tar", 900, H1, at(2025))]), KF.rule_words(), *t)
    assert rows(w, "kind", "size", "how", "date") == [("vm", 300.0, "members", at(2021)), ("wf_bin_bb", 600.0, "members", at(2023))]
    t = archive_tables(spark, 1000, "complete", [("", "a_bb.bin", 900, 1), ("", "x.srf", 100, 1)], [H1, H2])
    w = K.walk(files(spark, [("/R/x.tar.aa", 600, H1, None), ("/R/x.tar.ab", 400, H2, None), ("/R/copy.aa", 600, H1, None)]), KF.rule_words(), *t)
    assert kinds(spark, w) == {("wf_bin_bb", "members"): 1440, ("src", "members"): 160}


@pytest.mark.parametrize(("state", "listed", "how"), [("walking", 400, "name"), ("walking", 500, "members"), ("stale", 499, "name"), ("truncated", 100, "members"), ("complete", 100, "members")])
def test_trust(spark, state, listed, how):
    t = archive_tables(spark, 1000, state, [("", "a.txt", listed, 1)], [H1])
    w = K.walk(files(spark, [("/R/x.tar", 1000, H1, 1)]), KF.rule_words(), *t)
    assert {r[0] for r in rows(w, "how")} == {how}


def test_lf_tarballs_are_split(spark):
    w = K.walk(files(spark, [("/R/x_lf.tar", 1000, None, 5)]))
    assert kinds(spark, w) == {("wf_seis_tar", "name"): 303, ("xyts", "name"): 684, ("other", "name"): 13}


def test_tally(spark):
    year = 365.25 * 86400
    data = [("/R", "vm", 10.0, "loose", int(NOW - 0.4 * year)), ("/R", "vm", 20.0, "members", int(NOW - 1.5 * year)), ("/R", "xyts", 40.0, "name", int(NOW - 6 * year)), ("/R", "xyts", 80.0, "loose", None), ("/R", "im", 0.0, "loose", 1)]
    cube = K.tally(spark.createDataFrame(data, "folder string, kind string, size double, how string, date long"), NOW)
    assert rows(K.kinds_table(cube), "kind", "loose", "tarred") == [("vm", 10.0, 20.0), ("xyts", 80.0, 40.0)]
    assert [r for r in rows(K.kinds_older(cube), "kind", "years", "loose", "tarred") if r[0] == "vm"] == [("vm", 0.5, 0.0, 20.0), ("vm", 1.0, 0.0, 20.0)]
    assert rows(K.kinds_totals(cube), "total", "members", "by_name", "undated") == [(150.0, 20.0, 40.0, 80.0)]
    assert len(rows(K.kinds_by_month(cube), "kind", "month")) == 3


def test_keep_prefix(spark):
    w = K.walk(files(spark, [("/R/Keep/vm/x", 1, None, None), ("/R/vm/y", 2, None, None)]), KF.rule_words(keep=("/r/keep",)))
    assert kinds(spark, w) == {("vm_kept", "loose"): 1, ("vm", "loose"): 2}


def test_rules_file(tmp_path):
    p = tmp_path / "r.toml"
    p.write_text('recorded = ["Stations"]\n')
    assert KF.load_rules(str(p))["recorded"] == ("stations",) and KF.load_rules(None) == KF.rule_words()
    for bad in ("x = [1]", 'keep = "a"', "keep = [1]", "= ="):
        p.write_text(bad)
        with pytest.raises(KF.RulesError):
            KF.load_rules(str(p))
    with pytest.raises(KF.RulesError):
        KF.load_rules(str(tmp_path / "none"))


def test_rules_file_names_all_its_problems(tmp_path):
    p = tmp_path / "r.toml"
    p.write_text('other = ["a"]\nkeep = "a"\nrecorded = [1]\nim_folders = ["IM"]\n')
    with pytest.raises(KF.RulesError) as refused:
        KF.load_rules(str(p))
    assert all(name in str(refused.value) for name in ("other", "keep", "recorded"))
    p.write_text('im_folders = ["/IM/"]\nkeep = []\n')
    assert KF.load_rules(str(p)) == KF.rule_words(im_folders=("/im/",))


def tree_page(spark, tmp_path, entries, *more):
    """The page of a catalog made of (path, size, content) entries below /R."""
    import json

    from stowage import cli
    from stowage.operators import ingest
    from stowage.sources import listing
    from stowage.streaming import sink

    (tmp_path / "p").mkdir(exist_ok=True)
    made = [{".tag": "file", "id": f"f{i}", "name": p.rsplit("/", 1)[1], "path_display": p, "size": n, "content_hash": h, "client_modified": "2024-01-01T00:00:00Z"} for i, (p, n, h) in enumerate(entries)]
    (tmp_path / "p" / "00000000.json").write_text(json.dumps({"entries": made}))
    sink.write_batch(f"{tmp_path}/c", "/R")(listing.read_pages(spark, f"{tmp_path}/p"), 0)
    code = cli.main(["tree", f"{tmp_path}/c", "--root", "/R", "--out", f"{tmp_path}/t.html", "--min-size", "1B", "--as-of", "1750000000", *more], spark)
    return code, open(f"{tmp_path}/t.html", encoding="utf-8").read() if code == 0 else ""


def test_tree_page_shows_kinds_counterparts_and_what_repeats(spark, tmp_path):
    x, y = "ab" * 32, "cd" * 32
    code, page = tree_page(spark, tmp_path, [("/R/P/A/f", 30, x), ("/R/P/B/x/f", 30, x), ("/R/P/A/g", 10, y), ("/R/Q/g", 10, y), ("/R/a/vp3dfile.p", 300, None), ("/R/a/notes.txt", 100, None), ("/R/m/vp3dfile.p", 40, None), ("/R/m/x.srf", 30, None), ("/R/m/notes.txt", 30, None)])
    assert code == 0
    assert "<td>/R/P/A</td><td>40 B</td><td>75% of it in /R/P/B</td>" in page
    assert "40 B would go" in page and "judged by their names" in page
    summary = lambda name: next(line for line in page.split("\n") if f"</span> " in line and f" {name} (" in line)
    assert '<span class="k">velocity models 75%</span>' in summary("a") and 'class="k"' not in summary("m")
    assert "<h2>Where the bytes are, by kind</h2>" in page and "<td>velocity models</td><td>340 B</td><td>0 B</td>" in page
    assert "<h2>Bytes by kind and year</h2>" in page and "<td>rupture sources</td><td>2024</td><td>30 B</td>" in page


def test_tree_page_looks_inside_tarballs_and_refuses_bad_rules(spark, tmp_path):
    h = "ee" * 32
    t = {
        "archives": spark.createDataFrame([(1, "a.tar", "/R/t", "complete", 1000, 1)], "id long, name string, folder string, state string, total_size long, created_at long"),
        "parts": spark.createDataFrame([(1, 0, "a.tar", 1000, h)], "archive_id long, idx int, name string, size long, content_hash string"),
        "segments": spark.createDataFrame([(1, 0)], "archive_id long, idx int"),
        "members": spark.createDataFrame([(1, 0, 512, 1000, "0", 1_700_000_000, "", "vp3dfile.p")], "archive_id long, hdr_offset long, data_offset long, size long, type string, mtime long, dir string, name string"),
    }
    for name, df in t.items():
        df.write.parquet(f"{tmp_path}/arch/{name}")
    code, page = tree_page(spark, tmp_path, [("/R/t/a.tar", 1000, h)], "--archives", f"{tmp_path}/arch")
    assert code == 0 and "velocity models 100%" in page and "shared out over the members" in page and "judged by their names" not in page
    assert tree_page(spark, tmp_path, [("/R/t/a.tar", 1000, h)], "--rules", f"{tmp_path}/missing.toml")[0] == 2


def test_walk_reads_folders_and_names_where_they_are(spark):
    """Only contents are joined with a listing, never its folders; a file without a folder counts, and contents are told apart by case."""
    listed = files(spark, [("/a/x.bb", 3, "h", 50), ("/b/y.bb", 4, "h", 20), ("/b/z.bb", 5, "H", 90), ("/c/n.bb", 6, None, 70)])
    listed = listed.withColumn("folder", F.when(F.col("folder") != "/c", F.col("folder")))
    walked = K.walk(listed)
    assert walked._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted((r["size"], r["date"]) for r in walked.collect()) == [(3, 20), (4, 20), (5, 90), (6, 70)]


def test_hashes_of_parts_and_files_meet_in_either_case(spark):
    """A part's hash finds files in either case; dates go by the very text, and files without a hash are owned by nobody."""
    h = "ab" * 32
    listed = files(spark, [("/R/x.txt", 3, h, 50), ("/R/y.txt", 4, h.upper(), 20), ("/R/z.txt", 5, "q", 70), ("/R/u.txt", 6, "Q", 60), ("/R/v.txt", 7, "q", 30), ("/R/n.txt", 8, None, 10)])
    for state, want in [("walking", [(3, "name", 50), (4, "name", 20)]), ("complete", [(3, "members", 1), (4, "members", 1)])]:
        t = archive_tables(spark, 1000, state, [("", "a.txt", 400, 1)], [h.upper(), h])
        rest = [(5, "loose", 30), (6, "loose", 60), (7, "loose", 30), (8, "loose", 10)]
        got = K.walk(listed.withColumn("folder", F.concat("folder", F.lit("/"), "id")), None, *t)
        assert rows(got, "size", "how", "date") == want + rest


@pytest.mark.parametrize("tasks", [None, 3])
def test_walk_without_folders_has_the_same_sums(spark, tasks):
    """Copies in two folders, archives that hold nothing, are unknown or have no members."""
    n = 40
    listed = files(spark, [(f"/R/{i % 3}/f{i}.{('tar', 'bb', 'x')[i % 3]}", i + 1, f"{i % 11:064x}" if i % 5 else None, i * 100) for i in range(n)])
    a = spark.createDataFrame([(i, "x_lf.tar" if i % 2 else "vm.tar", "/A", ("complete", "walking")[i % 2], 100) for i in range(9)], "id long, name string, folder string, state string, total_size long")
    p = spark.createDataFrame([(i % 12, f"{i % 8:064x}") for i in range(20)], "archive_id long, content_hash string")
    m = spark.createDataFrame([(i % 7, "0", "d", f"m{i}.{('bb', 'csv')[i % 2]}", i, i * 10) for i in range(30)] + [(11, "0", "d", "m", 5, 5)], "archive_id long, type string, dir string, name string, size long, mtime long")
    sums = lambda w: [(*r[:3], round(r[3], 6)) for r in rows(w.groupBy("kind", "how", "date").agg(F.sum("size").alias("size")).fillna(-1), "kind", "how", "date", "size")]
    whole = K.walk(listed, None, a, p, m)
    bare = K.walk(listed, None, a, p, m, by_folder=False, tasks=tasks)
    assert bare.columns == ["kind", "size", "how", "date"] and sums(bare) == sums(whole)
    assert round(sum(r[3] for r in sums(bare)), 6) == n * (n + 1) // 2 and {r[1] for r in sums(bare)} == {"loose", "name", "members"}


def test_walk_with_archives_shuffles_a_file_once(spark):
    """Files, their contents and members each go once through a shuffle; joins do not deal them out again, and lines find their supplier where they are."""
    from stowage.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"

    def written():
        found = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): (found.apply(i).shuffleWriteRecords(), found.apply(i).shuffleWriteBytes() + found.apply(i).outputBytes()) for i in range(found.size())}

    before = max(written(), default=-1)
    QUERIES["kinds_indexed_older"](spark, sf).write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    records, sent = (sum(c) / lines for c in zip(*(v for k, v in written().items() if k > before)))
    assert records < 5.5 and sent < 145


@pytest.mark.parametrize("threshold, max_rows, want", [(0, 100, 0), (0, 6, 4), (3, 100, 3), (3, 6, 6)])
def test_layout_reads_figures_once_and_steps_are_exact(spark, threshold, max_rows, want):
    listed = files(spark, [("/r/a/0", 0, None, 1), ("/r/a/1", 1, None, 1), ("/r/a/2", 2, None, 1), ("/r/a/3", 3, None, 1), ("/r/a/6", 6, None, 1), ("/r/a/11", 11, None, 1), ("/r/a/12", 12, None, 1)])
    figures, seen = G.folder_figures(listed, NOW), spark.sparkContext.accumulator(0)

    def passed(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    at_least, page = G.layout(listed, figures.mapInPandas(passed, figures.schema), "/r", threshold, max_rows)
    shown = {r["name"] for r in page.filter("kind = 'file'").collect()}
    assert seen.value == figures.count()
    assert shown == {str(n) for n in (0, 1, 2, 3, 6, 11, 12) if n >= at_least} and at_least == want


def test_counterparts_shuffle_spots_by_number(spark):
    """A content's rows carry no paths of the places where its copies lie until they meet the few spots."""
    listed = files(spark, [("/a/x/1", 5, "h", 1), ("/b/y/2", 5, "h", 1)])
    found = G.counterparts(listed, spark.createDataFrame([("/a",)], "folder string"))
    assert any("content_hash#" in line and "spot#" in line and "Aggregate [" in line and "place" not in line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert [tuple(r) for r in found.collect()] == [("/a", "/b", 5)]
