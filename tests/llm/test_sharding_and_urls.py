"""Sharding against the published jump hash, and the URL trie against trying every rule."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stowage.llm import sharding, url_filter
from stowage.llm.queries import RULES


def jump(key, n):
    """The published algorithm."""
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, 2, 10, -1, -5, 2**63 - 1, -(2**63), *range(1000, 1400), None]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 7, 24, 25, 300):
        got = df.select("k", sharding.jump_hash(F.col("k"), n).alias("s")).collect()
        assert [r["s"] for r in got] == [jump(r["k"] or 0, n) for r in got]


def test_shards_of_odd_rows(spark):
    rows = [(i, "x" * (i % 50), "en", 3) for i in range(3000)] + [(7, None, "en", 3), (None, "é", "en", 3), (8, "", "en", 3)] + [(55, "hot", "en", 3)] * 800
    df = spark.createDataFrame(rows, "doc_id long, text string, law string, slot int")
    got = sharding.shard(df, 24, pieces=5).collect()
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    slots = defaultdict(list)
    for g in got:
        assert g["law"] == "key" and g["shard"] == jump(g["doc_id"] or 0, 24)
        assert g["grown_shard"] == jump(g["doc_id"] or 0, 25) and g["grown_shard"] in (g["shard"], 24)
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(df.limit(0)).count() == 0


def test_many_repeats_go_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRETCH", 64)
    df = spark.createDataFrame([(i, "t") for i in range(300)] + [(None, None)] * 1000 + [(7, "t")] * 63 + [(8, "u")] * 64, "doc_id long, text string")
    got = sharding.shard(df, 3, pieces=4).collect()
    assert Counter(g["doc_id"] for g in got) == Counter({**dict.fromkeys(range(300), 1), None: 1000, 7: 64, 8: 65})
    for s in range(3):
        assert sorted(g["slot"] for g in got if g["shard"] == s) == list(range(sum(g["shard"] == s for g in got)))


def test_sharding_is_native(spark):
    plan = sharding.shard(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = sharding.counted(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def fits(url, rules):
    """By trying every rule: the one with most host labels, then the longest path."""
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        host = rest[: min(ends)] if ends else rest
        tail = rest[len(host) :]
        ends = [tail.find(c) for c in "?#" if c in tail]
        path = tail[: min(ends)] if ends else tail
        host = host.translate({c: c + 32 for c in range(65, 91)})
    found = [(h, p, v) for h, p, v in rules if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(found, key=lambda r: (r[0].count("."), len(r[1]), r[2] == "block"), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else "allow"


def test_urls(spark, monkeypatch):
    r = random.Random(5)
    hosts = ["example.net", "A.Example.NET", "example.com", "x.example.com", "fr.org", "org", "notexample.net", "net", "com", "b.c.d", ""]
    paths = ["", "/", "/en", "/en/", "/en/1", "/fr/x?y", "/de/#z", "/de", "?q=/en/", "#/en/", "/a/b/c", "/a/bc"]
    urls = [f"{r.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a/b://example.net/en/", "://net/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    more = [*RULES, ("c.d", "/a/b", "block"), ("b.c.d", "/", "allow"), ("d", "/a/b/c", "block"), ("com", "", "block"), ("com", "", "allow")]
    for rules, limit in ((RULES, 500_000), (more, 500_000), (more, 2), ([], 10)):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", limit)
        for g in url_filter.judge(df, rules).collect():
            assert (g["host"], g["path"], g["rule"], g["verdict"]) == fits(urls[g["page_id"]], rules), urls[g["page_id"]]
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_many_rules_of_one_host():
    """Look-ups by length, not a scan of the rules; against testing every rule."""
    import random
    import time

    r = random.Random(4)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
    rules = [("x.org", "/" + "/".join(word() for _ in range(r.randint(0, 3))), r.choice(["allow", "block"])) for _ in range(300)]
    trie = url_filter.build_trie(rules)
    best = {}
    for host, path, verdict in rules:
        best[path] = max(best.get(path, ""), verdict)
    for _ in range(2000):
        path = "/" + "/".join(word() for _ in range(r.randint(0, 4)))
        fit = max((p for p in best if path.startswith(p)), key=len, default=None)
        assert url_filter.longest_match(trie, "a.x.org", path) == (("x.org" + fit, best[fit]) if fit is not None else None)
    trie = url_filter.build_trie([("y.org", f"/p{i}", "block") for i in range(100_000)])
    began = time.process_time()
    for i in range(2000):
        assert url_filter.longest_match(trie, "y.org", f"/p{i}x")[0].startswith("y.org/p")
    assert time.process_time() - began < 2


def test_odd_rows_of_urls(spark):
    """Very long urls, rows without a key, repeated rows, and columns whose names clash with those of the result."""
    long_path = "/en/" + "a/" * 500_000
    rows = [(1, f"http://example.net{long_path}", "r", 1), (2, "http://" + "x." * 300_000 + "org/fr/", "r", 2), (None, "http://x.net/", "r", 3), (3, None, "r", 4), (3, None, "r", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, path int")
    got = url_filter.judge(df, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    told = sorted((str(g["page_id"]), len(g["host"]), len(g["path"]), g["rule"], g["verdict"]) for g in got.collect())
    assert told == [("1", 11, len(long_path), "example.net/en/", "allow"), ("2", 600_003, 4, "org/fr/", "allow"), ("3", 0, 0, None, "allow"), ("3", 0, 0, None, "allow"), ("None", 5, 1, "net/", "block")]
