"""SimHash against a plain count of bits and a comparison of all pairs."""

import random
import re

import numpy as np
import xxhash

from stowage.llm import simhash
from stowage.llm.common import components


def plain_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_pairs(rows, budget=4):
    """Smallest id reachable, by comparing everything."""
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if bin(x ^ y).count("1") <= budget:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k, _ in rows}


def test_fingerprints_of_odd_texts():
    for t in [None, "", " \n\t", "One", "one two three", "A b c d", "a  b\tc\nd e É  x", "x " * 500, "  em"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(4)
    for n, flips in ((400, 3), (600, 8), (300, 0)):
        base = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)
        bits = base[rng.integers(0, len(base), n)].copy()
        for _ in range(flips):
            bits ^= np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        bits = np.unique(bits)
        for budget in (2, 4):
            labels = np.arange(len(bits))
            for turn in range(budget + 1):
                turned = simhash.turned(bits, sum(simhash.blocks(budget)[:turn]))
                order = np.argsort(turned)
                found = simhash.trie_links(turned[order], None, budget, simhash.allowance(budget, turn))
                k = np.nonzero(found != np.arange(len(found)))[0]
                labels = simhash.merged(labels, order[k], order[found[k]])
            want = all_pairs(list(enumerate(bits.tolist())), budget)
            assert labels.tolist() == [want[i] for i in range(len(bits))]


def documents(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = []
    for g in range(25):
        words = [word() for _ in range(r.choice([3, 40, 300]))]
        for _ in range(r.randint(1, 6)):
            copy = list(words)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows + [(900, None), (901, ""), (902, " \n "), (5, rows[5][1])]


def test_groups_through_spark_in_parts(spark, monkeypatch):
    rows = documents()
    keyless = [(None, "no key"), (None, "no key"), (None, rows[5][1])]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in [*rows, *keyless]], "doc_id long, text string, bits string, component_id int")
    every = simhash.near_duplicates(df).collect()
    got = [g for g in every if g["doc_id"] is not None]
    assert len(got) == len(rows) and len(every) == len(rows) + 3
    prints = {k: plain_fingerprint(t) for k, t in rows}
    want = all_pairs(sorted(prints.items()))
    # rows without a key belong to the documents they reach
    alone = f"{plain_fingerprint('no key'):016x}"
    assert sorted(g["fingerprint"] for g in every if g["doc_id"] is None) == sorted([alone, alone, f"{prints[rows[5][0]]:016x}"])
    assert {g["component_id"] for g in every if g["doc_id"] is None and g["fingerprint"] != alone} == {want[rows[5][0]]}
    assert {g["component_id"] for g in every if g["fingerprint"] == alone} == {None}
    for g in got:
        assert g["fingerprint"] == f"{prints[g['doc_id']]:016x}"
        assert g["component_id"] == want[g["doc_id"]]
    # every head is heavy now
    parted = simhash.near_groups(simhash.fingerprints(df), 4, part=2).collect()
    assert {(g["doc_id"], g["component_id"]) for g in parted if g["doc_id"] is not None} == {(k, want[k]) for k in prints}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (500, 499), (499, 498)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 498: 498, 499: 498, 500: 498}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_similar_shingle_sets(spark):
    """Copies with a few words changed link, other texts do not; against the exact similarity of all pairs."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    rows = []
    for _ in range(40):
        words = [word() for _ in range(300)]
        for _ in range(4):
            copy = list(words)
            for _ in range(r.choice([0, 1, 2, 3, 40])):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, " "), (902, "Only three words"), (903, "only  three words")]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: shingles(t) for k, t in rows}
    likeness = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = {g["doc_id"]: g["component_id"] for g in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    keys = sorted(sets)
    sure = [(a, b) for a in keys for b in keys if a < b and likeness(a, b) >= 0.87]
    assert len(sure) > 100 and all(got[a] == got[b] for a, b in sure)
    for g in set(got.values()):
        members = [k for k in keys if got[k] == g]
        assert all(max((likeness(a, b) for b in members if b != a), default=1) >= 0.7 for a in members)
    # many equal first words of the fingerprint, compared in pieces
    wide = np.zeros((700, 2), np.uint64)
    wide[:, 1] = np.repeat(np.array([0, 2**40 - 1], np.uint64), 350) ^ (np.uint64(1) << np.arange(700, dtype=np.uint64) % np.uint64(3))
    assert len(set(simhash.trie_links(np.zeros(700, np.uint64), None, 4, simhash.allowance(8, 0), wide).tolist())) == 2


def test_shingle_sets_link_from_the_threshold_on_only(spark):
    """Pairs at exactly 0.8 all link, pairs just below never do, and a pair between two groups joins them."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    rows, linked = [], {}
    for n in (1, 2, 3, 10, 40) * 20:  # 4n of 5n shingles are common, and 4n - 1 of 5n
        for common, link in ((4 * n, True), (4 * n - 1, False)):
            words = [word() for _ in range(5 * n + 4)]
            at = len(rows)
            rows += [(at, " ".join(words)), (at + 1, " ".join(words[: common + 4]))]
            linked[at + 1] = at if link else at + 1
    words = [word() for _ in range(184)]  # sliding windows: each only links to those next to it
    for i in range(9):
        rows.append((5000 + i, " ".join(words[10 * i : 10 * i + 104])))
        linked[5000 + i] = 5000
    got = {g["doc_id"]: g["component_id"] for g in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in linked} == linked


def planted(r, n, similarity):
    """Two texts of n + 4 or so words whose sets of five-word shingles have about this similarity, and what it is exactly."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    common = round(n * similarity)
    shared = [word() for _ in range(common + 4)]
    own = (n - common) // 2
    a = [word() for _ in range(own)] + shared
    b = shared + [word() for _ in range(n - common - own)]
    return " ".join(a), " ".join(b), common / n


def test_recall_over_similarities(spark):
    """Pairs of equal or other sizes, from few shingles to many: all at 0.8 and more link, none below it."""
    r = random.Random(17)
    rows, told = [], []
    for similarity in (0.8, 0.85, 0.75, 0.7):
        for n in (20, 60, 100, 400) * 25:
            a, b, exact = planted(r, n, similarity)
            told.append((len(rows), similarity, exact))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {g["doc_id"]: g["component_id"] for g in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = {s: [got[k] == got[k + 1] for k, t, _ in told if t == s] for s in (0.8, 0.85, 0.75, 0.7)}
    assert all(exact >= 0.8 if s >= 0.8 else exact < 0.8 for _, s, exact in told)
    assert np.mean(linked[0.8]) >= 0.99 and np.mean(linked[0.85]) >= 0.99
    assert not any(linked[0.75]) and not any(linked[0.7])


def test_a_large_group_of_alike_texts_against_all_pairs(spark):
    """Copies of one text with many or few words changed: a trie joins them all, the sets decide; the same in small cells and parts."""
    r = random.Random(23)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            words[r.randrange(120)] = f"x{r.random()}"
        rows.append((i, " ".join(words)))
    sets = {k: {tuple(w[i : i + 5]) for i in range(116)} for k, t in rows for w in [t.split()]}
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    df = spark.createDataFrame(rows, "row long, text string")
    numbered = simhash.materialize(df)
    for part, block in ((simhash.PART, simhash.BLOCK), (20, 20)):
        got = {g["row"]: g["component"] for g in simhash.near_rows(numbered, part=part, block=block).collect()}
        names = {find(k): got[find(k)] for k in got}
        assert len(set(names.values())) == len(names) and all(got[k] == names[find(k)] for k in got)


def test_sketch_choice_keeps_the_share_missed():
    for n in (10, 1000, 10**6, 10**9):
        s = simhash.choose_sketch(n, 0.8)
        hit = simhash.at_most(s.budget, s.width, simhash.bit_differs(0.8))
        assert (1 - hit) ** s.words <= simhash.MISS
        assert s.words * n * simhash.at_most(s.budget, s.width, 0.5) < 400  # random candidates of a row


def test_components_of_a_long_chain(spark, monkeypatch):
    from stowage.llm import common

    tables = []
    stored = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df: tables.append(stored(df)) or tables[-1])
    chain = spark.range(10_000).selectExpr("id as u", "id + 1 as v")
    got = components(chain)
    assert got.filter("component = 0").count() == got.count() == 10_001
    assert len(tables) <= 21  # one for the edges, one for each round
    for old in tables[:-1]:  # deleted
        with_files = common._at(spark, old.stored_at)
        assert not with_files[1].exists(with_files[0])


def test_tables_need_a_shared_folder_on_a_cluster():
    import pytest

    from stowage.llm import common

    class Conf:
        def get(self, key, default=None):
            return self.found or default

        found = None

    class Context:
        master, dir = "spark://host:7077", None

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, at):
            self.dir = at

    class Session:
        conf, sparkContext = Conf(), Context()

    s = Session()
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        s.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(s)
    for master in ("local", "local[4]", "local[*]"):
        s.sparkContext.master, s.sparkContext.dir = master, None
        assert common.shared_dir(s) == s.sparkContext.dir
    s.conf.found, s.sparkContext.master = "hdfs://shared/x", "yarn"
    assert common.shared_dir(s) == "hdfs://shared/x"


def test_similar_links_against_all_pairs():
    rng = np.random.default_rng(9)
    base = rng.permutation(4000).astype(np.uint64)
    sets = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
    for _ in range(80):
        at, n = rng.integers(0, 60), rng.integers(1, 60)
        sets.append(np.unique(base[at : at + n]))
    rep = rng.permutation(1000)[: len(sets)]
    for side in (None, rng.integers(0, 2, len(sets))):
        labels = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if simhash.jaccard(sets[i], sets[j]) >= 0.8 and (side is None or side[i] != side[j]):
                    labels[labels == labels[i]] = labels[j]
        got = simhash.similar_links(sets, rep, 0.8, side)
        for g in set(labels.tolist()):
            group = np.nonzero(labels == g)[0]
            assert set(got[group].tolist()) == {group[np.argmin(rep[group])]}
