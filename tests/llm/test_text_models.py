"""HTML extraction, toxicity and quality: marked pages, planted words and held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from stowage.llm import html_text, quality, toxicity

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><a href=/>Home of things</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies. Do you mind?</div><!-- <p>gone</p> --><div class="ad">Buy this now and save a lot of money.</div>
<article><h1>{title}</h1>{body}<aside class="sidebar">Read on elsewhere</aside><form>Mail <input><button>Send</button></form></article>
<section id="comments"><p>I think that this was a very good article to read.</p></section>
<div class="related-posts"><a href=c>Another story</a></div><footer>&copy; us</footer></body></html>"""


def test_pages():
    body = "<p>First <b>bold</b> &amp; <a href='x>y'>linked</a>  word.<p>Short.</p>\n<p>An &eacute;t&#233;\n\tlong<br>gone</p>"
    assert html_text.main_text(PAGE.format(title="Title here", body=body)) == "Title here First bold & linked word. Short. An été long gone"
    bare = "<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>A story of it</h2><p>" + "word " * 60 + "</p><p>" + "more " * 40 + "</p><div><a href=3>Terms</a></div></body>"
    text = html_text.main_text(bare)
    assert text.startswith("A story of it word") and "more" in text and "Home" not in text and "Terms" not in text
    for odd in [None, "", "<", "<p", "</p></p>", "<!--", "<script>alert(1)", "&nbsp;", "<article>"]:
        assert html_text.main_text(odd) == ""
    assert html_text.main_text("<article><p title=\"odd>a</p> <a href='x' y=\">b</a><p>c &lt; d</p></article>") != ""
    assert html_text.main_text("<article>" + "<p x='" * 2000) is not None
    assert html_text.main_text("<article>" + "<div>" * 3000 + "deep") == "deep"


def test_containers_do_not_take_the_article_away():
    words = "Plain words of an article that goes on for a good while, with commas, stops and no links at all in it. " * 3
    text = words.strip()
    for page in (
        "<body class='single right-sidebar'><article><p>{}</p></article></body>",
        "<body><div class='right-sidebar'><article><p>{}</p></article></div></body>",
        "<body><div class='content related-layout'><p>{}</p></div></body>",
        "<body><main id='main' aria-label='search results'><p>{}</p></main></body>",
        "<body><form id='aspnet'><main><p>{}</p></main></form></body>",
        "<body><div class='overflow-hidden'><article><p>{}</p></article></div></body>",
        "<body><div style='overflow:hidden'><article><p>{}</p></article></div></body>",
        "<body><article title='hidden gems'><p>{}</p></article></body>",
        "<body><article><header class='entry-header'><p>{}</p></header></article></body>",
        "<html><head><meta charset=utf-8><body><article><p>{}</p></article></body></html>",
    ):
        assert html_text.main_text(page.format(words)) == text, page
    for page in (
        "<body><article><p>{}</p></article><div hidden><p>Not shown.</p></div></body>",
        "<body><article><p>{}</p><p style='display: none'>Not shown.</p><p aria-hidden=true>Not shown.</p></article></body>",
        "<body><article><p>{}</p></article><div class='comments'><article class='comment'><p>Not the text.</p></article></div></body>",
        "<body><article><p>{}</p></article><aside class='sidebar'><article><p>Not the text.</p></article></aside></body>",
    ):
        assert html_text.main_text(page.format(words)) == text, page


def test_table_is_learned():
    x, y = html_text.labelled_table()
    assert (html_text.classify(html_text.grow(x, y), x) == y).all()


LONG = "Plain words of an article that goes on for a good while, with commas, stops and no links at all in it. " * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><div class='entry-header'><h1>Title</h1></div><p>{}</p></article>", "Title {}"),
        ("<article><h1>Ten things</h1><ul><li><a href=1>First</a><li><a href=2>Second one</a><li><a href=3>Third</a><li><a href=4>And a fourth</a></ul></article>", "Ten things First Second one Third And a fourth"),
        ("<body><div class='header-image-content'><p>{}</p></div></body>", "{}"),
        ("<body><p>A short story about a cat who slept.</p><p>It ended well.</p></body>", "A short story about a cat who slept. It ended well."),
        ("A page that is plain text, with nothing else in it.", "A page that is plain text, with nothing else in it."),
        ("<body><div>We use cookies to make this site better for you, and by going on you agree that we may keep them on your device for as long as we see fit.</div><h1>Title</h1><p>{}</p></body>", "Title {}"),
        ("<article><h1>T</h1><p>{}</p><div class='tag-list'><a href=1>one</a> <a href=2>two</a></div></article>", "T {}"),
        ("<article><h1>T</h1><p>{}</p><p>Copyright law is old.</p><p>{}</p><footer>Copyright us</footer></article>", "T {} Copyright law is old. {}"),
    ],
)
def test_pages_that_names_alone_get_wrong(page, text):
    assert html_text.main_text(page.replace("{}", LONG)) == text.replace("{}", LONG.strip())


def by_names(page):
    return [b.main and not b.boilerplate for b in page]


def kept(page):
    return html_text.classify(html_text.grow(*html_text.labelled_table()), html_text.features(page)).tolist()


def test_counts_and_densities_decide_where_names_say_nothing_or_mislead():
    import dataclasses

    import duckdb

    agreed = total = 0
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        found = html_text.blocks(page or "")
        if found:
            total += 1
            assert kept(found) == by_names(found)
            agreed += kept([dataclasses.replace(b, main=False, boilerplate=False) for b in found]) == by_names(found)
    assert agreed >= 0.96 * total and total >= 200
    # the tree and the rule of names differ
    for page, text in (
        ("<div class='sidebar'><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><h1>Title of it</h1><p>{}</p><p>{}</p></div>", "Title of it {} {}"),
        ("<main><div>We use cookies to make this site better for you, and we may keep them on your device.</div><h1>Title</h1><p>{}</p></main>", "Title {}"),
        ("<main><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>About us</a><li><a href=4>More</a></ul><h1>Title of it</h1><p>{}</p><p>{}</p></main>", "Title of it {} {}"),
    ):
        page = page.replace("{}", LONG)
        assert html_text.main_text(page) == text.replace("{}", LONG.strip())
        assert kept(html_text.blocks(page)) != by_names(html_text.blocks(page))


def test_a_very_long_page():
    page = "<article><h1>T</h1>" + "<p>word <a href=x>link</a> more of it</p>" * 100_000 + "</article>"
    assert html_text.main_text(page) == "T " + " ".join(["word link more of it"] * 100_000)


def test_extract(spark):
    rows = [(1, "u", PAGE.format(title="A", body="<p>b</p>"), "x"), (2, None, None, "x"), (3, "v", "", "y"), (3, "v", "", "y")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((g["page_id"], g["text"], g["n_chars"]) for g in got) == [(1, "A b", 3), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def corpus(n=600, seed=0):
    """Plain, toxic and poor texts, with their labels."""
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.choice([8, 60, 400]))]
        toxic, good = int(r.random() < 0.15), int(r.random() < 0.8)
        if toxic:
            for _ in range(r.randint(1, 8)):
                text[r.randrange(len(text))] = r.choice(["blorkface", "zumpty", "grindelo" + r.choice(["x", "yz", "w"])])
        told = " ".join(text).capitalize() + "."
        if not good:
            told = r.choice([told.upper().replace(" ", "!! "), " | ".join(text), " ".join(w + "###" for w in text), (text[0] + " ") * len(text)])
        docs.append((i, told, "en", "s", len(told)))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "word " * 50_000, "en", "s", 1), docs[0]], "doc_id long, text string, lang string, source string, n_chars long")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs, labels


def test_toxicity(spark, tables):
    d, marks, docs, labels = tables
    model = toxicity.train(d, marks)
    got = toxicity.grade(d, model).collect()
    assert len(got) == d.count()
    truth = {i: t for i, _, t in labels}
    of = {g["doc_id"]: g for g in got}
    wrong = [i for i in truth if of[i]["toxic"] != truth[i]]
    assert len(wrong) <= 0.02 * len(truth)
    assert all(g["toxic"] == (g["grade"] > 0) and 0 <= g["severity"] <= len(model.thresholds) for g in got)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) > 1
    assert of[9000]["toxic"] == of[9001]["toxic"] == of[9002]["toxic"] == 0
    mild, bad = "zumpty is here", "zumpty blorkface zumpty blorkface zumpty grindelox blorkface"
    two = {g["doc_id"]: g["severity"] for g in toxicity.grade(spark.createDataFrame([(1, mild), (2, bad), (3, "is here")], "doc_id long, text string"), model).collect()}
    assert two[3] < two[1] < two[2]
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {g["doc_id"] for g in got if not g["toxic"]}


def test_toxicity_without_labels(spark, tables):
    d, marks, *_ = tables
    for some in (marks.limit(0), marks.filter("toxic = 0"), marks.selectExpr("doc_id", "cast(null as int) as toxic")):
        model = toxicity.train(d, some)
        assert all(g["toxic"] == 0 for g in toxicity.grade(d.limit(5), model).collect())
    assert toxicity.grade(d.limit(0), model).count() == 0


def test_ordinal_fit_finds_the_minimum():
    """Analytic gradient against differences, by way of the loss at and around the fit."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3))
    z = x @ [1.5, -1.0, 0.0] + rng.logistic(size=400)
    grades = np.digitize(z, [-0.5, 1.0])
    w, cuts = toxicity.fit_ordinal(x, grades, 3, steps=2000)

    def loss(w, cuts):
        up = 1 / (1 + np.exp(-(x @ w)[:, None] + cuts))
        edges = np.column_stack([np.ones(400), up, np.zeros(400)])
        return -np.log(edges[np.arange(400), grades] - edges[np.arange(400), grades + 1]).mean() + 5e-5 * (w @ w)

    at = loss(w, cuts)
    for _ in range(50):
        assert loss(w + rng.normal(0, 0.05, 3), np.sort(cuts + rng.normal(0, 0.05, 2))) >= at - 1e-4
    assert w[0] > 1 and w[1] < -0.6 and abs(w[2]) < 0.4 and cuts[0] < cuts[1]


def test_quality(spark, tables):
    d, marks, docs, labels = tables
    model = quality.train(d, marks)
    got = quality.score(d, model).collect()
    assert len(got) == d.count()
    of = {g["doc_id"]: g for g in got}
    out = [(of[i]["predicted"], q) for i, q, _ in labels if of[i]["held_out"]]
    assert len(out) > 50 and np.mean([p == q for p, q in out]) >= 0.95
    for g in got:
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0)
        assert 0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3)
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {g["doc_id"] for g in got if g["predicted"]}


def test_quality_learns_nothing_from_held_out_rows(spark, tables):
    d, marks, *_ = tables
    flipped = marks.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert quality.train(d, marks) == quality.train(d, flipped)


def test_quality_without_labels(spark, tables):
    d, marks, *_ = tables
    assert quality.train(d, marks.filter("quality = 1")) is None
    assert {g["score"] for g in quality.score(d.limit(5), None).collect()} == {0.5}
    assert quality.score(d.limit(0), None).count() == 0
    assert quality.keep_good(d, None).count() == d.count()


def test_pair_weights_are_the_logistic_minimum():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 2))
    y = (x @ [2.0, 0.0] + rng.logistic(size=300) > 0).astype(int)
    w = quality.fit_pairs(x, y, pairs=5000)
    assert w[0] > 1 and abs(w[1]) < 0.5


def test_names_that_only_look_like_boilerplate():
    words = "Plain words of an article that goes on for a good while, with commas, stops and no links at all in it. " * 3
    text = words.strip()
    for page in (
        "<body class='home has-sidebar'><article><p>{}</p></article></body>",
        "<body><div class='content no-sidebar'><p>{}</p></div></body>",
        "<body><div id='comments-off' class='post'><p>{}</p></div></body>",
    ):
        assert html_text.main_text(page.format(words)) == text, page
    story = "<body><article><p>" + words + "</p><p>See <a class='related' href=x>this</a> for the story</p><p>And <span class='ad'>that</span> one.</p></article></body>"
    assert html_text.main_text(story) == text + " See this for the story And that one."
    hidden = "<article><p>" + words + "<span hidden>gone <span>gone too</span></span> stays</p><p>after</p></article>"
    assert html_text.main_text(hidden) == text + " stays after"
    for name in ("site-footer", "main-nav", "comment-list", "related-posts", "cookieNotice", "sidebar"):
        assert html_text.main_text(f"<body><article><p>{words}</p><div class='{name}'><p>Not the text of it.</p></div></article></body>") == text, name


def test_broken_pages_take_linear_time():
    import time

    n = 20_000
    for page in ("<div>" * n + "</p>" * n, "<a " * n, '<a "' * n, "<article>" + "<b>" * n + "x" + "</b>" * n, "<a>" * n + "</i>" * n, "<div>" * n + "<body>" * n, "<!--" * n, "<span hidden>" * n + "</span>" * n):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 3, page[:20]


def test_counts_and_densities_decide_inside_the_article():
    """Unmarked menus in the element that holds the article go, single links stay: labels differ from the flags alone."""
    words = "words of a text without any links that is long enough to be one " * 4
    menu = "".join(f"<li><a href={i}>Topic {i}</a></li>" for i in range(8))
    page = html_text.blocks(f"<main><ul>{menu}</ul><h1>A title of it</h1><p>{words}</p><p><a href=x>A link</a></p><p>{words}</p></main>")
    kept = html_text.classify(html_text.grow(*html_text.labelled_table()), html_text.features(page))
    assert all(b.main and not b.boilerplate for b in page)
    assert kept.tolist() == [False] * 8 + [True] * 4


def test_tree_path_against_plain_descent():
    x, _ = html_text.labelled_table()
    tree = html_text.grow(*html_text.labelled_table())
    rng = np.random.default_rng(6)
    rows = np.abs(x[rng.integers(0, len(x), 500)] + rng.normal(0, 0.4, (500, x.shape[1])))

    def plain(node, row):
        while len(node) > 1:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return bool(node[0])

    assert html_text.classify(tree, rows).tolist() == [plain(tree, r) for r in rows]


def test_toxicity_of_the_query_recomputed(spark, tables):
    """Severity, grade and flag of every row by plain loops over its words; held-out rows teach nothing and are told right."""
    import math
    import re

    d, marks, docs, labels = tables
    model = toxicity.train(d, marks)
    texts = {}
    for k, t, *_ in docs:
        texts[k] = t
    texts |= {9000: None, 9001: "", 9002: "word " * 50_000}
    got = toxicity.grade(d, model).collect()
    for g in got:
        counts = {}
        for token in re.findall(r"[^\W_]+", (texts[g["doc_id"]] or "").lower()):
            for f in ["=" + token] + [token[:n] for n in (4, 5, 6) if len(token) >= n]:
                if f in model.weights:
                    counts[f] = counts.get(f, 0) + 1
        score = sum(model.weights[f] * math.log1p(n) for f, n in counts.items())
        above = [1 / (1 + math.exp(-(score - t))) for t in model.thresholds]
        assert g["severity"] == pytest.approx(sum(above), abs=1e-9)
        assert g["grade"] == sum(p >= toxicity.REJECT for p in above) and g["toxic"] == int(g["grade"] > 0)
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0)
    of = {g["doc_id"]: g for g in got}
    out = [(of[k]["toxic"], t) for k, _, t in labels if of[k]["held_out"]]
    assert len(out) > 80 and np.mean([a == b for a, b in out]) >= 0.95
    assert sum(a and b for a, b in out) >= 0.9 * sum(b for _, b in out)
    out_of = toxicity.held_out(toxicity.F.col("doc_id"))
    flipped = marks.withColumn("toxic", toxicity.F.when(out_of, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.labelled_sample(d, flipped, "toxic", "doc_id", "text", 4000).filter(out_of).count() == 0


def test_quality_of_the_query_recomputed(spark, tables):
    """Scores of every row from its features by plain arithmetic, and the features of some texts by plain counts."""
    import math

    d, marks, docs, _ = tables
    model = quality.train(d, marks)
    texts = {k: t for k, t, *_ in docs} | {9000: None, 9001: "", 9002: "word " * 50_000}
    for g in quality.score(d, model).collect():
        x = quality.text_features(texts[g["doc_id"]])
        strength = 0.0
        for value, mean, scale, weight in zip(x, model.mean, model.scale, model.weights):
            strength += min(8.0, max(-8.0, (value - mean) / scale)) * weight
        at = model.slope * (strength - model.cut) + math.log(0.3 / 0.7)
        want = 1 / (1 + math.exp(-min(700.0, max(-700.0, at))))
        assert g["score"] == pytest.approx(want, abs=1e-9) and g["predicted"] == int(g["score"] >= 0.3)
    told = dict(zip(quality.NAMES, quality.text_features("One two two. THREE!! 44 ##\nOne two two.\n")))
    text = "One two two. THREE!! 44 ##\nOne two two.\n"
    words = text.split()
    assert told["upper_words"] == sum(len(w) > 1 and w.isupper() for w in words) / len(words)
    assert told["repeats"] == sum(a.lower() == b.lower() for a, b in zip(words, words[1:])) / len(words)
    assert told["letters"] == sum(c.isalpha() for c in text) / len(text)
    assert told["digits"] == sum(c.isdigit() for c in text) / len(text)
    assert told["distinct"] == len({w.lower() for w in words}) / len(words) ** 0.9
    assert told["line_repeats"] == 0.0  # its two lines differ


def test_models_do_not_depend_on_the_order_of_rows(spark, tables):
    """Two texts of each key, in either order, and columns whose names clash: the same model, the same columns."""
    d, marks, docs, _ = tables
    both = [(k, t, 7, 0.5, True) for k, t, *_ in docs] + [(k, "zzz " + t[::-1], 8, 0.1, False) for k, t, *_ in docs]
    kind = "doc_id long, text string, label int, score double, held_out boolean"
    one, two = (spark.createDataFrame(x, kind).repartition(n) for x, n in ((both, 3), (both[::-1], 5)))
    assert toxicity.train(one, marks) == toxicity.train(two, marks)
    a, b = quality.train(one, marks), quality.train(two, marks)
    assert np.allclose(a.weights, b.weights)
    assert toxicity.grade(one, toxicity.train(one, marks)).columns == ["doc_id", "severity", "grade", "toxic", "held_out"]
    assert quality.score(one, a).columns == ["doc_id", "held_out", "score", "predicted"]


def test_quality_learns_from_every_labelled_row(spark):
    """Means and cut are those of all 4,800 labelled rows that are not held out, more than a model was fitted on before."""
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(["alpha", "Beta", "GAMMA", "x9", "##", "end."]) for _ in range(r.randint(1, 30))) + (" !!!" if i % 12 == 0 else "")) for i in range(6000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = quality.train(d, spark.createDataFrame([(i, int(i % 12 != 0)) for i, _ in docs], "doc_id long, quality int"))
    known = [(i, quality.text_features(t)) for i, t in docs if zlib.crc32(str(i).encode()) % 5]
    x = np.array([f for _, f in known])
    assert (sum(i % 12 != 0 for i, _ in known)) > 4000
    assert np.allclose(model.mean, x.mean(axis=0), rtol=1e-9) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1), rtol=1e-9)
    strength = np.sort(model.strength(x))
    n = sum(i % 12 == 0 for i, _ in known)
    assert model.cut == pytest.approx((strength[n - 1] + strength[n]) / 2, abs=1e-9)


def test_places_in_an_order(spark):
    rows = spark.range(1000).select((quality.F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert all(a["v"] == a["at"] for a in quality.in_order(rows, "v").collect())
