"""The pipeline's stages against brute force on a small corpus."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from .test_text_models import corpus


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels = corpus(400, seed=7)
    r = random.Random(1)
    for i in range(60):  # copies, exact and with one word changed
        k, text, *rest = docs[r.randrange(400)]
        words = text.split(" ")
        if i % 2 and len(words) > 50:
            words[3] = "changed"
        docs.append((1000 + i, " ".join(words), *rest))
    docs.append((2000, None, None, None, None))
    spaced = next(i for i, (x, (_, q, t)) in enumerate(zip(docs, labels)) if q and not t and len(x[1].split()) > 50)
    docs[spaced] = (docs[spaced][0], docs[spaced][1].replace(" ", "\n" * 1_000_001, 1), *docs[spaced][2:])
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-dedup", "packing"]

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if i < 3:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now.write.parquet(f"{tmp_path}/{i}")
            now = spark.read.parquet(f"{tmp_path}/{i}")
            kept.append({x["doc_id"]: x["text"] for x in now.collect()})
    truth = {k: (q, t) for k, q, t in labels}
    # nearly all toxic ones went (a poor text may have lost its toxic words),
    assert sum(truth[k][1] for k in kept[0] if k in truth and truth[k][0]) <= 1
    assert sum(1 - t for k, (_, t) in truth.items() if k not in kept[0]) <= 2  # and no others
    assert sum(1 - truth[k][0] for k in kept[1] if k in truth) <= 10

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {k: shingles(t) for k, t in kept[1].items()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    near = {b for (a, b), j in like.items() if j >= 0.87}  # all but the first of a group
    gone = set(kept[1]) - set(kept[2])
    assert near <= gone
    assert all(any(like[min(k, o), max(k, o)] >= 0.7 for o in sets if o != k) for k in gone)
    assert docs[spaced][0] in kept[2]
    rows = now.collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = {k: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for k, x in kept[2].items()}
    got = {}
    for x in rows:
        got[x["doc_id"]] = got.get(x["doc_id"], 0) + x["length"]
    assert got == length
    assert {(x["doc_id"], x["piece"], x["sequence_id"], x["offset"]) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} != set()


def test_near_copies_without_a_key_and_two_texts_of_one_key(spark):
    import corpus_pipeline

    r = random.Random(5)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (3, d), (None, e), (None, e), (None, d), (None, text())]
    docs = spark.createDataFrame([(k, t, "en", "x", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(1, a), (2, b), (3, c), (3, d), (None, e), (None, rows[-1][1])]
    assert sorted((str(x["doc_id"]), x["text"]) for x in kept.collect()) == sorted((str(k), t) for k, t in want)


def test_columns_of_any_name_come_back(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "a b c d e f g", "x", 5), (2, "a b c d e f g", "y", 6), (3, "other words of another kind", "z", 7)], "doc_id long, text string, row string, component int")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f g", "x", 5), (3, "other words of another kind", "z", 7)]
