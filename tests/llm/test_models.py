"""Language identification and the passage classifier: gradients, held-out accuracy and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm import language_id as lid
from spanweave.llm import quality_mil as mil

DOCS = "doc_id long, text string, lang string"
WORDS = {"aa": "the house river of and stone", "bb": "der haus fluss und stein über", "cc": "la casa río y piedra señor"}


def _lang_docs(n=240):
    rng = random.Random(0)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 40))), lang))
    return out


# --- language identification


def _counts_by_force(text):
    """N-grams of one text, one at a time."""
    low = text.lower()
    out = np.zeros(lid.BUCKETS, np.int64)
    for n in range(1, lid.LONGEST + 1):
        for i in range(len(low) - n + 1):
            h = 0
            for k in range(n):
                h = ((h ^ (ord(low[i + k]) + k + 1)) * 0x9E3779B1) & 0xFFFFFFFF
                h ^= h >> 15
            out[((h * 0x85EBCA77) & 0xFFFFFFFF) >> (33 - lid.BUCKETS.bit_length())] += 1
    return out


def test_counts_equal_brute_force(monkeypatch):
    texts = ["Some Text", None, "", "x", "äöü ß 日本", "long " * 400, "ab"]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(lid, "CHUNK", chunk)
        got = np.concatenate([c for _, c in lid.counts(pa.array(texts))])
        assert (got == np.stack([_counts_by_force(t or "") for t in texts])).all()


def test_document_frequencies_cover_every_row(spark):
    docs = _lang_docs(50)
    df, n = lid.document_frequencies(spark.createDataFrame(docs, DOCS))
    assert n == 50 and (df == sum((_counts_by_force(t) > 0).astype(int) for _, t, _ in docs)).all()


def test_temperature_is_the_best_on_a_grid():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    scores = rng.normal(0, 4, (400, 3))
    scores[np.arange(400), y] += 3

    def loss(t):
        return -np.log(lid.softmax(scores, t)[np.arange(400), y]).mean()

    best = lid.best_temperature(scores, y)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(-3, 3, 200))) + 1e-6
    assert lid.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def _model_by_force(rows, seed=1):
    """Weights and temperature's inputs by plain sums over all buckets, in the order that the sample has."""
    n = len(rows)
    c = np.stack([_counts_by_force(t) for t, _ in rows])
    idf = np.log((n + 1) / ((c > 0).sum(0) + 1)) + 1
    x = np.log1p(c) * idf
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    classes = sorted({v for _, v in rows})
    y = [classes.index(v) for _, v in rows]
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    z, g2 = np.zeros((lid.BUCKETS, len(classes))), np.zeros((lid.BUCKETS, len(classes)))

    def weights():
        return np.where(np.abs(z) <= lid.L1, 0, -(z - np.sign(z) * lid.L1) / ((lid.BETA + np.sqrt(g2)) / lid.ALPHA + lid.L2))

    for _ in range(lid.EPOCHS):
        for i in rng.permutation(order[n // 5 :]):
            w = weights()
            s = np.exp(x[i] @ w - max(x[i] @ w))
            p = s / s.sum()
            for k in range(len(classes)):
                g = x[i] * (p[k] - (k == y[i]))
                sigma = (np.sqrt(g2[:, k] + g * g) - np.sqrt(g2[:, k])) / lid.ALPHA
                z[:, k] += g - sigma * w[:, k]
                g2[:, k] += g * g
    return classes, idf, weights()


def test_fit_and_predictions_equal_plain_ftrl(spark):
    docs = _lang_docs(60)
    df = spark.createDataFrame(docs, DOCS)
    by_mark = {r.text: r.mark for r in df.selectExpr("text", "xxhash64(text) AS mark").collect()}
    rows = sorted({(t, v) for _, t, v in docs}, key=lambda r: (r[1], by_mark[r[0]]))
    assert len(rows) == len(docs)
    classes, idf, w = _model_by_force(rows)
    model = lid.fit(df)
    assert model.classes == classes and np.allclose(model.idf, idf, atol=1e-5) and np.allclose(model.weights, w, atol=1e-4) and (w != 0).any()
    got = {r.doc_id: (r.lang_pred, r.confidence) for r in lid.predict(df, model).collect()}
    for i, t, _ in docs:
        x = np.log1p(_counts_by_force(t)) * idf
        s = (x / np.sqrt(x @ x)) @ w / model.temperature
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert got[i][0] == classes[p.argmax()] and abs(got[i][1] - p.max()) < 1e-3


def test_a_text_that_fills_the_table_is_drawn_once(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 100 = 0, concat('the river ', id), 'the house of stone') AS text", "if(id % 100 = 0, 'aa', 'bb') AS lang")
    found = lid.label_counts(docs, "text", "lang")
    drawn = lid.sample(docs, 2000, found, "text", "lang")
    assert drawn.column("label").to_pylist().count("bb") == 1 and drawn.column_names == ["label", "mark", "buckets", "counts"]
    assert found["bb"][0] == 2970


def test_l1_leaves_weights_at_zero(spark):
    docs = spark.createDataFrame(_lang_docs(), DOCS)
    w = lid.fit(docs).weights
    assert 0 < (w != 0).mean() < 0.2


def test_languages_of_unseen_documents(spark):
    docs = _lang_docs()
    train = [d if d[0] % 2 else (*d[:2], None) for d in docs]
    got = {r.doc_id: r for r in lid.identify(spark.createDataFrame(train, DOCS)).collect()}
    unseen = [d for d in docs if d[0] % 2 == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in unseen) >= 0.97 * len(unseen)
    assert all(0 < r.confidence <= 1 for r in got.values())


def test_languages_of_the_test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lid.identify(df).join(df.select("doc_id", "lang", "text"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.93 * len(rows)


def test_languages_odd_rows(spark):
    rows = [*_lang_docs(60), (None, "the house", None), (901, None, "aa"), (902, "", None), (903, "der haus und " * 100_000, None), (904, "the", None), (904, "the", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", lang_pred int")
    got = lid.identify(docs)
    assert got.columns == ["doc_id", "lang_pred", "confidence"]
    by = {}
    found = got.collect()
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(rows) and len(by[904]) == 2 and by[904][0] == by[904][1]
    assert by[903][0].lang_pred == "bb" and by[901][0].confidence == by[902][0].confidence
    assert lid.identify(docs.limit(0)).count() == 0
    none = lid.identify(spark.createDataFrame([(1, "a text", None)], DOCS)).collect()
    assert [tuple(r) for r in none] == [(1, None, None)]
    (one,) = lid.identify(spark.createDataFrame([(1, "a text", "aa")], DOCS)).collect()
    assert one.lang_pred == "aa" and one.confidence == 1.0


def test_a_large_table_with_few_labels_and_a_rare_language(spark):
    """Few of the rows are labelled, and one language has four rows of them; all are trained on."""
    docs = [d if d[0] < 50 else (*d[:2], None) for d in _lang_docs(4000)]
    rare = [(9000 + i, "kuća reka kamen žena dete " * (3 + i), "zz" if i < 4 else None) for i in range(8)]
    df = spark.createDataFrame(docs + rare, DOCS)
    got = {r.doc_id: r.lang_pred for r in lid.identify(df, 40).collect()}
    assert [got[i] for i, *_ in rare] == ["zz"] * 8
    full = {i: lang for i, _, lang in _lang_docs(4000)}
    assert sum(got[i] == lang for i, lang in full.items()) >= 0.9 * len(full)


def test_a_rare_language_is_drawn_among_many_labels(spark):
    docs = _lang_docs(3000) + [(9000, "kuća reka kamen", "zz")]
    df = spark.createDataFrame(docs, DOCS)
    found = lid.label_counts(df, "text", "lang")
    drawn = Counter(lid.sample(df, 100, found, "text", "lang").column("label").to_pylist())
    assert drawn["zz"] == 1 and set(drawn) == {"aa", "bb", "cc", "zz"} and sum(drawn.values()) <= 300
    assert lid.quotas({"aa": 10**9, "zz": 50}, 4000) == {"aa": 4000, "zz": 50}


# --- passage classifier


def _features_by_force(text):
    out = []
    for at in range(0, len(text), mil.PASSAGE):
        p = text[at : at + mil.PASSAGE]
        c = np.zeros(mil.BUCKETS)
        cp = [ord(x) for x in p]
        a = []
        for v in cp:
            v = (v * 0x9E3779B1) & 0xFFFFFFFF
            a.append(v ^ (v >> 15))
        h = a
        for step in (1, 2):
            h = [((h[i] ^ cp[i + step]) * 0x85EBCA77) & 0xFFFFFFFF for i in range(len(cp) - step)]
            h = [v ^ (v >> 13) for v in h]
            for v in h:
                c[((v * 0xC2B2AE3D) & 0xFFFFFFFF) >> (33 - mil.BUCKETS.bit_length())] += 1
        x = np.log1p(c)
        x /= max(np.sqrt((x**2).sum()), 1e-6)
        word = [x.isascii() and x.isalnum() or ord(x) >= 128 for x in p]
        kinds = (
            sum(not w and v > 32 and v not in (44, 46) for w, v in zip(word, cp)),
            sum(65 <= v <= 90 for v in cp),
            sum(48 <= v <= 57 for v in cp),
            sum(v == 10 for v in cp),
        )
        out.append(np.concatenate([x, [(c > 0).sum() / max(c.sum(), 1)], np.array(kinds) / len(p)]))
    return np.array(out).reshape(-1, mil.BUCKETS + 5)


def test_passages_cover_whole_texts(monkeypatch):
    rng = random.Random(1)
    texts = ["short", None, "", "".join(rng.choice("abc DE1,\n#é") for _ in range(3000)), "y", "z" * 1024]
    for chunk in (1 << 19, 1024):
        monkeypatch.setattr(mil, "CHUNK", chunk)
        x, first, which = mil.bags(pa.array(texts))
        assert which.tolist() == [0, 3, 4, 5]
        assert np.allclose(x, np.concatenate([_features_by_force(t) for t in texts if t]), atol=1e-5)
        assert np.diff(np.append(first, len(x))).tolist() == [1, 6, 1, 2]


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    m = mil.Mil(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, first, y = rng.normal(0, 0.1, (9, mil.BUCKETS + 5)), np.array([0, 2, 3, 7]), np.array([0.0, 1, 1, 0])

    def loss():
        s = m.attend(m.encode(x), first)[5]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    for k, g in m.gradients(x, first, y).items():
        flat, gf = m.p[k].reshape(-1), np.asarray(g).reshape(-1)
        for i in rng.integers(0, len(flat), 5):
            old, e = flat[i], 1e-5
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * e) - gf[i]) < 1e-6


def _bags(n=300):
    """Documents of several passages; a bad one has one bad passage somewhere."""
    rng = random.Random(3)
    docs, labels, where = [], [], {}
    for i in range(n):
        parts = ["".join(rng.choice("etaoin shrdlu") for _ in range(mil.PASSAGE)) for _ in range(rng.randrange(1, 6))]
        bad = i % 2
        if bad:
            where[i] = rng.randrange(len(parts))
            parts[where[i]] = "".join(rng.choice("#$%&*@!QZ9") for _ in range(mil.PASSAGE))
        docs.append((i, "".join(parts)))
        labels.append((i, 1 - bad))
    return docs, labels, where


def test_attention_finds_the_passage_that_decides(spark):
    docs, labels, where = _bags()
    got = {r.doc_id: r for r in mil.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels[:200], "doc_id long, quality int")).collect()}
    held = labels[200:]
    assert sum(got[i].keep == bool(q) for i, q in held) >= 0.95 * len(held)
    bad = [i for i, q in held if not q]
    assert sum(got[i].top_passage == where[i] for i in bad) >= 0.9 * len(bad)


def test_scores_equal_a_plain_forward_pass(spark):
    docs, labels, _ = _bags(80)
    docs += [(900, None), (901, ""), (902, "x"), (903, "etaoin " * 3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = mil.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    p = {k: v.astype(float) for k, v in model.p.items()}
    for r in mil.score(d, model).collect():
        text = dict(docs)[r.doc_id]
        if not text:
            assert (r.n_passages, r.quality, r.keep, r.top_passage) == (0, 0.0, False, None)
            continue
        h = [np.tanh(x @ p["V"] + p["b"]) for x in _features_by_force(text)]
        e = [math.exp(sum(math.tanh(h_ @ p["A"][:, k]) / (1 + math.exp(-(h_ @ p["G"][:, k]))) * p["w"][k] for k in range(mil.GATE))) for h_ in h]
        a = [v / sum(e) for v in e]
        z = sum(v * h_ for v, h_ in zip(a, h))
        q = 1 / (1 + math.exp(-(z @ p["c"] + p["d"][0])))
        assert r.n_passages == len(h) and abs(r.quality - q) < 1e-3 and r.keep == (r.quality >= 0.5)
        assert a[r.top_passage] >= max(a) - 1e-5


def test_the_bytes_of_the_fit_are_bounded(spark, monkeypatch):
    docs, labels, _ = _bags(60)
    d, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels * 3, "doc_id long, quality int")
    seen = []
    bags = mil.bags
    monkeypatch.setattr(mil, "bags", lambda t: seen.append(t.to_pylist()) or bags(t))
    monkeypatch.setattr(mil, "train", lambda *a: "model")
    mil.fit(d.unionByName(d), marks)
    assert sorted(seen[0]) == sorted(t for _, t in docs)  # rows and labels that repeat count once
    assert mil.fit(d, marks, train_bytes=20_000) == "model" and 10_000 < sum(map(len, seen[1])) <= 20_000
    assert mil.fit(d, marks, train_bytes=0) is None


def test_quality_of_held_out_labels(spark, sf_dir):
    """Of each class apart, since most labels are 1; sf0.001 has too few of 0 to learn from."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.keep for r in mil.classify(docs, labels.filter("doc_id % 2 = 0")).collect()}
    for quality, least in ((1, 0.97), (0, 0.85)):
        held = [r.doc_id for r in labels.filter(f"doc_id % 2 = 1 AND quality = {quality}").collect()]
        assert sum(got[i] == bool(quality) for i in held) >= least * len(held)


def test_quality_odd_rows(spark):
    docs, labels, _ = _bags(60)
    rows = [*docs, (None, "etaoin"), (901, None), (902, ""), (903, "etaoin shrdlu " * 100_000), (904, "a"), (904, "a")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, quality int")
    marks = spark.createDataFrame([*((*x, "n") for x in labels), (None, 1, "n"), (5000, 0, "n"), (1, None, "n"), (901, 1, "n"), (0, 1, "n")], "doc_id long, quality int, text string")
    found = mil.classify(d, marks).collect()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    assert [(r.n_passages, r.quality, r.keep, r.top_passage) for r in by[901] + by[902]] == [(0, 0.0, False, None)] * 2
    assert by[903][0].n_passages == -(-14 * 100_000 // mil.PASSAGE) and by[904][0] == by[904][1]
    assert mil.classify(d.limit(0), marks).count() == 0
    for none in (marks.limit(0), marks.filter("quality = 1")):
        assert {(r.quality, r.keep, r.top_passage) for r in mil.classify(d, none).collect()} == {(None, None, None)}


def test_fits_are_the_same_again(spark):
    docs, labels, _ = _bags(60)
    d, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    a, b = mil.fit(d.repartition(3), marks), mil.fit(d, marks.repartition(2))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
    x, y = (lid.fit(spark.createDataFrame(rows, DOCS)) for rows in (_lang_docs(80), _lang_docs(80)[::-1]))
    assert x.temperature == pytest.approx(y.temperature) and np.allclose(x.weights, y.weights)
