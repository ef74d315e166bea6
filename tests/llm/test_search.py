"""MinHash pairs, recompression repeats and benchmark matches against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm import decontamination as dec
from spanweave.llm import minhash_dedup as mh
from spanweave.llm import recompression as rec
from spanweave.llm.textscan import scans, words

DOC = "doc_id long, text string"
BENCH = "item_id long, text string"


def _prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- words


def test_scans_equal_the_plain_words():
    texts = ["Hello, World! it's", None, "", "...", "Straße ÀÉ 日本語 x", "a\nb\tc", "_x9 " * 500, "İstanbul"]
    plain = [words(t) for t in texts]
    seen = {}
    at = 0
    for s in scans(pa.array(texts)):
        for i in range(s.lo, s.hi):
            own = s.hashes[s.offsets[i - s.lo] : s.offsets[i - s.lo + 1]].tolist()
            assert len(own) == len(plain[i])
            for w, h in zip(plain[i], own):
                assert seen.setdefault(w, h) == h
            at += 1
    assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_words_of_scripts_and_typographic_punctuation():
    assert words("l\u2019\u00e9t\u00e9\u00a0\u00abfin\u00bb \u2014 don\u2019t\u2026") == words("l'\u00e9t\u00e9 \"fin\" - don't...") == ["l", "\u00e9t\u00e9", "fin", "don", "t"]
    assert words("\u65e5\u672c\u8a9e\u3002abc\u6587\u3001x1") == ["\u65e5", "\u672c", "\u8a9e", "abc", "\u6587", "x1"]
    assert words("\u0e17\u0e35\u0e48\u0e19\u0e35\u0e48") == ["\u0e17\u0e35\u0e48", "\u0e19\u0e35\u0e48"]
    assert words("cafe\u0301 \u0915\u093f\u0924\u093e\u092c") == ["cafe\u0301", "\u0915\u093f\u0924\u093e\u092c"]


def test_scans_equal_the_plain_words_beyond_ascii():
    rng = random.Random(4)
    signs = "ab1_ .\u00e9\u0301\u0e17\u0e35\u65e5\u3002\u2019\u00a0\U00020000\U0001f600\u30ab\u0915\u093f\u00ff"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(3000)]
    seen = {}
    for s in scans(pa.array(texts)):
        for i in range(s.lo, s.hi):
            own = s.hashes[s.offsets[i - s.lo] : s.offsets[i - s.lo + 1]].tolist()
            plain = words(texts[i])
            assert len(own) == len(plain)
            assert all(seen.setdefault(w, h) == h for w, h in zip(plain, own))
    assert len(set(seen.values())) == len(seen)


def test_a_benchmark_item_in_chinese_is_found(spark):
    item = "".join(chr(0x4E00 + 37 * k) for k in range(30))
    docs = [(1, "\u524d\u8a00\u3002" + item + "\u5b8c"), (2, "\u524d\u8a00\u3002")]
    got = _found(dec.matches(spark.createDataFrame(docs, DOC), spark.createDataFrame([(1, item + "\u3002")], BENCH)))
    assert got[1, 1, "phrase"] == (30, 2) and {k[0] for k in got} == {1}


# --- near duplicates


def _links_by_force(docs, threshold=mh.THRESHOLD):
    """(id, text) -> (group id, links), comparing every signature with every other."""
    every = sorted({(i, t or "") for i, t in docs}, key=lambda d: (d[0] is None, d[0] or 0, d[1]))
    sig = {}
    for d in every:
        for s in scans(pa.array([d[1]], pa.string())):
            rows, own = mh.signatures_of(s.hashes, s.offsets)
            if len(rows):
                sig[d] = own[0]
    t = mh.least_matches(threshold)
    near = {d: {o for o in sig if o != d and int((sig[d] == sig[o]).sum()) >= t} for d in sig}
    group = {}
    for d in every:
        reach, todo = {d}, [d]
        while todo:
            for o in near.get(todo.pop(), ()):
                if o not in reach:
                    reach.add(o)
                    todo.append(o)
        ids = [i for i, _ in reach if i is not None]
        group[d] = (min(ids) if ids else None, len(near.get(d, ())), reach)
    return group


def _check_links(spark, docs, threshold=mh.THRESHOLD):
    want = _links_by_force(docs, threshold)
    got = mh.near_links(spark.createDataFrame(docs, DOC), threshold).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((i, *want[i, t][:2]) for i, t in want), key=repr)
    return want


def _near_corpus():
    rng = random.Random(1)
    docs = []
    for _ in range(60):
        base = _prose(rng, rng.choice([1, 2, 5, 40, 200]))
        docs.append((len(docs), " ".join(base)))
        for changes in rng.sample([0, 0, 1, 3, 8, 20], rng.randrange(4)):
            other = list(base)
            for _ in range(changes):
                other[rng.randrange(len(other))] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(other).upper()))
    return docs


@pytest.mark.parametrize("threshold", [mh.THRESHOLD, 0.1, 0.9, 1.0])
def test_links_equal_brute_force(spark, threshold):
    want = _check_links(spark, _near_corpus(), threshold)
    assert sum(n for _, n, _ in want.values()) > 20


def test_links_of_groups_without_a_middle(spark):
    """Chains that drift away from where they began, and copies edited so much that some pairs miss the threshold."""
    rng = random.Random(8)
    docs = []
    for _ in range(6):
        own = _prose(rng, 60)
        for _ in range(25):
            docs.append((len(docs), " ".join(own)))
            own = list(own)
            for _ in range(rng.randrange(1, 4)):
                own[rng.randrange(60)] = f"y{rng.random()}"
    base = _prose(rng, 120)
    for _ in range(80):
        docs.append((len(docs), " ".join(f"z{rng.random()}" if rng.random() < 0.09 else v for v in base)))
    want = _check_links(spark, docs)
    counts = [n for _, n, _ in want.values()]
    assert max(counts) > 10 and any(n + 1 < len(g) for _, n, g in want.values()) and len(set(counts)) > 10


def test_a_list_whose_ends_are_linked_to_none_of_the_rest(spark):
    """The star's ends share a list with the others but no link; the others still meet."""
    rng = random.Random(9)
    docs = []
    for _ in range(40):
        a, b = _prose(rng, 70), _prose(rng, 70)
        for text in (a, b[:20] + a[:50], b[:50] + a[50:], b, a[:60] + b[60:]):
            docs.append((len(docs), " ".join(text)))
    _check_links(spark, docs)
    _check_links(spark, docs, 0.3)


def test_recall_of_true_overlap(spark, sf_dir):
    """Nine in ten of the pairs whose runs of words overlap by 70 % or more end in one group, and no group is of unlike texts."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = {}
    for r in df.select("doc_id", "text").collect():
        w = words(r.text)
        if w:
            runs[r.doc_id] = {tuple(w[k : k + mh.RUN]) for k in range(max(1, len(w) - mh.RUN + 1))}
    ids = sorted(runs)

    def overlap(a, b):
        return len(runs[a] & runs[b]) / len(runs[a] | runs[b])

    true = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if overlap(a, b) >= 0.7]
    group = {r.doc_id: r.group_id for r in mh.near_links(df).collect()}
    assert true and sum(group[a] == group[b] for a, b in true) >= 0.9 * len(true)
    for a in ids:
        assert group[a] == a or any(group[b] == group[a] and b != a and overlap(a, b) > 0.3 for b in ids)


def test_near_odd_rows(spark):
    text = " ".join(_prose(random.Random(2), 60))
    rows = [(1, None), (2, ""), (2, ""), (3, " .,; "), (None, text), (None, None), (4, text), (4, text), (5, text), (5, "another text"), (6, "one"), (7, "one"), (8, text * 3000), (None, "lone"), (None, "lone"), (9, "Lone")]
    docs = spark.createDataFrame([(*r, 5, "x", {"k": 1}) for r in rows], DOC + ", e int, sig string, g map<string,int>")
    got = sorted((tuple(r) for r in mh.near_links(docs).collect()), key=repr)
    want = _links_by_force(rows)
    assert len(got) == len(set(rows)) and got == sorted([(i, *want[i, t or ""][:2]) for i, t in set(rows)], key=repr)
    assert mh.near_links(docs).columns == ["doc_id", "group_id", "n_links"]
    kept = mh.one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert left == sorted([(1, None), (2, ""), (2, ""), (3, " .,; "), (None, None), (4, text), (5, "another text"), (6, "one"), (9, "Lone")], key=repr)  # 8 is the text of 4, again and again
    assert mh.near_links(docs.limit(0)).count() == 0 == mh.one_of_each(docs.limit(0)).count()
    with pytest.raises(ValueError, match="threshold"):
        mh.near_links(docs, 0)


def test_one_of_each_leaves_one_of_each_group(spark):
    docs = _near_corpus()
    want = _links_by_force(docs)
    left = {r.doc_id for r in mh.one_of_each(spark.createDataFrame(docs, DOC)).collect()}
    assert left == {g for g, *_ in want.values()}


def test_rows_that_repeat_differ_in_other_columns_only(spark):
    docs = spark.createDataFrame([(1, "some text", k % 5) for k in range(50)] + [(2, "else", 0)], DOC + ", n int")
    a, b = (sorted(tuple(r) for r in mh.one_of_each(d).collect()) for d in (docs, docs.repartition(7, "n")))
    assert a == b and [r[0] for r in a] == [1, 2]


# --- repeats


def _repeats_by_force(docs, n=rec.LEAST):
    """Rows of the result: every run of n words whose first occurrence, in order of (id, place), is another, joined at equal shifts."""
    first, rows = {}, []
    for i, t in sorted(docs):
        w = words(t)
        for p in range(len(w) - n + 1):
            src = first.setdefault(tuple(w[p : p + n]), (i, p))
            if src == (i, p):
                continue
            if rows and rows[-1][0] == i and rows[-1][1] + rows[-1][2] - n + 1 == p and (rows[-1][3], rows[-1][4] + rows[-1][2] - n + 1) == src:
                rows[-1][2] += 1
            else:
                rows.append([i, p, n, *src])
    return sorted(map(tuple, rows))


def _check_repeats(spark, docs):
    found = sorted(tuple(r) for r in rec.repeats(spark.createDataFrame(docs, DOC)).collect())
    want = _repeats_by_force(docs)
    assert found == want
    return want


def _repeat_corpus(seed=3):
    rng = random.Random(seed)
    shared = [_prose(rng, n) for n in (50, 51, 60, 75, 120, 400)]
    docs = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += _prose(rng, rng.randrange(0, 80))
            if rng.random() < 0.7:
                parts += rng.choice(shared)
        docs.append((i, " ".join(parts)))
    docs += [(100, "spam " * 300), (101, "x y " * 200), (102, "spam " * 77), (103, " ".join(_prose(rng, 49))), (104, " ".join(shared[0][:49]))]
    return docs


def test_repeats_equal_brute_force(spark):
    assert len(_check_repeats(spark, _repeat_corpus())) > 100


def test_repeats_odd_rows(spark):
    rng = random.Random(5)
    p = " ".join(_prose(rng, 80))
    rows = [(None, p), (1, None), (2, ""), (3, p), (4, "lead " + p), (4, "lead " + p), (5, " ".join(_prose(rng, 60_000)) + " " + p)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], DOC + ", at int, h string")
    got = sorted(tuple(r) for r in rec.repeats(docs).collect())
    assert got == [(4, 1, 80, 3, 0), (5, 60_000, 80, 3, 0)]
    assert rec.repeats(docs.limit(0)).count() == 0
    texts = spark.createDataFrame([(str(i), t) for i, t in rows if i in (3, 5)] + [("10", p)], "doc_id string, text string")
    assert sorted(tuple(r) for r in rec.repeats(texts).collect()) == [("3", 0, 80, "10", 0), ("5", 60_000, 80, "10", 0)]


def test_repeats_between_texts_of_one_id(spark):
    p = " ".join(_prose(random.Random(6), 80))
    docs = spark.createDataFrame([(1, p), (1, p + " more"), (2, "lead " + p)], DOC)
    got = sorted(tuple(r) for r in rec.repeats(docs).collect())
    assert got == [(1, 0, 80, 1, 0), (2, 1, 80, 1, 0)]


def test_repeats_whose_parts_occur_before_elsewhere(spark):
    """X and Y hold parts of a passage that are too short to be repeats; A and B hold it whole."""
    rng = random.Random(11)
    docs = []
    for _ in range(30):
        p = _prose(rng, 60)
        for part in (p[:40], p[20:], p, p):
            docs.append((len(docs), " ".join(_prose(rng, 20) + part + _prose(rng, 20))))
    assert len(_check_repeats(spark, docs)) == 30


def test_pieces_of_thirty_words_before_a_passage_of_a_hundred_and_twenty(spark):
    rng = random.Random(13)
    p = _prose(rng, 120)
    docs = [(k, " ".join(_prose(rng, 15) + p[10 * k : 10 * k + 30] + _prose(rng, 15))) for k in range(10)]
    docs += [(1000, " ".join(p)), (1001, " ".join(_prose(rng, 30) + p))]
    assert _check_repeats(spark, docs) == [(1001, 30, 120, 1000, 0)]


def test_repeats_in_a_large_group_of_edited_copies(spark):
    """Each place has few variants, so that most runs come from some copy other than the first."""
    rng = random.Random(12)
    base = _prose(rng, 240)
    docs = []
    for i in range(150):
        own = [f"{v}v{rng.randrange(3)}" if k % 24 == 0 else v for k, v in enumerate(base)]
        docs.append((i, " ".join(own)))
    docs += [(200 + i, docs[rng.randrange(100)][1]) for i in range(10)]
    assert len(_check_repeats(spark, docs)) > 100


def test_repeats_of_words_in_a_row(spark):
    """Ends of one run and starts of another, runs of several words, and runs of every length around CUT and LEAST."""
    docs = [(0, "x " * 30 + "y " * 40), (1, "a " + "x " * 25 + "y " * 60), (2, "p q r " * 40 + "end"), (3, "r " + "p q r " * 19), (4, "q r p " * 30)]
    docs += [(10 + n, f"s{n} " + "z " * n + f"t{n}") for n in range(18, 56)]
    docs += [(100 + n, " ".join(f"u{k}" for k in range(n)) + " m n" * n) for n in range(16, 30)]
    docs += [(200 + n, "a b c d e f g h i j k l m " * n) for n in range(3, 9)]
    assert len(_check_repeats(spark, docs)) > 60


def test_equal_runs_get_equal_symbols():
    rng = np.random.default_rng(0)
    p = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    for lead in range(12):
        text = np.concatenate([rng.integers(0, 1 << 63, 30 + lead, dtype=np.uint64), p])
        h, at, n = rec.symbols(text, np.zeros(len(text), np.int64))
        inside = {(int(x), int(a) - 30 - lead) for x, a, k in zip(h, at, n) if a >= 40 + lead and a + k <= 120 + lead}
        if lead == 0:
            first = inside
        assert len(inside & first) >= 2


# --- benchmark matches


def _matches_by_force(docs, bench, rules=dec.Rules()):
    by = defaultdict(list)
    for i, t in docs:
        if i is not None and t:
            by[i].append(words(t))
    out = {}

    def offer(key, n, at):
        if key not in out or (n, -at) > (out[key][0], -out[key][1]):
            out[key] = (n, at)

    for item, text in bench:
        if item is None or text is None or len(words(text)) < rules.least:
            continue
        b = words(text)
        m, d = len(b), set(b)
        least, w = min(rules.phrase, m), m + max(4, m // 4)
        k = math.ceil(rules.near * len(d) - 1e-9)
        for i, versions in by.items():
            for x in versions:
                run = [0] * (m + 1)
                for p, v in enumerate(x):
                    run = [0] + [run[j] + 1 if b[j] == v else 0 for j in range(m)]
                    for n in run:
                        if n >= least:
                            offer((i, item, "phrase"), n, p - n + 1)
                if len(d) >= rules.least_near:
                    for p, v in enumerate(x):
                        if v in d and (n := len(d.intersection(x[p : p + w]))) >= k:
                            offer((i, item, "near"), n, p)
    return out


def _found(df):
    return {(r.doc_id, r.item_id, r.kind): (r.n_words, r.at) for r in df.collect()}


def _bench_corpus():
    rng = random.Random(7)
    bench = [(i, " ".join(_prose(rng, rng.choice([3, 5, 9, 14, 30, 45]), 300))) for i in range(25)]
    docs = []
    for i in range(70):
        parts = _prose(rng, rng.randrange(60), 300)
        own = words(rng.choice(bench)[1])
        kind = rng.randrange(5)
        if kind == 1:
            parts += own
        elif kind == 2:
            parts += own[: max(4, len(own) * 2 // 3)]
        elif kind == 3:
            parts += [v if rng.random() < 0.85 else "other" for v in own]
        elif kind == 4:
            rng.shuffle(own)
            parts += own
        docs.append((i, " ".join(parts + _prose(rng, rng.randrange(60), 300))))
    return docs, bench


def test_matches_equal_brute_force(spark):
    docs, bench = _bench_corpus()
    got = _found(dec.matches(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, BENCH)))
    want = _matches_by_force(docs, bench)
    assert got == want and {k for *_, k in want} == {"phrase", "near"}


@pytest.mark.parametrize("rules", [dec.Rules(phrase=4, least=1, least_near=1), dec.Rules(phrase=20, near=1.0), dec.Rules(near=0.4, least=9)])
def test_matches_under_other_rules(spark, rules):
    docs, bench = _bench_corpus()
    docs = docs[:40]
    assert _found(dec.matches(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, BENCH), rules)) == _matches_by_force(docs, bench, rules)


@pytest.mark.parametrize("vocabulary", [1 << 23, 10])
def test_matches_do_not_depend_on_the_parts(spark, monkeypatch, vocabulary):
    docs, bench = _bench_corpus()
    for name, value in (("PART_BYTES", 1000), ("_AT_ONCE", 50), ("VOCABULARY", vocabulary)):
        monkeypatch.setattr(dec, name, value)
    assert _found(dec.matches(spark.createDataFrame(docs, DOC), spark.createDataFrame(bench, BENCH))) == _matches_by_force(docs, bench)


def test_items_that_are_left_out_are_counted(spark):
    bench = [(1, "a b c d"), (2, "a b c d a b c d"), (3, "a b c d e f g h i"), (None, "x"), (4, None)]
    (r,) = dec.left_out(spark.createDataFrame(bench, BENCH)).collect()
    assert tuple(r) == (1, 1, 3)


def test_a_segment_visits_only_items_whose_rare_words_it_has():
    """Items without a word in the segment cost nothing: no place of theirs is looked at."""
    toks = [np.arange(20 * k, 20 * k + 20) for k in range(500)]
    items = dec.Items(toks, np.ones(10_000, np.int64), dec.Rules())
    seg = dec.Segment(np.array([0, 21]), np.arange(60, 80), np.ones(20, np.int64), np.arange(20))
    looked = sum(len(p) for terms in (items.anchor_term, items.top_term) for p, _ in seg.meet(terms))
    assert looked < 20 and items.phrases(seg).tolist()[0][:3] == [3, 0, 20] and items.near(seg).tolist() == [[3, 0, 20, 0]]


def test_matches_odd_rows(spark):
    p = " ".join(f"b{k}" for k in range(20))
    rows = [(None, p), (1, None), (2, ""), (3, p + " x " + p), (3, p), (4, "z " * 100_000 + p), (5, "clean text"), (5, "clean text")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOC + ", item_id int, at int")
    bench = spark.createDataFrame([(1, p, 0), (1, p, 0), (None, p, 0), (2, None, 0), (3, "", 0), (4, "b0 b1", 0)], BENCH + ", doc_id int")
    got = _found(dec.matches(docs, bench))
    assert got == {(3, 1, "phrase"): (20, 0), (3, 1, "near"): (20, 0), (4, 1, "phrase"): (20, 100_000), (4, 1, "near"): (20, 100_000)}
    kept = dec.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 5, 5]  # the null id holds the item too
    assert dec.matches(docs.limit(0), bench).count() == 0 == dec.matches(docs, bench.limit(0)).count()
    assert dec.clean(docs, bench.limit(0)).count() == len(rows)
