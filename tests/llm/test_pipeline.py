"""The pipeline, stage by stage, against brute force on a small fixture."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from spanweave.llm import decontamination as dec
from spanweave.llm import mixing, quality_rules, resharding
from tests.llm.test_mixing_sharding import _expected
from tests.llm.test_search import _links_by_force, _matches_by_force

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _fixture():
    rng = random.Random(11)
    stop = "the of and to in is it was with for".split()

    def prose(n):
        return [rng.choice(stop) if rng.random() < 0.3 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)]

    bench = [(i, " ".join(prose(25))) for i in range(6)]
    texts = [" ".join(prose(rng.randrange(30, 120))) for _ in range(60)]
    for t in texts[:15]:
        texts.append(t.replace("the", "a", 1) if rng.random() < 0.5 else t)
    texts += [" ".join(prose(20)) + " " + bench[i][1] + " " + " ".join(prose(20)) for i in range(4)]
    texts += ["### $$$ %%%" * 30, "", None, "word " * 80]
    return [(i, t, "en", rng.choice(["s0", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)], bench


def _by_force(rows, bench):
    """doc_id -> copies, by plain Python over what quality rules keep."""
    groups = _links_by_force([(r[0], r[1]) for r in rows])
    first = {key: min(reach, key=lambda d: (d[0] is None, d[0])) for key, (*_, reach) in groups.items()}
    rows = sorted({r[:5] for r in rows if first[r[0], r[1]] == (r[0], r[1])}, key=repr)
    hit = {k for k, *_ in _matches_by_force(list(enumerate(r[1] for r in rows)), bench)}
    rows = [r for k, r in enumerate(rows) if k not in hit]
    copies = defaultdict(int)
    for (i, _), n in _expected([(r[0], r[1], r[3]) for r in rows]).items():
        copies[i] += n
    return copies


def _write(spark, folder, rows, bench):
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_equals_brute_force(spark, tmp_path):
    rows, bench = _fixture()
    folder = _write(spark, tmp_path, rows, bench)
    fine = {r.doc_id for r in quality_rules.measure(spark.createDataFrame(rows, DOC)).filter("keep").collect()}
    assert len(rows) - 4 <= len(fine) < len(rows)
    want = _by_force([r for r in rows if r[0] in fine], bench)
    got = cp.run(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == {i: n for i, n in want.items() if n}
    by = {r[0]: r for r in rows}
    assert all(tuple(r)[:5] == by[r.doc_id] for r in got)
    size, shards = sum(len(r.text.encode()) for r in got), defaultdict(int)
    for r in got:
        shards[r.new_shard] += len(r.text.encode())
    room = size * (100 + resharding.SLACK) / (100 * resharding.NEW_SHARDS)
    largest = max(len(r.text) for r in got) * max(want.values())
    assert max(shards) < resharding.NEW_SHARDS and max(shards.values()) <= room + 3 * largest


def test_run_equals_its_sql(spark, sf_dir, duck):
    got = cp.run(spark, sf_dir)
    want = duck.execute(cp.ORACLE_SQL)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(*names).collect()) == Counter(want.fetchall())


def test_run_on_odd_rows(spark, tmp_path):
    """Null ids, repeated rows, ids that repeat, null sources, a very long text and columns named as the stages' own."""
    rows, bench = _fixture()
    rng = random.Random(5)
    stop = "the of and to in is it was with for".split()
    long = " ".join(rng.choice(stop) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150_000))
    clean = " ".join(rng.choice(stop) if k % 3 == 0 else f"q{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    rows += rows[:6] + rows[:3]  # repeated rows
    rows += [(None, rows[4][1], "en", "s0", 1), (None, clean, "en", "s1", 1), (None, clean, "en", "s1", 1), (None, "lead in the " + bench[5][1], "en", "s1", 1)]
    rows += [(2, "an id of another text " + clean[::-1].replace("q", "r"), "en", "s2", 1), (900, long, None, "s2", None), (901, long + " and the end", "en", None, 1)]
    extra = ", _row string, e int, g int, copy int, mix_key string, _id string"
    spark.createDataFrame([(*r, "x", 1, 2, 3, "k", None) for r in rows], DOC + extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    fine = Counter((r.doc_id, r.text) for r in quality_rules.accepted(docs).collect())
    want = _by_force([r for r in rows if (r[0], r[1]) in fine], bench)
    got = cp.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == {i: n for i, n in want.items() if n}
    assert any(r.doc_id == 900 for r in got) == bool(want[900]) and not any(r.doc_id == 901 for r in got)
    assert all(r[5:11] == ("x", 1, 2, 3, "k", None) for r in got) and [c for c in got[0].__fields__][11:] == ["old_shard", "new_shard", "moved"]


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    rows, bench = _fixture()
    folder = _write(spark, tmp_path, rows, bench)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(cp.STAGES) <= 5
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]


def test_run_on_empty_tables(spark, tmp_path):
    folder = _write(spark, tmp_path, [], [])
    got = cp.run(spark, folder)
    assert got.count() == 0 and got.columns[:5] == [c.split()[0] for c in DOC.split(", ")]


@pytest.mark.parametrize("quality", [1])
def test_clean_labelled_documents_pass_the_rules(spark, sf_dir, quality):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(f"quality = {quality}")
    clean = docs.join(labels, "doc_id", "left_semi")
    assert cp.quality_stage(spark, clean, sf_dir).count() == clean.count()


def test_no_benchmark_passage_is_left(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    left = cp.decontamination_stage(spark, docs, sf_dir)
    assert dec.matches(left, bench).count() == 0 and left.count() < docs.count()


def test_mixing_stage_is_the_operator(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = cp.mixing_stage(spark, docs, sf_dir), mixing.mixed(docs)
    assert Counter(r.doc_id for r in a.collect()) == Counter(r.doc_id for r in b.collect())
