"""The entry module, the shared-folder tables and connected components."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module
from spanweave import storage
from spanweave.operators.graph import components
from spanweave.plans import catalog

REPO = Path(__file__).resolve().parents[1]


def _cells(rows):
    return sorted(repr([None if v is None or v != v else round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r]) for r in rows)


def test_entry_runs(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test data here")
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalog_query_equals_its_sql(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _cells(got.select(*[f"`{n}`" for n in names]).collect()) == _cells(want.fetchall())


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    """As the driver leaves it: no corpus_pipeline.py and no llm folders."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"],
        cwd=tmp_path / "r", capture_output=True, text=True, timeout=120,
    )
    assert said.returncode == 0, said.stderr
    assert said.stdout.split("\n")[0].split() == sorted(catalog.queries())


def test_nothing_outside_the_subpackage_imports_it():
    for p in (REPO / "spanweave").rglob("*.py"):
        if "llm" not in p.relative_to(REPO / "spanweave").parts:
            assert "spanweave.llm" not in p.read_text(), p


def test_written_table_is_in_the_folder_that_the_session_names(spark):
    w = storage.Written(spark.range(10).selectExpr("id", "cast(null as string) AS s"), "ten")
    assert w.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert w.df.count() == 10 and w.nbytes > 0
    assert "BroadcastExchange" in spark.range(5).join(w.side(), "id")._jdf.queryExecution().toString()
    w.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        w.df.count()


def test_release_keeps_what_came_before_and_what_it_is_told(spark):
    before = storage.Written(spark.range(3), "before")
    mark = storage.made()
    a, b = (storage.Written(spark.range(n), "t") for n in (4, 5))
    assert storage.release(spark, mark, (b.path,)) == 1
    assert before.df.count() == 3 and b.df.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        a.df.count()
    assert storage.release(spark, mark) == 1


def test_components(spark, rows):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (5, 5), (None, 4), (2, 1)], "a long, b long")
    assert rows(components(edges)) == sorted([(1, 1), (2, 1), (3, 1), (6, 6), (7, 6), (8, 6), (9, 6)], key=repr)
    assert components(edges.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in components(edges).collect()} == {0}
