"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from cipherlake.operators import train
from cipherlake.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if not isinstance(value, (str, bool)) and hasattr(value, "__float__") else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    have = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("leftover", [False, True])
def test_entry_imports_without_llm(tmp_path, leftover):
    """The entry module works when the llm folders and the pipeline are gone, also if caches or the pipeline stay behind."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/cipherlake", tmp_path / "cipherlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if leftover:
        (tmp_path / "cipherlake" / "llm" / "__pycache__").mkdir(parents=True)
        if os.path.exists(f"{root}/corpus_pipeline.py"):
            shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    assert said.stdout.split()[-2:] == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]


def test_learning_is_dealt_over_the_cores(spark):
    """One file of one row group is one task's, which every tree and round would go over."""
    rows = spark.range(0, 40_000, 1, 1).selectExpr("id % 2 as y", "cast(id as double) as x")
    dealt = train.prepared(rows, "y")
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert dealt.agg({"_weight": "sum", "_y": "sum"}).first().asDict() == {"sum(_weight)": 40_000.0, "sum(_y)": 20_000.0}


def test_catalogue_takes_invalid_addresses_as_public(spark, tmp_path):
    """From user 64,000 on the view makes addresses like 10.0.256.1, which are no addresses; the SQL took them as private."""
    con = duckdb.connect()
    source = f"{DATA}/events.parquet"
    if not os.path.exists(source):
        pytest.skip("no test tables")
    con.execute(f"copy (select * replace (user_id + event_id % 2 * 64000 as user_id) from '{source}') to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = catalog.queries()["endpoint_catalog"](spark, str(tmp_path))
    have = [tuple(map(str, r)) for r in got.collect()]
    want = [tuple(map(str, r)) for r in con.execute(f"select {', '.join(got.columns)} from ({catalog.oracle_sql()['endpoint_catalog']})").fetchall()]
    assert sorted(have) == sorted(want)
    assert any(r[0].startswith("10.0.256.") and r[2] == "False" for r in have) and any(r[2] == "True" for r in have)


def test_learning_bounds_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(train, "MOST_ROWS", 1_000)
    dealt = train.prepared(spark.range(0, 20_500, 1, 1).selectExpr("id % 2 as y"), "y")
    assert max(dealt.rdd.glom().map(len).collect()) <= 1_000 and dealt.count() == 20_500
