"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from stratolens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return f"{x + 0.0:.5g}"  # no -0
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    assert got
    q = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in q.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got) == want


def test_entry(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert entry.entry(spark).count() == 25 * n


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "stratolens", tmp_path / "stratolens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(k.startswith('op') and k[2].isdigit() for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
