"""Every registered query against its DuckDB statement, and what importing the entry point needs."""

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessella.plans import registry

FOLDER = os.environ.get("TESSELLA_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value with the same form for both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_as_duckdb(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert a == b, f"only Spark: {list((a - b).items())[:3]}; only DuckDB: {list((b - a).items())[:3]}"


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q)"
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_fact_conflicts_compares_classes_and_spells_out_their_rows(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT i AS p_partkey, 'Name ' || i % 3 AS p_name, (i % 5)::INT AS p_size, CASE WHEN i % 11 > 0 THEN 900.0 + i % 2 END AS p_retailprice FROM range(600) t(i)) TO '{tmp_path}/part.parquet'")
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    found = registry.QUERIES["fact_conflicts"](spark, str(tmp_path))
    want = duck.execute(registry.ORACLE["fact_conflicts"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 10_000
    # What is joined are classes and not rows: ids come out of lists behind the join.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(others") < plan.index("Join") and "collect_list(id" in plan[plan.index("Join") :]


def test_fact_conflicts_makes_each_pair_once_from_bounded_pieces(spark, tmp_path):
    duck = duckdb.connect()
    # Classes of more ids than a piece holds, ids in several classes and twice in one, and rows without an id or a session.
    rows = "SELECT i AS p_partkey, 'Name' AS p_name, (i % 2)::INT AS p_size, 900.0 + i % 2 AS p_retailprice FROM range(2600) t(i) WHERE i % 4 < 2"
    odd = "SELECT i % 40, 'NAME', 0, 901.0 FROM range(60) t(i) UNION ALL SELECT NULL, 'name', 0, 900.0 UNION ALL SELECT 5000000 + i, 'name', 0, 907.0 FROM range(3) t(i)"
    duck.execute(f"COPY ({rows} UNION ALL {odd}) TO '{tmp_path}/part.parquet'")
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    found = registry.QUERIES["fact_conflicts"](spark, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(duck.execute(registry.ORACLE["fact_conflicts"]).fetchall())
    # Pairs of pieces are dealt out between the join and the lists, and no list is longer than a piece.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(ones") < plan.index("RepartitionByExpression [ones") < plan.index("Join")
    assert plan.index("Join") < plan.index("slice(ids") < plan.index("collect_list(id")
