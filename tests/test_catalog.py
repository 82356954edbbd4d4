"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessella import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def plain(value):
    return "%.9g" % value if isinstance(value, float) and math.isfinite(value) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    want = duck.sql(registry.oracle_sql()[name])
    columns = want.columns
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, str(DATA)).count() > 0


def test_survival_runs_all_steps_of_the_survey(spark):
    rows = registry.queries()["mut11_survival"](spark, str(DATA)).collect()
    assert {(r.preset, r.step) for r in rows} == {(p, k) for p in ("low", "medium", "high") for k in range(1, 11)}


def test_longest_code_on_entities_and_breaks(spark, tmp_path):
    pages = ["<h1>a = &quot;b&quot;</h1>", "<h1>a<br/>b &amp; c</h1><H1 class='x'>&lt;<b>i</b>\n&gt;</H1>", "<p>none</p>", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.queries()["flt03_longest_code"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(registry.oracle_sql()["flt03_longest_code"]).fetchall())


@pytest.fixture
def odd_parts(spark, tmp_path):
    """Keys of several rows, a null key, a null name, and a repeated word."""
    rows = [(1, "red ring", "SMALL"), (1, "blue bolt", "SMALL"), (2, "Red plate", "red"), (2, "red plate", "RED"), (None, "lone word", "LARGE"), (3, None, "HUGE"), (4, "one", "one"), (5, "a  b", "TINY")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["grf01_edges", "grf02_connected", "grf03_neighbours"])
def test_graphs_of_odd_parts(spark, odd_parts, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{odd_parts}/part.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(map(tuple, registry.queries()[name](spark, odd_parts).select(want.columns).collect())) == sorted(want.fetchall())


def test_graph_sends_no_table_of_parts_to_every_task(spark, odd_parts):
    df = registry.queries()["grf03_neighbours"](spark, odd_parts)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Join" in line and "p_partkey" in line] == []
    assert "RepartitionByExpression [p_partkey" in plan
