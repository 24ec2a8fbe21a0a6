"""Every query against its SQL in DuckDB, on the smallest tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

spec = importlib.util.spec_from_file_location("entry_module", Path(__file__).parents[1] / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.library.queries()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.library.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.library.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in result.fetchall()), key=repr)
    assert got == want and got


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["fallback_chain", "slot_padding"])
def test_rows_are_dealt_by_their_number(spark, name, monkeypatch):
    """What a task joins and sorts does not grow with the table."""
    from auralake.plans import catalogue, scenes

    for module in (catalogue, scenes):
        monkeypatch.setattr(module, "parts_of", lambda df: -(-df.count() // 100))
    plan = entry.library.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 100)
    joins = plan.count("SortMergeJoin")
    assert joins and plan.count(f", {n}), REPARTITION_BY_NUM") >= 2
