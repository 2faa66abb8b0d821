import pytest

from chronolith.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert_same(got, duck.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0


def test_entry_point(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_point_knows_the_training_data_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "chronolith"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f


def test_described_edges_where_flags_and_dates_are_missing(spark, sf, tmp_path):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "part", "lineitem"):
        rows = f"SELECT * FROM '{sf}/{t}.parquet'"
        if t == "lineitem":
            rows = f"SELECT * REPLACE (CASE WHEN (l_orderkey + l_linenumber) % 3 > 0 THEN l_returnflag END AS l_returnflag, CASE WHEN l_partkey % 7 > 0 THEN l_shipdate END AS l_shipdate) FROM '{sf}/{t}.parquet'"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert_same(QUERIES["f16_described_edges"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["f16_described_edges"]).df())
