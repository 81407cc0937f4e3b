"""Every registered query that has SQL, against the SQL engine, on the smallest data."""

import math
from decimal import Decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
# Full profiles take seconds each; one of them is enough here.
SLOW = {"health_score", "table_summary", "rank_metrics", "pick_date", "suggestions", "before_after", "anomaly_facts",
        "data_notes", "fact_overview", "starter_plan_answers", "dashboard_build", "profile_columns", "stored_profile"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, Decimal):
        v = float(v)
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(tidy, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_agrees(spark, duck, name):
    frame = QUERIES[name](spark, str(DATA))
    found = table_of(frame.columns, frame.collect())
    relation = duck.sql(ORACLES[name])
    assert found == table_of(relation.columns, relation.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
