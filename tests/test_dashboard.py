import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import dashboard, facts
from quillgrid.operators.profile import profile_table
from quillgrid.plans.run import run_plan
from quillgrid.plans.starter import starter_plans


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame(
        {
            "sold_on": rng.choice(pd.date_range("2025-01-01", periods=120), n).astype(str),
            "revenue": np.round(rng.gamma(3, 40, n), 2),
            "quantity": rng.integers(1, 9, n),
            "region": rng.choice(["N", "S", "E", "W", None], n),
        }
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def built(sales):
    frame = sales[1]
    profile = profile_table(frame)
    return profile, dashboard.build_dashboard(frame, profile)


def test_all_tables_present(built):
    _, d = built
    assert d.roles == {"date": "sold_on", "metrics": ["revenue", "quantity"], "dimensions": ["region"]}
    assert [r["label"] for r in d.kpis.orderBy("place").collect()] == ["Records", "Total revenue", "Total quantity"]
    for part in (d.lines, d.bars, d.shares, d.histograms, d.boxes, d.correlations, d.category_options):
        assert part.count() > 0


def test_shares_add_up(built):
    _, d = built
    rows = d.shares.collect()
    assert "(missing)" in {r["category"] for r in rows}
    assert sum(r["share_pct"] for r in rows) == pytest.approx(100, abs=0.1)


def test_histogram_matches_numpy(sales, built):
    pdf, _ = sales
    rows = built[1].histograms.where("metric = 'revenue'").orderBy("bin").collect()
    counts, edges = np.histogram(pdf["revenue"], bins=20)
    assert [r["count"] for r in rows] == list(counts)
    assert [r["low_edge"] for r in rows] == pytest.approx(list(np.round(edges[:-1], 2)), abs=0.011)


def test_constant_histogram(spark):
    frame = spark.range(12).select(F.lit(5.0).alias("v"))
    rows = dashboard.histogram_table(frame, ["v"]).orderBy("bin").collect()
    counts, _ = np.histogram([5.0] * 12, bins=8)
    assert [r["count"] for r in rows] == list(counts)
    assert dashboard.histogram_table(frame.limit(9), ["v"]).count() == 0


def test_boxes(sales, built):
    pdf, _ = sales
    found = {r["category"]: r for r in built[1].boxes.collect()}
    north = pdf[pdf["region"] == "N"]["revenue"]
    assert found["N"]["median"] == pytest.approx(north.median(), abs=0.01)
    wide = sales[1].withColumn("region", F.concat("region", F.col("quantity")))
    found = {r["category"] for r in dashboard.box_table(wide, "revenue", "region").collect()}
    sizes = (pdf["region"].dropna() + pdf["quantity"].astype(str)).value_counts()
    assert len(found) > 8 and found - {"(missing)"} == set(sizes[sizes >= 5].index)


def test_all_categories_have_shares(sales):
    pdf, frame = sales
    wide = frame.withColumn("region", F.concat("region", F.col("quantity")))
    rows = dashboard.share_table(wide, "revenue", ["region", "quantity"]).collect()
    assert {r["dimension"] for r in rows} == {"region", "quantity"}
    assert sum(r["share_pct"] for r in rows) == pytest.approx(200, abs=0.5)


def test_all_metrics(spark):
    names = [f"m{i}" for i in range(5)]
    frame = spark.range(40).select(*[(F.col("id") * (i + 1)).cast("double").alias(n) for i, n in enumerate(names)])
    assert {r["metric"] for r in dashboard.histogram_table(frame, names).collect()} == set(names)
    assert dashboard.kpi_table(frame, names, None).count() == 1 + len(names)
    assert facts.metric_facts(frame, names, None).count() == len(names)


def test_filters(sales, built):
    pdf, frame = sales
    profile, full = built
    chosen = dashboard.DashboardFilters("2025-02-01", "2025-02-28", ["N"])
    part = dashboard.build_dashboard(frame, profile, chosen)
    expected = pdf[(pdf["region"] == "N") & (pdf["sold_on"] >= "2025-02-01") & (pdf["sold_on"] < "2025-03-01")]
    assert part.kpis.where("label = 'Records'").first()["value"] == len(expected)
    assert part.category_options.collect() == full.category_options.collect()


def test_without_dates_or_dimensions(spark):
    frame = spark.createDataFrame([(float(i % 37),) for i in range(100)], "amount double")
    d = dashboard.build_dashboard(frame, profile_table(frame))
    assert d.lines is None and d.bars is None and d.histograms.count() > 0


def test_facts(sales, built):
    pdf, frame = sales
    found = facts.extract_facts(frame, built[0])
    m = {r["metric"]: r for r in found.metrics.collect()}
    assert m["revenue"]["total"] == pytest.approx(pdf["revenue"].sum(), abs=0.01)
    assert m["revenue"]["best_value"] >= m["revenue"]["worst_value"]
    s = found.segments.first()
    assert s["top_value"] >= s["bottom_value"] and s["segments_count"] == 5
    assert {r["column"] for r in found.notes.collect()} >= {"region"}


def test_facts_without_dates(spark):
    frame = spark.createDataFrame([(1.5 * (i % 3), "abc"[i % 3]) for i in range(30)], "amount double, cat string")
    found = facts.extract_facts(frame, profile_table(frame))
    assert found.dates is None and found.metrics.first()["growth_pct"] is None


def test_starter_plans_run(sales, built):
    plans = starter_plans(built[0])
    assert [p.operation for p in plans] == ["top_n", "trend", "correlate", "aggregate"]
    for p in plans:
        assert run_plan(sales[1], p).rows.count() > 0
