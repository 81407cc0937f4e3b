"""Query plans over tickets opened every 53 hours, with pandas as the measure."""

import datetime as dt

import pandas as pd
import pytest

from quillgrid.errors import PlanError
from quillgrid.plans.model import Filter, Metric, QueryPlan
from quillgrid.plans.run import run_plan

FEE = Metric("fee")


@pytest.fixture(scope="module")
def tickets(spark):
    return spark.range(40).selectExpr(
        "id as ticket",
        "timestamp_ntz'2023-11-06 00:00:00' + make_dt_interval(0, cast(id * 53 as int)) as opened",
        "element_at(array('Ghent', 'Oslo', 'Turin'), cast(id * id % 7 % 3 as int) + 1) as branch",
        "id * id * 7 % 31 + 0.25D as fee",
        "cast(id % 6 as int) as copies",
    )


@pytest.fixture(scope="module")
def pdf(tickets):
    return tickets.toPandas()


def cells(result):
    return [tuple(r) for r in result.rows.collect()]


def test_all_groups_by_falling_first_metric(tickets, pdf):
    result = run_plan(tickets, QueryPlan("aggregate", [FEE, Metric("fee", "count")], group_by=["branch"]))
    expected = pdf.groupby("branch")["fee"].agg(["sum", "count"]).reset_index()
    expected = expected.sort_values(["sum", "branch"], ascending=[False, True])
    assert cells(result) == [tuple(r) for r in expected.itertuples(index=False)]
    assert tuple(result.summary.first()) == (3, 3)


@pytest.mark.parametrize("agg", ["sum", "mean", "median", "min", "max", "count", "nunique"])
def test_each_aggregate(tickets, pdf, agg):
    assert cells(run_plan(tickets, QueryPlan("aggregate", [Metric("fee", agg)])))[0][0] == pytest.approx(pdf["fee"].agg(agg))


def test_sums_of_doubles_are_steady(spark):
    cents = spark.range(200_000).selectExpr("cast(250000 + id % 977 + (id % 100) / 100 as double) as v")
    plan = QueryPlan("aggregate", [Metric("v"), Metric("v", "mean")])
    expected = sum(25_000_000 + (i % 977) * 100 + i % 100 for i in range(200_000)) / 100
    for parts in (1, 7):
        assert cells(run_plan(cents.repartition(parts), plan))[0] == (expected, round(expected / 200_000, 4))
    odd = spark.createDataFrame([(1.5,), (float("inf"),), (None,), (float("nan"),)], "v double")
    assert cells(run_plan(odd, QueryPlan("aggregate", [Metric("v")]))) == [(float("inf"),)]


def test_nothing_left(tickets):
    plan = QueryPlan("aggregate", [FEE, Metric("fee", "max")], filters=[Filter("ticket", "lt", 0)])
    assert cells(run_plan(tickets, plan)) == [(0.0, None)]


def test_months_and_chosen_weeks(tickets, pdf):
    monthly = run_plan(tickets, QueryPlan("trend", [FEE], date_column="opened", frequency="ME"))
    expected = pdf.set_index("opened")["fee"].resample("ME").sum()
    assert cells(monthly) == [(p.date(), v) for p, v in expected.items()]
    chosen = run_plan(tickets, QueryPlan("trend", [FEE], date_column="opened"))
    assert chosen.notes == {"frequency": "W"}
    assert [p for p, _ in cells(chosen)] == [p.date() for p in pdf.set_index("opened")["fee"].resample("W").sum().index]


@pytest.mark.parametrize(("agg", "empty"), [("sum", 0.0), ("count", 0), ("nunique", 0), ("mean", None), ("median", None)])
def test_days_without_rows(tickets, pdf, agg, empty):
    found = dict(cells(run_plan(tickets, QueryPlan("trend", [Metric("fee", agg)], date_column="opened", frequency="D"))))
    used = set(pdf["opened"].dt.date)
    days = pd.date_range(min(used), max(used)).date
    assert list(found) == list(days) and len(days) > len(used)
    assert {found[d] for d in days if d not in used} == {empty}


def test_trend_returns_every_period(spark):
    years = spark.range(900).selectExpr("date_add(date'2020-01-01', cast(id as int)) as d", "id as v")
    assert run_plan(years, QueryPlan("trend", [Metric("v")], date_column="d", frequency="D")).rows.count() == 900


def test_periods_side_by_side(tickets, pdf):
    spans = ["2023-11-10", "2023-11-30"], ["2023-12-01", "2024-01-05"]
    plan = QueryPlan("compare_periods", [FEE], date_column="opened", period_a=spans[0], period_b=spans[1])
    result, by_day = run_plan(tickets, plan), pdf.set_index("opened")["fee"]
    a, b = (by_day.loc[low:high].sum() for low, high in spans)
    assert [v for _, v in cells(result)] == [a, b]
    assert result.summary.first()[0] == round((b - a) / a * 100, 2)
    before = QueryPlan("compare_periods", [FEE], date_column="opened", period_a=["2001-01-01", "2001-12-31"], period_b=spans[1])
    assert run_plan(tickets, before).summary.first()[0] is None


def test_last_day_ends_before_midnight(spark):
    late = spark.sql("select timestamp_ntz'2024-02-29 23:59:59' as at, 4.0D as v union all select timestamp_ntz'2024-03-01 00:00:00', 9.0D")
    plan = QueryPlan("compare_periods", [Metric("v")], date_column="at", period_a=["2024-02-01", "2024-02-29"], period_b=["2024-03-01"] * 2)
    assert [v for _, v in cells(run_plan(late, plan))] == [4.0, 9.0]


MIDDAY = "2023-11-17 01:00:00"  # when ticket 5 was opened
FILTERS = {
    "day": (Filter("opened", "eq", "2023-11-17"), lambda p: p.opened.dt.date == dt.date(2023, 11, 17)),
    "date object": (Filter("opened", "eq", dt.date(2023, 11, 17)), lambda p: p.ticket == 5),
    "moment": (Filter("opened", "eq", MIDDAY), lambda p: p.ticket == 5),
    "other moment": (Filter("opened", "eq", "2023-11-17 00:00:00"), lambda p: p.ticket < 0),
    "not a date": (Filter("opened", "eq", "soon"), lambda p: p.ticket < 0),
    "other days": (Filter("opened", "ne", "2023-11-17"), lambda p: p.ticket != 5),
    "not soon": (Filter("opened", "ne", "soon"), lambda p: p.ticket >= 0),
    "days": (Filter("opened", "in", ["2023-11-06", MIDDAY, "never"]), lambda p: p.ticket.isin([0, 5])),
    "no days": (Filter("opened", "in", []), lambda p: p.ticket < 0),
    "from day": (Filter("opened", "gt", "2024-01-02"), lambda p: p.opened > "2024-01-02"),
    "number as text": (Filter("copies", "eq", "4"), lambda p: p.copies == 4),
    "half": (Filter("copies", "lte", 2.5), lambda p: p.copies <= 2),
    "range": (Filter("fee", "between", [7.25, "19"]), lambda p: p.fee.between(7.25, 19)),
    "names": (Filter("branch", "in", ["Oslo", "Bergen"]), lambda p: p.branch == "Oslo"),
    "other names": (Filter("branch", "ne", "Oslo"), lambda p: p.branch != "Oslo"),
    "exact case": (Filter("branch", "eq", "oslo"), lambda p: p.ticket < 0),
    "pattern": (Filter("branch", "contains", "^(GH|tu)"), lambda p: p.branch != "Oslo"),
    "plain text": (Filter("branch", "contains", "^gh", literal=True), lambda p: p.ticket < 0),
}


@pytest.mark.parametrize("name", FILTERS)
def test_filters(tickets, pdf, name):
    test, expected = FILTERS[name]
    result = run_plan(tickets, QueryPlan("filter_rows", filters=[test]))
    kept = pdf.loc[expected(pdf), "ticket"].to_list()
    assert sorted(r["ticket"] for r in result.rows.collect()) == kept
    assert result.summary.first()[0] == len(kept)


def test_dates_are_labels_without_a_time(spark, tickets):
    days = spark.sql("select timestamp_ntz'2024-05-01 00:00:00' as a, date'2024-05-02' as b, 1 as v union all select null, null, 2")
    for name, label in (("a", "2024-05-01"), ("b", "2024-05-02")):
        plan = QueryPlan("aggregate", [Metric("v")], group_by=[name])
        assert cells(run_plan(days, plan)) == [("(missing)", 2), (label, 1)]
    assert [r["b"] for r in run_plan(days, QueryPlan("filter_rows", filters=[Filter("b", "eq", "2024-05-02")])).rows.collect()] == [dt.date(2024, 5, 2)]
    timed = run_plan(tickets, QueryPlan("aggregate", [FEE], group_by=["opened"])).rows.collect()
    assert len(timed) == 40 and MIDDAY in {r["opened"] for r in timed}


def test_missing_and_nan_in_filters(spark):
    odd = spark.createDataFrame([(1.0, "a"), (None, None), (float("nan"), "b")], "v double, t string")

    def count(test):
        return run_plan(odd, QueryPlan("filter_rows", filters=[test])).summary.first()[0]

    assert count(Filter("v", "gt", 0)) == 1  # NaN is not a large number
    assert count(Filter("v", "ne", 1)) == 2  # stored numbers: missing differs
    assert count(Filter("t", "ne", "a")) == 1  # text: missing is left out


def test_describe(tickets, pdf):
    found = {r["column"]: r for r in run_plan(tickets, QueryPlan("describe", columns=["fee", "branch"])).rows.collect()}
    assert found["fee"]["mean"] == round(pdf["fee"].mean(), 4) and found["fee"]["unique"] is None
    assert (found["branch"]["count"], found["branch"]["unique"], found["branch"]["top"]) == (40, 3, pdf["branch"].mode()[0])


def test_correlate(tickets, pdf):
    result = run_plan(tickets, QueryPlan("correlate", columns=["fee", "copies"]))
    assert result.summary.first()["pearson_r"] == pytest.approx(pdf["fee"].corr(pdf["copies"]), abs=1e-4)
    flat = tickets.selectExpr("fee", "1 as one")
    assert run_plan(flat, QueryPlan("correlate", columns=["fee", "one"])).summary.first()[0] is None


def test_limits_are_what_was_asked_for(spark):
    wide = spark.range(500).selectExpr("concat('g', id) as g", "cast(id as double) as v")
    by_group = {"metrics": [Metric("v")], "group_by": ["g"]}
    assert run_plan(wide, QueryPlan("aggregate", **by_group)).rows.count() == 500
    assert run_plan(wide, QueryPlan("top_n", **by_group)).rows.count() == 10
    assert run_plan(wide, QueryPlan("top_n", limit=300, **by_group)).rows.count() == 300
    assert run_plan(wide, QueryPlan("filter_rows")).rows.count() == 500
    assert cells(run_plan(wide, QueryPlan("filter_rows", limit=2))) == [("g0", 0.0), ("g1", 1.0)]


def test_approximate_aggregates(spark):
    frame = spark.range(20_000).selectExpr("id % 3 as g", "cast(id as double) as v")
    plan = QueryPlan("aggregate", [Metric("v", "median"), Metric("v", "nunique")], group_by=["g"])
    for exact, rough in zip(*[sorted(cells(run_plan(frame, plan, a))) for a in (False, True)]):
        assert rough[0] == exact[0] and rough[1:] == pytest.approx(exact[1:], rel=0.1)


REFUSED = {
    "no metric": QueryPlan("top_n", group_by=["branch"]),
    "unknown column": QueryPlan("describe", columns=["fees"]),
    "another case": QueryPlan("aggregate", [Metric("FEE")]),
    "unknown aggregate": QueryPlan("aggregate", [Metric("fee", "p99")]),
    "unknown operation": QueryPlan("explode"),
    "trend without date": QueryPlan("trend", [FEE]),
    "one period": QueryPlan("compare_periods", [FEE], date_column="opened", period_a=["2024-01-01", "2024-01-02"]),
    "nothing to describe": QueryPlan("describe"),
    "three columns": QueryPlan("correlate", columns=["fee", "copies", "ticket"]),
    "no rows wanted": QueryPlan("filter_rows", limit=0),
    "open range": QueryPlan("filter_rows", filters=[Filter("fee", "between", [1])]),
    "unknown filter": QueryPlan("filter_rows", filters=[Filter("fee", "like", 1)]),
}


@pytest.mark.parametrize("name", REFUSED)
def test_refused_before_any_job(tickets, name):
    with pytest.raises(PlanError):
        run_plan(tickets, REFUSED[name])


def test_plan_from_dict(tickets, pdf):
    plan = QueryPlan.from_dict({"operation": "top_n", "metrics": [{"column": "fee"}], "group_by": ["branch"], "limit": 1,
                                "filters": [{"column": "copies", "op": "gte", "value": 3}], "note": "ignored"})
    sums = pdf[pdf["copies"] >= 3].groupby("branch")["fee"].sum()
    assert cells(run_plan(tickets, plan)) == [(sums.idxmax(), sums.max())]


def test_filters_reach_the_scan(spark, tickets, tmp_path, capsys):
    tickets.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    tests = [Filter("opened", "eq", "2023-11-17"), Filter("copies", "gt", 1), Filter("fee", "gt", 10)]
    run_plan(stored, QueryPlan("aggregate", [FEE], filters=tests)).rows.explain("formatted")
    text = capsys.readouterr().out
    pushed = next(line for line in text.splitlines() if line.startswith("PushedFilters"))
    for part in ("GreaterThanOrEqual(opened", "LessThan(opened", "GreaterThan(copies,1)", "GreaterThan(fee,10.0)"):
        assert part in pushed
    schema = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "branch" not in schema
