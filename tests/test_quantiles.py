"""Exact percentiles and ranks against brute force, on skewed data and small limits."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.operators.quantiles import column_quantiles, first_bucket, grouped_quantiles
from quillgrid.operators.ranks import pearson_pairs, spearman_pairs

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows in one group; in it, a third share one value."""
    rng = np.random.default_rng(3)
    n = 6_000
    group = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(np.arange(n) % 9 == 0, 7.5, np.round(rng.gamma(2.0, 30.0, n), 3))
    value[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"g": group, "v": value, "w": rng.integers(0, 5, n).astype(float)})


def frame_of(spark, pdf):
    return spark.createDataFrame(pdf).withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in pdf.select_dtypes("float").columns}
    )


@pytest.mark.parametrize(("per_power", "parts"), [(1, 3), (2, 64), (4_096, 65_536)])
def test_whole_columns(spark, skewed, per_power, parts):
    frame = frame_of(spark, skewed)
    columns = {"v": F.col("v"), "w": F.col("w"), "none": F.lit(None).cast("double")}
    found = column_quantiles(frame, columns, FRACTIONS, per_power, parts)
    for c in ("v", "w"):
        assert found[c] == pytest.approx(list(skewed[c].quantile(FRACTIONS)), abs=1e-9)
    assert found["none"] == [None] * len(FRACTIONS)


@pytest.mark.parametrize(("per_power", "parts"), [(1, 4), (4_096, 65_536)])
def test_groups(spark, skewed, per_power, parts):
    found = grouped_quantiles(frame_of(spark, skewed), ["g"], "v", FRACTIONS, per_power=per_power, parts=parts).collect()
    assert {r["g"]: r["values"] for r in found} == dict(skewed.groupby("g")["v"].count())
    expected = skewed.groupby("g")["v"].quantile(FRACTIONS).unstack()
    assert {r["g"] for r in found} == set(expected.index)
    for r in found:
        assert r["quantiles"] == pytest.approx(list(expected.loc[r["g"]]), abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_search_on_ties(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = column_quantiles(frame, {"v": F.col("v")}, [0.1, 0.5, 0.9], 1, 2)["v"]
    assert found == pytest.approx(list(pd.Series(values, dtype=float).quantile([0.1, 0.5, 0.9])))


def test_values_at_the_edges_of_doubles(spark):
    rng = np.random.default_rng(12)
    near = 1.75e9 * (1 + rng.integers(0, 50, 200) * 2.0**-52)  # one bucket of the first pass
    values = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 1.7e308, -1.7e308, 2.0**0.5, -1.0, *near]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    fractions = [i / 20 for i in range(21)]
    found = column_quantiles(frame, {"v": F.col("v")}, fractions, 16, 4)["v"]
    assert found == list(pd.Series(values).quantile(fractions))
    far = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, float("inf"), float("nan"))], "v double")
    lowest, highest = column_quantiles(far, {"v": F.col("v")}, [0.0, 1.0])["v"]
    assert lowest == float("-inf") and np.isnan(highest)


def test_first_buckets_keep_the_order(spark):
    rng = np.random.default_rng(13)
    values = np.sort(np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), 1 + np.arange(300) * 2.0**-52, [0.0]]))
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    marks = [r[0] for r in frame.orderBy("i").select(first_bucket(F.col("v"))).collect()]
    assert marks == sorted(marks)


@pytest.mark.parametrize("hot_share", [2, 10**6])
def test_correlations(spark, skewed, hot_share):
    pdf = skewed.assign(u=skewed["v"] * 2 + skewed["w"], k=1.0)[["v", "w", "u", "k"]]
    pdf.loc[::7, "w"] = np.nan
    frame = frame_of(spark, pdf)
    columns = {c: F.col(c) for c in pdf.columns}
    for method, found in (
        ("pearson", pearson_pairs(frame, columns)),
        ("spearman", spearman_pairs(frame, columns, hot_share)),
    ):
        expected = pdf.corr(method=method)
        for (a, b), r in found.items():
            if np.isnan(expected.loc[a, b]):
                assert r is None
            else:
                assert r == pytest.approx(expected.loc[a, b], abs=1e-9)


def test_correlations_of_many_columns(spark):
    names = [f"n{i}" for i in range(18)]  # 153 pairs: two passes
    frame = spark.range(300).select(
        *[F.when(F.col("id") % (11 + i) > 0, F.pmod(F.col("id") * 7, 17 + i)).cast("double").alias(n) for i, n in enumerate(names)]
    )
    pdf, columns = frame.toPandas(), {n: F.col(n) for n in names}
    for method, found in (("pearson", pearson_pairs(frame, columns)), ("spearman", spearman_pairs(frame, columns))):
        assert len(found) == 153
        for (a, b), r in found.items():
            assert r == pytest.approx(pdf[[a, b]].dropna().corr(method).iloc[0, 1], abs=1e-9)
