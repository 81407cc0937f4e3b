import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import health, ranks
from quillgrid.operators.inference import column_facts
from quillgrid.operators.isolation import isolation_outliers, tree_rows
from quillgrid.operators.profile import TableProfile, profile_table, read_once, smallest_texts, typed_columns
from quillgrid.operators.roles import pick_date_column, rank_dimensions, rank_metrics


def semantic(spark, values, name="col", kind="string"):
    frame = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    _, _, readings, _ = typed_columns(frame)
    return readings[0]


def mixture(readable, n, spell):
    """n texts, the first `readable` of them spelt so that they can be read, the others all different and not."""
    return [spell(i) if i < readable else f"~{i}~" for i in range(n)]


SPELLINGS = {
    "datetime": lambda i: f"{1990 + i % 30}-{1 + i % 12:02d}-{1 + i % 28:02d}",
    "numeric": lambda i: f"{i % 9},{i % 4}00.5%",
}


@pytest.mark.parametrize("target", SPELLINGS)
@pytest.mark.parametrize("readable", [79, 80, 99])
def test_text_is_read_where_four_fifths_can_be(spark, target, readable):
    found = semantic(spark, mixture(readable, 100, SPELLINGS[target]))
    if readable >= 80:
        assert (found.semantic, found.suggested, found.parse_pct) == (target, target, float(readable))
    else:
        assert found.suggested is None and found.semantic in ("text", "id")


@pytest.mark.parametrize("pair", [("y", "n"), ("1", "0"), ("TRUE", "False"), (" T ", "f")])
def test_two_boolean_tokens_make_a_boolean(spark, pair):
    assert semantic(spark, list(pair) * 3).semantic == "boolean"
    assert semantic(spark, [pair[0]] * 6).semantic != "boolean"
    assert semantic(spark, [*pair * 3, "perhaps"]).semantic != "boolean"


@pytest.mark.parametrize(("distinct", "of", "expected"), [(20, 100, "categorical"), (21, 100, "text"), (50, 1000, "categorical"), (51, 1000, "text")])
def test_few_different_texts_are_categories(spark, distinct, of, expected):
    assert semantic(spark, [f"~{i % distinct}~" for i in range(of)]).semantic == expected


@pytest.mark.parametrize(("distinct", "of", "name", "expected"), [
    (11, 20, "sku", "id"), (10, 20, "sku", "numeric"), (21, 21, "level", "id"), (20, 20, "level", "numeric"), (97, 100, "level", "numeric"),
])
def test_mostly_different_whole_numbers_are_ids(spark, distinct, of, name, expected):
    values = [1000 + i % distinct for i in range(of)]
    assert semantic(spark, values, name, "bigint").semantic == expected
    assert semantic(spark, [str(v) for v in values], name).semantic == expected


def test_stored_types_speak_for_themselves(spark):
    stored = {"timestamp_ntz": dt.datetime(2031, 5, 6), "boolean": True, "double": 0.25, "string": None}
    expected = {"timestamp_ntz": "datetime", "boolean": "boolean", "double": "numeric", "string": "text"}
    assert {kind: semantic(spark, [value] * 3, "stored", kind).semantic for kind, value in stored.items()} == expected


@pytest.fixture(scope="module")
def messy(spark):
    rng = np.random.default_rng(11)
    n = 300
    value = np.round(rng.normal(50, 5, n), 2)
    value[:3] = [5000, -4000, 4500]
    pdf = pd.DataFrame(
        {
            "ticket_id": np.arange(n) + 900_000,
            "amount": value,
            "twice": value * 2 + 1,
            "fixed": 3.0,
            "gap": np.where(np.arange(n) % 2 == 0, None, "x"),
            "sold": [f"{d:%Y-%m-%d}" for d in pd.date_range("2026-01-01", periods=n)],
            "region": rng.choice(["N", "S", "E"], n),
        }
    )
    return pd.concat([pdf, pdf.iloc[:6]], ignore_index=True)


@pytest.fixture(scope="module")
def profile(spark, messy):
    return profile_table(spark.createDataFrame(messy))


def test_counts(profile, messy):
    assert profile.row_count == 306
    assert profile.duplicate_row_count == 6 == int(messy.duplicated().sum())
    assert profile.column("gap").missing_count == int(messy["gap"].isna().sum())
    assert profile.column("region").unique_count == 3
    assert profile.column("region").samples == ["E", "N", "S"]
    assert profile.column("fixed").is_constant
    assert profile.column("ticket_id").semantic_type == "id"
    assert profile.column("sold").dates[0] == 306


def test_numeric_stats(profile, messy):
    s, x = profile.column("amount").measures, messy["amount"]
    expected = [x.mean(), x.median(), x.std(), x.min(), x.max(), x.quantile(0.25), x.quantile(0.75), x.skew()]
    found = [s[m] for m in ("mean", "median", "std", "min", "max", "q1", "q3", "skew")]
    assert found == pytest.approx(expected, abs=1e-3)
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    fence = ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
    assert profile.column("amount").outliers["iqr"] == fence
    assert profile.column("amount").outliers["zscore"] == int((((x - x.mean()) / x.std()).abs() > 3).sum())


def test_correlations(profile):
    r = {(m, a, b): v for m, a, b, v in profile.correlations}
    assert r[("pearson", "amount", "twice")] == 1.0
    assert r[("spearman", "twice", "amount")] == 1.0
    assert r[("pearson", "amount", "fixed")] is None
    assert r[("pearson", "fixed", "fixed")] is None


def test_health(spark, profile):
    kinds = {i["kind"] for i in profile.issues}
    assert kinds == {"missing_values", "duplicate_rows", "wrong_type", "outliers", "constant_column"}
    assert 0 < profile.health_score < 100
    assert health.health_score(profile.issues_frame(spark), 0).first()[0] == 0


def test_family_caps(spark):
    schema = "kind string, penalty double"
    issues = spark.createDataFrame([("missing_values", 12.0)] * 5 + [("wrong_type", 5.0)] * 4, schema)
    assert health.health_score(issues, 10).first()[0] == 100 - 30 - 15


def test_json_round_trip(profile):
    assert TableProfile.from_json(profile.to_json()) == profile


def test_roles(profile):
    assert rank_metrics(profile) == ["amount", "twice"]
    assert pick_date_column(profile) == "sold"
    assert rank_dimensions(profile) == ["region"]


def test_isolation_finds_the_far_point(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(0, 1, (400, 2))
    rows = [tuple(map(float, r)) for r in near]
    frame = spark.createDataFrame(rows + [(40.0, -40.0)], "a double, b double")
    columns = {"a": F.col("a"), "b": F.col("b")}
    far = isolation_outliers(frame, columns)
    assert 1 <= far < 200
    assert isolation_outliers(frame.limit(20), columns) == 0
    assert isolation_outliers(frame, {"a": F.col("a")}) == 0


@pytest.mark.parametrize("rows", [60, 3_000, 200_000])
def test_trees_draw_from_all_rows(spark, rows):
    points = spark.range(rows).select(F.col("id").cast("double").alias("x0"))
    drawn = tree_rows(points, rows).toPandas()
    sizes = drawn.groupby("tree")["x0"].agg(["count", "nunique"])
    assert len(sizes) == 100 and (sizes == min(rows, 256)).all(axis=None)
    assert drawn["x0"].nunique() >= min(rows, 20_000) * 0.9 and drawn["x0"].max() > 0.99 * (rows - 1)


def test_awkward_column_names(spark):
    frame = spark.createDataFrame([(i, f"${i}.5", "ab"[i % 2]) for i in range(40)] * 2, "`k.id` int, `unit price ($)` string, `a``b` string")
    p = profile_table(frame)
    assert [c.semantic_type for c in p.columns] == ["numeric", "numeric", "categorical"]
    assert p.duplicate_row_count == 40 and rank_dimensions(p) == ["a`b"]


def test_sketched_distinct_counts(spark):
    frame = spark.range(30_000).selectExpr("concat('v', id % 9000) as t", "cast(null as string) as gone")
    _, facts, _, _ = typed_columns(frame, approximate=True)
    assert facts[0].distinct == pytest.approx(9000, rel=0.05) and facts[1].distinct == 0


def test_types_counts_and_samples_of_odd_values(spark):
    """Against the facts counted row by row: gaps, NaN, both zeros, equal numbers spelt apart, dates and moments."""
    rows = [
        ("a" if i % 7 else None, f"{i % 5}.{'0' * (i % 3)}", ["-0.0", "0", "1e999", "", "x"][i % 5], [0.0, -0.0, float("nan"), 1.5][i % 4],
         2**53 + i % 2, dt.date(2031, 5, 1 + i % 9), dt.datetime(2031, 5, 6, 7, 8, 9, i % 11), ["t", " T", None, "F"][i % 4])
        for i in range(200)
    ]
    frame = spark.createDataFrame(rows, "a string, b string, c string, d double, e bigint, f date, g timestamp_ntz, h string")
    total, facts, _, samples = typed_columns(frame)
    by_row = column_facts(frame)
    assert total == by_row[0] == 200
    assert [(f.present, f.numbers, f.moments, f.whole, f.boolean_tokens) for f in facts] == [
        (f.present, f.numbers, f.moments, f.whole, f.boolean_tokens) for f in by_row[1]
    ]
    assert [f.distinct for f in facts] == [1, 15, 5, 2, 2, 9, 11, 3]
    assert facts[1].distinct_numbers == 5
    assert samples["d"] == ["0.0", "1.5"] and samples["e"] == [str(2**53), str(2**53 + 1)]
    assert samples["f"] == [f"2031-05-0{k}" for k in range(1, 6)]


def test_samples_are_the_smallest_of_all_rows_not_of_the_first(spark):
    frame = spark.range(30_000, numPartitions=3).select(F.lpad((29_999 - F.col("id")).cast("string"), 5, "0").alias("v"))
    assert smallest_texts(frame) == {"v": [f"0000{k}" for k in range(5)]}


def test_text_is_parsed_once_for_all_later_passes(spark):
    frame = spark.createDataFrame([(f"${i},000", "2031-05-06", i) for i in range(20)], "price string, day string, n int")
    read, numbers, moments = read_once(frame, ["price", "n"], ["day"])
    plan = read.select(*numbers.values(), *moments.values())._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "RLIKE" not in plan.upper()
    assert read.agg(F.sum(numbers["price"]), F.sum(numbers["n"]), F.count_distinct(moments["day"])).first()[:] == (190_000.0, 190, 1)
    assert read_once(frame, ["n"], [])[0].inputFiles() == frame.inputFiles()


def test_ranks_of_complete_columns_need_sums_alone(spark, monkeypatch):
    """Their mean is known, so no pair needs deviations of its own; constants still have no coefficient."""
    monkeypatch.setattr(ranks, "pearson", None)
    pdf = pd.DataFrame({"a": [(7 * i) % 31 for i in range(90)], "b": [i // 4 for i in range(90)], "c": [5] * 90})
    found = ranks.spearman_pairs(spark.createDataFrame(pdf), {n: F.col(n) for n in "abc"})
    assert found[("a", "b")] == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()), abs=1e-12)
    assert found[("a", "c")] is None and found[("b", "c")] is None
