"""Malformed and unusual files, and stored versions."""

import csv
import io
import random
from urllib.parse import unquote

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillgrid.errors import TableError
from quillgrid.operators.cleaning import Step, clean
from quillgrid.operators.ledger import budget_rollup, with_cost
from quillgrid.operators.profile import profile_table
from quillgrid.sources.delimited import audit_files, read_delimited, repair_names, write_csv
from quillgrid.sources.records import lines_of
from quillgrid.sources.versions import VersionStore


@pytest.fixture
def load(spark, tmp_path):
    def read(content, name="t.csv", encoding="utf-8", **options):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
        return read_delimited(spark, str(path), **options)

    return read


def cells(frame):
    return [tuple(r) for r in frame.collect()]


def test_types_come_from_the_whole_column(load):
    frame = load("id,day,share,ok,note\n1,2026-01-05,1.5,True,x\n2,2026-01-06,2,False,\n")
    assert [t for _, t in frame.dtypes] == ["bigint", "string", "double", "boolean", "string"]
    assert cells(frame)[1] == (2, "2026-01-06", 2.0, False, None)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(load, sep):
    rows = ["id", "name", "value"], ["1", "Alpha", "10"], ["2", "Beta", "20"], ["3", "Gamma", "30"]
    frame = load("\n".join(sep.join(r) for r in rows) + "\n")
    assert frame.columns == ["id", "name", "value"] and frame.count() == 3


def test_quotes_and_embedded_line_break(load):
    frame = load('id,company,note\n1,"Acme, Inc.","two\nlines"\n2,"The ""Co""",plain\n')
    assert cells(frame) == [(1, "Acme, Inc.", "two\nlines"), (2, 'The "Co"', "plain")]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "latin-1"])
def test_encodings(load, encoding):
    frame = load("id,città,wert\n1,Müller,10\n2,Größe,20\n", encoding=encoding)
    assert cells(frame) == [(1, "Müller", 10), (2, "Größe", 20)]
    assert frame.columns[1] == "città"


def test_windows_line_ends(load):
    assert cells(load(b"a,b\r\n1,x\r\n2,y\r\n")) == [(1, "x"), (2, "y")]
    assert cells(load("a,b\r\n1,x\r\n2,y\r\n", encoding="utf-16", name="w.csv")) == [(1, "x"), (2, "y")]


def test_wide_encoding_with_embedded_line_break(load):
    text = 'a,b\n1,"x\ny"\n2,"z, ""w"""\n'
    for encoding in ("utf-16", "utf-16-be"):
        assert cells(load(text, encoding=encoding, name=f"{encoding}.csv")) == [(1, "x\ny"), (2, 'z, "w"')]


def test_bytes_after_the_head_decide_the_encoding(spark, tmp_path):
    plain = "id,name\n" + "".join(f"{i},plain letters\n" for i in range(6000))
    (tmp_path / "late one.csv").write_bytes((plain + "6000,café\n").encode("latin-1"))
    (tmp_path / "other.csv").write_bytes((plain + "6001,naïve \ufffd\n").encode())
    found = read_delimited(spark, str(tmp_path / "*.csv"))
    assert found.count() == 12_002
    assert {tuple(r) for r in found.where("id >= 6000").collect()} == {(6000, "café"), (6001, "naïve \ufffd")}


def test_ragged_and_blank_lines(load):
    frame = load('a,b,c\n1,2,3\n\n4,5\n6,7,8,9\n"x,y",1,2\n   \n')
    assert [r[0] for r in cells(frame)] == ["1", "4", "x,y"]
    assert cells(frame)[1][2] is None


def test_empty_rows_then_empty_columns_are_dropped(load):
    frame = load("a,b,c\n1,,NA\n,,\nnull,N/A,\n2,,nan\n")
    assert frame.columns == ["a"] and cells(frame) == [(1,), (2,)]


def test_names():
    assert repair_names(["id", "value", "value", " Value ", ""]) == ["id", "value", "value_1", "Value_2", "column_5"]
    assert repair_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]


def test_duplicate_headers(load):
    frame = load("id,value,value,Value ,\n1,10,20,30,x\n2,11,21,31,y\n")
    assert len({c.lower() for c in frame.columns}) == 5 and cells(frame)[0] == (1, 10, 20, 30, "x")


@pytest.mark.parametrize(("content", "name"), [("", "e.csv"), ("a,b,c\n", "h.csv"), ("a\n1\n", "x.pdf")])
def test_refused_files(load, content, name):
    with pytest.raises(TableError):
        load(content, name)


def test_size_limit_is_strict(spark, load, tmp_path):
    load("a\n1\n", max_bytes=4)
    with pytest.raises(TableError):
        load("a\n1\n", max_bytes=3)
    (tmp_path / "note.txt").write_text("x")
    reasons = {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in audit_files(spark, str(tmp_path), 3).collect()}
    assert reasons == {"t.csv": "too large", "note.txt": "extension"}


def test_files_of_different_layout_are_one_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "b.csv").write_bytes("id;name\n3;ü\n4;w\n".encode("latin-1"))
    frame = read_delimited(spark, str(tmp_path / "*.csv"))
    assert sorted(cells(frame)) == [(1, "x"), (2, "y"), (3, "ü"), (4, "w")]


def test_export_and_read_back(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'say "hi", all'), (2, None)], "k bigint, t string")
    write_csv(frame, str(tmp_path / "out"))
    assert sorted(cells(read_delimited(spark, str(tmp_path / "out" / "*.csv")))) == [(1, 'say "hi", all'), (2, None)]


def test_versions(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame([(1, [1, 2]), (1, [1, 2])], "k bigint, tags array<int>")
    with pytest.raises(TableError):
        store.read("p")
    store.write_raw("p", frame)
    assert dict(store.read("p").dtypes) == {"k": "bigint", "tags": "string"}
    with pytest.raises(AnalysisException):
        store.write_raw("p", frame)
    for _ in range(2):
        cleaned = clean(store.read("p", "raw"), [Step("deduplicate")])
        store.write_cleaned("p", cleaned.frame)
    assert store.read("p").count() == 1 and store.read("p", "raw").count() == 2
    store.append_log("p", 2, cleaned)
    store.append_log("p", 1, cleaned)
    assert [r["run"] for r in store.read_log("p").collect()] == [1, 2]
    store.append_log("p", 1, cleaned)  # a run that is written again replaces itself
    assert store.read_log("p").count() == 2
    broken = store.read("p").select("k", F.raise_error(F.lit("stop")).cast("string").alias("tags"))
    with pytest.raises(Exception, match="stop"):
        store.write_cleaned("p", broken)
    assert store.read("p").count() == 1 and store.best_kind("p") == "cleaned"
    profile = profile_table(store.read("p"))
    store.write_profile("p", "cleaned", profile)
    assert store.read_profile("p", "cleaned") == profile and store.read_profile("p") is None


def test_costs(spark):
    usage = spark.createDataFrame(
        [("p", "gpt-4o-mini", 1_000_000, 500_000), ("p", "other", 1_000_000, 0), ("q", "gpt-4.1", 1, 0)],
        "project_id string, model string, prompt_tokens bigint, completion_tokens bigint",
    )
    costs = with_cost(usage)
    assert sorted(r["cost_usd"] for r in costs.collect()) == [0.000002, 0.45, 2.5]
    spent = {r["project_id"]: r for r in budget_rollup(costs, 2.95).collect()}
    assert spent["p"]["budget_exhausted"] and not spent["q"]["budget_exhausted"]
    assert not any(r["budget_exhausted"] for r in budget_rollup(costs, 0).collect())


def test_streamed_totals_equal_batch(spark, tmp_path):
    from quillgrid.streaming.arrivals import keep_table, running_totals

    rows = spark.range(200).selectExpr("timestampadd(HOUR, cast(id as int), timestamp_ntz'2026-01-01') as ts", "cast(id % 7 as double) as v")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    totals = running_totals(stream, "ts", F.col("v"), "D", late="30 days")
    keep_table(totals, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = sorted(cells(spark.read.parquet(str(tmp_path / "out"))))
    expected = rows.groupBy(F.col("ts").cast("date")).agg(F.count("*"), F.sum("v"))
    assert found == sorted(cells(expected))


def test_project_from_file_to_forecast(spark, tmp_path):
    from quillgrid.errors import ForecastError
    from quillgrid.operators.suggest import accepted_steps
    from quillgrid.sources.projects import Project

    lines = ["order_id,sold_on,region,revenue"]
    for i in range(500):
        day = f"2025-{1 + i % 12:02d}-{1 + i % 28:02d}" if i % 50 else "unknown"
        lines.append(f"{i},{day},{'NSEW'[i % 4] if i % 9 else ''},\"${1000 + i * 7 % 400:,}.25\"")
    lines += lines[5:15]
    (tmp_path / "sales.csv").write_text("\n".join(lines))
    project = Project(VersionStore(spark, str(tmp_path / "store")), "sales")
    assert project.ingest(str(tmp_path / "sales.csv")).count() == 510
    assert project.profile() == project.profile()
    comparison = project.clean(accepted_steps(project.suggestions()), run=1)
    after = {r["measure"]: (r["before"], r["after"]) for r in comparison.collect()}
    assert (after["rows"][1], after["duplicate_rows"][1]) == (500, 0) and after["health"][1] > after["health"][0]
    assert project.store.read_log("sales").count() > 2
    assert project.facts().first()["metric"] == "revenue" and project.facts().count() == 1
    made = project.forecast("revenue", 4, run=1)
    assert made.forecast.count() == 4 == project.store.read_forecasts().count()
    with pytest.raises(ForecastError):
        project.forecast("region", 4, run=2)
    stored = project.store.read_forecasts().first()
    assert (stored["project"], stored["run"], stored["metric"], stored["horizon"], stored["series"]) == ("sales", 1, "revenue", 4, {})
    assert stored["frequency"] and stored["model"] and stored["backtest_mape"] is not None
    project.forecast("revenue", 4, run=1)
    assert project.store.read_forecasts().count() == 4
    assert {n: project.store.read_facts(n).count() > 0 for n in ("overview", "segments")} == {"overview": True, "segments": True}
    other = Project(project.store, "second")
    with pytest.raises(TableError, match="quota"):
        other.ingest(str(tmp_path / "sales.csv"), quota_bytes=project.store.stored_bytes() + 10)
    assert other.ingest(str(tmp_path / "sales.csv"), quota_bytes=10**9).count() == 510
    project.export(str(tmp_path / "out"))
    assert read_delimited(spark, str(tmp_path / "out" / "*.csv")).count() == 500


def test_scratch_folder():
    from types import SimpleNamespace

    from quillgrid.sources.scratch import scratch_root

    def root(**conf):
        return scratch_root(SimpleNamespace(conf={k.replace("_", "."): v for k, v in conf.items()}))

    assert root(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn") == "hdfs://x/y"
    assert root(spark_master="local[2]", spark_app_id="t") == root(spark_master="local[2]", spark_app_id="t")
    with pytest.raises(RuntimeError):
        root(spark_master="yarn")


def test_rows_are_judged_by_their_field_count(load):
    """Surplus fields count even where they are empty, and short rows with quoted delimiters are no long ones."""
    frame = load('a,b,c\n1,2,3\n2,3,4,,x\n3,4,5,\n4,"5,6"\n"7,""8""",\n9,5" disk,1\n9,5" disk,1,2\n')
    assert cells(frame) == [("1", "2", 3), ("4", "5,6", None), ('7,"8"', None, None), ("9", '5" disk', 1)]


def test_empty_files_are_named(spark, load, tmp_path):
    (tmp_path / "none here.csv").write_text("")
    (tmp_path / "some.csv").write_text("a\n1\n")
    reasons = {r["path"].rsplit("/", 1)[1]: r["reject_reason"] for r in audit_files(spark, str(tmp_path)).collect()}
    assert {unquote(k): v for k, v in reasons.items()} == {"none here.csv": "empty", "some.csv": None}
    with pytest.raises(TableError, match="empty"):
        read_delimited(spark, str(tmp_path))


def test_old_line_ends(load):
    assert cells(load(b"a,b\r1,x\r2,y\r")) == [(1, "x"), (2, "y")]


def test_a_field_that_is_never_closed(load):
    with pytest.raises(TableError, match="never closed"):
        load('a,b\n1,"x\n2,y\n')


@pytest.mark.parametrize("encoding", ["utf-8-sig", "latin-1", "utf-16-le"])
def test_records_over_many_splits(spark, tmp_path, encoding, split=100):
    """Fields with line breaks, doubled quotes, delimiters and stray quotes, in splits smaller than a record."""
    rng = random.Random(split)
    rows = []
    for i in range(50):
        pieces = ["x", "é", "\n", "\r\n", '"', ",", "\n\n", "yy", " "]
        note = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 4, 12, 150])))
        rows.append((i, f"{note}.", rng.choice(["plain", '5" disk', 'a"b"'])))
    text = '"id","the\nnote",other\n'
    for i, note, other in rows:
        quoted = '"' + note.replace('"', '""') + '"'
        text += f"{i},{quoted},{other}" + rng.choice(["", "", ",surplus", ',"sur\nplus"']) + rng.choice(["\n", "\r\n", "\n\n"])
    (tmp_path / "t.csv").write_bytes(text.encode(encoding))
    expected = list(csv.reader(io.StringIO(text, newline="")))[1:]
    expected = {(int(r[0]), r[1], r[2]) for r in expected if len(r) == 3}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        frame = read_delimited(spark, str(tmp_path / "t.csv"))
        assert frame.columns == ["id", "the\nnote", "other"]
        assert lines_of(spark, [str(tmp_path / "t.csv")], "UTF-8", "\n").select("block").distinct().count() > 15
        found = cells(frame)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == len(expected) and set(found) == expected
