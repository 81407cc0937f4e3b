"""The whole pipeline over small tables: nulls, empties, repeated ids, clashing names, no rows."""

import numpy as np
import pytest

pytest.importorskip("quillgrid.llm")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, row string, document long, id string, mark string"


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{int(x)}" for x in rng.integers(0, vocabulary, n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(40)
    texts = []
    for i in range(240):
        words = prose(rng, int(rng.integers(30, 90))).split()
        for place in rng.integers(0, len(words), 5 if i % 4 == 0 else 0):
            words[place] = ["vile", "rotten", "foul"][int(rng.integers(0, 3))]
        texts.append((i, " ".join(words)))
    base, passage = prose(rng, 120), prose(rng, 70)
    texts += [(300 + i, base + f" end{i}") for i in range(8)]
    texts += [(320 + i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for i in range(4)]
    texts += [(340, prose(rng, 50)), (340, prose(rng, 50)), (341, None), (342, ""), (343, " \n"), (None, prose(rng, 40)), (None, None)]
    texts += [(344, prose(rng, 40))] * 2
    rows = [(i, t, ["en", "de", None][n % 3], f"src{n % 5}", len(t or ""), "a", "b", n, "c", "d") for n, (i, t) in enumerate(texts)]
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return folder, texts, base, passage


def test_stage_by_stage(spark, tables):
    folder, texts, base, passage = tables
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, str(folder)).cache()
        kept.append((name, docs.collect()))
        assert docs.columns == columns or name == "encoding"
    toxic, near, repeats, mixed, encoded = (rows for _, rows in kept)
    passed = [r["doc_id"] for r in toxic]
    assert sum(i in passed for i in range(0, 240, 4)) <= 6 and all(i in passed for i in range(240) if i % 4)
    assert len(toxic) - sum(i in passed for i in range(0, 240, 4)) == len(texts) - 60
    assert [r["doc_id"] for r in near if r["text"] and base in r["text"]] == [300]
    assert sum(r["doc_id"] == 340 for r in near) == 2 and sum(r["doc_id"] == 344 for r in near) == 1
    assert sum(r["doc_id"] is None for r in near) == 2
    assert sum(passage in (r["text"] or "") for r in repeats) == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in repeats)
    tokens = [sum(len((r["text"] or "").split()) for r in rows) for rows in (repeats, mixed)]
    assert 0.6 * tokens[0] <= tokens[1] < tokens[0]  # the last text of a source is drawn whole
    assert sorted(str(r["doc_id"]) for r in mixed) == sorted(str(r["doc_id"]) for r in encoded)
    assert all(r["n_tokens"] == len(r["ids"]) for r in encoded)


def test_run(spark, tables, tmp_path):
    folder, texts, base, _ = tables
    found = corpus_pipeline.run(spark, str(folder))
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    ids = [r["doc_id"] for r in found.collect()]
    assert set(ids) <= {i for i, _ in texts} and sum(i is not None and 300 <= i < 308 for i in ids) <= 1
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_token_counts_build_no_words(spark):
    """Counts equal those of Python's split at the same marks; the expression holds no array."""
    import re

    from pyspark.sql import functions as F

    from quillgrid.llm.mixing import token_count

    texts = ["", " ", "a", " a  b\t\n\x0b\x0c\rc ", "x" * 5, "é ü z 😀 \x00 \x1c", "$1 \\ x", None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", token_count(F.col("text")).alias("n"))
    assert "split" not in frame._jdf.queryExecution().analyzed().toString()
    found = {r["text"]: r["n"] for r in frame.collect()}
    assert found == {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts}


@pytest.fixture
def batch_limit(spark):
    from quillgrid.llm.tokens import BATCH_LIMIT

    before = spark.conf.get(BATCH_LIMIT)
    yield lambda value: spark.conf.set(BATCH_LIMIT, value)
    spark.conf.set(BATCH_LIMIT, before)


def test_stages_ask_for_small_batches(spark, tables, batch_limit):
    """Every stage with Python workers hands them about a megabyte at once, not 10,000 texts; a lower limit is left."""
    import pyarrow as pa

    from quillgrid.llm.tokens import BATCH_BYTES, BATCH_LIMIT, small_batches

    folder = tables[0]
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    long = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('some text ', 200) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    for name, stage in corpus_pipeline.STAGES:
        if name == "source_mixture":
            continue
        batch_limit("64m")
        stage(spark, docs, str(folder))
        found = long.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in found) == 3000 and max(r["bytes"] for r in found) < 1.1 * BATCH_BYTES, name
    batch_limit("4k")
    small_batches(spark)
    assert spark.conf.get(BATCH_LIMIT) == "4k"


def test_batches_do_not_change_results(spark, tables, batch_limit):
    """One or two rows in a batch give what one batch for all gives, in every stage."""
    folder = tables[0]
    for name, stage in corpus_pipeline.STAGES:
        if name == "source_mixture":
            continue
        docs = spark.read.parquet(str(folder / "documents.parquet")).coalesce(1)
        found = []
        for limit in ("1m", "1k"):
            batch_limit(limit)
            found.append(sorted(map(str, stage(spark, docs, str(folder)).collect())))
        assert found[0] == found[1], name
