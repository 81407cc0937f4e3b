"""From raw documents to token ids: toxic ones go, copies go, sources are mixed, texts are encoded.

Defined results: null and empty texts are clean, copies of nothing, and may be drawn; rows
without an id stay in every filter and are encoded under a null id; rows that share an id
are judged one by one, and of rows equal in id and text one stays; extra columns, whatever
their names, are kept up to the last stage; an empty table gives an empty result.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm.mixing import mixed_documents, plan_mixture
from quillgrid.llm.near_duplicates import without_near_duplicates
from quillgrid.llm.pair_index_bpe import encode_documents
from quillgrid.llm.parameters import SEED, SHARE, source_tree, toxicity_model
from quillgrid.llm.suffixes import without_copies
from quillgrid.llm.toxicity import without_toxic
from quillgrid.sources.scratch import remove, scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more are rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, toxicity_model(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return without_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first place they stand in."""
    left = without_copies(docs)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of the tokens, by weights. One epoch: no document comes back that the stages before made unique."""
    tree = source_tree()
    return mixed_documents(docs, tree, plan_mixture(docs, tree, SHARE, 1, SEED))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to as many tokens."""
    found = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mixture", source_mixture),
    ("encoding", encoding),
]

#: Maximal segments, suffix sorting and byte-pair merging are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and reread by the next, and removed when that is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        found = stage(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
