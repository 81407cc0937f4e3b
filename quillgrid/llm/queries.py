"""The operators of this subpackage over the test tables, and their SQL where SQL can express them."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import sql
from quillgrid.llm.chat_tree import prefix_trees, read_back
from quillgrid.llm.fingerprints import fingerprint_edits
from quillgrid.llm.hard_negatives import hard_negatives
from quillgrid.llm.katz import katz_scores
from quillgrid.llm.mixing import mixture_table, plan_mixture
from quillgrid.llm.near_duplicates import near_duplicates
from quillgrid.llm.one_bit_search import nearest
from quillgrid.llm.pair_index_bpe import encode_documents
from quillgrid.llm.parameters import MAX_EPOCHS, SEED, SHARE, WEIGHTS, remainder, source_tree, toxicity_model
from quillgrid.llm.simhash import simhash_duplicates
from quillgrid.llm.suffixes import repeated_passages
from quillgrid.llm.toxicity import toxic_documents
from quillgrid.llm.url_filter import Rule, judge_urls
from quillgrid.llm.variants import spelling_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_merkle_fingerprints", sql.MERKLE)
def merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op2_source_mixture", sql.mixture(WEIGHTS, SHARE, MAX_EPOCHS, SEED))
def source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return mixture_table(plan_mixture(documents, source_tree(), SHARE, MAX_EPOCHS, SEED))


#: Fixed by the query's contract: host and path of each rule, and its verdict.
URL_RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


@query("op4_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_one_bit_search", sql.NEAREST)
def one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


#: A conversation whose texts hold the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


@query("op6_chat_tree")
def chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)]
    added = spark.createDataFrame(added, "conv_id long, turn long, role string, text string")
    return read_back(prefix_trees(conversations.unionByName(added)))


@query("op7_pair_index_bpe")
def pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_toxic_segments")
def toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    found = toxic_documents(documents, model)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    predicted = (F.col("score") >= 0.5).cast("int")
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "passages")


@query("op10_hamming_near_duplicates")
def hamming_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_suffix_array_repeats")
def suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_katz_backoff")
def katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), remainder("id", 7) != 2)


@query("op11_anchor_simhash")
def anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


@query("op12_coordinate_negatives", sql.NEGATIVES)
def coordinate_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


@query("op13_reduced_variants", sql.VARIANTS)
def reduced_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
