"""What the queries and the pipeline share: mixture weights, hash remainders, the toxicity model's training rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.mixing import Level
from quillgrid.llm.toxicity import Model, fit_toxicity

#: Weights down the tree, the share of all tokens to use, and how often a text may be used.
WEIGHTS = {
    "domain": {"group0": 4, "group1": 3, "group2": 2, "group3": 1},
    "lang": {"en": 4, "de": 3, "es": 3, "fr": 2},
    "source": {"src0": 2},
}
SHARE, MAX_EPOCHS, SEED = (4, 5), 2, 11


def source_tree() -> list[Level]:
    """Domains are groups of sources by the number in their name."""
    domain = F.concat(F.lit("group"), F.expr(r"try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4"))
    labels = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return [Level(name, label, WEIGHTS[name]) for name, label in labels.items()]


def remainder(key: str, modulus: int) -> Column:
    return F.crc32(F.col(key).cast("string")) % modulus


def toxicity_model(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from all labels but those of every fifth hash; a quarter of the others calibrates."""
    calibrating = F.floor(F.crc32(F.col("key").cast("string")) / 5) % 4 == 0
    return fit_toxicity(documents, labels, remainder("key", 5) != 0, calibrating)
