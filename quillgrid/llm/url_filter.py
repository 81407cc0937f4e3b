"""Judge urls by rules, and by logistic regression on hashed character n-grams where no rule fits.

Rules are a short list held by the plan. The model learns from a bounded sample of the
urls that rules decide; each gradient step is one aggregation over that sample, and all
urls are scored in one map-only pass with the weights as a literal.

Defined results: a null url, or one without `://`, has an empty host and path and takes
part like any other; repeated rows are judged alike; an empty table gives an empty
result; when rules decide nothing or only one way, the model's verdict is that one way
(allow, if there is none). Other columns of the input are kept out of the way: only the
key and the url column are read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.sources.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4)
#: Log odds given to every url when the labelled ones are all of one kind.
CERTAIN = 20.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The text after the first `://`, cut at the first `/`, `?` or `#`, and the path behind it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""

    def fits(rule: Rule) -> Column:
        under = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        return under & F.startswith(path, F.lit(rule.path))

    def named(rule: Rule) -> Column:
        return F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))

    longest_first = sorted(rules, key=lambda r: -len(r.text))
    return F.coalesce(*(F.when(fits(r), named(r)) for r in longest_first), F.lit(None))


def features(host: Column, path: Column, size: int) -> Column:
    """Distinct buckets of the character n-grams of host and path, each marked with its field."""

    def of(field: str, text: Column) -> list[Column]:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        return [
            F.when(
                F.length(marked) >= n,
                F.transform(
                    F.sequence(F.lit(1), F.length(marked) - (n - 1)),
                    lambda i, n=n: F.pmod(F.xxhash64(F.lit(field), F.substr(marked, i, F.lit(n))), F.lit(size)).cast("int"),
                ),
            ).otherwise(F.array().cast("array<int>"))
            for n in GRAMS
        ]

    return F.array_distinct(F.concat(*of("host", host), *of("path", path)))


def probability(found: Column, model: Model) -> Column:
    """Of the block class: inputs are the bucket indicators scaled to unit length."""
    table = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(table, i))
    margin = total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + model.bias
    return 1 / (1 + F.exp(-margin))


def fit(labelled: DataFrame, size: int, steps: int, penalty: float) -> Model:
    """Accelerated gradient steps on (features array<int>, label 0/1); the driver holds `size` weights.

    Rows have unit length and a constant, so a step of 2 never overshoots the logistic loss.
    """
    share = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = share["n"], share["ones"] or 0
    if ones in (0, n):
        return Model((0.0,) * size, CERTAIN if n and ones else -CERTAIN)
    at, bias = [0.0] * size, 0.0
    ahead, ahead_bias = at, bias
    for step in range(steps):
        p = probability(F.col("features"), Model(tuple(ahead), ahead_bias))
        wrong = labelled.select("features", (p - F.col("label")).alias("wrong"))
        scaled = F.col("wrong") / F.sqrt(F.greatest(F.size("features"), F.lit(1)))
        cells = wrong.select(scaled.alias("g"), F.explode("features").alias("i")).groupBy("i").agg(F.sum("g").alias("g"))
        whole = wrong.select(F.lit(-1).alias("i"), F.col("wrong").alias("g")).groupBy("i").agg(F.sum("g").alias("g"))
        gradient = {r["i"]: r["g"] / n for r in cells.union(whole).collect()}
        following = [w - 2.0 * (gradient.get(i, 0.0) + penalty * w) for i, w in enumerate(ahead)]
        following_bias = ahead_bias - 2.0 * gradient.get(-1, 0.0)
        pull = step / (step + 3)
        ahead = [b + pull * (b - a) for a, b in zip(at, following, strict=True)]
        ahead_bias = following_bias + pull * (following_bias - bias)
        at, bias = following, following_bias
    return Model(tuple(at), bias)


def labelled_sample(pages: DataFrame, url: str, rules: list[Rule], rows: int, size: int) -> DataFrame:
    """At most `rows` different urls that rules decide, drawn by hash: label 1 is block."""
    host, path = host_and_path(F.col(url))
    parts = pages.select(host.alias("host"), path.alias("path"))
    parts = parts.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules)).filter("found is not null")
    drawn = parts.dropDuplicates(["host", "path"]).orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)
    label = (F.col("found.verdict") == "block").cast("double")
    return drawn.select(features(F.col("host"), F.col("path"), size).alias("features"), label.alias("label"))


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    train_rows: int = 4000,
    size: int = 4096,
    steps: int = 30,
    penalty: float = 1e-4,
) -> DataFrame:
    """key, host, path, rule (null where none fits), verdict, p_block of the model.

    `train_rows` bounds the labelled sample the classifier is fitted on; every url is judged.
    """
    with Scratch(pages.sparkSession, "urls") as scratch:
        sample = scratch.written(labelled_sample(pages, url, rules, train_rows, size))
        model = fit(sample, size, steps, penalty)
    host, path = host_and_path(F.col(url))
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    parts = parts.withColumn("p_block", probability(features(F.col("host"), F.col("path"), size), model))
    learned = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return parts.select(
        key, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", learned).alias("verdict"), "p_block"
    )
