"""Mix sources to target weights under a token budget, down a domain-language-source tree.

A budget flows from the root to the leaves in proportion to the children's weights. A
child takes no more than it holds (its tokens times the allowed epochs); what it leaves
goes to its siblings by their weights, and to the parent's siblings only when a whole
family is short, because a parent asks for no more than its children hold together.
Whole epochs of a leaf come first; the rest of its budget is the token prefix of one
more epoch in a seeded order. The prefix is found from sums per range of the order, so
no leaf's documents meet in one task: only the one range that holds the cut is ordered.

Defined results: null labels form the branch `(none)`; a null or empty text has no
tokens and is kept only where its place in the order lies before the cut; rows that
repeat a key share a place in the order and are chosen together (a row without a key is
placed by its text); the document at the cut is kept, and `tokens_taken` says how much
of it lies inside the budget; shares are rounded down to whole tokens; an empty table
gives an empty result. Weights are positive whole numbers, 1 where a label has none.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.sources.scratch import Scratch, written

SPACES = " \t\n\v\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits that name a range of the seeded order: 4,096 ranges a leaf.
RANGE_DIGITS = 3


@dataclass(frozen=True)
class Level:
    """One level of the tree: the label of a document, and weights by label."""

    name: str
    label: Column
    weights: dict[str, int] = field(default_factory=dict)

    def labelled(self) -> Column:
        return F.coalesce(self.label.cast("string"), F.lit("(none)")).alias(self.name)

    def weight(self) -> Column:
        found = F.lit(1)
        for label, weight in self.weights.items():
            found = F.when(F.col(self.name) == label, weight).otherwise(found)
        return found.cast("long")


def token_count(text: Column) -> Column:
    """Words become one letter each, so that no array of words is built for a long text."""
    letters = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), SPACES, "")
    return F.length(letters).cast("long")


def shared_out(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """Adds `budget`: each child's part of the `family_budget` of its family.

    Children are ordered by how soon they are full; one is full if it holds no more than
    its weight's share of what the fuller ones before it leave.
    """
    order = Window.partitionBy(*family, "root").orderBy("fullness", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = children.withColumn("root", F.lit(0)).withColumn("fullness", F.col("capacity").cast("double") / F.col("weight"))
    rows = rows.withColumn("left_over", F.col("family_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    rows = rows.withColumn("full", F.col("capacity") * F.sum("weight").over(onward) <= F.col("left_over") * F.col("weight"))
    whole = Window.partitionBy(*family, "root")
    rows = rows.withColumn("rest", F.col("family_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole))
    rows = rows.withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
    part = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(rest * weight) div open_weight"))
    return rows.withColumn("budget", part)


def leaf_budgets(held: DataFrame, levels: list[Level], budget: int, max_epochs: int) -> DataFrame:
    """held: the levels' labels and `tokens` per leaf. Adds each leaf's `budget`, top down."""
    names = [level.name for level in levels]
    leaves = held.withColumn("capacity", F.col("tokens") * max_epochs)
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = names[: depth + 1]
        children = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        children = children.withColumn("weight", level.weight())
        if above is None:
            children = children.withColumn("family_budget", F.lit(budget).cast("long"))
        else:
            family = above.select(*names[:depth], F.col("budget").alias("family_budget"))
            children = children.join(family, names[:depth])
        above = shared_out(children, names[:depth], level.name)
    return above.select(*names, "tokens", "budget")


def place(seed: int, epoch: Column) -> Column:
    """A document's place in the seeded order of an epoch: hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("ident")))


def cuts(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per leaf with a part epoch: the last place inside its `rest` tokens, and how far it reaches beyond.

    rows: labels, place, n_tokens, rest. Sums per range of places find the range of the
    cut; the documents of that range alone are then ordered.
    """
    rows = rows.filter("rest > 0").withColumn("range", F.substring("place", 1, RANGE_DIGITS))
    sums = rows.groupBy(*names, "range", "rest").agg(F.sum("n_tokens").alias("inside"))
    running = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("inside").over(running), F.lit(0)))
    cut = sums.filter("before < rest and before + inside >= rest").select(*names, "range", "before")
    near = rows.join(cut, [*names, "range"]).groupBy(*names, "place", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*names).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    last = near.filter("start < rest").groupBy(*names)
    return last.agg(F.max("place").alias("cut"), F.max_by(F.expr("start + n - rest"), "place").alias("beyond"))


@dataclass(frozen=True)
class Mixture:
    """rows: labels, ident, n_tokens of each document; plan: one row per leaf."""

    names: list[str]
    rows: DataFrame
    plan: DataFrame
    seed: int

    def chosen(self, documents: DataFrame) -> DataFrame:
        """Adds epochs (times a document is used, 0 excluded) by a join with the small plan alone."""
        found = documents.join(self.plan, self.names)
        found = found.withColumn("place", place(self.seed, F.col("full_epochs") + 1))
        part = F.coalesce(F.col("place") <= F.col("cut"), F.lit(False))
        found = found.withColumn("in_part", part).withColumn("epochs", F.col("full_epochs") + part.cast("long"))
        return found.filter("epochs > 0")


def identity(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")))))


def plan_mixture(
    documents: DataFrame,
    levels: list[Level],
    share: tuple[int, int],
    max_epochs: int,
    seed: int,
    key: str = "doc_id",
    text: str = "text",
) -> Mixture:
    """The budget is `share` (a fraction) of all tokens. Reads the texts once, to count tokens."""
    names = [level.name for level in levels]
    counted = documents.select(
        F.col(key).alias("key"),
        identity(key, text).alias("ident"),
        token_count(F.col(text)).alias("n_tokens"),
        *(level.labelled() for level in levels),
    )
    rows = written(counted, "mixture-rows")
    with Scratch(documents.sparkSession, "mixture") as scratch:
        held = scratch.written(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")))
        total = held.agg(F.sum("tokens")).first()[0] or 0
        leaves = leaf_budgets(held, levels, total * share[0] // share[1], max_epochs)
        leaves = leaves.withColumn("full_epochs", F.expr("if(tokens = 0, 0L, budget div tokens)"))
        leaves = scratch.written(leaves.withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens")))
        placed = rows.join(leaves.drop("tokens"), names).withColumn("place", place(seed, F.col("full_epochs") + 1))
        plan = leaves.join(cuts(placed, names), names, "left").withColumnRenamed("tokens", "leaf_tokens")
        plan = written(plan, "mixture-plan")
    return Mixture(names, rows, plan, seed)


def mixture_table(mixture: Mixture, key: str = "doc_id") -> DataFrame:
    """One row per document used: labels, n_tokens, epochs, tokens_taken over all its epochs."""
    found = mixture.chosen(mixture.rows)
    partly = F.when(F.col("place") == F.col("cut"), F.greatest(F.col("n_tokens") - F.col("beyond"), F.lit(0))).otherwise(F.col("n_tokens"))
    taken = F.col("full_epochs") * F.col("n_tokens") + F.when(F.col("in_part"), partly).otherwise(0)
    return found.select(F.col("key").alias(key), *mixture.names, "n_tokens", "epochs", taken.alias("tokens_taken"))


def mixed_documents(documents: DataFrame, levels: list[Level], mixture: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chosen documents with their own columns, each as often as it has epochs."""
    columns = [F.col(f"document.`{c}`").alias(c) for c in documents.columns]
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("document")
    docs = documents.select(whole, identity(key, text).alias("ident"), *(level.labelled() for level in levels))
    used = mixture.chosen(docs).select("document", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("epoch"))
    return used.select(*columns)
