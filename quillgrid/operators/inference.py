"""What a column really is, decided from a handful of counted facts."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.parsing import (
    BOOLEAN_TOKENS,
    column,
    kind_of,
    present,
    text_to_moment,
    text_to_number,
)
from quillgrid.operators.small import half_up

# --- Fixed values: thresholds and the identifier name pattern ----------------
PARSE_SHARE = 0.80
BOOLEAN_SHARE = 0.95
NOT_A_DATE_SHARE = 0.95
ID_SHARE_NAMED = 0.5
ID_SHARE_INTEGER = 0.98
ID_MIN_ROWS = 20
CATEGORY_FLOOR = 20
CATEGORY_SHARE = 0.05
ID_NAME = r"(^id$|_id$|^id_|_id_|_key$|_code$|^sku$|_sku$|number$|_no$)"
# -----------------------------------------------------------------------------


@dataclass
class ColumnFacts:
    """Counts over one column, gathered for all columns in one scan."""

    name: str
    kind: str  # numeric, boolean, datetime or text, as stored
    present: int
    numbers: int = 0  # values that read as a number
    moments: int = 0
    whole: bool = True  # every stored number is integral
    boolean_tokens: bool = False
    distinct: int = 0
    distinct_numbers: int = 0

    @property
    def number_share(self) -> float:
        return self.numbers / self.present if self.present else 0.0

    @property
    def moment_share(self) -> float:
        if not self.present or self.number_share > NOT_A_DATE_SHARE:
            return 0.0
        return self.moments / self.present

    @property
    def numeric_text(self) -> bool:
        """Text that will be read as numbers unless an earlier reading wins."""
        return self.kind == "text" and self.present > 0 and self.number_share >= PARSE_SHARE


@dataclass
class Reading:
    semantic: str
    suggested: str | None = None
    parse_pct: float | None = None


def column_facts(frame: DataFrame, texts: bool = True) -> tuple[int, list[ColumnFacts]]:
    """Row count and per-column facts (distinct counts excluded) in one aggregation. Without `texts`, text is not read."""
    measures: list[Column] = [F.count("*").alias("rows")]
    for i, field in enumerate(frame.schema.fields):
        c = present(frame, field.name)
        measures.append(F.count(c).alias(f"present{i}"))
        kind = kind_of(field.dataType)
        if kind == "numeric" and not isinstance(field.dataType, T.IntegralType):
            measures.append(F.coalesce(F.bool_and(c % 1 == 0), F.lit(True)).alias(f"whole{i}"))
        elif kind == "text" and texts:
            text = column(field.name).cast("string")
            known, mark = _boolean_marks(text)
            measures += [
                F.count(text_to_number(text)).alias(f"numbers{i}"),
                F.count(text_to_moment(text)).alias(f"moments{i}"),
                F.coalesce(F.bool_and(known) & (F.min(mark) < F.max(mark)), F.lit(False)).alias(f"tokens{i}"),
            ]
    row = frame.agg(*measures).first()
    facts = []
    for i, field in enumerate(frame.schema.fields):
        fact = ColumnFacts(field.name, kind_of(field.dataType), row[f"present{i}"])
        if f"whole{i}" in row:
            fact.whole = row[f"whole{i}"]
        elif fact.kind == "text" and texts:
            fact.numbers, fact.moments = row[f"numbers{i}"], row[f"moments{i}"]
            fact.boolean_tokens = bool(row[f"tokens{i}"])
        facts.append(fact)
    return row["rows"], facts


def _boolean_marks(text: Column) -> tuple[Column, Column]:
    """Whether a text is a boolean token, and its hash: two different hashes are two different tokens; equal ones can only be one of ten."""
    token = F.lower(F.trim(text))
    return token.isin(list(BOOLEAN_TOKENS)), F.when(token.isNotNull(), F.xxhash64(token))


def text_facts(values: DataFrame, facts: list[ColumnFacts]) -> None:
    """Completes the facts of text columns, distinct counts included, from `values`: one row (c, v, n) per column number and text.

    Each different text is read once, however many rows hold it and however many columns there are.
    """
    v = F.when(F.col("c").isin([i for i, f in enumerate(facts) if f.kind == "text"]), F.col("v"))
    known, mark = _boolean_marks(v)
    read = values.select(
        "c", "n", (text_to_number(v) + F.lit(0.0)).alias("number"), text_to_moment(v).isNotNull().alias("moment"), known.alias("known"), mark.alias("mark")
    )
    by_number = read.groupBy("c", "number").agg(
        F.count("*").alias("texts"), F.sum("n").alias("n"), F.sum(F.when(F.col("moment"), F.col("n"))).alias("moments"),
        F.bool_and("known").alias("known"), F.min("mark").alias("low"), F.max("mark").alias("high"),
    )
    found = by_number.groupBy("c").agg(
        F.sum("texts").alias("distinct"), F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("numbers"),
        F.count("number").alias("distinct_numbers"), F.coalesce(F.sum("moments"), F.lit(0)).alias("moments"),
        F.coalesce(F.bool_and("known") & (F.min("low") < F.max("high")), F.lit(False)).alias("tokens"),
    )
    for r in found.collect():
        f = facts[r["c"]]
        f.distinct = min(r["distinct"], f.present)
        if f.kind == "text":
            f.numbers, f.moments, f.boolean_tokens = r["numbers"], r["moments"], r["tokens"]
            f.distinct_numbers = r["distinct_numbers"] if f.numeric_text else 0


def _identifier(fact: ColumnFacts, distinct: int, of: int, integral: bool) -> bool:
    if of == 0:
        return False
    share = distinct / of
    named = re.search(ID_NAME, fact.name, re.IGNORECASE) is not None
    return (named and share > ID_SHARE_NAMED) or (
        integral and share > ID_SHARE_INTEGER and of > ID_MIN_ROWS
    )


def read_column(fact: ColumnFacts) -> Reading:
    """Stored types speak for themselves; text is tried as boolean, date, then number."""
    if fact.kind in ("boolean", "datetime"):
        return Reading(fact.kind)
    if fact.kind == "numeric":
        is_id = _identifier(fact, fact.distinct, fact.present, fact.whole)
        return Reading("id" if is_id else "numeric")
    if fact.present == 0:
        return Reading("text")

    readings = (
        ("boolean", float(fact.boolean_tokens), BOOLEAN_SHARE),
        ("datetime", fact.moment_share, PARSE_SHARE),
        ("numeric", fact.number_share, PARSE_SHARE),
    )
    for target, share, needed in readings:
        if share < needed:
            continue
        if target == "numeric" and _identifier(fact, fact.distinct_numbers, fact.numbers, True):
            return Reading("id")
        return Reading(target, target, half_up(share * 100, 1))

    if _identifier(fact, fact.distinct, fact.present, False):
        return Reading("id")
    few = max(CATEGORY_FLOOR, int(fact.present * CATEGORY_SHARE))
    return Reading("categorical" if fact.distinct <= few else "text")
