"""Merkle fingerprints of texts, and how much of a text survives an edit.

Sentences are the leaves, lines are paragraphs, and a section ends at every paragraph
whose digest says so, so that an edit moves only the sections it touches. Each node is
the SHA-256 of its children's digests. A fingerprint lists the root in full and then,
section by section, eight digits of each leaf: equal roots mean equal texts, and the
first differing branch says where an edit begins. The cuts are plain separators, which
makes the tree and the text determine each other.

Defined results: a null text counts as empty, which has one empty leaf; equal texts have
equal fingerprints; rows that repeat a key stand next to each other, in the order of
their texts; a null key has no neighbour, which counts as an empty next text; an empty
table gives an empty result. Only the key and the text column are read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION_END = r"([048c])\."
#: Consecutive keys that share a window: bounds its rows whatever the table's size.
SPAN_BITS = 8
KEYLESS = 1 << 62
FANOUT = 1 << 16


def leaves(text: Column) -> Column:
    """array<array<string>>: the digests of the sentences of each line."""
    return F.transform(
        F.split(text, "\n"), lambda line: F.transform(F.split(line, r"\. "), lambda s: F.sha2(s, 256))
    )


def joined(parts: Column) -> Column:
    return F.array_join(parts, ".")


def sections(found: Column) -> Column:
    """array<string>: paragraph digests, joined, cut after each digest that ends a section."""
    paragraphs = F.transform(found, lambda line: F.sha2(joined(line), 256))
    return F.split(F.regexp_replace(joined(paragraphs), SECTION_END, "$1|"), r"\|")


def root(found: Column) -> Column:
    return F.sha2(joined(F.transform(sections(found), lambda s: F.sha2(s, 256))), 256)


def leaf_codes(found: Column) -> Column:
    return F.transform(F.flatten(found), lambda d: F.substring(d, 1, 8))


def fingerprint(found: Column) -> Column:
    """Root, then the leaf codes: `.` between sentences, `/` between paragraphs."""
    branches = F.transform(found, lambda line: joined(F.transform(line, lambda d: F.substring(d, 1, 8))))
    return F.concat(root(found), F.lit(":"), F.array_join(branches, "/"))


def codes_of(print_: Column) -> Column:
    """The distinct leaf codes in a fingerprint."""
    return F.array_distinct(F.split(F.substring_index(print_, ":", -1), "[./]"))


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared leaves over all leaves of two lists of distinct codes."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first leaf that differs, null where the lists are equal."""
    places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
    return F.get(F.filter(places, lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))), 0)


def following_group(groups: DataFrame, lowest: int, highest: int) -> DataFrame:
    """(group, next_group) for distinct integers in a known range, in windows of bounded size.

    The last of each window takes the first of the next window that has any, found in
    the same way one level up, with 65,536 times fewer rows each time.
    """
    window = Window.partitionBy("upper").orderBy("group")
    placed = groups.withColumn("upper", F.expr(f"(group - {lowest}L) div {FANOUT}"))
    inside = placed.select("group", "upper", F.lead("group").over(window).alias("next_group"))
    last = (highest - lowest) // FANOUT
    if last == 0:
        return inside.select("group", "next_group")
    firsts = placed.groupBy("upper").agg(F.min("group").alias("first"))
    above = following_group(firsts.select(F.col("upper").alias("group")), 0, last)
    above = above.select(F.col("group").alias("upper"), F.col("next_group").alias("next_upper"))
    heads = firsts.select(F.col("upper").alias("next_upper"), F.col("first").alias("across"))
    crossing = above.join(heads, "next_upper").select("upper", "across")
    return inside.join(crossing, "upper", "left").select("group", F.coalesce("next_group", "across").alias("next_group"))


def with_next_text(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, next_text: the text of the next key in ascending order, the last one's being the first's.

    Texts move once, to the group of keys they lie in; a group's last row needs the
    head of the next group that has rows, and only heads move for that.
    """
    docs = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = docs.agg(F.min("id"), F.max("id")).first()
    lowest, highest = (0, 0) if bounds[0] is None else (b >> SPAN_BITS for b in bounds)
    # Rows without a key are spread by their text, over groups that no key falls into.
    spread = F.xxhash64("text").bitwiseAND(F.lit(KEYLESS - 1)).bitwiseOR(F.lit(KEYLESS))
    docs = docs.withColumn("group", F.coalesce(F.shiftright("id", SPAN_BITS), spread))
    window = Window.partitionBy("group").orderBy("id", "text")
    placed = docs.select("*", F.lead("text").over(window).alias("next_text"), F.lead(F.lit(True)).over(window).alias("inner"))

    keyed = docs.filter("id is not null")
    heads = keyed.groupBy("group").agg(F.min_by("text", F.struct("id", "text")).alias("head"))
    order = following_group(keyed.select("group").distinct(), lowest, highest)
    order = order.select("group", F.coalesce("next_group", F.lit(lowest)).alias("next_group"))
    heads = heads.withColumnRenamed("group", "next_group")
    across = order.join(heads, "next_group").select("group", "head")
    placed = placed.join(across, "group", "left")
    following = F.when(F.col("id").isNull(), F.lit("")).when(F.col("inner"), F.col("next_text")).otherwise(F.col("head"))
    return placed.select(F.col("id").alias(key), F.col("text").alias(text), following.alias("next_text"))


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by as many from the start of another text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - quarter), F.substr(following, F.lit(1), quarter))


def fingerprint_edits(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and how alike they and the next text are."""
    rows = with_next_text(documents, key, text)
    body, following = F.col(text), F.col("next_text")
    rows = rows.withColumn("edited", edited_text(body, following))
    rows = rows.select(
        key,
        F.length(body).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        leaves(body).alias("own"),
        leaves(F.col("edited")).alias("changed"),
        F.array_distinct(leaf_codes(leaves(following))).alias("next_codes"),
    )
    rows = rows.select(
        key,
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        leaf_codes(F.col("own")).alias("a"),
        leaf_codes(F.col("changed")).alias("b"),
        "next_codes",
    )
    own = F.array_distinct("a")
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(own, F.array_distinct("b")).alias("near_edited"),
        likeness(own, F.col("next_codes")).alias("near_next"),
        first_difference(F.col("a"), F.col("b")).cast("long").alias("first_changed_leaf"),
    )
