"""Toxic passages as maximum-scoring segments of token log-odds.

Each word, and its first six, five and four bytes, has log-odds between toxic and clean
training texts, counted once a text, with an informative Dirichlet prior: pseudo-counts
in proportion to how common the feature is at all. Features whose odds are many standard
deviations above even make the lexicon; a token scores the odds of its longest feature
in it, and every other token a small negative amount. A linear scan finds all maximal
segments of a text. Karlin-Altschul statistics, with rates from the clean training
texts, turn a segment's score into the number of such segments expected by chance, and
the best segments together into one p-value of the text, whatever its length. A
two-parameter logistic curve, fitted on training texts that the lexicon has not seen,
maps that to the score; it also decides how strict the lexicon is.

The classifier is fitted on a bounded sample of labelled rows (`train_rows` of each
class, drawn by hash); all texts are scored, whole. The curve weighs each class by how
many labels one drawn row stands for, so one half means the same whatever the table's
size. Labels are matched by key and are inputs of the fit only.

Defined results: null and empty texts have no passages and the lowest score; labels
other than 0 and 1, and labels without a text, are ignored; a key labelled both ways
counts as toxic; repeated texts count once in training; with labels of one kind or none,
every score is the share of toxic labels (0 without labels); an empty table gives an
empty result. Only the key and text columns are read.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tokens import MARKS, SMALL_SLICE, U64, Words, slices, small_batches, text_bytes, words
from quillgrid.sources.scratch import Scratch

#: None: the whole word; else its first bytes. The first that is in the lexicon counts.
LEVELS = (None, 6, 5, 4)
PRIOR = 0.1
NEUTRAL = -0.2
STRICTNESS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)
#: Size of the model: at most so many features, the surest first.
MOST_FEATURES = 20_000
LEAST_ODDS = 2.0
#: A passage is reported if fewer than this many are expected by chance in a text of its length.
CHANCE = 0.05
PASSAGES = "array<struct<first_word:int,last_word:int,start:int,end:int,score:double,expected:double>>"


@dataclass(frozen=True)
class Lexicon:
    """Sorted features with their log-odds, and the constants of the extreme-value law."""

    features: np.ndarray
    odds: np.ndarray
    rate: float
    decay: float

    def scores(self, level_hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that score, and their odds."""
        total = np.zeros(len(level_hashes[0]))
        for hashes in reversed(level_hashes):
            found = np.flatnonzero(self.known[hashes >> U64(44)])
            at = np.minimum(np.searchsorted(self.features, hashes[found]), len(self.features) - 1)
            real = self.features[at] == hashes[found]
            total[found[real]] = self.odds[at[real]]
        at = np.flatnonzero(total)
        return at, total[at]

    @property
    def known(self) -> np.ndarray:
        """Which first 20 bits any feature has: most tokens are dismissed by them."""
        if "known" not in self.__dict__:
            table = np.zeros(1 << 20, bool)
            table[self.features >> U64(44)] = True
            self.__dict__["known"] = table
        return self.__dict__["known"]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon | None
    slope: float
    intercept: float

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -500, 500)))


def level_words(data: np.ndarray, bounds: np.ndarray) -> tuple[Words, list[np.ndarray]]:
    """Words of texts, and the hash of each word's feature at each level."""
    whole = words(data, bounds, MARKS, LEVELS[0])
    hashes = [whole.hashes] + [words(data, bounds, MARKS, prefix).hashes for prefix in LEVELS[1:]]
    return whole, [h ^ U64(0x9E3779B97F4A7C15 * (i + 1) % 2**64) for i, h in enumerate(hashes)]


def maximal_segments(at: np.ndarray, odds: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) in linear time: first and last scoring token, and the sum.

    at: places of the positive tokens; those between them score NEUTRAL each.
    """
    done: list[tuple[int, int, float]] = []
    kept: list[tuple] = []  # first, last, sum before it, sum after it, the nearest one before with a lower sum before it
    total, previous = 0.0, -1
    for place, score in zip(at.tolist(), odds.tolist(), strict=True):
        total += NEUTRAL * (place - previous - 1)
        first, last, before, after = place, place, total, total + score
        total, previous = after, place
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= after:
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
        if j < 0:  # nothing to come can reach back beyond this one
            done += [(a, b, up - low) for a, b, low, up, _ in kept]
            kept = []
        kept.append((first, last, before, after, j))
    return done + [(a, b, up - low) for a, b, low, up, _ in kept]


def evidence_of(lexicon: Lexicon, segments: list[tuple[int, int, float]], n: int) -> float:
    """-log p of a text of n tokens: its best segment alone, or its r best by the law of sums."""
    normed = sorted((lexicon.decay * s - math.log(lexicon.rate * n) for _, _, s in segments), reverse=True)
    if not normed:
        return 0.0
    first = normed[0]
    best = first if first > 30 else -math.log(-math.expm1(-math.exp(-first)))
    total = first
    for r, value in enumerate(normed[1:], 2):
        total += value
        if value <= 0 or total <= r:
            break
        best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def scanned(lexicon: Lexicon, found: Words, hashes: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[int, int, float]], float]]:
    """Texts that have any scoring token: their number, segments and evidence."""
    at, odds = lexicon.scores(hashes)
    owners = np.searchsorted(found.bounds, at, "right") - 1
    heads = np.flatnonzero(np.diff(owners, prepend=-1))
    for places, values, text in zip(np.split(at, heads[1:]), np.split(odds, heads[1:]), owners[heads].tolist(), strict=False):
        segments = maximal_segments(places - found.bounds[text], values)
        yield text, segments, evidence_of(lexicon, segments, int(found.counts[text]))


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, level, toxic, clean: in how many texts of each kind it stands. rows: text, toxic."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in slices(bounds, SMALL_SLICE):
                found, hashes = level_words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                cuts = found.bounds[1:-1]
                for level, values in enumerate(hashes):
                    own = [np.unique(x) for x in np.split(values, cuts)]
                    kinds = np.repeat(toxic[lo:hi], [len(x) for x in own])
                    features, which = np.unique(np.concatenate(own), return_inverse=True)
                    ones = np.bincount(which, weights=kinds, minlength=len(features))
                    both = np.bincount(which, minlength=len(features))
                    columns = [features.view(np.int64), np.full(len(features), level), ones.astype(np.int64), (both - ones).astype(np.int64)]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["feature", "level", "toxic", "clean"])

    parts = rows.select("text", "toxic").mapInArrow(counted, "feature long, level long, toxic long, clean long")
    return parts.groupBy("feature", "level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def candidates(rows: DataFrame, scratch: Scratch) -> list:
    """Features with their log-odds, how many standard deviations those are, and their share of clean texts' features."""
    counts = scratch.written(feature_counts(rows))
    totals = {r["level"]: r for r in counts.groupBy("level").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()}

    def of_level(name: str) -> Column:
        found = F.lit(0.0)
        for level, row in totals.items():
            found = F.when(F.col("level") == level, float(row[name])).otherwise(found)
        return found

    prior = PRIOR * (F.col("toxic") + F.col("clean"))
    whole = PRIOR * (of_level("toxic") + of_level("clean"))
    up, down = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(up / (of_level("toxic") + whole - up)) - F.log(down / (of_level("clean") + whole - down))
    sure = odds / F.sqrt(1 / up + 1 / down)
    share = (F.col("clean") + 0.5) / F.greatest(of_level("clean"), F.lit(1.0))
    found = counts.filter("toxic > 0").select("feature", odds.alias("odds"), sure.alias("sure"), share.alias("share"))
    found = found.filter((F.col("sure") >= STRICTNESS[0]) & (F.col("odds") >= LEAST_ODDS))
    return found.orderBy(F.desc("sure"), "feature").limit(MOST_FEATURES).collect()


def lexicon_of(found: list, strictness: float) -> Lexicon | None:
    """The features at least so sure, and the law of chance segments that they make."""
    kept = sorted(((r["feature"] % 2**64, r["odds"], r["share"]) for r in found if r["sure"] >= strictness))
    if not kept:
        return None
    odds, shares = np.array([k[1] for k in kept]), np.array([k[2] for k in kept])
    chance = min(float(shares.sum()), 0.01)
    shares = shares * chance / shares.sum()

    def excess(decay: float) -> float:
        return float((shares * np.exp(decay * odds)).sum() + (1 - chance) * math.exp(decay * NEUTRAL)) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    # As many segments of the least score are expected as single scoring tokens.
    return Lexicon(np.array([k[0] for k in kept], U64), odds, chance * math.exp(low * float(odds.min())), low)


def fitted_curve(evidence: np.ndarray, toxic: np.ndarray, rates: tuple[float, float] = (1, 1), penalty: float = 0.01) -> tuple[float, float, float]:
    """Slope (not negative) and intercept of a logistic curve, and the penalised loss.

    rates: how many rows a clean and a toxic one stand for.
    """
    stands = np.where(toxic > 0, rates[1], rates[0])
    scale = max(float(evidence.std()), 1e-9)
    x = np.stack([evidence / scale, np.ones(len(evidence))], 1)
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (stands * (p - toxic)) + penalty * weights
        curvature = (x * (stands * p * (1 - p))[:, None]).T @ x + penalty * np.eye(2)
        weights -= np.clip(np.linalg.solve(curvature, gradient), -2, 2)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), 1e-12, 1 - 1e-12)
    loss = -float((stands * (toxic * np.log(p) + (1 - toxic) * np.log(1 - p))).sum()) + penalty / 2 * float(weights @ weights)
    return max(float(weights[0] / scale), 0.0), float(weights[1]), loss


def evidence_rows(rows: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    """toxic and an evidence per lexicon of each text. rows: text, toxic."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(0))
            evidence = np.zeros((batch.num_rows, len(lexicons)))
            for lo, hi in slices(bounds, SMALL_SLICE):
                found, hashes = level_words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                for j, lexicon in enumerate(lexicons):
                    for text, _, value in scanned(lexicon, found, hashes):
                        evidence[lo + text, j] = value
            yield pa.record_batch([batch.column(1), pa.array(evidence.tolist(), pa.list_(pa.float64()))], names=["toxic", "evidence"])

    return rows.select("text", "toxic").mapInArrow(measured, "toxic long, evidence array<double>")


def labelled_keys(labels: DataFrame, training: Column, fold: Column, key: str, label: str) -> DataFrame:
    """key, toxic, fold: of the keys that may be learnt from."""
    marked = labels.select(F.col(key).alias("key"), F.col(label).cast("long").alias("toxic"))
    marked = marked.filter(F.col("key").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("key").agg(F.max("toxic").alias("toxic"))
    return marked.select("key", "toxic", training.alias("training"), fold.alias("fold")).filter("training").drop("training")


def class_rates(marked: DataFrame, train_rows: int) -> tuple[float, float]:
    """How many labels a drawn clean and a drawn toxic row stand for, the lesser being one."""
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    stand = [max(1.0, totals.get(c, 0) / train_rows) for c in (0, 1)]
    return stand[0] / min(stand), stand[1] / min(stand)


def training_rows(documents: DataFrame, marked: DataFrame, train_rows: int, key: str, text: str) -> DataFrame:
    """text, toxic, fold: of at most train_rows keys of each class, different texts only."""
    drawn = [marked.filter(F.col("toxic") == c).orderBy(F.xxhash64("key"), "key").limit(train_rows) for c in (0, 1)]
    # At most 2 * train_rows keys, so a copy of them fits every executor.
    sample = F.broadcast(drawn[0].union(drawn[1]))
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(sample, "key")
    first = rows.groupBy(F.xxhash64("text").alias("same"), F.md5("text").alias("digest")).agg(
        F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.max("fold").alias("fold")
    )
    return first.select("text", "toxic", "fold")


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    training: Column,
    fold: Column,
    train_rows: int = 10_000,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """training: which keys (column key) may be learnt from; fold: of those, which calibrate instead."""
    small_batches(documents.sparkSession)
    with Scratch(documents.sparkSession, "toxicity") as scratch:
        marked = labelled_keys(labels, training, fold, key, label)
        rates = class_rates(marked, train_rows)
        rows = scratch.written(training_rows(documents, marked, train_rows, key, text))
        kinds = {(r["toxic"], r["fold"]): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
        if min(kinds.get((c, f), 0) for c in (0, 1) for f in (False, True)) == 0:
            return constant(kinds, rates)
        found = candidates(rows.filter("not fold"), scratch)
        lexicons = {s: x for s in STRICTNESS if (x := lexicon_of(found, s)) is not None}
        if not lexicons:
            return constant(kinds, rates)
        measured = evidence_rows(rows.filter("fold"), list(lexicons.values())).collect()
        toxic = np.array([r["toxic"] for r in measured], float)
        curves = {s: fitted_curve(np.array([r["evidence"][j] for r in measured]), toxic, rates) for j, s in enumerate(lexicons)}
        best = min(curves, key=lambda s: (curves[s][2], -s))
        # The strictness and the curve stay; the lexicon is counted again over all training texts.
        final = lexicon_of(candidates(rows, scratch), best) or lexicons[best]
    return Model(final, curves[best][0], curves[best][1])


def constant(kinds: dict, rates: tuple[float, float]) -> Model:
    """The share of toxic training texts, for want of anything to tell them by."""
    clean, toxic = (rates[c] * sum(n for (k, _), n in kinds.items() if k == c) for c in (0, 1))
    share = toxic / max(1, clean + toxic)
    return Model(None, 0.0, math.log((share + 1e-9) / (1 - share + 1e-9)))


def toxic_documents(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, and the significant passages: words counted from 0, code points, score, expected number by chance."""
    small_batches(documents.sparkSession)
    share = documents.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            evidence, passages = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for lo, hi in slices(bounds, SMALL_SLICE) if model.lexicon else ():
                part = data[bounds[lo] : bounds[hi]]
                found, hashes = level_words(part, bounds[lo : hi + 1] - bounds[lo])
                for number, segments, value in scanned(model.lexicon, found, hashes):
                    evidence[lo + number] = value
                    passages[lo + number] = located(model.lexicon, part, found, number, segments, bounds[lo + number] - bounds[lo])
            columns = [batch.column(0), pa.array(model.score(evidence)), pa.array(passages, PASSAGE_TYPE)]
            yield pa.record_batch(columns, names=[key, "score", "passages"])

    rows = documents.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    return rows.mapInArrow(judged, f"{key} long, score double, passages {PASSAGES}")


def without_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents, all columns, whose score is under one half."""
    small_batches(documents.sparkSession)
    share = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        for batch in batches:
            data, bounds = text_bytes(batch.column(at))
            evidence = np.zeros(batch.num_rows)
            for lo, hi in slices(bounds, SMALL_SLICE) if model.lexicon else ():
                found, hashes = level_words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                for number, _, value in scanned(model.lexicon, found, hashes):
                    evidence[lo + number] = value
            yield batch.filter(pa.array(model.score(evidence) < 0.5))

    return documents.mapInArrow(passed, documents.schema)


PASSAGE_TYPE = pa.list_(
    pa.struct([(n, pa.int32()) for n in ("first_word", "last_word", "start", "end")] + [(n, pa.float64()) for n in ("score", "expected")])
)


def located(lexicon: Lexicon, data: np.ndarray, found: Words, text: int, segments: list, text_start: int) -> list[dict]:
    base, n = int(found.bounds[text]), int(found.counts[text])
    rows = []
    for first, last, score in segments:
        expected = lexicon.rate * n * math.exp(-lexicon.decay * score)
        if expected <= CHANCE:
            start, end = found.starts[base + first], found.ends[base + last]
            points = (data[text_start:end] & 0xC0) != 0x80
            before = int(points[: start - text_start].sum())
            rows.append({"first_word": first, "last_word": last, "start": before, "end": int(points.sum()), "score": score, "expected": expected})
    return rows
