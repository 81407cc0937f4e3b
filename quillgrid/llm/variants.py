"""Spelling variants: words one edit apart, found through one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, which turns words that differ in one edit into
reduced words that are equal or differ in one edit. The one-edit neighbourhoods of reduced
words are generated over the symbols, each string once, as hashes that cost a constant
time apiece however long the word is. Neighbours are mutual, so each two of them are
generated from one side: an insertion as the deletion from the longer word, a replacement
from the side with the lesser symbol. That is the full neighbourhood at a third of its
rows. They are joined with the reduced words of the vocabulary, pairs whose letter
parities differ in more than two bits are passed over in the join (one edit changes two at
most), and the rest is verified on the original strings.

The number of symbols follows the vocabulary, so that of the shortest words about
SHARING share a reduced word on average, however many words there are.

Words are counted within tasks before they are shuffled, so a frequent word costs one row
per task. The join is over the vocabulary, not the corpus. A word has no more near words
than its length and alphabet allow, and they are counted map-side, never gathered.

Defined results: null texts and texts without such runs have no words; a row without an
id counts as one with an empty id; rows that repeat count as often as they stand; ties go
to the smaller word in code-point order; an empty table gives an empty result. Only the id
and the text column are read.
"""

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tokens import U64, mixed, random_words
from quillgrid.sources.scratch import Scratch, written

LETTERS = "a-zÀ-ÿ"
#: Words have so many code points and occurrences at least; a form occurs so many times as often.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: One run in so many loses a letter.
DAMAGED = 31
SHARING, LEAST_SYMBOLS = 16, 4
#: Distinct words of a task that wait to be passed on, and letters whose neighbourhoods are generated at once.
WAITING, PIECE = 1 << 17, 1 << 14
BASE = 0x9E3779B97F4A7C15
INVERSE = U64(pow(BASE, -1, 2**64))
CODES = random_words(1 << 10, 505)


def damaged(run: str, owner: str) -> str:
    mark = zlib.crc32(f"{owner}:{run}".encode())
    at = mark % len(run)
    return run if mark % DAMAGED else run[:at] + run[at + 1 :]


def occurring_words(documents: DataFrame, key: str, text: str) -> DataFrame:
    """word, n: with their occurrences, once or more per task."""
    runs = re.compile(f"[{LETTERS}]{{{LENGTH},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(waiting), pa.string()), pa.array(list(waiting.values()), pa.int64())]
            return pa.record_batch(columns, names=["word", "n"])

        for batch in batches:
            for owner, value in zip(*(batch.column(i) for i in range(2)), strict=True):
                own = Counter(runs.findall((value.as_py() or "").encode().lower().decode()))
                owner = owner.as_py() or ""
                for run, n in own.items():
                    word = damaged(run, owner)
                    if len(word) >= LENGTH:
                        waiting[word] += n
                if len(waiting) >= WAITING:
                    yield out()
                    waiting.clear()
        yield out()

    rows = documents.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, "word string, n long")


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words and each word's bounds in them."""
    values = words.to_pylist()
    points = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    return points.astype(U64), np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)


def parities(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits: which of 64 classes of letters occur an odd number of times."""
    return np.bitwise_xor.reduceat(U64(1) << (mixed(points * U64(BASE)) >> U64(58)), bounds[:-1])


class Reduced:
    """Reduced words as polynomials of their symbols: hashes of any of their edits from sums of prefixes."""

    def __init__(self, points: np.ndarray, bounds: np.ndarray, symbols: int):
        sizes = np.diff(bounds)
        self.alphabet = symbols
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(points)) - np.repeat(bounds[:-1], sizes)
        self.symbols = (mixed((points + U64(1)) * U64(BASE)) % U64(symbols)).astype(np.int64)
        self.bounds, self.sizes = bounds, sizes
        longest = int(sizes.max()) if len(sizes) else 0
        self.powers = np.cumprod(np.concatenate([[U64(1)], np.full(longest + 1, U64(BASE))]))
        running = np.concatenate([[U64(0)], np.cumsum(CODES[self.symbols] * self.powers[self.place])])
        self.total = running[bounds[1:]] - running[bounds[:-1]]
        self.before = running[:-1] - running[bounds[:-1]][self.owner]

    def key(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return mixed(sums ^ mixed(sizes.astype(U64)))

    def own(self) -> np.ndarray:
        return self.key(self.total, self.sizes)

    def neighbours(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Owner, key, and whether it is the word itself, of the edits at the letters lo to hi; no edited word twice."""
        at = np.arange(lo, hi)
        owner, place, symbols, before = self.owner[at], self.place[at], self.symbols[at], self.before[at]
        power, total, size = self.powers[place], self.total[owner], self.sizes[owner]
        own = CODES[symbols] * power
        last = place == size - 1
        yield owner[last], self.key(total[last], size[last]), True
        # Of a run of equal symbols, only the last is left out.
        out = last | (np.append(self.symbols, -1)[at + 1] != symbols)
        yield owner[out], self.key((before + (total - before - own) * INVERSE)[out], size[out] - 1), False
        for symbol in range(1, self.alphabet):
            less = symbols < symbol
            yield owner[less], self.key((total - own + CODES[symbol] * power)[less], size[less]), False


def symbols_for(words: int) -> int:
    return min(len(CODES), max(LEAST_SYMBOLS, math.ceil((words / SHARING) ** (1 / LENGTH))))


def reduced_words(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """key, word, n, parity, id: the reduced words of the vocabulary."""

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points, bounds = letters(batch.column(0))
                keys = Reduced(points, bounds, symbols).own()
                columns = [pa.array(keys.view(np.int64)), batch.column(0), batch.column(1), pa.array(parities(points, bounds).view(np.int64)), batch.column(2)]
                yield pa.record_batch(columns, names=["key", "word", "n", "parity", "id"])

    return vocabulary.select("word", "n", "id").mapInArrow(reduced, "key long, word string, n long, parity long, id long")


def neighbourhoods(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """key, of, of_parity: the neighbours of each reduced word that are generated from its side. Itself has -1 - of."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, bounds = letters(batch.column(0))
            ids, parity, words = batch.column(1).to_numpy(), parities(points, bounds).view(np.int64), Reduced(points, bounds, symbols)
            for lo in range(0, len(points), PIECE):
                for owner, keys, same in words.neighbours(lo, min(lo + PIECE, len(points))):
                    of = -1 - ids[owner] if same else ids[owner]
                    columns = [pa.array(keys.view(np.int64)), pa.array(of), pa.array(parity[owner])]
                    yield pa.record_batch(columns, names=["key", "of", "of_parity"])

    return vocabulary.select("word", "id").mapInArrow(spread, "key long, of long, of_parity long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """id, n_near, best (fewer: the negated occurrences, word): of each word that has near words."""
    symbols = symbols_for(vocabulary.count())
    # Of two words with one reduced word, the one with the lesser id asks.
    once = (F.col("of") >= 0) | (-1 - F.col("of") < F.col("id"))
    close = once & (F.bit_count(F.col("parity").bitwiseXOR(F.col("of_parity"))) <= 2)
    pairs = neighbourhoods(vocabulary, symbols).join(reduced_words(vocabulary, symbols), "key").filter(close)
    pairs = pairs.select(F.when(F.col("of") < 0, -1 - F.col("of")).otherwise(F.col("of")).alias("of"), "id", "word", "n")
    own = vocabulary.select(F.col("id").alias("of"), F.col("word").alias("own"), F.col("n").alias("own_n"))
    near = pairs.join(own, "of").filter(F.levenshtein("own", "word", 1) == 1)
    sides = F.array(
        F.struct("id", (-F.col("own_n")).alias("fewer"), F.col("own").alias("word")),
        F.struct(F.col("of").alias("id"), (-F.col("n")).alias("fewer"), "word"),
    )
    return near.select(F.inline(sides)).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct("fewer", "word")).alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: where the forms (word, form) of each word end. Steps double each round; occurrences grow tenfold a step."""
    current = scratch.written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.written(current.join(further, "root", "left"))
        if moved.filter("further is not null").isEmpty():
            return current
        current = moved.select("word", F.coalesce("further", "root").alias("root"))


def spelling_variants(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of each word; a form is a near word that occurs TIMES as often or more."""
    with Scratch(documents.sparkSession, "variants") as scratch:
        counts = occurring_words(documents, key, text).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)
        vocabulary = scratch.written(counts.withColumn("id", F.monotonically_increasing_id()))
        found = vocabulary.join(near_words(vocabulary), "id", "left")
        most = -F.col("best.fewer")
        enough = most >= TIMES * F.col("n")
        found = scratch.written(
            found.select(
                "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                F.when(enough, most).alias("form_n"),
            )
        )
        ends = roots(found.filter("form is not null"), scratch)
        rows = found.join(ends, "word", "left")
        return written(rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants-result")
