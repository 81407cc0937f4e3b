"""Katz back-off language model of word pairs, fitted and evaluated over whole texts.

Texts are read in blocks of a few million words. A block asks each range of n-gram
hashes for the n-grams it holds, as one packed, sorted row; the range adds up the
training counts of all blocks and answers every block in the order it asked. These
answers, partitioned by order and block, are the count tables: a block finds all counts
it needs in its own rows, and nothing is looked up word by word over the network.

Counts up to five are discounted by Good-Turing (by half an occurrence where the counts
of counts allow no valid discount), larger ones by a hundredth of an occurrence, so that
every context has some probability left over. What words give up goes to one unknown
word. A context's back-off weight is what its seen words leave over, divided by what the
word model gives to all other words; both sums run over the context's distinct words,
each counted by the one block that owns the pair, so that all probabilities of a context
add up to one. A token's probability is its pair's if that was seen, else the weight of
its context times the word's own: the weights are made where the sums are, and applied
there to the tokens that wait for them.

Hashes have 64 bits. Blocks are named by their documents; should a rerun of the scan cut
them otherwise, the job stops with an error instead of mixing answers.

Defined results: a null text counts as empty and is its end token alone; without
training rows every token has probability one, and so has the end of an empty text; rows
that repeat an id are scored each; rows without an id are too, and are not trained on if
the training condition is null; an empty table gives an empty result. Only the id and
the text column are read.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.tokens import END, START, U64, mixed, slices, text_bytes, words
from quillgrid.sources.scratch import Scratch, written

BLOCK_BYTES = 12 << 20
#: Bytes of text for each range of pairs; words have a quarter as many ranges.
RANGE_BYTES = 1 << 24
DISCOUNTED = 5
SMALL = 0.01
WORD, PAIR = 1, 2
REQUEST = "level int, part int, block long, n long, keys binary, counts binary"
ANSWER = "level int, part int, block long, n long, answer binary, stats array<long>"
MESSAGE = "part int, block long, keys binary, freed binary, covered binary, event_key binary, event_row binary, event_n binary, rows binary"
RESULT = "block long, row long, id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def packed(values: np.ndarray) -> bytes:
    """A column of numbers by byte planes, compressed: planes that hold little cost little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T if len(values) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return packed(np.diff(keys, prepend=U64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U64), dtype=U64)


@dataclass(frozen=True)
class Ranges:
    """How many ranges of hashes the keys of each order are dealt to."""

    words: int
    pairs: int

    def cuts(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Where the ranges begin in sorted keys, and their end."""
        n = self.words if level == WORD else self.pairs
        edges = np.array([(p << 64) // n for p in range(1, n)], dtype=U64)
        return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


@dataclass
class Block:
    """The texts of a block as indices into its sorted distinct words and pairs."""

    ids: list
    training: np.ndarray
    texts: np.ndarray  # of each token
    n_tokens: np.ndarray
    word_keys: np.ndarray
    word: np.ndarray  # of each token
    context: np.ndarray
    pair_keys: np.ndarray
    pair: np.ndarray

    def counts(self, level: int) -> np.ndarray:
        """Training occurrences in this block. The start mark counts once a text."""
        taught = self.training[self.texts]
        if level == PAIR:
            return np.bincount(self.pair[taught], minlength=len(self.pair_keys))
        counts = np.bincount(self.word[taught], minlength=len(self.word_keys))
        counts[np.searchsorted(self.word_keys, START)] = self.training.sum()
        return counts

    @property
    def name(self) -> int:
        digest = hashlib.blake2b(repr((self.ids, len(self.word))).encode() + self.word_keys.tobytes(), digest_size=8)
        return int.from_bytes(digest.digest(), "big", signed=True)


def block_of(ids: list, training: np.ndarray, hashes: list[np.ndarray], counts: np.ndarray) -> Block:
    """hashes: the words of all texts in a row; counts: of words per text."""
    n_tokens = counts + 1
    stops = np.cumsum(n_tokens)
    tokens = np.empty(int(n_tokens.sum()), U64)
    ends = np.zeros(len(tokens), bool)
    ends[stops - 1] = True
    tokens[ends], tokens[~ends] = END, np.concatenate([np.zeros(0, U64), *hashes])
    contexts = np.concatenate([[START], tokens[:-1]])
    contexts[stops[:-1]] = START
    word_keys, index = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
    word = index[:-1]
    context = np.where(contexts == START, np.searchsorted(word_keys, START), np.concatenate([[0], word[:-1]]))
    pair_keys, pair = np.unique(mixed(contexts * U64(0x9E3779B97F4A7C15) + tokens), return_inverse=True)
    texts = np.repeat(np.arange(len(ids)), n_tokens)
    return Block(ids, training, texts, n_tokens, word_keys, word, context, pair_keys, pair)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of about BLOCK_BYTES of text. Columns: id, text, training."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        training = np.array([bool(t) for t in batch.column(2).to_pylist()], dtype=bool)
        ids = batch.column(0).to_pylist()
        for first, last in slices(bounds, BLOCK_BYTES):
            hashes, counts = [], []
            for lo, hi in slices(bounds[first : last + 1]):
                lo, hi = first + lo, first + hi
                found = words(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                hashes.append(found.hashes)
                counts.append(found.counts)
            yield block_of(ids[first:last], training[first:last], hashes, np.concatenate(counts))


def requests(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """What each block asks of each range: its keys there, and how often it saw them in training."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            name = block.name
            for level, keys in ((WORD, block.word_keys), (PAIR, block.pair_keys)):
                cuts, counts = ranges.cuts(level, keys), block.counts(level).astype(np.uint32)
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_pylist(
                    [
                        {"level": level, "part": p, "block": name, "n": int(b - a), "keys": packed_keys(keys[a:b]), "counts": packed(counts[a:b])}
                        for p, a, b in spans
                    ],
                    REQUEST_TYPE,
                )

    return rows.mapInArrow(asked, REQUEST)


REQUEST_TYPE = pa.schema(
    [("level", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
)


def answered(rows: pd.DataFrame) -> pd.DataFrame:
    """One range: the total of each key to each block that asked, twice, plus one for the block that owns it.

    stats, with the first answer: how many keys have each training count from 1 to six,
    how many more, and the sum of all counts; the start mark is no word and left out.
    """
    rows = rows.sort_values("block")
    level = int(rows["level"].iloc[0])
    keys = np.concatenate([unpacked_keys(k) for k in rows["keys"]])
    counts = np.concatenate([unpacked(c, np.uint32) for c in rows["counts"]]).astype(np.int64)
    found, first, index = np.unique(keys, return_index=True, return_inverse=True)
    totals = np.bincount(index, weights=counts).astype(np.int64)
    owned = np.zeros(len(keys), np.int64)
    owned[first] = 1
    answers = np.split((2 * totals[index] + owned).astype(U64), np.cumsum(rows["n"])[:-1])
    seen = totals[(totals > 0) & ((found != START) | (level != WORD))]
    of_counts = np.bincount(np.minimum(seen, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:]
    stats = [[*of_counts.tolist(), int(seen.sum())]] + [None] * (len(rows) - 1)
    out = rows[["level", "part", "block", "n"]]
    return out.assign(answer=[packed(a) for a in answers], stats=stats)


@dataclass(frozen=True)
class Discounts:
    """The part of a count that stays with its n-gram, for counts of one order."""

    ratios: np.ndarray  # of counts 1 to DISCOUNTED
    total: int
    distinct: int
    freed: float  # occurrences given up by all n-grams together

    @classmethod
    def of(cls, stats: list[int] | None) -> "Discounts":
        """Good-Turing, if every ratio lies between 0 and 1."""
        if not stats or not stats[-1]:
            return cls(np.ones(DISCOUNTED), 0, 0, 0.0)
        n, total = stats[: DISCOUNTED + 1], stats[-1]
        ratios = []
        if all(n):
            tail = (DISCOUNTED + 1) * n[DISCOUNTED] / n[0]
            if tail != 1:
                ratios = [((r + 1) * n[r] / n[r - 1] / r - tail) / (1 - tail) for r in range(1, DISCOUNTED + 1)]
        if not ratios or not all(0 < x < 1 for x in ratios):
            ratios = [(r - 0.5) / r for r in range(1, DISCOUNTED + 1)]
        distinct = sum(stats[:-1])
        freed = sum((1 - x) * r * k for r, (x, k) in enumerate(zip(ratios, n, strict=False), 1))
        return cls(np.array(ratios), total, distinct, freed + SMALL * (distinct - sum(n[:DISCOUNTED])))

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """counts, discounted."""
        low = np.append(0.0, self.ratios)[np.minimum(counts, DISCOUNTED)] * counts
        return np.where(counts > DISCOUNTED, counts - SMALL, low)


@dataclass(frozen=True)
class Model:
    words: Discounts
    pairs: Discounts

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words by their training count; what all words give up is the unknown word's."""
        if not self.words.total:
            return np.ones(len(counts))
        return np.where(counts > 0, self.words.kept(counts), self.words.freed) / self.words.total


def own_answers(block: Block, answers: pd.DataFrame, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Training totals of the block's keys, and which of them it owns."""
    rows = answers[answers["level"] == level].sort_values("part")
    found = np.concatenate([np.zeros(0, U64), *(unpacked(a, U64) for a in rows["answer"])])
    if len(found) != len(block.word_keys if level == WORD else block.pair_keys):
        raise RuntimeError("a block was read otherwise than when its counts were asked for; run the job again")
    return (found >> U64(1)).astype(np.int64), (found & U64(1)).astype(bool)


def scored(block: Block, answers: pd.DataFrame, model: Model, ranges: Ranges) -> Iterator[dict]:
    """A message per range of contexts: sums for its back-off weights, tokens that wait for them, and finished rows."""
    word_counts, _ = own_answers(block, answers, WORD)
    pair_counts, owned = own_answers(block, answers, PAIR)
    probability = model.word_probability(word_counts)
    of_token, of_context, of_pair = word_counts[block.word], word_counts[block.context], pair_counts[block.pair]
    seen = of_pair > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log10(np.where(seen, model.pairs.kept(of_pair) / np.maximum(of_context, 1), probability[block.word]))
    waits = ~seen & (of_context > 0)
    base = np.log10((of_token + 1) / (model.words.total + model.words.distinct + 1))
    n = len(block.ids)
    table = {
        "row": np.arange(n), "n_tokens": block.n_tokens,
        "n_known": np.bincount(block.texts, weights=of_token > 0, minlength=n).astype(np.int64),
        "base": np.bincount(block.texts, weights=base, minlength=n), "score": np.bincount(block.texts, weights=logs, minlength=n),
    }

    # Sums over the distinct words of each context, of the pairs that this block owns.
    at = np.zeros(len(block.pair_keys), np.int64)
    at[block.pair] = np.arange(len(block.pair))
    own = np.flatnonzero(owned & (pair_counts > 0))
    heads, tails, size = block.context[at[own]], block.word[at[own]], len(block.word_keys)
    given_up = pair_counts[own] - model.pairs.kept(pair_counts[own])
    freed = np.bincount(heads, weights=given_up / np.maximum(word_counts[heads], 1), minlength=size)
    covered = np.bincount(heads, weights=probability[tails], minlength=size)
    waiting, times = np.unique(block.context[waits].astype(np.int64) * n + block.texts[waits], return_counts=True)
    event_key, event_row = waiting // max(n, 1), waiting % max(n, 1)
    used = np.zeros(size, bool)
    used[heads], used[event_key] = True, True

    cuts = ranges.cuts(WORD, block.word_keys)
    rows = pd.DataFrame(table).assign(id=pd.array(block.ids, dtype="Int64"), held_out=~block.training)
    name = block.name
    home = name % (len(cuts) - 1)
    for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        inside = a + np.flatnonzero(used[a:b])
        lo, hi = np.searchsorted(event_key, [a, b])
        if not len(inside) and part != home:
            continue
        yield {
            "part": part, "block": name, "keys": packed_keys(block.word_keys[inside]),
            "freed": packed(freed[inside]), "covered": packed(covered[inside]),
            "event_key": packed(np.searchsorted(inside, event_key[lo:hi]).astype(np.uint32)),
            "event_row": packed(event_row[lo:hi].astype(np.uint32)), "event_n": packed(times[lo:hi].astype(np.uint32)),
            "rows": pa_bytes(rows) if part == home else None,
        }


def pa_bytes(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def finished(rows: pd.DataFrame) -> pd.DataFrame:
    """One range of contexts: its back-off weights, and per text the sum of those that it waits for."""
    keys = [unpacked_keys(k) for k in rows["keys"]]
    found, index = np.unique(np.concatenate([np.zeros(0, U64), *keys]), return_inverse=True)
    sums = [
        np.bincount(index, weights=np.concatenate([np.zeros(0), *(unpacked(v, np.float64) for v in rows[c])]), minlength=len(found))
        for c in ("freed", "covered")
    ]
    weight = np.log10(np.maximum(sums[0], 1e-300)) - np.log10(np.maximum(1 - sums[1], 1e-12))
    out, at = [], 0
    for row, own in zip(rows.itertuples(), keys, strict=True):
        mine = weight[index[at : at + len(own)]]
        at += len(own)
        event_row, times = unpacked(row.event_row, np.uint32), unpacked(row.event_n, np.uint32)
        if len(event_row):
            texts, which = np.unique(event_row, return_inverse=True)
            sums_of = np.bincount(which, weights=mine[unpacked(row.event_key, np.uint32)] * times)
            out.append(pd.DataFrame({"block": row.block, "row": texts.astype(np.int64), "score": sums_of}))
        if row.rows is not None:
            out.append(pa.ipc.open_stream(row.rows).read_pandas().assign(block=row.block))
    columns = [c.split()[0] for c in RESULT.split(", ")]
    return pd.concat(out).reindex(columns=columns) if out else pd.DataFrame(columns=columns)


def katz_scores(documents: DataFrame, training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score, of each row.

    training: which rows (columns id and text) the model learns from; score is the log10
    probability of the whole text, base_score that of single words with one added.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.select("id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = Ranges(max(1, size // (4 * RANGE_BYTES)), max(1, size // RANGE_BYTES))
    scratch = Scratch(spark, "katz")
    with scratch:
        asked = requests(rows, ranges).groupBy("level", "part").applyInPandas(answered, ANSWER)
        answers = scratch.written(asked)
        sums = [F.sum(F.col("stats")[i]).alias(f"n{i}") for i in range(DISCOUNTED + 3)]
        stats = {r["level"]: [r[f"n{i}"] or 0 for i in range(DISCOUNTED + 3)] for r in answers.groupBy("level").agg(*sums).collect()}
        model = Model(Discounts.of(stats.get(WORD)), Discounts.of(stats.get(PAIR)))
        result = written_scores(rows, answers, model, ranges, scratch)
        totals = result.groupBy("block", "row").agg(
            F.max("id").alias(key), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            F.max("n_known").alias("n_known"), F.max("base").alias("base_score"), F.sum("score").alias("score"),
        )
        tokens = F.lit(model.words.total).cast("long").alias("train_tokens")
        return written(totals.select(key, "held_out", "n_tokens", "n_known", tokens, "base_score", "score"), "katz")


def packed_blocks(rows: DataFrame) -> DataFrame:
    """block and its rows, compressed: what meets the block's answers."""

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = text_bytes(batch.column(1))[1]
            for first, last in slices(bounds, BLOCK_BYTES):
                part = pa.RecordBatch.from_arrays([c.slice(first, last - first) for c in batch.columns], schema=batch.schema)
                name = next(blocks(iter([part]))).name
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.record_batch([pa.array([name]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

    return rows.mapInArrow(shipped, "block long, texts binary")


def written_scores(rows: DataFrame, answers: DataFrame, model: Model, ranges: Ranges, scratch: Scratch) -> DataFrame:
    """Rows and parts of scores, as the ranges of contexts give them."""

    def score(texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part in texts["texts"]:
            for block in blocks(iter(pa.ipc.open_stream(part))):
                out += scored(block, own, model, ranges)
        return pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGE.split(", ")])

    left, right = packed_blocks(rows).groupBy("block"), answers.drop("stats").groupBy("block")
    messages = left.cogroup(right).applyInPandas(score, MESSAGE)
    return messages.groupBy("part").applyInPandas(finished, RESULT)
