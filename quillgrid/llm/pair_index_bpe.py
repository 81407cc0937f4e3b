"""Byte-pair encoding and decoding with an index from each pair to all its positions.

The distinct words of an Arrow batch become one row of symbols. An index maps every
mergeable pair, by its rank, to the positions where it stands; the lowest active rank is
applied to all its positions at once, and the positions of the pairs that this makes are
filed under their ranks, until no rank is left. Each word is encoded once per part of a
batch, and the part bounds the memory. The vocabulary is a public tokenizer's file, never trained.

Defined results: a null text counts as empty and has no ids and an empty decoded text;
texts are encoded whole, whatever their length; repeated rows are encoded alike; an
empty table gives an empty result. Strings of special tokens inside a text are those
tokens. Only the key and the text column are read.
"""

import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from quillgrid.llm.tokens import slices, small_batches, text_bytes

#: Bytes of text whose words are indexed together: bounds memory.
PART_BYTES = 1 << 20
SCHEMA = "{key} long, ids array<int>, decoded string"


class Numbering(dict):
    """Numbers words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Vocabulary:
    """What a tokenizer file of this kind says: words by a pattern, lower case, byte symbols, word ends."""

    def __init__(self, definition: str):
        parts = json.loads(definition)
        model = parts["model"]
        ids = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        split = parts["pre_tokenizer"]["pretokenizers"][0]
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

        # Bytes that print stand for themselves, the others for the code points from 256 on.
        printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in printing}
        letters |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}
        end = model["end_of_word_suffix"]
        self.byte_ids = np.array([ids[letters[b]] for b in range(256)])
        self.last_byte_ids = np.array([ids[letters[b] + end] for b in range(256)])

        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs])
        self.right = np.array([ids[b] for _, b in pairs])
        self.made = np.array([ids[a + b] for a, b in pairs])
        self.size = 1 + max(*ids.values(), *special.values())
        keys = self.left * self.size + self.right
        self.ranks = np.argsort(keys, kind="stable")
        self.keys = keys[self.ranks]
        tokens = [""] * self.size
        for token, number in (ids | special).items():
            tokens[number] = token
        self.tokens = pa.array(tokens, pa.string())

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which two symbols merge, -1 for never."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if self.special_split is None:
            return self.plain_words(text)
        found = []
        for i, part in enumerate(self.special_split.split(text)):
            found += [part] if i % 2 else self.plain_words(part)
        return found

    def plain_words(self, text: str) -> list[str]:
        # Lower case goes letter by letter, so a capital sigma has one form wherever it stands.
        return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and each word's bounds in them."""
        raw = [b"" if w in self.special else w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        stops = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.byte_ids[data]
        lasts = stops[lengths > 0] - 1
        symbols[lasts] = self.last_byte_ids[data[lasts]]
        following = np.arange(1, len(data) + 1)
        following[lasts] = -1
        before = np.arange(-1, len(data) - 1)
        before[stops[lengths > 0] - lengths[lengths > 0]] = -1
        self.merge(symbols, following, before)

        alive = symbols >= 0
        owners = np.repeat(np.arange(len(words)), lengths)[alive]
        counts = np.bincount(owners, minlength=len(words))
        found = symbols[alive]
        if any(w in self.special for w in words):
            of_word = np.split(found, np.cumsum(counts)[:-1])
            of_word = [np.array([self.special[w]]) if w in self.special else x for w, x in zip(words, of_word, strict=True)]
            counts, found = np.array([len(x) for x in of_word]), np.concatenate(of_word)
        return found, np.concatenate([[0], np.cumsum(counts)])

    def merge(self, symbols: np.ndarray, following: np.ndarray, before: np.ndarray) -> None:
        """Merge in place, lowest rank first; a position that is merged into its left neighbour becomes -1."""
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(positions: np.ndarray) -> None:
            ranks = self.rank_of(symbols[positions], symbols[following[positions]])
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            heads = np.flatnonzero(np.diff(ranks, prepend=-1))
            for rank, chunk in zip(ranks[heads].tolist(), np.split(positions, heads[1:]), strict=False):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(chunk)

        file(np.flatnonzero(following >= 0))
        while active:
            rank = heapq.heappop(active)
            a, b = self.left[rank], self.right[rank]
            at = np.unique(np.concatenate(index.pop(rank)))
            at = at[(symbols[at] == a) & (following[at] >= 0)]
            at = at[symbols[following[at]] == b]
            if a == b:
                at = self.without_overlaps(at, following)
            if not len(at):
                continue
            taken = following[at]
            after = following[taken]
            symbols[at], symbols[taken] = self.made[rank], -1
            following[at] = after
            before[after[after >= 0]] = at[after >= 0]
            left = before[at]
            file(np.concatenate([left[left >= 0], at[after >= 0]]))

    @staticmethod
    def without_overlaps(at: np.ndarray, following: np.ndarray) -> np.ndarray:
        """From the left, the positions whose first symbol no earlier one takes."""
        kept, taken = [], -1
        for position in at.tolist():
            if position != taken:
                kept.append(position)
                taken = int(following[position])
        return np.array(kept, dtype=np.int64)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text."""
        numbering = Numbering()
        of_text = [np.array([numbering[w] for w in self.words(t or "")], dtype=np.int64) for t in texts]
        found, bounds = self.encode_words(list(numbering))
        used = np.concatenate([np.zeros(0, np.int64), *of_text])
        lengths = np.diff(bounds)[used]
        stops = np.cumsum(lengths)
        ids = found[np.repeat(bounds[:-1][used] - (stops - lengths), lengths) + np.arange(lengths.sum())]
        stops = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum([len(x) for x in of_text])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token strings joined by a space: what a file without a decoder says, special tokens included."""
        tokens = pa.ListArray.from_arrays(ids.offsets, self.tokens.take(ids.values))
        return pc.binary_join(tokens, " ")


def encode_documents(documents: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids, decoded of each whole text."""
    small_batches(documents.sparkSession)
    definition = documents.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text(encoding="utf-8"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = None
        for batch in batches:
            vocabulary = vocabulary or Vocabulary(definition.value)
            for lo, hi in slices(text_bytes(batch.column(1))[1], PART_BYTES):
                part = batch.slice(lo, hi - lo)
                ids = vocabulary.encode(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), ids, vocabulary.decode(ids)], names=[key, "ids", "decoded"])

    rows = documents.select(documents[key].cast("long").alias(key), documents[text].alias(text))
    return rows.mapInArrow(encoded, SCHEMA.format(key=key))
