"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python loop per word.

A word's hash is a sum of random codes of its bytes, each multiplied by a random odd
factor of its place, then mixed; A-Z count as a-z. Texts are handled in slices of about
two million bytes (a longer text is a slice of its own), which bounds memory; what runs
in the stages of the pipeline, whose workers keep their high-water marks, takes a quarter.
Those stages also ask for small batches of rows (`small_batches`).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES, SMALL_SLICE = 1 << 21, 1 << 19
#: Two small slices. Spark's own limits are 10,000 rows and 64 MB.
BATCH_BYTES = 1 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
U64 = np.uint64
#: Marks the end of a text, and its start where a model needs one.
END, START = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finisher)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


def byte_codes(separators: bytes) -> np.ndarray:
    codes = random_words(256, 1)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    codes[list(separators)] = 0
    return codes


SPACES = bytes([32, *range(9, 14)])
#: Everything in ASCII but letters and digits.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
_places = random_words(4096, 7) | U64(1)


def places(n: int) -> np.ndarray:
    global _places
    if n > len(_places):
        _places = random_words(max(n, 2 * len(_places)), 7) | U64(1)
    return _places


@dataclass(frozen=True)
class Words:
    """hashes: of each word; bounds: of each text in hashes; starts, ends: bytes of each word in data."""

    hashes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts (null: empty), and each text's bounds in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python workers in batches of about BATCH_BYTES (a longer row is a batch of its own).

    A batch is held by the executor, by the worker, and again by what the worker makes of
    it, and neither gives back what it once took: with whole batches of 10,000 texts that
    adds up over the stages of a pipeline. Frames are planned when they are run, so the
    limit stays; one that is lower already is left.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_LIMIT))
    if now > BATCH_BYTES:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most `limit` bytes; a longer text is a run of its own."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, bounds: np.ndarray, separators: bytes = SPACES, prefix: int | None = None) -> Words:
    """Words are runs of bytes that are no separators; none crosses texts. prefix: hash only so many first bytes."""
    codes = byte_codes(separators)[data]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    inside = inside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Words(np.zeros(0, U64), np.zeros(len(bounds), np.int64), starts, starts)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    factors = places(int(place.max()) + 1)[place]
    if prefix is not None:
        factors[place >= prefix] = 0
    hashes = mixed(np.add.reduceat(codes[starts[0] :] * factors, starts - starts[0]))
    return Words(hashes, np.searchsorted(starts, bounds), starts, ends)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text, and each text's bounds in them.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    n, counts = len(found.hashes), found.counts
    end = np.repeat(found.bounds[1:], counts)
    at = np.arange(n)
    factors = random_words(size, 11) | U64(1)
    total = np.zeros(n, U64)
    for j in range(min(size, n)):
        total[: n - j] += np.where(at[: n - j] + j < end[: n - j], found.hashes[j:] * factors[j], U64(0))
    short = np.repeat(counts < size, counts) & (at == np.repeat(found.bounds[:-1], counts))
    kept = (at + size <= end) | short
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    return mixed(total[kept]), np.concatenate([[0], np.cumsum(sizes)])


def binary_rows(values: np.ndarray) -> pa.Array:
    """One binary value per row of a contiguous matrix."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * int(np.prod(values.shape[1:]))
    offsets = np.arange(len(values) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
