"""Words of Arrow batches as numbers, for the operators that learn from text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text bytes handled at once, however long a batch is; a longer text is handled by itself.
SLICE_BYTES = 4 << 20


@dataclass
class Words:
    """Texts as tokens: ``words`` are distinct, ``index`` has a number into them per token, ``bounds`` the tokens of each text."""

    words: list[str]
    index: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        """The number of its text per token."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split_words(texts: pa.Array, *, letters_only: bool) -> Words:
    """Words of texts: runs of letters in lower case, or what blanks part. Null texts have none."""
    texts = pc.fill_null(texts, "")
    if letters_only:
        texts = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    words, index, bounds = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), bounds - bounds[0]
    if "" in words:
        present = index != words.index("")
        bounds = np.concatenate(([0], np.cumsum(present)))[bounds]
        index = index[present]
    return Words(words, index, bounds)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
        yield first, last - first
        first = last


def sampled(share: float | Column, *columns: str) -> Column:
    """True for about ``share`` of the rows, the same rows each time: by a hash of their columns."""
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1_000_000)) < F.ceil(F.lit(1_000_000) * share)


def release_memory() -> None:
    """Give memory that is no longer used back to the system: workers are reused, and what one task took else stays with the process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


class Adam:
    """Gradient steps with momentum and per-weight scale."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.n, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> None:
        self.n += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        weights -= self.rate * (self.m / (1 - 0.9**self.n)) / (np.sqrt(self.v / (1 - 0.99**self.n)) + 1e-8)
