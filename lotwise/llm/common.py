"""Helpers of the operators: text of Arrow batches as bytes, words in numpy, checkpoints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lotwise.functions.batches import SLICE_BYTES as SLICE_BYTES
from lotwise.functions.batches import slices as slices
from lotwise.session import ensure_checkpoint_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a written copy in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    held = array.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(array) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def byte_table(separators: Iterator[int]) -> np.ndarray:
    """True for bytes that belong to words; bytes of non-ASCII characters always do."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


# Word separators of `[^\x20\x09-\x0D]+` and of
# `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
SPACE_WORDS = byte_table([0x20, *range(0x09, 0x0E)])
LOWER_WORDS = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(int(base), -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[int(base)] = (np.cumprod(up, out=up), np.cumprod(down, out=down))
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_table(base, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out, down


@dataclass
class Words:
    """Words of some texts: byte bounds, hashes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def runs(self, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each word on; runs may cross texts."""
        if len(self.hashes) < length:
            return np.zeros(0, np.uint64)
        sums, down = _sums(self.hashes, _WORD_BASE)
        n = len(self.hashes) - length + 1
        return mix((sums[length:] - sums[:n]) * down[:n])

    def text(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of word bytes within each text, with a 64-bit hash of each."""
    inside = table[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span."""
    up, down = _power_table(_BASE, len(data) + 1)
    # In place: an array here has eight bytes for each of the text.
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= up[: len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return data + ((data >= 0x41) & (data <= 0x5A)).astype(np.uint8) * np.uint8(0x20)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """True at each of ``n`` places that lies in one of the runs."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0
