"""Benchmark decontamination by Wu-Manber search for many word windows at once."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import LOWER_WORDS, covered, lower_ascii, slices, split_words, text_bytes

WINDOW = 10  # words of one test string
PASS_BYTES = 32 << 20  # benchmark text searched for in one pass; more text means more passes
_LANE = 512  # words that one lane of the search walks over
_BLOCK_BASE = np.uint64(0x9E3779B97F4A7C15)

_FOUND = "array<struct<start:int,length:int>>"


class Patterns:
    """Test strings of one length: shift table over blocks, buckets by suffix block."""

    def __init__(self, length: int, strings: dict[bytes, list[str]]) -> None:
        self.length, self.block = length, min(2, length)
        self.strings, self.items = list(strings), list(strings.values())
        text = [s.split(b" ") for s in self.strings]
        data = np.frombuffer(b" ".join(self.strings), np.uint8)
        words = split_words(data, np.array([0, len(data)]), LOWER_WORDS)
        blocks = self.blocks(words.hashes).reshape(len(text), length)
        self.bits = np.uint64(64 - max(16, int(blocks.size * 32).bit_length()))
        self.shift = np.full(1 << (64 - int(self.bits)), length - self.block + 1, np.uint8 if length < 255 else np.int32)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, (blocks[:, end] >> self.bits).astype(np.int64), length - 1 - end)
        # Buckets: test strings in the order of their suffix block, then of their full hash.
        whole = words.runs(length)[:: length] if len(words.hashes) else np.zeros(0, np.uint64)
        order = np.lexsort((whole, blocks[:, -1]))
        self.suffix, self.whole, self.order = blocks[order, -1], whole[order], order

    def blocks(self, hashes: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at each word."""
        if self.block == 1 or not len(hashes):
            return hashes * _BLOCK_BASE
        return np.concatenate((hashes[:1], hashes[1:] + hashes[:-1] * np.uint64(3))) * _BLOCK_BASE

    def zero_shifts(self, blocks: np.ndarray) -> np.ndarray:
        """Ends of windows that the shift table cannot skip; all lanes walk together."""
        n, step = len(blocks), self.length - 1
        at = np.arange(0, max(0, n - step), _LANE) + step
        stop = np.minimum(at + _LANE, n)
        stay = []
        while len(at):
            shift = self.shift[(blocks[at] >> self.bits).astype(np.int64)]
            stay.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            inside = at < stop
            at, stop = at[inside], stop[inside]
        return np.sort(np.concatenate(stay)) if stay else np.zeros(0, np.int64)

    def find(self, words, lowered: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, test string) of every occurrence that lies in one text."""
        if len(words.hashes) < self.length:
            return
        blocks = self.blocks(words.hashes)
        ends = self.zero_shifts(blocks)
        starts = ends - self.length + 1
        whole = words.runs(self.length)
        same = text[starts] == text[ends]
        starts, ends = starts[same], ends[same]
        low, high = np.searchsorted(self.suffix, blocks[ends], "left"), np.searchsorted(self.suffix, blocks[ends], "right")
        some = low < high
        starts, low, high = starts[some], low[some], high[some]
        for start, lo, hi in zip(starts.tolist(), low.tolist(), high.tolist()):
            a = lo + int(np.searchsorted(self.whole[lo:hi], whole[start], "left"))
            while a < hi and self.whole[a] == whole[start]:
                pattern = int(self.order[a])
                own = b" ".join(lowered[s:e].tobytes() for s, e in zip(words.starts[start : start + self.length].tolist(), words.ends[start : start + self.length].tolist()))
                if own == self.strings[pattern]:
                    yield start, pattern
                a += 1


def windows_of(items: Iterable[tuple[str, str]], window: int = WINDOW) -> dict[int, dict[bytes, list[str]]]:
    """Test strings by length, each with the items that hold it; an item without words has none."""
    out: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        lowered = lower_ascii(data)
        words = split_words(lowered, np.array([0, len(data)]), LOWER_WORDS)
        own = [lowered[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
        length = min(window, len(own))
        for i in range(len(own) - length + 1 if own else 0):
            held = out[length][b" ".join(own[i : i + length])]
            if item is not None and item not in held:
                held.append(item)
    return {n: dict(x) for n, x in out.items()}


def _search(tables: list[Patterns], carry: list[str] | None):
    """One pass over the texts; with ``carry`` the last one, which gives results instead of runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                lowered = lower_ascii(data)
                words = split_words(lowered, offsets, LOWER_WORDS)
                text = words.text()
                runs, items = part.column("_runs").to_pylist(), [set(x) for x in part.column("_items").to_pylist()]
                for table in tables:
                    for start, pattern in table.find(words, lowered, text):
                        row = int(text[start])
                        runs[row].append({"start": start - int(words.first[row]), "length": table.length})
                        items[row].update(table.items[pattern])
                named = [sorted(x) for x in items]
                if carry is None:
                    held = {n: part.column(n) for n in part.schema.names}
                    held |= {"_runs": pa.array(runs, part.schema.field("_runs").type), "_items": pa.array(named, part.schema.field("_items").type)}
                    yield pa.RecordBatch.from_arrays(list(held.values()), schema=part.schema)
                else:
                    yield _results(part, carry, np.diff(words.first), runs, named)

    return run


def _results(part: pa.RecordBatch, carry: list[str], n_words: np.ndarray, runs: list, items: list) -> pa.RecordBatch:
    hit = []
    for n, own in zip(n_words.tolist(), runs):
        starts, lengths = (np.array([r[k] for r in own], np.int64) for k in ("start", "length"))
        hit.append(int(covered(starts, lengths, n).sum()) if own else 0)
    columns = {n: part.column(n) for n in carry} | {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(hit, pa.int64()),
        "n_items": pa.array([len(x) for x in items], pa.int64()),
        "item_ids": pa.array(items, pa.list_(pa.string())),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
        "contaminated": pa.array([h > 0 for h in hit], pa.bool_()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Words of each text that lie in a benchmark window, and the items these windows come from.

    Benchmark text is searched for in passes of at most ``PASS_BYTES``, so that no task holds more
    test strings than that; every pass goes over all documents within the same stage. An item of
    fewer than ``window`` words is one shorter window. Returns the columns named in ``carry``, then
    n_words, n_hit, n_items, item_ids (sorted as strings), items_sha256 and contaminated. Null or
    empty texts and items have no words, a null item_id is named nowhere, repeated rows are judged
    one by one, other columns are not read.
    """
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    keep = list(dict.fromkeys([*carry, "text"]))
    out = docs.select(*keep, F.expr(f"cast(array() as {_FOUND})").alias("_runs"), F.expr("cast(array() as array<string>)").alias("_items"))
    types = dict(docs.dtypes)
    result = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, contaminated boolean"])
    for number in range(passes):
        # The items of one pass; their size was checked above.
        chunk = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number) if passes > 1 else rows
        tables = [Patterns(n, strings) for n, strings in sorted(windows_of((r["item"], r["text"]) for r in chunk.toLocalIterator()).items())]
        last = number == passes - 1
        out = out.mapInArrow(_search(tables, list(carry) if last else None), result if last else out.schema)
    return out
