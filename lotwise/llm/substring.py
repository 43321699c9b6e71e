"""Substring dedup with compressed FM-indexes: repeated runs of words, removed but for the first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import SLICE_BYTES, SPACE_WORDS, Words, checkpointed, covered, mix, slices, split_words, text_bytes

WINDOW = 20  # words that must repeat
GRAM = 6  # words of an anchor; a window's anchor is its gram of lowest hash
HOT = 2000  # occurrences from which an anchor's windows are dealt out one by one
SHARD_WORDS = 300_000
HELD_SEGMENTS = 100_000  # distinct segments a task keeps before it passes them on
_HASH_BYTES = 5  # of each word's hash in a segment
_DIGEST_BYTES = 12  # of a segment's identity


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments: runs of windows of one text that share an anchor.

    Returns first window, number of windows, text and anchor of each segment.
    """
    n = len(words.hashes) - WINDOW + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, np.zeros(0, np.uint64)
    grams, wide = words.runs(GRAM), WINDOW - GRAM + 1
    # The place is kept in the low bits; minima over the window by doubling.
    low = np.uint64(0xFFFF)
    best = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    size = 1
    while size * 2 <= wide:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[:n], best[wide - size : wide - size + n])
    start = np.arange(n)
    place = start + ((best & low).astype(np.int64) - start) % 65536
    text = words.text()
    whole = text[:n] == text[WINDOW - 1 :]
    start, place, text = start[whole], place[whole], text[:n][whole]
    if not len(start):
        return empty, empty, empty, np.zeros(0, np.uint64)
    edge = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    return start[edge], np.diff(np.append(edge, len(start))), text[edge], mix(grams[place[edge]])


def _emit_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            _, _, text, anchor = anchors(split_words(*text_bytes(part.column("text")), SPACE_WORDS))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(part.column("key").to_numpy()[text])], ["anchor", "key"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way through the shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [None if t is None else press.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(packed, pa.binary()))


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spread = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES // 3):
            texts = [None if t is None else spread.decompress(t).decode() for t in part.column("text").to_pylist()]
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def _segments(part: pa.RecordBatch) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Segments whose anchor occurs elsewhere too, those of hot anchors window by window: their
    digest and word hashes, the text and first word of each, and the shard it goes to."""
    words = split_words(*text_bytes(part.column("text")), SPACE_WORDS)
    first, count, text, anchor = anchors(words)
    kept = _among(anchor, _flat(part.column("anchors")))
    first, count, text, anchor = first[kept], count[kept], text[kept], anchor[kept]
    hot = _among(anchor, _flat(part.column("hot")))
    parts = np.where(hot, count, 1)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, count, text = np.repeat(first, parts) + number, np.repeat(np.where(hot, 1, count), parts), np.repeat(text, parts)
    packed = np.ascontiguousarray((words.hashes >> np.uint64(64 - 8 * _HASH_BYTES)).view(np.uint8).reshape(-1, 8)[:, :_HASH_BYTES]).tobytes()
    held = [packed[a * _HASH_BYTES : b * _HASH_BYTES] for a, b in zip(first.tolist(), (first + count + WINDOW - 1).tolist())]
    segment = [hashlib.blake2b(h, digest_size=_DIGEST_BYTES).digest() for h in held]
    own = np.array([int.from_bytes(s[:8], "little", signed=True) for s in segment], np.int64)
    shard = np.where(np.repeat(hot, parts), own, np.repeat(anchor.view(np.int64), parts))
    return segment, held, text, first - words.first[text], shard


def _flat(lists: pa.Array) -> np.ndarray:
    return np.sort(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _emit_distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments of a task, each with its first place; a hot one leaves a task once."""
    held: dict[bytes, tuple] = {}

    def packed() -> pa.RecordBatch:
        at = [h[0] for h in held.values()]
        columns = [
            pa.array([h[1] for h in held.values()], pa.int64()), pa.array(list(held), pa.binary()), pa.array([None if a[0] else a[1] for a in at], pa.int64()),
            pa.array([a[2] for a in at], pa.int32()), pa.array([h[2] for h in held.values()], pa.binary()),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_id", "start", "words"])

    for part in _unpacked(batches):
        docs = part.column("doc_id").to_pylist()
        for segment, words, text, start, shard in zip(*(x if isinstance(x, list) else x.tolist() for x in _segments(part))):
            at = (docs[text] is None, docs[text] or 0, start)
            known = held.get(segment)
            if known is None or at < known[0]:
                held[segment] = (at, shard, words)
        if len(held) >= HELD_SEGMENTS:
            yield packed()
    if held:
        yield packed()


def _emit_places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _unpacked(batches):
        segment, _, text, start, _ = _segments(part)
        at = pa.array(text, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(segment, pa.binary()), part.column("doc_id").take(at), pa.array(start, pa.int32()), part.column("key").take(at)], ["segment", "doc_id", "start", "key"])


def _among(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
    return ranked[at] == values


class WaveletTree:
    """Symbols as one bit vector per level with counts per 64 bits (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels = []
        for level in range(levels - 1, -1, -1):
            ones = (symbols >> level & 1).astype(bool)
            padded = np.zeros(-(-(len(ones) + 1) // 64) * 64, np.uint8)
            padded[: len(ones)] = ones
            bits = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(bits) + 1, np.int32)
            np.cumsum(np.bitwise_count(bits), out=before[1:])
            self.levels.append((level, bits, before, len(ones) - int(ones.sum())))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place, all places at once; see ``first``."""
        for level, bits, before, zeros in self.levels:
            block = at >> 6
            ones = before[block] + np.bitwise_count(bits[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index over a text of whole numbers; backward search reaches ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, n = text, len(text)
        self.suffixes = suffix_order(text, depth)
        sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.tree = WaveletTree(text[self.suffixes - 1], max(1, int(sigma - 1).bit_length()))
        # What rank() gives for each symbol at place 0.
        self.base = self.tree.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns that have one more symbol in front."""
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        shift = self.first[symbol] - self.base[symbol]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def matches(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics at the end of each window, up to ``length``: how many of its last
        symbols occur elsewhere too; and the intervals, which are of whole windows where it is all."""
        symbol = self.text[starts + length - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        statistic = np.zeros(len(starts), np.int64)
        active = np.flatnonzero(high - low > 1)
        statistic[active] = 1
        for step in range(2, length + 1):
            a, b = self.extend(self.text[starts[active] + length - step], low[active], high[active])
            low[active], high[active] = a, b
            active = active[b - a > 1]
            statistic[active] = step
            if not len(active):
                break
        return statistic, low, high


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least, by prefix doubling."""
    rank, size, n = text.astype(np.int64), 1, len(text)
    order = np.argsort(rank, kind="stable")
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        key = rank * (int(rank.max()) + 2 + n) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        size *= 2
    return order


def repeated_windows(segments: list[bytes], doc: np.ndarray, start: np.ndarray, window: int = WINDOW) -> list[int]:
    """For each segment a number whose bit j says that its window j starts earlier elsewhere.

    ``doc`` and ``start`` tell where each segment is found first; ``doc`` are ranks of documents.
    """
    sizes = np.array([len(s) // _HASH_BYTES for s in segments])
    raw = np.zeros((int(sizes.sum()), 8), np.uint8)
    raw[:, :_HASH_BYTES] = np.frombuffer(b"".join(segments), np.uint8).reshape(-1, _HASH_BYTES)
    names, words = np.unique(raw.view(np.uint64).ravel(), return_inverse=True)
    # Segments behind each other, each closed by symbol 1; symbol 0 ends the text.
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.ones(int((sizes + 1).sum()) + 1, np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
    text[place] = words + 2
    text[-1] = 0
    index = FMIndex(text, window)
    count = sizes - window + 1
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    which = np.repeat(np.arange(len(sizes)), count)
    statistic, low, high = index.matches(begin[which] + number, window)
    found = np.zeros(len(text), np.int64)
    found[place] = (doc.astype(np.int64)[np.repeat(np.arange(len(sizes)), sizes)] << 32) + np.repeat(start, sizes) + (np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    out = [0] * len(segments)
    full = np.flatnonzero(statistic == window)
    if len(full):
        # Intervals of different windows are apart, so their minima cost no more than the text.
        opened, first = np.unique(low[full], return_index=True)
        closed = high[full][first]
        earliest = np.minimum.reduceat(np.append(found[index.suffixes], np.iinfo(np.int64).max), np.column_stack((opened, closed)).ravel())[::2]
        own = found[begin[which[full]] + number[full]]
        for i in full[earliest[np.searchsorted(opened, low[full])] < own].tolist():
            out[which[i]] |= 1 << int(number[i])
    return out


def _index_shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; as many whole shards as hold ``SHARD_WORDS`` share one index."""
    held: list[tuple] = []
    size, last = 0, None

    def judged() -> pa.RecordBatch:
        docs = [(d is None, d or 0) for _, d, _, _ in held]
        ranks = {d: i for i, d in enumerate(sorted(set(docs)))}
        masks = repeated_windows([h[3] for h in held], np.array([ranks[d] for d in docs]), np.array([h[2] for h in held], np.int64))
        columns = [pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.int32()), pa.array(masks, pa.int64())]
        whole = [(1 << (len(h[3]) // _HASH_BYTES - WINDOW + 1)) - 1 for h in held]
        return pa.RecordBatch.from_arrays([*columns, pa.array(whole, pa.int64())], ["segment", "first_doc", "first_start", "mask", "all"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "doc_id", "start", "words")))
        for shard, segment, doc, start, words in rows:
            if size >= SHARD_WORDS and shard != last:
                yield judged()
                held, size = [], 0
            held.append((segment, doc, start, words))
            size += len(words) // _HASH_BYTES
            last = shard
    if held:
        yield judged()


def _remove(carry: list[str], with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            n_words, n_removed, digest, texts = [], [], [], []
            marks = batch.column("marks").to_pylist()
            for i, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                words = text.encode().split()
                gone = 0
                if marks[i]:
                    starts = np.array([m["start"] + j for m in marks[i] for j in range(m["mask"].bit_length()) if m["mask"] >> j & 1], np.int64)
                    out = covered(starts, np.full(len(starts), WINDOW), len(words))
                    gone = int(out.sum())
                    n_words.append(len(words))
                    words = [w for w, o in zip(words, out.tolist()) if not o]
                else:
                    n_words.append(len(words))
                n_removed.append(gone)
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode() if gone else value.as_py())
            columns = {n: batch.column(n) for n in carry} | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                columns["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Remove every word covered by a 20-word window that also starts earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start; a null doc_id comes
    last. Windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Returns the
    columns of ``carry``, then n_words, n_removed and kept_sha256 (of the kept words joined by one
    space), and with ``with_text`` kept_text: the text as it was where nothing is removed. A null or
    empty text has no words; rows of one doc_id with one text are one document and fare alike.

    Windows are dealt out by content: every window has an anchor, its six-word gram of lowest hash,
    and consecutive windows of one anchor form a segment. Only segments whose anchor occurs at least
    twice go on, equal ones as one. They meet by anchor in shards; each shard's FM-index answers
    backward searches for all its windows. Anchors of more than ``HOT`` occurrences send their
    windows to shards one by one, so no shard grows with a hot passage.
    """
    keyed = docs.select(*dict.fromkeys([*carry, "doc_id", "text"])).withColumn("key", F.xxhash64("doc_id", "text"))
    seen = keyed.select("key", "text").where(F.col("text").isNotNull()).mapInArrow(_emit_anchors, "anchor long, key long")
    # Written, so that the join gets both sides from a shuffle and a hot anchor's rows can be split.
    often = checkpointed(seen.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    shared = seen.join(often, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))

    packed = keyed.mapInArrow(_pack, keyed.withColumn("text", F.col("text").cast("binary")).schema)
    # All columns go along, so that this shuffle of the texts is the one that the last join uses.
    asked = packed.join(checkpointed(shared), "key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    whole = asked.mapInArrow(_emit_distinct, "shard long, segment binary, doc_id long, start int, words binary")
    # Dealt out by shard once; equal segments have the same shard, so they meet without another shuffle.
    distinct = whole.repartition("shard").groupBy("shard", "segment").agg(F.min(order).alias("at"), F.first("words").alias("words"))
    dealt = distinct.select("shard", "segment", F.col("at.doc_id").alias("doc_id"), F.col("at.start").alias("start"), "words")
    judged = dealt.sortWithinPartitions("shard").mapInArrow(_index_shards, "segment binary, first_doc long, first_start int, mask long, all long")
    places = asked.mapInArrow(_emit_places, "segment binary, doc_id long, start int, key long")
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    # A later place repeats all windows of its segment.
    mask = F.when(first, F.col("mask")).otherwise(F.col("all"))
    marks = places.join(judged, "segment").select("key", "start", mask.alias("mask")).where(F.col("mask") != 0)
    gathered = marks.groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    types = dict(docs.dtypes)
    result = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "n_words long, n_removed long, kept_sha256 string", *["kept_text string"] * with_text])
    return packed.join(gathered, "key", "left").drop("key").mapInArrow(_remove(list(carry), with_text), result)
