"""Token ids in files of fixed-width bit fields, read back by block and by document.

A volume holds whole documents of one shard, little-endian: a header, the byte offset of every block,
the documents (id, whether it is null, place of their first id), and the blocks. A block is
``block_ids`` ids of the least number of bits that the vocabulary needs, the lowest bits first, and
is a whole number of 8-byte words, so any block can be unpacked alone and at once with numpy. Shards
follow each other in the order of document ids. Volumes are the rows of a Parquet table, so that
Spark commits them, a lost executor's are written again, and counts are read without the ids.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.bpe import ASCII_PIECE, PIECE, byte_characters
from lotwise.llm.common import slices

MAGIC = b"LWTOKENS"
_HEADER = struct.Struct("<8sIIIIQQQ")
BLOCK_IDS = 8192  # a multiple of 64, so that a block is whole words of 8 bytes at any width
VOLUME_IDS = 1 << 20  # a volume ends after the document that reaches so many
CACHED_WORDS = 1 << 19  # different words whose ids a worker keeps
# Characters up to U+024F are composed already; the dotted capital I alone has a lower case of two.
_LATIN = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch
SHARD_ROWS = 1 << 20  # shards whose places are sent to every task; beyond, they are joined


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in fields of ``bits`` bits, filled up to a whole number of 8-byte words."""
    share = math.gcd(bits, 64)
    period, words = 64 // share, bits // share
    rows = -(-len(ids) // period)
    held = np.zeros(rows * period, np.uint64)
    held[: len(ids)] = ids
    held, out = held.reshape(rows, period), np.zeros((rows, words), np.uint64)
    for j in range(period):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= held[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= held[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed fields as unsigned 32-bit integers."""
    share = math.gcd(bits, 64)
    period, words = 64 // share, bits // share
    rows = -(-n // period)
    held = np.frombuffer(data, "<u8", rows * words).reshape(rows, words)
    out, mask = np.empty((rows, period), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(period):
        word, shift = divmod(j * bits, 64)
        field = held[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            field = field | (held[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = field & mask
    return out.reshape(-1)[:n]


class Volume:
    """A volume's bytes, opened: nothing is unpacked until it is asked for."""

    def __init__(self, data: bytes) -> None:
        magic, _, self.bits, self.block_ids, _, self.n_ids, self.n_docs, self.first = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a volume of token ids")
        self.data, at = memoryview(data), _HEADER.size
        n_blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.null = np.frombuffer(data, "u1", self.n_docs, at).astype(bool)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from ``start`` to before ``end``; only their blocks are unpacked."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if end <= start:
            return np.zeros(0, np.uint32)
        low, high = start // self.block_ids, -(-end // self.block_ids)
        base = low * self.block_ids
        span = self.data[int(self.offsets[low]) : int(self.offsets[high])]
        return unpack(span, self.bits, min(high * self.block_ids, self.n_ids) - base)[start - base : end - base]

    @staticmethod
    def of(parts: list[np.ndarray], doc_ids: list[int | None], bits: int, block_ids: int, first: int) -> bytes:
        """Bytes of a volume with the given documents."""
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        starts = np.cumsum([0, *map(len, parts)])
        n_blocks = -(-len(ids) // block_ids)
        packed = [pack(ids[k * block_ids : (k + 1) * block_ids], bits) for k in range(n_blocks)]
        head = _HEADER.size + 8 * (n_blocks + 1) + 8 * len(parts) + 8 * (len(parts) + 1) + len(parts)
        gap = -head % 8
        offsets = head + gap + np.cumsum([0, *map(len, packed)])
        return b"".join(
            [
                _HEADER.pack(MAGIC, 1, bits, block_ids, 0, len(ids), len(parts), first),
                offsets.astype("<u8").tobytes(),
                np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(),
                starts.astype("<u8").tobytes(),
                np.array([i is None for i in doc_ids], "u1").tobytes(),
                bytes(gap),
                *packed,
            ]
        )


class Encoder:
    """Ids of texts by the tokenizers library, word by word.

    The file's pre-tokenizer drops white space and looks at nothing across it, so the ids of a text
    are those of its words between spaces and line ends. Words that were met before are looked up. New
    ones of Latin letters are cut into pieces here, as the file's normalizer and pre-tokenizer do, and
    the library's model encodes the pieces; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or "(?!)").search
        self.letters = dict(enumerate(byte_characters()))
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of the words, one after the other, and where each word's end."""
        known, tokenize, special, letters = self.pieces, self.model.tokenize, self.special, self.letters
        ids: list[int] = []
        ends: list[int] = []
        for word in words:
            if _LATIN(word) and not special(word):
                low = word.lower()
                for piece in (ASCII_PIECE if low.isascii() else PIECE).findall(low):
                    own = known.get(piece)
                    if own is None:
                        own = known[piece] = tuple([t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))])
                    ids += own
            else:
                ids += self.tokenizer.encode(word, add_special_tokens=False).ids
            ends.append(len(ids))
        return ids, ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > CACHED_WORDS or len(self.ids) > 4 * CACHED_WORDS:
            self.clear()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = len(self.place)
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.place) > known:
            ids, ends = self._encode_words(list(islice(self.place, known, None)))
            self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.array(ends, np.int64)])
        sizes = self.first[place + 1] - self.first[place]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[place] - (ends - sizes), sizes)]
        edges = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [ids[x:y] for x, y in zip(edges, edges[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file, added tokens among them."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    return 1 + max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])])


_VOLUMES = "shard int, volume int, first long, n_ids long, n_docs long, content binary"


def _volumes(path: str, end_id: int, bits: int, block_ids: int, volume_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, volume, first, held = TaskContext.get().partitionId(), 0, 0, 0
        parts: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def close() -> pa.RecordBatch:
            row = [shard, volume, first, held, len(parts), Volume.of(parts, doc_ids, bits, block_ids, first)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "volume", "first", "n_ids", "n_docs", "content"])

        for batch in batches:
            for piece in slices(batch, "text"):
                found = encoder(path).encode([t.as_py() or "" for t in piece.column("text")])
                for doc_id, ids in zip(piece.column("doc_id").to_pylist(), found):
                    parts.append(np.append(ids, np.uint32(end_id)))
                    doc_ids.append(doc_id)
                    held += len(parts[-1])
                    if held >= volume_ids:
                        yield close()
                        volume, first, held, parts, doc_ids = volume + 1, first + held, 0, [], []
        if parts:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS, volume_ids: int = VOLUME_IDS) -> None:
    """Encode every text, append ``end_id``, and write the ids by ascending doc_id to ``folder``.

    ``path`` is a tokenizer file every worker can read whose words can't reach across white space,
    ``folder`` one that all executors share. Ranges of (doc_id, hash of the text, row) are the shards,
    so rows that repeat an id are spread too; they follow each other by that hash. A null text is
    empty and gives the end id alone; a null doc_id comes first. ``doc_id`` must be an integer column;
    others are not read. A volume holds whole documents, so one longer than ``volume_ids`` is a volume
    alone.
    """
    bits = width_of(max(vocabulary_size(path), end_id + 1))
    order = ["doc_id", "salt", "row"]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("salt"), F.monotonically_increasing_id().alias("row"), "text")
    shards = given.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    volumes = shards.mapInArrow(_volumes(path, end_id, bits, block_ids, volume_ids), _VOLUMES)
    # Ids are packed already; small row groups keep the memory of readers and writers low.
    volumes.write.option("compression", "uncompressed").option("parquet.block.size", 32 << 20).parquet(folder)


def open_volumes(spark: SparkSession, folder: str) -> DataFrame:
    """The volumes with ``start``, the number of ids in all shards and volumes before."""
    volumes = spark.read.parquet(folder)
    # One number a shard, and shards are tasks, which the driver lists in any case.
    totals = volumes.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = np.cumsum([0, *(r["n"] for r in totals)])
    bases = spark.createDataFrame([(r["shard"], int(b)) for r, b in zip(totals, before)], "shard int, base long")
    if len(totals) <= SHARD_ROWS:
        bases = F.broadcast(bases)
    return volumes.join(bases, "shard").withColumn("start", F.col("base") + F.col("first"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, content in zip(batch.column("start"), batch.column("content")):
            volume = Volume(content.as_buffer().to_pybytes())
            ids = volume.ids().astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(volume.doc_ids.astype(np.int64), mask=volume.null),
                    pa.array(volume.starts[:-1] + start.as_py()),
                    pa.array(np.diff(volume.starts)),
                    pa.array([ids[a:b].tobytes() for a, b in zip(volume.starts, volume.starts[1:])], pa.binary()),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents out of the files: doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian)."""
    return open_volumes(spark, folder).select("start", "content").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def read_span(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """Ids from place ``start`` to before ``end`` of the whole stream: place, id.

    Volumes outside the span are ruled out by their counts; of the others only the blocks that the
    span meets are unpacked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, content in zip(batch.column("start"), batch.column("content")):
                volume, base = Volume(content.as_buffer().to_pybytes()), base.as_py()
                low = max(0, start - base)
                ids = volume.ids(low, end - base)
                yield pa.RecordBatch.from_arrays([pa.array(base + low + np.arange(len(ids))), pa.array(ids.astype(np.int64))], ["place", "id"])

    hit = (F.col("start") < end) & (F.col("start") + F.col("n_ids") > start)
    return open_volumes(spark, folder).where(hit).select("start", "content").mapInArrow(run, "place long, id long")
