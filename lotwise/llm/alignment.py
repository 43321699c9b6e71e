"""Alignment of two tokenizers' tokens over the bytes they share, with corpus-wide link counts.

Byte offsets where tokens of both end cut a text into groups. Most groups are one token against one
with the same bytes; their B id is known from their A id by a table made once, so they are counted
in vectors of vocabulary length. Only pairs of other groups go through the shuffle as pairs.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bpe import byte_characters
from lotwise.llm.common import slices

PAIRS = 1 << 20  # pairs that are spread out at once
HELD_KEYS = 1 << 21  # pair keys a task holds before it counts them
HEAD = 1 << 18  # the commonest pairs whose counts are sent to every task; the rest are joined
WORDS_AT_ONCE = 512  # new words that are encoded as one text
KNOWN_WORDS, KNOWN_LINKS = 1 << 18, 1 << 22  # words a worker keeps aligned, and links of them

# A single space between other characters begins a token of both kinds: no token spans it, and the
# tokens of what follows don't depend on what precedes. So texts are aligned word by word.
_SPLIT = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"\s\s|^\s|\s$")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def words_of(text: str) -> list[str]:
    """Words that lie between single spaces; other white space stays inside them."""
    return _SPLIT.split(text) if _ODD_SPACE.search(text) else text.split(" ")


class Pair:
    """Both tokenizers, the bytes of their tokens, and the id of B with the bytes of each id of A."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of_letter = {c: b for b, c in enumerate(byte_characters())}
        self.n_a, self.n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        entries = [self.a.id_to_token(i) or "" for i in range(self.n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        a_bytes = [bytes(of_letter[c] for c in t) if all(c in of_letter for c in t) else t.encode() for t in entries]
        b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        own = {b: i for i, b in enumerate(b_bytes)}
        own |= {b: i for i, b in enumerate(b_bytes) if not _BYTE_PIECE.fullmatch(pieces[i])}  # a piece before a byte
        self.same = np.array([own.get(b, -1) for b in a_bytes], np.int64)
        self.a_bytes, self.b_bytes = (np.array([*x, None], object)[:-1] for x in (a_bytes, b_bytes))
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (a_bytes, b_bytes))
        self.a_names = np.array([f"{i}{c}".encode() for i in range(self.n_a) for c in ",|"], object)
        self.b_names = np.array([f"{i}{c}".encode() for i in range(self.n_b) for c in ",;"], object)

    def encode(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A over space + word and of B over the word; None where the bytes of either differ.

        Words go through the tokenizers many at once, as one text in which they stand between single
        spaces; the lengths of the tokens tell them apart. Where those don't add up, one by one.
        """
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(words)
        together = [k for k, w in enumerate(words) if w and not w[0].isspace() and not w[-1].isspace()]
        apart = sorted(set(range(len(words))).difference(together))
        runs = [together[i : i + WORDS_AT_ONCE] for i in range(0, len(together), WORDS_AT_ONCE)]
        lines = [" ".join([words[k] for k in run]) for run in runs]
        of_a = self.a.encode_batch_fast([" " + line for line in lines], add_special_tokens=False)
        for run, line, found, b in zip(runs, lines, of_a, self.b.encode(lines, num_threads=1)):
            a, b, want = np.array(found.ids, np.int64), np.array(b, np.int64), (" " + line).encode()
            if b"".join(self.a_bytes[a]) == want and b"".join(self.b_bytes[b]) == want:
                ends = np.cumsum([len(words[k].encode()) + 1 for k in run])
                cut_a, cut_b = (np.searchsorted(np.cumsum(sizes[x]), ends) + 1 for sizes, x in ((self.a_sizes, a), (self.b_sizes, b)))
                for k, x, y in zip(run, np.split(a, cut_a[:-1]), np.split(b, cut_b[:-1])):
                    out[k] = x, y
            else:
                apart += run
        for k in apart:
            a, want = np.array(self.a.encode(" " + words[k], add_special_tokens=False).ids, np.int64), (" " + words[k]).encode()
            b = np.array(self.b.encode(words[k]), np.int64)
            if b"".join(self.a_bytes[a]) == want and b"".join(self.b_bytes[b]) == want:
                out[k] = a, b
        return out


@lru_cache(maxsize=1)
def load(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def _counted(group: np.ndarray, ids: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, id) and how often each occurs."""
    keys, counts = np.unique(group * n_ids + ids, return_counts=True)
    return keys // n_ids, keys % n_ids, counts


def _spread(ga: np.ndarray, a: np.ndarray, ca: np.ndarray, gb: np.ndarray, b: np.ndarray, cb: np.ndarray, n_b: int, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, pair key, links) of all ids of A and of B that share a group, a bounded run at a time."""
    low, high = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(ga):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        width = (high - low)[start:end]
        left = np.repeat(np.arange(start, end), width)
        right = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low[start:end], width)
        yield doc[ga[left]], a[left] * n_b + b[right], ca[left] * cb[right]
        start = end


def _together(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of equal (document, key) as one row, sorted."""
    doc, key, links = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((key, doc))
    doc, key, links = doc[order], key[order], links[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[first], key[first], np.add.reduceat(links, first) if len(first) else links


class Words:
    """Words aligned so far: counts, the text of their groups, and their different links."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.place: defaultdict[str, int] = defaultdict(count().__next__)
        self.lines: list[bytes] = []
        self.counts = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, links
        self.good = np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)  # where the links of each word begin
        self.key, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[str]) -> None:
        pair, n = self.pair, len(words)
        ids = pair.encode(words)
        none = np.zeros(0, np.int64)
        n_a, n_b = (np.array([0 if x is None else len(x[i]) for x in ids], np.int64) for i in range(2))
        a, b = (np.concatenate([none, *(x[i] for x in ids if x is not None)]) for i in range(2))
        # Words follow each other: each ends in a boundary of both, so groups never cross them.
        ends_a, ends_b = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ga, gb = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        p, q = np.bincount(ga, minlength=len(ends)), np.bincount(gb, minlength=len(ends))
        first_a, first_b = np.cumsum(p) - p, np.cumsum(q) - q
        word = np.repeat(np.arange(n), n_a)[first_a] if len(ends) else none
        n_links = np.zeros(n, np.int64)
        np.add.at(n_links, word, p * q)
        regular = (p == 1) & (q == 1)
        regular[regular] = pair.same[a[first_a[regular]]] == b[first_b[regular]]
        own = a[first_a[regular]]
        parts = [(word[regular], own * pair.n_b + pair.same[own], np.ones(len(own), np.int64))]
        in_a, in_b = ~regular[ga], ~regular[gb]
        for part in _spread(*_counted(ga[in_a], a[in_a], pair.n_a), *_counted(gb[in_b], b[in_b], pair.n_b), pair.n_b, word):
            parts.append(_together([part]))
        of_word, key, links = _together(parts)
        self.lines += self._lines(a, b, n_a, n_b, ga, gb, p, q)
        self.counts = np.hstack([self.counts, np.vstack([n_a, n_b, np.bincount(word, minlength=n), n_links])])
        self.good = np.concatenate([self.good, [x is not None for x in ids]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(of_word, minlength=n))])
        self.key, self.links = np.concatenate([self.key, key]), np.concatenate([self.links, links])

    def _lines(self, a, b, n_a, n_b, ga, gb, p, q) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` for each word."""
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[np.cumsum(p) - 1], ends_b[np.cumsum(q) - 1] = 1, 1
        line = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + (np.cumsum(q) - q)[ga]] = self.pair.a_names[2 * a + ends_a]
        line[np.arange(len(b)) + np.cumsum(p)[gb]] = self.pair.b_names[2 * b + ends_b]
        edges = np.cumsum(np.concatenate([[0], n_a + n_b]))
        return [b"".join(line[x:y])[:-1] for x, y in zip(edges, edges[1:])]

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """Places of the words of each text; none if it is empty or a word's bytes differ."""
        if len(self.place) > KNOWN_WORDS or len(self.key) > KNOWN_LINKS:
            self.clear()
        split = [words_of(t) if t else [] for t in texts]
        known = len(self.place)
        found = [np.fromiter(map(self.place.__getitem__, own), np.int64, len(own)) for own in split]
        if len(self.place) > known:
            self.add(list(islice(self.place, known, None)))
        return [x if self.good[x].all() else x[:0] for x in found]


class Aligned:
    """Counts, digests and different links of some texts, put together from those of their words."""

    def __init__(self, words: Words, texts: list[str]) -> None:
        found = words.places(texts)
        n = len(texts)
        doc, place = np.repeat(np.arange(n), [len(x) for x in found]), np.concatenate([np.zeros(0, np.int64), *found])
        counts = np.zeros((4, n), np.int64)
        for i in range(4):
            np.add.at(counts[i], doc, words.counts[i][place])
        self.n_a, self.n_b, self.n_groups, self.n_links = counts
        line = words.lines.__getitem__
        self.digests = [hashlib.sha256(b";".join(map(line, x.tolist()))).hexdigest() if len(x) else "" for x in found]
        doc, place, times = _counted(doc, place, max(len(words.lines), 1))
        sizes = words.first[place + 1] - words.first[place]
        at = np.arange(sizes.sum()) + np.repeat(words.first[place] - (np.cumsum(sizes) - sizes), sizes)
        self.doc, self.key, self.links = _together([(np.repeat(doc, sizes), words.key[at], words.links[at] * np.repeat(times, sizes))])
        self.same = words.pair.same[self.key // words.pair.n_b] == self.key % words.pair.n_b


@lru_cache(maxsize=1)
def known_words(a_path: str, b_path: str) -> Words:
    return Words(load(a_path, b_path))


def _align(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(a_path, b_path)
        pair, row = words.pair, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                got = Aligned(words, [t.as_py() or "" for t in part.column("text")])
                edges = np.searchsorted(got.doc, np.arange(part.num_rows + 1))
                held: dict[str, list[bytes]] = {"same": [], "same_links": [], "keys": [], "key_links": []}
                for x, y in zip(edges, edges[1:]):
                    same = got.same[x:y]
                    held["same"].append((got.key[x:y][same] // pair.n_b).astype("<i4").tobytes())
                    held["same_links"].append(got.links[x:y][same].astype("<i8").tobytes())
                    held["keys"].append(got.key[x:y][~same].astype("<i8").tobytes())
                    held["key_links"].append(got.links[x:y][~same].astype("<i8").tobytes())
                columns = {"row": pa.array(row + np.arange(part.num_rows)), "doc_id": part.column("doc_id")}
                columns |= {c: pa.array(getattr(got, c).astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")}
                columns |= {"groups_sha256": pa.array(got.digests, pa.string())} | {c: pa.array(v, pa.binary()) for c, v in held.items()}
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document: its counts, and its different links as packed arrays.

    ``same`` (ids of A linked to the id of B with the same bytes) and ``keys`` (other pairs, as
    a * vocabulary of B + b) come with the number of links of each.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(_align(a_path, b_path), f"row long, {_DOC}, same binary, same_links binary, keys binary, key_links binary")


def _count_same(n_a: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_a, np.int64)
        for batch in batches:
            for part in slices(batch, "same", 1 << 24):
                counts += np.bincount(np.frombuffer(b"".join(part.column("same").to_pylist()), "<i4"), minlength=n_a)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"a": pa.array(at), "n": pa.array(counts[at])})

    return run


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_pydict({"key": pa.array(keys), "n": pa.array(n.astype(np.int64))})

    for batch in batches:
        for part in slices(batch, "keys", 1 << 22):
            held.append(np.frombuffer(b"".join(part.column("keys").to_pylist()), "<i8"))
            if sum(map(len, held)) >= HELD_KEYS:
                yield counted()
                held = []
    yield counted()


def _head_from(counts: DataFrame, head: int) -> int:
    """Least power of two that at most ``head`` counts reach."""
    steps = counts.groupBy((F.length(F.bin("n")) - 1).alias("step")).count().orderBy(F.desc("step")).collect()
    total, step = 0, 62
    for r in steps:
        total += r["count"]
        if total > head:
            break
        step = r["step"]
    return 1 << step


def _score(tables, n_b: int):
    """n_best and count_sum of a document's links, as far as the tables hold their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, best, head, head_n = tables.value
        for batch in batches:
            n_best, total = [], []
            for a, a_links, keys, key_links in zip(*(batch.column(c) for c in ("same", "same_links", "keys", "key_links"))):
                a, a_links = np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(a_links.as_buffer(), "<i8")
                keys, key_links = np.frombuffer(keys.as_buffer(), "<i8"), np.frombuffer(key_links.as_buffer(), "<i8")
                known, n = _look_up(head, head_n, keys)
                top = n == best[keys[known] // n_b]
                n_best.append(int(a_links[same[a] == best[a]].sum() + key_links[known][top].sum()))
                total.append(int(a_links @ same[a] + key_links[known] @ n))
            columns = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            columns |= {"own_best": pa.array(n_best, pa.int64()), "own_sum": pa.array(total, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _look_up(head: np.ndarray, head_n: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table holds, and the counts of those."""
    if not len(head):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(head, keys), len(head) - 1)
    known = head[at] == keys
    return known, head_n[at[known]]


def _rest(tables):
    """Links whose pairs the table doesn't hold: row, key, links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, head, head_n = tables.value
        for batch in batches:
            for part in slices(batch, "keys", 1 << 20):
                keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), "<i8")
                links = np.frombuffer(b"".join(part.column("key_links").to_pylist()), "<i8")
                sizes = np.array([len(k.as_buffer()) // 8 for k in part.column("keys")], np.int64)
                left = ~_look_up(head, head_n, keys)[0]
                rows = np.repeat(np.asarray(part.column("row")), sizes)
                yield pa.RecordBatch.from_pydict({"row": pa.array(rows[left]), "key": pa.array(keys[left]), "links": pa.array(links[left])})

    return run


def link_tokens(docs: DataFrame, folder: str, a_path: str, b_path: str, head: int = HEAD) -> DataFrame:
    """Counts and corpus-wide scores of each document's links between tokens of A and of B.

    ``a_path`` is a byte-level BPE file, ``b_path`` a sentencepiece model, both readable by every
    worker; ``folder`` is new and shared by all executors. Returns doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256. A text that is null or empty, or whose tokens do not
    spell space + text in either tokenizer, has no tokens: zeros and an empty digest. Each row is a
    document, so repeated rows count each. ``doc_id`` must be an integer column and may be null;
    other columns are not read. What reaches every task is bounded by the vocabulary of A and by
    ``head`` pairs; counts of all other pairs are joined, and each of those is in fewer documents
    than any pair of the head, so no key of the join is hot.
    """
    spark, pair = docs.sparkSession, load(a_path, b_path)
    align_documents(docs, a_path, b_path).write.parquet(f"{folder}/aligned")
    aligned = spark.read.parquet(f"{folder}/aligned")
    counts = aligned.select("keys").mapInArrow(_count_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    same = np.zeros(pair.n_a, np.int64)
    for r in aligned.select("same").mapInArrow(_count_same(pair.n_a), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        same[r["a"]] = r["n"]
    best = same.copy()
    for r in counts.groupBy(F.floor(F.col("key") / pair.n_b).alias("a")).agg(F.max("n").alias("n")).collect():
        best[r["a"]] = max(best[r["a"]], r["n"])
    least = _head_from(counts, head)
    common = counts.where(F.col("n") >= least).orderBy("key").toArrow()
    tables = spark.sparkContext.broadcast((same, best, np.asarray(common["key"], np.int64), np.asarray(common["n"], np.int64)))
    best_of = spark.createDataFrame([(int(a), int(n)) for a, n in enumerate(best) if n], "a long, best long")
    own = aligned.mapInArrow(_score(tables, pair.n_b), f"row long, {_DOC}, own_best long, own_sum long")
    rest = (
        aligned.select("row", "keys", "key_links")
        .mapInArrow(_rest(tables), "row long, key long, links long")
        .join(counts.where(F.col("n") < least).withColumn("a", F.floor(F.col("key") / pair.n_b)).join(F.broadcast(best_of), "a"), "key")
        .groupBy("row")
        .agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    )
    return own.join(rest, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("own_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("own_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
