"""BPE encoding and decoding as streams with bounded lookahead."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed values of the tokenizer file's pre-tokenizer: its white space and its pieces.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
WORD_END = "</w>"

TEXT_BLOCK = 1 << 16  # characters normalised and split at once
CACHED_PIECES = 250_000  # pieces whose tokens a worker keeps


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge list of a tokenizer file, its sufficient lookahead, and the two transducers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.ids: dict[str, int] = held["model"]["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.lookahead = self.sufficient_lookahead(pairs)
        letters = byte_characters()
        self.inner = [self.ids[c] for c in letters]
        self.final = [self.ids[c + WORD_END] for c in letters]
        self.bytes = {c: b for b, c in enumerate(letters)}
        self.cache: dict[str, tuple[str, str, int]] = {}

    @staticmethod
    def sufficient_lookahead(pairs: list[tuple[str, str]]) -> int:
        """Bytes to the right of a place that can still change the tokens to the left of it.

        News travels left through merges of rising rank only: a merge is undone or enabled by an
        earlier one that takes or makes its right part, or competes for its left part. The reach of
        a merge is its left part plus the furthest reach of those; the bound is the largest reach.
        """
        size = lambda t: len(t.removesuffix(WORD_END))
        reach: dict[str, int] = {}
        most = 1
        for left, right in pairs:
            own = max(size(left) + max(size(right), reach.get(right, 0)), reach.get(left, 0))
            for token in (left, left + right):
                reach[token] = max(reach.get(token, 0), own)
            most = max(most, own)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        merges = self.merges
        found = [merges.get(pair) for pair in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, m in enumerate(found):
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at:
                found[at - 1] = merges.get((ids[at - 1], best[1]))
            if at < len(found):
                found[at] = merges.get((best[1], ids[at + 1]))

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Tokens of the bytes of one piece, each as soon as no later byte can change it.

        Holds at most four lookaheads of bytes. A token that ends a lookahead before the last byte
        read is stable, and what follows a token boundary is merged as if it stood alone.
        """
        held, room = [], 4 * self.lookahead
        for byte in piece:
            held.append(byte)
            if len(held) > room:
                done, stable = 0, len(held) - 1 - self.lookahead
                for token in self.merge([self.inner[b] for b in held[:-1]]):
                    size = len(self.tokens[token])
                    if done + size > stable:
                        break
                    done += size
                    yield token
                held = held[done:]
        if held:
            yield from self.merge([self.inner[b] for b in held[:-1]] + [self.final[held[-1]]])

    def piece(self, text: str) -> tuple[str, str, int]:
        """Ids and decoded text of one piece, as they stand in a sequence, and how many."""
        own = self.cache.get(text)
        if own is None:
            ids = list(self.stream(text.encode()))
            own = (" ".join(map(str, ids)), " ".join(self.tokens[i] for i in ids), len(ids))
            if len(text) <= 64:
                if len(self.cache) >= CACHED_PIECES:
                    self.cache.clear()
                self.cache[text] = own
        return own

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pieces of a text between special tokens, block by block."""
        for block in blocks(text):
            if not block.isascii():
                block = unicodedata.normalize("NFC", block).replace("Σ", "σ")
            block = block.lower()
            yield (ASCII_PIECE if block.isascii() else PIECE).findall(block)

    def sections(self, text: str) -> Iterator[list[tuple[str, str, int]]]:
        """The text's (ids, decoded text, number of tokens), special tokens among them."""
        for part in self.split_special.split(text) if self.split_special and "<|" in text else (text,):
            if part in self.special:
                yield [(str(self.special[part]), part, 1)]
            elif part:
                cached, piece = self.cache.get, self.piece
                for own in self.pieces(part):
                    yield [cached(p) or piece(p) for p in own]

    def encode(self, text: str | None) -> Iterator[int]:
        """Token ids of a text."""
        for section in self.sections(text or ""):
            for ids, _, _ in section:
                yield from map(int, ids.split(" "))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids: a state machine over token, word end and unfinished character.

        A word end becomes one space before the next token. Bytes are held only until their
        character is whole; what never becomes one is replaced.
        """
        decoder, gap = codecs.getincrementaldecoder("utf-8")("replace"), False
        for token in ids:
            own = self.tokens[token]
            if own in self.special:
                yield decoder.decode(b"", True) + " " * gap + own
                decoder.reset()
                gap = True
                continue
            ended = own.endswith(WORD_END)
            data = bytes(self.bytes[c] for c in own.removesuffix(WORD_END))
            out = " " * gap + decoder.decode(data, ended)
            gap = ended
            if out:
                yield out
        yield decoder.decode(b"", True)


def blocks(text: str) -> Iterator[str]:
    """Runs of a text that end at white space; a run without any is as long as it is."""
    start = 0
    while len(text) - start > TEXT_BLOCK:
        end = max(text.rfind(" ", start + 1, start + TEXT_BLOCK), text.rfind("\n", start + 1, start + TEXT_BLOCK))
        if end <= start:
            ends = [x for x in (text.find(" ", start + TEXT_BLOCK), text.find("\n", start + TEXT_BLOCK)) if x > 0]
            if not ends:
                break
            end = min(ends)
        yield text[start:end]
        start = end
    yield text[start:]


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


def _encode(path: str, carry: list[str], with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(path)
        for batch in batches:
            n_tokens, ids_digest, decoded_digest, ids = [], [], [], []
            for text in batch.column("text"):
                count, first, own = 0, True, []
                ids_sha, decoded_sha = hashlib.sha256(), hashlib.sha256()
                for section in merges.sections(text.as_py() or ""):
                    if not section:
                        continue
                    gap = "" if first else " "
                    listed = " ".join([s[0] for s in section])
                    ids_sha.update((gap + listed).encode())
                    decoded_sha.update((gap + " ".join([s[1] for s in section])).encode())
                    count += sum([s[2] for s in section])
                    first = False
                    if with_ids:
                        own += map(int, listed.split(" "))
                n_tokens.append(count)
                ids_digest.append(ids_sha.hexdigest())
                decoded_digest.append(decoded_sha.hexdigest())
                ids.append(own)
            columns = {n: batch.column(n) for n in carry} | {
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "ids_sha256": pa.array(ids_digest, pa.string()),
                "decoded_sha256": pa.array(decoded_digest, pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def encode_documents(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encode every text with the merge list at ``path`` and decode it again.

    ``path`` is a tokenizer file that every worker can read. Returns the columns of ``carry``, then
    n_tokens, ids_sha256, decoded_sha256 (the tokens joined by one space, as the file has no
    decoder) and, if asked for, the ids. Null counts as empty; an empty text has no tokens and the
    digests of nothing. Each row is worked on alone, so repeated rows give repeated results, and
    other columns are not read.
    """
    types = dict(docs.dtypes)
    result = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>"] * with_ids])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(_encode(path, list(carry), with_ids), result)
