"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.llm.common import SPACE_WORDS, slices, span_hashes, split_words, text_bytes

HIDDEN = 12
LONGEST = 48  # bytes of one sequence; longer words are cut into sequences of this size
DOCS_PER_LANGUAGE = 200  # bound of the labelled sample: rows
WORDS_PER_DOC = 200  # and words of each of them, evenly spread over its whole text
STEPS, BATCH, RATE = 500, 256, 0.02
CACHED_WORDS = 150_000  # words whose pooled probabilities a worker keeps
SLICE_BYTES = 2 << 20  # text whose new words are labelled together
PIECE_BYTES = 1 << 19  # text whose words are found at once
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class ByteNetwork:
    """Two gated recurrent layers, one reading forwards and one backwards, and a softmax over
    languages at every byte. A sequence is one word, so equal words are labelled once."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        scale = 1 / np.sqrt(HIDDEN)
        self.weights = {}
        for side in "fb":
            self.weights[f"E{side}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
            self.weights[f"U{side}"] = rng.normal(0, scale, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
            self.weights[f"V{side}"] = rng.normal(0, scale, (HIDDEN, len(languages))).astype(np.float32)
        self.weights["c"] = np.zeros(len(languages), np.float32)

    def _walk(self, side: str, codes: np.ndarray, active: list[int], keep: bool):
        """States of one layer at each step; rows are sorted by length, the longest first."""
        table, inner = self.weights[f"E{side}"], self.weights[f"U{side}"]
        n, steps = codes.shape
        state = np.zeros((n, HIDDEN), np.float32)
        states, held = np.zeros((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            m = active[t]
            before, given = state[:m].copy() if keep else state[:m], table[codes[:m, t]]
            sent = before @ inner
            gates = _sigmoid(given[:, : 2 * HIDDEN] + sent[:, : 2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            fresh = np.tanh(given[:, 2 * HIDDEN :] + reset * sent[:, 2 * HIDDEN :])
            state[:m] = fresh + update * (before - fresh)
            states[t, :m] = state[:m]
            if keep:
                held.append((before, sent, update, reset, fresh))
        return states, held

    def _back(self, side: str, codes: np.ndarray, active: list[int], held: list, given: np.ndarray, grads: dict) -> None:
        """Backpropagation through time of one layer; ``given`` is the gradient at each state."""
        inner = self.weights[f"U{side}"]
        carry = np.zeros_like(given[0])
        table, square = np.zeros_like(self.weights[f"E{side}"]), np.zeros_like(inner)
        for t in reversed(range(codes.shape[1])):
            m = active[t]
            before, sent, update, reset, fresh = held[t]
            d = carry[:m] + given[t, :m]
            d_fresh = d * (1 - update) * (1 - fresh * fresh)
            d_update = d * (before - fresh) * update * (1 - update)
            d_reset = d_fresh * sent[:, 2 * HIDDEN :] * reset * (1 - reset)
            into = np.concatenate((d_update, d_reset, d_fresh), axis=1)
            np.add.at(table, codes[:m, t], into)
            through = np.concatenate((d_update, d_reset, d_fresh * reset), axis=1)
            square += before.T @ through
            carry[:m] = d * update + through @ inner.T
        grads[f"E{side}"], grads[f"U{side}"] = table, square

    def _positions(self, codes: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Probabilities at every byte of every row, with what training needs."""
        active = [int((lengths > t).sum()) for t in range(codes.shape[1])]
        turned = np.take_along_axis(codes, np.maximum(lengths[:, None] - 1 - np.arange(codes.shape[1]), 0), axis=1)
        ahead, held_f = self._walk("f", codes, active, keep)
        astern, held_b = self._walk("b", turned, active, keep)
        row, t = np.nonzero(np.arange(codes.shape[1]) < lengths[:, None])
        mirrored = lengths[row] - 1 - t
        one, two = ahead[t, row], astern[mirrored, row]
        logits = one @ self.weights["Vf"] + two @ self.weights["Vb"] + self.weights["c"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), (row, t, mirrored, one, two, active, turned, held_f, held_b, ahead.shape)

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes, and its gradients; rows sorted by length."""
        chance, (row, t, mirrored, one, two, active, turned, held_f, held_b, shape) = self._positions(codes, lengths, True)
        want = labels[row]
        loss = -float(np.mean(np.log(chance[np.arange(len(row)), want] + 1e-9)))
        d = chance.copy()
        d[np.arange(len(row)), want] -= 1
        d /= len(row)
        grads = {"Vf": one.T @ d, "Vb": two.T @ d, "c": d.sum(axis=0)}
        at_f, at_b = np.zeros(shape, d.dtype), np.zeros(shape, d.dtype)
        at_f[t, row] = d @ self.weights["Vf"].T
        at_b[mirrored, row] = d @ self.weights["Vb"].T
        self._back("f", codes, active, held_f, at_f, grads)
        self._back("b", turned, active, held_b, at_b, grads)
        return loss, grads

    def train(self, words: list[bytes], labels: np.ndarray, seed: int = 7) -> float:
        """Adam over batches that hold as many words of each language; the last loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        loss = 0.0
        for step in range(1, STEPS + 1):
            picked = np.concatenate([rng.choice(own, max(1, BATCH // len(by_label))) for own in by_label])
            codes, lengths, order = pad([words[i] for i in picked])
            loss, grads = self.gradients(codes, lengths, labels[picked][order])
            rate = RATE * (1 - 0.9 * step / STEPS)
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return loss

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """For each word, sums over its bytes of the probabilities, then of the labels."""
        n = len(self.languages)
        out = np.zeros((len(words), 2 * n), np.float32)
        for a in range(0, len(words), 8192):
            codes, lengths, order = pad(words[a : a + 8192])
            chance, (row, *_) = self._positions(codes, lengths)
            label = np.zeros_like(chance)
            label[np.arange(len(row)), chance.argmax(axis=1)] = 1
            starts = np.searchsorted(row, np.arange(len(lengths)))
            out[a + order] = np.add.reduceat(np.concatenate((chance, label), axis=1), starts, axis=0)
        return out


def pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as rows of one matrix, the longest first; their lengths; the order they are in."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")
    wide = int(lengths.max())
    codes = np.frombuffer(b"".join(words[i].ljust(wide, b"\0") for i in order), np.uint8).reshape(len(words), wide)
    return codes, lengths[order], order


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the byte sequences that hold a letter."""
    words = split_words(data, offsets, SPACE_WORDS)
    parts = -(-(words.ends - words.starts) // LONGEST)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(words.starts, parts) + number * LONGEST
    ends = np.minimum(starts + LONGEST, np.repeat(words.ends, parts))
    letters = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(_LETTER[data], out=letters[1:])
    some = letters[ends] > letters[starts]
    return starts[some], ends[some], np.repeat(words.text(), parts)[some]


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train_language_model(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> ByteNetwork | None:
    """A network fitted on a bounded sample: of each language at most ``docs_per_language`` rows
    (those of the lowest hash among the rows not held out) and ``WORDS_PER_DOC`` words of each.
    None where no row has both a language and a text with letters."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ranked = known.select("doc_id", "lang").withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    chosen = F.broadcast(ranked.where(F.col("place") <= docs_per_language).select("doc_id", "lang").distinct())
    # Words evenly spread over the text; only they come to the driver.
    spread = F.split(F.col("text"), r"[\s]+")
    step = F.greatest(F.lit(1), F.floor(F.size(spread) / WORDS_PER_DOC)).cast("int")
    some = F.transform(F.sequence(F.lit(0), F.least(F.size(spread), F.lit(WORDS_PER_DOC)) - 1), lambda i: F.substring(F.get(spread, i * step), 1, LONGEST))
    rows = known.join(chosen, ["doc_id", "lang"]).select("lang", "doc_id", some.alias("words")).orderBy("lang", "doc_id", F.xxhash64("words")).collect()
    words, names = [], []
    for r in rows:
        own = [w[:LONGEST] for w in (x.encode() for x in r["words"] if x) if _LETTER[np.frombuffer(w, np.uint8)].any()]
        words += own
        names += [r["lang"]] * len(own)
    languages = sorted(set(names))
    if not languages:
        return None
    model = ByteNetwork(languages)
    model.train(words, np.searchsorted(languages, names))
    return model


def _predict(model: ByteNetwork | None, carry: list[str]):
    names = model.languages if model else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        place: dict[int, int] = {}
        table = np.zeros((CACHED_WORDS, 2 * n), np.float32)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                sums = np.zeros((part.num_rows, 2 * n))
                pieces, row = [], 0
                for piece in slices(part, "text", PIECE_BYTES) if n else ():
                    data, offsets = text_bytes(piece.column("text"))
                    starts, ends, text = sequences(data, offsets)
                    if len(starts):
                        own_hashes, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
                        pieces.append((data, starts[first], ends[first], own_hashes, which.astype(np.int32), text + row))
                    row += piece.num_rows
                if pieces:
                    hashes, first = np.unique(np.concatenate([p[3] for p in pieces]), return_index=True)
                    base = np.cumsum([0] + [len(p[3]) for p in pieces])
                    if len(place) + len(hashes) > CACHED_WORDS:
                        place.clear()
                    keys = hashes.tolist()
                    new = [i for i, h in enumerate(keys) if h not in place]
                    if len(place) + len(new) > len(table):  # one slice with more words than are kept
                        table = np.zeros((len(place) + len(new), 2 * n), np.float32)
                    if new:
                        words = []
                        for at in first[new].tolist():
                            k = int(np.searchsorted(base, at, "right")) - 1
                            data, starts, ends = pieces[k][:3]
                            words.append(data[starts[at - base[k]] : ends[at - base[k]]].tobytes())
                        held = len(place)
                        table[held : held + len(new)] = model.pooled(words)
                        place.update((keys[i], held + k) for k, i in enumerate(new))
                    for _, _, _, own_hashes, which, text in pieces:
                        own = table[np.fromiter((place[h] for h in own_hashes.tolist()), np.int64, len(own_hashes))].astype(np.float64)[which]
                        begins = np.flatnonzero(np.diff(text, prepend=-1))
                        sums[text[begins]] = np.add.reduceat(own, begins, axis=0)
                yield _answers(part, carry, names, sums)

    return run


def _answers(part: pa.RecordBatch, carry: list[str], names: list[str], sums: np.ndarray) -> pa.RecordBatch:
    n = len(names)
    total = sums[:, :n].sum(axis=1)
    seen = total > 0
    best = sums[:, :n].argmax(axis=1) if n else np.zeros(len(sums), np.int64)
    share = np.where(seen, sums[np.arange(len(sums)), best] / np.where(seen, total, 1), 0) if n else np.zeros(len(sums))
    label, score, shares = [], [], []
    column = part.column("text")
    for i in range(len(sums)):
        # Bytes above ASCII may be signs instead of letters; only such texts are looked at again.
        if not seen[i] or not any(c.isalpha() for c in column[i].as_py()):
            label.append(UNKNOWN)
            score.append(0.0)
            shares.append([])
        else:
            label.append(names[best[i]])
            score.append(round(float(min(1.0, share[i])), 6))
            counts = sums[i, n:]
            shares.append([(name, round(float(c / counts.sum()), 6)) for name, c in zip(names, counts)])
    columns = {c: part.column(c) for c in carry} | {
        "lang_pred": pa.array(label, pa.string()),
        "score": pa.array(score, pa.float64()),
        "label_shares": pa.array(shares, pa.map_(pa.string(), pa.float64())),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def predict_language(docs: DataFrame, model: ByteNetwork | None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Language of every whole text.

    Every byte of every word gets a label; probabilities are averaged over all bytes of words with
    a letter. Returns the columns of ``carry``, then lang_pred, score (the mean probability of that
    language) and label_shares (share of bytes labelled with each language). A null or empty text,
    one without a letter, and any text without a model, is ``und`` with score 0. Rows are judged one
    by one, so repeated rows agree; of the input only ``carry`` and ``text`` are read. Ties go to the
    first language in sorted order.
    """
    types = dict(docs.dtypes)
    result = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "lang_pred string, score double, label_shares map<string,double>"])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(_predict(model, list(carry)), result)
