"""Whitening, alignment of tokenizers and token files: against brute force, and odd input for each."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import alignment, token_files, whitening
from lotwise.llm.queries import run_folder, tokenizer_path
from tests.llm.test_operators import documents, prose

A, B, W = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path()
ODD = [None, "", " ", "  a  b ", "a▁b", "<|endoftext|> x </s><s>", "ééé😀😀  日本語テキスト\n\n\tx", "a" * 2000, " " * 300 + "x", "x" + " " * 300, "a\x00b",
       "naïve café", "word up " * 30_000, "'s don't I'LL  ", "\x1c\x85\xa0 q", "İ ΣΑΣ x²³¼ | a|b", "C<|startoftext|>d"]


# Whitening

VECTORS = "vec_id long, embedding array<float>, n long, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, 0) for i, v in rows], VECTORS)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_principal_directions(n):
    rng = np.random.default_rng(n)
    samples = [rng.normal(size=(200, n)), np.diag(np.arange(n, 0, -1.0)) + 0.0, np.eye(n), np.zeros((n, n)), rng.normal(size=(200, n)) * np.logspace(0, -6, n)]
    samples.append(np.diag(1 + 1e-13 * rng.normal(size=n)) @ np.linalg.qr(rng.normal(size=(n, n)))[0])
    constant = rng.normal(size=(150, n))
    constant[:, 0] = 0
    samples.append(constant)
    for x in samples:
        r = np.linalg.qr(x, mode="r")
        values, found = whitening.principal(r)
        top = max(np.linalg.norm(r, 2) ** 2, 1e-300)
        assert np.abs(values - np.linalg.svd(r, compute_uv=False) ** 2).max() <= 1e-13 * top
        assert np.abs(found.T @ found - np.eye(n)).max() < 1e-10
        assert np.abs(r.T @ (r @ found) - found * values).max() <= 1e-12 * top


def test_small_values_keep_their_accuracy():
    diagonal, upper = np.logspace(0, -12, 9), np.full(8, 1e-3) * np.logspace(0, -12, 8)
    exact = np.linalg.svd((np.diag(diagonal) + np.diag(upper, 1)).astype(np.float64), compute_uv=False) ** 2
    assert np.all(np.abs(whitening.dqds(diagonal, upper) / exact - 1) < 1e-6)


def test_whitening_against_the_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 12)).astype(np.float32) @ rng.normal(size=(12, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [None] * 12), (905, [1.0] * 5), (None, rows[0][1]), (3, rows[3][1])]
    got = whitening.whiten(vectors(spark, rows).repartition(9), components=8).collect()
    kept = [v for _, v in rows if v is not None and len(v) == 12 and all(c is not None and np.isfinite(c) for c in v)]
    ints = np.floor(64 * np.array(kept, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(ints), ints.sum(axis=0)
    centred = (ints * n - sums) / n
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1][:8], found[:, ::-1][:, :8]
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and {r["vec_id"] for r in got} == {None, *range(700)}
    by = collections.defaultdict(dict)
    for r in got:
        by[r["vec_id"]][r["component"]] = r
    first = ints[0] * n - sums
    assert int(by[0][1]["deviation"]) == int((first.astype(object) ** 2).sum())
    want = centred[:700] @ found / np.sqrt(values)
    have = np.array([[by[i][k + 1]["whitened"] for k in range(8)] for i in range(700)])
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-9
    total = np.trace(centred.T @ centred / n)
    assert all(abs(by[5][k + 1]["explained"] - values[k] / total) < 1e-12 and by[5][k + 1]["identity_error"] < 1e-9 for k in range(8))


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, []).limit(0)).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in same] == [(None, None, None, 0)] * 4
    line = whitening.whiten(vectors(spark, [(1, [0.0, 5.0]), (2, [1.0, 5.0]), (3, [2.0, 5.0])])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}


def test_sums_beyond_64_bits_stay_exact():
    centre = whitening.Centre(1 << 40, [3 << 62, 5])
    x = np.array([[3 << 22, 0]])
    numerators = centre.numerators(x)
    assert [int(v) for v in numerators[0]] == [(3 << 62) - (3 << 62), -5]
    far = whitening.Centre(1 << 30, [0, 0]).numerators(np.array([[1 << 33, 1]]))
    assert str(whitening.Centre.deviation(far)[0]) == str((1 << 126) + (1 << 60))


# Alignment


def brute_links(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: k for k, c in enumerate(alignment.byte_characters())}
    bytes_a = lambda i: bytes(byte_of[c] for c in a.id_to_token(i))

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    groups = []
    for _, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        own, at, left = [], (0, 0), ([], [])
        if text and b"".join(map(bytes_a, ids_a)) == want == b"".join(map(bytes_b, ids_b)):
            i = j = 0
            while i < len(ids_a) or j < len(ids_b):
                if at[0] <= at[1]:
                    left[0].append(ids_a[i])
                    at, i = (at[0] + len(bytes_a(ids_a[i])), at[1]), i + 1
                else:
                    left[1].append(ids_b[j])
                    at, j = (at[0], at[1] + len(bytes_b(ids_b[j]))), j + 1
                if at[0] == at[1]:
                    own.append(left)
                    left = ([], [])
        groups.append(own)
    counts = collections.Counter()
    for own in groups:
        counts.update({(x, y) for xs, ys in own for x in xs for y in ys})
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), own in zip(rows, groups):
        links = [(x, y) for xs, ys in own for x in xs for y in ys]
        line = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in own)
        out.append((i, sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(links), sum(counts[x] == best[x[0]] for x in links),
                    sum(counts[x] for x in links), alignment.hashlib.sha256(line.encode()).hexdigest() if own else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("head", [1 << 18, 40, 0])
def test_links_against_brute_force(spark, head):
    rng = random.Random(4)
    rows = [*enumerate(ODD), (None, "naïve café"), (3, "naïve café"), *((100 + i, prose(60, rng) + ", Größe: 12.5%!") for i in range(30))]
    got = alignment.link_tokens(documents(spark, rows).repartition(5), run_folder(spark, "alignment"), A, B, head=head).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_links(rows)
    assert alignment.link_tokens(documents(spark, rows).limit(0), run_folder(spark, "alignment"), A, B).count() == 0


def test_words_known_or_not_give_the_same(monkeypatch):
    texts = [prose(50) + " 12,5 x\n\ny" for _ in range(20)] + [t for t in ODD if t]
    whole = alignment.Aligned(alignment.Words(alignment.load(A, B)), texts)
    words = alignment.Words(alignment.load(A, B))
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 10)
    monkeypatch.setattr(alignment, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(alignment, "PAIRS", 5)
    for k, text in enumerate(texts):
        one = alignment.Aligned(words, [text])
        assert (one.digests[0], one.n_links[0]) == (whole.digests[k], whole.n_links[k])
        mine = whole.doc == k
        assert one.key.tolist() == whole.key[mine].tolist() and one.links.tolist() == whole.links[mine].tolist()


# Token files


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 31, 32])
def test_fields_come_back(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
        data = token_files.pack(ids, bits)
        assert len(data) % 8 == 0 and len(data) <= -(-n * bits // 64) * 8 + 8 * bits
        assert (token_files.unpack(data, bits, n) == ids).all()


def test_volume_unpacks_only_what_is_asked():
    parts = [np.arange(100, dtype=np.uint32), np.zeros(0, np.uint32), np.arange(300, dtype=np.uint32) % 7]
    data = token_files.Volume.of(parts, [5, None, -3], 9, 64, 1000)
    volume = token_files.Volume(data + b"\n")
    whole = np.concatenate(parts)
    assert volume.first == 1000 and volume.doc_ids.tolist() == [5, 0, -3] and volume.null.tolist() == [False, True, False]
    for a, b in ((0, 400), (63, 65), (64, 64), (399, 400), (130, 131), (0, 9999)):
        assert volume.ids(a, b).tolist() == whole[a:b].tolist()
    broken = bytearray(data)
    broken[int(volume.offsets[3]) :] = b"\xff" * (len(data) - int(volume.offsets[3]))
    assert token_files.Volume(bytes(broken)).ids(0, 150).tolist() == whole[:150].tolist()
    with pytest.raises(ValueError):
        token_files.Volume(b"x" * 100)


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(W)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_encode_like_whole_texts(monkeypatch):
    texts = [t or "" for t in ODD] + [prose(200) + " Ünïcode ß, ŽLUŤOUČKÝ kůň 1½ ab|cd" for _ in range(5)]
    want = library_ids(texts)
    assert [x.tolist() for x in token_files.Encoder(W).encode(texts)] == want
    monkeypatch.setattr(token_files, "CACHED_WORDS", 5)
    encoder = token_files.Encoder(W)
    assert [encoder.encode([t])[0].tolist() for t in texts] == want


def test_documents_come_back_from_files(spark):
    rng = random.Random(6)
    rows = [(i * 7 % 101, prose(rng.randint(1, 60), rng)) for i in range(101)] + [(200 + i, t) for i, t in enumerate(ODD)]
    rows += [(None, "a b"), (-5, prose(5000, rng)), (40, "again"), (40, "again")]
    folder = run_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, rows).repartition(6), folder, W, volume_ids=500, block_ids=64)
    got = token_files.read_documents(spark, folder).collect()
    ids = {k: [*x, 2] for k, x in zip((t for _, t in rows), library_ids([t for _, t in rows]))}
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((repr(i), np.array(ids[t], "<u4").tobytes()) for i, t in rows)
    ordered = sorted(got, key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in ordered]
    assert keys == sorted(keys)
    at, stream = 0, []
    for r in ordered:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
        stream += np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    for a, b in ((0, 5), (490, 1100), (at - 3, at + 9), (at, at + 1)):
        span = token_files.read_span(spark, folder, a, b).orderBy("place").collect()
        assert [(r["place"], r["id"]) for r in span] == list(zip(range(a, min(b, at)), stream[a:b]))
    crc = token_files.read_documents(spark, folder).where("doc_id = -5").select(F.crc32("ids").alias("c")).first()["c"]
    assert crc == zlib.crc32(np.array(ids[rows[-3][1]], "<u4").tobytes())


def test_files_of_no_documents(spark):
    folder = run_folder(spark, "tokens")
    token_files.write_tokens(documents(spark, []).limit(0), folder, W)
    assert token_files.read_documents(spark, folder).count() == 0 and token_files.read_span(spark, folder, 0, 9).count() == 0
