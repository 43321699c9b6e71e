"""Operators against brute force, and odd input for each: nulls, empty and long texts, ties, repeated
rows, empty tables, other columns with clashing names."""

import hashlib
import random
import re
import textwrap

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.llm import bpe, chat, decontaminate, html_text, language, licenses, near_dups, substring, top_k, url_filter
from lotwise.llm.queries import tokenizer_path

RANDOM = random.Random(5)
VOCABULARY = ["".join(RANDOM.choice("abcdefgh") for _ in range(RANDOM.randint(1, 5))) for _ in range(60)]


def prose(n, rng=RANDOM, words=VOCABULARY):
    return " ".join(rng.choice(words) for _ in range(n))


def documents(spark, rows):
    """Documents with columns that carry the names of results."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1.0, True, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, contaminated boolean, key string")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Windows over words


def brute_repeats(rows):
    held = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in held:
        for k in range(len(w) - 19):
            at = (i is None, i or 0, k)
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in held:
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (i is None, i or 0, k) for j in range(k, k + 20)}
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=repr)


def odd_texts():
    passage, hot = prose(60), prose(45)
    copy = prose(120)
    rows = [(0, copy), (1, None), (2, ""), (3, " \n\t "), (4, copy), (4, copy), (5, f"{prose(30)} {passage}\n{prose(30)}"), (6, f"{passage} {prose(10)} {passage}")]
    rows += [(7, "a " * 300), (8, "é" * 50 + " " + passage.upper()), (9, prose(19)), (10, prose(6000) + " " + passage), (None, copy), (11, f"{prose(20)}\x0b{hot}\xa0x")]
    rows += [(20 + k, f"{prose(RANDOM.randint(0, 40))} {hot} {prose(RANDOM.randint(0, 40))}") for k in range(40)]
    return rows


@pytest.mark.parametrize("hot", [2000, 5])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    rows = odd_texts()
    got = substring.remove_repeats(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert substring.remove_repeats(documents(spark, [])).count() == 0


def test_index_counts_like_a_scan():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = substring.FMIndex(text, 8)
    starts = np.arange(len(text) - 9)
    statistic, low, high = index.matches(starts, 8)
    for s in starts:
        own = next((n for n in range(8, 0, -1) if sum((text[i : i + n] == text[s + 8 - n : s + 8]).all() for i in range(len(text) - n + 1)) > 1), 0)
        assert statistic[s] == own
    whole = statistic == 8
    assert all(high[s] - low[s] == sum((text[i : i + 8] == text[s : s + 8]).all() for i in range(len(text) - 7)) for s in np.flatnonzero(whole))


def lower(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_leaks(rows, items):
    tests = {}
    for item, text in items:
        w = lower(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            tests.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, named = lower(text), set(), set()
        for n in {len(t) for t in tests}:
            for k in range(len(w) - n + 1):
                if (own := tests.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    named |= own
        out.append((i, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return sorted(out, key=repr)


def test_leaks_against_brute_force(spark, monkeypatch):
    items = [(k, prose(RANDOM.randint(12, 40))) for k in range(30)] + [(100, None), (101, ""), (102, "Zürich ist da"), (103, "solo"), (104, "..."), (3, "solo"), (10, prose(11))]
    rows = [(k, f"{prose(30)} {items[k][1].upper()}, {prose(8)}") for k in range(25)] + [(50, None), (50, ""), (51, "zürich-ist--DA"), (51, "SOLO"), (52, items[1][1][:40]), (53, prose(3000))]
    docs = documents(spark, rows)
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    for size in (32 << 20, 300):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", size)
        got = decontaminate.find_contamination(docs, bench).drop("item_ids").collect()
        assert sorted(map(tuple, got), key=repr) == brute_leaks(rows, items)
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


# Tokens


def test_tokens_like_the_library(spark):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())
    rng = random.Random(3)
    texts = [None, "", " ", "a" * 3000, "".join(rng.choice("abcdeinthr") for _ in range(9000)), "Héllo wörld, it's 123 <|endoftext|> a_b ñandú! ﬁ ΑΣ ΑΣ. İ", "x\x1cy\x85z q\u0301 e\u0301"]
    texts += ["日本語 한국어 ①½", "'S 'LL don't <|endoftext|><|startoftext|>b", "A\n\u0301b " * 20000, prose(20000), prose(5), prose(5)]
    got = {r["doc_id"]: r for r in bpe.encode_documents(documents(spark, list(enumerate(texts))), tokenizer_path(), with_ids=True).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(ids), ids)
        assert got[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == sha(tokenizer.decode(ids, skip_special_tokens=False))
    assert bpe.encode_documents(documents(spark, []), tokenizer_path()).count() == 0


def test_streamed_tokens_are_stable_and_come_back():
    merges = bpe.load(tokenizer_path())
    rng = random.Random(4)
    for n in (1, 50, 700, 5000):
        word = "".join(rng.choice("thereandingé") for _ in range(n))
        data = word.encode()
        assert list(merges.stream(data)) == merges.merge([merges.inner[b] for b in data[:-1]] + [merges.final[data[-1]]])
        # However the text goes on, what was emitted stays.
        longer = list(merges.stream(data + b"zzq"))
        size, shared = 0, 0
        for a, b in zip(longer, merges.stream(data)):
            if a != b:
                break
            size, shared = size + len(merges.tokens[a]), shared + 1
        assert size >= len(data) - merges.lookahead
        assert "".join(merges.decode(merges.encode(word))) == word.lower()


# Chat


def spoken(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, turn long, kind string, role string, text string")


def test_texts_and_roles_come_back_from_the_format(spark):
    odd = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> </\\s>", "", None, "a\nb %0A <s", "[/INST]</s", "é" * 10, "<s>[INST]" * 50, "\\"]
    roles = ["user", "assistant", "sys\ntem", "[INST]", "50%", None, "", "</s>", "assistant"]
    rows = [(c, t, t, "message", roles[(c + t) % 9], odd[(c * 5 + t) % 9]) for c in range(9) for t in range(9)]
    rows += [(100, 0, 0, "message", "assistant", "x"), (100, 0, 0, "message", "assistant", "x"), (None, 1, None, "message", "user", "u")]
    read = chat.read_back(chat.render(chat.fold_events(spoken(spark, rows)))).collect()
    for r in read:
        own = sorted([(x[2] if x[2] is not None else -1, x[4] or "", x[5] or "") for x in rows if x[0] == r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[1:] for x in own]
        assert r["loss_text"] == "".join(t for _, role, t in own if role == "assistant")
    assert len(read) == 11
    assert chat.digest_columns(chat.read_back(chat.render(chat.fold_events(spoken(spark, []))))).count() == 0


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", "he"), (1, 2, 1, "delta", None, "ll"), (1, 3, 1, "delta", None, "o"),
        (1, 4, 2, "message", "user", "later"), (1, 5, 1, "regenerate", None, ""), (1, 6, 1, "delta", None, "new"), (1, 7, 0, "edit", None, "hey"), (1, 8, 2, "message", "user", "next"),
        (2, 0, 0, "delta", "user", "only"), (2, 1, 0, "delta", "user", " this"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold_events(spoken(spark, rows)).collect()}
    assert got == {(1, 0): ("user", "hey"), (1, 1): ("assistant", "new"), (1, 2): ("user", "next"), (2, 0): ("user", "only this")}


# Urls


def test_rules_like_a_scan(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "", "allow"), ("example.net", "/en/deep/", "block"), ("", "/x", "block"), (None, None, "allow"), ("net", "/", "allow")]
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "EXAMPLE.net", "org", "example.net.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en/1?q=/x", "/en/deep/2#f", "/EN/")] + [None, "", "example.net/en/", "x", "http://", "http:///x", "ftp://net?a", "http://net/\n/b"]
    rows = [(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z"), (None, urls[1], "z")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    want = []
    for page, url, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len((h or "") + (p or "")), len(h or ""), (h or "") + (p or ""), v) for h, p, v in rules if (host == (h or "") or host.endswith("." + (h or ""))) and path.startswith(p or "")]
        best = min((f for f in fits if f[:2] == max(fits)[:2]), key=lambda f: f[3]) if fits else (0, 0, None, "allow")
        want.append((page, host, path, best[2], best[3]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")).first()["rule"] is None


# Vectors


def brute_top(rows, k):
    held = [(i, [int(np.floor(1024 * float(np.float32(v)))) for v in e]) for i, e in rows if e is not None and all(v is not None and np.isfinite(v) for v in e)]
    out = []
    for i, q in held:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in held if j != i and len(e) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 40])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "CHUNK", 4)
    monkeypatch.setattr(top_k, "LEAF", 4)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[100][1]) for i in range(60)]  # copies, a query among them
    rows += [(2000, None), (2100, [1.0, None]), (2200, [float("nan")] * 8), (2300, [float("inf")] * 8), (2400, [1.0, 2.0]), (2401, [0.5, 0.5]), (2500, []), (2600, [0.0] * 8)]
    frame = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, rank int, score long")
    got = top_k.exact_top_k(frame, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 10)
    assert top_k.exact_top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_doubles():
    data = np.array([[1 << 40, 1], [1 << 40, 2], [1 << 40, 3]])
    found = top_k.DualSearch(data, np.arange(3), np.array([[1 << 15, 1]]), np.array([-np.inf]), 2)
    assert found.found.tolist() == [[2, 1]] and found.score[0, 0] == (1 << 55) + 3


def test_tree_covers_its_points():
    points = np.random.default_rng(3).normal(size=(500, 3))
    tree = top_k.CoverTree(points)
    for node, own in enumerate(tree.members):
        assert (np.linalg.norm(points[own] - tree.centers[node], axis=1) <= tree.radii[node] + 1e-9).all()
        if tree.children[node] is not None:
            assert sorted(np.concatenate([tree.members[c] for c in tree.children[node]]).tolist()) == sorted(own.tolist())
            assert (tree.radii[tree.children[node]] <= tree.radii[node] / 2 + 1e-9).all()


# Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li>menu<li>more</ul></nav><div class="cookie-notice">We use cookies</div><main><article class=post><h1>{title}</h1>{body}
<div class="share">Share</div><form><label>mail</label></form><section id="comments"><article><p>Nice!</p></article></section></article></main>
<aside>side</aside><footer>&copy; x</footer>"""


def test_article_without_what_surrounds_it(spark):
    bodies = ["<p>One &amp; two<br>three<p><b>Four\n  five</p><ul><li>a<li>b</ul>", "<p>Other</p><h2>Head</h2><p>x</p><h2>Head 2</h2><p>y<i>z</i></p>", "", "<p>" + "word " * 50000 + "</p>"]
    want = ["One & two three\n\nFour five\n\na\n\nb", "Other\n\nHead\n\nx\n\nHead 2\n\nyz", "", ("word " * 50000).strip()]
    rows = [(i, f"http://h.example/{i}", PAGE.format(title=f"T{i}", body=b)) for i, b in enumerate(bodies)]
    rows += [(10, "http://h.example/", None), (11, None, ""), (12, None, "<div>" * 3000 + "deep"), (13, "http://h.example/0", rows[0][2]), (13, "http://h.example/0", rows[0][2]), (14, "x://z", "<p>plain <!-- gone")]
    got = html_text.extract_text(spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long"))
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    for i in range(4):
        assert by[i]["text"] == f"T{i}" + ("\n\n" + want[i] if want[i] else "") and by[i]["n_chars"] == len(by[i]["text"])
    assert [by[i]["text"] for i in (10, 11, 12, 14)] == ["", "", "deep", "plain"]
    assert by[13]["text"] == by[0]["text"]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_has_optional_and_repeated_groups():
    one = html_text.page_wrapper("<div><h1>a</h1><p>x</p><p>y</p></div>")
    two = html_text.page_wrapper("<div><h1>a</h1><img><p>z</p><hr></div>")
    kids = {n["k"]: n for n in html_text.united(one, two)["ch"][0]["ch"]}
    assert kids["p"].get("r") and not kids["p"].get("o") and kids["img"].get("o") and kids["hr"].get("o") and not kids["h1"].get("o")
    assert kids["h1"]["ch"][0]["t"] and not kids["p"]["ch"][0]["t"]
    rows = html_text.page_wrapper("<table>" + "<tr><td>a</td></tr><tr class=odd><td>b</td></tr>" * 4 + "</table>")["ch"][0]["ch"]
    assert [(n["k"], n.get("r")) for n in rows] == [("tr", 1), ("tr.class.odd", 1)] or [(n["k"], n.get("r")) for n in rows] == [("tr", 1), ("tr.odd", 1)]


def test_without_an_article_shared_text_is_left_out():
    pages = [f"<body><div><span>Same</span><p>own {i}</p></div></body>" for i in range(4)]
    wrapper = html_text.page_wrapper(pages[0])
    for p in pages[1:]:
        wrapper = html_text.united(wrapper, html_text.page_wrapper(p))
    assert html_text.extract(pages[2], html_text.mark_main(wrapper)) == "own 2"


def texts_of(pages):
    wrapper = html_text.page_wrapper(pages[0])
    for p in pages[1:]:
        wrapper = html_text.united(wrapper, html_text.page_wrapper(p))
    return [html_text.extract(p, html_text.mark_main(wrapper)) for p in pages]


def test_each_page_has_its_own_main_place():
    pages = ["<article><p>one</p></article>", "<main><p>two</p></main>", "<div><p>three</p></div>", "<main><p>four</p><article></article></main>", "<main></main><p>five</p>"]
    assert texts_of(pages) == ["one", "two", "three", "four", "five"]
    assert texts_of(["<div><p>same</p></div>"] * 5) == ["same"] * 5
    assert texts_of(["<div><p>same</p></div>"] * 2 + [f"<div><p>same</p><p>{i}</p></div>" for i in "ab"]) == ["same", "same", "same\n\na", "same\n\nb"]


def test_extraction_follows_the_alignment():
    pages = ["<body><div>banner</div><section>s</section><div><article>one</article></div><footer>f</footer></body>", "<body><div><article>two</article></div><footer>f</footer></body>"]
    assert texts_of(pages) == ["one", "two"] and texts_of(pages[::-1]) == ["two", "one"]
    # Places the wrapper has not.
    assert html_text.extract("<div><b>x</b><article>kept</article></div>", html_text.mark_main(html_text.page_wrapper("<div><p>x</p></div>"))) == "kept"
    folded = html_text._folded(["p", "p", "h2", "p", "h2", "p", "#", "#"])
    assert [k for k, _ in folded] == [n["k"] for n in html_text.shape([("p", []), ("p", []), ("h2", []), ("p", []), ("h2", []), ("p", []), "a", "b"])]


def test_words_in_names_of_article_content():
    article = """<article><div class="article-header"><h1>T{0}</h1></div><h2 id="social-impact">A</h2><p class="notice">b{0}</p><h2 id="legal-framework">C</h2>
    <section id="related-work"><h2>D{0}</h2><p>e{0}</p></section><p>f <span class="ad">g</span></p><div class="share">S</div><div class="post-comments"><p>no{0}</p></div></article>"""
    want = "T{0}\n\nA\n\nb{0}\n\nC\n\nD{0}\n\ne{0}\n\nf g"
    assert texts_of([article.format(i) for i in range(4)]) == [want.format(i) for i in range(4)]
    assert texts_of([article.format(1)] * 4) == [want.format(1) + "\n\nno1"] * 4
    last = "<article><p>x</p><section id=legal-notice><p>own</p></section></article>"
    assert texts_of([last, "<article><p>y</p></article>", "<article><p>z</p></article>"])[0] == "x\n\nown"


# Licenses


def test_links_across_settled_parts_of_a_bucket(spark, monkeypatch):
    # One bucket holds all: the first leader settles those it links, the second meets only the rest.
    words = [f"w{i}" for i in range(400)]
    chain = [words[0:200], words[18:218], words[36:236], words[54:254]]
    assert near_dups.similar(chain[0], chain[1]) and not near_dups.similar(chain[0], chain[2])
    monkeypatch.setattr(near_dups, "ROUNDS", 2)
    texts = spark.createDataFrame([(bytes([i]), " ".join(c)) for i, c in enumerate(chain)], "node binary, text string")
    # The middle texts would lead by their counts; here the ends do.
    near = [9, 1, 1, 8]
    members = spark.createDataFrame([(1, bytes([i]), 196, near[i]) for i in range(len(chain))], "bucket long, node binary, size int, near long")
    labels = {r["node"][0]: r["label"][0] for r in near_dups._groups(texts, members).collect()}
    assert labels == {i: 0 for i in range(len(chain))}


def test_near_duplicates_of_few_shingles_and_without_ids(spark):
    rows = [(i, " ".join(["x"] * (5 + i))) for i in range(4)]
    own = prose(300).split()
    rows += [(None, " ".join(own)), (None, " ".join(own[:290])), (20, " ".join(own[:280])), (21, prose(50))]
    got = near_dups.near_duplicate_classes(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["class_id"], r["class_texts"]) for r in got if r["doc_id"] is not None) == [*((i, 0, 4) for i in range(4)), (20, 20, 3), (21, 21, 1)]
    assert [(r["class_id"], r["class_texts"]) for r in got if r["doc_id"] is None] == [(20, 3), (20, 3)]


def test_compression_decides_on_licenses(monkeypatch):
    text = prose(40) + " Released under the MIT License. " + prose(40)
    assert [n[2] for n in licenses.notices(text)] == ["MIT"]
    rng = random.Random(7)
    for form, (name, want, at, told, _) in enumerate(licenses.forms()):
        # Wording at its limit, among other words, is still shortened enough.
        spare = [i for i in range(len(want)) if not at <= i < at + told]
        gone = set(rng.sample(spare, min(len(spare), int(0.2 * len(want)))))
        own = []
        for i, w in enumerate(want):
            if i not in gone:
                own += [w] if at <= i < at + told else [w, rng.choice(VOCABULARY)]
        begin = next(i for i in range(len(own)) if own[i : i + told] == want[at : at + told])
        assert licenses.reduction(licenses.around([*prose(400, rng).split(), *own, *prose(400, rng).split()], 400 + begin, form), form) >= licenses.LEAST_REDUCTION, name
    # A compressor that finds nothing in common finds no notice, whatever the wording.
    monkeypatch.setattr(licenses, "saved", lambda words, form: (0, 0.0))
    assert licenses.notices(text) == []


def test_licenses_by_wording(spark):
    texts = ["Foo.\nLicensed under the Apache License, Version 2.0.\nBar", "licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0.", "This work is licensed under the GNU General Public License, version 2.", None, ""]
    texts += [prose(500) + ". Released under the MIT License. " + prose(500), "my license plate is gone", "All  rights\treserved.", "Released under the really good MIT License.", "All rights reserved.\nAll rights reserved."]
    got = {}
    for r in licenses.scan_licenses(documents(spark, list(enumerate(texts)))).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["exact"], texts[r["doc_id"]][r["start"] : r["end"]]))
    assert [got[i][0][:2] for i in (0, 1, 2, 3, 6, 8)] == [("Apache-2.0", True), ("CC-BY-NC-4.0", True), ("CC-BY-4.0", True), ("GPL-2.0", True), ("MIT", True), ("all-rights-reserved", True)]
    assert got[6][0][2] == "Released under the MIT License." and got[9][0][:2] == ("MIT", False) and len(got[10]) == 2
    assert set(got) == {0, 1, 2, 3, 6, 8, 9, 10}
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize("size", [60, 100, 150, 250, 350, 390, 500, 5000])
def test_notices_within_other_prose(size):
    for name, (notice, _) in licenses.TEMPLATES.items():
        before, after = prose(size)[: size // 2].rsplit(" ", 1)[0] + ". ", " " + prose(size)[: size // 2]
        for line in (before + notice, before + notice + after):
            got = [(n[2], n[4], line[n[0] : n[1]]) for n in licenses.notices(line)]
            assert got == [(name, True, notice)]
    two = licenses.notices(prose(30) + " Licensed under the MIT License or the Apache License, Version 2.0. " + prose(30))
    assert [n[2] for n in two] == ["Apache-2.0", "MIT"] or [n[2] for n in two] == ["MIT", "Apache-2.0"]
    assert licenses.notices("I was under the strong impression that in the end we only ever discussed the MIT License") == []


def test_notices_with_any_word_altered(spark):
    rng, texts = random.Random(11), []
    for form, (_, named, _) in licenses.templates().items():
        name, want, *_ = licenses.forms()[form]
        spare = [i for i in range(len(want)) if i not in named] if licenses.spare(form) else []
        for i in rng.sample(spare, min(len(spare), 12)):
            texts.append((name, f"{prose(60, rng)} {' '.join([*want[:i], 'zq' + prose(1, rng), *want[i + 1 :]])} {prose(60, rng)}"))
    for name, text in texts:
        assert [(n[2], n[4]) for n in licenses.notices(text)] == [(name, False)], text
    rows = [(0, "Licensed under the Apache Licence, Version 2.0."), (1, "All the rights are reserved."), (2, "Released under the MIT terms."), (3, "Licensed under Creative CC BY version 4.0.")]
    found = licenses.scan_licenses(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["license"], r["exact"]) for r in found) == [(0, "Apache-2.0", False), (1, "all-rights-reserved", False), (2, "MIT", False), (3, "CC-BY-4.0", False)]
    # A name or a version is never the altered word, nor is a kind of the license added.
    for text in ("Licensed under the Educational Community License, Version 2.0.", "Released under the BSD License.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under the GNU General Public License, version 1.", "This work is licensed under the Eclipse Public License, version 2.0."):
        assert licenses.notices(text) == [], text


def test_many_notices_in_one_text():
    assert len(licenses.notices("Released under the MIT License. " * 3000)) == 3000
    assert len(licenses.notices((licenses._GNU.format(kind="General", n="3").replace("hope", "wish") + "\n") * 30)) == 30


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "dnl ", "REM ", "; ", "> "])
@pytest.mark.parametrize("width", [30, 72])
def test_wrapped_headers_and_full_texts(mark, width):
    short = [(name, text, (telling,)) for name, (text, telling) in licenses.TEMPLATES.items()]
    for name, text, _ in [*short, *licenses.LONG_TEMPLATES]:
        assert re.search(licenses.CUE, text)
        page = "\n".join(mark + line for line in ["first line", "", *textwrap.wrap(text, width, break_long_words=False), "", "last line"])
        found = licenses.notices(page)
        assert [(n[2], n[4]) for n in found] == [(name, True)], (name, text, found)
    # Names instead of the template's, and paragraphs.
    body = "Copyright (c) 2020 Ann\n\n" + licenses._BSD_HEAD + "3. Neither the name of Ann nor the names of its contributors " + licenses._BSD_THIRD.split("contributors ")[1] + "\n\n" + licenses._BSD_TAIL
    assert [(n[2], n[4]) for n in licenses.notices(body)] == [("BSD-3-Clause", False)]
    assert licenses.notices("This is free of charge.\nRedistribution is not.") == []


# Near duplicates


def test_alignment_counts_like_the_full_table():
    rng = random.Random(6)
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.2] + [rng.choice("abcd") for _ in range(rng.randint(0, 5))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        whole = table[-1][-1]
        assert near_dups.common_words(a, b, 100) == whole
        if b:
            assert near_dups._aligned(a, b, 0.8) == (whole >= 0.8 * max(len(a), len(b)) - 1e-9)


def test_links_by_shingles_or_words():
    own = [str(i) for i in range(200)]
    edited = own[:40] + ["x"] + own[41:90] + ["y"] + own[91:]
    assert near_dups.similar(own, edited) and near_dups.similar(own, own[:165]) and not near_dups.similar(own, own[:155])
    assert not near_dups.similar(own, own[:140] + [f"z{i}" for i in range(60)])
    assert not near_dups.similar(own, own[100:] + own[:100])


def test_near_copies_meet_and_others_do_not(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(3000)]
    base = [prose(200, rng, words).split() for _ in range(30)]
    rows, want = [], {}
    for k, own in enumerate(base):
        for c in range(1 + k % 4):
            copy = list(own)
            for _ in range(c):
                copy[rng.randrange(200)] = rng.choice(words)
            rows.append((k * 100 + c, " ".join(copy)))
            want[k * 100 + c] = k * 100
    hot = prose(100, rng, words).split()
    for c in range(300):
        copy = list(hot)
        copy[rng.randrange(100)] = rng.choice(words)
        rows.append((10000 + c, "  ".join(copy).upper() if c % 2 else " ".join(copy)))
        want[10000 + c] = 10000
    # A passage that many texts share, and of them two that are near copies.
    passage = prose(140, rng, words)
    for c in range(80):
        rows.append((15000 + c, f"{passage} {prose(60, rng, words)}"))
        want[15000 + c] = 15000 + c
    rows.append((15100, rows[-1][1] + " end"))
    want[15100] = 15079
    alone = [(20000, None), (20001, ""), (20002, "one two"), (20003, "one three"), (20004, " "), (20005, prose(5, rng, words))]
    rows += [*alone, (20006, "one  TWO"), (None, rows[0][1]), (10000, rows[-84][1])]
    want |= {i: i for i, _ in alone} | {20006: 20002, None: 0}
    got = near_dups.near_duplicate_classes(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert near_dups.near_duplicate_classes(documents(spark, [])).count() == 0


def test_links_do_not_depend_on_who_leads(spark):
    """Words changed here and there: 0.94 of them aligned, but fewer than 0.8 of the shingles."""
    rng = random.Random(9)
    words = ["".join(rng.choice("mnopqrstuvwx") for _ in range(5)) for _ in range(3000)]
    own = prose(200, rng, words).split()
    copies = [own] + [[f"z{k}" if i % 16 == k else w for i, w in enumerate(own)] for k in (3, 8, 13)]
    assert not any(near_dups.similar(a, b) for a in copies for b in copies if a is not b)
    got = near_dups.near_duplicate_classes(documents(spark, [(i, " ".join(c)) for i, c in enumerate(copies)])).collect()
    assert all(r["class_id"] == r["doc_id"] for r in got)


def test_rare_pairs_lose_no_link(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(3):
        own = prose(80, rng).split()
        for _ in range(14):
            copy = list(own)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(80)] = rng.choice(VOCABULARY)
            texts.append(copy[: rng.randint(72, 80)])
    frame = spark.createDataFrame([(bytes([i]), bytes([i]), " ".join(t)) for i, t in enumerate(texts)], "node binary, comp binary, text string")
    got = {(r["a"][0], r["b"][0]) for r in near_dups._rare_pairs(frame, frame.select("node")).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and near_dups.similar(texts[i], texts[j])}
    assert want and want <= got


def brute_classes(texts):
    words = [near_dups.normal_words(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and near_dups.similar(words[i], words[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("length", [30, 45])
def test_one_large_group_and_a_shared_passage(spark, monkeypatch, length):
    """Classes as of all pairs; texts that are one component already are not paired again."""
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(4000)]
    own = prose(length, rng, words).split()
    texts = []
    for _ in range(400):
        copy = list(own)
        copy[rng.randrange(length)] = rng.choice(words)
        texts.append(" ".join(copy))
    passage = prose(60, rng, words)
    texts += [f"{passage} {prose(40, rng, words)}" for _ in range(60)]
    met, whole = [], near_dups._rare_pairs

    def counted(*args):
        pairs = whole(*args).cache()
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_dups, "_rare_pairs", counted)
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicate_classes(documents(spark, list(enumerate(texts)))).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(met) <= 4 * len(texts)


def test_recall_of_the_sketches():
    """Of pairs whose shingles are 0.8 to 0.9 alike, nearly all share a band."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(4000)]
    found = pairs = 0
    while pairs < 400:
        own = prose(150, rng, words).split()
        copy = own[: rng.randint(128, 140)]
        if rng.random() < 0.5:
            copy = list(own)
            copy[rng.randrange(150)] = "x"
            copy[rng.randrange(150)] = "y"
        one, two = near_dups.shingles(own), near_dups.shingles(copy)
        alike = len(set(one) & set(two)) / len(set(one) | set(two))
        if not near_dups.SIMILARITY <= alike < 0.9:
            continue
        number = {s: k for k, s in enumerate(dict.fromkeys(one + two))}
        keys = [near_dups.order_sketch(near_dups.labelled(near_dups.mix(np.array([number[s] for s in x], np.uint64) + np.uint64(99)))) for x in (one, two)]
        found += any(a == b for a, b in zip(*keys))
        pairs += 1
    assert found >= 0.99 * pairs


# Language


def test_gradients_by_differences():
    model = language.ByteNetwork(["a", "b"])
    codes, lengths, order = language.pad([b"abc", b"hello", b"z"])
    labels = np.array([0, 1, 1])[order]
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    _, grads = model.gradients(codes, lengths, labels)
    for name, own in grads.items():
        place = np.unravel_index(np.abs(own).argmax(), own.shape)
        kept = model.weights[name][place]
        sides = []
        for step in (1e-3, -1e-3):
            model.weights[name][place] = kept + step
            sides.append(model.gradients(codes, lengths, labels)[0])
        model.weights[name][place] = kept
        assert abs((sides[0] - sides[1]) / 2e-3 - own[place]) < 2e-3 * max(1, abs(own[place]))


def test_language_on_rows_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train_language_model(docs)
    found = language.predict_language(docs, model, ("doc_id", "lang")).withColumn("held", language.held_out(F.col("doc_id")))
    right = found.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.9
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "…—"), (5, "Привет"), (6, prose(9) * 3000), (7, "x" * 5000), (None, "the and of"), (7, "x" * 5000)]
    got = language.predict_language(documents(spark, odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert language.train_language_model(docs.limit(0)) is None
    assert {r["lang_pred"] for r in language.predict_language(documents(spark, odd), None).collect()} == {"und"}
    assert language.predict_language(docs.limit(0), model).count() == 0


def test_words_of_a_slice_are_found_in_pieces(monkeypatch):
    from lotwise.llm import language

    texts = [f"wort{i % 37} word{i} " * 400 for i in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": texts})
    found, sizes = language.sequences, []
    monkeypatch.setattr(language, "sequences", lambda data, offsets: sizes.append(len(data)) or found(data, offsets))
    run = language._predict(language.ByteNetwork(["de", "en"]), ["doc_id"])
    in_pieces = [p.to_pydict() for p in run(iter([batch]))]
    assert max(sizes) <= 1 << 19 and sum(sizes) == sum(map(len, texts))
    monkeypatch.setattr(language, "PIECE_BYTES", language.SLICE_BYTES)
    assert [p.to_pydict() for p in run(iter([batch]))] == in_pieces
