"""Main text of pages by wrappers: union-free expressions inferred from pages of one host."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import checkpointed
from lotwise.llm.url_filter import url_host

DEEPEST = 100  # levels of nesting that are told apart; deeper elements join the level above
HELD_HOSTS = 1000  # wrappers a task keeps before it passes them on
SALTS = 32
BROADCAST_BYTES = 16 << 20  # all wrappers together, measured, for them to be sent to every task
LONGEST_GROUP = 6  # sibling elements that may form one repeated group
SHARED = 3  # different pages that show the same text at a place outside an article for it to be template text

_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")
_ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME_ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SCOPE = set("html body table ul ol dl div section article main aside nav header footer form td th button figure blockquote".split())
_BOILERPLATE_TAGS = set("head nav footer aside form button select dialog menu object canvas".split()) | set(_RAW)
_BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header legal "
    "masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo related replies respond share sharing sidebar social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split()
)
_NEVER_BOILERPLATE = {"html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p"} | _INLINE
# Names that say enough within an article, if nothing is joined to them; the others are words of sections as well.
_CLEAR_WORDS = set(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments cookie cookies disqus modal nav navbar navigation newsletter pager pagination "
    "popup promo share sharing sidebar sponsored subscribe toolbar widget widgets".split()
)

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(_RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|(?P<text>[^<]++|<)",
    re.IGNORECASE | re.DOTALL,
)
_attribute = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_name_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

TEXT = "#"
LOOSE = "loose"


@lru_cache(maxsize=20_000)
def symbol(name: str, attributes: str) -> str:
    """Name of an element with its class, id and role, without numbers; words of one are joined by "-"."""
    said = [_name_words.findall(x) for m in _attribute.finditer(attributes) for x in (m[2] or m[3] or m[4] or "").split()]
    return ".".join([name, *dict.fromkeys("-".join(w.lower() for w in words) for words in said if words)])


def _name(own: str) -> str:
    return own.split(".", 1)[0]


@lru_cache(maxsize=20_000)
def boilerplate(own: str) -> bool:
    """True for elements that hold menus, notices, adverts, forms, comments and the like."""
    return _name(own) in _BOILERPLATE_TAGS or worded(own)


@lru_cache(maxsize=20_000)
def worded(own: str) -> bool:
    """True if it is by a word of its class, id or role; never for headings, paragraphs and inline elements."""
    name, *words = own.replace("-", ".").split(".")
    return name not in _BOILERPLATE_TAGS | _NEVER_BOILERPLATE and not _BOILERPLATE_WORDS.isdisjoint(words)


@lru_cache(maxsize=20_000)
def clear(own: str) -> bool:
    """True if each word of one of its names says so within an article too."""
    return worded(own) and any(_CLEAR_WORDS.issuperset(token.split("-")) for token in own.split(".")[1:])


def parse(page: str) -> list:
    """Tree of a page as (symbol, children) with texts among the children; missing ends are filled in."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]

    def close(names: set[str], stop: set[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in names:
                del stack[depth:]
                return
            if stack[depth][0] in stop:
                return

    for m in _token.finditer(page):
        if m["text"] is not None:
            into = stack[-1][1]
            if into and isinstance(into[-1], str):
                into[-1] += m["text"]
            else:
                into.append(m["text"])
        elif m["name"]:
            name = m["name"].lower()
            if m["end"]:
                if name == "p" and not any(n == "p" for n, _ in stack):
                    stack[-1][1].append(("p", []))
                close({name}, set() if name in _SCOPE else _SCOPE - {name})
                continue
            if name in _ENDS_P:
                close({"p"}, _SCOPE)
            if name in _SAME_ENDS:
                close(set(_SAME_ENDS[name].split()), {"ul", "ol", "dl", "table", "select"})
            children: list = []
            if len(stack) > DEEPEST:
                children = stack[-1][1]
            else:
                stack[-1][1].append((symbol(name, m["attributes"]), children))
            if name not in _VOID and not m["attributes"].endswith("/"):
                stack.append((name, children))
    return root


def _digest(text: str) -> str:
    return blake2b(text.encode(errors="surrogatepass"), digest_size=6).hexdigest()


def _slot(text: str, page: str) -> dict:
    words = " ".join(text.split())
    return {"k": TEXT, "n": 1, "c": len(words), "t": _digest(words), "d": [page]}


def shape(children: list, page: str = "", inside: bool = False) -> list[dict]:
    """Expression of one page's elements: repeated siblings become groups, texts become slots. ``page``
    tells different pages apart; ``inside`` says that they are within an article."""
    out = []
    for child in children:
        if isinstance(child, str):
            if not child.isspace():
                out.append(_slot(child, page))
        elif not boilerplate(child[0]):
            out.append({"k": child[0], "n": 1, "ch": shape(child[1], page, inside or _name(child[0]) in ("article", "main"))})
        elif inside and worded(child[0]) and not clear(child[0]):
            out.append({"k": child[0], "n": 1, "d": [page], "ch": shape(child[1], page, True)})
        else:  # what is inside never matters
            out.append({"k": child[0], "n": 1, "ch": []})
    return repeated(out, 1)


def _pages(a: dict, b: dict) -> list[str]:
    """Different pages that show a place, as many as are asked for."""
    return sorted({*a.get("d", ()), *b.get("d", ())})[:SHARED]


def _united(a: dict, b: dict, pages: int | None = None) -> dict:
    """One node for two that stand at the same place; ``pages`` if both are on the same page."""
    own = {"k": a["k"], "n": pages if pages is not None else a["n"] + b["n"]}
    for flag in "or":
        if a.get(flag) or b.get(flag):
            own[flag] = 1
    if a["k"] == TEXT:
        own |= {"c": a["c"] + b["c"], "t": a["t"] if a["t"] == b["t"] else ""}
        if own["t"]:
            own["d"] = _pages(a, b)
    else:
        own["ch"] = align(a["ch"], b["ch"], pages)
        if a.get("d") or b.get("d"):
            own["d"] = _pages(a, b)
    return own


def repeated(nodes: list[dict], pages: int | None = None) -> list[dict]:
    """Fold tandem repeats of up to ``LONGEST_GROUP`` siblings into repeated groups."""
    nodes = list(nodes)
    for size in range(1, LONGEST_GROUP + 1):
        i = 0
        while i + 2 * size <= len(nodes):
            first, second = nodes[i : i + size], nodes[i + size : i + 2 * size]
            if all(a["k"] == b["k"] for a, b in zip(first, second)) and not (size == 1 and first[0]["k"] == TEXT):
                if size == 1:
                    nodes[i : i + 2] = [_united(first[0], second[0], pages) | {"r": 1}]
                else:
                    nodes[i : i + 2 * size] = [_united(a, b, pages) | {"r": 1} for a, b in zip(first, second)]
            else:
                i += 1
    return nodes


def align(a: list[dict], b: list[dict], pages: int | None = None) -> list[dict]:
    """Resolve the mismatches of two expressions: what only one of them has becomes optional, what
    comes to stand beside its like becomes a repeated group."""
    if [x["k"] for x in a] == [x["k"] for x in b]:
        return [_united(x, y, pages) for x, y in zip(a, b)]
    match = SequenceMatcher(None, [x["k"] for x in a], [x["k"] for x in b], autojunk=False)
    out = []
    for kind, i, j, k, m in match.get_opcodes():
        if kind == "equal":
            out += [_united(x, y, pages) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [x | {"o": 1} for x in [*a[i:j], *b[k:m]]]
    return repeated(out, pages)


def united(a: dict, b: dict) -> dict:
    """The wrapper of two sets of pages."""
    return {"n": a["n"] + b["n"], "ch": align(a["ch"], b["ch"])}


def _kind(node: dict) -> str:
    return node["k"].split(".", 1)[0]


def mark_apart(nodes: list[dict], last: bool) -> None:
    """Mark the places of an article that are apart from its own blocks: named like boilerplate, on
    several different pages, without a main heading, and either after all other blocks or with the
    same text on each page. ``last`` says that no own block follows the nodes."""
    for node in reversed(nodes):
        if node["k"] == TEXT:
            last = False
        elif boilerplate(node["k"]):
            if worded(node["k"]) and len(node.get("d", ())) >= SHARED and not _holds_title(node["ch"]) and (last or _constant(node["ch"])):
                node["x"] = 1
            elif worded(node["k"]) and not clear(node["k"]):
                mark_apart(node["ch"], last)
                last = False
        else:
            mark_apart(node["ch"], last)
            last = False


def _holds_title(nodes: list[dict]) -> bool:
    return any(_kind(n) == "h1" or _holds_title(n.get("ch", ())) for n in nodes)


def _constant(nodes: list[dict]) -> bool:
    return all(n["t"] != "" if n["k"] == TEXT else _constant(n["ch"]) for n in nodes)


def mark_main(wrapper: dict) -> dict:
    """Mark the nodes of the wrapper that hold the article: `article` elements, and `main` elements."""

    def look(nodes: list[dict]) -> None:
        for node in nodes:
            if node["k"] == TEXT or boilerplate(node["k"]):
                continue
            if _kind(node) in ("article", "main"):
                node["m"] = _kind(node)
                mark_apart(node["ch"], True)
            if _kind(node) != "article":
                look(node["ch"])

    look(wrapper["ch"])
    return wrapper


def _next(nodes: list[dict], key: str, at: int) -> int:
    """Place of the expression's next node with this key; groups may begin again."""
    for i in (*range(at, len(nodes)), *range(0, at)):
        if nodes[i]["k"] == key:
            return i
    return -1


def _folded(keys: list[str]) -> list[tuple[str, list[int]]]:
    """Keys after ``repeated``, each with the places of the siblings that it stands for."""
    nodes = [(key, [i]) for i, key in enumerate(keys)]
    for size in range(1, LONGEST_GROUP + 1):
        i = 0
        while i + 2 * size <= len(nodes):
            if all(nodes[j][0] == nodes[j + size][0] for j in range(i, i + size)) and not (size == 1 and nodes[i][0] == TEXT):
                nodes[i : i + 2 * size] = [(nodes[j][0], nodes[j][1] + nodes[j + size][1]) for j in range(i, i + size)]
            else:
                i += 1
    return nodes


def _places(children: list, nodes: list[dict]) -> list[dict | None]:
    """Node of each child, by the alignment that built the wrapper; what it leaves out takes the next
    node with its key."""
    kept = [i for i, c in enumerate(children) if not isinstance(c, str) or not c.isspace()]
    keys, wanted = [TEXT if isinstance(children[i], str) else children[i][0] for i in kept], [n["k"] for n in nodes]
    places = [-1] * len(keys)
    own = [(k, [i]) for i, k in enumerate(keys)] if keys == wanted else _folded(keys)
    if [k for k, _ in own] == wanted:
        same = [(0, 0, len(own))]
    else:
        same = SequenceMatcher(None, wanted, [k for k, _ in own], autojunk=False).get_matching_blocks() if nodes else []
    for a, b, size in same:
        for k in range(size):
            for i in own[b + k][1]:
                places[i] = a + k
    out: list[dict | None] = [None] * len(children)
    at = 0
    for i, key, place in zip(kept, keys, places):
        if place < 0:
            place = _next(nodes, key, at)
        if place >= 0:
            out[i], at = nodes[place], place
    return out


def _blocks(children: list, nodes: list[dict], inside: bool, choice: str, out: list[list[str]]) -> None:
    """Text of the nodes marked as ``choice``, or of all; an empty list in ``out`` begins a block."""
    for child, node in zip(children, _places(children, nodes)):
        key = TEXT if isinstance(child, str) else child[0]
        if key == TEXT:
            constant = node is not None and node["t"] != "" and len(node["d"]) >= SHARED
            if inside or choice == LOOSE and not constant:
                out[-1].append(child)
            continue
        name = key.split(".", 1)[0]
        if boilerplate(key) and not (inside and (name == "header" or worded(key) and not clear(key) and not (node and node.get("x")))):
            out.append([])
            continue
        if name not in _INLINE:
            out.append([])
        if name == "br":
            out[-1].append(" ")
        _blocks(child[1], node["ch"] if node else [], inside or (node.get("m") == choice if node else name == choice), choice, out)
        if name not in _INLINE:
            out.append([])


def extract(page: str, wrapper: dict) -> str:
    """Blocks of the article, in page order: of `article` elements, else of `main`, else of all that
    is not template text. A choice that gives no block leaves the page to the next."""
    tree = parse(page)
    for choice in ("article", "main", LOOSE):
        out: list[list[str]] = [[]]
        _blocks(tree, wrapper["ch"], False, choice, out)
        blocks = [" ".join(html.unescape("".join(parts)).split()) for parts in out]
        blocks = [b for b in blocks if b]
        if blocks:
            return "\n\n".join(blocks)
    return ""


def page_wrapper(page: str) -> dict:
    return {"n": 1, "ch": shape(parse(page), _digest(page))}


def _infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of one task."""
    held: dict[str, dict] = {}

    def packed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"])
        held.clear()
        return out

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not page:
                continue
            own = page_wrapper(page)
            held[host] = united(held[host], own) if host in held else own
            if len(held) >= HELD_HOSTS:
                yield packed()
    if held:
        yield packed()


def _fold(group: pd.DataFrame) -> pd.DataFrame:
    wrapper = None
    for one in sorted(group["wrapper"]):
        own = json.loads(one)
        wrapper = own if wrapper is None else united(wrapper, own)
    return pd.DataFrame({"host": [group["host"].iloc[0]], "salt": [int(group["salt"].iloc[0]) // SALTS], "wrapper": [json.dumps(wrapper)]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """One wrapper per host from all its pages: host, wrapper (JSON of the expression).

    Tasks align the pages they read; their wrappers meet per host in two steps, so that a hot host
    brings one small row from each task.
    """
    parts = pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(_infer, "host string, wrapper string")
    schema = "host string, salt int, wrapper string"
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    return parts.groupBy("host", "salt").applyInPandas(_fold, schema).withColumn("salt", F.lit(0)).groupBy("host").applyInPandas(_fold, schema).select("host", "wrapper")


def _extract(carry: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column("_html").to_pylist(), batch.column("_wrapper").to_pylist()):
                if not page or wrapper is None:
                    texts.append("")
                    continue
                if wrapper not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    known[wrapper] = mark_main(json.loads(wrapper))
                texts.append(extract(page, known[wrapper]))
            columns = {n: batch.column(n) for n in carry} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def extract_text(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of every page, from the wrapper of its host.

    Returns the columns of ``carry``, then text (blocks joined by an empty line; empty if none) and
    n_chars. Null or empty html has empty text; pages without a host share one wrapper; repeated rows
    give repeated rows; of the input only ``carry``, url and html are read. The wrapper says which
    places hold the article: of each page those in `article`, else those in `main`. Pages without
    either give the text outside menus and the like that is not the same on all different pages of the
    host that show its place. Within an article, a section whose name has a word of menus and the like
    is left out if the name says nothing else, or if the wrapper shows it as a place apart: on three
    different pages, after the article's own blocks or with the same text, and without an h1. Headings,
    paragraphs and inline elements never are by their names.
    """
    types = dict(pages.dtypes)
    wrappers = checkpointed(infer_wrappers(pages))
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wrappers = F.broadcast(wrappers)
    asked = pages.select(*carry, F.col("html").alias("_html"), url_host(F.col("url")).alias("_host"))
    joined = asked.join(wrappers.select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper")), "_host", "left").drop("_host")
    result = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "text string, n_chars long"])
    return joined.mapInArrow(_extract(list(carry)), result)
