"""Near duplicates by Order MinHash and banded alignment."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.llm.common import SPACE_WORDS, checkpointed, lower_ascii, mix, slices, split_words, text_bytes

WORDS = 5  # of one shingle
SIMILARITY = 0.8  # different shingles in common, aligned, of all different ones
BANDS = 12  # sketches of a text
PICKED = 3  # shingles of one sketch
ROUNDS = 2  # in which one text of a bucket is compared with the rest
_WIDE = 1 << 16  # shingles hashed for all bands at once

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def normal_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return lower_ascii(np.frombuffer((text or "").encode(), np.uint8)).tobytes().split()


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of shingles with the number of their occurrence, in text order.

    Repeats are left out where there are enough first occurrences to sample from, so that a line
    said a hundred times does not crowd out the text.
    """
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    begins = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    number = np.arange(len(ranked)) - np.repeat(begins, np.diff(np.append(begins, len(ranked))))
    out = np.empty_like(shingles)
    out[order] = mix(ranked + number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out[np.sort(order[begins])] if len(begins) >= PICKED else out


def few_key(shingles: np.ndarray) -> list[int]:
    """One more key for a text of fewer different shingles than a sketch picks: these in text order,
    without the number of their occurrence, since similarity does not count repeats."""
    found, at = np.unique(shingles, return_index=True)
    if len(found) >= PICKED:
        return []
    own = np.uint64(len(found))
    for i in np.sort(at):
        own = mix(own * np.uint64(3) + shingles[i : i + 1])[0]
    return [int(np.int64(own.view(np.int64)))]


def order_sketch(labels: np.ndarray) -> list[int]:
    """One key per band: its smallest labelled shingles, in the order of the text."""
    keys = np.empty(BANDS, np.uint64)
    take = min(PICKED, len(labels))
    step = BANDS if len(labels) <= _WIDE else 1
    for a in range(0, BANDS, step):
        values = mix(labels[:, None] ^ _SEEDS[None, a : a + step])
        at = np.argpartition(values, take - 1, axis=0)[:take] if take < len(labels) else np.broadcast_to(np.arange(take)[:, None], (take, values.shape[1]))
        at = np.sort(at, axis=0)
        own = _SEEDS[a : a + step].copy()
        for row in at:
            own = mix(own * np.uint64(3) + labels[row])
        keys[a : a + step] = own
    return keys.astype(np.int64).tolist()


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            data = lower_ascii(data)
            words = split_words(data, offsets, SPACE_WORDS)
            runs = words.runs(WORDS)
            node, size, different, keys = [], [], [], []
            for i in range(part.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                size.append(b - a)
                if a == b:
                    node.append(None)
                    different.append(0)
                    keys.append([])
                    continue
                node.append(blake2b(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split()), digest_size=16).digest())
                # A text of fewer words than a shingle is near to no other.
                own = runs[a : max(a, b - WORDS + 1)]
                different.append(len(np.unique(own)))
                keys.append(order_sketch(labelled(own)) + few_key(own) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(node, pa.binary()), pa.array(size, pa.int32()), pa.array(different, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "node", "n_words", "size", "keys"],
            )


def common_words(a: list, b: list, band: int) -> int:
    """Length of the longest common subsequence whose pairs lie within ``band`` of the diagonal.

    The rows of the alignment are bits of one whole number, so a row is a few operations.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return head + tail
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for j, w in enumerate(b):
        here = places.get(w)
        if here is None:
            continue
        low, high = max(0, j - band), min(len(a), j + band + 1)
        if low >= high:
            continue
        here &= ((1 << (high - low)) - 1) << low
        both = row & here
        row = ((row + both) | (row - both)) & full
    return head + tail + len(a) - row.bit_count()


def _aligned(a: list, b: list, least: float) -> bool:
    """Aligned items are at least ``least`` of the longer sequence.

    An alignment that good never leaves the diagonal by more than the items it may miss, so a band
    of that width decides exactly.
    """
    longer = max(len(a), len(b))
    need = int(np.ceil(least * longer - 1e-9))
    if min(len(a), len(b)) < need or (Counter(a) & Counter(b)).total() < need:
        return False
    return common_words(a, b, longer - need) >= need


def shingles(words: list) -> list:
    """Different five-word shingles in the order in which they first occur."""
    return list(dict.fromkeys(tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))


def similar(a: list, b: list) -> bool:
    """A link: of all different shingles of both texts ``SIMILARITY`` are common to an alignment of
    the two."""
    one, two = shingles(a), shingles(b)
    common = len(set(one).intersection(two))
    # common / (all - common) is at least so much
    need = int(np.ceil((len(one) + len(two)) * SIMILARITY / (1 + SIMILARITY) - 1e-9))
    return common >= need > 0 and common_words(one, two, max(len(one), len(two)) - need) >= need


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, last, words = [], None, []
        ones, twos = batch.column("text_a"), batch.column("text_b")
        # Pair by pair: a batch may hold thousands of long texts.
        for i in range(batch.num_rows):
            one = ones[i].as_buffer()
            if last is None or not one.equals(last):
                last, words = one, _buffer_words(one)
            if similar(words, _buffer_words(twos[i].as_buffer())):
                kept.append(i)
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"])


def _buffer_words(text: pa.Buffer) -> list[bytes]:
    return lower_ascii(np.frombuffer(text, np.uint8)).tobytes().split()


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return checkpointed(with_both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a binary, b binary"))


def _fit(one: str, two: str):
    """Two texts with so many different shingles can be links."""
    return F.least(one, two) >= F.greatest(one, two) * SIMILARITY - 1e-6


def _groups(texts: DataFrame, members: DataFrame) -> DataFrame:
    """(node, label) of the texts that have links: one label for each component.

    ``members`` has (bucket, node, size, near); ``near`` is how many texts share a bucket with it. In
    a few rounds the text of each bucket that is nearest to most is compared with those that are left
    there: a group of copies meets its original, which settles it at the cost of its size. A text is
    settled in a bucket if it is in the component of that bucket's first leader, by whatever links: of two
    texts of a bucket in different components one at least is not. What is then left, texts that share a passage and
    little else, is compared across components with the texts of its buckets that share one of its
    rarest shingles: any text as similar as ``SIMILARITY`` does.
    """
    left, links, seen, firsts = members, None, None, None
    for _ in range(ROUNDS):
        lead = left.groupBy("bucket").agg(F.min(F.struct((-F.col("near")).alias("far"), "node", "size")).alias("lead"))
        asked = checkpointed(left.join(lead, "bucket").select("bucket", "node", "size", "near", F.col("lead.node").alias("leader"), F.col("lead.size").alias("led")))
        # Every text of every bucket beside its first leader.
        firsts = asked.select("bucket", "node", "leader") if firsts is None else firsts
        fit = asked.where((F.col("node") != F.col("leader")) & _fit("size", "led"))
        pairs = fit.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        pairs = checkpointed(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        seen = pairs if seen is None else seen.unionByName(pairs)
        found = _compare(pairs, texts)
        links = found if links is None else links.unionByName(found)
        both_ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("leader"))
        left = checkpointed(asked.where(F.col("node") != F.col("leader")).join(both_ways, ["node", "leader"], "left_anti").select("bucket", "node", "size", "near", "leader"))
    labels = components(links)
    open_ = _labelled(_labelled(firsts, labels, "node", "comp"), labels, "leader", "led_by").where(F.col("comp") != F.col("led_by"))
    open_ = checkpointed(open_.select("bucket", "node"))
    around = _labelled(members.join(open_.select("bucket").distinct(), "bucket").select("node").distinct(), labels, "node", "comp")
    rest = _rare_pairs(texts.join(around, "node"), open_.select("node").distinct())
    found = _compare(checkpointed(rest.join(seen, ["a", "b"], "left_anti")), texts)
    if found.isEmpty():
        return labels
    # The new links join whole components: only these are labelled again.
    own = labels.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    ends = _labelled(_labelled(found, labels, "a", "one"), labels, "b", "two").where(F.col("one") != F.col("two"))
    joined = components(ends.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct())
    moved = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return checkpointed(own.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of ``node``; a node without links is its own."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _rare_pairs(texts: DataFrame, left: DataFrame) -> DataFrame:
    """Pairs of a text of ``left`` with any text of another component (``comp``) that share one of the
    shingles rarest in both.

    Of n shingles, two texts as similar as ``SIMILARITY`` have so many in common that the n - 0.8 n
    + 1 rarest of either hold one of them; shingles found in one text only pair nothing. The first one
    in common leaves enough behind it in both. Components meet first, one row for each shingle, so a
    group whose texts are linked already meets others once and itself never.
    """
    own = checkpointed(texts.select("node", "comp", "text").mapInArrow(_shingle_hashes, "node binary, comp binary, shingles array<long>"))
    each = own.select("node", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("texts")).where(F.col("texts") > 1)
    shared = each.join(often, "shingle").groupBy("node", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("texts", "shingle"))).alias("ranked"))
    first = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1 - (F.col("n") - F.size("ranked"))
    top = F.slice("ranked", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))
    rare = shared.select("node", "comp", "n", F.size("ranked").alias("held"), F.posexplode(top).alias("at", "s"))
    # Shingles from this place on: of two texts' first common one, no more than these can be common.
    rare = rare.select("node", "comp", "n", (F.col("held") - F.col("at")).alias("rest"), F.col("s.shingle").alias("shingle"))
    rare = checkpointed(rare.join(left.withColumn("open", F.lit(True)), "node", "left").withColumn("open", F.coalesce("open", F.lit(False))))
    groups = rare.groupBy("shingle", "comp").agg(
        F.max("open").alias("open"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("rest"), F.count("*").alias("nodes")
    )

    def side(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return rows.select("shingle", *[F.col(c).alias(f"{c}_{name}") for c in columns])

    # The smaller group of the two is side a, and is spread out first.
    columns = ["comp", "open", "least", "most", "rest", "nodes"]
    smaller = (F.col("nodes_a") < F.col("nodes_b")) | ((F.col("nodes_a") == F.col("nodes_b")) & (F.col("comp_a") < F.col("comp_b")))
    possible = (F.least("most_a", "most_b") >= F.greatest("least_a", "least_b") * SIMILARITY - 1e-6) & (
        F.least("rest_a", "rest_b") * (1 + SIMILARITY) >= (F.col("least_a") + F.col("least_b")) * SIMILARITY - 1e-6
    )
    met = side(groups, "a", columns).join(side(groups, "b", columns), "shingle")
    met = met.where((F.col("comp_a") != F.col("comp_b")) & smaller & (F.col("open_a") | F.col("open_b")) & possible)
    met = checkpointed(met.select("shingle", "comp_a", "comp_b", F.col("open_b").alias("any_b")))
    columns = ["comp", "node", "open", "n", "rest"]
    enough = F.least("rest_a", "rest_b") * (1 + SIMILARITY) >= (F.col("n_a") + F.col("n_b")) * SIMILARITY - 1e-6
    pairs = (
        met.join(side(rare, "a", columns), ["shingle", "comp_a"])
        .where(F.col("open_a") | F.col("any_b"))
        .join(side(rare, "b", columns), ["shingle", "comp_b"])
        .where((F.col("open_a") | F.col("open_b")) & _fit("n_a", "n_b") & enough)
    )
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _shingle_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_bytes(part.column("text"))
            words = split_words(lower_ascii(data), offsets, SPACE_WORDS)
            runs = words.runs(WORDS)
            spans = zip(words.first[:-1].tolist(), words.first[1:].tolist())
            hashes = [np.unique(runs[a : b - WORDS + 1]).view(np.int64) if b - a >= WORDS else [] for a, b in spans]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("comp"), pa.array(hashes, pa.list_(pa.int64()))], ["node", "comp", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of the links."""
    ways = checkpointed(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct())
    labels = checkpointed(ways.groupBy("node").agg(F.min("other").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        heard = ways.join(labels.select(F.col("node").alias("other"), F.col("label").alias("given")), "other").groupBy("node").agg(F.min("given").alias("given"))
        stepped = labels.join(heard, "node").select("node", "label", F.least("label", "given").alias("given"))
        # Follow the label's own label, so that chains halve.
        jumped = stepped.join(labels.select(F.col("node").alias("given"), F.col("label").alias("beyond")), "given")
        after = checkpointed(jumped.select("node", F.col("label").alias("before"), F.least("given", "beyond").alias("label")))
        labels = after.select("node", "label")
        if after.where(F.col("before") != F.col("label")).isEmpty():
            return labels


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """Class of every document: doc_id, class_id (the smallest doc_id of the class), n_words, class_texts.

    Texts of equal words are one text. Texts that share an Order MinHash sketch (three minimum
    occurrence-labelled five-word shingles, in text order, in one of twelve bands) are candidates; a
    candidate is a link if by a banded alignment the two share 0.8 or more of all their different
    five-word shingles. Classes are the connected components of the links. ``class_texts`` counts the
    different texts of the class. Words are divided by ASCII white space, A-Z in lower case. Two texts
    of shingle similarity 0.8 share no band once in 5 000 times.

    Null texts and texts without words are classes of their own, as are texts under five words
    that no other text repeats. Repeated rows share their class. A null doc_id never names a class
    unless all its documents have none. Other columns are not read.
    """
    rows = checkpointed(docs.select("doc_id", "text").mapInArrow(_sketch, f"doc_id {dict(docs.dtypes)['doc_id']}, node binary, n_words int, size int, keys array<long>"))
    held = rows.where(F.col("node").isNotNull())
    nodes = checkpointed(held.groupBy("node").agg(F.min("doc_id").alias("doc"), F.min("size").alias("size"), F.first("keys").alias("keys")))
    spread = nodes.select("node", "size", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node", "size")
    spread = checkpointed(spread.distinct())
    shared = checkpointed(spread.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    members = spread.join(shared, "bucket")
    near = members.groupBy("node").agg(F.sum("n").alias("near"))
    members = checkpointed(members.drop("n").join(near, "node"))
    # Texts of the members, once each; the rest of the documents' text is not kept.
    wanted = members.select("node").distinct().join(nodes.select("node", "doc"), "node")
    first = docs.select("doc_id", "text").join(wanted.where(F.col("doc").isNotNull()).withColumnRenamed("doc", "doc_id"), "doc_id")
    nameless = docs.where(F.col("doc_id").isNull()).select("text").mapInArrow(_with_node, "node binary, text string")
    nameless = nameless.join(wanted.where(F.col("doc").isNull()).select("node"), "node", "left_semi")
    texts = checkpointed(first.mapInArrow(_own_text, "node binary, text string").unionByName(nameless).dropDuplicates(["node"]))
    labels = nodes.join(_groups(texts, members), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    named = labels.join(nodes.select("node", "doc"), "node")
    classes = named.groupBy("label").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_texts"))
    named = checkpointed(named.join(classes, "label").select("node", "class_id", "class_texts"))
    return rows.join(named, "node", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n_words").cast("long").alias("n_words"), F.coalesce("class_texts", F.lit(1)).cast("long").alias("class_texts")
    )


def _with_node(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text with words and the digest of these."""
    for batch in batches:
        nodes = []
        for text in batch.column("text"):
            words = normal_words(text.as_py())
            nodes.append(blake2b(b" ".join(words), digest_size=16).digest() if words else None)
        node = pa.array(nodes, pa.binary())
        yield pa.RecordBatch.from_arrays([node, batch.column("text")], ["node", "text"]).filter(node.is_valid())


def _own_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is the one of the node; rows of one doc_id may hold several texts."""
    for batch in batches:
        kept = []
        for i, (node, text) in enumerate(zip(batch.column("node"), batch.column("text"))):
            words = normal_words(text.as_py())
            if words and blake2b(b" ".join(words), digest_size=16).digest() == node.as_py():
                kept.append(i)
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("text")], ["node", "text"])
