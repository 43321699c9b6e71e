"""Exact top-k search by inner product with cover trees over queries and data together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.llm.common import checkpointed

SCALE = 1024.0
PIVOTS = 16  # cells of the trees' top level, chosen from a sample
SAMPLE = 512  # distinct vectors the cells are chosen from
BLOCK = 1024  # vectors of one block of a cell; building a tree over far-apart points costs their square
CHUNK = 2048  # queries of one chunk
LEAF = 32
FLAT = 8  # a node stays a leaf if an eighth of its points don't cover it
_EXACT = float(1 << 53)


class CoverTree:
    """Nodes with a center, a covering radius and either children or points.

    Children of a node are centers more than half its radius apart that cover its points within
    half the radius; splitting ends at ``LEAF`` points, at copies of one point, and at points so far
    apart that most would be centers.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(points)), 0, -1)]
        kids: dict[int, list[int]] = {}
        while todo:
            own, center, parent = todo.pop()
            gap = self._gap(own, center)
            radius, node = float(gap.max()), len(self.center)
            self.center.append(center)
            self.radius.append(radius)
            self.members.append(own)
            self.children.append(None)
            kids.setdefault(parent, []).append(node)
            if len(own) <= LEAF or radius == 0:
                continue
            owner, centers = np.zeros(len(own), np.int64), [center]
            while gap.max() > radius / 2 and len(centers) <= max(LEAF, len(own) // FLAT):
                nearest = int(own[gap.argmax()])
                other = self._gap(own, nearest)
                owner[other < gap] = len(centers)
                centers.append(nearest)
                gap = np.minimum(gap, other)
            if gap.max() <= radius / 2:
                todo += [(own[owner == i], c, node) for i, c in enumerate(centers)]
        for node, own in kids.items():
            if node >= 0:
                self.children[node] = np.array(own)
        self.centers = points[self.center]
        self.radii = np.array(self.radius)
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.leaf = np.array([c is None for c in self.children])

    def _gap(self, own: np.ndarray, center: int) -> np.ndarray:
        apart = self.points[own] - self.points[center]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))


class DualSearch:
    """The ``k`` best (score, id) of each query, ties to the smaller id."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> None:
        biggest = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, data.shape[1])
        self.whole = biggest < _EXACT
        self.data, self.ids, self.queries, self.k = data, ids, queries, k
        self.real_data, self.real_queries = data.astype(np.float64), queries.astype(np.float64)
        self.score = np.full((len(queries), k), -np.iinfo(np.int64).max, np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor.astype(np.float64)  # no score under this can be among the k best
        self.tree, self.asked = CoverTree(self.real_data), CoverTree(self.real_queries)
        self.visit(0, np.array([0]))

    def visit(self, node: int, others: np.ndarray) -> None:
        """Search the data nodes ``others`` for the queries of one query node."""
        asked, tree = self.asked, self.tree
        radius, norm = asked.radii[node], asked.norms[node]
        reach = tree.centers[others] @ asked.centers[node] + radius * tree.norms[others] + tree.radii[others] * norm + tree.radii[others] * radius
        # Half a point of slack covers rounding, as scores are whole numbers.
        kept = reach * (1 + 1e-12) + 0.5 >= self.floor[asked.members[node]].min()
        others = others[kept][np.argsort(-reach[kept], kind="stable")]
        if not len(others):
            return
        leaf = tree.leaf[others]
        if asked.leaf[node]:
            ends = others[leaf]
            for a in range(0, len(ends), 64):
                own = ends[a : a + 64]
                self.compare(asked.members[node], np.concatenate([tree.members[i] for i in own]))
            for inner in others[~leaf]:
                self.visit(node, tree.children[inner])
            return
        large = ~leaf & (tree.radii[others] > radius)
        finer = np.concatenate([others[~large], *(tree.children[i] for i in others[large])])
        for child in asked.children[node]:
            self.visit(int(child), finer)

    def compare(self, asked: np.ndarray, points: np.ndarray) -> None:
        """Score a group of queries against a group of points and keep the best."""
        if self.whole:
            scores = (self.real_queries[asked] @ self.real_data[points].T).astype(np.int64)
        else:
            scores = self.queries[asked] @ self.data[points].T
        last = max(0, scores.shape[1] - self.k)
        least = np.maximum(np.partition(scores, last, axis=1)[:, last].astype(np.float64), self.floor[asked])
        row, column = np.nonzero(scores >= least[:, None])
        if not len(row):
            return
        rows = np.concatenate((np.repeat(np.arange(len(asked)), self.k), row))
        score = np.concatenate((self.score[asked].ravel(), scores[row, column]))
        ids = np.concatenate((self.found[asked].ravel(), self.ids[points[column]]))
        order = np.lexsort((ids, -score, rows))
        best = order[np.searchsorted(rows[order], np.arange(len(asked)))[:, None] + np.arange(self.k)]
        self.score[asked], self.found[asked] = score[best], ids[best]
        self.floor[asked] = np.maximum(self.floor[asked], self.score[asked][:, -1].astype(np.float64))


def _matrix(table: pa.Table, column: str = "x") -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(table.num_rows, len(flat) // table.num_rows)


def _search(k: int):
    schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        if not data.num_rows or not asked.num_rows:
            return schema.empty_table()
        own = DualSearch(_matrix(data), data.column("id").to_numpy(), _matrix(asked), asked.column("floor").to_numpy(), k)
        row, place = np.nonzero(own.found < np.iinfo(np.int64).max)
        return pa.table([asked.column("qid").to_numpy()[row], own.found[row, place], own.score[row, place]], schema=schema)

    return run


def _cells(pivots: dict[int, np.ndarray], dots: bool):
    """Nearest pivot of each vector, the distance to it, and products with all pivots."""

    def run(batches):
        for batch in batches:
            cell, gap, norm, products = [], [], [], []
            for x in batch.column("x"):
                v = np.array(x.as_py(), np.float64)
                own = pivots.get(len(v))
                if own is None or not len(v):
                    cell.append(0)
                    gap.append(float(np.sqrt(v @ v)))
                    products.append([0.0])
                else:
                    far = np.sqrt(((own - v) ** 2).sum(axis=1))
                    cell.append(int(far.argmin()))
                    gap.append(float(far.min()))
                    products.append((own @ v).tolist())
                norm.append(float(np.sqrt(v @ v)))
            columns = {n: batch.column(n) for n in batch.schema.names} | {"cell": pa.array(cell, pa.int32()), "gap": pa.array(gap, pa.float64())}
            if dots:
                columns |= {"norm": pa.array(norm, pa.float64()), "products": pa.array(products, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Cells by farthest-first choice from a bounded sample; each length of vector has its own."""
    sample = rows.select("x").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    out = {}
    for length in {len(r["x"]) for r in sample} - {0}:
        points = np.unique(np.array([r["x"] for r in sample if len(r["x"]) == length], np.float64).reshape(-1, length), axis=0)
        chosen = [points[0]]
        gap = np.sqrt(((points - chosen[0]) ** 2).sum(axis=1))
        while len(chosen) < PIVOTS and gap.max(initial=0) > 0:
            chosen.append(points[gap.argmax()])
            gap = np.minimum(gap, np.sqrt(((points - chosen[-1]) ** 2).sum(axis=1)))
        out[length] = np.array(chosen)
    return out


def quantized(embedding: Column) -> Column:
    """floor(1024 * x) of each component, taken as double."""
    return F.transform(embedding, lambda v: F.floor(F.lit(SCALE) * v.cast("double")).cast("long"))


def _usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & ~bad


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The ``k`` rows of highest integer inner product with each query row, itself left out.

    ``vectors`` has vec_id and embedding; ``is_query`` picks the queries among its rows. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; a query of a small table
    has fewer rows. Vectors that are null or hold a null or non-finite component take no part, and
    vectors meet only those of their own length. Rows that repeat a vec_id count as rows: they stay
    candidates of each other's queries only under another id. Other columns are not read.

    Cells around pivots are the top level of both trees. A first pass searches one block of each
    query's own cell; its worst kept score then rules out, by the covering radii, whole blocks for
    whole queries, and within a block node pairs of the block's tree and the chunk's tree. Copies of
    a vector are cut to the k+1 smallest ids, which are all that can ever be among k best; copies of
    a query are searched once.
    """
    rows = vectors.where(_usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding")).alias("x"), is_query.alias("asked"))
    pivots = _pivots(rows)
    copies = Window.partitionBy("x").orderBy("id")
    data = rows.select("id", "x").distinct().withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("id", "x")
    data = data.mapInArrow(_cells(pivots, False), "id long, x array<long>, cell int, gap double").withColumn("dim", F.size("x"))
    sizes = {(r["dim"], r["cell"]): r["n"] for r in data.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return vectors.sparkSession.range(0).selectExpr("id query_id", "cast(id as int) rank", "id vec_id", "id score")
    # As many rows as there are cells, a bounded number for each length of vector.
    parts = F.create_map(*(F.lit(v) for (dim, cell), n in sizes.items() for v in (f"{dim}:{cell}", -(-n // BLOCK))))
    name = F.concat_ws(":", "dim", "cell")
    data = checkpointed(data.withColumn("block", F.pmod(F.xxhash64("id"), parts[name])))
    blocks = data.groupBy("dim", "cell", "block").agg(F.max("gap").alias("radius"))

    asked = rows.where("asked").groupBy("x").agg(F.min("id").alias("qid"))
    asked = asked.mapInArrow(_cells(pivots, True), "x array<long>, qid long, cell int, gap double, norm double, products array<double>").withColumn("dim", F.size("x"))
    asked = checkpointed(asked)
    chunks = max(1, -(-asked.count() // CHUNK))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)))
    lowest = F.lit(float("-inf"))

    def search(pairs: DataFrame) -> DataFrame:
        """Search each (block, chunk) that has pairs; ``pairs`` are queries with the block to search."""
        key = ["dim", "cell", "block", "chunk"]
        own = data.join(pairs.select(*key).distinct(), ["dim", "cell", "block"]).select(*(F.col(c).alias(c) for c in (*key, "id", "x")))
        return own.groupBy(key).cogroup(pairs.groupBy(key)).applyInArrow(_search(k + 1), "qid long, vec_id long, score long")

    home = asked.join(data.select("dim", "cell").distinct(), ["dim", "cell"], "left_semi")
    near = checkpointed(search(home.select("dim", "cell", F.lit(0).cast("long").alias("block"), "chunk", "qid", "x", lowest.alias("floor"))))
    known = near.groupBy("qid").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    floor = F.coalesce(F.when(F.col("n") > k, F.col("worst").cast("double")), lowest)
    bounded = asked.join(known, "qid", "left").withColumn("floor", floor).withColumnRenamed("cell", "own")
    reach = F.coalesce(F.get("products", F.col("cell")), F.lit(0.0)) + F.col("norm") * F.col("radius")
    wanted = (reach * (1 + 1e-12) + F.col("norm") * 1e-9 + 0.5 >= F.col("floor")) & ~((F.col("cell") == F.col("own")) & (F.col("block") == 0))
    far = search(bounded.join(blocks, "dim").where(wanted).select("dim", "cell", "block", "chunk", "qid", "x", "floor"))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id")
    found = near.unionByName(far).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("qid", "vec_id", "score")

    same = rows.where("asked").select(F.col("id").alias("query_id"), "x").join(asked.select("x", "qid"), "x").select("query_id", "qid")
    answers = same.join(found, "qid").where(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return answers.distinct().withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
