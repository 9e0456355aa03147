"""Exact top-k inner products by best-first search of an M-tree.

With one more component, sqrt(M - |x|^2) for M the greatest squared norm, all vectors
have norm sqrt(M), and the greatest inner products with a query are the least
Euclidean distances: d^2 = |q|^2 + M - 2 q.x.

The tree is grown from the top: every vector goes to the nearest of up to ``ROOTS`` routing
objects (a documented sample by hash, of bounded size), and a node with more than two
pages of vectors goes on to the nearest of routing objects of its own, until nodes are about a
page or hold equal vectors alone, which are dealt into pages by hash. A page keeps a routing object (the vector nearest the node's), the least and
greatest distance of its vectors to it and that object's distance to the root object; within a page, nodes
have a centre, a covering radius, the centre's distance to the page's object, and each entry its distance to its centre.

A query first searches the page it would itself be in. Its k-th score excludes root cells, then pages, by their
stored distances; the pages left are searched in the order of their lower bounds, the
nearest ``NEXT`` first, whose k-th score excludes more of the others. In a page, nodes are taken by
ascending bound, and nodes and entries are passed over whose stored distances show by
the triangle inequality that they can't be among the best. Bounds are compared with
a slack for rounding; scores are exact integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize

ROOTS, FAN, PAGE, NODE, QUERIES, NEXT = 64, 64, 1024, 24, 64, 8
#: Levels below the root after which a node is dealt into pages by hash, whatever its vectors.
DEEPEST = 8
LONG = 2**63 - 1
BINARY = ("ids", "vectors", "bounds", "centres", "radius", "parent", "own")
PAGE_SCHEMA = "page string, root int, pivot array<double>, near double, far double, above double, " + ", ".join(f"{c} binary" for c in BINARY)


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _queries(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _slack(top: float) -> float:
    return 1e-6 * (1 + math.sqrt(top))


def _limits(q: np.ndarray, top: float, floor: list[int | None]) -> np.ndarray:
    """Distance beyond which no vector has a score of ``floor`` (none: no limit)."""
    floor = np.array([-math.inf if x is None else float(x) for x in floor])
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.maximum((q * q).sum(1) + top - 2 * floor, 0)) + _slack(top)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles, as longs; those beyond a long are cut to its range."""
    most = x.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
    if most < 2**53:  # doubles hold every partial sum exactly
        return (q @ x.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in x] for r in q]
    return np.array([[min(max(v, -LONG - 1), LONG) for v in r] for r in exact], np.int64).reshape(len(q), len(x))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _route(roots: np.ndarray, top: float):
    """(vec_id, v) -> with the nearest root object, as a node, and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _augmented(roots, top)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = _distances(_augmented(_matrix(part.column(1)), top), centres)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32)), pa.array([str(r) for r in near]), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "v", "root", "node", "far"])

    return run


def _split(top: float):
    """(root, node, pivots, cards of a block) -> its vectors with the child node of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                root, node = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                pivots = np.unique(_matrix(batch.column(2).slice(i, 1).flatten()), axis=0)
                cards = batch.column(3).slice(i, 1).flatten()
                v = _matrix(cards.field("v"))
                d = _distances(_augmented(v, top), _augmented(pivots, top))
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([cards.field("vec_id"), _lists(v), pa.array(np.full(len(v), root, np.int32)), pa.array([f"{node}/{c}" for c in near]), pa.array(d[np.arange(len(v)), near])], names=["vec_id", "v", "root", "node", "far"])

    return run


def _build(roots: np.ndarray, top: float):
    """(page, root, cards) -> the page with its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                root, cards = batch.column(1)[i].as_py(), batch.column(2).slice(i, 1).flatten()
                ids, v = np.asarray(cards.field("vec_id")), _matrix(cards.field("v"))
                x, first = _augmented(v, top), int(np.lexsort((ids, np.asarray(cards.field("far"))))[0])
                centres, least = [first], _distances(x, x[first : first + 1])[:, 0]
                near, far = float(least.min()), float(least.max())
                while len(centres) < min(NODE, len(x)) and least.max() > 0:  # the farthest vector becomes the next centre
                    centres.append(int(least.argmax()))
                    least = np.minimum(least, _distances(x, x[centres[-1:]])[:, 0])
                d = _distances(x, x[centres])
                node = d.argmin(1)
                own = d[np.arange(len(x)), node]
                order = np.lexsort((own, node))
                radius = np.array([own[node == c].max(initial=0) for c in range(len(centres))])
                parent, above = _distances(x[centres], x[first : first + 1])[:, 0], float(_distances(x[first : first + 1], _augmented(roots[root : root + 1], top))[0, 0])
                arrays = [ids[order], v[order], np.searchsorted(node[order], np.arange(len(centres) + 1)), v[centres], radius, parent, own[order]]
                plain = [pa.array([batch.column(0)[i].as_py()]), pa.array([root], pa.int32()), _lists(v[first : first + 1]), *(pa.array([y]) for y in (near, far, above))]
                yield pa.RecordBatch.from_arrays([*plain, *(pa.array([y.tobytes()], pa.binary()) for y in arrays)], names=["page", "root", "pivot", "near", "far", "above", *BINARY])

    return run


class _Page:
    def __init__(self, raw: dict, top: float):
        self.ids, self.bounds = (np.frombuffer(raw[c], np.int64) for c in ("ids", "bounds"))
        self.radius, self.parent, self.own = (np.frombuffer(raw[c], np.float64) for c in ("radius", "parent", "own"))
        self.vectors = np.frombuffer(raw["vectors"], np.float64).reshape(len(self.ids), -1)
        self.centres, self.top = _augmented(np.frombuffer(raw["centres"], np.float64).reshape(len(self.radius), -1), top), top

    def search(self, q: np.ndarray, qids: np.ndarray, floor: list[int | None], k: int) -> tuple[list[list[tuple[int, int]]], int]:
        """(best (-score, id) of each query, ascending, of those that its floor doesn't exclude; number of scores computed)."""
        points, square, slack = _queries(q), (q * q).sum(1) + self.top, _slack(self.top)
        limit = _limits(q, self.top, floor)
        found: list[list[tuple[int, int]]] = [[] for _ in q]
        above = _distances(points, self.centres[:1])  # the page's own object is the first centre
        bound = np.abs(above - self.parent[None, :]) - self.radius[None, :]
        computed = 0
        for node in np.argsort(bound.min(0), kind="stable"):
            open_ = np.nonzero(bound[:, node] <= limit)[0]
            if not len(open_):
                continue
            to = _distances(points[open_], self.centres[node : node + 1])[:, 0]
            open_, to = open_[to - self.radius[node] <= limit[open_]], to[to - self.radius[node] <= limit[open_]]
            lo, hi = self.bounds[node], self.bounds[node + 1]
            maybe = np.abs(to[:, None] - self.own[None, lo:hi]) <= (limit[open_] + slack)[:, None]
            rows, cols = np.nonzero(maybe.any(1))[0], np.nonzero(maybe.any(0))[0] + lo
            if not len(rows):
                continue
            scores = inner_products(q[open_[rows]], self.vectors[cols])
            computed += scores.size
            ids = self.ids[cols]
            for i, s in zip(open_[rows], scores, strict=True):
                worst = -found[i][-1][0] if len(found[i]) == k else -LONG - 1
                take = np.nonzero((s >= worst) & (ids != qids[i]))[0]
                if len(take):
                    take = take[np.lexsort((ids[take], ~s[take]))[:k]]
                    found[i] = sorted([*found[i], *((-int(s[j]), int(ids[j])) for j in take)])[:k]
                    if len(found[i]) == k:
                        limit[i] = min(limit[i], math.sqrt(max(square[i] + 2 * float(found[i][-1][0]), 0)) + slack)
        return found, computed


def _search(top: float, k: int):
    """(queries, page) -> the page's best k of each query, and a row without a query that has the number of scores computed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int | None, int, int]] = []
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                page = _Page({c: part.column(c)[0].as_py() for c in BINARY}, top)
                cards = part.column("queries").flatten()
                qids = np.asarray(cards.field("query_id"))
                found, computed = page.search(_matrix(cards.field("v")), qids, cards.field("floor").to_pylist(), k)
                out.append((None, len(qids), computed))
                out += [(int(q), i, -s) for q, best in zip(qids, found, strict=True) for s, i in best]
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _open_roots(roots: np.ndarray, top: float, near: np.ndarray, far: np.ndarray):
    """(q, v, floor) -> the root cells that may still hold a better vector, by their covering radii, with the distance to the root object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _augmented(roots, top)
        for batch in batches:
            q = _matrix(batch.column(1))
            if not len(q):
                continue
            d = _distances(_queries(q), centres)
            limit = _limits(q, top, batch.column(2).to_pylist())
            i, root = np.nonzero(np.maximum(d - far[None, :], near[None, :] - d) <= limit[:, None])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in batch.columns), pa.array(root.astype(np.int32)), pa.array(d[i, root])], names=["q", "v", "floor", "root", "above"])

    return run


def _open_pages(top: float):
    """(queries, pages of one root cell) -> (q, page, bound) of pages that may hold a better vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries, pages = (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                q = _matrix(queries.field("v"))
                limit = _limits(q, top, queries.field("floor").to_pylist())
                near, far, parent = (np.asarray(pages.field(c)) for c in ("near", "far", "above"))
                above = np.asarray(queries.field("above"))
                bound = np.abs(above[:, None] - parent[None, :]) - far[None, :]
                maybe = bound <= limit[:, None]
                some = np.nonzero(maybe.any(0))[0]  # to these pages' objects the distances are computed
                d = np.full(maybe.shape, np.inf)
                if len(some):
                    d[:, some] = _distances(_queries(q), _augmented(_matrix(pages.field("pivot"))[some], top))
                bound = np.maximum(bound, np.maximum(d - far[None, :], near[None, :] - d))
                x, page = np.nonzero(maybe & (bound <= limit[:, None]))
                yield pa.RecordBatch.from_arrays([queries.field("q").take(pa.array(x)), pages.field("page").take(pa.array(page)), pa.array(np.maximum(bound[x, page], 0.0))], names=["q", "page", "bound"])

    return run


def _grown(routed: DataFrame, top: float) -> DataFrame:
    """Vectors with the page they are in: (vec_id, v, root, page, far)."""
    done, level = None, 0
    while True:
        sizes = routed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        large = sizes.where((F.col("n") > 2 * PAGE) & (F.col("radius") > 0))
        if level == DEEPEST or large.isEmpty():
            break
        large = materialize(large, "large-nodes")
        finished = routed.join(large.select("node"), "node", "left_anti").select(*routed.columns)
        done = finished if done is None else done.unionByName(finished)
        # about one object for each page, at most FAN, drawn by hash anew at each level
        wide = routed.join(large.select("node", "n", F.least(F.lit(FAN), F.ceil(F.col("n") / PAGE)).alias("fan")), "node")
        drawn = F.pmod(F.xxhash64("vec_id", "v", F.lit(level)), F.lit(1 << 30))
        pivots = wide.groupBy("node").agg(F.collect_list(F.when(drawn * F.col("n") < F.col("fan") * float(1 << 30), F.col("v"))).alias("some"), F.min_by("v", drawn).alias("one"))
        pivots = materialize(pivots.select("node", F.array_append("some", F.col("one")).alias("pivots")), "pivots")
        block = F.pmod(F.xxhash64("vec_id", "v"), F.greatest(F.lit(1), F.ceil(F.col("n") / PAGE)))
        cards = wide.groupBy("root", "node", block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("cards"))
        routed = cards.join(pivots, "node").select("root", "node", "pivots", "cards").mapInArrow(_split(top), "vec_id long, v array<double>, root int, node string, far double")
        routed, level = materialize(routed, "routed"), level + 1
    out = routed if done is None else done.unionByName(routed)
    sizes = out.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("n") > 2 * PAGE, F.ceil(F.col("n") / PAGE)).otherwise(1)
    out = out.join(sizes, "node").withColumn("page", F.concat("node", F.lit("#"), F.pmod(F.xxhash64("vec_id", "v", "far"), parts).cast("string")))
    return materialize(out.drop("node", "n"), "paged")


def top_inner_products(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, done: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """The ``k`` greatest inner products of each query: (query_id, rank, vec_id, score).

    ``vectors`` has vec_id and embedding; components become floor(``scale`` * x) of the double
    x. Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with
    another vec_id. Ties go to the smaller vec_id; a query with fewer candidates gets all of
    them, one without candidates no row. Rows with a null vec_id, a null vector, null or non-finite components, or
    components so large that the sum of their squares isn't finite, take no part. Vectors of
    different lengths are compared as if zeros followed the shorter one. Scores beyond a long are cut to its range. Repeated candidates count
    each; rows that repeat a query's vec_id with other vectors offer their best together, equal ones once. Other columns are ignored.

    ``done`` is filled with the pairs of a query and a page that were searched, and the scores computed there, in each pass.
    At most ``ROOTS`` vectors and their cells' radii come to the driver; a node of any size is split by joins that AQE splits.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    clean = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    whole = F.transform(x, lambda e: F.when(F.abs(e.cast("double")) < 2.0**42, F.floor(e.cast("double") * scale).cast("double")).otherwise(e.cast("double") * scale))
    clean = clean.select("vec_id", whole.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    clean = materialize(clean.withColumn("square", square).where("square < double('Infinity')"), "vectors")
    most = clean.agg(F.max("square").alias("top"), F.max(F.size("v")).alias("dim")).first()
    if most["top"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top, dim = most["top"], max(most["dim"], 1)
    padded = F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))).otherwise(F.col("v"))
    clean = clean.select("vec_id", padded.alias("v"))
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ROOTS).collect()
    roots = np.unique(np.array([r["v"] for r in sample]).reshape(len(sample), -1), axis=0)
    routed = materialize(clean.mapInArrow(_route(roots, top), "vec_id long, v array<double>, root int, node string, far double"), "routed")
    cells = {r["root"]: r for r in routed.groupBy("root").agg(F.min("far").alias("near"), F.max("far").alias("far")).collect()}  # at most ROOTS rows
    paged = _grown(routed, top)
    pages = paged.groupBy("page").agg(F.first("root").alias("root"), F.collect_list(F.struct("vec_id", "v", "far")).alias("cards"))
    tree = materialize(pages.mapInArrow(_build(roots, top), PAGE_SCHEMA), "pages")
    near = np.array([cells[i]["near"] if i in cells else math.inf for i in range(len(roots))])
    far = np.array([cells[i]["far"] if i in cells else -math.inf for i in range(len(roots))])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def in_blocks(rows: DataFrame, by: str, columns: list[str], size: int, to: str) -> DataFrame:
        counted = rows.join(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)
        block = F.pmod(F.xxhash64(columns[0]), F.greatest(F.lit(1), F.ceil(F.col("n") / size)))
        return counted.withColumn("block", block).groupBy(by, "block").agg(F.collect_list(F.struct(*columns)).alias(to)).drop("block")

    def searched(asked: DataFrame, name: str) -> DataFrame:
        rows = in_blocks(asked, "page", ["q", "query_id", "v", "floor"], QUERIES, "queries")
        hits = rows.join(tree.select("page", *BINARY), "page").mapInArrow(_search(top, k), "query_id long, vec_id long, score long")
        hits = materialize(hits, name)
        if done is not None:
            met = hits.where("query_id IS NULL").agg(F.sum("vec_id"), F.sum("score")).first()
            done[name] = (met[0] or 0, met[1] or 0)
        return hits.where("query_id IS NOT NULL")

    def floors(hits: DataFrame) -> DataFrame:
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
        return ranked.select("query_id", F.col("score").alias("floor"))

    # a query is a vector under an id; vectors of one id are searched apart, under the floor of the id
    queries = paged.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "v").agg(F.min("page").alias("page"))
    queries = materialize(queries.withColumn("q", F.monotonically_increasing_id()), "queries")
    hits = searched(queries.withColumn("floor", F.lit(None).cast("long")), "home-hits")
    asked = materialize(queries.drop("page").join(floors(hits), "query_id", "left"), "asked")
    cells_of = asked.select("q", "v", "floor").mapInArrow(_open_roots(roots, top, near, far), "q long, v array<double>, floor long, root int, above double")
    one = in_blocks(materialize(cells_of, "open-roots"), "root", ["q", "v", "floor", "above"], QUERIES, "queries")
    met = one.join(in_blocks(tree, "root", ["page", "pivot", "near", "far", "above"], PAGE, "pages"), "root").select("queries", "pages")
    open_ = met.mapInArrow(_open_pages(top), "q long, page string, bound double").join(queries.select("q", "page"), ["q", "page"], "left_anti")
    open_ = materialize(open_.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("bound", "page"))), "open-pages")
    hits = hits.unionByName(searched(open_.where(F.col("place") <= NEXT).drop("bound", "place").join(asked, "q"), "next-hits"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    limit = F.sqrt(F.greatest(square + F.lit(top) - 2 * F.col("floor").cast("double"), F.lit(0.0))) + _slack(top)
    rest = open_.where(F.col("place") > NEXT).drop("place").join(asked.drop("floor"), "q").join(floors(hits), "query_id", "left")
    rest = rest.where(F.col("floor").isNull() | (F.col("bound") <= limit))
    hits = hits.unionByName(searched(rest, "other-hits"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
