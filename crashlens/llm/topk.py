"""Exact top-k inner products with a KD-tree per shard.

A coarse KD-tree over a bounded sample parts the space into regions; a region's vectors are dealt to shards of a few thousand. Each
shard's tree is built once: it splits at medians and keeps a tight bounding box per node. Each query is first held against the region
whose box allows the largest inner product. Its k-th score is passed on: the query then goes to those regions only whose boxes
can reach that score, and in a tree down those nodes only; leaves are taken best first until no box can reach the k-th score any more.

Trees are kept in files of the scratch space; a task reads those alone that one of its queries goes to, once for the blocks of queries that it has.
Queries are searched in blocks, many at once. Vectors whose scores pass what floats hold exactly are searched one by one, in longs or,
beyond 63 bits, in Python integers.
"""

from __future__ import annotations

import functools
import heapq
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scratch
from crashlens.llm.token_files import get, put

#: Vectors of a shard, of a leaf, and queries of a block, about.
SHARD = 4096
LEAF = 128
QUERIES = 4096
#: Vectors that the coarse tree is fitted on, at most; regions at least, so that a small table is still spread, and at most.
SAMPLE = 4096
LEAST, MOST = 32, 256
#: Vectors with a squared largest component, times the dimension, beyond this are wide: two that aren't have scores that fit a long.
LIMIT = 1 << 62
#: Products up to this are exact in floats.
EXACT = 1 << 53
#: Components of wide vectors from this size on are integers before they are scaled.
WHOLE = 1 << 53
LONG = 1 << 63
#: The region of vectors that the coarse tree has no place for: of another dimension, or wide.
ODD = -1


def split(points: np.ndarray, most: int) -> tuple[list[int], list[list[int]], list, list[np.ndarray | None]]:
    """Nodes of a KD-tree: split dimension, kids, split value, and the rows of leaves with `most` points or fewer. Parents come first."""
    dims, kids, cuts, rows = [], [], [], []
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        node, here = len(dims), points[own]
        if parent >= 0:
            kids[parent][side] = node
        low, high = here.min(0), here.max(0)
        wide = int((high - low).argmax())
        dims.append(wide)
        kids.append([-1, -1])
        if len(own) <= most or low[wide] == high[wide]:
            cuts.append(low[wide])
            rows.append(own)
            continue
        order = np.argsort(here[:, wide], kind="stable")
        cuts.append(here[order[len(own) // 2], wide])
        rows.append(None)
        todo += [(own[order[: len(own) // 2]], node, 0), (own[order[len(own) // 2 :]], node, 1)]
    return dims, kids, cuts, rows


class Regions:
    """The coarse tree: each vector of its dimension has a region from 0."""

    def __init__(self, sample: np.ndarray, most: int):
        self.dim = sample.shape[1] if len(sample) else 0
        self.dims, self.kids, self.cuts, rows = split(sample, most) if len(sample) else ([], [], [], [])
        self.number = [-1 if r is not None else 0 for r in rows]
        self.count = 0
        for i, r in enumerate(rows):
            if r is not None:
                self.number[i], self.count = self.count, self.count + 1

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.kids[node][0] < 0:
                out[rows] = self.number[node]
            elif len(rows):
                left = points[rows, self.dims[node]] < self.cuts[node]
                todo += [(self.kids[node][0], rows[left]), (self.kids[node][1], rows[~left])]
        return out


class Tree:
    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.points, self.ids = points, ids
        _, self.kids, _, self.rows = split(points, LEAF)
        low: list = [None] * len(self.kids)
        high: list = [None] * len(self.kids)
        for i in range(len(self.kids) - 1, -1, -1):  # kids come after their parents
            if self.rows[i] is not None:
                low[i], high[i] = points[self.rows[i]].min(0), points[self.rows[i]].max(0)
            else:
                a, b = self.kids[i]
                low[i], high[i] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        self.low, self.high = np.array(low), np.array(high)
        self.largest = max(1, int(max(abs(self.low).max(), abs(self.high).max())))

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, -id) from the floor on but the query's own id, best first, in exact integers."""
        bounds = np.maximum(query * self.low, query * self.high).sum(1).tolist()
        best: list[tuple[int, int]] = []
        todo = [(-bounds[0], 0)]
        while todo:
            bound, node = heapq.heappop(todo)
            if (len(best) == k and -bound < best[0][0]) or (floor is not None and -bound < floor):
                break
            if self.rows[node] is None:
                for kid in self.kids[node]:
                    if len(best) < k or bounds[kid] >= best[0][0]:
                        heapq.heappush(todo, (-bounds[kid], kid))
                continue
            rows = self.rows[node]
            scores = self.points[rows] @ query
            fine = np.flatnonzero(scores >= best[0][0]) if len(best) == k else np.arange(len(rows))
            for s, i in zip(scores[fine].tolist(), self.ids[rows[fine]].tolist(), strict=True):
                if i != own and (floor is None or s >= floor):
                    (heapq.heappush if len(best) < k else heapq.heappushpop)(best, (s, -i))
        return sorted(best, reverse=True)

    def search_many(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search() for many queries at once, whose products are exact in floats: query numbers, ids and scores, from each query's floor on."""
        q, points = queries.astype(float), self.points.astype(float)
        bounds = np.maximum(q, 0) @ self.high.astype(float).T + np.minimum(q, 0) @ self.low.astype(float).T
        alive = bounds >= floor[:, None]
        for node, (a, b) in enumerate(self.kids):
            if a >= 0:
                alive[:, a] &= alive[:, node]
                alive[:, b] &= alive[:, node]
        leaves = np.array([i for i, r in enumerate(self.rows) if r is not None])
        bounds = np.where(alive[:, leaves], bounds[:, leaves], -np.inf)
        order = np.argsort(-bounds, 1, kind="stable")
        best = np.full((len(q), k), -np.inf)
        found = np.full((len(q), k), np.iinfo(np.int64).max)
        live = np.arange(len(q))
        for r in range(len(leaves)):
            bound = bounds[live, order[live, r]]
            live = live[(bound > -np.inf) & (bound >= best[live, -1])]
            if not len(live):
                break
            at = order[live, r]
            for leaf in np.unique(at).tolist():
                some, rows = live[at == leaf], self.rows[leaves[leaf]]
                ids = np.broadcast_to(self.ids[rows], (len(some), len(rows)))
                scores = q[some] @ points[rows].T
                scores[(ids == own[some, None]) | (scores < floor[some, None])] = -np.inf
                scores, ids = np.hstack((best[some], scores)), np.hstack((found[some], ids))
                top = np.lexsort((ids, -scores), axis=1)[:, :k]
                best[some], found[some] = np.take_along_axis(scores, top, 1), np.take_along_axis(ids, top, 1)
        number, place = np.nonzero(best > -np.inf)
        return number, found[number, place], best[number, place].astype(np.int64)


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and the floors of scaled components: v, or w for wide vectors, where a component is low + scale * high.

    Rows with null ids or vectors, with null or non-finite components take no part; repeated rows stay.
    """
    usable = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    rows = vectors.where(usable).select(F.col("vec_id").cast("long"), F.expr("transform(embedding, x -> cast(x as double))").alias("e"))
    rows = rows.withColumn("wide", F.expr(f"size(e) * pow(array_max(transform(e, x -> abs(x))) * {scale} + 1, 2) >= {LIMIT}"))
    v = F.expr(f"if(wide, null, transform(e, x -> cast(floor({scale} * x) as bigint)))")
    w = F.expr(f"if(wide, transform(e, x -> if(abs(x) < {WHOLE}, struct(cast(floor({scale} * x) as bigint) as low, 0D as high), struct(0L as low, x as high))), null)")
    return rows.select("vec_id", v.alias("v"), w.alias("w"))


def _narrow(t: pa.Table | pa.RecordBatch, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors by dimension, of those that aren't wide."""
    v = t.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    sizes = np.where(np.asarray(v.is_valid()), np.asarray(v.value_lengths().fill_null(0)), 0)
    out = {}
    for d in np.unique(sizes[sizes > 0]) if dim is None else [dim]:
        rows = np.flatnonzero(sizes == d)
        if d and len(rows):
            out[int(d)] = rows, np.asarray(v.take(pa.array(rows)).flatten(), np.int64).reshape(len(rows), d)
    return out


def _wide(t: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and exact vectors by dimension, of wide ones."""
    groups: dict[int, list[tuple[int, list[int]]]] = {}
    for i, w in enumerate(t.column("w").to_pylist()):
        if w is not None:
            groups.setdefault(len(w), []).append((i, [x["low"] + scale * int(x["high"]) for x in w]))
    return {d: (np.array([i for i, _ in x]), np.array([y for _, y in x], object)) for d, x in groups.items()}


def _far(score: int) -> tuple[int, int | None, str | None]:
    """Sort keys of a score: its zone (1 above longs, 0, -1 below), itself if it fits a long, or else a text; greater ones first."""
    if -LONG <= score < LONG:
        return 0, score, None
    digits = str(abs(score))
    if score > 0:
        return 1, None, f"{len(digits):05d}{digits}"
    return -1, None, f"{99_999 - len(digits):05d}" + "".join(str(9 - int(c)) for c in digits)


FOUND = "query_id long, vec_id long, zone int, score long, far string"


@functools.lru_cache(maxsize=1)
def _kept(path: str) -> dict:
    """A shard's trees by kind and dimension. The last one stays, for the next block of queries."""
    return pickle.loads(get(path))  # noqa: S301  written by build() below


def _searched(trees: DataFrame, asked: DataFrame, k: int, scale: int) -> DataFrame:
    """What each (region, part) has for the queries asked of it in a block. trees: region, part, path; asked: region, part, block, vec_id, v, w, floor."""

    def search(queries: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"query_id": [], "vec_id": [], "zone": [], "score": [], "far": []}

        def add(own: int, found: list[tuple[int, int]]) -> None:
            for s, i in found:
                for x, y in zip(rows.values(), (own, -i, *_far(s)), strict=True):
                    x.append(y)

        ids = np.asarray(queries.column("vec_id"))
        floors = np.asarray(queries.column("floor").fill_null(-LONG)).astype(np.int64)
        have = _kept(queries.column("path")[0].as_py())
        narrow, wide = _narrow(queries), _wide(queries, scale)
        for (is_wide, d), tree in have.items():
            for asks, far in ((narrow, False), (wide, True)):
                if d not in asks:
                    continue
                numbers, vectors = asks[d]
                if not (is_wide or far) and d * tree.largest * max(1, int(abs(vectors).max())) < EXACT:
                    at, found, scores = tree.search_many(vectors, ids[numbers], k, floors[numbers].astype(float))
                    rows["query_id"] += ids[numbers[at]].tolist()
                    rows["vec_id"] += found.tolist()
                    rows["score"] += scores.tolist()
                    rows["zone"] += [0] * len(at)
                    rows["far"] += [None] * len(at)
                    continue
                if is_wide != far:  # one side is made of Python integers
                    vectors = vectors.astype(object)
                for i, query in zip(numbers.tolist(), vectors, strict=True):
                    floor = int(floors[i])
                    add(int(ids[i]), tree.search(query, int(ids[i]), k, floor if floor > -LONG else None))
        return pa.table({x: pa.array(y, pa.string() if x == "far" else pa.int32() if x == "zone" else pa.int64()) for x, y in rows.items()})

    return asked.join(trees.select("region", "part", "path"), ["region", "part"]).groupBy("region", "part", "block").applyInArrow(search, FOUND)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for queries (vec_id, v, w) against all candidates (vec_id, v, w) of the same dimension, ties to smaller ids.

    Ranks are exact for all finite vectors; score is null where it doesn't fit a long. Repeated candidates count each, but those
    with a query's id are its own; repeated queries are asked once.
    """
    queries = queries.distinct()
    n, m = candidates.count(), queries.count()
    narrow = candidates.where("v is not null")
    dim = narrow.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dim.d if dim else 0
    sample = narrow.where(F.size("v") == dim).select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", F.xxhash64("v")).limit(SAMPLE).collect() if dim else []
    count = min(MOST, max(LEAST, n // SHARD))
    regions = Regions(np.array([r.v for r in sample], np.int64).reshape(len(sample), dim), max(1, len(sample) // count))
    blocks = max(1, m // QUERIES)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(len(batch), ODD, np.int32)
            for rows, points in _narrow(batch, dim).values():
                out[rows] = regions.of(points)
            yield batch.append_column("region", pa.array(out))

    kind = "vec_id long, v array<bigint>, w array<struct<low: bigint, high: double>>"
    placed = scratch.stored(candidates.mapInArrow(place, f"{kind}, region int"), "placed")
    sizes = {r.region: r["count"] for r in placed.groupBy("region").count().collect()}  # MOST rows and one
    # parts of each region, the odd ones' first; a region that most vectors have is spread
    spread = F.expr(f"get(array({', '.join(str(-(-sizes.get(i, 1) // SHARD)) for i in range(ODD, regions.count))}), region + 1)")

    out = scratch.folder(candidates.sparkSession, "tree-files")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        ids, trees = np.asarray(table.column("vec_id")), {}
        for far, groups in ((False, _narrow(table)), (True, _wide(table, scale))):
            for d, (rows, points) in groups.items():
                trees[far, d] = Tree(points, ids[rows])
        box = trees.get((False, dim)) if key[0].as_py() != ODD else None
        path = f"{out}/{uuid.uuid4().hex}.trees"  # a fresh name in each attempt: the table below names those of tasks that ended well
        put(path, pickle.dumps(trees))
        return pa.table({
            "region": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "path": pa.array([path]),
            "box": pa.array([list(zip(box.low[0].tolist(), box.high[0].tolist(), strict=True)) if box else []], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
        })

    dealt = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), spread).cast("int"))
    trees = scratch.stored(dealt.groupBy("region", "part").applyInArrow(build, "region int, part int, path string, box array<struct<low: bigint, high: bigint>>"), "trees")
    boxes = trees.select("region", F.posexplode("box").alias("i", "x")).groupBy("region", "i").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    low, high = np.full((regions.count, dim), np.inf), np.full((regions.count, dim), -np.inf)
    for r in boxes.collect():  # MOST rows for each dimension
        low[r.region, r.i], high[r.region, r.i] = r.low, r.high
    full = np.isfinite(low).all(1) if dim else np.zeros(0, bool)
    odd = [ODD] if ODD in sizes else []

    def route(first: bool):
        """Regions that a query is held against: the one with the greatest bound at first, then all others that can reach its floor."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                goes: list[list[int]] = [[] if first else odd for _ in range(len(batch))]
                floors = np.asarray(batch.column("floor").fill_null(-LONG)).astype(float)
                for rows, points in _narrow(batch, dim).values() if full.any() else ():
                    q = points.astype(float)
                    bounds = np.full((len(rows), regions.count), -np.inf)
                    bounds[:, full] = np.maximum(q, 0) @ high[full].T + np.minimum(q, 0) @ low[full].T
                    best = bounds.argmax(1)
                    # floats may be off in the last places
                    reach = (bounds + abs(bounds) * 1e-9 + 1 >= floors[rows, None]) & full
                    for i, b, r in zip(rows.tolist(), best.tolist(), reach, strict=True):
                        goes[i] = [b] if first else [*goes[i], *(x for x in np.flatnonzero(r).tolist() if x != b)]
                yield batch.append_column("regions", pa.array(goes, pa.list_(pa.int32())))

        return run

    def asked(rows: DataFrame, first: bool) -> DataFrame:
        routed = rows.select("vec_id", "v", "w", "floor").mapInArrow(route(first), f"{kind}, floor bigint, regions array<int>").select("vec_id", "v", "w", "floor", F.explode("regions").alias("region"))
        return routed.withColumn("part", F.explode(F.sequence(F.lit(0), spread - 1))).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))

    best = Window.partitionBy("query_id").orderBy(F.desc("zone"), F.desc("score"), F.desc("far"), "vec_id")
    rank = lambda found: found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
    one = scratch.stored(rank(_searched(trees, asked(queries.withColumn("floor", F.lit(None).cast("long")), True), k, scale)), "first")
    floors = one.where(f"rank = {k} and zone = 0").select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    two = _searched(trees, asked(queries.join(floors, "vec_id", "left"), False), k, scale)
    return rank(one.drop("rank").unionByName(two)).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scratch.stored(integers(scratch.table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q, v c WHERE c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
