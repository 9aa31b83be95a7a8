"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors fall into bands by the power of two of their length. Within a band they are scaled by it, exactly, to at most
length one and get one more component that lifts them all to length one; queries get length one and a zero there. Then the
largest inner product of a band is its smallest Euclidean distance, for which the triangle inequality holds, and a
vector of extreme length only makes a band of its own. A bounded sample gives each band's centres; a cell, the vectors
nearest to one centre, is cut into shards by rings of that distance. Each shard builds one tree.

Every query first searches the shard that promises most, which bounds its k-th inner product; then those of all bands
whose lower bound, by ring and by the centres' bisecting planes, doesn't exceed ``factor`` times the distance that the
bound means there. Subtrees are skipped by the same rule. Factor one is exact search; a smaller one prunes more. Vectors
are moved twice, whatever the number of queries; queries are copied to the shards that they must visit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.batches import drop_stored, quoted, smallest_hashes, stored

#: Vectors of a shard, about; queries that visit a shard together, about; vectors of the sample; most centres; most rings of a cell.
SHARD, BLOCK, SAMPLE, CENTRES, RINGS = 8192, 65_536, 2048, 512, 64
LEAF = 64
#: Queries searched, or routed, at a time.
STEP = 1024
#: Allowance for rounding in distances of vectors of length one.
SLACK = 1e-6


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by the power of two above their length, and its exponent; none overflows or vanishes."""
    _, first = np.frexp(np.abs(x).max(axis=1))
    y = np.ldexp(x, -first[:, None])
    _, second = np.frexp(np.sqrt((y**2).sum(axis=1)))
    return np.ldexp(y, -second[:, None]), (first + second).astype(np.int64)


def lifted(x: np.ndarray) -> np.ndarray:
    """Scaled rows with the component that gives them all the length one."""
    return np.column_stack([x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1), 0))])


def asking(q: np.ndarray) -> np.ndarray:
    """Query rows at length one, with a zero in the place of the lift."""
    y, _ = scaled(q)
    return np.column_stack([y / np.sqrt((y**2).sum(axis=1))[:, None], np.zeros(len(y))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` from all rows of ``b``."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def reach_in(bound: np.ndarray, power: np.ndarray, band) -> np.ndarray:
    """The distance in ``band`` that an inner product of ``bound * 2**power`` with the query of length one means."""
    with np.errstate(over="ignore"):
        least = np.ldexp(bound, np.clip(power - band, -4000, 4000).astype(np.int64))
    # Beyond length one nothing of the band is as near: no distance is below zero.
    return np.where(least > 1 + SLACK, -1.0, np.sqrt(np.maximum(2 - 2 * np.clip(least, -1, 1), 0)))


@dataclass
class Node:
    rows: np.ndarray | None = None
    number: int = 0
    point: np.ndarray | None = None
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None
    bounds: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


class VantageTree:
    """A vantage-point tree over rows of ``x`` (lifted vectors, of length one)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x, self.leaf, self.leaves = x, leaf, 0
        self.root = self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> Node:
        if len(rows) > self.leaf:
            start = self.x[rows[0]]
            point = self.x[rows[int(np.argmax(((self.x[rows] - start) ** 2).sum(axis=1)))]]
            d = distances(self.x[rows], point[None])[:, 0]
            radius = float(np.median(d))
            near = d <= radius
            if near.all():
                near = d < radius
            if 0 < near.sum() < len(rows):
                a, b = d[near], d[~near]
                return Node(None, 0, point, radius, self._grow(rows[near]), self._grow(rows[~near]), (a.min(), a.max(), b.min(), b.max()))
        self.leaves += 1
        return Node(rows, self.leaves)

    def search(self, queries: np.ndarray, k: int, factor: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that hold each query's ``k`` nearest rows; ``bound`` is a first k-th distance of each."""
        best = np.full((len(queries), k), np.inf)
        reach = bound.copy()
        home = np.zeros(len(queries), np.int64)
        pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(node: Node, active: np.ndarray) -> None:
            d = distances(queries[active], self.x[node.rows])
            q, r = np.nonzero(d <= reach[active][:, None] + SLACK)
            pairs.append((active[q], node.rows[r], d[q, r]))
            both = np.concatenate([best[active], d], axis=1)
            best[active] = np.partition(both, k - 1, axis=1)[:, :k]
            reach[active] = np.minimum(reach[active], best[active].max(axis=1))

        def descend(node: Node, active: np.ndarray) -> None:
            if not len(active):
                return
            if node.rows is not None:
                home[active] = node.number
                return look(node, active)
            near = distances(queries[active], node.point[None])[:, 0] <= node.radius
            descend(node.inner, active[near])
            descend(node.outer, active[~near])

        def visit(node: Node, active: np.ndarray) -> None:
            if node.rows is not None:
                active = active[home[active] != node.number]
                if len(active):
                    look(node, active)
                return
            d = distances(queries[active], node.point[None])[:, 0]
            low_in, high_in, low_out, high_out = node.bounds
            for child, low, high in ((node.inner, low_in, high_in), (node.outer, low_out, high_out)):
                least = np.maximum(np.maximum(d - high, low - d), 0)
                open_ = least <= factor * reach[active] + SLACK
                if open_.any():
                    visit(child, active[open_])

        everyone = np.arange(len(queries))
        descend(self.root, everyone)
        if len(everyone):
            visit(self.root, everyone)
        if not pairs:
            return everyone[:0], everyone[:0]
        q, r, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = d <= reach[q] + SLACK
        return q[keep], r[keep]


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` of rows with an id and a vector that isn't null, empty, zero or with null or non-finite parts."""
    rows = embeddings.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce(fine, F.lit(False))).where(F.exists("v", lambda x: x != 0)).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Layout:
    """What routing needs of one length of vectors: centres by band, and every ring's place and extent."""

    centres: dict[int, np.ndarray]  # band to lifted centres; cell k is the k-th, cell -1 has none
    bands: np.ndarray
    cells: np.ndarray
    rings: np.ndarray
    parts: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def least(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's lower bound of the distance to each ring, and its distance to the ring's centre (2 without)."""
        least, away = np.zeros((len(q), len(self.cells))), np.full((len(q), len(self.cells)), 2.0)
        for band, centres in self.centres.items():
            at = np.flatnonzero((self.bands == band) & (self.cells >= 0))
            d = distances(q, centres)
            own = d[:, self.cells[at]]
            plane = (own - d.min(axis=1)[:, None]) / 2
            least[:, at] = np.maximum(np.maximum(own - self.high[at], self.low[at] - own), np.maximum(plane, 0))
            away[:, at] = own
        return least, away


_HITS = "query_id long, twin long, vec_id long, score double, near double, band int"
_KEYS = ["dim", "band", "cell", "ring", "part"]


def search_shard(left: pa.Table, right: pa.Table, k: int, factor: float) -> pa.Table:
    """Each query's ``k`` best ids of one shard: ``left`` (v, ids, band) and ``right`` (query_id, twin, v, reach)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
    names = [part.split()[0] for part in _HITS.split(", ")]
    found: list[tuple[np.ndarray, ...]] = []
    if left.num_rows and right.num_rows:
        x, band = _matrix(left["v"]), left["band"][0].as_py()
        lists = left["ids"].combine_chunks()
        ids, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        lift = lifted(scaled(x)[0])
        tree = VantageTree(lift)
        asked, twin = right["query_id"].to_numpy(), right["twin"].to_numpy()
        reach = right["reach"].to_numpy()
        for at in range(0, right.num_rows, STEP):
            q = _matrix(right["v"].slice(at, STEP))
            own = asking(q)
            qi, xi = tree.search(own, k + 1, factor, reach[at : at + STEP])
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.concatenate([np.zeros(0), *((q[qi[c : c + 50_000]] * x[xi[c : c + 50_000]]).sum(axis=1) for c in range(0, len(qi), 50_000))])
            score[np.isnan(score)] = -np.inf
            near = np.concatenate([np.zeros(0), *((own[qi[c : c + 50_000]] * lift[xi[c : c + 50_000]]).sum(axis=1) for c in range(0, len(qi), 50_000))])
            # Equal vectors: one candidate for each of their ids.
            times = sizes[xi]
            row = np.repeat(np.arange(len(xi)), times)
            vec = ids[np.repeat(starts[xi] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            query = asked[at + qi[row]]
            row, vec, query = (a[vec != query] for a in (row, vec, query))
            order = np.lexsort((vec, -score[row], qi[row]))
            row, vec, query = row[order], vec[order], query[order]
            first = np.flatnonzero(np.r_[True, qi[row][1:] != qi[row][:-1]][: len(row)])
            kept = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
            row = row[kept]
            found.append((query[kept], twin[at + qi[row]], vec[kept], score[row], near[row], np.full(len(row), band)))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * len(names)
    return pa.table([pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)], names=names)


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, factor: float = 0.9, shard: int = SHARD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest others of each row whose id ``every`` divides.

    Nearest is the largest inner product in double precision, ties to the smaller id; all others if they are fewer than
    ``k``. Null, empty, zero and non-finite vectors take no part; vectors of another length than the query's aren't its
    candidates. An inner product that overflows is infinite, and one of opposite infinities counts as the least. An id
    with several vectors counts with its best; repeated rows count once. Equal vectors are searched once, with the
    ``k + 1`` smallest of their ids, which loses nothing. Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    spark = embeddings.sparkSession
    rows, rows_path = stored(usable(embeddings, id_col, vector_col).withColumns({"dim": F.size("v"), "twin": F.xxhash64("v")}))
    same = Window.partitionBy("v").orderBy("vec_id")
    vectors = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    chosen = spark.createDataFrame(smallest_hashes(rows, SAMPLE, "vec_id"), "vec_id long")  # bounded by the sample
    sample = rows.join(F.broadcast(chosen), "vec_id").groupBy("vec_id", "dim").agg(F.min("v").alias("v")).orderBy(F.xxhash64("vec_id")).collect()
    total = rows.count()
    wanted = min(CENTRES, max(1, -(-total // shard)))
    centres: dict[int, dict[int, np.ndarray]] = {}
    for dim in sorted({s.dim for s in sample}):
        own, band = scaled(np.array([s.v for s in sample if s.dim == dim]))
        own = lifted(own)
        for b in np.unique(band).tolist():
            held = own[band == b]
            centres.setdefault(dim, {})[b] = held[: max(1, round(wanted * len(held) / len(sample)))]
    held = spark.sparkContext.broadcast(centres)

    def assign(batches):
        centres = held.value
        for batch in batches:
            dims, values = batch.column(1).to_numpy(), batch.column(0)
            cell, away, bands = np.full(len(dims), -1, np.int32), np.zeros(len(dims)), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                own, band = scaled(_matrix(values.take(pa.array(at))))
                bands[at] = band
                for b in np.unique(band).tolist():
                    if b in centres.get(dim, {}):
                        here = at[band == b]
                        d = distances(lifted(own[band == b]), centres[dim][b])
                        best = d.argmin(axis=1)
                        cell[here], away[here] = best, d[np.arange(len(here)), best]
            yield pa.RecordBatch.from_arrays([values, batch.column(1), batch.column(2), pa.array(bands), pa.array(cell), pa.array(away)], names=["v", "dim", "ids", "band", "cell", "away"])

    dealt, dealt_path = stored(vectors.select("v", "dim", "ids").mapInArrow(assign, "v array<double>, dim int, ids array<long>, band int, cell int, away double"))
    # Rings: quantiles of the distance from the centre; as many as the cell has shards. Cells are few: centres bound them.
    grid = [i / RINGS for i in range(1, RINGS)]
    shapes, cuts = [], []
    for r in dealt.groupBy("dim", "band", "cell").agg(F.count("*").alias("n"), F.percentile_approx("away", grid, F.lit(1000)).alias("at")).collect():
        rings = min(RINGS, max(1, -(-r.n // shard))) if r.cell >= 0 else 1
        shapes.append((r.dim, r.band, r.cell, sorted({r["at"][round(i * RINGS / rings) - 1] for i in range(1, rings)})))
    shaped = F.broadcast(spark.createDataFrame(shapes, "dim int, band int, cell int, cuts array<double>"))
    dealt = dealt.join(shaped, ["dim", "band", "cell"]).withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("away")))).drop("cuts")
    extents = dealt.groupBy("dim", "band", "cell", "ring").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    # Ties can leave a ring large; then all rings of its cell are cut by hash as well.
    parts: dict[tuple, int] = {}
    for r in extents:
        cell = (r.dim, r.band, r.cell)
        parts[cell] = max(parts.get(cell, 1), -(-r.n // (2 * shard)))
    cut = F.broadcast(spark.createDataFrame([(*c, n) for c, n in parts.items()], "dim int, band int, cell int, parts int"))
    dealt = dealt.join(cut, ["dim", "band", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("parts")).cast("int"))
    layouts = {}
    for dim in {r.dim for r in extents}:
        own = [r for r in extents if r.dim == dim]
        each = [np.array(c) for c in zip(*((r.band, r.cell, r.ring, parts[dim, r.band, r.cell], r.n, r.low, r.high) for r in own), strict=True)]
        layouts[dim] = Layout(centres.get(dim, {}), *each)
    layout = spark.sparkContext.broadcast(layouts)

    def route(first: bool):
        """Each query once for the most promising shard, or for all that it may not skip."""

        def run(batches):
            for batch in batches:
                dims = batch.column(3).to_numpy()
                for dim in np.unique(dims):
                    shape = layout.value[int(dim)]
                    step = max(1, min(STEP, 20_000_000 // max(1, len(shape.cells))))
                    rows = np.flatnonzero(dims == dim)
                    for at in range(0, len(rows), step):
                        some = batch.take(pa.array(rows[at : at + step]))
                        q = asking(_matrix(some.column(2)))
                        least, away = shape.least(q)
                        if first:
                            # What a ring holds at best, as an inner product: the largest band first, then the nearest.
                            fit = np.where(shape.rows > k, 1 - least**2 / 2 - away / 100, -2.0)
                            ring = np.argmax(np.where(fit > 0, np.ldexp(np.maximum(fit, 1e-9), np.clip(shape.bands - shape.bands.max(), -1000, 0)), fit - 2), axis=1)
                            qi, of, reach = np.arange(len(ring)), np.abs(some.column(0).to_numpy()) % shape.parts[ring], np.full(len(ring), 2.0)
                        else:
                            power = some.column(5).to_numpy(zero_copy_only=False)
                            reach_all = np.column_stack([reach_in(some.column(4).to_numpy(zero_copy_only=False), power, b) for b in np.unique(shape.bands)])
                            reach_all = reach_all[:, np.searchsorted(np.unique(shape.bands), shape.bands)]
                            qi, ring = np.nonzero((least <= factor * reach_all + SLACK) & (reach_all >= 0))
                            times = shape.parts[ring]
                            qi, ring = np.repeat(qi, times), np.repeat(ring, times)
                            of = np.arange(len(qi)) - np.repeat(np.cumsum(times) - times, times)
                            reach = reach_all[qi, ring]
                        for low in range(0, len(qi), 10_000):
                            here = slice(low, low + 10_000)
                            some_rows = some.take(pa.array(qi[here]))
                            keys = [np.full(len(qi[here]), dim), shape.bands[ring[here]], shape.cells[ring[here]], shape.rings[ring[here]], of[here]]
                            yield pa.RecordBatch.from_arrays([*some_rows.columns[:3], pa.array(reach[here]), *(pa.array(c.astype(np.int32)) for c in keys)], names=["query_id", "twin", "v", "reach", *_KEYS])

        return run

    def visit(queries: DataFrame, first: bool) -> DataFrame:
        routed, path = stored(queries.mapInArrow(route(first), "query_id long, twin long, v array<double>, reach double, dim int, band int, cell int, ring int, part int"))
        # A shard that very many queries visit is copied for each block of them; all others move once.
        many = routed.groupBy(*_KEYS).count().select(*_KEYS, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
        left = dealt.join(many, _KEYS).select(*_KEYS, "v", "ids", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = routed.join(many.where("blocks > 1").select(*_KEYS, "blocks"), _KEYS, "left").withColumn("block", F.pmod(F.xxhash64("query_id", "twin"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
        keys = [*_KEYS, "block"]
        hits, hits_path = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda _key, a, b: search_shard(a, b, k, factor), _HITS))
        drop_stored(spark, path)
        paths.append(hits_path)
        return hits

    paths: list[str] = []
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "twin", "v", "dim")
    near = visit(queries.select(F.col("vec_id").alias("query_id"), "twin", "v", "dim", F.lit(-1.0).alias("bound"), F.lit(0).alias("power")), True)
    # The k-th best of those gives each query its bound; a query with fewer has none.
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    bounds = near.withColumn("n", F.row_number().over(order)).where((F.col("n") == k) & (F.abs("score") < float("inf"))).select("query_id", "twin", F.col("near").alias("bound"), F.col("band").alias("power"))
    bounded = queries.withColumnRenamed("vec_id", "query_id").join(bounds, ["query_id", "twin"], "left")
    none = 5000  # the exponent of no bound at all: minus two to it is below every inner product
    bounded = bounded.select("query_id", "twin", "v", "dim", F.coalesce("bound", F.lit(-1.0)).alias("bound"), F.coalesce("power", F.lit(none)).alias("power"))
    far = visit(bounded, False)
    drop_stored(spark, rows_path, dealt_path)
    hits = near.unionByName(far).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
