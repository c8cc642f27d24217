"""Exact vector search that visits only cells that can hold a result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.retrieval import _rows, _unit, top_k
from ledgerloom.sources.landing import materialize

#: Vectors that the cells are fitted on, at most, the most cells, and the rows of neighbouring cells that one task holds, at most.
FIT_ROWS, CELLS, CHUNK = 4096, 256, 65536
#: Queries that meet them in one task, at most, and those that are multiplied at once.
BLOCK, AT_ONCE = 65536, 256
#: Numbers in the rows, and in the queries, of one task: long vectors make fewer of both. Products that are held at once.
HELD, PRODUCTS = 1 << 22, 1 << 21
#: Parts that rows, and queries, are dealt in at least, so that there are tasks enough, unless a part has less than so many of them.
SPREAD, LEAST = 16, 4096


def _at_most(most: int, every: int, dim: int) -> int:
    """How many of `every` vectors of that length go to one task."""
    return max(1, min(most, HELD // max(dim, 1), max(LEAST, -(-every // SPREAD))))


def _fit(x: np.ndarray, cells: int, steps: int = 8, seed: int = 3) -> np.ndarray:
    """Centres by Lloyd's steps from rows chosen at random."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(steps):
        of = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        n = np.bincount(of, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0))


class Layout:
    """The cells of one length of vectors that have rows, in order, and the bundles that these are dealt in."""

    def __init__(self, dim: int, centres: np.ndarray, cells: list[tuple[int, float, int]]):
        self.cell, self.radius, self.n = (np.array(c) for c in zip(*sorted(cells)))
        self.centres = centres[self.cell]
        most, bundle, held = _at_most(CHUNK, int(self.n.sum()), dim), -1, 0
        self.bundle = np.zeros(len(self.cell), np.int64)
        for k, n in enumerate(self.n.tolist()):
            if bundle < 0 or held + n > most:
                bundle, held = bundle + 1, 0
            self.bundle[k], held = bundle, held + n
        rows = np.bincount(self.bundle, self.n).astype(int)
        self.chunks = [-(-n // most) for n in rows.tolist()]  # over one only for a cell that is too large by itself

    def bounds(self, y: np.ndarray) -> np.ndarray:
        """The least distance that a row of each cell can have; NaN for vectors that have none."""
        return np.maximum(_distances(y, self.centres) - self.radius, 0)


def _best(score: np.ndarray, least: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best of each row, rounded, the first ones on a tie, and maybe of more; none under the row's `least`."""
    row, at = np.nonzero(score >= least[:, None])
    width = score.shape[1]
    if k < width and len(row) > 32 * k * len(score):
        order = (np.rint(score * 10.0**digits).astype(np.int64) << 32) - np.arange(width)  # no two are equal
        at = np.argpartition(order, width - k, axis=1)[:, width - k :].ravel()
        row = np.repeat(np.arange(len(score)), k)
    return row, at


def nearest_in_cells(
    vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", query_id: str = "query_id",
    query: str = "query", digits: int = 6, keep: Callable[[DataFrame], DataFrame] = materialize,
) -> tuple[DataFrame, DataFrame]:
    """The rows of `retrieval.nearest`, and one row with n_products and n_all.

    Unit vectors fall into cells around centres that are fitted on at most `FIT_ROWS` of them; every vector is in the cell of
    its nearest centre, and each cell knows its radius. By the triangle inequality nothing in a cell is nearer to a query
    than the distance to the centre less the radius. A query first visits the cells of the lowest bounds that together hold
    k vectors; the k-th distance there is one that the result keeps, so cells whose bound is beyond it are never visited. That
    is exact whatever the cells are; they only decide how much is left out.

    Bounds are worked out where the query is. What is shuffled are vectors: a query goes once to each bundle of neighbouring
    cells that it visits, with the numbers of the cells, and rows once to each block of queries that visit their bundle. A
    task holds a bundle, or a chunk of a cell that is too large for one, and a block, however many there are; and it gives
    the k best of a query over all cells of its bundle.
    """
    held = keep(vectors.select(F.col(vec_id).alias("_v"), _unit(F.col(embedding)).alias("_x"))).filter("_x is not null")
    asked = keep(queries.select(F.col(query_id).alias("_q"), _unit(F.col(query)).alias("_y"))).filter("_y is not null")
    sample = held.withColumn("_dim", F.size("_x")).orderBy(F.xxhash64("_v"), "_v").limit(FIT_ROWS).select("_dim", "_x").toArrow()
    n = held.count()
    lengths = sample.column("_dim").to_numpy()
    cells = min(CELLS, max(1, int(np.sqrt(max(n, 1)))))
    centres = {}
    for dim in np.unique(lengths):
        x = _rows(sample.column("_x").filter(pa.array(lengths == dim)))
        x = x[np.isfinite(x).all(axis=1)]
        centres[int(dim)] = _fit(x, cells) if len(x) else np.zeros((1, int(dim)))

    kinds = [queries.schema[query_id].dataType.simpleString(), vectors.schema[vec_id].dataType.simpleString()]

    def placed(batches):
        """Vectors with their cell and the distance to its centre."""
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(size):
                part = batch.take(pa.array(np.flatnonzero(size == dim)))
                d = _distances(_rows(pa.chunked_array([part.column(1)])), centres.get(int(dim), np.zeros((1, int(dim)))))
                cell = np.argmin(np.where(np.isnan(d), np.inf, d), axis=1)
                out = [part.column(0), pa.array(np.full(len(cell), dim), pa.int32()), pa.array(cell, pa.int32()),
                       pa.array(d[np.arange(len(d)), cell], pa.float64()), part.column(1)]
                yield pa.RecordBatch.from_arrays(out, ["_v", "_dim", "_cell", "_d", "_x"])

    rows = keep(held.select("_v", "_x").mapInArrow(placed, f"_v {kinds[1]}, _dim int, _cell int, _d double, _x array<double>").filter(
        "not isnan(_d)"))
    found: dict[int, list] = {}
    for r in rows.groupBy("_dim", "_cell").agg(F.max("_d").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # CELLS a length
        found.setdefault(r["_dim"], []).append((r["_cell"], r["radius"], r["n"]))
    layouts = {dim: Layout(dim, centres.get(dim, np.zeros((1, dim))), cells) for dim, cells in found.items()}
    spark = vectors.sparkSession
    bundles = spark.createDataFrame(
        [(dim, int(c), int(b)) for dim, x in layouts.items() for c, b in zip(x.cell, x.bundle)], "_dim int, _cell int, _bundle int")
    slack = 2 * 10.0**-digits  # scores are rounded, and distances carry rounding errors

    def ways(df: DataFrame, after: bool) -> DataFrame:
        """A row for each query and bundle it visits: the cells there and how many rows they have. `_all` is the number of rows that
        the query could meet, once for each query. `after` the first visit the score of the k-th found there is known."""

        def run(batches):
            for batch in batches:
                size = np.asarray(batch.column(1).value_lengths())
                for dim in np.unique(size):
                    x = layouts.get(int(dim))
                    if x is None:
                        continue
                    part = batch.take(pa.array(np.flatnonzero(size == dim)))
                    bound = x.bounds(_rows(pa.chunked_array([part.column(1)])))
                    known = ~np.isnan(bound)
                    least = part.column(2).to_numpy(zero_copy_only=False).astype(float)  # NULL is NaN
                    if after:
                        beyond = np.sqrt(np.maximum(2 - 2 * (least - slack), 0)) + 1e-7
                        visit = known & ~(bound > beyond[:, None])
                    else:
                        order = np.argsort(bound, axis=1, kind="stable")
                        n = x.n[order]
                        visit = np.zeros(bound.shape, bool)
                        np.put_along_axis(visit, order, n.cumsum(axis=1) - n < k, axis=1)
                        visit &= known
                    row, at = np.nonzero(visit)
                    if not len(row):
                        continue
                    start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (x.bundle[at[1:]] != x.bundle[at[:-1]])])
                    whose = row[start]
                    every = np.where(np.r_[True, whose[1:] != whose[:-1]], x.n.sum(), 0)
                    cells = pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)], pa.int32()), pa.array(x.cell[at], pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(whose)), pa.array(np.full(len(start), dim), pa.int32()),
                         pa.array(x.bundle[at[start]], pa.int32()), cells, pa.array(np.add.reduceat(x.n[at], start), pa.int64()),
                         pa.array(every, pa.int64()), pa.array(least[whose], pa.float64())], names)

        names = ["_q", "_dim", "_bundle", "_cells", "_n", "_all", "_least"]
        return df.select("_q", "_y", "_least").mapInArrow(
            run, f"_q {kinds[0]}, _dim int, _bundle int, _cells array<int>, _n bigint, _all bigint, _least double")

    by = ["_dim", "_bundle", "_chunk", "_block"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        q, v = left.column("_q"), right.column("_v")
        row, at, kept = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        if len(left) and len(right):
            ids, cell = np.asarray(v), np.asarray(right.column("_cell"))
            order = np.lexsort((ids, cell))  # ties by id
            y, x, cell = _rows(left.column("_y")), _rows(right.column("_x"))[order], cell[order]
            least = np.nan_to_num(left.column("_least").to_numpy() - 10.0**-digits, nan=-np.inf)
            visits = left.column("_cells").combine_chunks()
            whose, which = np.repeat(np.arange(len(y)), np.asarray(visits.value_lengths())), np.asarray(visits.flatten())
            for start in range(0, len(y), AT_ONCE):
                lo, hi = np.searchsorted(whose, (start, start + AT_ONCE))
                some = [[np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]]
                for c in np.unique(which[lo:hi]).tolist():
                    first, last = np.searchsorted(cell, (c, c + 1))
                    asking = whose[lo:hi][which[lo:hi] == c]
                    step = max(1, PRODUCTS // max(last - first, 1))
                    for s in range(0, len(asking) if last > first else 0, step):
                        part = asking[s : s + step]
                        score = y[part] @ x[first:last].T
                        r, a = _best(score, least[part], k, digits)
                        for out, values in zip(some, (part[r], a + first, np.round(score[r, a], digits))):
                            out.append(values)
                r, a, score = map(np.concatenate, some)
                best = np.lexsort((ids[order[a]], -score, r))
                best = best[np.arange(len(best)) - np.searchsorted(r[best], r[best]) < k]
                for out, values in zip((row, at, kept), (r[best], order[a[best]], score[best])):
                    out.append(values)
        return pa.table({"q": q.take(pa.array(np.concatenate(row), pa.int64())), "v": v.take(pa.array(np.concatenate(at), pa.int64())),
                         "score": pa.array(np.concatenate(kept), pa.float64())})

    def visited(some: DataFrame) -> DataFrame:
        asking = some.groupBy("_dim", "_bundle").agg(F.count(F.lit(1)).alias("n")).collect()
        blocks = spark.createDataFrame(
            [(r["_dim"], r["_bundle"], layouts[r["_dim"]].chunks[r["_bundle"]], -(-r["n"] // _at_most(BLOCK, r["n"], r["_dim"]))) for r in asking],
            "_dim int, _bundle int, _chunks int, _blocks int")
        grid = some.join(asked, "_q").join(blocks, ["_dim", "_bundle"]).withColumns({
            "_block": F.pmod(F.xxhash64("_q"), F.col("_blocks")).cast("int"),
            "_chunk": F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))}).select("_q", "_y", "_cells", "_least", *by)
        met = rows.join(bundles, ["_dim", "_cell"]).join(blocks, ["_dim", "_bundle"]).withColumns({
            "_chunk": F.pmod(F.xxhash64("_v"), F.col("_chunks")).cast("int"),
            "_block": F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))}).select("_v", "_x", "_cell", *by)
        out = grid.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(rank, f"q {kinds[0]}, v {kinds[1]}, score double")
        return out.filter("not isnan(score)").select(
            F.col("q").alias(query_id), F.col("v").alias(vec_id), F.round("score", digits).alias("score"))

    first = keep(ways(asked.withColumn("_least", F.lit(None).cast("double")), False))
    reached = top_k(visited(first), [query_id], "score", vec_id, k).groupBy(F.col(query_id).alias("_q")).agg(
        F.min("score").alias("_least"), F.count(F.lit(1)).alias("_found")).filter(F.col("_found") == k)
    left = keep(ways(asked.join(reached, "_q", "left"), True))
    counted = left.agg(F.sum("_n").alias("n_products")).select("n_products", first.agg(F.sum("_all").alias("n")).scalar().alias("n_all"))
    return top_k(visited(left), [query_id], "score", vec_id, k), counted
