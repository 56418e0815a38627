"""Exact top-k search by a Voronoi join on the inner product.

Pivots (a bounded sample of the data) divide the space into cells.  Every data
vector goes to the cell of its nearest pivot, queries are grouped in the same
way, and each cell is summarised by its number of vectors, its radius and its
longest vector.  From the summaries a query gets a lower bound of its k-th
score (the pivots are data themselves) and, for each cell, an upper bound
``q.p + |q| r`` of any score in it; it is sent only to cells whose upper bound
reaches the lower one.  Near cells share a bin of bounded size and a cell with
very many vectors (copies) is cut into several.  A bin's vectors, followed by
blocks of the queries that need one of its cells, pass a task as a stream; each
block is solved by one product of two matrices and gives at most k rows for a
query, of which the best k remain.  Nothing is broadcast but pivots and
summaries: the queries sent are as many as their number times that of the bins
where nothing can be pruned.

Components are whole numbers, ``floor(scale * x)``; scores are exact as long
as they fit 64 bits.

Defined cases: vectors that are null or hold null or non-finite components
take no part, neither do rows with a null id; shorter vectors are padded with
zeros (an empty one is the zero vector); ties go to the smaller id; every
other row is a candidate, repeated rows as often as they occur; a query row
that occurs repeatedly is one query; a row's own are all rows of its id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import Scratch, partitions

SCALE = 256
CHUNK = 16_384
MOST_PIVOTS = 2048
#: Queries of a block.
BLOCK = 128
#: Whole numbers up to this are exact in doubles.
_EXACT = 2.0**52


def whole_vectors(spark: SparkSession, data: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id, v (int64, binary) of all rows with usable vectors."""

    def run(batches):
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            flat = pc.list_flatten(vectors)
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            ok = (bad[ends] == bad[ends - sizes]) & pc.is_valid(vectors).to_numpy(zero_copy_only=False) & pc.is_valid(ids).to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore"):
                ints = np.floor(values * scale).astype(np.int64)
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), X.binary_array([ints[ends[k] - sizes[k] : ends[k]] for k in keep.tolist()])], ["vec_id", "v"])

    rows = data.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, v binary")


def _matrix(column, dim: int) -> np.ndarray:
    values, o = X.unpack(column, np.int64)
    out = np.zeros((len(column), dim), dtype=np.int64)
    sizes = np.diff(o)
    if (sizes == dim).all():
        return values.reshape(len(column), dim).copy() if dim else out
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(values)) - np.repeat(o[:-1], sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Cells:
    """Pivots and the summaries of their cells; bounded by the number of pivots."""

    def __init__(self, ids: np.ndarray, pivots: np.ndarray) -> None:
        self.ids, self.pivots = ids, pivots
        self.exact = pivots.astype(np.float64)
        self.squares = (self.exact**2).sum(axis=1)
        n = len(ids)
        self.count, self.radius, self.longest = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance to its pivot, length) of each vector."""
        v = vectors.astype(np.float64)
        squares = (v**2).sum(axis=1)
        cell = (self.squares[None, :] - 2 * v @ self.exact.T).argmin(axis=1) if len(v) else np.zeros(0, dtype=np.int64)
        distance = np.sqrt(((v - self.exact[cell]) ** 2).sum(axis=1))
        return cell, distance, np.sqrt(squares)

    def deal(self, chunk: int) -> None:
        """The bins of each cell, `parts` from `first` on: about `chunk` vectors in each."""
        self.parts = np.maximum(1, -(-self.count // chunk))
        heads = self.exact[: max(1, int(self.count.sum()) // chunk)]
        near = ((heads**2).sum(axis=1)[None, :] - 2 * self.exact @ heads.T).argmin(axis=1) if len(self.ids) else np.zeros(0, dtype=np.int64)
        order = np.argsort(near, kind="stable")
        long, short = np.flatnonzero(self.parts > 1), order[self.parts[order] == 1]
        self.first = np.zeros(len(self.ids), dtype=np.int64)
        self.first[long] = np.cumsum(self.parts[long]) - self.parts[long]
        self.first[short] = self.parts[long].sum() + (np.cumsum(self.count[short]) - self.count[short]) // chunk

    def needed(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Which cells (columns) may hold one of the k best of each query (rows)."""
        score = products(queries, self.pivots).astype(np.float64)
        length = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))[:, None]
        upper = np.minimum(score + length * self.radius, length * self.longest)
        known = np.where(self.ids[None, :] == query_ids[:, None], -np.inf, score)
        floor = np.partition(known, len(self.ids) - k, axis=1)[:, len(self.ids) - k] if len(self.ids) >= k else np.full(len(queries), -np.inf)
        slack = 1e-9 * (np.abs(upper) + np.abs(score) + 1)
        return (upper + slack >= floor[:, None]) & (self.count > 0)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best of each query among one chunk, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    score = products(queries, vectors)
    own = ids[None, :] == query_ids[:, None]
    rows, at = [], []
    low = np.iinfo(np.int64).min
    score[own] = low
    take = min(k, len(ids))
    if take < len(ids):
        border = np.partition(score, len(ids) - take, axis=1)[:, len(ids) - take]
    else:
        border = np.full(len(queries), low)
    for q in range(len(queries)):
        near = np.flatnonzero((score[q] >= border[q]) & ~own[q])
        near = near[np.argsort(-score[q, near].astype(np.float64), kind="stable")] if float(np.abs(score[q, near]).max(initial=0)) < _EXACT else np.array(sorted(near.tolist(), key=lambda c: (-int(score[q, c]), c)), dtype=np.int64)
        near = near[:take]
        rows.append(np.full(len(near), q))
        at.append(near)
    rows_, at_ = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in (rows, at))
    return rows_, ids[at_], score[rows_, at_]


def top_k(
    spark: SparkSession,
    data: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    most_pivots: int = MOST_PIVOTS,
    chunk: int = CHUNK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row where `queries` holds.

    `queries` is a condition on ``vec_id``.  The number of pivots follows the
    square root of the number of rows up to `most_pivots`; results depend on
    neither `most_pivots` nor `chunk`.
    """
    with Scratch(spark) as scratch:
        rows = scratch.table(whole_vectors(spark, data, id_col, vector_col, scale), "vectors")
        shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("v") / 8).alias("dim")).first()
        n, dim = int(shape["n"]), int(shape["dim"] or 0)
        wanted = max(8, min(most_pivots, math.isqrt(n) // 2))
        picked = rows.orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id", "v").limit(2 * wanted).toArrow()
        vectors, ids = _matrix(picked["v"].combine_chunks(), dim) if n else np.zeros((0, dim), dtype=np.int64), picked["vec_id"].to_numpy()
        _, first = np.unique(vectors, axis=0, return_index=True) if n and dim else (None, np.arange(min(n, 1)))
        first = np.sort(first)[:wanted]
        cells = Cells(ids[first], vectors[first])
        pivots = spark.sparkContext.broadcast(cells)

        def assign(batches):
            own = pivots.value
            for batch in batches:
                cell, distance, length = own.nearest(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(length)], ["vec_id", "v", "cell", "distance", "length"])

        placed = scratch.table(rows.mapInArrow(assign, "vec_id long, v binary, cell int, distance double, length double"), "placed")
        summary = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.max("length").alias("longest")).collect()  # one row for each pivot at most
        for r in summary:
            cells.count[r["cell"]], cells.radius[r["cell"]], cells.longest[r["cell"]] = r["n"], r["radius"], r["longest"]
        cells.deal(min(chunk, max(2048, n // 64)))
        held = spark.sparkContext.broadcast(cells)
        names = ["bin", "kind", "cell", "vec_id", "v", "ids", "keys"]
        schema = "bin long, kind int, cell int, vec_id long, v binary, ids binary, keys binary"
        dealt = spark.createDataFrame([(c, int(a), int(p)) for c, (a, p) in enumerate(zip(cells.first, cells.parts))], "cell int, first long, parts long")
        part = F.pmod(F.xxhash64("vec_id", "v"), "parts")
        stored = placed.join(F.broadcast(dealt), "cell").select((F.col("first") + part).alias("bin"), F.lit(0).alias("kind"), "cell", "vec_id", "v", *(F.lit(None).cast("binary").alias(c) for c in ("ids", "keys")))

        def send(batches):
            own = held.value
            for batch in batches:
                ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                q = _matrix(batch.column(1), dim)
                for a in range(0, len(ids), BLOCK):
                    at = slice(a, a + BLOCK)
                    # most components are small
                    packed = q[at].astype(np.int16) if np.abs(q[at]).max(initial=0) < 1 << 15 else q[at]
                    need = own.needed(ids[at], q[at], k)
                    wanted: dict[int, np.ndarray] = {}
                    for c in np.flatnonzero(need.any(axis=0)).tolist():
                        for b in range(int(own.first[c]), int(own.first[c] + own.parts[c])):
                            wanted[b] = need[:, c] | wanted.get(b, False)
                    bins = list(wanted)
                    for s in range(0, len(bins), 64):
                        some = bins[s : s + 64]
                        rows_ = [np.flatnonzero(wanted[b]) for b in some]
                        none = np.zeros(len(some), dtype=np.int64)
                        columns = [pa.array(some, pa.int64()), pa.array(none + 1, pa.int32()), pa.array(none, pa.int32()), pa.array(none)]
                        yield pa.RecordBatch.from_arrays([*columns, *(X.binary_array([x[r] for r in rows_]) for x in (packed, ids[at], keys[at]))], names)

        asked = placed.where(queries).select("vec_id", "v", "cell").distinct().repartition(partitions(spark), "cell", F.pmod(F.xxhash64("vec_id"), F.lit(16))).sortWithinPartitions("cell", "vec_id").select("vec_id", "v", F.xxhash64("v").alias("key"))
        sent = asked.mapInArrow(send, schema)

        def solve(batches):
            own = held.value
            now, vectors, ids, cell = None, [], [], []
            for batch in batches:
                bins, kinds = (batch.column(c).to_numpy() for c in (0, 1))
                starts = np.flatnonzero(np.concatenate([[True], (bins[1:] != bins[:-1]) | (kinds[1:] != kinds[:-1])])) if len(bins) else []
                for a, b in zip(starts, [*starts[1:], len(bins)]):
                    if bins[a] != now:
                        now, vectors, ids, cell = bins[a], [], [], []
                    piece = batch.slice(a, b - a)
                    if kinds[a] == 0:
                        vectors.append(_matrix(piece.column(4), dim))
                        ids.append(piece.column(3).to_numpy())
                        cell.append(piece.column(2).to_numpy())
                        continue
                    if not ids:
                        continue
                    if len(ids) > 1:
                        order = np.argsort(np.concatenate(ids), kind="stable")
                        vectors, ids, cell = ([np.concatenate(x)[order]] for x in (vectors, ids, cell))
                    for i in range(len(piece)):
                        qi, key = (np.frombuffer(piece.column(c)[i].as_py(), dtype=np.int64) for c in (5, 6))
                        packed = piece.column(4)[i].as_py()
                        q = np.frombuffer(packed, dtype=f"i{len(packed) // (len(qi) * dim) if dim else 8}").astype(np.int64).reshape(len(qi), dim)
                        use = own.needed(qi, q, k).any(axis=0)[cell[0]]
                        r, vec, score = best_of(qi, q, ids[0][use], vectors[0][use], k) if not use.all() else best_of(qi, q, ids[0], vectors[0], k)
                        yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(key[r]), pa.array(vec), pa.array(score)], ["query_id", "q", "vec_id", "score"])

        stream = stored.unionByName(sent).repartition(partitions(spark), "bin").sortWithinPartitions("bin", "kind")
        found = stream.mapInArrow(solve, "query_id long, q long, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
        out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        return scratch.finish(out)
