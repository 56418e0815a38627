"""Centroid clustering: plain Lloyd in whole numbers.

Components are whole numbers, ``floor(scale * x)``.  The centroids (a fixed,
small number) are broadcast; ``mapInPandas`` computes, for each block of
vectors, the integer squared differences to one centroid after another in
NumPy, and the argmin takes the lowest number among equals.  Each partition
gives one row of integer sums for each centroid that it met, and a groupBy
merges these rows; so what a round shuffles is the number of partitions times
the number of centroids, whatever the number of vectors, and a centroid that
holds most of the vectors costs no task more than the others.  New centroids
are the exact floors of sum over count, so the result does not depend on the
order or the layout of the rows.

The first centroids are the vectors with the smallest
``sha256("<seed>:<vec_id>")``.

Defined cases: vectors that are null, hold null or non-finite components, or
have another number of components than `dim` take no part, neither do those
with a component beyond ``MOST`` (their squared distances would not fit 64
bits); rows with a null id take part and come last among the first centroids;
repeated rows count as often as they occur (equal ids are ordered by the bytes
of their components); with fewer vectors than centroids there are as many centroids as
vectors; a centroid that no vector is nearest to stays where it is; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import Scratch

DIM, K, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Components up to this size, so that sums of squares fit 64 bits.
MOST = 1 << 27
#: Vectors whose differences are held at once.
_BLOCK = 4096


def whole_vectors(data: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id, v (`dim` int64 as binary) of all usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False)
            ids, vectors = batch.column(0).filter(fits), vectors.filter(fits)
            values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(values * scale)
            keep = (np.abs(scaled) <= MOST).all(axis=1)  # false for NaN
            whole = scaled[keep].astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), X.binary_array(list(whole))], ["vec_id", "v"])

    return data.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.int64).reshape(len(column), dim)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; the lowest number among equals."""
    cluster, least = np.zeros(len(vectors), dtype=np.int32), np.zeros(len(vectors), dtype=np.int64)
    for a in range(0, len(vectors), _BLOCK):
        block = vectors[a : a + _BLOCK]
        squares = np.empty((len(block), len(centroids)), dtype=np.int64)
        for c, centroid in enumerate(centroids):
            apart = block - centroid
            squares[:, c] = np.einsum("ij,ij->i", apart, apart)
        cluster[a : a + _BLOCK] = squares.argmin(axis=1)
        least[a : a + _BLOCK] = squares.min(axis=1)
    return cluster, least


def first_centroids(rows: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    picked = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).toPandas()
    return matrix(picked["v"], dim)


def sums(rows: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """cluster, n, s0 ... : number and componentwise sums of the vectors nearest to each centroid."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        count, total = np.zeros(len(own), dtype=np.int64), np.zeros((len(own), dim), dtype=np.int64)
        for frame in frames:
            vectors = matrix(frame["v"], dim)
            cluster, _ = nearest(vectors, own)
            count += np.bincount(cluster, minlength=len(own))
            order = np.argsort(cluster, kind="stable")
            met, at = np.unique(cluster[order], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(vectors[order], at, axis=0)
        some = np.flatnonzero(count)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "sums": list(total[some])})

    parts = rows.select("v").mapInPandas(run, "cluster int, n long, sums array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)))


def moved(rows: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """The centroids after one round."""
    out = centroids.copy()
    for row in sums(rows, centroids, dim).collect():  # one row for each centroid at most
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def lloyd(
    spark: SparkSession,
    data: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    dim: int = DIM,
    seed: int = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia and inertia of every vector; the final centroids).

    `distance` is squared.  The vectors are written once, as whole numbers;
    each round reads them where they are and sends `k` rows to the driver.
    """
    with Scratch(spark, batch=10_000) as scratch:
        rows = scratch.table(whole_vectors(data, id_col, vector_col, dim, scale), "vectors")
        centroids = first_centroids(rows, k, seed, dim)
        for _ in range(rounds if len(centroids) else 0):
            centroids = moved(rows, centroids, dim)
        held = spark.sparkContext.broadcast(centroids)

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                cluster, distance = nearest(matrix(frame["v"], dim), held.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "cluster": cluster, "distance": distance})

        placed = scratch.table(rows.mapInPandas(assign, "vec_id long, cluster int, distance long"), "placed")
        inertia = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
        whole = placed.agg(F.sum("distance")).first()[0]
        out = placed.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"))
        return scratch.finish(out), centroids


def centroid_digests(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    """cluster, centroid_sha256: of the components as decimal numbers joined by commas."""
    rows = [(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)]
    return spark.createDataFrame(rows, "cluster int, centroid_sha256 string")
