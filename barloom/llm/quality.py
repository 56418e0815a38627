"""Quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good and one
from texts labelled bad.  A text is compressed with each; the difference of
the sizes, divided by the length of the text, says which kind it resembles,
and a logistic curve of this one number, fitted on labelled texts that neither
dictionary has seen, turns it into a probability.

The fit uses a bounded sample of labelled rows: of each label at most
``rows_per_label`` documents in the order of a hash of their ids.  If these
pass ``bytes_per_label``, all stay, and of the longer ones a part of an equal
share of the bytes, at a hashed place, is used.  Every text is then scored whole, in
blocks of ``BLOCK_BYTES`` that are compressed one by one, so that a
dictionary counts in every part of a long text.

Defined cases: null and empty texts have the score 0.5;
rows are scored one by one, so equal rows get equal scores; a null id falls in
the training fold but matches no label; documents with labels of both kinds
count for both; of rows that share a labelled id, one takes part in the fit
(by a hash of the text); with no labels the score is 0.5, with one kind only it is that
kind's smoothed share; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import wide_rows

ROWS_PER_LABEL = 1600
BYTES_PER_LABEL = 12 << 20
BLOCK_BYTES = 8192
DICTIONARY_BYTES = 1 << 20
LEVEL = 3


def fold(modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    blocks = [s[i : i + BLOCK_BYTES] for s in samples for i in range(0, len(s), BLOCK_BYTES)]
    try:
        return zstandard.train_dictionary(size, [b for b in blocks if len(b) >= 8], k=1024, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:] or b"\0" * 8


def _compressors(dictionaries: tuple[bytes, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in dictionaries:
        held = zstandard.ZstdCompressionDict(d)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False))
    return out


def difference(compressors, text: bytes) -> float:
    """(size with the bad dictionary - size with the good one) / length of the text; 0 for an empty text."""
    sizes = [0, 0]
    for at in range(0, len(text), BLOCK_BYTES):
        block = text[at : at + BLOCK_BYTES]
        for k, c in enumerate(compressors):
            sizes[k] += len(c.compress(block))
    return (sizes[0] - sizes[1]) / max(1, len(text))


def fit_curve(x: np.ndarray, y: np.ndarray, each: np.ndarray, steps: int = 60) -> tuple[float, float, float, float]:
    """(slope, intercept, centre, scale) of a logistic curve, by Newton steps with a weak prior; each: the weights of the rows."""
    centre, scale = float(x.mean()), max(float(x.std()), 1e-9)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (each * (p - y)) + 0.1 * w
        hessian = (z * (each * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), centre, scale


class Model:
    """Dictionaries and the curve; of bounded size whatever the corpus."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, curve: tuple | None, share: float) -> None:
        self.dictionaries, self.curve, self.share = dictionaries, curve, share

    def scores(self, compressors, texts: list[bytes]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        slope, intercept, centre, scale = self.curve
        x = np.array([difference(compressors, t) for t in texts])
        t = np.where(np.array([len(t) for t in texts]) > 0, slope * (x - centre) / scale + intercept, 0.0)
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def fit(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    rows_per_label: int = ROWS_PER_LABEL,
    bytes_per_label: int = BYTES_PER_LABEL,
) -> Model:
    """Dictionaries from one half of the sample, the curve from the other; docs and labels: training rows only."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) >= 1).cast("int").alias("y")).distinct()
    marked = marked.withColumn("order", F.xxhash64("doc_id"))
    shares = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    sample = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy("order", "doc_id").limit(rows_per_label)
        sample = part if sample is None else sample.union(part)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the sample has at most 2 * rows_per_label rows, whatever the input; so have the lengths, one for each of them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    chosen = rows.join(F.broadcast(sample), "doc_id").groupBy("y", "order", "doc_id").agg(F.min(F.struct("text_key", F.octet_length("text").alias("size"))).alias("least"))
    label_rows = W.partitionBy("y")
    share = F.greatest(F.floor(F.lit(bytes_per_label) / F.count(F.lit(1)).over(label_rows)), F.lit(1)).cast("int")
    chosen = chosen.select("y", "order", "doc_id", "least.text_key", "least.size")
    chosen = chosen.withColumn("most", F.when(F.sum("size").over(label_rows) > bytes_per_label, F.least("size", share)).otherwise(F.col("size")))
    # texts are cut where they are read; what travels has at most bytes_per_label for each label
    at = (F.pmod(F.xxhash64("doc_id", "text"), F.col("size") - F.col("most") + 1) + 1).cast("int")
    parts = rows.join(F.broadcast(chosen), ["doc_id", "text_key"]).select("y", "order", "doc_id", F.substring(F.col("text").cast("binary"), at, F.col("most")).alias("text"))
    rows = parts.groupBy("y", "order", "doc_id").agg(F.min("text").alias("text")).orderBy("y", "order", "doc_id").select("y", "text").toArrow()
    y = np.array(rows["y"].to_pylist(), dtype=np.int64)
    texts = rows["text"].to_pylist()
    share = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    kinds = [[t for t, v in zip(texts, y.tolist()) if v == k] for k in (0, 1)]
    if min(map(len, kinds)) < 2:
        return Model(None, None, share)
    dictionaries = tuple(_dictionary(k[::2], DICTIONARY_BYTES) for k in kinds)
    compressors = _compressors(dictionaries)
    x = np.array([difference(compressors, t) for k in kinds for t in k[1::2]])
    target = np.concatenate([np.full(len(k[1::2]), float(v)) for v, k in enumerate(kinds)])
    # the labels' own shares, not those of the sample, make the score a probability
    prior = np.array([shares[int(v)] / max(1, int((target == v).sum())) for v in target.tolist()])
    return Model(dictionaries, fit_curve(x, target, prior / prior.mean()), share)


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs` (doc_id, held_out, text)."""
    wide_rows(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        compressors = _compressors(own.dictionaries) if own.dictionaries else None
        for batch in batches:
            data, o = X.column_bytes(batch.column(2))
            text = data.tobytes()
            s = own.scores(compressors, [text[a:b] for a, b in zip(o[:-1].tolist(), o[1:].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, **options) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text), learned from rows outside the held-out fold alone."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold(modulus) == held)
    model = fit(spark, docs.where(~F.col("held_out")), labels.where(fold(modulus) != held), label, **options)
    return score(spark, docs, model)
