"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic).  Raking multiplies one
factor for each source, language and topic until the expected tokens of the
sample meet all three targets; a document's probability is the product of its
factors, at most 1, and it is drawn by a hash of its id and text, so that a
repeated or partly lost run draws the same sample.

The table of cells is the product of three label sets.  Up to ``CELLS`` cells
it is raked on the driver; beyond, by the same steps on the distributed table.

A document's topic is learned from all documents: their words of six bytes or
more are counted in ``TOPIC_WIDTH`` hashed columns, weighted by their
rarity, and split into ``TOPICS`` groups by spherical k-means, whose every round is
a pass over all profiles with sums in whole numbers (so that no order of rows counts),
language by language (else topics would be languages again, whose targets
contradict those of the languages); 0 is a language's largest group.  Only where the
rounds begin is a choice: the least alike of a language's ``STARTS`` documents of smallest hash.
Languages with less than ``LEAST_ROWS`` documents, and any beyond the ``MODELS`` largest, share one model.
Every document has the topic of the nearest centre (the smallest of equals, -1
without such words).  Tokens are words between white space.

Targets that cannot be met (a source has fewer tokens than it should give, or
targets contradict each other) are met as far as possible: ``residual``, the largest relative
gap between expected tokens and target over all values, comes with every row.

Defined cases: null sources and languages are values of their own; a text that
is null or empty has no tokens and the topic -1; where a whole cell has no
tokens its documents have probability 1; repeated rows are drawn together; an
empty table gives an empty sample; a target's values that do not occur are
ignored and values without a target get none; columns of the input that are
called n_tokens, topic, probability or residual are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import _text as X
from barloom.llm._spark import Scratch, wide_rows

TOPICS = 8
#: Hashed columns of a document's word counts.
TOPIC_WIDTH = 512
STARTS = 128
LEAST_ROWS = 40
MODELS = 64
#: Rounds end where the sum of similarities grows by less than this share.
_GAIN = 1e-4
_UNITS = 1 << 30
_REST = "\0rest"
CELLS = 200_000
#: Cells up to this number have their probabilities broadcast (a few MB); more are joined.
MOST_BROADCAST = 50_000
KEEP = 0.8
#: Targets not given: shares of tokens to this power, so that small parts gain, though no part gives more than it has.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.7}
DIMS = ("source", "lang", "topic")
_NONE = "\0null"
_MOST = 1e6


_FEATURES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("topic", T.IntegerType())])


def _label(name: str):
    return F.coalesce(F.col(name).cast("string"), F.lit(_NONE))


def _profiles(w: X.Words) -> np.ndarray:
    """The counts of each document's long words by hashed column."""
    n = len(w.counts)
    doc = np.repeat(np.arange(n), w.counts)
    long = (w.ends - w.starts) >= 6
    at = doc[long] * TOPIC_WIDTH + (w.hashes[long] % np.uint64(TOPIC_WIDTH)).astype(np.int64)
    return np.bincount(at, minlength=n * TOPIC_WIDTH).reshape(n, TOPIC_WIDTH)


def _unit(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.zeros(counts.shape)
    at = np.nonzero(counts)
    x[at] = np.log1p(counts[at]) * weight[at[1]]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the smallest of equals) and its similarity, in steps that no order of summing reaches."""
    like = np.round(x @ centres.T, 9)
    at = like.argmax(axis=1)
    return at, like[np.arange(len(x)), at]


def _starts(x: np.ndarray, k: int) -> np.ndarray:
    """Some rows of `x`: each is the one that the starts before resemble least."""
    centres = np.zeros((k, TOPIC_WIDTH))
    best, at = np.full(len(x), -1.0), 0
    for j in range(k):
        centres[j] = x[at]
        best = np.maximum(best, np.round(x @ centres[j], 9))
        at = int(best.argmin())
    return centres


class Topics:
    """Weights and centres of each language that has a model, and of all others together; of a bounded size."""

    def __init__(self, models: dict[str, tuple[np.ndarray, np.ndarray]], rest: tuple[np.ndarray, np.ndarray]) -> None:
        self.models, self.rest = models, rest

    def of(self, counts: np.ndarray, langs: list[str]) -> np.ndarray:
        out = np.full(len(counts), -1, dtype=np.int32)
        names = np.array(langs, dtype=object)
        for v in set(langs):
            own = np.flatnonzero((names == v) & counts.any(axis=1))
            weight, centres = self.models.get(v, self.rest)
            out[own] = _nearest(_unit(counts[own], weight), centres)[0]
        return out


def _sparse(counts: np.ndarray) -> list[pa.Array]:
    """The columns and the counts of each row that are not 0."""
    row, at = np.nonzero(counts)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))])

    def packed(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])

    return [packed(at.astype("<u2")), packed(counts[row, at].astype("<i4"))]


class Profiles:
    """Word counts of some documents by hashed column, as those that are not 0: the row, the column and the count of each."""

    def __init__(self, at: pa.Array, n: pa.Array) -> None:
        columns, ends = X.unpack(at, "<u2")
        self.rows, self.row = len(ends) - 1, np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        self.at, self.n = columns.astype(np.int64), X.unpack(n, "<i4")[0]

    def unit(self, weight: np.ndarray) -> np.ndarray:
        """The values of each row in proportion, the sum of their squares 1."""
        x = np.log1p(self.n) * weight[self.at]
        return x / np.maximum(np.sqrt(np.bincount(self.row, weights=x * x, minlength=self.rows)), 1e-12)[self.row]

    def dense(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, TOPIC_WIDTH))
        out[self.row, self.at] = x
        return out


def _summed(known: DataFrame, k: int, tally) -> dict[str, np.ndarray]:
    """For each model the sums over all its documents of what `tally` gives for some of them: `k` rows of TOPIC_WIDTH + 2 whole numbers."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            for c, v in enumerate(names.dictionary.to_pylist()):
                own = pa.array(np.flatnonzero(code == c))
                sums.setdefault(v, np.zeros((k, TOPIC_WIDTH + 2), dtype=np.int64))
                sums[v] += tally(v, Profiles(batch.column(1).take(own), batch.column(2).take(own)))
        for v, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total.ravel()[at])], ["model", "place", "value"])

    parts = known.select("model", "at", "n").mapInArrow(run, "model string, place int, value long")
    found = parts.groupBy("model", "place").agg(F.sum("value").alias("value")).toArrow()  # k * (TOPIC_WIDTH + 2) rows a model at most
    out: dict[str, np.ndarray] = {}
    for v, place, value in zip(*(found[c].to_pylist() for c in ("model", "place", "value"))):
        out.setdefault(v, np.zeros((k, TOPIC_WIDTH + 2), dtype=np.int64)).ravel()[place] = value
    return out


def learn_topics(docs: DataFrame, k: int = TOPICS, rounds: int = 25) -> Topics:
    """Topics of all of `docs`; the driver holds sums of a bounded number of models."""
    spark = docs.sparkSession

    def count(batches):
        for batch in batches:
            for i, j, w in X.text_words(batch.column(2), X.NON_SPACE):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(2)), *_sparse(_profiles(w))], ["order", "lang", "at", "n"])

    def seen(_, profiles):
        out = np.zeros((1, TOPIC_WIDTH + 2), dtype=np.int64)
        out[0, :TOPIC_WIDTH], out[0, TOPIC_WIDTH] = np.bincount(profiles.at, minlength=TOPIC_WIDTH), profiles.rows
        return out

    rows = docs.select(F.xxhash64("doc_id", F.lit(7)).alias("order"), _label("lang").alias("lang"), F.col("text").cast("string").alias("text"))
    with Scratch(spark) as scratch:
        known = scratch.table(rows.mapInArrow(count, "order long, lang string, at binary, n binary").where("length(at) > 0"), "profiles")
        own = [r.lang for r in known.groupBy("lang").count().where(F.col("count") >= LEAST_ROWS).orderBy(F.desc("count"), "lang").limit(MODELS).collect()]
        known = known.withColumn("model", F.when(F.col("lang").isin(own), F.col("lang")).otherwise(_REST))
        weight = {v: np.log((t[0, TOPIC_WIDTH] + 1.0) / (t[0, :TOPIC_WIDTH] + 1.0)) + 0.1 for v, t in _summed(known, 1, seen).items()}
        first = W.partitionBy("model").orderBy("order", "at", "n")
        begin = known.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= STARTS).select("model", "_i", "at", "n").orderBy("model", "_i").collect()
        centres = {}
        for v in weight:
            starts = Profiles(*(pa.array([r[c] for r in begin if r.model == v], pa.binary()) for c in ("at", "n")))
            centres[v] = _starts(starts.dense(starts.unit(weight[v])), k)
        last = -1
        for step in range(rounds):
            held = spark.sparkContext.broadcast((weight, centres))

            def tally(v, profiles, held=held):
                weights, now = held.value
                x = profiles.unit(weights[v])
                at, like = _nearest(profiles.dense(x), now[v])
                out = np.zeros((k, TOPIC_WIDTH + 2), dtype=np.int64)
                # whole numbers of some thousand rows: exact as doubles, too
                out[:, :TOPIC_WIDTH] = np.bincount(at[profiles.row] * TOPIC_WIDTH + profiles.at, weights=np.rint(x * _UNITS), minlength=k * TOPIC_WIDTH).reshape(k, TOPIC_WIDTH)
                out[:, TOPIC_WIDTH] = np.bincount(at, minlength=k)
                out[:, TOPIC_WIDTH + 1] = np.bincount(at, weights=np.rint(like * _UNITS), minlength=k)
                return out

            sums = _summed(known, k, tally)
            held.unpersist()
            like = sum(int(t[:, TOPIC_WIDTH + 1].sum()) for t in sums.values())
            if step == rounds - 1 or like - last <= _GAIN * like:
                break
            last = like
            for v, t in sums.items():
                size = np.linalg.norm(t[:, :TOPIC_WIDTH].astype(float), axis=1, keepdims=True)
                centres[v] = np.where(size > 0, t[:, :TOPIC_WIDTH] / np.maximum(size, 1e-12), centres[v])
        # the largest group of a language first
        models = {v: (weight[v], centres[v][np.argsort(-sums[v][:, TOPIC_WIDTH], kind="stable")]) for v in weight}
    rest = models.pop(_REST, None) or (models[own[0]] if own else (np.zeros(TOPIC_WIDTH), np.zeros((k, TOPIC_WIDTH))))
    return Topics(models, rest)


def text_features(topics: Topics):
    """A function of the text and its language: n_tokens and topic."""
    held = SparkSession.active().sparkContext.broadcast(topics)

    def run(text: pa.Array, lang: pa.Array) -> pa.Array:
        names = lang.to_pylist()
        tokens, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)]
        for i, j, w in X.text_words(text, X.NON_SPACE):
            tokens.append(w.counts.astype(np.int64))
            found.append(held.value.of(_profiles(w), names[i:j]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(found))], ["n_tokens", "topic"])

    run.__annotations__ = {"text": pa.Array, "lang": pa.Array, "return": pa.Array}
    # not to be pushed down or split up: a second evaluation costs a second Python worker for each task
    return F.arrow_udf(run, _FEATURES).asNondeterministic()


def featured(docs: DataFrame, topics: Topics | None = None) -> DataFrame:
    """Every row of `docs` as one struct `row`, with n_tokens and its cell; topics not given are learned from `docs`."""
    features = text_features(topics or learn_topics(docs))
    rows = docs.select(F.struct("*").alias("row"), *(_label(c).alias(f"_{c}") for c in ("source", "lang")), features(F.col("text").cast("string"), _label("lang")).alias("f"))
    return rows.select("row", F.col("f.n_tokens").alias("_tokens"), "_source", "_lang", F.col("f.topic").cast("string").alias("_topic"))


def _scale(margin: DataFrame, goal: float) -> float:
    """What the shares are multiplied by for sums of `goal` where no value gives more than it has."""
    scale = 0.0
    for _ in range(50):
        full = F.col("share") * scale >= F.col("n")
        got = margin.agg(F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0)).alias("open")).first()
        new = (goal - got["full"]) / got["open"] if got["open"] else scale
        if abs(new - scale) <= 1e-12 * max(1.0, scale):
            break
        scale = new
    return scale


def token_targets(cells: DataFrame, targets: dict | None, keep: float) -> dict[str, DataFrame]:
    """For each dimension its values and the tokens the sample should have of each."""
    total = cells.agg(F.sum("n")).first()[0] or 0
    out: dict[str, DataFrame] = {}
    for dim in DIMS:
        margin = cells.groupBy(f"_{dim}").agg(F.sum("n").alias("n"))
        given = (targets or {}).get(dim)
        if given is None:
            margin = margin.withColumn("share", F.pow(F.col("n"), F.lit(TEMPER[dim])))
            out[dim] = margin.select(f"_{dim}", F.least(F.col("n"), F.col("share") * _scale(margin, keep * total)).alias("target"))
            continue
        spark = cells.sparkSession
        table = spark.createDataFrame([(_NONE if k is None else str(k), float(v)) for k, v in given.items()], f"_{dim} string, share double")
        margin = margin.join(table, f"_{dim}", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        sums = margin.agg(F.sum("share")).first()[0] or 1.0
        out[dim] = margin.select(f"_{dim}", (F.col("share") / sums * keep * total).alias("target"))
    return out


def _rake(cells: list[dict], targets: dict[str, dict[str, float]], rounds: int, tolerance: float) -> dict[str, dict[str, float]]:
    """The factors, from a table of cells that fits the driver."""
    names = {d: sorted({c[f"_{d}"] for c in cells}) for d in DIMS}
    place = {d: {v: k for k, v in enumerate(names[d])} for d in DIMS}
    at = {d: np.array([place[d][c[f"_{d}"]] for c in cells], dtype=np.int64) for d in DIMS}
    n = np.array([float(c["n"]) for c in cells])
    goal = {d: np.array([targets[d].get(v, 0.0) for v in names[d]]) for d in DIMS}
    factor = {d: np.ones(len(names[d])) for d in DIMS}
    for _ in range(rounds):
        worst = 0.0
        for d in DIMS:
            p = np.minimum(1.0, np.prod([factor[e][at[e]] for e in DIMS], axis=0))
            now = np.bincount(at[d], weights=n * p, minlength=len(names[d]))
            step = np.where(now > 0, goal[d] / np.where(now > 0, now, 1), 1.0)
            worst = max(worst, float(np.abs(step - 1).max(initial=0)))
            factor[d] = np.minimum(factor[d] * step, _MOST)
        if worst < tolerance:
            break
    return {d: dict(zip(names[d], factor[d].tolist())) for d in DIMS}


def _rake_distributed(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float, scratch: Scratch) -> DataFrame:
    """The same steps where the cells are too many for the driver."""
    for d in DIMS:
        cells = cells.withColumn(f"f_{d}", F.lit(1.0))
    p = F.least(F.lit(1.0), F.col("f_source") * F.col("f_lang") * F.col("f_topic"))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMS:
            now = cells.groupBy(f"_{d}").agg(F.sum(F.col("n") * p).alias("now")).join(targets[d], f"_{d}")
            step = scratch.table(now.select(f"_{d}", F.when(F.col("now") > 0, F.col("target") / F.nullif("now", F.lit(0.0))).otherwise(1.0).alias("step")), "step")
            worst = max(worst, step.agg(F.max(F.abs(F.col("step") - 1))).first()[0] or 0.0)
            cells = scratch.table(cells.join(step, f"_{d}").withColumn(f"f_{d}", F.least(F.col(f"f_{d}") * F.col("step"), F.lit(_MOST))).drop("step"), "cells")
        if worst < tolerance:
            break
    return cells.select("_source", "_lang", "_topic", p.alias("probability"))


def probabilities(
    spark: SparkSession,
    rows: DataFrame,
    scratch: Scratch,
    targets: dict[str, dict] | None = None,
    keep: float = KEEP,
    rounds: int = 60,
    tolerance: float = 1e-6,
    most_cells: int = CELLS,
) -> DataFrame:
    """_source, _lang, _topic, probability of every cell of `rows` (featured), and the largest relative gap to a target."""
    cells = scratch.table(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("n")), "cells")
    goals = token_targets(cells, targets, keep)
    n_cells = cells.count()
    if n_cells > most_cells:
        out = _rake_distributed(cells, goals, rounds, tolerance, scratch)
    else:
        goal = {d: {r[0]: r[1] for r in goals[d].collect()} for d in DIMS}  # no more rows than cells
        table = [r.asDict() for r in cells.collect()]
        factors = _rake(table, goal, rounds, tolerance)
        found = [(c["_source"], c["_lang"], c["_topic"], float(min(1.0, np.prod([factors[d][c[f"_{d}"]] for d in DIMS])))) for c in table]
        out = spark.createDataFrame(found, "_source string, _lang string, _topic string, probability double")
    out = out.join(cells, ["_source", "_lang", "_topic"]).select("_source", "_lang", "_topic", F.when(F.col("n") == 0, 1.0).otherwise(F.col("probability")).alias("probability"), "n")
    out = scratch.table(out, "probabilities")
    gaps = [
        out.groupBy(f"_{d}").agg(F.sum(F.col("n") * F.col("probability")).alias("now")).join(goals[d].where("target > 0"), f"_{d}").agg(F.max(F.abs(F.col("now") / F.col("target") - 1))).first()[0]
        for d in DIMS
    ]
    out = scratch.finish(out.drop("n").withColumn("residual", F.lit(float(max(g or 0.0 for g in gaps)))))
    return F.broadcast(out) if n_cells <= MOST_BROADCAST else out


def sample(spark: SparkSession, docs: DataFrame, targets: dict[str, dict] | None = None, keep: float = KEEP, seed: int = 0, **options) -> DataFrame:
    """The drawn rows of `docs` with n_tokens, topic, their probability and the residual.

    `targets` maps source, lang and topic to shares of tokens by value;
    `keep` is the share of all tokens that the sample is to have.
    """
    wide_rows(spark)
    rows = featured(docs)
    with Scratch(spark) as scratch:
        table = probabilities(spark, rows.select("_tokens", "_source", "_lang", "_topic"), scratch, targets, keep, **options)
    draw = F.shiftrightunsigned(F.xxhash64("row.doc_id", "row.text", F.lit(seed)), 11) / F.lit(float(1 << 53))
    taken = rows.join(table, ["_source", "_lang", "_topic"]).where(draw < F.col("probability"))
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_tokens", "topic", "probability", "residual")]
    return taken.select(*own, F.col("_tokens").alias("n_tokens"), F.col("_topic").cast("int").alias("topic"), "probability", "residual")
