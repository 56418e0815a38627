"""LM scoring by a hashed maximum-entropy model.

Words are factored into nested classes: a word's last two bytes give the first
digit of its class, two hashes of the whole word the others.  The probability
of a token is the product of its digits' probabilities, each given the context
and the digits before, and of the token's share in its class of ``LEAVES``.
Every digit comes from a softmax over hashed features, taken together with the
digits before: the word before, the word before that (a skip feature), and
both (an n-gram feature).  So context decides between words, not between kinds
of words alone.  The share in the class is the smoothed count, the
maximum-entropy solution with one weight for each word; counts of all words of
the whole corpus take part.

Training is one pass of distributed gradient updates over all training texts.
The texts are dealt by hash to parts whose number follows the number of tokens
alone (its root, then, from ``MOST_PART_TOKENS`` in each on, the number itself,
so that more data are more tasks and not longer ones) and are taken in the order of their hashes, so that scores depend neither
on the cluster nor on the files' layout.  Every part takes mini-batch steps from
the common start and the results are averaged row by row, weighted by the
squared gradients that a row has seen, so that parts which never met a feature
don't count for it.  The tables of weights grow with the number of different
words, up to ``MOST_BUCKETS`` rows for each kind of feature, since every task
holds them.  Word counts grow with the corpus and stay distributed: the ``HEAD``
commonest are broadcast (a bound in rows), the rest are joined.

Defined cases: a null or empty text has its end as its only token; equal rows
are scored alike, each once; a null id counts as the empty text in the fold;
an empty training fold gives N = V = 0 and a uniform model; other columns are
ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import Scratch, partitions

#: Digits of a word's class, and what each is out of.
LEVELS = 3
CLASSES = 16
LEAVES = CLASSES**LEVELS
KINDS = 3
#: Rows of weights for each digit and kind of feature: one for so many different words, within these bounds.
WORDS_PER_BUCKET = 8
FEWEST_BUCKETS, MOST_BUCKETS = 1 << 10, 1 << 15
HEAD = 200_000
SMOOTH = 0.1
BATCH = 1 << 15
RATE = 0.5
#: Logits stay within this, in training and in scoring.
LIMIT = np.float32(40)
#: Training parts, each a task and a partial model, grow with the root of the number of tokens: one for so many, two for four times as many;
PART_TOKENS = 1 << 19
#: but no part has more than about so many tokens (some 50 MB of text), so in large corpora parts grow with the tokens.
MOST_PART_TOKENS = 1 << 23
#: Rows of weights that travel together.
SHARD = 1024

_U = np.uint64
END = _U(0x1F83D9ABFB41BD6B)
_LN10 = math.log(10)


class Tokens:
    """The tokens of a chunk: words and, after each document's, its end."""

    def __init__(self, words: X.Words) -> None:
        n_docs, n_words = len(words.counts), len(words.starts)
        doc = np.repeat(np.arange(n_docs), words.counts)
        self.per_doc = words.counts + 1
        self.first = np.cumsum(self.per_doc) - self.per_doc
        at = np.arange(n_words) + doc
        size = n_words + n_docs
        self.doc = np.repeat(np.arange(n_docs), self.per_doc)
        self.hash = np.full(size, END, dtype=np.uint64)
        self.hash[at] = words.hashes
        d = words.data
        tail = np.zeros(size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            tail[at] = X.VALUES[d[words.ends - 1]] * _U(3) + X.VALUES[d[np.maximum(words.ends - 2, words.starts)]] if n_words else 0
            keys = [tail] + [self.hash * _U(0x9E3779B97F4A7C15) + _U(level) for level in range(1, LEVELS)]
            self.digits = [(X.mix(k) % _U(CLASSES)).astype(np.int64) for k in keys]
        # the digits before each, as one number; the last is the class
        self.before = [np.zeros(size, dtype=np.int64)]
        for digit in self.digits:
            self.before.append(self.before[-1] * CLASSES + digit)
        self.leaf = self.before.pop()

    def features(self) -> list[np.ndarray]:
        """Hashes of each token's features: word before, skip, both; the start of a text counts as its own word."""
        size = len(self.hash)
        one, two = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
        one[1:], two[2:] = self.hash[:-1], self.hash[:-2]
        one[self.first] = 1
        two[self.first] = 2
        second = self.first[self.per_doc > 1] + 1
        two[second] = 1
        with np.errstate(over="ignore"):
            both = X.mix(one * _U(0x9E3779B97F4A7C15) + two)
        return [X.mix(one), X.mix(two ^ _U(0xA0761D6478BD642F)), both]

    def rows(self, features: list[np.ndarray], level: int, buckets: int) -> list[np.ndarray]:
        """Rows of the tables of weights of one digit; 16 bits, which numpy sorts by radix."""
        shift = _U(64 - int(buckets).bit_length() + 1)
        with np.errstate(over="ignore"):
            own = X.mix(self.before[level].astype(np.uint64) + _U(LEAVES * level))
            return [((f ^ own) * _U(0xD6E8FEB86659FD93) >> shift).astype(np.uint16) for f in features]


def logits(bias: np.ndarray, weights: np.ndarray, before: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Of one digit of each token; bias: a row for each value of the digits before, weights: a table for each kind."""
    z = np.take(bias, before, axis=0)
    for w, r in zip(weights, rows):
        z += np.take(w, r, axis=0)
    return np.clip(z, -LIMIT, LIMIT, out=z)


def steps(bias: np.ndarray, weights: np.ndarray, squares: np.ndarray, before: np.ndarray, rows: list[np.ndarray], digit: np.ndarray) -> None:
    """Mini-batch gradient steps (adaptive rates) on the `weights` of one digit, in place."""
    for a in range(0, len(digit), BATCH):
        part = slice(a, a + BATCH)
        own, y = [r[part] for r in rows], digit[part]
        g = np.exp(logits(bias, weights, before[part], own))
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        for w, s, r in zip(weights, squares, own):
            order = np.argsort(r, kind="stable")
            r = r[order]
            start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            total = np.add.reduceat(np.take(g, order, axis=0), start, axis=0)
            at = r[start]
            seen = np.take(s, at, axis=0) + total * total
            s[at] = seen
            w[at] -= RATE * total / np.sqrt(seen + 1)


def learn(bias: list[np.ndarray], weights: np.ndarray, squares: np.ndarray, tokens: Tokens) -> None:
    """Gradient steps on all digits of some texts' tokens, in place."""
    features = tokens.features()
    for level in range(LEVELS):
        steps(bias[level], weights[level], squares[level], tokens.before[level], tokens.rows(features, level, weights.shape[2]), tokens.digits[level])


def log_digits(model: Model, tokens: Tokens) -> np.ndarray:
    """The natural logarithm of the probability of each token's class given its context."""
    out = np.zeros(len(tokens.hash))
    features = tokens.features()
    for level in range(LEVELS):
        rows, before, digit = tokens.rows(features, level, model.buckets), tokens.before[level], tokens.digits[level]
        for a in range(0, len(out), BATCH):
            part = slice(a, a + BATCH)
            z = logits(model.bias[level], model.weights[level], before[part], [r[part] for r in rows])
            out[part] += z[np.arange(len(z)), digit[part]] - np.log(np.exp(z).sum(axis=1))
    return out


def _count(batches):
    for batch in batches:
        words, kinds = [], []
        for _, _, w in X.text_words(batch.column(0), X.NON_SPACE):
            t = Tokens(w)
            h, first, n = np.unique(t.hash, return_index=True, return_counts=True)
            words.append(h)
            kinds.append(np.stack([t.leaf[first], n], axis=1))
        if not words:
            continue
        h, r = np.concatenate(words), np.concatenate(kinds)
        order = np.argsort(h, kind="stable")
        h, r = h[order], r[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(r[start, 0].astype(np.int32)), pa.array(np.add.reduceat(r[:, 1], start))], ["word", "class", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), class, n of every token of the texts; partial sums come before the shuffle."""
    return docs.select("text").mapInArrow(_count, "word long, class int, n long").groupBy("word").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


class Model:
    """The softmaxes, of a bounded size, and the totals of each class."""

    def __init__(self, n: int, v: int, class_n: np.ndarray, class_v: np.ndarray) -> None:
        self.n, self.v = n, v
        self.buckets = FEWEST_BUCKETS
        while self.buckets < MOST_BUCKETS and self.buckets * WORDS_PER_BUCKET < v:
            self.buckets *= 2
        self.weights = self.zeros()
        self.bias = []
        for level in range(LEVELS):
            digits = class_n.reshape(CLASSES**level, CLASSES, -1).sum(axis=2)
            self.bias.append(np.log((digits + 1) / (digits.sum(axis=1, keepdims=True) + CLASSES)).astype(np.float32))
        self.log_total = np.log10(class_n + SMOOTH * (class_v + 1))

    def zeros(self) -> np.ndarray:
        return np.zeros((LEVELS, KINDS, self.buckets, CLASSES), dtype=np.float32)


def train(spark: SparkSession, docs: DataFrame, counts: DataFrame) -> Model:
    """One pass of gradient updates over all texts of `docs`; counts: their words."""
    totals = counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # LEAVES rows at most
    class_n, class_v = np.zeros(LEAVES), np.zeros(LEAVES)
    for r in totals:
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    model = Model(int(class_n.sum()), int(class_v.sum()), class_n, class_v)
    bias, shape = model.bias, model.weights.shape
    # neither the number of partial models nor what each is made from follows the cluster
    n_parts = max(1, math.ceil(math.sqrt(model.n / PART_TOKENS)), math.ceil(model.n / MOST_PART_TOKENS))
    salts = math.isqrt(n_parts)

    def run(batches):
        weights, squares = np.zeros(shape, dtype=np.float32), np.zeros(shape, dtype=np.float32)
        for batch in batches:
            for _, _, w in X.text_words(batch.column(0), X.NON_SPACE):
                learn(bias, weights, squares, Tokens(w))
        if not squares.any():
            return
        task = TaskContext.get()
        rows = np.concatenate([weights, squares.sum(axis=-1, keepdims=True)], axis=-1)
        yield from _partial((task.partitionId() if task else 0) % salts, enumerate(rows.reshape(-1, SHARD, CLASSES + 1)))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values, o = X.unpack(batch.column(2), np.float32)
            for k, shard in enumerate(batch.column(1).to_pylist()):
                part = values[o[k] : o[k + 1]].reshape(SHARD, CLASSES + 1).astype(np.float64)
                part[:, :-1] *= part[:, -1:]
                sums[shard] = sums[shard] + part if shard in sums else part
        for part in sums.values():
            part[:, :-1] /= np.where(part[:, -1:] > 0, part[:, -1:], 1)
        yield from _partial(0, ((k, sums[k].astype(np.float32)) for k in sorted(sums)))

    schema = "salt int, shard int, part binary"
    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("order")).withColumn("part", F.pmod("order", F.lit(n_parts)).cast("int"))
    dealt = dealt.repartitionById(n_parts, "part").sortWithinPartitions("order")  # one part to a task, whatever the shuffles' width
    parts = dealt.select("text").mapInArrow(run, schema)
    # tasks' results are added in two steps, each holding one mean for each shard
    parts = parts.repartition(partitions(spark), "shard", "salt").mapInArrow(add, schema)
    rows = parts.repartition(partitions(spark), "shard").mapInArrow(add, schema).toArrow()  # the model's own, bounded size
    flat = model.weights.reshape(-1, SHARD, CLASSES)
    for shard, part in zip(rows["shard"].to_pylist(), rows["part"].to_pylist()):
        flat[shard] = np.frombuffer(part, dtype=np.float32).reshape(SHARD, CLASSES + 1)[:, :-1]
    return model


def _partial(salt: int, parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Numbered shards of a model: rows of weights, each with what is known of it, the sum of its squared gradients."""
    parts = iter(parts)
    while some := list(islice(parts, 64)):
        columns = [pa.array([salt] * len(some), pa.int32()), pa.array([k for k, _ in some], pa.int32()), X.binary_array([p for _, p in some])]
        yield pa.RecordBatch.from_arrays(columns, ["salt", "shard", "part"])


def _score(held):
    def run(batches):
        model, words, logs = held.value
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        for batch in batches:
            for i, j, w in X.text_words(batch.column(2), X.NON_SPACE):
                t = Tokens(w)
                z = log_digits(model, t)
                at = np.searchsorted(words, t.hash)
                at[at == len(words)] = 0
                head = words[at] == t.hash if len(words) else np.zeros(len(t.hash), dtype=bool)
                got = np.where(head, logs[at], 0.0) if len(words) else np.zeros(len(t.hash))
                n = j - i
                add = lambda x: np.bincount(t.doc, weights=x, minlength=n)  # noqa: B023, E731
                rest = np.flatnonzero(~head)
                cut = np.searchsorted(t.doc[rest], np.arange(n + 1))
                tail = t.hash[rest]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)),
                        batch.column(0).slice(i, n),
                        batch.column(1).slice(i, n),
                        pa.array(t.per_doc.astype(np.int64)),
                        pa.array(add(head).astype(np.int64)),
                        pa.array(add(got)),
                        pa.array(add(z / _LN10 - model.log_total[t.leaf])),
                        X.binary_array([tail[a:b] for a, b in zip(cut[:-1], cut[1:])]),
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "head_known", "head_log", "model_log", "tail"],
                )
                uid += n

    return run


def _tails(batches):
    for batch in batches:
        words, o = X.unpack(batch.column(1), np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.diff(o))
        order = np.lexsort((words, row))
        words, row = words[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (row[1:] != row[:-1])])) if len(words) else np.empty(0, dtype=np.int64)
        columns = [batch.column(0).take(pa.array(row[start])), pa.array(words[start]), pa.array(np.diff(np.append(start, len(words))))]
        yield pa.RecordBatch.from_arrays(columns, ["uid", "word", "times"])


def scores(spark: SparkSession, docs: DataFrame, head: int = HEAD) -> DataFrame:
    """For every row of `docs` (doc_id, held_out, text): token counts, unigram base score, model score (log10).

    Learned from the rows that are not held out.  `head` is the number of
    commonest words that are broadcast; results do not depend on it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))
    with Scratch(spark) as scratch:
        training = docs.where(~F.col("held_out"))
        counts = scratch.table(word_counts(training), "counts")
        model = train(spark, training, counts)
        common = counts.orderBy(F.desc("n"), "word").limit(head).select("word", "n").toArrow()
        order = np.argsort(common["word"].to_numpy().view(np.uint64)) if len(common) else np.empty(0, dtype=np.int64)
        words = common["word"].to_numpy().view(np.uint64)[order] if len(common) else np.empty(0, dtype=np.uint64)
        logs = np.log10(common["n"].to_numpy()[order] + SMOOTH) if len(common) else np.empty(0)
        held = spark.sparkContext.broadcast((model, words, logs))
        table = docs.mapInArrow(_score(held), "uid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, model_log double, tail binary")
        table = scratch.table(table, "scores")
        tails = table.where(F.length("tail") > 0).select("uid", "tail").mapInArrow(_tails, "uid long, word long, times long")
        rest = (
            tails.join(counts.select("word", "n"), "word", "left")
            .groupBy("uid")
            .agg(F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("tail_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("tail_log"))
        )
        logs_of = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))
        out = table.drop("tail").join(rest, "uid", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(model.n).cast("long").alias("train_tokens"),
            (logs_of - F.col("n_tokens") * F.lit(math.log10(model.n + SMOOTH * (model.v + 1)))).alias("base_score"),
            (logs_of + F.col("model_log")).alias("score"),
        )
        return scratch.finish(out)


def fold(modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus


def language_model(spark: SparkSession, docs: DataFrame, modulus: int = 10, held: int = 0, **options) -> DataFrame:
    """Scores of all rows, learned from those outside the held-out fold."""
    return scores(spark, docs.withColumn("held_out", fold(modulus) == held), **options)
