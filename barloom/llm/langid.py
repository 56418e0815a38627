"""Language ID: script ranges, per-word scores and a Viterbi path.

A word's script (the range its first character is in) narrows the languages to
those that use the script; the rest are scored by hashed trigrams of the
word's bytes.  A Viterbi path over the words of a text, on which every change
of language costs ``SWITCH``, labels spans of mixed-language text; the
language with most bytes in its spans is the text's, and the share of these
bytes is the score.

The trigram counts are learned from a sample of labelled rows: of each
language about ``rows_per_language`` documents, chosen by a hash of their ids.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
ties go to the language whose name sorts first; equal rows get equal results;
a null id falls in the held-out fold; without labelled rows every text is
``und``; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import wide_rows

ROWS_PER_LANGUAGE = 4000
BUCKETS = 1 << 15
SWITCH = 10.0
UNKNOWN = "und"
#: Languages up to this number have their sampling rates broadcast; more are joined.
MOST_BROADCAST = 10_000

#: First code points of ranges of scripts, and the script of each range; 0 is none.
SCRIPT_STARTS = np.array([0x00, 0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xA00, 0xB80, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00])
SCRIPT_OF = np.array([0, 1, 0, 1, 0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11, 0, 12, 13, 0, 1, 2, 0, 14, 0, 15, 0, 13, 0, 15, 0])
SCRIPTS = int(SCRIPT_OF.max()) + 1

_WORD = X.byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[~_WORD] = 32


def _trigrams(words: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigram around each byte of each word, and where each word's begin."""
    d = _FOLD[words.data]
    before, after = np.empty_like(d), np.empty_like(d)
    before[1:], after[:-1] = d[:-1], d[1:]
    before[words.starts] = 32
    after[words.ends - 1] = 32
    length = words.ends - words.starts
    first = np.cumsum(length) - length
    at = np.repeat(words.starts - first, length) + np.arange(int(length.sum()))
    h = (before[at] * np.uint32(0x9E3779B1)) ^ (d[at] * np.uint32(0x85EBCA77)) ^ (after[at] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64), first


def _scripts(words: X.Words) -> np.ndarray:
    """The script of the first character of each word."""
    d = words.data
    n = len(d)
    s = words.starts
    b = [d[np.minimum(s + k, n - 1)].astype(np.int64) for k in range(4)]
    cp = np.where(
        b[0] < 0x80,
        b[0],
        np.where(
            b[0] < 0xE0,
            (b[0] & 0x1F) << 6 | b[1] & 0x3F,
            np.where(b[0] < 0xF0, (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F, (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F),
        ),
    )
    return SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, cp, side="right") - 1]


class Model:
    """Log probabilities of trigrams (bucket by language) and the scripts that each language uses."""

    def __init__(self, languages: list[str], trigrams: np.ndarray, scripts: np.ndarray) -> None:
        """Counts: trigrams (language, bucket), words by script (language, script)."""
        self.languages = languages
        logs = np.log((trigrams + 0.5) / (trigrams.sum(axis=1, keepdims=True) + 0.5 * BUCKETS))
        self.table = np.ascontiguousarray(logs.T, dtype=np.float32)
        used = scripts >= np.maximum(1, 0.005 * scripts.sum(axis=1, keepdims=True))
        self.barred = np.where(used.T | ~used.any(axis=0)[:, None], 0.0, -50.0).astype(np.float32)
        self.barred[0] = 0

    def word_scores(self, words: X.Words) -> np.ndarray:
        index, first = _trigrams(words)
        if not len(first) or not self.languages:
            return np.zeros((0, len(self.languages)), dtype=np.float32)
        out = np.add.reduceat(self.table[index], first, axis=0)
        out -= out.max(axis=1, keepdims=True)
        return out + self.barred[_scripts(words)]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH, cells: int = 1 << 21) -> np.ndarray:
    """The best label of each word; words first[d]:first[d + 1] are document d's.

    Documents are worked off in groups of like length, a word position at a time.
    """
    out = np.zeros(len(scores), dtype=np.int16)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    n_labels = scores.shape[1]
    at = 0
    while at < len(order):
        longest = int(length[order[at]])
        take = max(1, min(512, cells // (longest * n_labels)))
        group = order[at : at + take]
        at += take
        rows, width = len(group), length[group]
        best_of = np.empty((longest, rows), dtype=np.int16)
        stays = np.empty((longest, rows, n_labels), dtype=bool)
        start = first[group]
        value = scores[start].astype(np.float64)
        live = rows
        for t in range(1, longest):
            while width[live - 1] <= t:  # the group is sorted, longest first
                live -= 1
            v = value[:live]
            arg = v.argmax(axis=1)
            switch = v[np.arange(live), arg][:, None] - penalty
            stay = v >= switch
            best_of[t, :live], stays[t, :live] = arg, stay
            value[:live] = np.where(stay, v, switch) + scores[start[:live] + t]
        label = value.argmax(axis=1)
        row = np.arange(rows)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-width, -t, side="left"))  # rows longer than t
            out[start[:live] + t] = label[:live]
            if t:
                r = row[:live]
                label[:live] = np.where(stays[t, r, label[:live]], label[:live], best_of[t, :live])
    return out


def label_batch(model: Model, column, limit: int = 3 << 20):
    """For groups of rows of a string column: (first row, end row, chunk words, labels per word, bytes by row and language, has a letter)."""
    n = max(1, len(model.languages))
    pending: list[tuple[int, int, X.Words, np.ndarray]] = []
    held = 0
    for i, j, words in X.text_words(column, _WORD):
        pending.append((i, j, words, model.word_scores(words)))
        held += len(words.starts) * n + len(words.data)
        if held > limit:
            yield from _label(model, pending)
            pending, held = [], 0
    if pending:
        yield from _label(model, pending)


def _label(model: Model, pending):
    n = max(1, len(model.languages))
    scores = np.concatenate([p[3] for p in pending])
    shift = np.cumsum([0, *(len(p[3]) for p in pending)])
    first = np.concatenate([p[2].first[:-1] + s for p, s in zip(pending, shift)] + [shift[-1:]])
    labels = viterbi(scores, first) if model.languages else np.zeros(len(scores), dtype=np.int16)
    for (i, j, words, _), a, b in zip(pending, shift[:-1], shift[1:]):
        own = labels[a:b]
        doc = np.repeat(np.arange(j - i), words.counts)
        size = words.ends - words.starts
        weight = np.bincount(doc * n + own, weights=size, minlength=(j - i) * n).reshape(j - i, n)
        ascii_letter = np.zeros(j - i, dtype=bool)
        np.logical_or.at(ascii_letter, doc, words.data[words.starts] < 0x80)
        letter = ascii_letter
        for d in np.flatnonzero(~ascii_letter & (words.counts > 0)).tolist():
            letter[d] = any(c.isalpha() for c in words.data[words.offsets[d] : words.offsets[d + 1]].tobytes().decode("utf-8", "replace"))
        yield i, j, words, own, weight, letter


def fold(modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus


def fit(spark: SparkSession, docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows with `lang` and `text`; the sample holds about `rows_per_language` of each language."""
    wide_rows(spark)
    marked = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = marked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select("lang", F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("n")).alias("rate"))
    # one row for each language: sent along only once their number is known to be small
    rates = F.broadcast(rates) if rates.count() <= MOST_BROADCAST else rates
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = marked.join(rates, "lang").where(draw < F.col("rate")).select("lang", "text")

    def count(batches):
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for i, j, words in X.text_words(batch.column(1), _WORD):
                index, first = _trigrams(words)
                scripts = _scripts(words)
                names, of = np.unique(lang[i:j].astype(str), return_inverse=True)
                word_lang = np.repeat(of, words.counts)
                byte_lang = np.repeat(word_lang, words.ends - words.starts)
                grams = np.bincount(byte_lang * BUCKETS + index, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                used = np.bincount(word_lang * SCRIPTS + scripts, minlength=len(names) * SCRIPTS).reshape(len(names), SCRIPTS)
                for name, g, s in zip(names.tolist(), grams, used):
                    k = np.flatnonzero(g)
                    m = np.flatnonzero(s)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (len(k) + len(m)), pa.string()), pa.array(np.concatenate([k, BUCKETS + m]).astype(np.int32)), pa.array(np.concatenate([g[k], s[m]]).astype(np.int64))],
                        ["lang", "slot", "n"],
                    )

    rows = sample.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    at = {name: k for k, name in enumerate(languages)}
    table = np.zeros((len(languages), BUCKETS + SCRIPTS))
    if languages:
        table[[at[x] for x in rows["lang"].to_pylist()], rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, table[:, :BUCKETS], table[:, BUCKETS:])


def predict(spark: SparkSession, docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` of every row of `docs`, and lang_pred and score from its text alone."""
    held = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", lang_pred string, score double"

    def run(batches):
        own = held.value
        names = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for i, j, words, _, weight, letter in label_batch(own, batch.column(len(columns))):
                total = weight.sum(axis=1)
                known = letter & (total > 0) & bool(own.languages)
                best = np.where(known, weight.argmax(axis=1), len(own.languages))
                share = np.where(known, weight.max(axis=1) / np.maximum(total, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(columns))), pa.array(names[best], pa.string()), pa.array(share)], [*columns, "lang_pred", "score"])

    return docs.select(*columns, "text").mapInArrow(run, schema)


def language_spans(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, begin, end (byte offsets in the text), lang: maximal runs of words of one language, in order."""
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        for batch in batches:
            for i, _, words, labels, _, _ in label_batch(own, batch.column(1)):
                if not len(labels) or not own.languages:
                    continue
                doc = np.repeat(np.arange(len(words.counts)), words.counts)
                new = np.ones(len(labels), dtype=bool)
                new[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                last = np.append(start[1:], len(labels)) - 1
                base = words.offsets[doc[start]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[start] + i)), pa.array(words.starts[start] - base), pa.array(words.ends[last] - base), pa.array(np.array(own.languages, dtype=object)[labels[start]], pa.string())],
                    ["doc_id", "begin", "end", "lang"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, begin long, end long, lang string")


def typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def languages(spark: SparkSession, docs: DataFrame, modulus: int = 5, held: int = 0, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs`, learned outside the held-out fold."""
    docs = typed(docs).withColumn("held_out", fold(modulus) == held)
    model = fit(spark, docs.where(~F.col("held_out")), **options)
    return predict(spark, docs, model, ["doc_id", "held_out"])


def keep_known(spark: SparkSession, docs: DataFrame, least: float = 0.4, modulus: int = 5, held: int = 0, **options) -> DataFrame:
    """The rows of `docs` whose language is told with a share of at least `least`; all columns as they were."""
    model = fit(spark, typed(docs).withColumn("held_out", fold(modulus) == held).where(~F.col("held_out")), **options)
    held_model = spark.sparkContext.broadcast(model)

    def sure(batches):
        for batch in batches:
            keep = []
            for i, _, _, _, weight, letter in label_batch(held_model.value, batch.column(batch.schema.get_field_index("text")).cast(pa.string())):
                total = weight.sum(axis=1)
                keep += (np.flatnonzero(letter & (total > 0) & (weight.max(axis=1) >= least * total)) + i).tolist()
            if keep:
                yield batch.take(pa.array(keep, pa.int64()))

    return docs.mapInArrow(sure, docs.schema)
