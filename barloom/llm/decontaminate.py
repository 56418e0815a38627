"""Benchmark decontamination by winnowing.

Both sides are cut into k-grams of words, and of every run of ``span - k + 1``
k-grams the one with the smallest hash is kept as a fingerprint, so that any
shared span of ``span`` words has at least one fingerprint in common.  The
fingerprints are joined, and every hit is extended on both sides, word by
word, to the spans that really agree.  Items with fewer words than a span have
their whole sequence as one fingerprint of its own length.

A bit filter of bounded size over the benchmark's fingerprints keeps document
fingerprints that cannot match out of the shuffle; what passes it is joined.
Everything a hit needs travels with it (the words around it), so neither
documents nor items are gathered anywhere.

Defined cases: null and empty texts have no words, are never hit and, as
items, hit nothing; rows with equal ids are separate documents and each gets a
row; equal item ids count once, a null item id counts as the empty string;
an empty benchmark leaves every document clean; other columns are ignored.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import KEY, BitFilter, Scratch, key_columns, keyed

SPAN, GRAM = 10, 5
#: Words of context that a fingerprint carries: all spans that can have it.
_BEFORE = SPAN - GRAM
_AROUND = 2 * SPAN - GRAM


def _selected(grams: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which k-grams are the (rightmost) minimum of a span; first, last: the k-grams of their document."""
    run = SPAN - GRAM + 1
    keep = np.zeros(len(at), dtype=bool)
    before = np.zeros(len(at), dtype=np.int64)  # neighbours on either side that do not beat it
    after = np.zeros(len(at), dtype=np.int64)
    for side, count in ((-1, before), (1, after)):
        going = np.ones(len(at), dtype=bool)
        for step in range(1, run):
            other = at + side * step
            going &= (other >= first) & (other <= last)
            value = grams[np.clip(other, 0, len(grams) - 1)]
            going &= (grams[at] <= value) if side < 0 else (grams[at] < value)
            count += going
    keep |= before + after + 1 >= run
    return keep


def _around(hashes: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The words around each position; 0 outside its document."""
    where = at[:, None] + np.arange(-_BEFORE, _AROUND - _BEFORE)[None, :]
    out = hashes[np.clip(where, 0, max(len(hashes) - 1, 0))]
    out[(where < first[:, None]) | (where >= end[:, None])] = 0
    return out


def _fingerprints(words: X.Words, bits: np.ndarray | None, lengths: list[int] | None):
    """(document, records): hash, position, length, words around; `bits` None: of items, else those that may match."""
    doc_of = np.repeat(np.arange(len(words.counts)), words.counts)
    first, end = words.first[:-1][doc_of], words.first[1:][doc_of]
    docs, records = [], []

    def add(at, h, length, around):
        docs.append(doc_of[at])
        head = np.stack([h.view(np.int64), (at - first[at]).astype(np.int64), np.full(len(at), length)], axis=1)
        records.append(np.concatenate([head, around.view(np.int64)], axis=1))

    grams = X.windows(words.hashes, GRAM)
    at = np.flatnonzero(np.arange(len(grams)) + GRAM <= end[: len(grams)])
    if bits is not None:
        at = at[BitFilter.test_hashes(bits, grams[at])]
    at = at[end[at] - first[at] >= SPAN]
    at = at[_selected(grams, at, first[at], end[at] - GRAM)]
    add(at, grams[at], SPAN, _around(words.hashes, at, first[at], end[at]))
    for length in range(1, SPAN) if lengths is None else lengths:
        h = X.windows(words.hashes, length)
        at = np.flatnonzero(np.arange(len(h)) + length <= end[: len(h)])
        at = at[end[at] - first[at] == length] if bits is None else at[BitFilter.test_hashes(bits, h[at])]
        add(at, h[at], length, np.zeros((len(at), _AROUND), dtype=np.uint64))
    docs, records = np.concatenate(docs), np.concatenate(records)
    order = np.argsort(docs, kind="stable")
    return docs[order], records[order]


def _items(batches):
    for batch in batches:
        for i, j, words in X.text_words(batch.column(1), X.ALNUM):
            doc, r = _fingerprints(words, None, None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(r[:, 0].copy()), pa.array(r[:, 1].copy()), pa.array(r[:, 2].copy()), X.binary_array(list(r[:, 3:]))],
                ["item_id", "h", "item_at", "length", "item_words"],
            )


def _documents(words_of, lengths):
    def run(batches):
        task = TaskContext.get()
        uid = (task.partitionId() if task else 0) << 40
        for batch in batches:
            for i, j, words in X.text_words(batch.column(-1), X.ALNUM):
                doc, records = _fingerprints(words, words_of.value, lengths)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                parts = [records[a:b] for a, b in zip(cut[:-1], cut[1:])]
                own = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + j - i)), *own, pa.array(words.counts.astype(np.int64)), X.binary_array(parts)],
                    ["uid", "doc_id", *KEY, "n_words", "hits"],
                )
                uid += j - i

    return run


def _spread(batches):
    for batch in batches:
        r, o = X.unpack(batch.column(1), np.int64)
        r = r.reshape(-1, 3 + _AROUND)
        uid = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(o) // (3 + _AROUND))
        yield pa.RecordBatch.from_arrays([pa.array(uid), *(pa.array(r[:, k].copy()) for k in range(3)), X.binary_array(list(r[:, 3:]))], ["uid", "h", "doc_at", "length", "doc_words"])


def _extended(batches):
    """Spans of a document that agree with an item around one joint fingerprint."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at, length = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        x, y = (X.unpack(batch.column(k), np.uint64)[0].reshape(n, _AROUND) for k in (4, 5))
        same = (x == y) & (x != 0)
        starts = np.stack([same[:, o : o + SPAN].all(axis=1) for o in range(_BEFORE + 1)], axis=1)
        any_span = starts.any(axis=1)
        low = starts.argmax(axis=1)
        high = _BEFORE - starts[:, ::-1].argmax(axis=1)
        short = length < SPAN
        begin = np.where(short, at, at - _BEFORE + low)
        end = np.where(short, at + length, at - _BEFORE + high + SPAN)
        ok = pa.array(np.flatnonzero(short | any_span))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(ok), batch.column(1).take(ok), pa.array(begin).take(ok), pa.array(end).take(ok)], ["uid", "item_id", "begin", "end"])


def spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): uid, doc_id, key and n_words of each row; uid, item_id, begin, end (word positions) of each agreement."""
    sc = spark.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.table(items.mapInArrow(_items, "item_id string, h long, item_at long, length long, item_words binary"), "items")
    lengths = sorted(r[0] for r in items.where(F.col("length") < SPAN).select("length").distinct().collect())  # 9 values at most
    bits = sc.broadcast(BitFilter(items.select("h"), hashed=True).words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key_columns(), F.col("text").cast("string").alias("text"))
    table = scratch.table(rows.mapInArrow(_documents(bits, lengths), "uid long, doc_id long, _no_id boolean, _id long, _text_key long, n_words long, hits binary"), "documents")
    hits = table.where(F.length("hits") > 0).select("uid", "hits").mapInArrow(_spread, "uid long, h long, doc_at long, length long, doc_words binary")
    both = hits.join(items, ["h", "length"]).select("uid", "item_id", "doc_at", "length", "doc_words", "item_words")
    found = scratch.table(both.mapInArrow(_extended, "uid long, item_id string, begin long, end long").distinct(), "spans")
    return table.drop("hits"), found


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every row of `docs`: doc_id, its key, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of ten consecutive words of an
    item, or of a whole item of fewer.  The items of a document are listed in
    one digest, so a document's list is as long as the items that hit it.
    """
    with Scratch(spark) as scratch:
        table, found = spans(spark, docs, benchmark, scratch)
        order = W.partitionBy("uid").orderBy("begin", "end")
        reach = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        cover = found.select("uid", "begin", "end").distinct().withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(reach, F.col("begin"))))
        n_hit = cover.groupBy("uid").agg(F.sum("new").alias("n_hit"))
        ids = found.select("uid", "item_id").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
        out = (
            table.join(n_hit.join(ids, "uid"), "uid", "left")
            .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
            .withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
            .select("doc_id", *KEY, "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
        )
        return scratch.finish(out)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that share no span with the benchmark."""
    gone = contamination(spark, docs, benchmark).where("contaminated").select(*KEY).distinct()
    return keyed(docs).join(gone, KEY, "left_anti").select("row.*")
