"""Source divergence audit by joint count histograms.

For each language, every source is compared with each other source and with
the whole language by the counts of its terms.  With few different counts and
very many terms, a sum of ``f(p, q)`` over terms is the sum over the distinct
combinations (count here, count there) of ``f`` times the number of terms that
have it; so a pair of sources is reduced to its joint histogram.  Only
combinations of two counts above zero are tallied.  Those with a zero follow
from them: the terms that a source has c times, less those of them that the
other source has too; and the terms that neither has are what is left of the
language's terms.

Terms are counted in batches where the texts are and merged by Spark's
map-side combined groupBy.  The tally walks rows sorted by (language, term) in
bounded chunks and gives histogram rows alone, never a row for each pair of
sources of a term.  All arithmetic is on whole numbers.

With ``p = 1 + floor(UNIT * (count + 2) / (N + 2 V))``, N the counts of a group
over its language's V terms, ``f = floor((p - q)^2 / (p + q))``.

Defined cases: a null text, language or source is the empty string; terms are
runs of letters and of anything outside ASCII, of which only A-Z are
lower-cased; a language keeps the terms in at least `least` of its documents;
groups without terms take part, with zero counts; a language without terms
gives its pairs the value 0; a language with one source has no pair; rows that
repeat are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm import _text as X
from barloom.llm._spark import Scratch, partitions

LEAST_DOCUMENTS, TOP, UNIT = 10, 10, 1_000_000_000
#: Letters and everything outside ASCII.
LETTERS = X.byte_class([(0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_CHUNK = 1 << 16


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            sources = max(1, len(source.dictionary))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * sources + source.indices.to_numpy(zero_copy_only=False)
            for i, j, words in X.text_words(batch.column(2), LETTERS):
                code, terms = X.distinct(words, lower=True)
                width = max(1, len(terms))
                doc = np.repeat(np.arange(j - i), words.counts)
                pair, n = np.unique(doc * width + code, return_counts=True)
                key, at = np.unique(group[i:j][pair // width] * width + pair % width, return_inverse=True)
                counts = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
                g, w = key // width, key % width
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(g // sources)), source.dictionary.take(pa.array(g % sources)), terms.take(pa.array(w)).cast(pa.string()), pa.array(counts), pa.array(np.bincount(at, minlength=len(key)))],
                    ["lang", "source", "term", "n", "docs"],
                )

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tally(rows: pa.Table) -> pa.Table:
    """lang, a, b, x, y, m: how many terms source a has x times and source b y times; rows sorted by (lang, term, source)."""
    lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    term = rows["term"].combine_chunks()
    n = rows["n"].to_numpy()
    l, s = (d.indices.to_numpy(zero_copy_only=False).astype(np.int64) for d in (lang, source))
    new = np.ones(len(n), dtype=bool)
    if len(n):
        new[1:] = (l[1:] != l[:-1]) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
    run = np.cumsum(new)
    found = []
    step = 1
    here = np.arange(len(n))
    while True:
        here = here[here + step < len(n)]
        here = here[run[here] == run[here + step]]
        if not len(here):
            break
        there = here + step
        keys, m = np.unique(np.stack([l[here], s[here], s[there], n[here], n[there]]), axis=1, return_counts=True)
        found.append(np.concatenate([keys, m[None]]))
        step += 1
    l, a, b, x, y, m = np.concatenate([np.empty((6, 0), dtype=np.int64), *found], axis=1)
    return pa.table({"lang": lang.dictionary.take(pa.array(l)), "a": source.dictionary.take(pa.array(a)), "b": source.dictionary.take(pa.array(b)), "x": x, "y": y, "m": m})


def joint_histograms(kept: DataFrame, n: int) -> DataFrame:
    """lang, a < b, x, y, m of all pairs of sources with a term in common, from lang, source, term, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            if rows.num_rows < _CHUNK:
                rest = rows
                continue
            last = rows.slice(rows.num_rows - 1)
            same = pc.and_(pc.equal(rows["lang"], last["lang"][0]), pc.equal(rows["term"], last["term"][0]))
            cut = rows.num_rows - pc.sum(same).as_py()
            rest = rows.slice(cut)
            yield from tally(rows.slice(0, cut)).to_batches()
        if rest is not None:
            yield from tally(rest).to_batches()

    sorted_ = kept.select("lang", "source", "term", "n").repartition(n, "lang", "term").sortWithinPartitions("lang", "term", "source")
    return sorted_.mapInArrow(run, "lang string, a string, b string, x long, y long, m long").groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))


def share(count: str, total: str) -> Column:
    """p of a count, `total` = N + 2 V; products of large counts need decimals."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({total} as decimal(20,0))")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: each other source of the language and its divergence, all
    ranks.  Part `term`: the terms that the source has more often than its
    language, up to rank `top`.  Ranks by value descending, then item.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with Scratch(spark) as scratch:
        term = W.partitionBy("lang", "term")
        counted = term_counts(docs).withColumn("in_docs", F.sum("docs").over(term)).withColumn("in_lang", F.sum("n").over(term)).withColumn("lowest", F.min("source").over(term))
        kept = scratch.table(counted.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "in_lang", (F.col("lowest") == F.col("source")).cast("long").alias("first")), "kept", batch=10_000)
        # the sizes of groups and languages
        seen = docs.select("lang", "source").distinct()
        sizes = seen.select("lang", "source", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("has")).unionByName(kept.select("lang", "source", "n", "first", F.lit(1).alias("has")))
        groups = sizes.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("v"), F.sum("has").alias("terms"))
        language = W.partitionBy("lang")
        groups = scratch.table(
            groups.withColumn("all", F.sum("v").over(language)).select("lang", "source", (F.col("n") + 2 * F.col("all")).alias("total"), (F.sum("n").over(language) + 2 * F.col("all")).alias("lang_total"), F.col("all").alias("v"), "terms"),
            "groups",
        )

        # pairs: joint histogram, then the cells that hold a zero
        joint = scratch.table(joint_histograms(kept, partitions(spark)), "joint", batch=10_000)
        own = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("h"))
        a, b = (groups.select("lang", F.col("source").alias(c), F.col("total").alias(f"{c}_total"), F.col("terms").alias(f"{c}_terms"), *([F.col("v")] if c == "a" else [])) for c in "ab")
        pairs = scratch.table(a.join(b, "lang").where("a < b"), "pairs")  # as many as the result has
        both = joint.groupBy("lang", "a", "b").agg(F.sum("m").alias("shared"))
        neither = pairs.where("v > 0").join(both, ["lang", "a", "b"], "left").select("lang", "a", "b", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.expr("v - a_terms - b_terms + coalesce(shared, 0)").alias("m"))
        cells = joint.unionByName(neither)
        for side, other, c, d in (("a", "b", "x", "y"), ("b", "a", "y", "x")):
            matched = joint.groupBy("lang", "a", "b", c).agg(F.sum("m").alias("shared"))
            alone = (
                pairs.select("lang", "a", "b")
                .join(own.select("lang", F.col("source").alias(side), F.col("n").alias(c), "h"), ["lang", side])
                .join(matched, ["lang", "a", "b", c], "left")
                .select("lang", "a", "b", c, F.lit(0).cast("long").alias(d), F.expr("h - coalesce(shared, 0)").alias("m"))
            )
            cells = cells.unionByName(alone)
        valued = cells.where("m > 0").join(pairs, ["lang", "a", "b"]).withColumn("p", share("x", "a_total")).withColumn("q", share("y", "b_total"))
        summed = valued.groupBy("lang", "a", "b").agg(F.sum(divergence("p", "q") * F.col("m")).alias("value"))
        scored = scratch.table(pairs.select("lang", "a", "b").join(summed, ["lang", "a", "b"], "left").select("lang", "a", "b", F.coalesce("value", F.lit(0)).alias("value")), "scored")
        pair = scored.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").unionByName(
            scored.select("lang", F.col("b").alias("source"), F.lit("pair").alias("part"), F.col("a").alias("item"), "value")
        )

        # terms that mark a source
        marked = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total")).withColumn("q", share("in_lang", "lang_total")).where("p > q")
        of_term = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence("p", "q").alias("value"))
        order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        best = of_term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = pair.withColumn("rank", F.row_number().over(order)).unionByName(best)
        return scratch.finish(out.select("lang", "source", "part", "item", "value", "rank"))
