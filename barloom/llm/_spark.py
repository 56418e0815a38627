"""Session helpers: the shared folder, scratch tables and components.

Executors can be lost at any time, so intermediate results are written to the
folder that the cluster names in ``spark.checkpoint.dir``; they are never kept
on one machine alone.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="barloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows with texts or sets go to Python in batches of so many.
WIDE_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def wide_rows(spark: SparkSession) -> None:
    """Lets the session send small Arrow batches, for plans that run after the operator has returned.

    With Spark's 10,000 rows a batch of documents takes tens of MB several
    times over, in the JVM and in Python.
    """
    if int(spark.conf.get(BATCH)) > WIDE_ROWS:
        spark.conf.set(BATCH, str(WIDE_ROWS))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Tables of one operator call in the shared folder, removed at its end.

    ``table`` writes a DataFrame as Parquet and reads it back, which cuts its
    lineage; ``finish`` checkpoints the (narrow) result, after which nothing
    depends on the tables any more.  While it is open, rows go to Python in
    small batches, since most of them carry texts or sets; a table of narrow
    rows may ask for larger ones.
    """

    def __init__(self, spark: SparkSession, batch: int = WIDE_ROWS) -> None:
        self.spark, self.batch = spark, batch
        self.path = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        self.before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(self.batch))
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(BATCH, self.before)
        remove(self.spark, self.path)

    def table(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        self.spark.conf.set(BATCH, str(batch or self.batch))
        df.write.parquet(path)
        self.spark.conf.set(BATCH, str(self.batch))
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, old: DataFrame, new: DataFrame, name: str) -> DataFrame:
        """`new`, made from the table `old` alone, in the place of `old`, whose files go."""
        folder = old.inputFiles()[0].rsplit("/", 1)[0] if old.inputFiles() else None
        out = self.table(new, name)
        if folder:
            remove(self.spark, folder)
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of plans that are no longer held, as it does from time to time."""
        gc.collect()
        self.spark._jvm.System.gc()

    def finish(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long), the root shared by all that are connected.

    Each round hooks every node to the smallest of its neighbours and itself
    and replaces the ends of the edges by these, so that connected groups
    shrink until no edge is left; the hooks of all rounds are then followed.
    Node ids should be hashes: their random order makes the number of rounds
    logarithmic.  Every step is a map-side combined aggregate or a join, so a
    node with very many neighbours is never gathered in one place.
    """
    edges = scratch.table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    hooks = []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hook = scratch.table(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "hook")
        hooks.append(hook)
        to_a, to_b = (hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        edges = scratch.table(
            edges.join(to_a, "a").join(to_b, "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0]
    for hook in hooks[1:]:
        nxt = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return scratch.table(out, "components")


#: Keys that are broadcast because many rows have them, at most.
MOST_HOT = 100_000


def on_hot(rows: DataFrame, values: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `values` (one row for each `key`, met by `count` rows), without dealing rows by a key that many share.

    Keys of more than ``least`` rows are broadcast: since the counts add up
    to `total`, there are at most ``total / least``, that is ``MOST_HOT``.  The
    others are met by few rows each and are joined as usual.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    least = max(1000, -(-total // MOST_HOT))
    hot = values.where(F.col(count) > least).drop(count)
    own = [c for c in hot.columns if c != key]
    found = rows.join(F.broadcast(hot.select(key, F.struct(*own).alias("_hot"))), key, "left")
    shared = found.where("_hot is not null").select(*rows.columns, *(F.col(f"_hot.{c}").alias(c) for c in own))
    alone = found.where("_hot is null").drop("_hot").join(values.where(F.col(count) <= least).drop(count), key, how)
    return shared.unionByName(alone)


class BitFilter:
    """A fixed-size bit set, built by aggregation; false positives only.

    The driver holds at most ``max_bits / 8`` bytes whatever the number of ids.
    """

    def __init__(self, ids: DataFrame, hashed: bool = False, max_bits: int = 1 << 26) -> None:
        """`ids` has one long column; `hashed`: it holds hashes whose low bits are the position."""
        (name,) = ids.columns
        n = ids.count()
        self.bits = 1 << 12
        while self.bits < 16 * n and self.bits < max_bits:
            self.bits *= 2
        at = (F.col(name).bitwiseAND(self.bits - 1) if hashed else self.column(name)).cast("int")
        words = (
            ids.select(F.floor(at / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(32))).alias("bit"))
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bits"))
            .toArrow()
        )
        self.words = np.zeros(self.bits // 32, dtype=np.uint32)
        self.words[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)

    def column(self, name: str):
        """The position of an id, to be computed by Spark beside the id."""
        return F.pmod(F.xxhash64(name), F.lit(self.bits)).cast("int")

    @staticmethod
    def test(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        return (words[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1

    @staticmethod
    def test_hashes(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return BitFilter.test(words, hashes & np.uint64(32 * len(words) - 1))


#: What identifies a document: its id, which may be null, and a hash of its text.
KEY = ["_no_id", "_id", "_text_key"]


def key_columns() -> list:
    """The columns of KEY, from doc_id and text."""
    return [
        F.col("doc_id").isNull().alias("_no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("_text_key"),
    ]


def keyed(docs: DataFrame) -> DataFrame:
    """Every row of `docs` as one struct `row`, so that no name can clash, and its key."""
    return docs.select(F.struct("*").alias("row"), *key_columns())
