"""Positions in a total order of a whole table, without a task that sees all of it.

Rows are dealt by ranges of the order, sorted in their partition and numbered
there; a checkpoint fixes both.  The sizes of the partitions, one number for
each, give the number of rows before each of them.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.session import checkpoint_dir, parts

#: Row numbers within a partition are the low bits of Spark's increasing id.
_LOW = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column | str], n: int | None) -> DataFrame:
    """`df` with _part and _pos, checkpointed."""
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(n or parts(df.sparkSession), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return ranged.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND(_LOW).alias("_pos")).checkpoint()


def _beside(held: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """`held` with a value for each partition; the other side has as many rows as there are partitions."""
    return held.join(F.broadcast(held.sparkSession.createDataFrame(values, f"_part int, {schema}")), "_part")


def ordinals(df: DataFrame, order: list[Column | str], name: str = "ordinal", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Adds the position of each row in `order` (a total one, or equal rows take any order among themselves)."""
    held = _ranged(df, order, partitions)
    sizes = sorted(tuple(r) for r in held.groupBy("_part").count().collect())  # a row for each partition
    before = list(accumulate((n for _, n in sizes), initial=start))
    placed = _beside(held, [(p, b) for (p, _), b in zip(sizes, before)], "_before long")
    return placed.select(*df.columns, (F.col("_before") + F.col("_pos")).alias(name))


def ntiles(df: DataFrame, order: list[Column | str], k: int, name: str = "tile", partitions: int | None = None) -> DataFrame:
    """Adds the number (from 1) of `k` equal groups in `order`; the first ones are longer by one where it does not divide."""
    placed = ordinals(df, order, "_ordinal", 0, partitions)
    n = placed.count()
    size, more = divmod(n, k)
    i = F.col("_ordinal")
    tile = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / max(size, 1)))
    return placed.select(*df.columns, (tile + 1).cast("int").alias(name))


def running_max(df: DataFrame, order: list[Column | str], value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the largest `value` of all rows before each in `order`; null for the first."""
    held = _ranged(df, order, partitions)
    own = F.max(value).over(W.partitionBy("_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, -1))
    tops = sorted(tuple(r) for r in held.groupBy("_part").agg(F.max(value)).collect())  # a row for each partition
    before, top = [], None
    for p, t in tops:
        before.append((p, top))
        top = t if top is None else top if t is None else max(top, t)
    return _beside(held.withColumn("_own", own), before, f"_carried {df.schema[value].dataType.simpleString()}").select(*df.columns, F.greatest("_own", "_carried").alias(name))
