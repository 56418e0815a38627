"""Sweeps along an axis within keys: as-of joins, running sums and the algebra of ranges.

A key may hold most of the rows, so a key is no task of its own where it is large:
a key of more rows than a task should have is cut along the axis into as many
pieces as its count asks for, and a piece that still holds too many again.  All other keys
stay whole, and one shuffle by key serves every window and aggregate of a sweep.
What a piece hands to the next (its last row, its sum) is a table with one row for
each piece of the cut keys, which is swept in turn and broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a piece of a cut key holds, about; keys of up to twice as many stay whole.
MOST = 200_000
_BUCKET = ["_bucket", "_piece"]
#: Times that a piece may be cut; after so many a piece is narrower than doubles tell apart.
_CUTS = 12


def _same(keys: list[str]) -> Column:
    """Whether the columns `keys` equal _k0, _k1 ..., nulls among them."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))


def _named(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *columns)


def _sizes(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(first).cast("double").alias("_low"), F.max(last).cast("double").alias("_high"))


def _large(df: DataFrame, sizes: DataFrame, keys: list[str], most: int) -> DataFrame | None:
    """What is to be cut, with its number of parts; a row for every 2 `most` rows of `df` at most, none: None."""
    cut = _named(sizes.where((F.col("_n") > 2 * most) & (F.col("_high") > F.col("_low"))).withColumn("_parts", F.ceil(F.col("_n") / most)), keys, "_low", "_high", "_parts")
    found = cut.collect()
    return df.sparkSession.createDataFrame(found, cut.schema) if found else None


def _cut_up(df: DataFrame, keys: list[str], at: str, most: int, cut: DataFrame | None) -> DataFrame:
    df = df.withColumns({"_bucket": F.lit(0), "_piece": F.lit(0.0)})
    columns, by, looked = df.columns, keys, df
    for _ in range(_CUTS):
        if cut is None:
            break
        width = (F.col("_high") - F.col("_low")) / F.col("_parts")
        nth = F.greatest(F.lit(0), F.least(F.floor((F.col(at).cast("double") - F.col("_low")) / width), F.col("_parts") - 1))
        # _piece is where a piece begins; rows never fall back behind those of an earlier position
        own = {"_bucket": F.when(F.col("_parts").isNotNull(), 1).otherwise(F.col("_bucket")), "_piece": F.coalesce(F.col("_low") + nth * width, "_piece")}
        df = df.join(F.broadcast(cut), _same(by), "left").select(*(own[c].alias(c) if c in own else c for c in columns))
        by, looked = [*keys, "_piece"], df.where("_bucket = 1")
        cut = _large(df, _sizes(looked, by, at, at), by, most)
    return df


def bucketed(df: DataFrame, keys: list[str], at: str, most: int = MOST) -> DataFrame:
    """Adds _bucket (1: of a key that is cut) and _piece, which follows `at` within a key.

    Rows at one position stay together, whatever their number.
    """
    return _cut_up(df, keys, at, most, _large(df, _sizes(df, keys, at, at), keys, most))


def _carry(df: DataFrame, keys: list[str], totals: DataFrame, names: list[str]) -> DataFrame:
    """`df` with the columns `names` of the row of its piece in `totals`, null for keys that are not cut."""
    by = [*keys, *_BUCKET]
    return df.join(F.broadcast(_named(totals, by, *names)), _same(by), "left").drop(*(f"_k{i}" for i in range(len(by))))


def running_sums(df: DataFrame, keys: list[str], at: str, sums: dict[str, Column], cut: bool = True) -> DataFrame:
    """Adds the sums of all rows of the key up to and with each (`at` differs within a key).

    Rows have _bucket and _piece where keys are `cut`.
    """
    df = df.withColumns({f"_in_{name}": c for name, c in sums.items()})
    if not cut:
        whole = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(f"_in_{name}").over(whole) for name in sums}).drop(*(f"_in_{name}" for name in sums))
    own = W.partitionBy(*keys, *_BUCKET).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy(*_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    totals = df.where("_bucket = 1").groupBy(*keys, *_BUCKET).agg(*(F.sum(f"_in_{name}").alias(f"_of_{name}") for name in sums))
    totals = totals.select(*keys, *_BUCKET, *(F.sum(f"_of_{name}").over(before).alias(f"_of_{name}") for name in sums))
    df = df.withColumns({name: F.sum(f"_in_{name}").over(own) for name in sums})
    df = _carry(df, keys, totals, [f"_of_{name}" for name in sums])
    return df.withColumns({name: F.col(name) + F.coalesce(F.col(f"_of_{name}"), F.lit(0)) for name in sums}).drop(*(f"_{p}_{name}" for p in ("in", "of") for name in sums))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    columns: list[str],
    order: list[str] | None = None,
    strict: bool = False,
    tolerance: float | None = None,
    most: int = MOST,
) -> DataFrame:
    """Every row of `left` with `columns` of the last row of `right` of its keys at or before `at` (before it: `strict`).

    Of rows of `right` at one position the last by `order` counts.  Rows of
    `left` whose keys or position are null, that have no row of `right` before
    them, or none within `tolerance`, get nulls.  Columns of `right` that are
    called like one of `left` must be renamed before.
    """
    usable = F.col(at).isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    rank = F.struct(*(order or columns))
    values = right.where(usable).groupBy(*keys, at).agg(F.max_by(F.struct(F.col(at).alias("_at"), *columns), rank).alias("_value"))
    kept = left.where(usable)
    rows = kept.select(*keys, at, F.struct(*left.columns).alias("_row"), F.lit(None).cast(values.schema["_value"].dataType).alias("_value"))
    both = rows.unionByName(values.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    cut = _large(both, _sizes(kept.select(*keys, at).unionByName(right.where(usable).select(*keys, at)), keys, at, at), keys, most)
    first = F.col("_value").isNull() if not strict else F.col("_value").isNotNull()
    if cut is None:
        own = W.partitionBy(*keys).orderBy(at, first).rowsBetween(W.unboundedPreceding, 0)
        seen = both.withColumn("_seen", F.last("_value", ignorenulls=True).over(own)).where("_row is not null").withColumn("_handed", F.col("_seen"))
    else:
        both = _cut_up(both, keys, at, most, cut)
        own = W.partitionBy(*keys, *_BUCKET).orderBy(at, first).rowsBetween(W.unboundedPreceding, 0)
        handed = both.where("_bucket = 1").groupBy(*keys, *_BUCKET).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(at))).alias("_handed"))
        before = W.partitionBy(*keys).orderBy(*_BUCKET).rowsBetween(W.unboundedPreceding, -1)
        handed = handed.select(*keys, *_BUCKET, F.last("_handed", ignorenulls=True).over(before).alias("_handed"))
        seen = _carry(both.withColumn("_seen", F.last("_value", ignorenulls=True).over(own)).where("_row is not null"), keys, handed, ["_handed"])
    found = F.coalesce("_seen", "_handed")
    if tolerance is not None:
        found = F.when(F.col(f"_row.{at}") - found["_at"] <= tolerance, found)
    joined = seen.withColumn("_found", found).select("_row.*", *(F.col(f"_found.{c}").alias(c) for c in columns))
    rest = left.where(~F.coalesce(usable, F.lit(False))).select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns))
    return joined.unionByName(rest)


def _sided(ranges: DataFrame, keys: list[str], side: str) -> DataFrame:
    return ranges.where("start < stop").select(*keys, "start", "stop", F.lit(side).alias("_side"))


def _steps(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """+1 at every start and -1 at every stop of its side."""
    ends = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("stop").alias("pos"), F.lit(-1).alias("step"))))
    steps = ranges.select(*keys, "_side", ends.alias("e"))
    return steps.select(*keys, F.col("e.pos").alias("pos"), *(F.when(F.col("_side") == side, F.col("e.step")).otherwise(0).alias(f"d{side}") for side in "ab"))


def _swept(ranges: DataFrame, keys: list[str], inside, most: int) -> DataFrame:
    """keys, start, stop: the longest ranges in which `inside` of the two depths holds."""
    cut = _large(ranges, _sizes(ranges, keys, "start", "stop"), keys, max(1, most // 2))  # a range has two steps
    # keys that stay whole are shuffled once, as ranges; all that follows is grouped by key
    steps = _steps(ranges.repartition(*keys), keys) if cut is None else _cut_up(_steps(ranges, keys), keys, "pos", most, cut)
    own = [*keys, *(_BUCKET if cut is not None else [])]
    changes = steps.groupBy(*own, "pos").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    depths = running_sums(changes, keys, "pos", {"a": F.col("da"), "b": F.col("db")}, cut is not None)
    after, before = inside(F.col("a"), F.col("b")), inside(F.col("a") - F.col("da"), F.col("b") - F.col("db"))
    edges = depths.select(*own, "pos", after.alias("_opens"), before.alias("_was")).where("_opens <> _was")
    numbered = running_sums(edges, keys, "pos", {"_nth": F.col("_opens").cast("long")}, cut is not None)
    return numbered.groupBy(*keys, "_nth").agg(F.min("pos").alias("start"), F.max("pos").alias("stop")).select(*keys, "start", "stop")


def cover(ranges: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """The union of the half-open ranges [start, stop) of each key, as disjoint ranges that do not touch."""
    return _swept(_sided(ranges, keys, "a"), keys, lambda a, b: a > 0, most)


def subtract(ranges: DataFrame, cuts: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """What the union of `ranges` keeps outside all `cuts` of its key."""
    return _swept(_sided(ranges, keys, "a").unionByName(_sided(cuts, keys, "b")), keys, lambda a, b: (a > 0) & (b == 0), most)


def intersect(ranges: DataFrame, others: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """Where both unions lie."""
    return _swept(_sided(ranges, keys, "a").unionByName(_sided(others, keys, "b")), keys, lambda a, b: (a > 0) & (b > 0), most)


def points_in_ranges(points: DataFrame, at: str, ranges: DataFrame, block: int = 1024) -> DataFrame:
    """Every point with every range [start, stop) that holds it, as an equal join on blocks of `block` positions.

    Joins on the columns that both have, beside the block.
    """
    shared = [c for c in points.columns if c in ranges.columns]
    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))
    cut = ranges.where("start < stop").withColumn("_block", F.explode(blocks))
    placed = points.withColumn("_block", F.floor(F.col(at) / block))
    return placed.join(cut, [*shared, "_block"]).where((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop"))).drop("_block")
