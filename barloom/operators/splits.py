"""Leakage-safe index ranges: nested walk-forward and combinatorial purged splits.

Ranges are half-open.  A plan is computed on the driver, combinatorial training
ranges by the algebra of range tables; ranges meet the bars in an equal join on
blocks of bars.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.errors import SplitError
from barloom.operators import sweep

Range = tuple[int, int]


@dataclass(frozen=True)
class SplitConfig:
    n_outer_folds: int
    outer_test_bars: int
    n_inner_folds: int
    inner_val_bars: int
    purge_bars: int
    embargo_bars: int
    lockbox_bars: int
    min_train_bars: int

    def __post_init__(self) -> None:
        for name in ("n_outer_folds", "outer_test_bars", "n_inner_folds", "inner_val_bars", "lockbox_bars"):
            if getattr(self, name) <= 0:
                raise SplitError("must be positive", field=name)
        for name in ("purge_bars", "embargo_bars", "min_train_bars"):
            if getattr(self, name) < 0:
                raise SplitError("must not be negative", field=name)


def subtract(base: list[Range], cuts: list[Range]) -> list[Range]:
    """What is left of the ranges outside all cuts."""
    left = [r for r in base if r[0] < r[1]]
    for a, b in cuts:
        left = [p for s, e in left for p in ((s, min(e, a)), (max(s, b), e)) if p[0] < p[1]]
    return sorted(left)


def overlaps(a: Range, b: Range) -> bool:
    return max(a[0], b[0]) < min(a[1], b[1])


def length(ranges: list[Range]) -> int:
    return sum(b - a for a, b in ranges)


@dataclass(frozen=True)
class Fold:
    train: list[Range]
    test: Range
    inner: list[tuple[list[Range], Range]]


@dataclass(frozen=True)
class Plan:
    n_bars: int
    config: SplitConfig
    lockbox: Range
    folds: list[Fold]

    def rows(self) -> list[tuple[int, int, str, int, int]]:
        """(outer, inner, role, start, stop); -1 where a level does not apply."""
        out = [(-1, -1, "lockbox", *self.lockbox)]
        for k, f in enumerate(self.folds):
            out += [(k, -1, "train", *r) for r in f.train] + [(k, -1, "test", *f.test)]
            for j, (train, val) in enumerate(f.inner):
                out += [(k, j, "inner_train", *r) for r in train] + [(k, j, "validation", *val)]
        return out


def _tiles(stop: int, count: int, size: int) -> list[Range]:
    start = stop - count * size
    return [(start + i * size, start + (i + 1) * size) for i in range(count)]


def walk_forward(n_bars: int, c: SplitConfig) -> Plan:
    """Tests tile the end of the research bars; training expands from the start, purged and embargoed."""
    lockbox = (n_bars - c.lockbox_bars, n_bars)
    tests = _tiles(lockbox[0] - c.purge_bars, c.n_outer_folds, c.outer_test_bars)
    if tests[0][0] < c.min_train_bars + c.purge_bars:
        raise SplitError("too few bars for this plan", n_bars=n_bars)
    folds = []
    for k, test in enumerate(tests):
        end = test[0] - c.purge_bars
        train = subtract([(0, end)], [(b, b + c.embargo_bars) for _, b in tests[:k]])
        if length(train) < c.min_train_bars:
            raise SplitError("training set too short", fold=k, bars=length(train))
        vals = _tiles(end, c.n_inner_folds, c.inner_val_bars)
        if vals[0][0] < c.purge_bars + 1:
            raise SplitError("inner blocks do not fit", fold=k)
        inner = []
        for j, val in enumerate(vals):
            until = val[0] - c.purge_bars
            base = [(a, min(b, until)) for a, b in train if a < until]
            inner.append((subtract(base, [(b, b + c.embargo_bars) for _, b in vals[:j]]), val))
        folds.append(Fold(train, test, inner))
    plan = Plan(n_bars, c, lockbox, folds)
    check_plan(plan)
    return plan


def check_plan(plan: Plan) -> None:
    """Raises on any way in which later data could reach training."""
    p, e = plan.config.purge_bars, plan.config.embargo_bars
    for k, f in enumerate(plan.folds):
        if f.test[1] + p > plan.lockbox[0]:
            raise SplitError("test reaches the lockbox", fold=k)
        for r in f.train:
            if r[1] + p > f.test[0]:
                raise SplitError("training is not purged before its test", fold=k, range=r)
            for other in plan.folds[:k]:
                if overlaps(r, (other.test[1], other.test[1] + e)):
                    raise SplitError("training lies in an embargo", fold=k, range=r)
        for train, val in f.inner:
            if val[0] < 0 or val[1] + p > f.test[0]:
                raise SplitError("validation is not purged before the outer test", fold=k)
            for r in train:
                if r[1] + p > val[0] or not any(a <= r[0] and r[1] <= b for a, b in f.train):
                    raise SplitError("inner training leaks", fold=k, range=r)
                if any(overlaps(r, (other[1], other[1] + e)) for _, other in f.inner[: f.inner.index((train, val))]):
                    raise SplitError("inner training lies in an embargo", fold=k, range=r)


def combinatorial(n_bars: int, groups: int, test_groups: int, purge: int, embargo: int) -> list[tuple[list[Range], list[Range]]]:
    """(train, tests) for every choice of test groups."""
    if not 0 < test_groups < groups or n_bars < groups:
        raise SplitError("bad numbers of groups", groups=groups, test_groups=test_groups)
    bounds = [round(i * n_bars / groups) for i in range(groups + 1)]
    blocks = list(zip(bounds[:-1], bounds[1:]))
    out = []
    for chosen in combinations(range(groups), test_groups):
        tests = [blocks[i] for i in chosen]
        cuts = [(max(0, a - purge), min(n_bars, b + embargo)) for a, b in tests]
        out.append((subtract([(0, n_bars)], cuts), tests))
    return out


RANGES = "plan int, inner int, role string, start long, stop long"


def plan_frame(spark: SparkSession, plan: Plan) -> DataFrame:
    return spark.createDataFrame(plan.rows(), RANGES)


def combinatorial_frame(spark: SparkSession, splits: list[tuple[list[Range], list[Range]]]) -> DataFrame:
    rows = [(k, -1, role, a, b) for k, (train, tests) in enumerate(splits) for role, ranges in (("train", train), ("test", tests)) for a, b in ranges]
    return spark.createDataFrame(rows, RANGES)


def combinatorial_ranges(bars: DataFrame, groups: int, test_groups: int, purge: int, embargo: int) -> DataFrame:
    """`combinatorial` for all bars of the longest series as a table: the training ranges are what the tests' surroundings leave of all bars."""
    spark = bars.sparkSession
    n = bars.agg((F.max("bar_idx") + 1).alias("n"))
    edge = lambda g: F.bround(g * F.col("n") / groups).cast("long")
    chosen = [(k, g) for k, some in enumerate(combinations(range(groups), test_groups)) for g in some]
    tests = spark.createDataFrame(chosen, "plan int, g int").crossJoin(F.broadcast(n)).select("plan", edge(F.col("g")).alias("start"), edge(F.col("g") + 1).alias("stop"), "n")  # n is one row
    cuts = tests.select("plan", F.greatest(F.lit(0), F.col("start") - purge).alias("start"), F.least("n", F.col("stop") + embargo).alias("stop"))
    whole = tests.select("plan", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    train = sweep.subtract(whole, cuts, ["plan"])
    role = lambda rows, name: rows.select("plan", F.lit(-1).alias("inner"), F.lit(name).alias("role"), "start", "stop")
    return role(train, "train").unionByName(role(tests, "test"))


def bars_in_ranges(bars: DataFrame, ranges: DataFrame) -> DataFrame:
    """The bars of each range."""
    return sweep.points_in_ranges(bars, "bar_idx", ranges)


def leaks(ranges: DataFrame, purge: int) -> DataFrame:
    """Pairs of a training and a test range of one split that overlap or are closer than the purge."""
    train = ranges.where(F.col("role").isin("train", "inner_train")).select("plan", "inner", F.col("start").alias("train_start"), F.col("stop").alias("train_stop"))
    test = ranges.where(F.col("role").isin("test", "validation")).select("plan", "inner", F.col("start").alias("test_start"), F.col("stop").alias("test_stop"))
    near = (F.col("train_start") < F.col("test_stop")) & (F.col("train_stop") + purge > F.col("test_start"))
    return train.join(test, ["plan", "inner"]).where(near)
