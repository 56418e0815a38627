"""Sweeps, orders, layers, archives, the normal columns and posterior draws against brute force."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ordinals, posterior, ranking, splits, sweep
from barloom.functions.normal import cdf, inverse

MOST = [3, 40, 200_000]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", MOST)
@pytest.mark.parametrize("strict", [False, True])
def test_asof_join(spark, most, strict):
    rng = np.random.default_rng(most)
    left = [(int(i), ("a", "b", None)[int(rng.choice(3, p=[0.8, 0.15, 0.05]))], None if i % 50 == 0 else int(rng.integers(0, 300) ** 2 // 300)) for i in range(400)]
    right = [(("a", "b", None)[int(rng.choice(3, p=[0.8, 0.15, 0.05]))], int(rng.integers(100, 250)), int(j)) for j in range(60)] + [("a", None, 99), ("c", 1, 98)]
    l = spark.createDataFrame(left, "id long, k string, t long").repartition(4)
    r = spark.createDataFrame(right, "k string, t long, v long").repartition(3)
    for tolerance in (None, 5):
        got = {x.id: x.v for x in sweep.asof_join(l, r, ["k"], "t", ["v"], ["v"], strict, tolerance, most).collect()}
        want = {}
        for i, k, t in left:
            before = [] if k is None or t is None else [(s, v) for kk, s, v in right if kk == k and s is not None and (s < t or s == t and not strict)]
            best = max(before, default=None)
            want[i] = best[1] if best and (tolerance is None or t - best[0] <= tolerance) else None
        assert got == want


def test_asof_join_of_empty_sides(spark):
    l, r = spark.createDataFrame([(1, "a", 5)], "id long, k string, t long"), spark.createDataFrame([("a", 4, 7)], "k string, t long, v long")
    assert sweep.asof_join(l.where("false"), r, ["k"], "t", ["v"]).count() == 0
    assert [x.v for x in sweep.asof_join(l, r.where("false"), ["k"], "t", ["v"]).collect()] == [None]


def test_hot_buckets_are_cut(spark):
    rows = spark.range(20_000).selectExpr("'a' k", "CASE WHEN id < 19000 THEN 1000000 + id ELSE id * 1000 END t")
    sizes = sorted(r["count"] for r in sweep.bucketed(rows, ["k"], "t", 500).groupBy("_bucket", "_piece").count().collect())
    assert sum(sizes) == 20_000 and sizes[-1] <= 1100


def _days(ranges, keys=("a", "b", None)):
    return {k: set().union(*(range(a, b) for kk, a, b in ranges if kk == k)) for k in keys}


def _found(df):
    out = {"a": [], "b": [], None: []}
    for r in df.collect():
        out[r.k].append((r.start, r.stop))
    return out


@pytest.mark.parametrize("most", MOST)
def test_algebra_of_ranges(spark, most):
    rng = np.random.default_rng(most)

    def some(n):
        return [(("a", "b", None)[int(rng.choice(3, p=[0.8, 0.15, 0.05]))], int(s), int(s + rng.integers(-1, 9))) for s in rng.integers(0, 200, n)]

    x, y = some(60), some(40)
    dx, dy = (spark.createDataFrame(v, "k string, start long, stop long").repartition(3) for v in (x, y))
    sx, sy = _days(x), _days(y)
    for df, want in ((sweep.cover(dx, ["k"], most), sx), (sweep.subtract(dx, dy, ["k"], most), {k: sx[k] - sy[k] for k in sx}), (sweep.intersect(dx, dy, ["k"], most), {k: sx[k] & sy[k] for k in sx})):
        for k, ranges in _found(df).items():
            ranges.sort()
            assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))  # disjoint, and none touches the next
            assert sum(b - a for a, b in ranges) == len(want[k]) and set().union(*(range(a, b) for a, b in ranges)) == want[k]
    assert sweep.cover(dx.where("false"), ["k"]).count() == 0


def test_points_in_ranges_without_a_nested_loop(spark):
    points = spark.range(500).selectExpr("id at")
    ranges = spark.createDataFrame([(0, 0, 10), (1, 5, 400), (2, 7, 7), (3, 499, 900)], "n int, start long, stop long")
    for block in (3, 1024):
        got = sweep.points_in_ranges(points, "at", ranges, block)
        assert "NestedLoop" not in plan_of(got)
        assert {r["n"]: r["count"] for r in got.groupBy("n").count().collect()} == {0: 10, 1: 395, 3: 1}


def test_combinatorial_ranges_equal_the_lists(spark):
    bars = spark.range(101).selectExpr("'A' symbol", "id bar_idx")
    got = sorted(tuple(r) for r in splits.combinatorial_ranges(bars, 6, 2, 5, 3).collect())
    assert got == sorted(tuple(r) for r in splits.combinatorial_frame(spark, splits.combinatorial(101, 6, 2, 5, 3)).collect())


def test_ordinals_and_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(v)) for i, v in enumerate(rng.integers(0, 50, 1003))]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    order = [F.desc("v"), F.col("id")]
    want = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    placed = ordinals.ordinals(df, order, "n", 0, partitions=7)
    assert {r.id: r.n for r in placed.collect()} == want
    assert "SinglePartition" not in plan_of(placed)
    tiles = {r.id: r.t for r in ordinals.ntiles(df, order, 10, "t").collect()}
    assert tiles == {i: next(t + 1 for t in range(10) if n < sum(101 if u < 3 else 100 for u in range(t + 1))) for i, n in want.items()}
    before = {r.id: r.m for r in ordinals.running_max(df, ["id"], "v", "m", 6).collect()}
    assert before == {i: max((v for _, v in rows[:i]), default=None) for i, _ in rows}
    assert ordinals.ordinals(df.where("false"), order).count() == 0


def brute_layers(m):
    layer, left, k = np.full(len(m), -1), np.arange(len(m)), 0
    while len(left):
        x = m[left]
        beaten = np.array([((x >= v).all(axis=1) & (x > v).any(axis=1)).any() for v in x])
        layer[left[~beaten]] = k
        left, k = left[beaten], k + 1
    return layer


@pytest.mark.parametrize(("step", "block"), [(64, 50_000), (3, 120), (2, 25)])
@pytest.mark.parametrize("shape", ["mixed", "front"])
def test_layers(spark, step, block, shape):
    rng = np.random.default_rng(4)
    m = rng.integers(0, 12, (400, 3)).astype(float) if shape == "mixed" else np.round(rng.normal(size=(200, 3)), 3)
    if shape == "front":  # every row is on the first layer, but for a few copies from below
        m[:, 2] = -m[:, 0] - m[:, 1]
        m = np.concatenate([m, m[:30] - 1])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)] + [(-1, None, 1.0, 1.0), (-2, float("nan"), 99.0, 99.0)], "id long, x double, y double, z double").repartition(4)
    got = ranking.layers(df, ["x", "y", "z"], step=step, block=block)
    found = {r.id: r.front for r in got.collect()}
    assert found.pop(-1) == found.pop(-2) == 0
    assert found == dict(enumerate(brute_layers(m).tolist()))
    assert {r.id for r in ranking.layers(df, ["x", "y", "z"], most=1, step=step, block=block).collect()} == {i for i, k in found.items() if k == 0} | {-1, -2}
    assert "BroadcastNestedLoop" not in plan_of(got)


@pytest.mark.parametrize("shape", ["chain", "ties", "wide"])
def test_layers_of_many(spark, shape, monkeypatch):
    """Every layer of a table with far more layers than one pass takes, without a pass for each few of them."""
    rng = np.random.default_rng(6)
    m = np.unique(rng.integers(0, {"chain": 3000, "ties": 9, "wide": 10**6}[shape], (600, 3)).astype(float), axis=0)
    if shape == "chain":
        m = np.sort(m, axis=0)
        m[0, 0], m[-1, 1] = -np.inf, np.inf
    monkeypatch.setattr(ranking, "_chained", None)
    monkeypatch.setattr(ranking, "_layered", None)
    for k in (2, 3):
        v = np.unique(m[:, :k], axis=0)
        df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(v)], "id long, " + ", ".join(f"c{c} double" for c in range(k)))
        found = {r.id: r.front for r in ranking.layers(df, [f"c{c}" for c in range(k)], block=80).collect()}
        assert found == dict(enumerate(brute_layers(v).tolist()))


SCORED = "cell int, candidate string, n long, feasible boolean, total_violation double, x double, y double"


def scored(seed, n=300):
    rng = np.random.default_rng(seed)
    v = np.maximum(0, rng.integers(-3, 3, n)).astype(float)
    return [(int(rng.choice(3, p=[0.8, 0.1, 0.1])), f"c{i}", i, bool(v[i] == 0), float(v[i]), float(rng.integers(0, 20)), float(rng.integers(0, 20))) for i in range(n)]


def fold(rows):
    cells = {}
    for row in rows:
        cell, name, _, f, v, x, y = row
        held = cells.get(cell)
        if held is None:
            cells[cell] = (row, 1)
            continue
        _, _, _, hf, hv, hx, hy = held[0]
        better = (x >= hx and y >= hy and (x > hx or y > hy)) if f and hf else f if f != hf else v < hv
        if better:
            cells[cell] = (row, held[1] + 1)
    return {c: (row[1], k) for c, (row, k) in cells.items()}


def test_archive_in_order_of_arrival(spark):
    for seed in range(3):
        rows = scored(seed)
        df = spark.createDataFrame(rows, SCORED).repartition(6)
        got = ranking.archive_in_order(df, "n", ["cell"], ("x", "y")).collect()
        assert {r.cell: (r.elite, r.accepted) for r in got} == fold(rows)
        assert sum(r.tried for r in got) == len(rows)
    # two elites of which neither is better: the first one stays
    pair = [(0, "p", 1, True, 0.0, 1.0, 2.0), (0, "q", 2, True, 0.0, 2.0, 1.0)]
    for rows in (pair, [(*r[:2], 3 - r[2], *r[3:]) for r in pair]):
        first = min(rows, key=lambda r: r[2])[1]
        assert ranking.archive_in_order(spark.createDataFrame(rows, SCORED), "n", ["cell"], ("x", "y")).first().elite == first


def test_archive_of_a_stream(spark, tmp_path):
    rows = scored(9, 90)
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], SCORED).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    last = {}

    def keep(frame, epoch):
        last.update({r.cell: (r.elite, r.accepted) for r in frame.collect()})

    ranking.archive_stream(source, "n", ["cell"], ("x", "y")).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert last == fold(rows)


def test_normal_columns(spark):
    normal = NormalDist()
    xs = [k / 20 for k in range(-800, 801)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", cdf(F.col("x")).alias("c")).collect()
    assert max(abs(r.c - normal.cdf(r.x)) for r in got) < 1e-15
    assert max(abs(r.c / (0.5 * math.erfc(-r.x / math.sqrt(2))) - 1) for r in got if -37 < r.x < 7) < 1e-12
    ps = [10.0**-k for k in range(1, 300, 13)] + [k / 500 for k in range(1, 500)] + [1 - 10.0**-k for k in range(1, 16)]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inverse(F.col("p")).alias("x")).collect()
    assert max(abs(r.x - normal.inv_cdf(r.p)) / max(1, abs(r.x)) for r in got) < 1e-12
    odd = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,)], "p double").select(inverse(F.col("p"))).collect()]
    assert odd == [float("-inf"), float("inf"), None, None]


def test_beta_function_and_draws(spark):
    x = np.linspace(0.001, 0.999, 97)
    for a, b in ((1, 1), (3, 1), (2, 5), (40, 9), (900, 1100)):
        # the tail of a binomial is a beta distribution
        n = a + b - 1
        k = np.arange(a, n + 1)
        log_c = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in k])
        want = np.exp(log_c + k * np.log(x[:, None]) + (n - k) * np.log1p(-x[:, None])).sum(axis=1)
        np.testing.assert_allclose(posterior.beta_cdf(np.full(97, a), np.full(97, b), x), want, rtol=1e-10, atol=1e-14)
    rows = spark.range(4000).selectExpr("id", "30L successes", "100L trials")
    got = posterior.draws(rows, ["id"], 3)
    d = np.array([r.draw for r in got.collect()])
    mean, var = 31 / 102, 31 * 71 / (102**2 * 103)
    assert abs(d.mean() - mean) < 4 * math.sqrt(var / 4000) and abs(d.var() / var - 1) < 0.15
    again = {r.id: r.draw for r in posterior.draws(rows.repartition(7), ["id"], 3).collect()}
    assert again == {r.id: r.draw for r in got.collect()} and again != {r.id: r.draw for r in posterior.draws(rows, ["id"], 4).collect()}
    outcomes = spark.createDataFrame([("c", "good", 900, 1000), ("c", "bad", 100, 1000)], "context string, operator string, successes long, trials long")
    few = spark.createDataFrame([("good",), ("bad",)], "operator string")
    picked = posterior.picks(outcomes, outcomes.select("context").union(spark.createDataFrame([("new",)], "context string")), few, 1).collect()
    assert {r.context for r in picked} == {"c", "new"} and [r.operator for r in picked if r.context == "c"] == ["good"]


def test_keys_that_stay_whole_are_shuffled_once(spark):
    # the ranges of many short keys: a shuffle of the ranges by key serves the sums, both sweeps and the result
    x = spark.range(4000).selectExpr("id % 2000 k", "id div 2000 * 7 start", "id div 2000 * 7 + 5 stop")
    y = spark.range(4000).selectExpr("id % 3000 k", "id % 9 start", "id % 9 + 2 stop")
    got = sweep.subtract(x, y, ["k"], 200_000)
    days = {}
    for r in got.collect():
        days.setdefault(r.k, set()).update(range(r.start, r.stop))
    cuts = {}
    for i in range(4000):
        cuts.setdefault(i % 3000, set()).update((i % 9, i % 9 + 1))
    assert days == {k: d for k in range(2000) if (d := (set(range(5)) | set(range(7, 12))) - cuts[k])}
    final = plan_of(got).split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Join" not in final


def test_digests_of_files_beyond_the_reader_of_whole_files(spark, tmp_path):
    """Longer files pass as lines in parts; whatever they hold, every byte counts once."""
    import gzip
    import hashlib

    from barloom.sources.bars import file_digests

    rng = np.random.default_rng(3)
    contents = {
        "random.parquet": rng.bytes(300_000), "few.bin": rng.choice(np.frombuffer(b"\n\ra", np.uint8), 150_001).tobytes(), "feeds": b"\n" * 9_000, "no_feed": b"x" * 70_000, "ended": b"ab\r\n" * 500 + b"\n",
        "mark.txt": b"\xef\xbb\xbf" + b"line\n" * 900, "mark only": b"\xef\xbb\xbf" * 700, "wide/row name.csv": b"\xff\xfe,\x00\n" * 1000 + b"end", "short": b"\n", "packed.gz": gzip.compress(rng.bytes(4000)),
    }
    (tmp_path / "wide").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    conf = {"spark.sql.sources.binaryFile.maxLength": "5000", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.execution.arrow.maxRecordsPerBatch": "300"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.path.removeprefix(f"file:{tmp_path}/"): (r.length, r.digest) for r in file_digests(spark, str(tmp_path), whole=1000).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in contents.items()}


def test_layers_of_large_tables_take_few_diagonals(spark, monkeypatch):
    """The strips had grown as fast as the rows, for none was to have more than 10 blocks; now only a cell that is too large makes more of them."""
    asked = []
    dealt = ranking._dealt

    def counted(*given):
        asked.append((out := dealt(*given))[1])
        return out

    monkeypatch.setattr(ranking, "_dealt", counted)
    rng = np.random.default_rng(5)
    spread = rng.permuted(np.tile(np.arange(300), (3, 1)), axis=1).T.astype(float)
    line = np.repeat(np.arange(150.0), 3).reshape(-1, 3)
    for v, tries in ((spread, 1), (line, 2)):
        asked.clear()
        df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(v)], "id long, x double, y double, z double")
        block = 4 if tries == 1 else 1
        found = {r.id: r.front for r in ranking.layers(df, ["x", "y", "z"], block=block).collect()}
        assert found == dict(enumerate(brute_layers(v).tolist())) and asked[-1] <= 10 * block
    assert ranking._strips(216_000_000, 50_000) < 60
