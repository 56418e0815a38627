import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.errors import CompileError, ParseError, UnitError
from barloom.functions.expr import CLOSE, HIGH, LOW, OPEN, VOLUME, Node, Unit, const, n
from barloom.functions.ops import OPS, register
from barloom.plans.compiler import canonical, complexity, ema_array, evaluate, lookback, unit_of
from barloom.streaming.incremental import Evaluator, evaluate_sorted
from tests.helpers import random_bars

R = n("ret", CLOSE, period=1)
A, B = n("gt", CLOSE, OPEN), n("gt", HIGH, n("sma", HIGH, period=5))
ALL = {
    "close": CLOSE, "open": OPEN, "high": HIGH, "low": LOW, "volume": VOLUME, "constant": n("gt", CLOSE, const(100, "price")), "abs": n("abs", R), "neg": n("neg", R), "add": n("add", HIGH, LOW),
    "sub": n("sub", CLOSE, OPEN), "gt": A, "lt": n("lt", CLOSE, OPEN), "and": n("and", A, B), "or": n("or", A, B), "not": n("not", B), "cross_above": n("cross_above", CLOSE, n("sma", CLOSE, period=7)),
    "cross_below": n("cross_below", CLOSE, n("sma", CLOSE, period=7)), "sma": n("sma", CLOSE, period=5), "highest": n("highest", HIGH, period=8), "lowest": n("lowest", LOW, period=8), "stdev": n("stdev", CLOSE, period=9),
    "zscore": n("zscore", CLOSE, period=9), "rank": n("rank", CLOSE, period=9), "delta": n("delta", CLOSE, period=3), "ret": n("ret", CLOSE, period=3), "efficiency_ratio": n("efficiency_ratio", CLOSE, period=6),
    "rsi": n("rsi", CLOSE, period=6), "atr": n("atr", period=6), "chop": n("chop", period=6), "ema": n("ema", CLOSE, period=6),
}
NESTED = {"a": n("zscore", n("sub", n("ema", CLOSE, period=5), n("ema", CLOSE, period=12)), period=20), "b": n("sma", n("ret", CLOSE, period=2), period=4), "c": n("ema", n("delta", CLOSE, period=3), period=4), "d": n("rsi", n("sma", CLOSE, period=3), period=5)}


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(random_bars(120, 11, ("A", "B"))).repartition(3).cache()


def values(df, names):
    rows = df.orderBy("symbol", "bar_idx").toPandas()
    return {k: rows[k].astype(float).to_numpy() for k in names}


def test_every_operator_is_covered():
    assert set(ALL) == set(OPS)


def test_batch_equals_bar_at_a_time(spark, frame):
    named = {**ALL, **NESTED}
    a, b = values(evaluate(frame, named, ["symbol", "bar_idx"]), named), values(evaluate_sorted(frame, named), named)
    for k in named:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=1e-9, err_msg=k)


def test_no_operator_looks_ahead(spark, frame):
    named = {**ALL, **NESTED}
    whole = evaluate(frame, named, ["symbol", "bar_idx"]).where("bar_idx < 60")
    prefix = evaluate(frame.where("bar_idx < 60"), named, ["symbol", "bar_idx"])
    a, b = values(whole, named), values(prefix, named)
    for k in named:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-12, atol=1e-12, err_msg=k)


def test_missing_values(spark):
    rows = [("A", i, x) for i, x in enumerate([1.0, None, 3.0, 4.0, 5.0, None, 7.0, 9.0])]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, close double").selectExpr("*", "close open", "close high", "close low", "1.0D volume", "bar_idx ts")
    got = evaluate(df, {"s": n("sma", CLOSE, period=2), "d": n("delta", CLOSE, period=2), "n": n("not", n("gt", CLOSE, const(100, "price"))), "e": n("ema", CLOSE, period=3)}, ["bar_idx"]).orderBy("bar_idx").collect()
    assert [r.s for r in got] == [None, None, None, 3.5, 4.5, None, None, 8.0]
    assert [r.d for r in got] == [None, None, 2.0, None, 2.0, None, 2.0, None]
    assert all(r.n for r in got)
    assert [r.e for r in got] == [1.0, None, 2.0, 3.0, 4.0, None, 5.5, 7.25]
    assert np.nansum(ema_array(np.array([1, np.nan, 3.0]), 3)) == 3.0


@pytest.mark.parametrize(
    "bad",
    [n("abs", CLOSE), n("ret", VOLUME, period=1), n("add", CLOSE, VOLUME), n("gt", n("rank", CLOSE, period=3), R), n("gt", CLOSE, const(1, "zscore")), n("and", CLOSE, A), n("gt", n("delta", CLOSE, period=1), n("delta", CLOSE, period=1))],
)
def test_unit_errors(bad):
    with pytest.raises(UnitError):
        unit_of(bad)


@pytest.mark.parametrize("bad", [n("sma", CLOSE), n("sma", CLOSE, period=0), n("stdev", CLOSE, period=1), n("and", A), n("close", CLOSE), Node("nope"), Node("close", value=1.0), n("gt", CLOSE, OPEN, period=3), Node("constant", value=1.0)])
def test_structure_errors(bad):
    with pytest.raises((CompileError, UnitError)):
        unit_of(bad)


def test_registry_rejects_duplicates():
    with pytest.raises(CompileError):
        register("sma", OPS["sma"])


def test_json_round_trip():
    for node in [*ALL.values(), *NESTED.values()]:
        assert Node.of(node.to_dict()) == node
    for doc in (1, {}, {"op": "sma", "x": 1}, {"op": "sma", "period": 1.5}, {"op": "sma", "period": True}):
        with pytest.raises(ParseError):
            Node.of(doc)


def test_canonical_forms():
    assert canonical(n("neg", n("neg", R))) == R
    assert canonical(n("abs", n("neg", R))) == n("abs", R)
    assert canonical(n("and", n("and", A, B), A)) == canonical(n("and", B, A))
    assert canonical(n("and", A, A)) == A
    assert canonical(n("not", n("not", A))) == A
    assert canonical(n("and", n("lt", OPEN, CLOSE), A)) == A
    assert canonical(n("add", LOW, HIGH)) == canonical(n("add", HIGH, LOW))
    assert canonical(n("cross_below", CLOSE, OPEN)) == n("cross_above", OPEN, CLOSE)


def test_costs_of_expressions():
    assert lookback(n("sma", n("delta", CLOSE, period=3), period=5)) == 7
    assert lookback(n("cross_above", CLOSE, n("sma", CLOSE, period=10))) == 10
    assert complexity(n("gt", CLOSE, n("sma", CLOSE, period=3))) == 6
    assert unit_of(n("stdev", CLOSE, period=3)) is Unit.VOLATILITY


def test_one_sort_for_all_windows(frame):
    plan = evaluate(frame, {k: v for k, v in ALL.items() if k != "ema"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") <= 2


def test_stream_of_bars(spark, tmp_path):
    bars = random_bars(60, 5, ("A", "B"))
    for k, part in enumerate((bars[bars.bar_idx < 25], bars[bars.bar_idx >= 25])):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    from barloom.streaming.incremental import evaluate_stream

    named = {"s": n("sma", CLOSE, period=5), "x": n("cross_above", CLOSE, n("ema", CLOSE, period=4)), "a": n("atr", period=4)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = evaluate_stream(source, named).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = values(spark.read.parquet(str(tmp_path / "out")), named)
    want = values(evaluate(spark.createDataFrame(bars), named, ["symbol", "bar_idx"]), named)
    for k in named:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-9)


def test_evaluator_shares_states():
    e = Evaluator({"a": n("sma", CLOSE, period=3), "b": n("gt", CLOSE, n("sma", CLOSE, period=3))})
    assert sum(x.op == "sma" for x in e.order) == 1


@pytest.mark.parametrize("chunk", [4, 7, 33, 1000])
def test_chunks_shorter_and_longer_than_the_periods(spark, frame, chunk):
    named = {**ALL, **NESTED}
    a, b = values(evaluate(frame, named, ["symbol", "bar_idx"], chunk), named), values(evaluate_sorted(frame, named), named)
    for k in named:
        np.testing.assert_allclose(a[k], b[k], rtol=1e-9, atol=1e-9, err_msg=k)


@pytest.mark.parametrize("period", [1, 2, 9, 40, 500])
@pytest.mark.parametrize("missing", [0.0, 0.3, 0.97])
def test_recursive_averages_over_chunks(spark, period, missing):
    rng = np.random.default_rng(period)
    x = rng.normal(0, 5, 4000)
    x[rng.random(4000) < missing] = np.nan
    x[:50] = np.nan
    rows = [("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [(None, i, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, close double").repartition(5)
    want = ema_array(x, period)
    for chunk in (3, 100, 5000):
        got = evaluate(df, {"e": n("ema", CLOSE, period=period)}, ["symbol", "bar_idx"], chunk).orderBy("symbol", "bar_idx").toPandas()
        np.testing.assert_allclose(got[got.symbol.notna()].e.to_numpy(float), want, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(got[got.symbol.isna()].e.to_numpy(float), ema_array(np.arange(30.0), period), rtol=1e-9)


def test_no_partition_holds_a_whole_series(spark):
    df = spark.range(64_000).selectExpr("concat('A', id % 1) symbol", "id bar_idx", "id ts", *(f"1.0D + id % 7 {c}" for c in ("open", "high", "low", "close", "volume")))
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for named in ({"z": n("zscore", CLOSE, period=20)}, {"e": n("ema", CLOSE, period=10)}):
            out = evaluate(df, named, ["symbol", "bar_idx"], 1000)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "MapInArrow" not in plan and "SinglePartition" not in plan
            held = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(held) == 64_000 and len(held) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(held) < 40_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
