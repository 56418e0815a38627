import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.errors import MemoryError_, QualityError, SourceError, SplitError
from barloom.operators import memory, parity, quality, ranking, regimes, splits, stats
from barloom.sources import bars as B
from tests.helpers import random_bars


def report(df):
    return {r.check: (r.passed, r.offending) for r in quality.quality_report(df, 3600, 0.01).collect()}


def test_quality_of_clean_and_broken_bars(spark):
    pdf = random_bars(100, 3)
    assert all(ok for k, (ok, _) in report(spark.createDataFrame(pdf)).items() if quality.CHECKS[k] == "error")
    hole = pdf.copy()
    hole.loc[50:, "ts"] += 5 * 3600
    df = spark.createDataFrame(hole)
    assert report(df)["gap_census"] == (False, 1)
    assert [(r.bar_idx, r.missing) for r in quality.gap_census(df, 3600).collect()] == [(50, 5)]
    cheap = pdf.copy()
    cheap[["open", "high", "low", "close"]] *= 0.005 / 100
    assert report(spark.createDataFrame(cheap))["price_quantization"] == (False, 100)
    bad = pdf.copy()
    bad.loc[10, "high"], bad.loc[11, "ts"], bad.loc[12, "close"] = 1.0, bad.loc[10, "ts"], float("nan")
    got = report(spark.createDataFrame(bad))
    assert not got["no_duplicate_timestamps"][0] and not got["finite_values"][0] and not got["ohlc_invariants"][0]
    with pytest.raises(QualityError):
        quality.require_quality(spark.createDataFrame(bad), 3600, 0.01)


def test_json_exports(spark, tmp_path):
    pdf = random_bars(5, 1)
    doc = {"symbol": "X", "period": "H1", "bars": 5, "swapLong": 0, "swapShort": 0, "time": [i * 60 for i in range(5)], "spreads": [1, 2, 3, 4, 5], "lotSize": 1000, "point": 0.01}
    doc |= {c: pdf[c].tolist() for c in ("open", "high", "low", "close", "volume")}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    rows = B.read_bar_json(spark, str(tmp_path / "x.json")).orderBy("bar_idx").collect()
    assert len(rows) == 5 and rows[1].ts == B.EPOCH_2000 + 3600 and rows[4].spread_points == 5
    assert B.read_instruments(spark, str(tmp_path / "x.json")).first().swap_long is None
    (tmp_path / "y.json").write_text("{broken")
    assert [r.symbol for r in B.discover(spark, str(tmp_path)).collect()] == ["X"]
    (tmp_path / "z.json").write_text(json.dumps(doc | {"bars": 6}))
    with pytest.raises(SourceError):
        B.read_bar_json(spark, str(tmp_path / "z.json"))


def test_split_plans():
    assert splits.subtract([(0, 100)], [(10, 20), (90, 200)]) == [(0, 10), (20, 90)]
    c = splits.SplitConfig(4, 500, 3, 300, 50, 20, 1500, 2000)
    plan = splits.walk_forward(10_000, c)
    assert plan.lockbox == (8500, 10_000) and len(plan.folds) == 4 and plan.folds[-1].test[1] == 8450
    with pytest.raises(SplitError):
        splits.walk_forward(4000, c)
    leaking = splits.Plan(plan.n_bars, c, plan.lockbox, [splits.Fold([(0, plan.folds[0].test[0])], plan.folds[0].test, [])])
    with pytest.raises(SplitError):
        splits.check_plan(leaking)
    cv = splits.combinatorial(1200, 6, 2, 10, 5)
    assert len(cv) == 15
    for train, tests in cv:
        assert not any(splits.overlaps(a, (t[0] - 10, t[1] + 5)) for a in train for t in tests)


@pytest.mark.parametrize("labels, dwell, want", [([1] * 20 + [3] * 3 + [1] * 20, 6, {20: 1, 42: 1}), ([1] * 20 + [3] * 20, 6, {24: 1, 25: 3}), ([1] * 20 + [0] * 10 + [1] * 10, 3, {25: 1, 39: 1})])
def test_dwell(spark, labels, dwell, want):
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(labels)], "symbol string, bar_idx long, raw int")
    got = {r.bar_idx: r.regime for r in regimes.dwell(df, dwell).collect()}
    assert {k: got[k] for k in want} == want


def automaton(raw, d):
    out, committed, challenger, streak = [], 0, 0, 0
    for x in raw:
        if x and x != committed:
            challenger, streak = (x, streak + 1) if x == challenger else (x, 1)
            if streak >= d:
                committed, challenger, streak = x, 0, 0
        else:
            challenger, streak = 0, 0
        out.append(committed)
    return out


def test_dwell_equals_the_automaton(spark):
    raw = np.random.default_rng(5).choice(5, 2000, p=[0.1, 0.4, 0.3, 0.1, 0.1]).tolist()
    raw = [x for x in raw for _ in range(2)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(raw)], "symbol string, bar_idx long, raw int")
    assert [r.regime for r in regimes.dwell(df, 5).orderBy("bar_idx").collect()] == automaton(raw, 5)


def test_overfitting_of_noise_and_of_an_edge(spark):
    rng = np.random.default_rng(0)
    for edge, low, high in ((0.0, 0.2, 0.9), (0.5, 0.0, 0.2)):
        m = rng.normal(0, 1, (120, 8))
        m[:, 0] += edge
        df = spark.createDataFrame([(t, f"c{c}", float(m[t, c])) for t in range(120) for c in range(8)], "t long, cand string, ret double")
        assert low <= stats.overfitting_probability(stats.cscv(df, 6)).first().pbo <= high


def test_effective_trials_equals_the_spectrum(spark):
    m = np.random.default_rng(1).normal(0, 1, (60, 5))
    m[:, 4] = m[:, 0]
    df = spark.createDataFrame([(t, f"c{c}", float(m[t, c])) for t in range(60) for c in range(5)], "t long, cand string, ret double")
    e = np.linalg.eigvalsh(np.corrcoef(m, rowvar=False))
    assert stats.effective_trials(df).first().n_effective == pytest.approx(e.sum() ** 2 / (e**2).sum())


def test_sharpe_probabilities():
    assert stats.probabilistic_sharpe(0.2, 0.0, 3.0, 100) > 0.9
    assert stats.probabilistic_sharpe(None, 0.0, 3.0, 100) == 0.0
    assert stats.expected_max_sharpe(1.0, 1.0) == 0.0 < stats.expected_max_sharpe(100.0, 1.0)


def test_concentration(spark):
    df = spark.createDataFrame([("A", x) for x in (80.0, 15.0, 5.0, -30.0)], "symbol string, pnl double")
    r = stats.return_concentration(df).first()
    assert (r.top1_share, r.top3_share, r.hhi, r.net) == (pytest.approx(0.8), pytest.approx(1.0), pytest.approx(0.665), 70.0)


def test_pareto_and_hypervolume(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.9, 1.1), ("c", 0.5, 0.5), ("d", 0.1, 0.1)], "candidate string, x double, y double")
    for most in (20_000, 0):
        assert {r.candidate: r.front for r in ranking.fronts(df, ("x", "y"), most_local=most).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2}
    p = spark.createDataFrame([(0.5, -0.5), (0.0, 0.0)], "x double, y double")
    assert ranking.hypervolume(p, "x", "y").first().hypervolume == pytest.approx(1.25)


def test_event_log(spark, tmp_path):
    log = memory.EventLog(spark, str(tmp_path / "log"))
    assert log.count() == 0
    one = log.append("candidate_evaluated", {"operator": "jitter", "context": "c", "reward": True, "failure_labels": ["OVERFIRE"]})
    two = log.append_many([("candidate_evaluated", {"operator": "jitter", "context": "c", "reward": False, "failure_labels": []}), ("lesson_added", {})])
    assert sorted(r.id for r in log.events().collect()) == [one, *two]
    with pytest.raises(MemoryError_):
        log.append("other", {})
    got = memory.operator_outcomes(memory.payloads(log.events("candidate_evaluated"))).first()
    assert (got.successes, got.trials, got.posterior_mean) == (1, 2, 0.5)


def test_event_log_writes_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "log")
    a, b = memory.EventLog(spark, path), memory.EventLog(spark, path)
    rows = spark.createDataFrame([("lesson_added", f'{{"n":{i}}}') for i in range(50)], "kind string, payload string").repartition(4)
    assert a.append_frame("q-0", rows) and not a.append_frame("q-0", rows) and not b.append_frame("q-0", rows)
    assert b.append_frame("q-1", rows.limit(3))
    # two writers that both saw no commit: the second one's part is dropped
    b.committed = lambda batch: False
    assert not b.append_frame("q-1", rows)
    # a writer that died before its commit
    spark.createDataFrame([("q-2", 0, "t", "lesson_added", "{}")], memory.EVENTS).write.parquet(f"{path}/data/part=dead")
    got = a.events().collect()
    assert len(got) == 53 and len({r.id for r in got}) == 53 and sorted(r.n for r in got if r.batch == "q-0") == list(range(50))
    assert a.append_many([("lesson_added", {})], batch="q-1") and a.count() == 53
    with pytest.raises(MemoryError_):
        a.append_frame("q-3", rows.selectExpr("'other' kind", "payload"))


def test_event_log_of_a_stream(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("lesson_added", str(k))], "kind string, payload string").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    log = memory.EventLog(spark, str(tmp_path / "log"))
    source = spark.readStream.schema("kind string, payload string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def write(frame, epoch):
        log.append_frame(f"s-{epoch}", frame)
        log.append_frame(f"s-{epoch}", frame)  # as after a failure

    source.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.payload for r in log.events().collect()) == ["0", "1"]


def test_lineage(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None)], "node long, parent long")
    roots = memory.lineage_roots(df)
    assert {r.node: r.root for r in roots.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    assert memory.lineage_concentration(roots).first().concentration == pytest.approx(0.8)


def test_parity_csv_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(1, True, False, True, 1.25), (2, False, False, True, None)], "time long, entry_long boolean, entry_short boolean, allow boolean, atr double")
    parity.write_signals(s.na.fill(0.0), str(tmp_path / "s"))
    back = parity.read_signals(spark, str(tmp_path / "s"))
    assert parity.signal_differences(s.na.fill(0.0), back, ["time"], ["entry_long", "entry_short", "allow"], ["atr"]).count() == 0
    diff = parity.signal_differences(s, back.where(F.col("time") == 1), ["time"], ["entry_long"], ["atr"]).collect()
    assert [(d.time, d.field) for d in diff] == [(2, "missing")]
    assert (parity.verdict(0, 0), parity.verdict(2, 0), parity.verdict(2, 1)) == ("PENDING", "PASS", "FAIL")
