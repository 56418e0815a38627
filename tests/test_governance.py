import pytest
from pyspark.sql import functions as F

from barloom import governance as G
from barloom.errors import ContractError, LockboxError, SplitError, StateError
from barloom.operators import hashtree, splits
from tests.helpers import random_bars


def test_lockbox_opens_once(spark):
    bars = spark.createDataFrame(random_bars(420, 8))
    plan = splits.walk_forward(420, splits.SplitConfig(1, 60, 2, 40, 5, 2, 60, 100))
    e = G.Experiment("x")
    box = G.Lockbox(e, plan)
    with pytest.raises(LockboxError):
        box.open(bars, "me", "early")
    e.seal("split_plan_hash", G.digest_of(plan.rows()))
    e.seal("data_content_hash", G.content_digest(bars))
    with pytest.raises(StateError):
        e.move("SEALED")  # two seals are missing
    e.seal("config_hash", "c")
    e.seal("seed", "1")
    e.move("SEALED")
    with pytest.raises(StateError):
        e.move("FROZEN")
    for s in ("SEARCH_ACTIVE", "SHORTLISTED", "FROZEN"):
        e.move(s)
    with pytest.raises(StateError):
        e.move("DISCLOSED")  # only the lockbox does
    with pytest.raises(LockboxError):
        box.open(bars.limit(10), "me", "other data")
    assert box.open(bars, "me", "final").count() == 60
    with pytest.raises(LockboxError):
        box.open(bars, "me", "again")
    with pytest.raises(StateError):
        e.seal("split_plan_hash", "other")
    e.move("CLOSED_ACCEPTED")


def test_contracts(tmp_path):
    with pytest.raises(ContractError):
        G.forbid_lockbox({"a": [{"lockbox": 1}]})
    for key in ("sealed_test", "final_test", "holdout_metrics", "my_lockbox", "My_LockBox_2"):
        with pytest.raises(ContractError):
            G.forbid_lockbox({"a": ({"b": {key: 1}},)})
    G.forbid_lockbox({"lock": {"hold": ["lockbox"]}})
    good = dict(name="slow_trend", causal=True, inputs=["close"], output="zscore", lookback_parameters=["p"], complexity=3, hypothesis="h", failure_mode="f")
    assert G.check_proposal(good) == good
    for k, v in dict(name="X", causal=False, inputs=["future"], output="bool", lookback_parameters=[], complexity=0, hypothesis="", failure_mode="import os").items():
        with pytest.raises(ContractError):
            G.check_proposal(good | {k: v})
    G.write_once(str(tmp_path / "m"), {"a": 1})
    G.write_once(str(tmp_path / "m"), {"a": 1})
    with pytest.raises(StateError):
        G.write_once(str(tmp_path / "m"), {"a": 2})


def test_manifest_holds_whatever_the_partitioning(spark, tmp_path):
    bars = spark.createDataFrame(random_bars(120, 8))
    path = str(tmp_path / "manifest.json")
    G.write_once(path, G.manifest(bars))
    G.verify_manifest(path, bars.repartition(7))
    with pytest.raises(StateError):
        G.verify_manifest(path, bars.where("bar_idx > 0"))


def test_inner_purge_and_embargo_are_checked():
    c = splits.SplitConfig(1, 60, 2, 40, 5, 2, 60, 100)
    plan = splits.walk_forward(420, c)
    fold = plan.folds[0]
    for inner in (
        [fold.inner[0], (fold.inner[1][0], (fold.inner[1][1][0], fold.test[0] - 4))],  # too near to the outer test
        [fold.inner[0], ([(0, fold.inner[0][1][1] + 2)], fold.inner[1][1])],  # in the embargo after the first validation
    ):
        with pytest.raises(SplitError):
            splits.check_plan(splits.Plan(420, c, plan.lockbox, [splits.Fold(fold.train, fold.test, inner)]))


def test_hash_tree_names_the_changed_chunk(spark):
    bars = spark.createDataFrame(random_bars(300, 8, ("A", "B")))
    names = ["symbol"]
    before = hashtree.tree(bars, names, "bar_idx", size=16, fan=4)
    assert {r["level"]: r["n"] for r in before.groupBy("level").agg(F.count("*").alias("n")).collect()} == {0: 38, 1: 10, 2: 4, 3: 2}
    swap = F.when(F.col("symbol") == "B", F.when(F.col("bar_idx") == 100, 101).when(F.col("bar_idx") == 101, 100)).otherwise(None)
    swapped = bars.withColumn("bar_idx", F.coalesce(swap, F.col("bar_idx")).cast("long"))
    after = hashtree.tree(swapped.repartition(5), names, "bar_idx", size=16, fan=4)
    assert [tuple(r) for r in hashtree.changed_chunks(before, after, names).collect()] == [("B", 6)]
    assert hashtree.root(before, names) != hashtree.root(after, names) == hashtree.root(hashtree.tree(swapped, names, "bar_idx", size=16, fan=4), names)
    longer = hashtree.tree(bars.where("symbol = 'A' or bar_idx < 40"), names, "bar_idx", size=16, fan=4)
    assert {tuple(r) for r in hashtree.changed_chunks(before, longer, names).collect()} == {("B", k) for k in range(2, 19)}
    assert hashtree.root(hashtree.tree(bars.where("bar_idx < 0"), names, "bar_idx"), names) == ""
