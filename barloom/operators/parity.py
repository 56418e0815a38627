"""Differences between two runs' signals and trades, and the CSV forms they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIGNALS = "time long, entry_long string, entry_short string, allow string, atr double"
TRADES = "open_time long, close_time long, direction int, lots double, entry_price double, exit_price double, sl double, tp double, exit_reason string"


def read_signals(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """`;`-separated with a checked header; a malformed row raises.  `by`: columns whose values are in the folders' names."""
    by = by or []
    rows = spark.read.schema(", ".join([SIGNALS, *(f"`{c}` string" for c in by)])).option("sep", ";").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return rows.select(*by, "time", *((F.col(c) == "1").alias(c) for c in ("entry_long", "entry_short", "allow")), "atr")


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRADES).option("sep", ";").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_signals(signals: DataFrame, path: str, by: list[str] | None = None) -> None:
    flag = lambda c: F.when(F.col(c), "1").otherwise("0").alias(c)
    rows = signals.select(*(by or []), "time", flag("entry_long"), flag("entry_short"), flag("allow"), F.format_string("%.10f", "atr").alias("atr"))
    rows.write.partitionBy(*(by or [])).option("sep", ";").option("header", True).csv(path)


def write_trades(trades: DataFrame, path: str) -> None:
    price = [F.format_string("%.10f", c).alias(c) for c in ("entry_price", "exit_price", "sl", "tp")]
    trades.select("open_time", "close_time", "direction", F.format_string("%.2f", "lots").alias("lots"), *price, "exit_reason").write.option("sep", ";").option("header", True).csv(path)


def signal_differences(ours: DataFrame, theirs: DataFrame, keys: list[str], flags: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """keys, field, ours, theirs (as text) of each disagreement; a row that the other side lacks is `missing`."""
    o = ours.select(*keys, *(F.col(c).alias(f"o_{c}") for c in (*flags, *values)))
    t = theirs.select(*keys, F.lit(True).alias("_there"), *(F.col(c).alias(f"t_{c}") for c in (*flags, *values)))
    both = o.join(t, keys, "left")
    there = F.coalesce("_there", F.lit(False))
    item = lambda field, bad, a, b: F.when(bad, F.struct(F.lit(field).alias("field"), a.cast("string").alias("ours"), b.cast("string").alias("theirs")))
    cases = [item("missing", ~there, F.lit(None), F.lit(None))]
    cases += [item(c, there & ~F.col(f"o_{c}").eqNullSafe(F.col(f"t_{c}")), F.col(f"o_{c}"), F.col(f"t_{c}")) for c in flags]
    for c in values:
        x, y = F.col(f"o_{c}"), F.col(f"t_{c}")
        far = F.coalesce(F.abs(x - y) > tolerance, x.isNull() != y.isNull())
        cases.append(item(c, there & far, F.round(x, 6), F.round(y, 6)))
    return both.select(*keys, F.explode(F.filter(F.array(*cases), lambda d: d.isNotNull())).alias("d")).select(*keys, "d.*")


def trade_differences(ours: DataFrame, theirs: DataFrame, by: str, order: str, fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Trades matched by their ordinal: field by field, and one `count` row where the numbers differ."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(order))
    o = ours.withColumn("nth", nth).select(by, "nth", *(F.col(c).cast("double").alias(f"o_{c}") for c in fields))
    t = theirs.withColumn("nth", nth).select(by, "nth", *(F.col(c).cast("double").alias(f"t_{c}") for c in fields))
    cases = [F.when(F.abs(F.col(f"o_{c}") - F.col(f"t_{c}")) > tolerance, F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("ours"), F.col(f"t_{c}").alias("theirs"))) for c in fields]
    rows = o.join(t, [by, "nth"]).select(by, "nth", F.explode(F.filter(F.array(*cases), lambda d: d.isNotNull())).alias("d")).select(by, "nth", "d.*")
    n = lambda df, name: df.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias(name))
    counts = n(ours, "ours").join(n(theirs, "theirs"), by, "full").na.fill(0.0, ["ours", "theirs"]).where("ours <> theirs")
    return rows.unionByName(counts.select(by, F.lit(0).alias("nth"), F.lit("count").alias("field"), "ours", "theirs"))


def verdict(n_rows: int | None, n_differences: int) -> str:
    """PENDING without rows of the other side, else PASS or FAIL."""
    return "PENDING" if not n_rows else "PASS" if n_differences == 0 else "FAIL"
