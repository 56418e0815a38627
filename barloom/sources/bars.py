"""Bar tables: from events, from JSON exports, and slices of them.

A bar table has symbol, bar_idx (position in the series), ts (epoch seconds),
open, high, low, close, volume and, where known, spread_points.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import SourceError
from barloom.session import parts, ship

#: Minutes in JSON exports count from 2000-01-01.
EPOCH_2000 = 946_684_800
BAR_JSON = (
    "ver string, terminal string, company string, server string, symbol string, description string, period string, baseCurrency string, priceIn string,"
    " lotSize double, stopLevel double, minLot double, maxLot double, lotStep double, spread double, digits int, bars int, swapLong double, swapShort double,"
    " commissionType string, commission double, pointValue double, point double, pip double,"
    " time array<bigint>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>, spreads array<double>"
)
_SERIES = ("time", "open", "high", "low", "close", "volume")


def series(order: str = "bar_idx"):
    """The window of one series in order."""
    return W.partitionBy("symbol").orderBy(order)


def bars_from_events(events: DataFrame, symbol: str = "event_type", seconds: int = 3600) -> DataFrame:
    """OHLC bars of `seconds` from (ts, event_id, value); the volume is the number of events.

    One aggregation with map-side partial results; only bars reach the shuffle.
    """
    epoch = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    at = F.struct("ts", "event_id")
    out = (
        events.where("ts is not null and value is not null")
        .groupBy(F.col(symbol).alias("symbol"), (epoch - F.pmod(epoch, F.lit(seconds))).alias("ts_s"))
        .agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    )
    idx = F.row_number().over(W.partitionBy("symbol").orderBy("ts_s")) - 1
    return out.select("symbol", idx.cast("long").alias("bar_idx"), F.col("ts_s").alias("ts"), "open", "high", "low", "close", "volume")


def read_bar_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Bars of every JSON export at `path` (a file each, or a line each: `lines`); raises where a document's arrays disagree with its declared count.

    The position in the arrays is the bar index: the order is never taken from
    the times, so a broken order stays visible to the quality checks.
    """
    docs = spark.read.schema(BAR_JSON).option("multiLine", not lines).json(path)
    sizes = [F.size(c) for c in _SERIES]
    wrong = docs.where(~(F.coalesce(F.least(*sizes) == F.greatest(*sizes), F.lit(False)) & F.coalesce(F.col("bars") == F.size("time"), F.lit(True))))
    bad = wrong.select("symbol").head()
    if bad is not None:
        raise SourceError("arrays missing, of different lengths, or not of the declared number", symbol=bad[0])
    spreads = F.when(F.size("spreads") == F.size("time"), F.col("spreads"))
    zipped = F.arrays_zip(*(F.col(c) for c in _SERIES))
    rows = docs.select("symbol", spreads.alias("sp"), F.posexplode(zipped).alias("bar_idx", "b"))
    return rows.select(
        "symbol",
        F.col("bar_idx").cast("long").alias("bar_idx"),
        (F.col("b.time") * 60 + EPOCH_2000).alias("ts"),
        *(F.col(f"b.{c}").alias(c) for c in _SERIES[1:]),
        F.get("sp", F.col("bar_idx")).alias("spread_points"),
    )


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """One row of contract metadata for each export; unknown values are null (a zero swap on both sides is unknown)."""
    d = spark.read.schema(BAR_JSON).option("multiLine", True).json(path)
    unknown = (F.col("swapLong") == 0) & (F.col("swapShort") == 0)
    return d.select(
        "symbol",
        F.col("baseCurrency").alias("base_currency"),
        F.col("priceIn").alias("quote_currency"),
        F.col("point").alias("tick_size"),
        "digits",
        F.col("lotSize").alias("lot_size"),
        F.col("minLot").alias("min_lot"),
        F.col("maxLot").alias("max_lot"),
        F.col("lotStep").alias("lot_step"),
        "commission",
        F.col("commissionType").alias("commission_mode"),
        F.col("spread").alias("static_spread_points"),
        F.lit("static_header").alias("spread_source"),
        F.when(~unknown, F.col("swapLong")).alias("swap_long"),
        F.when(~unknown, F.col("swapShort")).alias("swap_short"),
        F.lit(None).cast("double").alias("min_notional"),
    )


def discover(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """symbol, period and number of bars of each readable export under a folder; others are left out."""
    d = spark.read.schema(BAR_JSON + ", _corrupt string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = F.col("symbol").isNotNull() & F.col("period").isNotNull() & F.col("time").isNotNull() & F.col("close").isNotNull()
    return d.where(ok).select("symbol", "period", F.size("time").alias("n_bars"))


def slice_bars(bars: DataFrame, start: int, stop: int, rebase: bool = False) -> DataFrame:
    """Bars of [start, stop); the filter reaches the scan."""
    if not 0 <= start <= stop:
        raise SourceError("bad slice", start=start, stop=stop)
    out = bars.where((F.col("bar_idx") >= start) & (F.col("bar_idx") < stop))
    return out.withColumn("bar_idx", F.col("bar_idx") - start) if rebase else out


def tail_bars(bars: DataFrame, n: int) -> DataFrame:
    """The latest n bars of each symbol."""
    return bars.withColumn("_n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_idx")))).where(F.col("_n") <= n).drop("_n")


def research_view(bars: DataFrame, lockbox_share: float = 0.2) -> DataFrame:
    """All bars before the held-out tail of each symbol."""
    n = F.count(F.lit(1)).over(W.partitionBy("symbol"))
    return bars.withColumn("_n", n).where(F.col("bar_idx") < F.floor(F.col("_n") * (1 - lockbox_share))).drop("_n")


def _utc(ts: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {ts}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")


def iso_text(ts: str) -> Column:
    """Epoch seconds as ISO text in UTC."""
    return F.date_format(_utc(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def dotted_text(ts: str) -> Column:
    """Epoch seconds as dates of exports are written."""
    return F.date_format(_utc(ts), "yyyy.MM.dd HH:mm")


#: Files of more bytes pass a task as a stream.
WHOLE_FILE = 64 << 20
#: Names that Spark's reader of lines takes for compressed text.
_CODED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")


def _pieces(batches):
    """file, start, number, size, content of what each batch has of a part of a file; a line feed ends each line, the last one too."""
    now, number = None, 0
    for batch in batches:
        part = np.column_stack([batch.column(c).to_numpy() for c in (0, 1)])
        begins = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]).any(axis=1)])) if len(part) else []
        for a, b in zip(begins, [*begins[1:], len(part)]):
            file, start = part[a].tolist()
            now, number = (file, start), number + 1 if now == (file, start) else 0
            lines = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(3).slice(a, b - a))
            content = pc.binary_join(lines, pa.scalar(b"\n", pa.binary()))[0].as_py() + b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (file, start, number, batch.column(2)[a].as_py())] + [pa.array([content], pa.binary())], ["file", "start", "number", "size", "content"])


def _stream_digests(batches):
    """file, digest of files whose pieces follow one another in order."""
    now, size, read, ways = None, 0, 0, {}

    def finish():
        # the reader drops a byte order mark and does not tell whether a line feed ends the file
        for mark, digest in ways.items():
            if size - read - len(mark) in (-1, 0):
                digest.update(b"\n" * (size - read - len(mark) + 1))
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["file", "digest"])
        raise SourceError("a file was read to another length than it has", size=size, read=read)

    for batch in batches:
        for i in range(batch.num_rows):
            file, content = batch.column(0)[i].as_py(), memoryview(batch.column(4)[i].as_buffer())
            if file != now:
                if ways:
                    yield finish()
                now, size, read, ways = file, batch.column(3)[i].as_py(), 0, {mark: hashlib.sha256(mark) for mark in (b"", b"\xef\xbb\xbf")}
            for digest in ways.values():
                digest.update(b"\n" if read else b"")
                digest.update(content[:-1])
            read += len(content)
    if ways:
        yield finish()


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """path, length, digest (SHA-256) of every file that is not empty.

    Files of up to `whole` bytes are held whole where they are read.  The digest of a
    longer one is a chain over its bytes: its parts are read in many tasks, as
    lines whatever it holds, and their pieces pass one task in order, a batch at a
    time.  Longer files that are named as compressed ones, which Spark would unpack, are held whole, 2 GB at most.
    """

    def files(**options):
        return spark.read.format("binaryFile").options(recursiveFileLookup=True, **options).load(path)

    ship(spark)
    held = files().where(F.col("length") <= whole).unionByName(files(pathGlobFilter="*.{%s}" % ",".join(_CODED)).where(F.col("length") > whole))
    m = F.col("_metadata")
    lines = spark.read.options(recursiveFileLookup=True, lineSep="\n").text(path).where((m["file_size"] > whole) & ~m["file_path"].rlike(r"\.(%s)$" % "|".join(_CODED)))
    lines = lines.select(F.xxhash64(m["file_path"]).alias("file"), m["file_block_start"].alias("start"), m["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))
    pieces = lines.mapInArrow(_pieces, "file long, start long, number long, size long, content binary")
    ordered = pieces.repartition(parts(spark), "file").sortWithinPartitions("file", "start", "number")
    streamed = ordered.mapInArrow(_stream_digests, "file long, digest string")
    named = files().where(F.col("length") > whole).select("path", "length", F.xxhash64(m["file_path"]).alias("file"))
    return held.select("path", "length", F.sha2("content", 256).alias("digest")).unionByName(named.join(streamed, "file").select("path", "length", "digest"))
