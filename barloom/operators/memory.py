"""Append-only event memory and what is read from it: outcomes, lessons, lineage, retrieval."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import MemoryError_
from barloom.operators.ordinals import ordinals
from barloom.session import checkpoint_dir

KINDS = ("candidate_evaluated", "lesson_added", "generation_closed", "intervention", "experiment_closed")
EVENTS = "batch string, n long, ts_utc string, kind string, payload string"
PAYLOAD = "genome_hash string, operator string, context string, reward boolean, failure_labels array<string>"


class EventLog:
    """An append-only log; nothing rewrites or deletes rows, and a batch is written exactly once.

    Rows go to a folder of their own, `data/part=<uuid>`; a batch counts when
    its commit, a file named after the batch that says which part holds it,
    has been put in place by a rename that fails where one exists.  A writer
    that dies leaves a part that no commit names; one that repeats a batch, or
    races with another over it, finds the commit and drops its own part.  Ids
    come from the batch and the row's number in it, so writers need not count.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._context = None

    def append(self, kind: str, payload: dict) -> str:
        return self.append_many([(kind, payload)])[0]

    def append_many(self, events: list[tuple[str, dict]], batch: str | None = None) -> list[str]:
        """The ids of the events; a repeated `batch` writes nothing. Without a name the batch is a new one."""
        for kind, _ in events:
            if kind not in KINDS:
                raise MemoryError_("unknown kind of event", kind=kind)
        batch = batch or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        texts = [(n, kind, json.dumps(payload, sort_keys=True, separators=(",", ":"))) for n, (kind, payload) in enumerate(events)]
        rows = self.spark.createDataFrame(texts, "n long, kind string, payload string").coalesce(1)
        self._write(batch, rows)
        return [event_id(batch, n) for n, _, _ in texts]

    def append_frame(self, batch: str, rows: DataFrame) -> bool:
        """Writes rows of kind and payload as one batch; false if it had been written before.

        For `foreachBatch`, name the batch after the query and the epoch.
        """
        if self.committed(batch):
            return False
        if rows.where(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))).head() is not None:
            raise MemoryError_("unknown kind of event", batch=batch)
        return self._write(batch, ordinals(rows.select("kind", "payload"), ["kind", "payload"], "n", 0))

    def committed(self, batch: str) -> bool:
        return self._files().util().exists(self._hadoop(self._commit(batch)))

    def _write(self, batch: str, rows: DataFrame) -> bool:
        if self.committed(batch):
            return False
        part = uuid.uuid4().hex
        now = datetime.now(timezone.utc).isoformat()
        rows.select(F.lit(batch).alias("batch"), "n", F.lit(now).alias("ts_utc"), "kind", "payload").write.parquet(f"{self.path}/data/part={part}")
        return self._put(batch, part)

    def _put(self, batch: str, part: str) -> bool:
        """Commits a part for a batch, unless another one is."""
        jvm, files = self.spark._jvm, self._files()
        fresh = f"{self.path}/_fresh/{part}"
        self.spark.createDataFrame([(batch, part)], "batch string, part string").coalesce(1).write.json(fresh)
        written = [s.getPath() for s in files.util().listStatus(self._hadoop(fresh)) if s.getPath().getName().startswith("part-")]
        files.mkdir(self._hadoop(f"{self.path}/commits"), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
        try:
            files.rename(written[0], self._hadoop(self._commit(batch)), self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            files.delete(self._hadoop(f"{self.path}/data/part={part}"), True)
            return False
        finally:
            files.delete(self._hadoop(fresh), True)
        return True

    def _commit(self, batch: str) -> str:
        return f"{self.path}/commits/{hashlib.sha256(batch.encode()).hexdigest()}.json"

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        if self._context is None:
            conf = self.spark._jsparkSession.sessionState().newHadoopConf()
            uri = self._hadoop(self.path).getFileSystem(conf).makeQualified(self._hadoop(self.path)).toUri()
            self._context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf)
        return self._context

    def events(self, kind: str | None = None) -> DataFrame:
        """id, batch, n, ts_utc, kind, payload of all committed batches; the filter on kind reaches the scan."""
        if kind is not None and kind not in KINDS:
            raise MemoryError_("unknown kind of event", kind=kind)
        if not self._files().util().exists(self._hadoop(f"{self.path}/commits")):
            rows = self.spark.createDataFrame([], f"{EVENTS}, part string")
        else:
            rows = self.spark.read.schema(f"{EVENTS}, part string").parquet(f"{self.path}/data")
            commits = self.spark.read.schema("batch string, part string").json(f"{self.path}/commits")
            rows = rows.join(commits.select("part"), "part", "left_semi")
        rows = rows.where(F.col("kind") == kind) if kind else rows
        return rows.select(F.concat("batch", F.lit(":"), F.lpad(F.col("n").cast("string"), 12, "0")).alias("id"), "batch", "n", "ts_utc", "kind", "payload")

    def count(self, kind: str | None = None) -> int:
        return self.events(kind).count()


def event_id(batch: str, n: int) -> str:
    return f"{batch}:{n:012d}"


def payloads(events: DataFrame) -> DataFrame:
    return events.withColumn("p", F.from_json("payload", PAYLOAD)).select("id", "kind", "p.*")


def operator_outcomes(evaluated: DataFrame) -> DataFrame:
    """context, operator, successes, trials, and the posterior mean of a uniform prior."""
    got = evaluated.where("reward is not null").groupBy("context", "operator").agg(F.count_if("reward").alias("successes"), F.count(F.lit(1)).alias("trials"))
    return got.withColumn("posterior_mean", (F.col("successes") + 1) / (F.col("trials") + 2))


def failure_label_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.select("context", F.explode("failure_labels").alias("label")).groupBy("context", "label").agg(F.count(F.lit(1)).alias("n"))


def top_failure_labels(counts: DataFrame, k: int = 6) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("context").orderBy(F.desc("n"), "label"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= k)


def active_lessons(lessons: DataFrame, k: int = 5) -> DataFrame:
    """The k best lessons of each context that no other supersedes.

    `lessons`: lesson_id, contexts (array), confidence, evidence_count, active, supersedes.
    """
    gone = lessons.where("supersedes is not null").select(F.col("supersedes").alias("lesson_id"))
    live = lessons.where("active").join(gone, "lesson_id", "left_anti").select("lesson_id", F.explode("contexts").alias("context"), "confidence", "evidence_count")
    nth = F.row_number().over(W.partitionBy("context").orderBy(F.desc("confidence"), F.desc("evidence_count"), "lesson_id"))
    return live.withColumn("nth", nth).where(F.col("nth") <= k)


def lineage_roots(links: DataFrame, depth: int = 64) -> DataFrame:
    """node, root: the first ancestor along first parents, `depth` steps at most.

    `links`: node, parent (null for roots).  Pointers are doubled, so the
    number of joins is the logarithm of the depth; each doubling starts from a
    checkpoint, so that the plan does not double with them.
    """
    checkpoint_dir(links.sparkSession)
    at = links.select("node", F.coalesce("parent", "node").alias("root")).checkpoint()
    step = 1
    while step < depth:
        up = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
        at = at.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")).checkpoint()
        step *= 2
    return at


def lineage_concentration(roots: DataFrame) -> DataFrame:
    n = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("concentration"))


def lineage_records(links: DataFrame) -> DataFrame:
    """record: every link as a line of JSON with sorted keys, for `write.text`."""
    return links.select(F.to_json(F.struct(*sorted(links.columns)), {"ignoreNullFields": "false"}).alias("record"))


def context_key(volatility, trend, regime):
    """What is known of a series in one key: volatility and trend in two steps each, and the regime; without a volatility only the regime."""
    level = F.when(volatility > 0.01, "hivol").otherwise("lovol")
    shape = F.when(trend > 0.3, "trendy").otherwise("choppy")
    return F.concat(F.when(volatility.isNull(), "anyfp").otherwise(F.concat(level, F.lit("_"), shape)), F.lit("|"), regime)
