"""Calls of a paid service: each different request is asked once, whatever fails in between.

Answers go to a ledger, a folder of small Parquet files that tasks write while they ask. Requests that have an answer there
aren't asked again, neither by a later run nor by a second attempt of a lost task. A failing call is tried again after a
wait that doubles. A bucket of tokens for each task holds the rate of all tasks together. What has failed for good is a
row with its error, and is asked again by the next run.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.fs as pf
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: id: SHA-256 of the service's name and the request.
LEDGER = "id string, request string, answer string, error string, attempts int, run string, at double"
FIELDS = pa.schema([("id", pa.string()), ("request", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("attempts", pa.int32()), ("run", pa.string()), ("at", pa.float64())])


def opened(folder: str) -> tuple[pf.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return pf.FileSystem.from_uri("/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder)


class Bucket:
    """Tokens that come at `rate` a second, at most `burst` of them: take() waits until there is one."""

    def __init__(self, rate: float | None, burst: float = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, max(1.0, burst), clock, sleep
        self.tokens, self.last = self.burst, clock()

    def take(self) -> None:
        if not self.rate:
            return
        now = self.clock()
        self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        self.last = now
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.sleep(wait)
            self.tokens, self.last = 1, self.last + wait
        self.tokens -= 1


@dataclass(frozen=True)
class Policy:
    """How a service is asked. rate: calls a second of all tasks together, None for no limit; attempts: of a call, each after
    a wait that is twice the last one, up to longest_wait; parts: tasks that ask at once; flush: answers, or seconds, after
    which a task writes what it has."""

    rate: float | None = None
    burst: float = 1
    attempts: int = 3
    wait: float = 1.0
    longest_wait: float = 60.0
    parts: int = 8
    flush: int = 20
    flush_seconds: float = 5.0


@dataclass(frozen=True)
class Ledger:
    """The answers of one service in a folder that all executors share. ask takes a request's text and returns the answer's, or None."""

    ask: Callable[[str], str | None]
    folder: str
    service: str = "service"
    policy: Policy = Policy()

    def identity(self):
        return F.sha2(F.concat_ws("\0", F.lit(self.service), "request"), 256)

    def rows(self, spark) -> DataFrame:
        """(id, request, answer, error, attempts, run, at): all that tasks have written, failures too; requests of other services as well."""
        try:
            return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(self.folder)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], LEDGER)

    def _known(self, spark) -> DataFrame:
        """(id, answer) of requests that went well; of several, the first."""
        return self.rows(spark).where("error is null").groupBy("id").agg(F.min_by("answer", "at").alias("answer"))

    def answers(self, requests: DataFrame) -> DataFrame:
        """(request, answer, error) of the distinct texts in requests' column `request`, null ones left out.

        What the ledger has isn't asked. error is null where a call went well, if with no answer.
        """
        spark, run = requests.sparkSession, uuid.uuid4().hex
        wanted = requests.select("request").where("request is not null").distinct().withColumn("id", self.identity())
        left = wanted.join(self._known(spark).select("id"), "id", "left_anti").select("id", "request")
        fs, path = opened(self.folder)
        fs.create_dir(f"{path}/{run}")
        # an action that asks and keeps nothing but the ledger
        left.repartition(self.policy.parts, "id").mapInArrow(_asking(self, run), "n long").agg(F.sum("n")).first()
        failed = self.rows(spark).where((F.col("run") == run) & F.col("error").isNotNull()).groupBy("id").agg(F.max_by("error", "at").alias("error"))
        known = self._known(spark)
        made = wanted.join(known.withColumn("_ok", F.lit(True)), "id", "left").join(failed, "id", "left")
        return made.select("request", "answer", F.when(F.col("_ok").isNull(), F.col("error")).alias("error"))

    def failures(self, spark) -> DataFrame:
        """(request, error, attempts) of requests that have never been answered, by their last attempt."""
        rows = self.rows(spark)
        last = rows.where("error is not null").groupBy("id").agg(F.max_by(F.struct("request", "error", "attempts"), "at").alias("_l"))
        return last.join(self._known(spark).select("id"), "id", "left_anti").select("_l.request", "_l.error", "_l.attempts")

    def with_policy(self, **changes) -> Ledger:
        return replace(self, policy=replace(self.policy, **changes))


def call(ask: Callable[[str], str | None], request: str, policy: Policy, bucket: Bucket, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts) of one request. Each attempt takes a token."""
    wait, error = policy.wait, None
    for attempt in range(1, policy.attempts + 1):
        bucket.take()
        try:
            said = ask(request)
            return None if said is None else str(said), None, attempt
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        if attempt < policy.attempts:
            sleep(wait)
            wait = min(policy.longest_wait, 2 * wait)
    return None, error, policy.attempts


def _asking(ledger: Ledger, run: str):
    """Asks a task's requests. Answers are files in the run's folder, named by partition, which a second attempt reads first."""
    policy = ledger.policy

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(ledger.folder)
        part, bucket = TaskContext.get().partitionId(), Bucket(policy.rate and policy.rate / policy.parts, policy.burst)
        own = f"{path}/{run}/{part:06d}-"
        files = [f.path for f in fs.get_file_info(pf.FileSelector(f"{path}/{run}")) if f.path.startswith(own.lstrip("/")) or f.path.startswith(own)]
        done = {i for f in files for i, e in zip(*(pq.read_table(f, filesystem=fs, columns=["id", "error"]).to_pydict()[c] for c in ("id", "error")), strict=True) if e is None}
        held, last, n = [], time.monotonic(), 0

        def put() -> None:
            nonlocal held, last
            if held:
                name = f"{part:06d}-{uuid.uuid4().hex}.parquet"
                pq.write_table(pa.Table.from_pylist(held, FIELDS), f"{path}/{run}/_{name}", filesystem=fs)
                fs.move(f"{path}/{run}/_{name}", f"{path}/{run}/{name}")
            held, last = [], time.monotonic()

        try:
            for b in batches:
                for id_, request in zip(b["id"].to_pylist(), b["request"].to_pylist(), strict=True):
                    if id_ in done:
                        continue
                    answer, error, attempts = call(ledger.ask, request, policy, bucket)
                    held.append({"id": id_, "request": request, "answer": answer, "error": error, "attempts": attempts, "run": run, "at": time.time()})
                    n += 1
                    if len(held) >= policy.flush or time.monotonic() - last >= policy.flush_seconds:
                        put()
        finally:
            # what was paid for is kept, also if the task is stopped here
            put()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return go
