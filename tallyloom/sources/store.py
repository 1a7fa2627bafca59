"""Stored runs: jobs, their orders and training records, committed together and laid out by job.

Orders and records of a run are written first, into a folder of their own within the slot of their job. The job's row comes
last and names that folder: it is the commit. Readers go by the jobs' rows, so that a run that failed half-way isn't there,
and a job that is stored again is replaced. A job's rows are found by their folder's path, and no other folder is listed or
read; a user's jobs are in the user's slot.
"""

from __future__ import annotations

import time
import uuid
import zlib
from dataclasses import dataclass

import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyloom.operators.calls import opened
from tallyloom.sources.schemas import ORDERS

#: Folders that jobs, or users, are dealt into.
SLOTS = 256
JOBS = "id string, user_id string, title string, live_start_time string, model string, created_at string, run string, total_orders long, committed long"
TABLES = {
    "extracted_orders": ", ".join(f"{n} {t}" for n, t in ORDERS.items()),
    "training_data": "job_id string, user_id string, chat_filename string, catalog_json string, chat_json string, predicted_json string, is_verified boolean, created_at string",
}


def slot(value: str) -> int:
    return zlib.crc32(value.encode()) % SLOTS


@dataclass(frozen=True)
class Store:
    """A folder of stored runs. Those who write at the same time don't disturb each other; of two that store one job, the later commit holds."""

    spark: SparkSession
    folder: str

    def _place(self, table: str, job_id: str, run: str) -> str:
        return f"{self.folder}/{table}/slot={slot(job_id)}/run={run}"

    def stage(self, job_id: str, tables: dict[str, DataFrame]) -> tuple[str, int]:
        """(run, orders): a run's rows, written where no reader looks before they are committed, and how many orders there are."""
        run = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(self._place(name, job_id, run))
        # counts are in the files' footers
        return run, self._read("extracted_orders", [(job_id, run)]).count()

    def commit(self, job: dict, run: str, total_orders: int) -> None:
        """Make a staged run the one of its job: one row in one file, which is there or isn't."""
        row = {"title": "", "live_start_time": None, "model": "", **job, "run": run, "total_orders": total_orders, "committed": time.time_ns()}
        names = [c.split()[0] for c in JOBS.split(", ")]
        rows = self.spark.createDataFrame([tuple(row[n] for n in names)], JOBS).coalesce(1)
        rows.write.mode("append").parquet(f"{self.folder}/extraction_jobs/slot={slot(job['user_id'])}")

    def put(self, job: dict, tables: dict[str, DataFrame]) -> str:
        """Store a job with its tables, all or nothing; returns the run."""
        run, total = self.stage(job["id"], tables)
        self.commit(job, run, total)
        return run

    def jobs(self, user_id: str | None = None) -> DataFrame:
        """The jobs, of a user or of all, each by its last commit, with total_orders."""
        where = f"/slot={slot(user_id)}" if user_id is not None else ""
        rows = self._parquet([f"{self.folder}/extraction_jobs{where}"], JOBS)
        rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
        names = [c.split()[0] for c in JOBS.split(", ")]
        last = rows.groupBy("id").agg(F.max_by(F.struct(*names), F.struct("committed", "run")).alias("_j"))
        return last.select("_j.*")

    def runs(self, jobs: DataFrame, most: int = 1000) -> list[tuple[str, str]]:
        """(job, run) of a few jobs, to find their rows by; more than `most` raise, as they should be joined instead."""
        found = [(r["id"], r["run"]) for r in jobs.select("id", "run").limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"over {most} jobs: join committed() instead")
        return found

    def rows(self, table: str, jobs: DataFrame) -> DataFrame:
        """The rows of a few jobs: their folders are all that is listed and read."""
        return self._read(table, self.runs(jobs))

    def committed(self, table: str) -> DataFrame:
        """All rows of committed runs. The whole table is read; jobs' rows are few beside it and are sent to it if small, else joined by run."""
        rows = self._parquet([f"{self.folder}/{table}"], TABLES[table] + ", run string")
        return rows.join(self.jobs().select("run"), "run", "left_semi").drop("run")

    def job(self, job_id: str) -> DataFrame:
        """A job's row by its id alone: no user's slot is known, but ids are pushed down to the files."""
        rows = self._parquet([f"{self.folder}/extraction_jobs"], JOBS).where(F.col("id") == job_id)
        return rows.orderBy(F.desc("committed"), F.desc("run")).limit(1)

    def vacuum(self, older_than_seconds: float = 86_400) -> list[str]:
        """Delete the folders of runs that no job names: replaced ones, and those that failed or are under way since that long. Returns their names."""
        kept = {r["run"] for r in self.jobs().select("run").toLocalIterator()}
        fs, path = opened(self.folder)
        gone = []
        for table in TABLES:
            for at_slot in fs.get_file_info(pf.FileSelector(f"{path}/{table}", allow_not_found=True)):
                for info in fs.get_file_info(pf.FileSelector(at_slot.path)) if at_slot.type == pf.FileType.Directory else []:
                    run = info.base_name.removeprefix("run=")
                    if info.type == pf.FileType.Directory and run not in kept and time.time() - info.mtime_ns / 1e9 >= older_than_seconds:
                        fs.delete_dir(info.path)
                        gone.append(run)
        return gone

    def _read(self, table: str, runs: list[tuple[str, str]]) -> DataFrame:
        return self._parquet([self._place(table, j, r) for j, r in runs], TABLES[table])

    def _parquet(self, paths: list[str], schema: str) -> DataFrame:
        """The files in paths; none, if a path isn't there."""
        if not paths:
            return self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).option("basePath", self.folder).parquet(*paths).select(*[c.split()[0] for c in schema.split(", ")])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
