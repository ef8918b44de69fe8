"""Profiling jobs in the background: start, status, cancel, result."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tablelens.plans.insights import insights
from tablelens.plans.profiler import Profiler
from tablelens.plans.types import ProfilingConfig
from tablelens.streaming.log import Logger


@dataclass
class Job:
    job_id: str
    status: str = "pending"
    progress: int = 0
    log: Logger = field(default_factory=Logger)
    result: dict[str, Any] | None = None
    error: str | None = None


class Jobs:
    """Each job runs in a thread with a job group of its own, so that cancelling it stops its Spark jobs.

    A cancelled job stays cancelled, whatever its thread does later.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._jobs, self._lock = spark, {}, threading.Lock()

    def start(self, load: Callable[[], DataFrame], table: str = "", config: ProfilingConfig | None = None, keys: bool = True) -> str:
        job = Job(uuid.uuid4().hex)
        with self._lock:
            self._jobs[job.job_id] = job
        thread = InheritableThread(target=self._run, args=(job, load, table, config, keys), daemon=True)
        job.thread = thread  # type: ignore[attr-defined]
        thread.start()
        return job.job_id

    def _move(self, job: Job, status: str, progress: int) -> bool:
        with self._lock:
            if job.status == "cancelled":
                return False
            job.status, job.progress = status, progress
            return True

    def _run(self, job: Job, load: Callable[[], DataFrame], table: str, config: ProfilingConfig | None, keys: bool) -> None:
        try:
            self.spark.sparkContext.setJobGroup(job.job_id, f"profile {table}", interruptOnCancel=True)
            if not self._move(job, "running", 20):
                return
            df = load()
            if not self._move(job, "running", 30):
                return
            report = Profiler(config, log=job.log).profile(df, table)
            if not self._move(job, "running", 80):
                return
            job.result = insights(report, df if keys else None, table)
            self._move(job, "complete", 100)
        except Exception as e:
            job.error = str(e)
            job.log.error("job", str(e)[:500])
            self._move(job, "error", job.progress)

    def get(self, job_id: str) -> Job:
        return self._jobs[job_id]

    def status(self, job_id: str, logs: int = 10) -> dict[str, Any]:
        job = self._jobs.get(job_id)
        if job is None:
            return {"status": "not_found"}
        return {"jobId": job_id, "status": job.status, "progress": job.progress, "logs": job.log.latest(logs), "result": job.result, "error": job.error}

    def cancel(self, job_id: str) -> bool:
        job = self._jobs.get(job_id)
        if job is None or not self._move(job, "cancelled", job.progress):
            return False
        self.spark.sparkContext.cancelJobGroup(job_id)
        return True

    def wait(self, job_id: str, seconds: float | None = None) -> dict[str, Any]:
        self._jobs[job_id].thread.join(seconds)
        return self.status(job_id)
