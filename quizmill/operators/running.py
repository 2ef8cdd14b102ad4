"""Generation jobs in the background, a few at a time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: Fixed value: jobs that run at once.
MAX_JOBS = 3


class Jobs:
    """Queues jobs of a session and runs at most `most` at once, each under its own tag, so that a scheduler can share out the cluster and a job can be stopped."""

    def __init__(self, spark: SparkSession, most: int = MAX_JOBS):
        self.spark, self.pool, self.running = spark, ThreadPoolExecutor(most), {}

    def enqueue(self, job: str, work: Callable[[], object]) -> Future:
        """The job's outcome, some time. A job of that name that hasn't ended is returned as it is."""
        known = self.running.get(job)
        if known is not None and not known.done():
            return known

        def run() -> object:
            found: dict[str, object] = {}

            def tagged() -> None:
                self.spark.addTag(job)
                try:
                    found["value"] = work()
                except Exception as e:  # noqa: BLE001  raised again where the outcome is asked for
                    found["error"] = e
                finally:
                    self.spark.removeTag(job)

            thread = InheritableThread(target=tagged, session=self.spark)
            thread.start()
            thread.join()
            if "error" in found:
                raise found["error"]
            return found.get("value")

        self.running[job] = self.pool.submit(run)
        return self.running[job]

    def cancel(self, job: str) -> None:
        """Ends what Spark does for the job, or keeps it from starting."""
        if job in self.running and not self.running[job].cancel():
            self.spark.interruptTag(job)

    def close(self) -> None:
        self.pool.shutdown()
