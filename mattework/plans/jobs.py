"""Long work in the background: its Spark jobs carry a tag, by which they are counted and cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, Future
from dataclasses import dataclass
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Progress:
    """Finished and known tasks of the stages that were seen, and what runs now."""

    done: int
    known: int
    title: str

    @property
    def share(self) -> float:
        return self.done / self.known if self.known else 0.0


class Work:
    """work() on a thread of its own. result() waits; cancel() ends its jobs, and result() then raises CancelledError.

    A job counts with the tasks of its stages; later jobs are not known before they start, so the share can fall.
    """

    def __init__(self, spark: SparkSession, work: Callable[[], Any], title: str = "keying"):
        self._spark, self._title, self._group = spark, title, f"mattework-{uuid.uuid4().hex}"
        self._told: Future = Future()
        self._gone = threading.Event()

        def run():
            spark.sparkContext.setJobGroup(self._group, title, interruptOnCancel=False)
            try:
                if self._gone.is_set():
                    raise CancelledError
                self._told.set_result(work())
            except BaseException as e:  # handed to whoever asks for the result
                self._told.set_exception(CancelledError() if self._gone.is_set() else e)

        self._thread = InheritableThread(target=run, daemon=True)
        self._thread.start()

    def progress(self) -> Progress:
        tracker = self._spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(self._group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        infos = [i for i in map(tracker.getStageInfo, stages) if i]
        return Progress(sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos), self._title)

    def cancel(self) -> None:
        self._gone.set()
        self._spark.sparkContext.cancelJobGroup(self._group)

    @property
    def running(self) -> bool:
        return not self._told.done()

    def result(self, timeout: float | None = None) -> Any:
        return self._told.result(timeout)


class Latest:
    """The last work asked for: a new one cancels the one before, whose result nobody gets."""

    def __init__(self, spark: SparkSession):
        self._spark, self._now = spark, None

    def ask(self, work: Callable[[], Any], title: str = "preview") -> Work:
        if self._now and self._now.running:
            self._now.cancel()
        self._now = Work(self._spark, work, title)
        return self._now
