"""Scans under watch: one of a root at a time, with progress, and to be cancelled.

A scan's Spark jobs form a job group. Its progress is that of the group's tasks, as Spark's status tracker has it, and its counters are metrics observed
while the result is written. Cancelling interrupts the group's jobs; as results are written by a commit at the end, a cancelled scan leaves what was there.
The guard holds for the scans of one driver; roots that several drivers scan have to be dealt out to them."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class ScanRunning(RuntimeError):
    """A root is being scanned already."""


class ScanCancelled(RuntimeError):
    """The scan was cancelled before its result was committed."""


@dataclass
class Progress:
    """Tasks of a scan's running and finished stages."""

    stages: int = 0
    tasks: int = 0
    done: int = 0
    failed: int = 0


@dataclass
class Scan:
    spark: SparkSession
    roots: tuple
    group: str = field(default_factory=lambda: f"scan-{uuid.uuid4().hex}")
    cancelled: bool = False

    def progress(self) -> Progress:
        out, tracker = Progress(), self.spark.sparkContext.statusTracker()
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                s = tracker.getStageInfo(stage)
                if s:
                    out.stages, out.tasks, out.done, out.failed = out.stages + 1, out.tasks + s.numTasks, out.done + s.numCompletedTasks, out.failed + s.numFailedTasks
        return out

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)


@dataclass
class Scans:
    """The scans of a session."""

    spark: SparkSession
    running: dict = field(default_factory=dict)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    @contextmanager
    def scan(self, *roots) -> Iterator[Scan]:
        """Runs the body as the scan of these roots; refused while one of them is scanned. All of the body's Spark jobs belong to it."""
        scan, context = Scan(self.spark, roots), self.spark.sparkContext
        with self._lock:
            busy = [r for r in roots if r in self.running]
            if busy:
                raise ScanRunning(f"being scanned: {', '.join(map(str, busy))}")
            self.running.update(dict.fromkeys(roots, scan))
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
        context.setJobGroup(scan.group, f"scan of {', '.join(map(str, roots))}", interruptOnCancel=True)
        try:
            yield scan
        except Exception as e:
            if scan.cancelled:
                raise ScanCancelled(f"cancelled: {', '.join(map(str, roots))}") from e
            raise
        finally:
            for k, v in before.items():
                context.setLocalProperty(k, v)
            with self._lock:
                for r in roots:
                    del self.running[r]

    def cancel(self, root) -> bool:
        """Cancels the scan of a root; False where there is none."""
        with self._lock:
            scan = self.running.get(root)
        if scan:
            scan.cancel()
        return scan is not None
