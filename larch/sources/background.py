"""A table that is built in the background: one build at a time, its progress, and what readers see meanwhile."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from larch.sources.snapshots import exists
from larch.sources.stores import replace


class BackgroundTable:
    """The table at `path`, as `build` makes it.

    Readers get the table they had while a build runs, and the new one after it; a failed build leaves both the
    files and what is held as they are, and shows in progress().  Files are looked at once, and not during a build.
    A frame taken before a build reads files that the build replaces: take it anew.
    """

    def __init__(self, spark: SparkSession, path: str, build: Callable[[Callable[[int, int], None]], DataFrame]):
        """build gets a function (done, total) that it may call as it goes on."""
        self._spark, self._path, self._build = spark, path, build
        self._guard, self._pool = threading.Lock(), ThreadPoolExecutor(1)
        self._held: DataFrame | None = None
        self._job: Future | None = None
        self._steps = (0, 0)

    def start(self) -> bool:
        """Starts a build; False if one is running."""
        with self._guard:
            if self.running:
                return False
            self._steps = (0, 0)  # before the build can note any
            self._job = self._pool.submit(self._run)
            return True

    def _note(self, done: int, total: int) -> None:
        self._steps = (done, total)

    def _run(self) -> None:
        replace(self._build(self._note), self._path)
        fresh = self._spark.read.parquet(self._path)
        with self._guard:
            self._held, self._steps = fresh, (self._steps[1], self._steps[1])

    @property
    def running(self) -> bool:
        return self._job is not None and not self._job.done()

    def progress(self) -> dict:
        """running, done, total and error (None if the last build went well)."""
        failed = self._job.exception() if self._job is not None and self._job.done() else None
        return {"running": self.running, "done": self._steps[0], "total": self._steps[1], "error": str(failed) if failed else None}

    def get(self) -> DataFrame | None:
        """The table, or None if there is none yet."""
        with self._guard:
            if self._held is None and not self.running and exists(self._spark, self._path):
                self._held = self._spark.read.parquet(self._path)
            return self._held

    def wait(self) -> None:
        """Returns when no build runs; errors stay in progress()."""
        if self._job is not None:
            self._job.exception()
