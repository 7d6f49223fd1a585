"""Counts that come with a run: rows of stages by observation, and number and seconds of a driver's operations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Reasons for which blocks take no part in exact comparison.
SKIPPED = ("heading", "no_path", "deleted", "fence", "no_text")


class Metrics:
    """What stages count while the first action that passes through them runs; no stage is scanned again for it.

    Of stages that occur several times in one plan, or in several actions, the first result counts.  Spark adds up what tasks
    report, so a stage that lost executors make it run again may count rows twice: figures for people, not for results.
    """

    def __init__(self):
        self._stages: dict[str, Observation] = {}
        self._operations: dict[str, tuple[int, float]] = {}

    def observed(self, rows: DataFrame, stage: str, **counts: Column) -> DataFrame:
        """rows, counted (`rows`) as they pass, with further aggregates by name; a stage has one name."""
        if stage in self._stages:
            raise ValueError(f"stage {stage!r} is observed already")
        self._stages[stage] = Observation(stage)
        return rows.observe(self._stages[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counts.items()])

    @contextmanager
    def timed(self, operation: str) -> Iterator[None]:
        """Counts an operation and adds its seconds, also where it fails."""
        began = time.monotonic()
        try:
            yield
        finally:
            n, seconds = self._operations.get(operation, (0, 0.0))
            self._operations[operation] = (n + 1, seconds + time.monotonic() - began)

    def stages(self, wait: float = 5.0) -> dict[str, dict[str, int]]:
        """Counts of the stages that an action has passed through; Spark tells of them shortly after it, for which this waits
        at most so many seconds."""
        until = time.monotonic() + wait
        done = lambda o: o._jo is not None and o._jo.future().isCompleted()
        while not all(map(done, self._stages.values())) and time.monotonic() < until:
            time.sleep(0.05)
        return {stage: dict(o.get) for stage, o in self._stages.items() if done(o)}

    def operations(self) -> dict[str, dict[str, float]]:
        return {name: {"count": n, "seconds": seconds} for name, (n, seconds) in self._operations.items()}


def skipped(reason: Column) -> dict[str, Column]:
    """Aggregates of processed rows (no reason) and of those skipped for each reason."""
    return {"processed": F.count_if(reason.isNull()), **{f"skipped_{r}": F.count_if(reason == r) for r in SKIPPED}}
