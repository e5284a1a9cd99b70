"""Why an item is where it is: every stage's decision about it, from scoring to selection, in one frame."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import written


class Step(NamedTuple):
    """A stage: run takes the rows that are left, or is None if the stage adds nothing to them; decision and detail are read from its result; stays says which rows go on."""

    name: str
    run: Callable[[DataFrame], DataFrame] | None
    decision: Column
    detail: Column
    stays: Column


def explained(items: DataFrame, steps: list[Step], row_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(trail, rows left at the end). The trail has (id, stage_no, stage, decision, detail), a row per item and stage that it came to.

    Each stage works on all rows that its predecessors left, as it does without the trail; what it makes is a written table, read twice.
    """
    trail, left = None, items
    for no, step in enumerate(steps, 1):
        done = written(step.run(left), f"explain-{step.name}") if step.run else left
        told = done.select(F.col(row_id).alias("id"), F.lit(no).alias("stage_no"), F.lit(step.name).alias("stage"), step.decision.cast("string").alias("decision"), step.detail.cast("string").alias("detail"))
        trail = told if trail is None else trail.union(told)
        left = done.filter(step.stays)
    return trail, left
