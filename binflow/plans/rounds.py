"""Greedy matchings as rounds of edges whose turn has come.

With a fixed total order of the edges, an edge whose open competitors at both endpoints
all come later is chosen by the sequential greedy no matter what happens elsewhere. So
every round takes all such edges at once and the driver only asks whether any edge was
taken. Chosen edges go to the shared checkpoint folder each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.session import cut

# Pieces merged into one checkpoint when this many rounds have passed.
MERGE_EVERY = 8


class Chosen:
    """The edges taken so far: checkpointed pieces, merged now and then."""

    def __init__(self) -> None:
        self._pieces: list[DataFrame] = []

    def add(self, piece: DataFrame) -> bool:
        """Store one round; false when it took nothing."""
        stored = cut(piece)
        if stored.isEmpty():
            return False
        self._pieces.append(stored)
        if len(self._pieces) >= MERGE_EVERY:
            self._pieces = [cut(self.frame())]
        return True

    def frame(self) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self._pieces) if self._pieces else None


def remaining(amounts: DataFrame, chosen: DataFrame | None, key: str, column: str) -> DataFrame:
    """Amounts minus what was taken, exhausted keys dropped."""
    if chosen is None:
        return amounts.where(F.col(column) > 0)
    used = chosen.groupBy(key).agg(F.sum("amount").alias("used"))
    return (
        amounts.join(used, key, "left")
        .withColumn(column, F.col(column) - F.coalesce("used", F.lit(0)))
        .drop("used")
        .where(F.col(column) > 0)
    )
