"""Threshold grids whose points are the exact doubles of an arange/linspace."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    start: float
    step: float
    size: int
    first: int = 0

    @classmethod
    def arange(cls, start: float, stop: float, step: float) -> "Grid":
        return cls(start, (start + step) - start, math.ceil((stop - start) / step))

    @classmethod
    def inner_edges(cls, bins: int) -> "Grid":
        """Edges between ``bins`` equal-width bins of [0, 1]."""
        return cls(0.0, 1.0 / bins, bins - 1, first=1)

    def values(self) -> list[float]:
        return [self.start + (i + self.first) * self.step for i in range(self.size)]

    def point(self, index: Column) -> Column:
        place = index + self.first if self.first else index
        return F.lit(self.start) + place * F.lit(self.step)

    def slot(self, value: Column) -> Column:
        """How many grid points are <= value; exact for every double."""
        guess = F.floor((value - F.lit(self.start)) / F.lit(self.step)) - self.first
        exact = (
            F.when(self.point(guess + 1) <= value, guess + 1)
            .when(self.point(guess) > value, guess - 1)
            .otherwise(guess)
        )
        return F.least(F.greatest(exact + 1, F.lit(0)), F.lit(self.size)).cast("int")


TUNING = Grid.arange(0.01, 0.99, 0.01)
SWEEP = Grid.arange(0.05, 0.95, 0.01)
FAIRNESS = Grid.arange(0.20, 0.61, 0.05)
