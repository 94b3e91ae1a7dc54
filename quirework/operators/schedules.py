"""Schedules as column expressions over a step column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(begin: float, end: float, step: Column, steps: int) -> Column:
    return begin + step * (end - begin) / steps


def exponential(begin: float, end: float, step: Column, steps: int) -> Column:
    """Falls towards the end value; the step is held at the last one."""
    s = F.least(step, F.lit(steps - 1))
    return begin - (begin - end) * (1 - F.exp(-10.0 * s / steps))


def dropout(rate: float, step: Column, steps: int) -> Column:
    return rate * (1 - F.exp(-10.0 * step / steps))


def curriculum_lines(step: Column, start: int, every: int, least: int, most: int) -> Column:
    """One line more every so many samples, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), (F.floor((step - start) / every) + 1))).cast("int")


def step_points(table: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(step, lines): from which step on (exclusively) how many lines are asked for, spread evenly between the rows of a table."""
    out = []
    rows = sorted(table)
    for (a, m), (b, n) in zip(rows, rows[1:]):
        k = n - m + 1
        out += [(math.trunc(a + (b - a) * i / (k - 1)) if k > 1 else a, m + i) for i in range(k)]
    return out


def step_lines(step: Column, table: list[tuple[int, int]]) -> Column:
    """Lines at a step by such a table; 1 before the first."""
    value = F.lit(1)
    for at, lines in step_points(table):
        value = F.when(step > at, F.lit(lines)).otherwise(value)
    return value
