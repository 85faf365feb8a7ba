"""How the scores of a region are reduced, and what a region without any gets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From (score, is inside the region, name) to an aggregate.
METHODS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "mean": lambda score, inside, name: F.avg(score),
    "sum": lambda score, inside, name: F.sum(score),
    "median": lambda score, inside, name: F.percentile(score, 0.5),
    "min": lambda score, inside, name: F.min(score),
    "max": lambda score, inside, name: F.max(score),
    "count": lambda score, inside, name: F.count(score),
    "pcount": lambda score, inside, name: F.count_if(inside),
    "ncount": lambda score, inside, name: F.count_distinct(name),
    "range": lambda score, inside, name: F.max(score) - F.min(score),
    "stddev": lambda score, inside, name: F.stddev_pop(score),
}
#: Methods that give 0 for a region without scores; others give null.
ZERO_IF_EMPTY = ("sum", "count", "pcount", "ncount")


def reduce(method: str, score: Column, inside: Column, name: Column) -> Column:
    if method not in METHODS:
        raise ValueError(f"method: one of {', '.join(METHODS)}; rpm and rpkm are no methods, see fpkm()")
    return METHODS[method](score, inside, name)


def filled(method: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if method in ZERO_IF_EMPTY else value
