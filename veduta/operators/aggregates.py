"""The twenty exact aggregates of a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veduta.functions.columns import View

QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
NAMES = ("count", "countValues", "distinct", "sum", "sumSquares", "avg", "min", "max", "range", *QUANTILES, "iqr", "variance", "stddev", "varianceP", "stddevP")
_ON_TEXT = ("min", "max", "range")


def levels_of(fn: str) -> tuple[float, ...]:
    """The quantiles an aggregate is made of; of two it is the distance."""
    return (0.25, 0.75) if fn == "iqr" else (QUANTILES[fn],) if fn in QUANTILES else ()


def aggregate(v: View, fn: str) -> Column:
    if fn not in NAMES:
        raise ValueError(f"unknown aggregate {fn!r}")
    if fn == "count":
        return F.count("*")
    if fn == "countValues":
        return F.count(F.when(~v.blank, 1))
    if fn == "distinct":
        return F.count_distinct(F.when(~v.blank, v.txt if v.kind == "text" else v.num))
    if v.kind == "text" and fn not in _ON_TEXT:
        return F.max(F.lit(None).cast("double"))
    x = v.num
    if fn in QUANTILES:
        return F.percentile(x, F.lit(QUANTILES[fn]))
    if fn == "iqr":
        both = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
        return both[1] - both[0]
    return {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "sumSquares": lambda: F.coalesce(F.sum(x * x), F.lit(0.0)),
        "avg": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "range": lambda: F.max(x) - F.min(x),
        "variance": lambda: F.var_samp(x),
        "stddev": lambda: F.stddev_samp(x),
        "varianceP": lambda: F.var_pop(x),
        "stddevP": lambda: F.stddev_pop(x),
    }[fn]()
