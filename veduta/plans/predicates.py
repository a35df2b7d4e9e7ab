"""Filter trees and quick search as Columns.

In a filter NULL counts as false, so leaves stay bare and reach the scan; what a negation covers is made two-valued
first, because negative operators match missing rows.
"""

from __future__ import annotations

import operator
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veduta.functions.columns import Schema, View

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "between", "notBetween", "in", "notIn", "contains", "notContains", "startsWith", "endsWith", "matches", "blank", "notBlank")
_COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_NEGATIVE = {"ne": "eq", "notBetween": "between", "notIn": "in", "notContains": "contains", "notBlank": "blank"}


def _not(p: Column) -> Column:
    return ~F.coalesce(p, F.lit(False))


def _string(v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v == int(v) and abs(v) < 1e21:
        return str(int(v))
    return str(v)


def java_pattern(pattern: str, case: bool = True) -> str | None:
    """The pattern as the JVM takes it, or None where it takes none; named groups may be written ``(?P<name>``."""
    pattern = ("" if case else "(?i)") + pattern.replace("(?P<", "(?<")
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):  # a syntax error, in either spelling of a JVM exception
        return None
    return pattern


def leaf(v: View, op: str, value=None, case: bool = False, bounds: str = "[]") -> Column:
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    if op in _NEGATIVE:
        return _not(leaf(v, _NEGATIVE[op], value, case, bounds))
    ordered = v.kind != "text"
    fold = (lambda s: s) if case else str.lower
    text = v.txt if case else F.lower(v.txt)
    if op == "blank":
        return v.blank
    if op == "eq":
        if value is None:
            return v.missing
        if ordered:
            x = v.operand(value)
            return F.lit(False) if x is None else v.compared("eq", x)
        return text == fold(_string(value))
    if op == "in":
        items = list(value) if isinstance(value, (list, tuple, set)) else [value]
        present = [x for x in items if x is not None]
        if ordered:
            numbers = [x for x in map(v.operand, present) if x is not None]
            out = v.among(numbers) if numbers else F.lit(False)
        else:
            out = text.isin([fold(_string(x)) for x in present]) if present else F.lit(False)
        return F.coalesce(out, F.lit(False)) | v.missing if len(present) < len(items) else out
    if op in _COMPARE:
        if ordered:
            x = v.operand(value)
            return F.lit(False) if x is None else v.compared(op, x)
        return F.lit(False) if value is None else _COMPARE[op](F.lower(v.txt), F.lit(_string(value).lower()))
    if op == "between":
        lo, hi = value if isinstance(value, (list, tuple)) and len(value) == 2 else (value, value)
        lower, upper = "gte" if bounds[0] == "[" else "gt", "lte" if bounds[-1] == "]" else "lt"
        if ordered:
            lo, hi = v.operand(lo), v.operand(hi)
            return F.lit(False) if lo is None or hi is None else v.compared(lower, lo) & v.compared(upper, hi)
        if lo is None or hi is None:
            return F.lit(False)
        x = F.lower(v.txt)
        return _COMPARE[lower](x, F.lit(_string(lo).lower())) & _COMPARE[upper](x, F.lit(_string(hi).lower()))
    if op == "matches":
        pattern = java_pattern(_string(value), case)
        return F.lit(False) if pattern is None else v.txt.rlike(pattern)
    needle = F.lit(fold(_string(value)))
    return {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](text, needle)


def compiled(node: dict | None, schema: Schema) -> Column | None:
    """The tree's predicate, or None where it filters nothing."""
    if not node:
        return None
    if "conditions" in node:
        own = [p for p in (compiled(x, schema) for x in node["conditions"]) if p is not None]
        op = node.get("op", "and")
        if op not in ("and", "or", "not"):
            raise ValueError(f"unknown group {op!r}")
        if not own:
            return None
        return reduce(operator.or_, own) if op == "or" else _not(reduce(operator.and_, own)) if op == "not" else reduce(operator.and_, own)
    return leaf(schema[node["col"]], node["op"], node.get("value"), bool(node.get("caseSensitive")), node.get("bounds") or "[]")


def quick(needle: str | None, schema: Schema) -> Column | None:
    needle = (needle or "").strip().lower()
    if not needle:
        return None
    return reduce(operator.or_, (F.coalesce(F.contains(F.lower(v.txt), F.lit(needle)), F.lit(False)) for v in schema.values()))


def pruned(node: dict | None, columns) -> dict | None:
    """The tree without leaves on absent columns; empty groups vanish."""
    if not node:
        return None
    if "conditions" in node:
        own = [x for x in (pruned(y, columns) for y in node["conditions"]) if x]
        return {**node, "conditions": own} if own else None
    return node if node.get("col") in columns else None


def prune_state(state: dict, columns) -> dict:
    """A saved state without what names absent columns."""
    out = {**state, "filters": pruned(state.get("filters"), columns), "sort": [s for s in state.get("sort") or [] if s.get("col") in columns]}
    for key in ("group", "columns", "columnOrder"):
        if key in state:
            out[key] = [c for c in state[key] or [] if (c.get("field") if isinstance(c, dict) else c) in columns]
    return out
