"""Field coercion of router sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veduta.functions.columns import js_number_text, js_text, kind_of, text_number

TYPES = ("text", "number", "integer", "boolean", "date", "json")


class Unsupported(ValueError):
    """A field that can't be read."""


def _number(s: Column, decimal: str) -> Column:
    s = F.regexp_replace(F.trim(s), r"[\s' ]", "")
    s = F.translate(F.regexp_replace(s, r"\.", ""), ",", ".") if decimal == "," else F.regexp_replace(s, ",", "")
    expression = s.rlike(r"\d\s*[*/^+]\s*\d|\d-\d") & ~s.rlike(r"(?i)^[+-]?[\d.]+e[+-]?\d+$")
    bare = F.when(s.rlike(r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), s).otherwise(F.regexp_replace(s, r"[^0-9.+-]", ""))
    return F.when(~expression, text_number(bare))


_TOKENS = {"yyyy": r"(\d{4})", "yy": r"(\d{2})", "MM": r"(\d{1,2})", "M": r"(\d{1,2})", "dd": r"(\d{1,2})", "d": r"(\d{1,2})", "HH": r"(\d{1,2})", "mm": r"(\d{1,2})", "ss": r"(\d{1,2})"}


def _pattern_date(s: Column, pattern: str) -> Column:
    """Days and months may run over; tokens not known give null."""
    out, places = "^", {}
    for quoted, word, other in re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z']+)", pattern):
        if word:
            if word not in _TOKENS:
                return F.lit(None).cast("string")
            out += _TOKENS[word]
            places[word[0] if word[0] != "y" else word] = len(places) + 1
        else:
            out += re.escape(quoted or other)
    got = lambda k: F.regexp_extract(F.trim(s), out + "$", places[k]).try_cast("int") if k in places else F.lit(1)
    year = got("yyyy") if "yyyy" in places else 2000 + got("yy") if "yy" in places else F.lit(1970)
    return F.when(F.trim(s).rlike(out + "$"), F.date_format(F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), got("M") - 1), got("d") - 1), "yyyy-MM-dd"))


def coerced(c: Column, t, spec: dict | str) -> Column:
    """``c`` as the declared type; blank text is null for every type but text."""
    spec = {"type": spec} if isinstance(spec, str) else spec
    kind = spec.get("type", "text")
    s = js_text(c, t)
    if spec.get("nulls"):
        s = F.when(~F.coalesce(s.isin([str(x) for x in spec["nulls"]]), F.lit(False)), s)
    if kind == "text":
        return s
    s = F.when(F.trim(s) != "", s)
    if kind in ("number", "integer"):
        x = c.cast("double") if kind_of(t) in ("number", "bool") else _number(s, spec.get("decimal", "."))
        return F.when(x == F.floor(x), x) if kind == "integer" else x
    if kind == "boolean":
        yes = [str(x).lower() for x in spec.get("true") or ("true", "yes", "y", "1")]
        no = [str(x).lower() for x in spec.get("false") or ("false", "no", "n", "0")]
        low = F.lower(F.trim(s))
        return F.when(low.isin(yes), True).when(low.isin(no), False)
    if kind == "date":
        form = spec.get("format", "iso")
        if form in ("epoch-s", "epoch-ms"):
            ms = text_number(s) * (1000 if form == "epoch-s" else 1)
            return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd")
        if form == "iso":
            return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10))
        return _pattern_date(s, form)
    if kind == "json":
        return F.to_json(F.try_parse_json(s))
    raise Unsupported(f"unknown field type {kind!r}")


__all__ = ["TYPES", "Unsupported", "coerced", "js_number_text"]
