"""Typed views of a column: number, text, missing, blank, group key; and the JavaScript spellings they rest on.

A NULL or NaN is missing.  Numbers compare as doubles, dates as epoch milliseconds, text without case.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity|inf|infinity)\s*$"


def plain(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text"


def real(t: T.DataType) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType))


def js_number_text(x: Column) -> Column:
    """String(number) of a double column."""
    s = x.cast("string")
    digits = lambda scale: F.regexp_replace(F.regexp_replace(s.try_cast(f"decimal(38,{scale})").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(s, r"\.0E", "E"), r"E(-?)(\d+)$", "e$1$2")
    a = F.abs(x)
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == float("inf"), "Infinity")
        .when(x == float("-inf"), "-Infinity")
        .when((x == F.floor(x)) & (a < 9e18), F.when(a < 9e18, x).cast("bigint").cast("string"))
        .when(a >= 1e21, F.regexp_replace(power, r"e(\d)", "e+$1"))
        .when(a < 1e-6, power)
        .otherwise(F.when(a < 1e-3, digits(30)).when(a >= 1e7, digits(12)).otherwise(s))
    )


def js_text(c: Column, t: T.DataType) -> Column:
    """String(value) of any column; NULL stays NULL."""
    k = kind_of(t)
    if k == "datetime":
        return iso_text(c)
    if k == "bool":
        return c.cast("string")
    if k == "number":
        return c.cast("string") if isinstance(t, T.IntegralType) else js_number_text(c.cast("double"))
    return F.to_json(c) if isinstance(t, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def iso_text(c: Column) -> Column:
    ts = c.cast("timestamp")
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros != 0, F.date_format(ts, ".SSSSSS")).otherwise(""), F.lit("Z"))


def epoch_ms(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1000.0


def text_number(s: Column) -> Column:
    """A number that is all of a text, else NULL."""
    return F.when(s.rlike(NUMBER_TEXT), F.trim(s).try_cast("double"))


def js_number(c: Column, t: T.DataType) -> Column:
    """Number(value): null and blank text are 0, hexadecimal and the like are read, other text is NaN."""
    k = kind_of(t)
    if k != "text":
        return F.coalesce(epoch_ms(c) if k == "datetime" else c.cast("double"), F.lit(0.0))
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    radix = F.when(s.rlike("(?i)^0x[0-9a-f]+$"), F.conv(F.substring(s, F.lit(3), F.length(s)), 16, 10)).when(s.rlike("(?i)^0b[01]+$"), F.conv(F.substring(s, F.lit(3), F.length(s)), 2, 10)).when(s.rlike("(?i)^0o[0-7]+$"), F.conv(F.substring(s, F.lit(3), F.length(s)), 8, 10))
    return F.when(s == "", 0.0).when(radix.isNotNull(), radix.try_cast("double")).otherwise(F.coalesce(F.when(~s.rlike("(?i)^[+-]?inf$|nan|infinity") | s.rlike("^[+-]?Infinity$"), text_number(s)), F.lit(float("nan"))))


_COMPARISONS = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def _whole(c: Column, op: str, x: float, literal) -> Column:
    """A column of whole numbers compared with any number, as one of whole numbers; ``literal`` spells one."""
    low = math.floor(x)
    if low == x:
        return _COMPARISONS[op](c, literal(int(low)))
    if op == "eq":
        return F.lit(False) & c.isNotNull()
    return c > literal(int(low)) if op in ("gt", "gte") else c <= literal(int(low))


@dataclass(frozen=True)
class View:
    """One column of a table."""

    name: str
    type: T.DataType

    @property
    def kind(self) -> str:
        return kind_of(self.type)

    @property
    def raw(self) -> Column:
        return plain(self.name)

    @property
    def value(self) -> Column:
        """NULL where missing."""
        return F.nanvl(self.raw, F.lit(None)) if real(self.type) else self.raw

    @property
    def num(self) -> Column:
        if self.kind == "datetime":
            return epoch_ms(self.raw)
        if self.kind == "text":
            return text_number(self.raw.cast("string"))
        return self.value.cast("int").cast("double") if self.kind == "bool" else self.value.cast("double")

    def compared(self, op: str, x: float) -> Column:
        """``num`` compared with ``x``, written over the bare column wherever that is the same, so that the scan gets it."""
        if isinstance(self.type, T.IntegralType) and abs(x) < 2**53:
            return _whole(self.raw, op, x, F.lit)
        if self.kind == "datetime" and abs(x) < 2**43:
            return self._moments(op, x)
        if real(self.type):
            # NaN is greater than any number
            out = _COMPARISONS[op](self.raw, F.lit(float(x)))
            return out & ~F.isnan(self.raw) if op in ("gt", "gte") else out
        return _COMPARISONS[op](self.num, F.lit(x))

    def _moments(self, op: str, x: float) -> Column:
        micros = round(x * 1000)
        exact = micros / 1000.0 == x
        unit = 86_400_000_000 if isinstance(self.type, T.DateType) else 1
        at = micros / unit if exact and micros % unit == 0 else (micros if exact else math.floor(x * 1000) + 0.5) / unit
        if isinstance(self.type, T.DateType):
            return _whole(self.raw, op, at, lambda d: F.date_from_unix_date(F.lit(d)))
        return _whole(self.raw, op, at, lambda m: F.timestamp_micros(F.lit(m)).cast(self.type))

    def among(self, numbers: list[float]) -> Column:
        """Whether ``num`` is one of some numbers."""
        if isinstance(self.type, T.IntegralType) and all(abs(x) < 2**53 for x in numbers):
            whole = [int(x) for x in numbers if x == math.floor(x)]
            return self.raw.isin(whole) if whole else F.lit(False) & self.raw.isNotNull()
        return self.raw.isin(numbers) if real(self.type) else self.num.isin(numbers)

    @property
    def txt(self) -> Column:
        return js_text(self.value, self.type)

    @property
    def missing(self) -> Column:
        return (self.raw.isNull() | F.isnan(self.raw)) if real(self.type) else self.raw.isNull()

    @property
    def blank(self) -> Column:
        return (self.missing | (self.raw == "")) if isinstance(self.type, T.StringType) else self.missing

    @property
    def key(self) -> Column:
        return self.raw.cast("timestamp_ntz") if self.kind == "datetime" else self.value

    def operand(self, v) -> float | None:
        """What a filter's value is as a number, or None where it is none."""
        if isinstance(v, bool):
            return float(v)
        if self.kind == "datetime":
            return moment(v)
        if self.kind == "bool" and isinstance(v, str) and v.strip().lower() in ("true", "false"):
            return float(v.strip().lower() == "true")
        try:
            x = float(v.strip() if isinstance(v, str) else v)
        except (TypeError, ValueError, AttributeError):
            return None
        return None if x != x else x


def moment(v) -> float | None:
    """Epoch milliseconds of ISO text, a date or a number of milliseconds; naive times are UTC."""
    if v is None or isinstance(v, bool):
        return None
    if isinstance(v, (int, float)):
        return None if v != v else float(v)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    if isinstance(v, str):
        try:
            v = dt.datetime.fromisoformat(v.strip())
        except ValueError:
            return None
    if not isinstance(v, dt.datetime):
        return None
    if v.tzinfo is None:
        v = v.replace(tzinfo=dt.UTC)
    return (v - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) / dt.timedelta(milliseconds=1)


class Schema(dict):
    """Column name -> View; an unknown name is a KeyError."""

    def __init__(self, df: DataFrame, hidden: tuple[str, ...] = ()):
        super().__init__({f.name: View(f.name, f.dataType) for f in df.schema.fields if f.name not in hidden})

    def __missing__(self, name):
        raise KeyError(f"no column {name!r}")
