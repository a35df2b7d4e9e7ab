"""Sort keys: missing last unless nullsFirst, text without case and lower before upper, ties in source order."""

from __future__ import annotations

from pyspark.sql import Column

from pyspark.sql import functions as F

from veduta.functions.columns import Schema, View


def keys(v: View, desc: bool = False, nulls_first: bool = False, wrap=lambda c: c) -> list[Column]:
    parts = [v.num] if v.kind != "text" else [F.lower(v.txt), v.txt]
    turned = [desc] if v.kind != "text" else [desc, not desc]  # lower case has the higher code points
    out = []
    for c, down in zip(parts, turned, strict=True):
        c = wrap(c)
        out.append((c.desc_nulls_first() if nulls_first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if nulls_first else c.asc_nulls_last()))
    return out


def order(sort: list[dict] | None, schema: Schema, row_id: Column) -> list[Column]:
    out = []
    for s in sort or []:
        out += keys(schema[s["col"]], s.get("dir") == "desc", bool(s.get("nullsFirst")))
    return [*out, row_id.asc()]
