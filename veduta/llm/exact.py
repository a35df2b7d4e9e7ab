"""Exact deduplication by content-defined chunk recipes.

Texts are equal when identical after lower-casing A-Z.  Each text is cut where a rolling gear hash of its bytes says
so, which gives equal texts equal chunks; a chunk's identifier is its 128-bit hash.  Identifiers are verified against
the bytes: for every identifier the smallest and the largest chunk content are aggregated (with map-side combine, so
a chunk that a third of the documents hold leaves each task once) and must be the same; an identifier for which they
differ is replaced by the SHA-256 of the chunk.  Documents are then grouped by their ordered identifier lists, some
16 bytes for every 2 KB of text.  A text's bytes are moved once, for the verification, however often it is compared.

A group of more than a thousandth of all rows meets its rows by broadcast of its recipe: there are less than a thousand
such groups, and their recipes together are no longer than a thousand average ones.

Null text counts as empty and is equal to empty text.  A null doc_id is smaller than any other.  Of rows with equal
text and equal doc_id one stays.  Very long texts are cut into chunks of at most ``MOST`` bytes.  An empty table gives an
empty result.  ``exact_groups`` reads doc_id and text alone; ``exact_dedup`` keeps every column, whatever its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.common import cut, grouped_rows, keep_rows, table

LEAST, MEAN_BITS, MOST = 512, 11, 16384
#: Clashing identifiers that are sent to all tasks, 16 bytes each.
MOST_CLASHES = 100_000
_REACH = 32  # bytes that a gear hash of 32 bits sees


def cuts(data: bytes, starts: list[int], least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> Iterator[list[tuple[int, int]]]:
    """For each text ``data[starts[i]:starts[i+1]]`` its chunks as (start, end); no chunk for an empty text."""
    import numpy as np

    gear = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
    h = gear[np.frombuffer(data, dtype=np.uint8)]
    k = 1
    while k < _REACH:  # h[i] = sum of gear[data[i-j]] << j for j < k, then the same for twice as many j
        h[k:] += h[:-k].copy() << np.uint32(k)
        k *= 2
    found = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    for a, b in zip(starts, starts[1:], strict=False):
        out, last = [], a
        for c in found[np.searchsorted(found, a + least) : np.searchsorted(found, b)].tolist():
            if c - last < least:
                continue
            while c - last > most:
                out.append((last, last + most))
                last += most
            if c - last >= least:
                out.append((last, c))
                last = c
        while b - last > most:
            out.append((last, last + most))
            last += most
        yield [*out, (last, b)] if b > last else out


def _joined(texts: pa.Array, most: int = 32 << 20) -> Iterator[tuple[int, bytes, list[int]]]:
    """Consecutive texts, lower-cased, as (first row, bytes, starts); some ``most`` bytes at once."""
    parts, starts, first = [], [0], 0
    for i, x in enumerate(texts):
        parts.append((x.as_py() or "").encode().lower())
        starts.append(starts[-1] + len(parts[-1]))
        if starts[-1] >= most:
            yield first, b"".join(parts), starts
            parts, starts, first = [], [0], i + 1
    if parts:
        yield first, b"".join(parts), starts


def recipes(docs: DataFrame, bad: tuple[bytes, ...] | None = ()) -> DataFrame:
    """doc_id, text_hash, text_sha256, recipe (ordered chunk identifiers) of every row.

    A ``bad`` identifier gives way to the chunk's SHA-256, all do if ``bad`` is None.
    """

    def run(batches):
        import hashlib

        import xxhash

        for b in batches:
            shas, lists = [], []
            for _, data, starts in _joined(b.column(1)):
                for i, own in enumerate(cuts(data, starts)):
                    shas.append(hashlib.sha256(data[starts[i] : starts[i + 1]]).hexdigest())
                    ids = []
                    for x, y in own:
                        c = data[x:y]
                        k = xxhash.xxh3_128_digest(c)
                        ids.append(hashlib.sha256(c).digest() if bad is None or k in bad else k)
                    lists.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "text_hash", "text_sha256", "recipe"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, text_sha256 string, recipe array<binary>")


def clashing(docs: DataFrame) -> DataFrame:
    """The identifiers that stand for more than one chunk content."""

    def run(batches):
        import xxhash

        for b in batches:
            for _, data, starts in _joined(b.column(0), 8 << 20):
                seen = {data[x:y] for own in cuts(data, starts) for x, y in own}
                seen = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(c) for c in seen], pa.binary()), pa.array(seen, pa.binary())], ["id", "content"])

    chunks = docs.select("text").mapInArrow(run, "id binary, content binary")
    return chunks.groupBy("id").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("id")


def exact_groups(docs: DataFrame, most_clashes: int = MOST_CLASHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_hash for every row of ``docs``."""
    bad = tuple(bytes(r[0]) for r in clashing(docs).limit(most_clashes + 1).collect())  # none, unless someone forges them
    # With so many that they can't be sent to all tasks, no short identifier is trusted.
    rows = cut(recipes(docs, bad if len(bad) <= most_clashes else None).withColumn("row", F.monotonically_increasing_id()))
    best = F.max(F.struct("doc_id", "row"))
    groups = cut(rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size")))
    both = grouped_rows(rows, groups, "recipe", "group_size")
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "text_hash")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    return keep_rows(docs, exact_groups(docs).where("kept"))


def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
r AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept FROM t)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
