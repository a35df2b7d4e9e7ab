"""Removal of repeated passages, with a count-min prefilter.

A window is ``WINDOW`` consecutive words.  A word goes if a window that covers it also starts in a document with a
smaller doc_id.  Windows are known by 128 bits: two polynomial hashes over two independent 64-bit hashes of their words,
which are not compared themselves; any two windows of a corpus of 10**13 words clash with a chance of one in a trillion.

1. Every window is represented by the least hash of the 25-word runs in it; windows that are equal have equal ones,
   and neighbouring windows mostly share theirs, so there is one for some 13 words.  Each document's distinct ones
   are counted in a count-min sketch.  Tasks send the cells that they touch, block by block of the sketch; merged
   blocks keep a bit for each cell: reached at least twice.  The estimate is never too low, so no repeat is lost.
   The bits (at most ``MOST_CELLS`` / 8 bytes, whatever the input) are broadcast.  Beyond some 2 GB of text for that
   many cells, ever more windows are taken for repeated and grouped exactly: the result is the same, at more cost.
2. Only windows whose representative is estimated repeated go on.  In a task, a window that a document with a smaller
   doc_id of the same batch also has is settled there; of the others one document's windows go to the exact grouping,
   dealt out by window hash.  So a passage that a third of all rows share is one row for each batch.
3. What is settled meets by batch, and goes back to the documents as runs of positions.

Null text has no words.  A null doc_id is larger than any other.  Rows with equal doc_id never count as smaller than
each other; repeated rows get equal answers.  Batches are cut by bytes, so very long texts stand alone.  An empty table
gives an empty result.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.common import WORD, table

WINDOW, INNER = 50, 25
MOST_CELLS, BLOCK_CELLS, ROWS = 1 << 29, 1 << 20, 2


class Words(dict):
    """Word -> its number; ``first`` and ``second`` are two independent 64-bit hashes by number."""

    def __init__(self):
        self.first, self.second = array("Q"), array("Q")

    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = n = len(self.first)
        h = xxhash.xxh3_128_intdigest(word)
        self.first.append(h & 0xFFFFFFFFFFFFFFFF)
        self.second.append(h >> 64)
        return n


def pieces(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Slices of a batch whose texts have some ``most`` bytes, or one text."""
    import numpy as np

    n = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    part = np.cumsum(n) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


class Windows:
    """Of a batch of texts: for each window its row, its position in the row, two hashes and its representative."""

    def __init__(self, window: int = WINDOW, inner: int = INNER):
        import re

        self.window, self.inner, self.words, self.known = window, inner, re.compile(WORD).findall, Words()

    def rolled(self, a, base: int, *lengths: int):
        """Polynomial hashes of each of the runs that start at each place, one array for each length."""
        import numpy as np

        power, by = {1: base}, {1: a}
        m = 1
        while 2 * m <= max(lengths):
            h = by[m]
            by[2 * m] = h[:-m] * np.uint64(power[m]) + h[m:] if len(h) > m else h[:0]
            power[2 * m] = power[m] * power[m] % 2**64
            m *= 2
        for n in lengths:
            out, done = None, 0
            for m in (m for m in sorted(by, reverse=True) if n & m):
                part = by[m][done:]
                size = max(0, len(a) - done - m + 1)
                out = part[:size] if out is None else out[:size] * np.uint64(power[m]) + part[:size]
                done += m
            yield out

    def __call__(self, texts):
        import numpy as np

        if len(self.known) > 1_000_000:
            self.known = Words()
        lengths, parts = [], []
        for x in texts:
            own = self.words(x.as_py() or "")
            lengths.append(len(own))
            parts.append(np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)))
        number, lengths = (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(lengths, np.int64)
        a, other = (np.array(h, np.uint64)[number] for h in (self.known.first, self.known.second))
        count = np.maximum(0, lengths - self.window + 1)
        row = np.repeat(np.arange(len(lengths)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(np.cumsum(lengths) - lengths, count) + at
        none = np.zeros(0, np.uint64)
        if not len(row):
            return row, at, none, none, none
        whole, inner = self.rolled(a, 0x9E3779B97F4A7C15, self.window, self.inner)
        (second,) = self.rolled(other, 0xC2B2AE3D27D4EB4F, self.window)
        inner = (inner ^ (inner >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        inner ^= inner >> np.uint64(29)
        span, low, m = self.window - self.inner + 1, inner, 1
        while 2 * m <= span:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        if span > m:
            low = np.minimum(low[: len(inner) - span + 1], low[span - m :][: len(inner) - span + 1])
        return row, at, whole[place], second[place], low[place]


def _cells(values, cells: int):
    """The place of each value in each row of the sketch; all rows lie in one range of ``cells``."""
    import numpy as np

    each = np.uint64(cells // ROWS - 1)
    for k, by in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        h = values * np.uint64(by)
        yield ((h ^ (h >> np.uint64(33))) & each) + np.uint64(k * (cells // ROWS))


def sketch(docs: DataFrame, cells: int, window: int = WINDOW, inner: int = INNER) -> bytes:
    """A bit for each cell that at least two documents may have reached."""
    block = min(BLOCK_CELLS, cells)

    def partial(batches):
        import numpy as np

        windows = Windows(window, inner)
        for b in (x for y in batches for x in pieces(y, 0)):
            row, _, _, _, low = windows(b.column(0))
            new = np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])) if len(low) else np.zeros(0, bool)
            row, low = row[new], low[new]
            order = np.lexsort((low, row))
            row, low = row[order], low[order]
            if not len(low):
                continue
            low = low[np.append(True, (low[1:] != low[:-1]) | (row[1:] != row[:-1]))]
            at, n = np.unique(np.concatenate(list(_cells(low, cells))), return_counts=True)
            edges = np.searchsorted(at, np.arange(0, cells + block, block, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[k], edges[k + 1])
                inside = (at[own] - np.uint64(k * block)).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([inside.tobytes()]), pa.array([inside[n[own] > 1].tobytes()])], ["block", "once", "more"])

    def merged(batches):
        import numpy as np

        now, counts = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(counts > 1).tobytes()])], ["block", "bits"])

        for b in batches:
            for k, once, more in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if k != now:
                    if now is not None:
                        yield done()
                    now, counts = k, np.zeros(block, np.uint8)
                at = np.frombuffer(once.as_buffer(), "<u4")
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(more.as_buffer(), "<u4")] = 2
        if now is not None:
            yield done()

    parts = docs.select("text").mapInArrow(partial, "block int, once binary, more binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, bits binary").toArrow()
    out = bytearray(cells // 8)
    for k, bits in zip(blocks["block"].to_pylist(), blocks["bits"], strict=True):
        out[k * block // 8 : (k + 1) * block // 8] = bits.as_buffer().to_pybytes()
    return bytes(out)


def repeats(docs: DataFrame, window: int = WINDOW, inner: int = INNER, most_cells: int = MOST_CELLS) -> DataFrame:
    """id, text_hash, starts: the places of the windows of each row that a document with a smaller doc_id also has."""
    import numpy as np

    n_chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    cells = 1 << 16
    while cells < min(most_cells, n_chars // 4):
        cells *= 2
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, cells, window, inner))
    buckets = 16 + n_chars // 4_000_000
    kind = docs.schema["doc_id"].dataType.simpleString()
    u8, i8, i4 = "<u8", "<i8", "<i4"

    def blob(a, kind):
        return pa.array([a.astype(kind).tobytes()], pa.binary())

    # bucket -1 is a batch's list of documents, -2 what the batch has settled itself
    names = ["bucket", "chunk", "first", "second", "ids", "rows", "at", "id", "text_hash"]
    middle = f"bucket int, chunk long, first binary, second binary, ids binary, rows binary, at binary, id array<{kind}>, text_hash array<long>"

    def flagged(batches):
        import xxhash
        from pyspark import TaskContext

        windows, part = Windows(window, inner), TaskContext.get().partitionId()
        seen = np.frombuffer(bits.value, np.uint8)
        for number, b in enumerate(x for y in batches for x in pieces(y, 1)):
            row, at, k1, k2, low = windows(b.column(1))
            keep = np.ones(len(low), bool)
            for c in _cells(low, cells):
                keep &= (seen[(c >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (c & np.uint64(7))).astype(np.uint8)) & 1 == 1
            if not keep.any():
                continue
            row, at, k1, k2 = row[keep], at[keep], k1[keep], k2[keep]
            ids = pa.compute.fill_null(b.column(0).cast(pa.int64()), 2**63 - 1).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids[row], k2, k1))
            row, at, k1, k2 = row[order], at[order], k1[order], k2[order]
            own = ids[row]
            new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
            least = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
            settled = own > least
            chunk = xxhash.xxh3_64_intdigest(b"%d %d " % (part, number) + k1.tobytes()) - 2**63
            none, lists = pa.nulls(1, pa.binary()), (pa.nulls(1, pa.list_(b.column(0).type)), pa.nulls(1, pa.list_(pa.int64())))
            made = lambda k, *a: pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), *a], names)
            used = np.unique(row)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield made(-1, none, none, none, blob(used, i4), none, one(b.column(0).take(pa.array(used))), one(b.column(2).take(pa.array(used))))
            if settled.any():
                yield made(-2, none, none, none, blob(row[settled], i4), blob(at[settled], i4), *lists)
            open_ = ~settled
            row, at, k1, k2, own = row[open_], at[open_], k1[open_], k2[open_], own[open_]
            to = ((k1 >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                i = order[edges[k] : edges[k + 1]]
                yield made(k, blob(k1[i], u8), blob(k2[i], u8), blob(own[i], i8), blob(row[i], i4), blob(at[i], i4), *lists)

    def grouped(batches):
        def done(held):
            chunks = np.repeat(np.array([h[0] for h in held]), [len(h[1]) for h in held])
            k1, k2, own, row, at = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
            order = np.lexsort((own, k2, k1))
            k1, k2, own, row, at, chunks = (x[order] for x in (k1, k2, own, row, at, chunks))
            new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
            gone = own > own[np.flatnonzero(new)[np.cumsum(new) - 1]]
            row, at, chunks = row[gone], at[gone], chunks[gone]
            order = np.argsort(chunks, kind="stable")
            row, at, chunks = row[order], at[order], chunks[order]
            edges = [*np.flatnonzero(np.diff(chunks, prepend=chunks[0] - 1)), len(chunks)] if len(chunks) else []
            for x, y in zip(edges, edges[1:], strict=False):
                none = pa.nulls(1, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int32()), pa.array([chunks[x]], pa.int64()), none, none, none, blob(row[x:y], i4), blob(at[x:y], i4), pa.nulls(1, pa.list_(ids_of)), pa.nulls(1, pa.list_(pa.int64()))], names)

        now, held, ids_of = None, [], None
        for b in batches:
            ids_of = b.column(7).type.value_type
            for i, k in enumerate(b.column(0).to_pylist()):
                if k < 0:
                    yield b.slice(i, 1)
                    continue
                if k != now and held:
                    yield from done(held)
                    held = []
                now = k
                held.append((b.column(1)[i].as_py(), *[np.frombuffer(b.column(j)[i].as_buffer(), t) for j, t in ((2, u8), (3, u8), (4, i8), (5, i4), (6, i4))]))
        if held:
            yield from done(held)

    def returned(batches):
        def done(who, parts):
            if not parts:
                return
            row, at = np.concatenate([r for r, _ in parts]), np.concatenate([a for _, a in parts])
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            rows, edges = np.unique(row, return_index=True)
            where = np.searchsorted(who[0], rows)
            starts = [at[x:y].astype(i4).tobytes() for x, y in zip(edges, [*edges[1:], len(row)], strict=True)]
            yield pa.RecordBatch.from_arrays([who[1].take(pa.array(where)), who[2].take(pa.array(where)), pa.array(starts, pa.binary())], ["id", "text_hash", "starts"])

        now, who, parts = None, None, []
        for b in batches:
            for i, (k, c) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if c != now and now is not None:
                    yield from done(who, parts)
                    parts = []
                now = c
                rows = np.frombuffer(b.column(5)[i].as_buffer(), i4)
                if k == -1:
                    who = (rows, b.column(7)[i].values, b.column(8)[i].values)
                else:
                    parts.append((rows, np.frombuffer(b.column(6)[i].as_buffer(), i4)))
        if now is not None:
            yield from done(who, parts)

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    first = rows.mapInArrow(flagged, middle)
    settled = first.repartition("bucket", F.when(F.col("bucket") < 0, F.col("chunk"))).sortWithinPartitions("bucket").mapInArrow(grouped, middle)
    back = settled.repartition("chunk").sortWithinPartitions("chunk", F.desc("bucket"))
    return back.mapInArrow(returned, f"id {kind}, text_hash long, starts binary").dropDuplicates(["id", "text_hash"])


def without_repeats(docs: DataFrame, window: int = WINDOW, inner: int = INNER, most_cells: int = MOST_CELLS, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and the kept words joined by one space if asked for."""
    import numpy as np

    found = repeats(docs, window, inner, most_cells)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("own_hash"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left").select("doc_id", "text", "starts")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import hashlib
        import re

        words = re.compile(WORD).findall
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x, s in zip(b.column(1), b.column(2), strict=True):
                own = words(x.as_py() or "")
                n = len(own)
                if s.is_valid:
                    at = np.frombuffer(s.as_buffer(), "<i4")
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                kept = " ".join(own)
                for to, v in zip(out, (n, n - len(own), hashlib.sha256(kept.encode()).hexdigest(), kept), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), *([pa.array(out[3])] if text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 5 if text else 4])

    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", text string" * text)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


#: The same from the definition, every window spelt out.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q, len(w) AS n FROM d),
windows AS (SELECT doc_id, q, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS g FROM each),
whole AS (SELECT doc_id, q, g FROM windows WHERE q + 49 <= n),
firsts AS (SELECT g, min(doc_id) AS first FROM whole GROUP BY g),
starts AS (SELECT w.doc_id, w.q, CAST(f.first < w.doc_id AS INT) AS again FROM whole w JOIN firsts f USING (g)),
covered AS (SELECT e.doc_id, e.q, e.word, max(coalesce(again, 0)) OVER (PARTITION BY e.doc_id ORDER BY e.q ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM each e LEFT JOIN starts s ON s.doc_id = e.doc_id AND s.q = e.q),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (gone = 0) AS t FROM covered GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
