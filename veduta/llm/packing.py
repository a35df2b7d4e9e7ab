"""Bounded-space online best-fit packing of documents into fixed-length sequences.

A document is its token ids followed by an end id.  A longer one is cut into pieces of ``length`` tokens, of which
the first may be shorter.  A packer keeps at most ``bins`` open sequences.  A bitset has bit f set while an open
sequence has f tokens free; a piece goes to the lowest set bit at or above its length, or opens a sequence; if that
makes one too many, the fullest closes.  Pieces meet a packer in the order of a hash, so that sizes are mixed and a
rerun gives the same result; there is one packer for about ``per_packer`` documents.

Null and empty text is the end id alone.  Repeated rows and rows with a null doc_id are packed like others.  Very long
texts are tokenized whole and become many pieces, of which all but the first fill a sequence each.  Of equally full
open sequences the one touched last takes a piece or closes.  An empty table gives an empty result.  Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.common import Splitter, table

LENGTH, END, BINS, PER_PACKER = 1024, 2, 4096, 40_000
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


class BestFit:
    """put(length) -> (bin, offset); bins are numbered from 0 in the order in which they open."""

    def __init__(self, length: int = LENGTH, bins: int = BINS):
        self.length, self.bins, self.bits, self.open, self.next = length, bins, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, n: int) -> tuple[int, int]:
        fits = self.bits >> n
        if n and fits:
            free = n + (fits & -fits).bit_length() - 1
            own = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, own = self.length, self.next
            self.next += 1
        if left := free - n:
            self.by_free[left].append(own)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
        return own, self.length - free


def pieces(docs: DataFrame, path: str, fast: str | None, length: int = LENGTH, end: int = END, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, and the ids themselves if asked for."""

    def run(batches):
        import zlib

        import numpy as np

        encode = Splitter(path, fast).ids
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for row, x in enumerate(b.column(1)):
                own = np.append(encode(x.as_py() or ""), np.uint32(end)).astype("<u4")
                edges = [0, *range(len(own) % length or length, len(own) + 1, length)]
                for k, (p, q) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = own[p:q].tobytes()
                    for to, v in zip(out, (row, k, p, q - p, zlib.crc32(part), own[p:q] if ids else None), strict=True):
                        to.append(v)
            arrays = [b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *[pa.array(v, pa.int64()) for v in out[2:5]]]
            if ids:
                arrays.append(pa.array([v.tolist() for v in out[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def pack(parts: DataFrame, packers: int, length: int = LENGTH, bins: int = BINS) -> DataFrame:
    """Adds sequence_id and offset to rows that have ``length``; other columns stay."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields]

    def run(batches):
        from pyspark import TaskContext

        own, base = BestFit(length, bins), TaskContext.get().partitionId() << 40
        for b in batches:
            at = [own.put(n) for n in b.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([base + k for k, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    order = ["__order", "start", "length", "ids_crc32"]
    mixed = parts.withColumn("__order", F.xxhash64("doc_id", "piece")).repartition(packers, "__order").sortWithinPartitions(*order)
    return mixed.drop("__order").mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def packed(docs: DataFrame, path: str | None = None, fast: str | None = None, length: int = LENGTH, end: int = END, bins: int = BINS, ids: bool = False, per_packer: int = PER_PACKER) -> DataFrame:
    import public_tokenizers

    if path is None:
        path, fast = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    packers = 1 + docs.select("doc_id").count() // per_packer
    return pack(pieces(docs, path, fast, length, end, ids), packers, length, bins)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
