"""Token counts from distinct pre-tokens.

A task splits its texts into pre-tokens and counts them for each document.  A pre-token that few of the task's
documents hold leaves it once, with the documents' places and frequencies (an inverted list); lists of one pre-token meet by a
hash, its pieces are counted once, and count times frequency is summed for each document.  Lists travel packed, those
of one hash bucket in a row, as millions of small rows would cost more than all the counting.  A pre-token
that many of the task's documents hold (over 1 in ``common``, and ``few``) is counted in the task, once for all of
them, and never shuffled: otherwise the rows of the commonest words would meet in one task.  No ids are made; the
tokenizer is asked only for the number of pieces of each distinct pre-token.

Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null doc_ids give a row each.  Very long texts are
counted whole, and runs without a pre-token's end by the tokenizer itself.  There are no ties to break.  An empty table
gives an empty result.  Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veduta.llm.common import Splitter, table

LIMIT, COMMON, FEW = 512, 128, 4
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
_HELD = 4_000_000  # partial sums that a reducing task holds before it passes them on


def token_counts(docs: DataFrame, path: str | None = None, fast: str | None = None, limit: int = LIMIT, common: int = COMMON, few: int = FEW, bucket_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row."""
    import public_tokenizers

    if path is None:
        path, fast = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    buckets = 8 + n_chars // bucket_chars
    # A row is a chunk's pre-tokens of one bucket, packed; bucket -1 lists a chunk's documents, -2 holds partial sums.
    names = ["bucket", "chunk", "keys", "lengths", "holders", "at", "n", "ids", "n_bytes", "n_tokens"]
    middle = f"bucket int, chunk long, keys binary, lengths binary, holders binary, at binary, n binary, ids array<{kind}>, n_bytes array<long>, n_tokens array<long>"

    def split(batches):
        import itertools
        import zlib
        from collections import defaultdict

        import numpy as np
        import xxhash
        from pyspark import TaskContext

        splitter, part = Splitter(path, fast), TaskContext.get().partitionId()
        id_type = None
        for number, b in enumerate(batches):
            id_type = b.column(0).type
            number_of = defaultdict(itertools.count().__next__)
            sizes, lengths, codes, digest = [], [], [], xxhash.xxh3_64(f"{part} {number}")
            for x in b.column(1):
                text = x.as_py() or ""
                data = text.encode()
                sizes.append(len(data))
                digest.update(data)
                own = splitter(text)
                lengths.append(len(own))
                codes.append(np.fromiter(map(number_of.__getitem__, own), np.int64, len(own)))
            chunk, bound, distinct = digest.intdigest() - 2**63, max(few, len(sizes) // common), list(number_of)
            local = np.zeros(len(sizes), np.int64)
            if distinct:
                # one number for (pre-token, row); runs of it are frequencies
                both = np.sort(np.concatenate(codes) * len(sizes) + np.repeat(np.arange(len(sizes)), lengths))
                first = np.flatnonzero(np.diff(both, prepend=-1))
                n, code, row = np.diff(first, append=len(both)), both[first] // len(sizes), both[first] % len(sizes)
                holders = np.bincount(code, minlength=len(distinct))
                near = np.flatnonzero(holders > bound)
                pieces = np.zeros(len(distinct), np.int64)
                pieces[near] = splitter.counts([distinct[i] for i in near])
                local += np.bincount(row, weights=n * pieces[code], minlength=len(sizes)).astype(np.int64)
                starts = np.cumsum(holders) - holders
                far = np.flatnonzero(holders <= bound)
                keys = [distinct[i].encode() for i in far]
                to = np.fromiter(map(zlib.crc32, keys), np.int64, len(keys)) % buckets
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                narrow = "<u2" if len(sizes) < 65536 else "<u4"
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    own = order[edges[k] : edges[k + 1]]
                    held = holders[far[own]]
                    place = np.repeat(starts[far[own]] - np.cumsum(held) + held, held) + np.arange(held.sum())
                    some = [keys[i] for i in own]
                    blobs = (b"".join(some), np.array([len(x) for x in some], "<u4").tobytes(), held.astype("<u4").tobytes(), row[place].astype(narrow).tobytes(), n[place].astype("<u4").tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs], *nothing(id_type)], names)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.binary())] * 5, one(b.column(0)), one(pa.array(sizes, pa.int64())), one(pa.array(local))], names)

    def nothing(id_type):
        return pa.nulls(1, pa.list_(id_type)), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64()))

    def count(batches):
        import numpy as np

        splitter, now, id_type = Splitter(path, fast), None, None
        held: list[tuple] = []
        sums: dict[int, np.ndarray] = {}
        size = 0

        def summed():
            """The rows of one bucket: its distinct pre-tokens are counted once."""
            number: dict[bytes, int] = {}
            coded = []
            for _, keys, lengths, *_ in held:
                ends = np.cumsum(lengths)
                own = [keys[x:y] for x, y in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                coded.append(np.fromiter((number.setdefault(x, len(number)) for x in own), np.int64, len(own)))
            pieces = np.array(splitter.counts([x.decode() for x in number]), np.int64)
            more = 0
            for (c, _, _, holders, at, n), codes in zip(held, coded, strict=True):
                got = np.bincount(at, weights=n * np.repeat(pieces[codes], holders)).astype(np.int64)
                old = sums.get(c)
                if old is None or len(old) < len(got):
                    more += len(got) - (0 if old is None else len(old))
                    sums[c] = got if old is None else np.concatenate([old, np.zeros(len(got) - len(old), np.int64)]) + got
                else:
                    old[: len(got)] += got
            return more

        def passed_on():
            for c, v in sums.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays([pa.array([-2], pa.int32()), pa.array([c], pa.int64()), *[pa.nulls(1, pa.binary())] * 3, pa.array([at.astype("<u4").tobytes()]), pa.array([v[at].astype("<i8").tobytes()]), *nothing(id_type)], names)

        for b in batches:
            id_type = b.column(7).type.value_type
            for i, k in enumerate(b.column(0).to_pylist()):
                if k < 0:
                    yield b.slice(i, 1)
                    continue
                if k != now and held:
                    size += summed()
                    held = []
                    if size > _HELD:
                        yield from passed_on()
                        sums, size = {}, 0
                now = k
                blob = lambda j, kind: np.frombuffer(b.column(j)[i].as_buffer(), kind)  # noqa: B023, E731
                n = blob(6, "<u4")
                at = blob(5, "<u2" if len(b.column(5)[i].as_buffer()) == 2 * len(n) else "<u4")
                held.append((b.column(1)[i].as_py(), b.column(2)[i].as_py(), blob(3, "<u4").astype(np.int64), blob(4, "<u4"), at, n))
        if held:
            summed()
        yield from passed_on()

    def total(batches):
        import numpy as np

        now, whole, extra = None, None, []

        def done():
            out = whole[2].copy()
            for at, n in extra:
                out[at] += n
            return pa.RecordBatch.from_arrays([whole[0], pa.array(whole[1]), pa.array(out), pa.array(out > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        for b in batches:
            for i, (c, bucket) in enumerate(zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)):
                if c != now and now is not None:
                    yield done()
                    whole, extra = None, []
                now = c
                if bucket == -1:
                    whole = (b.column(7)[i].values, b.column(8)[i].values.to_numpy(), b.column(9)[i].values.to_numpy())
                else:
                    extra.append((np.frombuffer(b.column(5)[i].as_buffer(), "<u4"), np.frombuffer(b.column(6)[i].as_buffer(), "<i8")))
        if now is not None:
            yield done()

    lists = docs.select("doc_id", "text").mapInArrow(split, middle)
    spread = lists.repartition("bucket", F.when(F.col("bucket") < 0, F.col("chunk"))).sortWithinPartitions("bucket")
    sums = spread.mapInArrow(count, middle)
    back = sums.repartition("chunk").sortWithinPartitions("chunk")
    return back.mapInArrow(total, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
