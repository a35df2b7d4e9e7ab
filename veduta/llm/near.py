"""Near-duplicates by order MinHash, verified by banded alignment.

Words are runs of letters, digits and underscores, lower-cased.  A document's k-mers are its five-word runs in text order
(one of all words if it has fewer), each labelled with its occurrence number.  A sketch takes the ``ELL`` k-mers that
are least under one of ``TABLES`` hash functions and keeps them in text order; documents with an equal sketch are
candidates.  At a similarity of 0.8 a pair of long texts shares one of the sketches with probability
1 - (1 - 0.8**4)**24, all but some 3 in a million, and one of 20 k-mers all but some 10 in a million; texts with fewer
than ``SHORT`` k-mers are compared exactly.

Similarity of two documents is L / (a + b - L), where a and b are their numbers of k-mers and L is the length of
their longest common subsequence of labelled k-mers.  A similarity of ``least`` allows (a + b)(1 - least)/(1 + least)
unmatched k-mers, so only matches within that band of the diagonal are aligned, and pairs with too few common k-mers
are not aligned at all.  Documents of 0.8 or more are linked; a class is a connected component of links.

Documents with equal words are one text.  Texts are compared in rounds: each with the centre with which it shares
most sketches; then one pair for each two classes that still share a bucket, several times, about other centres.  Of
the buckets that then still hold several classes, only texts remain of which at least ``least`` of the k-mers stand in
texts of other classes, as they do in similar ones: texts that merely share a common passage go.  Those that remain in a
bucket are paired by outlines, bits for their k-mers that tell how many a text lacks at least.  Short texts are paired
where they share one of their rarest k-mers, as similar ones do.  Pairs within a class are never needed, so a bucket
of thousands of near copies costs a few comparisons each, and no link between classes is lost.  Components are found by
joins, pointers halving each time.

Null and empty texts, and others without a word, have no near-duplicates: rows without a word are in one class only if
doc_id and text are equal.  Repeated rows are in one class.  Very long texts are sketched and aligned whole.  Of equally
good centres the larger row counts, which may change comparisons but not classes; of a class the row with the smallest
doc_id is kept, null being smaller than any other, and of these one.  An empty table gives an empty result.
``near_groups`` reads doc_id and text alone; ``near_dedup`` keeps every column, whatever its name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veduta.llm.common import cut, grouped_rows, keep_rows, release, repeated, table

K, ELL, TABLES, LEAST, ROUNDS, SHORT = 5, 4, 24, 0.8, 3, 20


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Kmers:
    """text -> (number of words, digest of the words, labels of its k-mers in text order)."""

    def __init__(self, k: int = K):
        import re

        self.k, self.words, self.hashes = k, re.compile(r"\w+").findall, WordHashes()

    def __call__(self, text: str | None):
        import numpy as np
        import xxhash

        words = self.words((text or "").lower())
        a = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        digest = xxhash.xxh3_128_digest(a.tobytes())
        if not words:
            return 0, digest, a
        k = min(self.k, len(a))
        h = np.zeros(len(a) - k + 1, np.uint64)
        for i in range(k):
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - k + 1 + i]
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.append(True, s[1:] != s[:-1])
        occurrence = np.empty(len(h), np.uint64)
        occurrence[order] = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        labels = (h + occurrence * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xFF51AFD7ED558CCD)
        return len(words), digest, labels ^ (labels >> np.uint64(33))


def order_sketches(labels, tables: int = TABLES, ell: int = ELL):
    """One 64-bit key for each hash function: its ``ell`` least labels in text order."""
    import numpy as np

    seeds = np.random.default_rng(11).integers(0, 2**64, tables, dtype=np.uint64)
    out = np.empty(tables, np.uint64)
    step = max(1, 1_000_000 // len(labels))
    for i in range(0, tables, step):
        own = seeds[i : i + step, None]
        h = (labels[None, :] ^ own) * np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        at = np.argpartition(h, ell - 1, axis=1)[:, :ell] if len(labels) > ell else np.argsort(h, axis=1)
        key = own[:, 0].copy()
        for column in labels[np.sort(at, axis=1)].T:
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + column
        out[i : i + step] = key
    return out


def aligned(a, b, least: float = LEAST) -> float:
    """Similarity of two label sequences by banded alignment; 0 where it must be under ``least``."""
    from bisect import bisect_left

    import numpy as np

    total = len(a) + len(b)
    need = least * total / (1 + least) - 1e-9
    if not total or min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= total - 2 * need
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        n = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        n = len(tails)
    return n / (total - n)


def _sketched(docs: DataFrame, k: int, ell: int, tables: int) -> DataFrame:
    """doc_id, text_hash, n_words, digest, n, keys of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np

        kmers = Kmers(k)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for x in b.column(1):
                n, digest, labels = kmers(x.as_py())
                keys = order_sketches(labels, tables, ell).astype(np.int64) if n else np.zeros(0, np.int64)
                for to, v in zip(out, (n, digest, len(labels), keys), strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_words", "digest", "n", "keys"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_words long, digest binary, n long, keys array<long>")


def _verified(pairs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough."""

    def run(batches):
        import numpy as np

        for b in batches:
            ok = [aligned(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), least) >= least for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = labels.select(F.col("rep").alias("a"), F.col("labels").alias("labels_a"))
    right = labels.select(F.col("rep").alias("b"), F.col("labels").alias("labels_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "labels_a", "labels_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """A written table (node, label, moved) of every node of the links (a, b): the least node of its component.

    A node takes the least label about it and that label's own, until none moves; a step's table replaces the last's.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        there = now.select(F.col("node").alias("b"), F.col("label").alias("there"))
        low = both.join(there, "b").groupBy("a").agg(F.min("there").alias("low"))
        own = now.join(low, F.col("node") == F.col("a")).select("node", "label", F.least("label", "low").alias("low"))
        jump = now.select(F.col("node").alias("low"), F.col("label").alias("next"))
        least = F.least("low", "next")
        after = cut(own.join(jump, "low").select("node", least.alias("label"), (least != F.col("label")).alias("moved")))
        release(now)
        now = after
        if now.where("moved").isEmpty():
            release(both)
            return now


class Classes:
    """The classes so far: node, label of every linked text; any other is its own class."""

    def __init__(self, links: DataFrame):
        self.table = components(links)

    def add(self, links: DataFrame) -> None:
        """Merges classes by links between their labels; only these are looked at."""
        more, old = components(links), self.table
        to = more.select(F.col("node").alias("n"), F.col("label").alias("to"))
        known = old.join(to, F.col("label") == F.col("n"), "left").select("node", F.coalesce("to", "label").alias("label"))
        fresh = more.join(old.select("node"), "node", "left_anti").select("node", "label")
        self.table = cut(known.unionByName(fresh))
        release(old, more)

    def of(self, rows: DataFrame, node: str, name: str) -> DataFrame:
        """``rows`` with the class of ``node``."""
        own = self.table.select(F.col("node").alias(f"__{name}"), F.col("label").alias(name))
        return rows.join(own, F.col(node) == F.col(f"__{name}"), "left").select(*rows.columns, F.coalesce(name, node).alias(name))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts lie in two classes, with these as la and lb."""
        return self.of(self.of(pairs, "a", "la"), "b", "lb").where("la <> lb")


def _fits(x: str, y: str, least: float):
    """Whether sizes differ so little that texts of these can be similar enough."""
    return F.least(x, y) >= least * F.greatest(x, y) - 1e-9


def _prefix_pairs(labels: DataFrame, texts: DataFrame, least: float, block: int = 256) -> DataFrame:
    """a, b, la, lb: all pairs of ``texts`` (rep, la) of two classes that may be similar enough.

    Labels are ordered by how many texts hold them, those within one class first.  Two similar texts share a label among
    the first n - ceil(least * n) + 1 of each, which a common passage is not among, as its labels are frequent.  Texts
    that meet at a label held by more than ``block`` of them meet by pairs of blocks.
    """

    def spread(batches):
        import numpy as np

        for b in batches:
            own = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(2)]
            n = [len(x) for x in own]
            each = lambda c: pa.array(np.repeat(c.to_numpy(), n))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), each(b.column(0)), each(b.column(1)), pa.array(np.repeat(np.array(n), n))], ["label", "rep", "la", "n"])

    each = cut(texts.join(labels, "rep").select("rep", "la", "labels").mapInArrow(spread, "label long, rep long, la long, n long"))
    held = F.count("*").alias("held"), F.min("la").alias("lo"), F.max("la").alias("hi")
    common = cut(each.groupBy("label").agg(*held).where("lo <> hi").select("label", "held"))
    whole = Window.partitionBy("rep")
    ranked = grouped_rows(each, common, "label", "held")
    ranked = ranked.withColumns({"place": F.row_number().over(whole.orderBy("held", "label")), "own": F.col("n") - F.count("*").over(whole)})
    place = (F.col("own") + F.col("place")).alias("place")  # from 1, among all of the text's labels
    first = ranked.where(F.col("own") + F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1).select("label", "rep", "la", "n", place)
    first = cut(first)
    blocks = first.groupBy("label").agg(*held).where("lo <> hi").select("label", F.ceil(F.col("held") / block).cast("int").alias("blocks"), "held")
    blocks = cut(blocks)
    met = grouped_rows(first, blocks, "label", "held").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "la", "n", "place")
    names = ("block", "rep", "la", "n", "place")
    left = met.select("label", "x", "y", *[F.col(c).alias(f"{c}_a") for c in names])
    right = met.select("label", "x", "y", *[F.col(c).alias(f"{c}_b") for c in names])
    # Once for each pair of blocks; of what follows a shared label, enough must be left in both.
    once = (F.col("rep_a") < F.col("rep_b")) & (F.col("la_a") != F.col("la_b")) & ((F.col("x") == F.col("y")) == (F.col("block_a") == F.col("block_b")))
    need = least * (F.col("n_a") + F.col("n_b")) / (1 + least) - 1e-6
    enough = 1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need
    pairs = left.join(right, ["label", "x", "y"]).where(once & _fits("n_a", "n_b", least) & enough)
    out = cut(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), F.col("la_a").alias("la"), F.col("la_b").alias("lb")).distinct())
    release(each, common, first, blocks)
    return out


def _supported(labels: DataFrame, texts: DataFrame, least: float, part: int = 100_000, bucket: int = 400_000) -> DataFrame:
    """rep: those of ``texts`` (rep, la) of which enough labels stand in texts of other classes.

    A text of n labels that is similar to one of another class has least * n labels or more in common with it.  Texts go
    in chunks of some ``part`` labels; the labels of a chunk are dealt into buckets, packed, where labels of two
    classes are found; how many of these each text has goes back to its chunk.
    """
    n_labels = texts.join(labels, "rep").agg(F.sum(F.length("labels"))).first()[0] or 0
    buckets = 8 + n_labels // 8 // bucket
    names = ["bucket", "chunk", "labels", "classes", "at", "n"]
    middle = "bucket int, chunk long, labels binary, classes binary, at binary, n binary"

    def row(k, chunk, *blobs):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], names)

    def spread(batches):
        import numpy as np
        import xxhash
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), "<u8") for x in b.column(2)]
            n = np.array([len(x) for x in own], np.int64)
            ends = np.flatnonzero(np.diff(np.cumsum(n) // part, append=-1)) + 1
            for x, y in zip([0, *ends], ends, strict=False):
                reps, classes = (b.column(j)[x:y].to_numpy() for j in (0, 1))
                chunk = xxhash.xxh3_64_intdigest(b"%d %d " % (task, number) + reps.tobytes()) - 2**63
                number += 1
                at, all_ = np.repeat(np.arange(y - x, dtype="<u4"), n[x:y]), np.concatenate(own[x:y])
                yield row(-1, chunk, reps, n[x:y], np.zeros(0, "<u4"), np.zeros(0, "<u4"))
                to = ((all_ >> np.uint64(13)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    i = order[edges[k] : edges[k + 1]]
                    yield row(k, chunk, all_[i], classes[at[i]], at[i], np.zeros(0, "<u4"))

    def counted(batches):
        import numpy as np

        def done(held):
            all_, classes = (np.concatenate([h[j] for h in held]) for j in (1, 2))
            order = np.argsort(all_, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(all_[order]) != 0))
            low, high = (f.reduceat(classes[order], starts) for f in (np.minimum, np.maximum))
            mixed = np.empty(len(all_), bool)
            mixed[order] = np.repeat(low != high, np.diff(starts, append=len(all_)))
            p = 0
            for chunk, own, _, at in held:
                got = np.bincount(at[mixed[p : p + len(own)]]) if len(own) else np.zeros(0, int)
                p += len(own)
                some = np.flatnonzero(got)
                if len(some):
                    yield row(-2, chunk, np.zeros(0, "<u8"), np.zeros(0, "<u8"), some.astype("<u4"), got[some].astype("<u4"))

        now, held = None, []
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                if k < 0:
                    yield b.slice(i, 1)
                    continue
                if k != now and held:
                    yield from done(held)
                    held = []
                now = k
                held.append((b.column(1)[i].as_py(), *[np.frombuffer(b.column(j)[i].as_buffer(), t) for j, t in ((2, "<u8"), (3, "<i8"), (4, "<u4"))]))
        if held:
            yield from done(held)

    def enough(batches):
        import numpy as np

        now, whole, got = None, None, []

        def done():
            reps, n = whole
            shared = np.zeros(len(reps), np.int64)
            for at, k in got:
                shared[at] += k
            return pa.RecordBatch.from_arrays([pa.array(reps[shared >= np.ceil(n * least - 1e-6)])], ["rep"])

        for b in batches:
            for i, (k, c) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if c != now and now is not None:
                    yield done()
                    whole, got = None, []
                now = c
                if k == -1:
                    whole = tuple(np.frombuffer(b.column(j)[i].as_buffer(), "<i8") for j in (2, 3))
                else:
                    got.append(tuple(np.frombuffer(b.column(j)[i].as_buffer(), "<u4") for j in (4, 5)))
        if now is not None:
            yield done()

    lists = texts.join(labels, "rep").select("rep", "la", "labels").mapInArrow(spread, middle)
    counts = lists.repartition("bucket", F.when(F.col("bucket") < 0, F.col("chunk"))).sortWithinPartitions("bucket").mapInArrow(counted, middle)
    return counts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(enough, "rep long")


def _bucket_pairs(members: DataFrame, texts: DataFrame, least: float, block: int = 512, words: int = 64) -> DataFrame:
    """a, b, la, lb: the pairs of two classes that share a bucket and may be similar enough, each once.

    ``members`` (rep, key, held) of open buckets; ``texts`` (rep, la, n, keys, labels).  A text's outline has a bit for each
    of its labels modulo 64 * ``words``: bits of one text that another lacks are labels that it lacks.  Members of one bucket
    meet by pairs of blocks of some ``block`` texts; a pair counts in the first bucket that it shares.
    """

    def outlined(batches):
        import numpy as np

        for b in batches:
            out = []
            for x in b.column(4):
                bits = np.zeros(64 * words, np.uint8)
                bits[(np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(40)).astype(np.int64) % (64 * words)] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(4)), pa.array(out, pa.binary())], ["rep", "la", "n", "keys", "outline"])

    outlines = cut(texts.select("rep", "la", "n", "keys", "labels").mapInArrow(outlined, "rep long, la long, n long, keys array<long>, outline binary"))
    blocks = F.ceil(F.col("held") / block).cast("int")
    met = members.withColumns({"block": F.pmod(F.xxhash64("rep"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    met = met.select("rep", "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block")
    cells = met.join(outlines, "rep").select("key", "x", "y", "block", "rep", "la", "n", "keys", "outline")

    def paired(batches):
        import numpy as np

        def done(cell, held):
            key, x, y = cell
            block_, rep, la, n, keys, outline = (np.concatenate([h[j] for h in held]) for j in range(6))
            if len(rep) < 2 or la.min() == la.max():
                return
            for p in range(0, len(rep), 64):
                q = slice(p, p + 64)
                ok = (rep[q, None] < rep) & (la[q, None] != la) & ((block_[q, None] == block_) == (x == y))
                ok &= np.minimum(n[q, None], n) >= least * np.maximum(n[q, None], n) - 1e-9
                all_i, all_j = np.nonzero(ok)
                for r in range(0, len(all_i), 32_768):
                    i, j = all_i[r : r + 32_768] + p, all_j[r : r + 32_768]
                    need = np.ceil(least * (n[i] + n[j]) / (1 + least) - 1e-6)
                    good = np.bitwise_count(outline[i] & ~outline[j]).sum(axis=1, dtype=np.int64) <= n[i] - need
                    i, j, need = i[good], j[good], need[good]
                    good = np.bitwise_count(outline[j] & ~outline[i]).sum(axis=1, dtype=np.int64) <= n[j] - need
                    i, j = i[good], j[good]
                    first = keys[i, (keys[i] == keys[j]).argmax(axis=1)] == key
                    i, j = i[first], j[first]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (rep[i], rep[j], la[i], la[j])], ["a", "b", "la", "lb"])

        now, held = None, []
        for b in batches:
            at = np.stack([b.column(j).to_numpy() for j in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for p, q in zip(edges, edges[1:], strict=False):
                cell, part = tuple(at[p].tolist()), b.slice(p, q - p)
                if cell != now and held:
                    yield from done(now, held)
                    held = []
                now = cell
                own = np.frombuffer(b"".join(part.column(8).to_pylist()), np.uint64).reshape(len(part), words)
                held.append((*(part.column(j).to_numpy() for j in range(3, 7)), part.column(7).flatten().to_numpy().reshape(len(part), -1), own))
        if held:
            yield from done(now, held)

    sorted_ = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    out = cut(sorted_.mapInArrow(paired, "a long, b long, la long, lb long"))
    release(outlines)
    return out


def near_groups(docs: DataFrame, k: int = K, ell: int = ELL, tables: int = TABLES, least: float = LEAST, rounds: int = ROUNDS, short: int = SHORT) -> DataFrame:
    """doc_id, class_id (the class's smallest doc_id), class_size, kept (one row of each class) and text_hash."""
    wordless = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_hash"))
    rows = _sketched(docs, k, ell, tables).withColumn("digest", F.when(F.col("n_words") > 0, F.col("digest")).otherwise(F.md5(wordless).cast("binary")))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    first, smallest = F.min(F.struct("row", "doc_id", "text_hash")).alias("first"), F.min(F.struct("doc_id", "row")).alias("smallest")
    texts = rows.groupBy("digest").agg(first, smallest, F.count("*").alias("copies"), F.min("n").alias("n"), F.any_value("keys").alias("keys"))
    texts = cut(texts.select(F.col("first.row").alias("rep"), "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "smallest", "copies", "n", "keys"))
    reps = texts.where("n > 0")

    # Buckets of two texts or more: their members, each with the bucket's centres.
    each = reps.select("rep", "n", F.explode("keys").alias("key"))
    centre = [F.min(F.struct(F.xxhash64("rep", F.lit(r)), "rep", "n")) for r in range(rounds)]
    centre = [c.getField(f).alias(f"{f}{r}") for r, c in enumerate(centre) for f in ("rep", "n")]
    centres = cut(each.groupBy("key").agg(F.count("*").alias("held"), *centre).where("held > 1"))
    members = cut(grouped_rows(each, centres, "key", "held").drop("held"))

    brief = F.col("n") * least < short  # all that may be similar to a short text
    needed = members.select("rep").unionByName(reps.where(brief).select("rep")).distinct()
    # The side that is hashed has 24 bytes a text.
    wanted = needed.join(reps, "rep").select("rep", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).hint("shuffle_hash")
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("own_hash"))
    found = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash"))).select("rep", "text")

    def labelled(batches):
        kmers = Kmers(k)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kmers(x.as_py())[2].astype("<u8").tobytes() for x in b.column(1)], pa.binary())], ["rep", "labels"])

    labels = found.mapInArrow(labelled, "rep long, labels binary")
    if repeated(rows):
        labels = labels.dropDuplicates(["rep"])
    labels = cut(labels)

    def about(r: int) -> DataFrame:
        """Each text with the centres of its buckets, and the number of buckets."""
        there = members.where((F.col("rep") != F.col(f"rep{r}")) & _fits("n", f"n{r}", least))
        return there.groupBy(F.col("rep").alias("a"), F.col(f"rep{r}").alias("b")).agg(F.count("*").alias("shared"))

    tried = cut(about(0).groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")))
    links = cut(_verified(tried, labels, least))
    classes = Classes(links)
    release(links)

    def joined(pairs: DataFrame) -> None:
        """Verifies pairs, given with their classes la and lb, and joins the classes of the similar ones."""
        links = cut(pairs.join(_verified(pairs, labels, least), ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        if not links.isEmpty():
            classes.add(links)
        release(links)

    for r in range(1, rounds):
        pair = F.max_by(F.struct("a", "b", "la", "lb"), F.struct("shared", "a", "b")).alias("pair")
        chosen = classes.apart(about(r)).groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(pair)
        more = cut(chosen.select("pair.*").join(tried, ["a", "b"], "left_anti"))
        joined(more)
        before, tried = tried, cut(tried.unionByName(more.select("a", "b")))
        release(more, before)

    # What is left: the texts of buckets that still hold several classes, and short ones.
    mixed = classes.of(members, "rep", "la").groupBy("key").agg(F.min("la").alias("lo"), F.max("la").alias("hi"), F.count("*").alias("held"))
    mixed = cut(mixed.where("lo <> hi").select("key", "held"))
    open_ = cut(grouped_rows(members.select("rep", "key"), mixed, "key", "held"))
    left = cut(classes.of(open_.select("rep").distinct(), "rep", "la"))
    likely = cut(_supported(labels, left, least))
    whole = left.join(likely, "rep", "left_semi").join(reps.select("rep", "n", "keys"), "rep").join(labels, "rep")
    rest = _bucket_pairs(open_.join(likely, "rep", "left_semi"), whole, least)
    few = cut(classes.of(reps.where(brief).select("rep"), "rep", "la"))
    short_ = _prefix_pairs(labels, few, least)
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    last = cut(rest.unionByName(short_).distinct().join(done, ["a", "b"], "left_anti"))
    joined(last)
    release(rest, short_, last, few, likely, left, open_, mixed, tried, labels, members, centres)

    own = cut(classes.of(texts.select("digest", "rep", "copies", "smallest"), "rep", "class"))
    groups = cut(own.groupBy("class").agg(F.min("smallest").alias("least"), F.sum("copies").alias("class_size"), F.count("*").alias("held")))
    own = cut(grouped_rows(own, groups, "class", "held").select("digest", "copies", "least", "class_size"))
    out = grouped_rows(rows.select("doc_id", "text_hash", "row", "digest"), own, "digest", "copies")
    return out.select("doc_id", F.col("least.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("least.row")).alias("kept"), "text_hash")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with its columns."""
    return keep_rows(docs, near_groups(docs, **how).where("kept"))


def op2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("text_hash")
