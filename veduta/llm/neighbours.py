"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by Euclidean distance are the nearest by cosine.  Each of ``TABLES``
tables hashes a vector to some integers floor((a.x + b) / WIDTH) with Gaussian a.  A query visits its own bucket
of each table and then perturbed ones, a step up or down in some coordinates, in the order of estimated success: the
sum of squared distances to the edges crossed, of which the expected order over sorted edges is computed once.
Candidates of all tables are reranked by exact cosine in double precision.

How many hashes a table has and how many buckets are visited is found by trial: the true neighbours of ``SAMPLE`` queries
are searched exactly, and of ``CHOICES`` hashes and an eighth to 8 times ``PROBES`` buckets those are taken that would
find ``RECALL`` of them at the least cost: the rows visited, by the share of some sampled ones, and the probes, each of
which takes as long as ``PROBE`` rows; so tables with more rows get more hashes.  If none does, as among vectors of many dimensions none of which are near, every query is searched
exactly, in blocks.  So is each query for which the probes found less than five vec_ids, or than all if there are fewer.

Buckets are dealt to groups of some ``GROUP`` rows; a bucket with more rows is split by row over several groups, so
a vector that a third of all rows resemble is no single task.  A query goes once to each group that holds a bucket of
its probes, and leaves with its nearest five vec_ids there.  Rows equal in vec_id and vector are one index row in every
table; equal vectors of other vec_ids are index rows of their own, and so are the vectors of one vec_id.

Vectors null, empty, zero or holding null or non-finite components take no part, nor rows with a null vec_id or of
another dimension than the commonest (the smaller of equally common ones).  Ties go to the smaller vec_id.  Equal
vec_ids are one row's own: a query never finds its own vec_id, and a vec_id is found once, with its best score.  An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veduta.llm.common import cut, table

TABLES, HASHES, WIDTH, PROBES, TOP, GROUP = 6, None, 2.0, 1000, 5, 4096
#: Hashes of a table that are tried.
CHOICES = (8, 10, 12, 14, 16, 20)
#: Rows that are ranked in the time of a probe.
PROBE = 16
#: Least recall over SAMPLE queries; most times PROBES that are probed for it; components in a block of exact search.
RECALL, SAMPLE, MORE, BLOCK = 0.95, 64, 8, 1_000_000


class Hashing:
    def __init__(self, size: int, tables: int, hashes: int, width: float = WIDTH, probes: int = PROBES, seed: int = 5):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width, self.probes = tables, hashes, width, probes
        self.a, self.b = rng.normal(size=(tables, hashes, size)), rng.uniform(0, width, size=(tables, hashes))
        self.odd = rng.integers(0, 2**63, hashes, dtype=np.uint64) | np.uint64(1)

    def places(self, x):
        """(vectors, tables, hashes) real positions in units of the width."""
        import numpy as np

        return (np.einsum("thd,nd->nth", self.a, x) + self.b) / self.width

    def keys(self, cells):
        """A 64-bit key for each row of cells (last axis: hashes)."""
        import numpy as np

        h = (cells.astype(np.int64).astype(np.uint64) * self.odd).sum(axis=-1, dtype=np.uint64)
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)

    def template(self):
        """Sets of ranks among the 2 * hashes sorted edge distances, the likeliest first; the first is empty."""
        import heapq

        import numpy as np

        m = self.hashes
        j = np.arange(1, 2 * m + 1, dtype=float)
        cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
        out, heap = [()], [(cost[0], (0,))]
        while heap and len(out) < self.probes:
            c, s = heapq.heappop(heap)
            if len({min(x, 2 * m - 1 - x) for x in s}) == len(s):  # not both edges of a coordinate
                out.append(s)
            if s[-1] + 1 < 2 * m:
                heapq.heappush(heap, (c - cost[s[-1]] + cost[s[-1] + 1], (*s[:-1], s[-1] + 1)))
                heapq.heappush(heap, (c + cost[s[-1] + 1], (*s, s[-1] + 1)))
        masks = np.zeros((len(out), 2 * m), bool)
        for i, s in enumerate(out):
            masks[i, list(s)] = True
        return masks

    def probed(self, x, masks):
        """Keys (tables, probes) of one vector's buckets, the likeliest first."""
        import numpy as np

        at = self.places(x[None])[0]
        cell = np.floor(at)
        low = at - cell
        out = np.empty((self.tables, len(masks)), np.int64)
        for t in range(self.tables):
            order = np.argsort(np.concatenate([low[t], 1 - low[t]]), kind="stable")
            steps = np.zeros((2 * self.hashes, self.hashes), np.int64)
            for rank, e in enumerate(order):
                steps[rank, e % self.hashes] = -1 if e < self.hashes else 1
            out[t] = self.keys(cell[t].astype(np.int64) + (masks.astype(np.float32) @ steps.astype(np.float32)).astype(np.int64))
        return out


def neighbours(vectors: DataFrame, every: int = 50, top: int = TOP, tables: int = TABLES, hashes: int | None = HASHES, width: float = WIDTH, probes: int = PROBES, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by ``every``, against all rows."""
    import numpy as np

    sound = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = common["n"]
    # Rows equal in vec_id and vector are one index row; those of one vec_id but other vectors have numbers of their own.
    rows = rows.where(F.size("v") == size).distinct()
    rows = cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    lists = lambda x: x.flatten().to_numpy().reshape(-1, size)

    def unit(x):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def index(batches):
        h = Hashing(*how)
        for b in batches:
            keys = h.keys(np.floor(h.places(unit(lists(b.column(2))))))
            n = len(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(b.column(0).to_numpy(), tables)), pa.array(np.repeat(np.arange(tables, dtype=np.int32), n)), pa.array(keys.T.ravel())], ["row", "t", "key"])

    def probe(batches):
        h = Hashing(*how)
        masks = h.template()
        each = np.repeat(np.arange(tables, dtype=np.int32), len(masks))
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), unit(lists(b.column(2))), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), i)), pa.array(each), pa.array(h.probed(x, masks).ravel())], ["row", "t", "key"])

    def probed(each_keys, key, row):
        # the rows of each query's buckets
        for k in each_keys:
            k = k.values.to_numpy()
            lo, hi = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            yield np.unique(np.concatenate([row[p:r] for p, r in zip(lo, hi, strict=True)])) if len(k) else row[:0]

    def likely(q_ids, q_own, ids, own, place):
        # all rows that may be a query's best, by rounded scores; ids are sorted
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        own = unit(own)
        for at in range(0, len(q_ids), 64):
            scores = own @ unit(q_own[at : at + 64]).T
            best = np.maximum.reduceat(scores, starts, axis=0)
            for j, q in enumerate(q_ids[at : at + 64]):
                others = best[ids[starts] != q, j]
                least = np.partition(others, -top)[-top] if len(others) > top else -2
                yield place[scores[:, j] >= least - 1e-9]

    def rank(batches):
        # a group's index rows (query_id null) come first; queries pass by in batches
        now, ids, keys, own, of = None, [], [], [], []
        for b in batches:
            g = b.column("g").to_numpy()
            query = b.column("query_id")
            edges = [*np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g)]
            for x, y in zip(edges, edges[1:], strict=False):
                part = b.slice(x, y - x)
                if g[x] != now:
                    now, ids, keys, own, of, ready = g[x], [], [], [], [], None
                fresh = part.filter(query.slice(x, y - x).is_null())
                if len(fresh):
                    ids.append(fresh.column("vec_id").to_numpy()), own.append(lists(fresh.column("v")))
                    lengths = pa.compute.list_value_length(fresh.column("keys")).to_numpy()
                    keys.append(fresh.column("keys").flatten().to_numpy())
                    of.append(np.repeat(np.arange(len(fresh)) + sum(map(len, ids[:-1])), lengths))
                asked = part.filter(query.slice(x, y - x).is_valid())
                if not len(asked) or not ids:
                    continue
                whole = asked.column("keys").null_count > 0  # exact search: every row of the group is a candidate
                if ready is None:
                    key, row = np.concatenate(keys), np.concatenate(of)
                    by_key = np.argsort(key, kind="stable")
                    all_ids, all_own = np.concatenate(ids), np.concatenate(own)
                    ready = key[by_key], row[by_key], all_ids, all_own, np.linalg.norm(all_own, axis=1), np.argsort(all_ids, kind="stable")
                key, row, all_ids, all_own, lengths, by_id = ready
                out: list[list] = [[], [], []]
                q_ids, q_own = asked.column("query_id").to_pylist(), lists(asked.column("v"))
                hits = likely(q_ids, q_own, all_ids[by_id], all_own[by_id], by_id) if whole else probed(asked.column("keys"), key, row)
                for q, v, hit in zip(q_ids, q_own, hits, strict=True):
                    hit = hit[all_ids[hit] != q]
                    if not len(hit):
                        continue
                    score = (all_own[hit] * v).sum(axis=1) / (lengths[hit] * np.linalg.norm(v))
                    order = np.lexsort((all_ids[hit], -score))
                    first = np.unique(all_ids[hit][order], return_index=True)[1]  # of each vec_id the best
                    best = order[np.sort(first)[:top]]
                    for to, z in zip(out, ([q] * len(best), all_ids[hit][best].tolist(), score[best].tolist()), strict=True):
                        to.extend(z)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    def ranked(stored, asked):
        # the nearest of each group; index rows have no query_id, queries no vec_id
        both = stored.select("g", F.lit(None).cast("long").alias("query_id"), "vec_id", "v", "keys")
        both = both.unionByName(asked.select("g", "query_id", F.lit(None).cast("long").alias("vec_id"), "v", "keys"))
        found = both.repartition("g").sortWithinPartitions("g", F.asc_nulls_first("query_id")).mapInArrow(lambda bs: rank(bs), "query_id long, vec_id long, score double")
        # Several groups may find a vec_id: its best score, which differs only between vec_ids of several vectors.
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

    def exact(queries):
        # every query against every block of rows
        blocks = 1 + n_rows * size // BLOCK
        stored = rows.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn("keys", F.array().cast("array<long>"))
        asked = queries.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return ranked(stored, asked.withColumn("keys", F.lit(None).cast("array<long>")))

    def met(h, masks, x, keys):
        # for each row of keys (rows, tables) the place of the first probe of x that meets it
        own, first = h.probed(x, masks), np.full(len(keys), len(masks))
        for t in range(tables):
            order = np.argsort(own[t], kind="stable")
            at = np.searchsorted(own[t][order], keys[:, t])
            hit = np.flatnonzero(own[t][order[np.minimum(at, len(order) - 1)]] == keys[:, t])
            first[hit] = np.minimum(first[hit], order[at[hit]])
        return first

    def enough():
        # (hashes, probes) that find RECALL of some queries' true neighbours at the least cost; None if none do
        some = queries.groupBy("query_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("query_id")).limit(SAMPLE).collect()
        if not some:
            return (hashes or CHOICES[0]), probes
        true = cut(exact(queries.sparkSession.createDataFrame(some, "query_id long, v array<double>")))
        near: dict = {}
        for r in true.join(rows, "vec_id").groupBy("query_id", "vec_id").agg(F.max_by("v", "row").alias("v")).collect():
            near.setdefault(r["query_id"], []).append(r["v"])
        others = rows.orderBy(F.xxhash64("row")).limit(max(256, min(4096, 1_000_000 // size))).select("v").collect()
        others, best = unit(np.array([r["v"] for r in others])), None
        for m in [hashes] if hashes else CHOICES:
            h = Hashing(size, tables, m, width, MORE * probes)
            masks, found, seen = h.template(), [], []
            keys_of = lambda v: h.keys(np.floor(h.places(v)))  # noqa: B023, E731
            other_keys = keys_of(others)
            for r in some:
                if r["query_id"] in near:
                    x = unit(np.array([r["v"]]))[0]
                    found.append(met(h, masks, x, keys_of(unit(np.array(near[r["query_id"]])))))
                    seen.append(met(h, masks, x, other_keys))
            found, seen = (np.concatenate(y) if y else np.zeros(0) for y in (found, seen))
            for p in (probes * MORE >> k for k in range(7)):
                if p and (not len(found) or np.mean(found < p) >= RECALL):
                    cost = tables * p * PROBE + n_rows * float(np.mean(seen < p) if len(seen) else 0)
                    if best is None or (cost, p) < best[:2]:
                        best = cost, p, m
        return best and (best[2], best[1])

    n_rows, n_ids = rows.agg(F.count("*"), F.count_distinct("vec_id")).first()
    queries = rows.where(F.col("vec_id") % every == 0).select("row", F.col("vec_id").alias("query_id"), "v")
    chosen = enough()
    if chosen is None:
        return exact(queries)
    how = (size, tables, chosen[0], width, chosen[1])
    placed = cut(rows.mapInArrow(lambda bs: index(bs), "row long, t int, key long"))
    buckets = placed.groupBy("t", "key").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / group).cast("int")
    n_groups = F.lit(1 + placed.count() // group)
    to_group = F.pmod(F.xxhash64("t", "key", "salt"), n_groups).alias("g")
    buckets = cut(buckets.select("t", "key", parts.alias("parts")))
    held = placed.join(buckets, ["t", "key"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).select("row", "key", to_group)
    stored = held.groupBy("row", "g").agg(F.collect_list("key").alias("keys")).join(rows, "row")
    asked = queries.select("row", "query_id", "v").mapInArrow(lambda bs: probe(bs), "row long, t int, key long").join(buckets, ["t", "key"])
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("row", "key", to_group)
    asked = asked.groupBy("row", "g").agg(F.collect_set("key").alias("keys")).join(queries, "row")
    probed_for = cut(ranked(stored, asked))
    # Queries whose probes found too few are searched exactly.
    full = probed_for.groupBy("query_id").count().where(F.col("count") >= min(top, n_ids - 1)).select("query_id")
    short = cut(queries.join(full, "query_id", "left_anti"))
    if short.isEmpty():
        return probed_for
    return probed_for.join(full, "query_id", "left_semi").unionByName(exact(short))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))
