"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions alone.

1. Sources in code-point order, null last, weigh 1, 2, 3, 1, ...  Their targets share all words by weight; a target
   stops at ``cap`` times its source's size and the excess is shared again by weight: sources fill up in the order of
   size by weight, and the first whose share fits gives the rate of all that follow.
2. The targets are apportioned into equal blocks of ``block`` words by highest quotients target/(2k+1); where a target
   is under 16 blocks, blocks are shorter, down to one word, so that no source is rounded away.
3. A source is dealt into shards by a seeded hash of doc_id; its blocks are apportioned to its shards by size in the
   same way, which gives each shard an integer quota.  No shard depends on another, so a source with a third of all
   rows is many shards, and each running sum covers one shard.
4. In a shard, documents lie in seeded order.  The quota is taken as whole passes over the shard and, of the rest, the
   blocks from a seeded one on, wrapping round.  As documents lie in random order, these blocks are a random choice;
   that they are consecutive leaves all documents but the first and the last of them whole.

Only tables with a row for each source or shard are ranked, in ranges, so that no task holds them all.  Rows equal in
doc_id, source and size are counted first and placed as runs of at most ``RUN`` copies, so a row repeated any number of times is
many places.

Nulls: a null text has size 0; a null source is a source of its own; a null doc_id is hashed by its text.  Documents
without words, empty ones among them, take nothing.  Ties between quotients go to the smaller source (null last) or shard.  Very long texts
are counted whole and may be cut anywhere.  An empty table gives an empty result.  ``mix`` reads doc_id, source and
text alone; ``mixed_documents`` keeps every other column, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veduta.llm.common import WORD, attached, cut, plain, release, table, word_count

BLOCK, SHARD, CAP, SEED, RUN = 64, 500_000, 3, "mix-1", 64


def running(rows: DataFrame, by: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over all rows before, in the order ``by``.

    Rows are dealt in ranges of that order; a range needs the sums of those before it, one row for each of them.
    """
    ranged = cut(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__range").alias("__of"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({n: F.coalesce(F.sum(x).over(inside), F.lit(0)) for n, x in sums.items()})
    out = out.join(F.broadcast(starts), F.col("__range") == F.col("__of"))
    out = cut(out.select(*rows.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums]))
    release(ranged)
    return out


def quotas(items: DataFrame, group: str, item: str, size: str, total: Column, seats: Column, n_items: Column) -> DataFrame:
    """group, item, quota: the seats of every item that gets any, by highest quotients; ties to the smaller item.

    ``items`` is a written table; ``n_items`` is at least the number of the group's items.  An item's seats differ from
    its rounded share by at most ceil(share * items / (2 * seats)) + 1, so only the quotients about that share are
    ranked, some three for each item.
    """
    share = seats.cast("double") * F.col(size) / total
    wide = F.ceil(share * n_items / (2.0 * seats)).cast("long") + 1
    middle = F.floor(share + 0.5).cast("long")
    sized = items.where((F.col(size) > 0) & (seats > 0)).select(group, item, F.col(size).alias("__v"), seats.alias("__seats"), middle.alias("__mid"), wide.alias("__wide"))
    sized = cut(sized.select(group, item, "__v", "__seats", F.greatest(F.col("__mid") - F.col("__wide"), F.lit(0)).alias("__lo"), (F.col("__mid") + F.col("__wide")).alias("__hi")))
    each = sized.select(group, item, "__v", F.explode(F.sequence("__lo", "__hi")).alias("__k"))
    quotient = F.col("__v") / (2.0 * F.col("__k") + 1.0)
    ranked = running(each.select(group, item, quotient.alias("__q"), "__k"), [F.col(group).asc_nulls_last(), F.desc("__q"), F.col(item).asc_nulls_last(), F.col("__k").asc()], __place=F.lit(1))
    left = sized.groupBy(group).agg((F.max("__seats") - F.sum("__lo")).alias("__left"))
    first = ranked.groupBy(group).agg(F.min("__place").alias("__first"))
    info = cut(left.join(first.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g"))
    taken = attached(ranked, info, group).where(F.col("__place") - F.col("__first") < F.col("__left"))
    both = sized.select(group, item, F.col("__lo").alias("__n")).unionByName(taken.select(group, item, F.lit(1).cast("long").alias("__n")))
    out = cut(both.groupBy(group, item).agg(F.sum("__n").alias("quota")))
    release(sized, ranked, info)
    return out


def sources(sizes: DataFrame, block: int = BLOCK, shard: int = SHARD, cap: int = CAP) -> tuple[DataFrame, int]:
    """A written table (source, place, source_size, target, blocks, n_shards), and the words of a block."""
    per = cut(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")))
    placed = running(per, [F.col("source").asc_nulls_last()], place=F.lit(1).cast("long"))
    weight = 1 + F.col("place") % 3
    r = placed.agg(F.sum("source_size").alias("total"), F.sum(weight).alias("weights"), F.count("*").alias("n")).first()
    total, weights, n = r["total"] or 0, r["weights"] or 0, r["n"]
    weighed = placed.withColumns({"weight": weight, "full_at": float(cap) * F.col("source_size") / weight})
    filled = running(weighed, [F.col("full_at").asc(), F.col("place").asc()], full=F.col("source_size"), spent=F.col("weight"), turn=F.lit(1).cast("long"))
    rate = (F.lit(total) - F.col("full") * cap).cast("double") / (F.lit(weights) - F.col("spent"))
    stop = filled.where(rate <= F.col("full_at")).agg(F.min(F.struct(F.col("turn"), rate.alias("rate"))).alias("s")).first()["s"]
    whole = float(cap) * F.col("source_size")
    target = whole if stop is None else F.when(F.col("turn") < stop["turn"], whole).otherwise(F.col("weight") * F.lit(stop["rate"]))
    aimed = cut(filled.select("source", "place", "source_size", target.alias("target"), F.lit(0).alias("all")))
    least = aimed.where("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(block, int((least or 0) // 16)))
    blocks = quotas(aimed, "all", "place", "target", F.lit(float(total)), F.lit(int(total / block + 0.5)).cast("long"), F.lit(n))
    given = aimed.join(blocks.select(F.col("place").alias("__p"), "quota"), F.col("place") == F.col("__p"), "left")
    n_shards = 1 + F.floor(F.col("source_size") / float(shard)).cast("long")
    out = cut(given.select("source", "place", "source_size", "target", F.coalesce("quota", F.lit(0)).alias("blocks"), n_shards.alias("n_shards")))
    release(per, placed, filled, aimed, blocks)
    return out, block


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size, key (what a document is hashed by) and ``more`` of every row, as a written table."""
    null = F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit(""))))
    return cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.coalesce(F.col("doc_id").cast("string"), null).alias("key"), *more))


def _placed(sizes: DataFrame, of: list[str], block: int, shard: int, cap: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The places of all copies of the rows with words, with the columns ``of`` and the source's; and the sources' table.

    Rows equal in ``of`` are copies of one.
    """
    per, block = sources(sizes, block, shard, cap)
    counted = sizes.where("size > 0").groupBy(*of).agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    tag = F.concat(F.col("key"), F.when(F.col("run") > 0, F.concat(F.lit(" "), F.col("run").cast("string"))).otherwise(F.lit("")))
    runs = runs.select(*of, F.least(F.col("n") - F.col("run"), F.lit(RUN)).alias("n"), tag.alias("__tag"))
    dealt = attached(runs, per, "source").withColumn("shard", _number(F.concat(F.lit(f"{seed} shard "), F.col("__tag"))) % F.col("n_shards"))
    dealt = cut(dealt.select("*", F.md5(F.concat(F.lit(f"{seed} order "), F.col("__tag"))).alias("seeded")).drop("__tag", "n_shards"))
    shards = cut(dealt.groupBy("place", "shard").agg(F.first("blocks").alias("blocks"), F.first("source_size").alias("source_size"), F.sum(F.col("size") * F.col("n")).alias("shard_size")))
    many = 1 + F.floor(F.col("source_size") / float(shard)).cast("long")
    quota = quotas(shards, "place", "shard", "shard_size", F.col("source_size"), F.col("blocks"), many)
    got = shards.join(quota.select(F.col("place").alias("__p"), F.col("shard").alias("__s"), "quota"), (F.col("place") == F.col("__p")) & (F.col("shard") == F.col("__s")), "left")
    words = F.least(F.coalesce("quota", F.lit(0)) * block, F.col("shard_size") * cap)
    passes = F.floor(words / F.col("shard_size")).cast("long")
    n_blocks = F.ceil(F.col("shard_size") / float(block)).cast("long")
    start = _number(F.concat(F.lit(f"{seed} start "), F.col("place").cast("string"), F.lit(" "), F.col("shard").cast("string"))) % n_blocks * block
    taken = cut(got.select(F.col("place").alias("__p"), F.col("shard").alias("__s"), "shard_size", passes.alias("passes"), start.alias("run_from"), (words - passes * F.col("shard_size")).alias("run_words")))
    release(shards, quota)
    before = Window.partitionBy("place", "shard").orderBy("seeded", *[F.col(c).asc_nulls_last() for c in of]).rowsBetween(Window.unboundedPreceding, -1)
    at = dealt.withColumn("pos", F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)))
    met = at.join(taken, (F.col("place") == F.col("__p")) & (F.col("shard") == F.col("__s")))
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("pos", F.col("pos") + F.col("copy") * F.col("size"))
    end = F.col("run_from") + F.col("run_words")
    first = F.greatest("run_from", "pos")
    out = each.select(
        *of, "source_size", "target", "passes", (first - F.col("pos")).alias("from_1"),
        F.greatest(F.least(end, F.col("shard_size"), F.col("pos") + F.col("size")) - first, F.lit(0)).alias("words_1"),
        F.least(F.greatest(F.least(end - F.col("shard_size"), F.col("pos") + F.col("size")) - F.col("pos"), F.lit(0)), F.col("size")).alias("words_2"),
    )
    return out, per


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, its source, and how the words are taken.

    ``passes`` whole copies, ``words_1`` words from word ``from_1`` on, and the first ``words_2`` words.
    """
    sizes = _sized(docs)
    given, per = _placed(sizes, ["doc_id", "source", "size", "key"], block, shard, cap, seed)
    none = attached(sizes.where("size = 0"), per, "source").withColumns({c: F.lit(0).cast("long") for c in ("passes", "from_1", "words_1", "words_2")})
    taken = (F.col("passes") * F.col("size") + F.col("words_1") + F.col("words_2")).alias("taken")
    names = ["doc_id", "size", "source_size", "target", taken, "source", "passes", "from_1", "words_1", "words_2"]
    return given.select(*names).unionByName(none.select(*names))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies unchanged, partial ones cut to the words taken.

    The words before and after a block's edge are joined by one space; whole copies keep their text as it is.
    """
    rest = [plain(c) for c in docs.columns if c not in ("doc_id", "source", "text")]
    row = F.xxhash64("source", "text", F.to_json(F.struct(*rest)) if rest else F.lit(0))  # rows equal in all columns are copies
    sizes = _sized(docs, row.alias("row"))
    given, _ = _placed(sizes, ["doc_id", "source", "size", "key", "row"], block, shard, cap, seed)
    # The documents' columns travel as one struct, so that their names clash with none of these.
    own = docs.select(F.col("doc_id").alias("__id"), row.alias("__row"), F.struct(*[plain(c) for c in docs.columns]).alias("__doc"))
    if not sizes.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        own = own.dropDuplicates(["__id", "__row"])
    right = given.where("passes + words_1 + words_2 > 0")
    both = own.join(right, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__row") == F.col("row")))
    text = F.col("__doc")["text"]
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    part = lambda a, n: F.when(F.col(n) == F.col("size"), text).when(F.col(n) > 0, F.array_join(F.slice(words, (a + 1).cast("int"), F.col(n).cast("int")), " "))
    copies = F.concat(F.array_repeat(text, F.col("passes").cast("int")), F.array_compact(F.array(part(F.col("from_1"), "words_1"), part(F.lit(0), "words_2"))))
    each = both.select("__doc", F.explode(copies).alias("__text"))
    return each.select(*[(F.col("__text") if c == "text" else F.col("__doc").getField(c)).alias(c) for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same from the definition: all quotients are ranked, and the level of the targets is found by trying each source.
ORACLE = f"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null ' || md5(coalesce(text, ''))) AS key FROM documents),
rows AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, key) - 1 AS nth FROM docs),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
weighed AS (SELECT *, 1 + place % 3 AS weight, {CAP}e0 * source_size / (1 + place % 3) AS full_at FROM per),
tried AS (SELECT a.full_at, a.place, CAST((SELECT sum(source_size) FROM per) - {CAP} * coalesce(sum(b.source_size), 0) AS DOUBLE)
    / ((SELECT sum(weight) FROM weighed) - coalesce(sum(b.weight), 0)) AS rate
  FROM weighed a LEFT JOIN weighed b ON b.full_at < a.full_at OR b.full_at = a.full_at AND b.place < a.place GROUP BY ALL),
level AS (SELECT rate, full_at AS stop, place AS stop_place FROM tried WHERE rate <= full_at ORDER BY full_at, place LIMIT 1),
aimed AS (SELECT source, place, source_size, CASE WHEN full_at < stop OR full_at = stop AND place < stop_place THEN {CAP}e0 * source_size ELSE weight * rate END AS target FROM weighed, level),
unit AS (SELECT greatest(1, least({BLOCK}, CAST(floor(coalesce(min(target) FILTER (target > 0), 0) / 16) AS BIGINT))) AS block, CAST(sum(source_size) AS DOUBLE) AS total FROM aimed),
seats AS (SELECT block, CAST(floor(total / block + 0.5e0) AS BIGINT) AS n FROM unit),
quotients AS (SELECT place, target / (2e0 * k + 1e0) AS q, k FROM aimed, (SELECT unnest(range(0, n)) AS k FROM seats) WHERE target > 0),
won AS (SELECT place, count(*) AS blocks FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY q DESC, place, k) AS r FROM quotients) WHERE r <= (SELECT n FROM seats)) GROUP BY place),
hashed AS (SELECT rows.*, a.place, a.source_size, a.target, coalesce(blocks, 0) AS blocks, key || CASE WHEN nth >= {RUN} THEN ' ' || CAST(nth // {RUN} * {RUN} AS VARCHAR) ELSE '' END AS tag
  FROM rows JOIN aimed a ON rows.source IS NOT DISTINCT FROM a.source LEFT JOIN won ON won.place = a.place),
dealt AS (SELECT *, CAST(('0x' || substr(md5('{SEED} shard ' || tag), 1, 8)) AS BIGINT) % (1 + CAST(floor(source_size / {SHARD}e0) AS BIGINT)) AS shard, md5('{SEED} order ' || tag) AS seeded FROM hashed),
shards AS (SELECT place, shard, max(blocks) AS blocks, CAST(sum(size) AS BIGINT) AS shard_size FROM dealt GROUP BY place, shard HAVING sum(size) > 0),
shares AS (SELECT place, shard, count(*) AS quota FROM (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2e0 * k + 1e0) DESC, shard, k) AS r, blocks FROM
    (SELECT *, unnest(range(0, blocks)) AS k FROM shards)) WHERE r <= blocks GROUP BY place, shard),
amounts AS (SELECT s.place, s.shard, shard_size AS n, least(coalesce(quota, 0) * block, {CAP} * shard_size) AS words,
    CAST(('0x' || substr(md5('{SEED} start ' || s.place || ' ' || s.shard), 1, 8)) AS BIGINT) % CAST(ceil(shard_size / CAST(block AS DOUBLE)) AS BIGINT) * block AS a
  FROM shards s LEFT JOIN shares q ON s.place = q.place AND s.shard = q.shard, seats),
spots AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY seeded, doc_id NULLS LAST, nth ROWS UNBOUNDED PRECEDING) - size AS p FROM dealt WHERE size > 0)
SELECT doc_id, size, source_size, target, CAST(words // n * size + greatest(0, least(p + size, a + words % n) - greatest(p, a)) + greatest(0, least(p + size, a + words % n - n) - p) AS BIGINT) AS taken
  FROM spots JOIN amounts USING (place, shard)
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM dealt WHERE size = 0
"""
