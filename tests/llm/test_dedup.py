import random

import brute
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect

from veduta.llm import exact, near, substring

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \t"), (None, "one two three four five six"), (4, "ONE two three four five six"), (4, "ONE two three four five six"), (5, "!?"), (6, "é É ß"), (7, "x")]


def rows_of(name, *columns):
    t = pq.read_table(f"{SF}/{name}.parquet", columns=list(columns))
    return list(zip(*[t[c].to_pylist() for c in columns], strict=True))


def edited(seed, n=60):
    """Texts with exact copies, near copies in chains, reordered parts and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    shared, out = text(60), []
    for _ in range(n // 6):
        t = text(rng.randrange(20, 200))
        out.append(t)
        for _ in range(3):  # a chain
            t = list(t)
            for _ in range(max(1, len(t) // 60)):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(t)
        out.append(t[len(t) // 2 :] + t[: len(t) // 2])
        out.append(text(30) + shared + text(30))
    rng.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_exact_sql(spark):
    got, want = compare(exact.op6_exact(spark, SF), connect(SF), exact.ORACLE)
    assert got == want


def test_exact_odd_rows(spark):
    got = exact.exact_groups(brute.documents(spark, ODD, extra=True)).collect()
    by = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got]
    assert len(by) == len(ODD)
    assert sorted(x for x in by if x[0] in (1, 2)) == [(1, 2, 2, False), (2, 2, 2, True)]
    assert sorted((str(x[0]), x[3]) for x in by if x[1] == 4) == [("4", False), ("4", True), ("None", False)]
    long = "ab" * 3_000_000
    got = {r.doc_id: r for r in exact.exact_groups(brute.documents(spark, [(1, long), (2, long.upper()), (3, long + "c")])).collect()}
    assert (got[1].keep_id, got[2].keep_id, got[3].keep_id) == (2, 2, 3)


def test_exact_verifies_identifiers(spark, monkeypatch):
    """Where a chunk hash clashes, the chunks' SHA-256 take its place."""
    rows = [(i, f"text number {i % 3}") for i in range(12)]
    docs = brute.documents(spark, rows)
    bad = exact.recipes(docs).select("recipe").collect()
    forged = tuple({bytes(x) for r in bad for x in r.recipe})
    lists = {r.doc_id: tuple(map(bytes, r.recipe)) for r in exact.recipes(docs, forged).collect()}
    assert len(set(lists.values())) == 3 and all(len(x) == 32 for v in lists.values() for x in v)
    assert exact.clashing(docs).count() == 0


def test_exact_cuts_follow_content():
    rng = random.Random(3)
    body = bytes(rng.randrange(97, 123) for _ in range(60_000))
    both = b"0123456789" + body
    a = {body[x:y] for own in exact.cuts(body, [0, len(body)]) for x, y in own}
    b = {both[x:y] for own in exact.cuts(both, [0, len(both)]) for x, y in own}
    assert len(a & b) >= len(a) - 2


@pytest.mark.parametrize("seed", [1, 2])
def test_near_against_all_pairs(spark, seed):
    rows = edited(seed)
    want = brute.near_classes(rows)
    got = {r.doc_id: r.class_id for r in near.near_groups(brute.documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == want


def test_near_on_documents(spark):
    rows = rows_of("documents", "doc_id", "text")
    classes = brute.near_classes(rows)
    least = {}
    for (i, _), c in zip(rows, classes, strict=True):
        least[c] = min(least.get(c, i), i)
    out = near.op2_near(spark, SF).collect()
    assert {r.doc_id: r.class_id for r in out} == {i: least[c] for (i, _), c in zip(rows, classes, strict=True)}
    assert sum(r.kept for r in out) == len(least)


def test_near_odd_rows(spark):
    got = near.near_groups(brute.documents(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    assert sorted(r.class_size for r in got) == [1, 1, 1, 1, 1, 1, 3, 3, 3]
    assert sum(r.kept for r in got) == 7
    kept = near.near_dedup(brute.documents(spark, ODD, extra=True))
    assert kept.columns == brute.documents(spark, ODD, extra=True).columns and kept.count() == 7


def test_near_alignment_needs_order():
    import numpy as np

    a = np.arange(100, dtype=np.uint64)
    assert near.aligned(a, a) == 1
    assert near.aligned(a, np.roll(a, 50)) == 0
    assert near.aligned(a, np.delete(a, [3, 50])) == 98 / 100


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    passages = [[rng.choice(words) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(80):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            k = rng.randrange(len(t) + 1)
            t[k:k] = p
        rows.append((i, " \n".join(t)))
    rows += [(90, None), (91, ""), (92, "a b " * 100), (93, "a b " * 100)]
    docs = brute.documents(spark, rows, extra=True).repartition(5)
    got = sorted(tuple(r) for r in substring.without_repeats(docs).collect())
    assert got == sorted(brute.repeats(rows))


def test_substring_on_documents(spark):
    rows = rows_of("documents", "doc_id", "text")
    got = sorted(tuple(r) for r in substring.op7_substring(spark, SF).collect())
    assert got == sorted(brute.repeats(rows))


def test_substring_sql(spark):
    got, want = compare(substring.op7_substring(spark, SF), connect(SF), substring.ORACLE)
    assert got == want


def test_substring_small_sketch_loses_nothing(spark):
    rows = rows_of("documents", "doc_id", "text")
    docs = brute.documents(spark, rows)
    got = sorted(tuple(r) for r in substring.without_repeats(docs, most_cells=1 << 16).collect())
    assert got == sorted(brute.repeats(rows))


def test_substring_repeated_ids(spark):
    t = " ".join(f"x{i}" for i in range(70))
    rows = [(2, t), (2, t), (1, t + " tail"), (None, t)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.without_repeats(brute.documents(spark, rows)).collect()), key=str)
    assert got == sorted([(2, 70, 70), (2, 70, 70), (1, 71, 0), (None, 70, 70)], key=str)


def test_empty_tables(spark):
    docs = brute.documents(spark, [])
    assert exact.exact_groups(docs).count() == near.near_groups(docs).count() == substring.without_repeats(docs).count() == 0
    assert exact.exact_dedup(docs).count() == near.near_dedup(docs).count() == 0


def test_near_wordless_repeats(spark):
    docs = brute.documents(spark, [(1, None), (1, None), (2, "!!"), (2, "!!"), (3, "!!"), (None, ""), (None, ""), (4, "a b c")])
    got = near.near_groups(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in got) == sorted([("1", "1", 2)] * 2 + [("2", "2", 2)] * 2 + [("3", "3", 1)] + [("None", "None", 2)] * 2 + [("4", "4", 1)])
    assert sum(r.kept for r in got) == near.near_dedup(docs).count() == 5


def test_near_common_passage(spark):
    """Texts that share a passage and no more, among them some that are near copies."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    passage, rows = [rng.choice(words) for _ in range(60)], []
    for i in range(240):
        own = [rng.choice(words) for _ in range(25)]
        rows.append((i, " ".join(own[:12] + passage + own[12:])))
        if i % 8 == 0:
            rows.append((1000 + i, " ".join(own[:12] + passage + own[12:-1])))
    want = brute.near_classes(rows)
    got = {r.doc_id: r.class_id for r in near.near_groups(brute.documents(spark, rows)).collect()}
    least = {}
    for (i, _), c in zip(rows, want, strict=True):
        least[c] = min(least.get(c, i), i)
    assert [got[i] for i, _ in rows] == [least[c] for c in want] and len(set(got.values())) == 240


def test_near_short_texts_are_all_found(spark):
    rows = []
    for i in range(400):
        own = [f"v{i}x{k}" for k in range(9)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-1]))]
    got = near.near_groups(brute.documents(spark, rows)).collect()
    assert all(r.class_id == r.doc_id // 2 * 2 and r.class_size == 2 for r in got)


def test_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    other = [*words[:70_000], "new", *words[70_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 900_000), (4, " ".join(words[-60:]))]
    docs = brute.documents(spark, rows, extra=True)
    assert {r.doc_id: r.class_id for r in near.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(tuple(r) for r in substring.without_repeats(docs).collect()) == sorted(brute.repeats(rows))
    assert exact.exact_dedup(docs).count() == 4


@pytest.mark.parametrize("stage", [exact.exact_dedup, near.near_dedup])
def test_dedup_keeps_columns(spark, stage):
    docs = brute.documents(spark, ODD, extra=True)
    got = stage(docs)
    assert got.columns == docs.columns and got.where("`a.b` <> 'own a.b' OR __doc <> 'own __doc'").count() == 0


def test_exact_without_trusted_identifiers(spark, monkeypatch):
    docs = brute.documents(spark, [(i, f"text {i % 3}") for i in range(9)])
    assert {len(x) for r in exact.recipes(docs, None).collect() for x in r.recipe} == {32}
    monkeypatch.setattr(exact, "clashing", lambda d: d.select(exact.F.lit(b"x").alias("id")))
    assert sorted(r.group_size for r in exact.exact_groups(docs, most_clashes=2).collect()) == [3] * 9


def test_groups_meet_their_rows(spark):
    from pyspark.sql import functions as F

    from veduta.llm.common import attached, cut, grouped_rows, release

    rows = cut(spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 > 0, F.col("id")).alias("k"), "id"))
    groups = cut(rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")))
    got = grouped_rows(rows, groups, "k", "n")
    assert got.count() == rows.where("k IS NOT NULL").count() and got.columns == ["k", "id", "n", "low"]
    assert got.where("k = 0").select("n").distinct().count() == 1 and got.where("k > 0 AND (n <> 1 OR low <> id)").count() == 0
    info = cut(rows.groupBy("k").agg(F.max("id").alias("high")))
    ways = [attached(rows, info, "k", most=m) for m in (10**6, 0)]
    assert ways[0].count() == ways[1].count() == 3000 and ways[0].exceptAll(ways[1]).isEmpty()
    release(rows, groups, info)


def test_folders(spark):
    from veduta.llm.common import cut, release, shared_folder

    assert shared_folder(spark) == shared_folder(spark)
    df = cut(spark.range(3))
    assert df.written_at.startswith(shared_folder(spark)) and df.count() == 3
    release(df)
    with pytest.raises(Exception, match="."):
        spark.read.parquet(df.written_at)
