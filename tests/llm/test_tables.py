"""Neighbours, tool calls, mixing, and the queries as registered."""

import json
import math
import random

import brute
import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect

from veduta.llm import chat, mixing, neighbours, queries

SF = "/root/testdata/sf0.001"


def exact_neighbours(rows, every, top):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], float)
    norm = np.linalg.norm(v, axis=1)
    out = {}
    for i, x, n in zip(ids, v, norm, strict=True):
        if i % every == 0:
            score = v @ x / (norm * n)
            order = [k for k in np.lexsort((ids, -score)) if ids[k] != i][:top]
            out[int(i)] = [(int(ids[k]), float(score[k])) for k in order]
    return out


def test_neighbours_recall(spark):
    d = "/root/testdata/sf0.01"
    t = pq.read_table(f"{d}/embeddings.parquet")
    want = exact_neighbours(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)), 50, 5)
    got: dict = {}
    for r in neighbours.op8_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, own in got.items():
        assert [x[0] for x in own] == list(range(1, 6))
        assert all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False))
        hit += len({x[1] for x in own} & {x[0] for x in want[q]})
        known = dict(want[q])
        assert all(math.isclose(s, known[i], rel_tol=1e-12) for _, i, s in own if i in known)
    assert hit >= 0.9 * 5 * len(want)


def test_neighbours_odd_rows(spark):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    base = vec()
    rows = [(0, base), (50, [x * 4 for x in base]), (51, base), (52, base), (1, None), (2, [0.0] * 8), (3, [float("nan")] * 8), (4, [None] + [1.0] * 7), (5, [float("inf")] * 8), (6, [1.0]), (None, base), (7, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, key string")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 51), (0, 3, 52), (50, 1, 0), (50, 2, 51), (50, 3, 52)]
    assert neighbours.neighbours(df.limit(0)).count() == 0


def test_neighbours_hot_bucket_is_split(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(i, base) for i in range(300)], "vec_id long, embedding array<float>")
    got = neighbours.neighbours(df, group=32).where("query_id = 100").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_chat(spark):
    call = lambda i, name="search", **a: "<tool_call>" + json.dumps({"name": name, "id": i, "arguments": a}) + "</tool_call>"
    result = lambda i, c: "<tool_result>" + json.dumps({"id": i, "content": c}) + "</tool_result>"
    rows = [
        (1, 0, "user", "find it"),
        (1, 1, "assistant", "Sure. " + call("a", query="x", limit=3) + call("b", limit=3) + call("a", query="y")),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": [1, "q\"'"]}})),
        (1, 3, "assistant", result("late", 5) + "<tool_call>{broken</tool_call>" + result("nobody", None)),
        (1, 4, "assistant", call("late", "unknown_tool")),
        (1, 5, "assistant", call("c", query=4) + call("d", query="x", more=1) + call("e", "weather", city="Rome", units="C")),
        (2, 0, None, None), (None, 0, "tool", "not json"), (None, None, None, None), (2, 1, "user", ""), (2, 1, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    got = chat.linked(df).collect()
    at = {(r.conv_id, r.turn, r.part, r.kind): r for r in got}
    status = lambda *k: (at[k].status, at[k].error)
    assert status(1, 1, 1, "call") == ("answered", None) and status(1, 1, 2, "call") == ("unanswered", "missing query")
    assert status(1, 1, 3, "call") == ("duplicate", None) and status(1, 2, 1, "result") == ("linked", None)
    assert at[1, 2, 1, "result"].json == '{"content":{"a":[1,"q\\"\'"],"z":1},"id":"a"}'
    assert at[1, 1, 1, "call"].json == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"}'
    assert status(1, 3, 2, "result")[0] == "orphan" and status(1, 3, 1, "call")[0] == "malformed"
    late = at[1, 3, 1, "result"]
    assert late.status == "linked" and (late.order_turn, late.order_part, late.order_kind) == (4, 1, 1)
    assert status(1, 4, 1, "call") == ("answered", "unknown tool")
    assert [status(1, 5, k, "call")[1] for k in (1, 2, 3)] == ["query is no string", "undeclared argument", None]
    assert sum(r.conv_id == 2 and r.kind == "message" for r in got) == 3
    assert at[None, 0, 1, "result"].status == "malformed"
    assert chat.linked(df.limit(0)).count() == 0


def talk(seed, n=400):
    """Conversations of calls, late, early and repeated results, ids that several calls share, and malformed spans."""
    rng, rows = random.Random(seed), []
    names = ["search", "calculator", "weather", "fetch", "unheard"]
    values = ["x", 3, 2.5, True, None, [1], {"b": 1, "a": "é\"'"}]
    for conv in range(n):
        ids, turn = [f"c{k}" for k in range(rng.randrange(1, 6))], 0
        for _ in range(rng.randrange(1, 9)):
            parts = [rng.choice(["", "Sure. ", "a <b> c "])]
            for _ in range(rng.randrange(3)):
                call = {"id": rng.choice(ids), "name": rng.choice(names), "arguments": {rng.choice(["query", "limit", "expression", "city", "url", "headers", "more"]): rng.choice(values) for _ in range(rng.randrange(3))}}
                for f in rng.sample(sorted(call), rng.randrange(4) == 0):
                    del call[f]
                if rng.randrange(8) == 0:
                    call["more"] = 1
                parts.append(f"<tool_call>{json.dumps(call)}</tool_call>")
            for _ in range(rng.randrange(3)):
                result = {"id": rng.choice([*ids, "nobody"]), "content": rng.choice(values)}
                parts.append(f"<tool_result>{json.dumps(result) if rng.randrange(9) else '{bad'}</tool_result>")
            rng.shuffle(parts)
            rows.append((conv if rng.randrange(50) else None, turn, "assistant", "".join(parts)))
            if rng.randrange(3) == 0:
                turn += rng.randrange(2)
                alone = json.dumps({"tool_call_id": rng.choice(ids), "content": rng.choice(values)})
                rows.append((conv, turn, "tool", rng.choice([alone, "plain text", '"text"', None])))
            turn += 1
    return rows


def linked_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_chat_against_plain_linker(spark, seed):
    rows = talk(seed)
    hot = [(10**6, t, "assistant", '<tool_call>{"id":"a","name":"search","arguments":{"query":"q"}}</tool_call><tool_result>{"id":"a","content":1}</tool_result>') for t in range(1500)]
    long = [(10**6 + 1, 0, "user", "word " * 100_000), (10**6 + 1, 1, "user", "word " * 100_000 + '<tool_call>{"id":"z"}</tool_call>')]
    rows += hot + long + rows[:50]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, link int")
    want = sorted(brute.linked(rows, chat.SCHEMAS), key=repr)
    assert len(want) > 5000 and {r[6] for r in want} == {"message", "answered", "unanswered", "duplicate", "malformed", "linked", "orphan"}
    assert linked_rows(chat.linked(df)) == want


def test_chat_order_is_topological(spark):
    out = chat.linked(spark.createDataFrame(talk(3), "conv_id long, turn long, role string, text string")).where("conv_id IS NOT NULL")
    place = lambda r: (r.order_turn, r.order_part, r.order_kind, r.turn, r.part)
    rows, first = out.collect(), {}
    for r in rows:
        if r.kind == "call" and r.status in ("answered", "unanswered"):
            first[r.conv_id, r.call_id] = place(r)
    assert all(first[r.conv_id, r.call_id] < place(r) for r in rows if r.status == "linked")


def test_chat_joins_by_hash(spark):
    plan = chat.linked(spark.createDataFrame(talk(4, 5), "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan


def test_mixing_sql(spark):
    got, want = compare(mixing.op10_mixing(spark, SF), connect(SF), mixing.ORACLE)
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_quotas(spark, seed):
    rng = random.Random(seed)
    sources = [None, "a", "b", "c", "d"][: rng.randrange(1, 6)]
    weights = [rng.choice([1, 5, 30]) for _ in sources]
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)) if i % 17 else None, None, rng.choices(sources, weights)[0]) for i in range(400)]
    rows += rows[:5] + [(None, "one two three", None, None)]
    how = {"shard": 3000, "block": 16}
    got = mixing.mix(brute.documents(spark, rows, extra=True), **how).collect()
    assert len(got) == len(rows)
    total, sums = 0, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.passes * r.size + r.words_1 + r.words_2
        total += r.size
        s = sums.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] += r.size
    for taken, target, size, own in sums.values():
        assert size == own and target <= 3 * size + 1e-6
        assert abs(taken - target) <= 2 * 16 + 0.02 * target
    goal = sum(s[1] for s in sums.values())
    assert math.isclose(goal, min(total, 3 * total), rel_tol=1e-9)
    docs = brute.documents(spark, rows, extra=True)
    out = mixing.mixed_documents(docs, **how)
    assert out.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in got)


def test_mixing_reruns_agree(spark):
    rows = [tuple(r) for r in mixing.op10_mixing(spark, SF).collect()]
    again = [tuple(r) for r in mixing.op10_mixing(spark, SF).collect()]
    assert sorted(rows) == sorted(again)


def test_mixing_empty(spark):
    docs = brute.documents(spark, [])
    assert mixing.mix(docs).count() == mixing.mixed_documents(docs).count() == 0
    docs = brute.documents(spark, [(1, None, None, "a"), (2, "", None, None)])
    assert [r.taken for r in mixing.mix(docs).collect()] == [0, 0]


def test_registered():
    assert [int(k.split("_")[0][2:]) for k in queries.QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("seed", [1, 2])
def test_quotas_are_highest_quotients(spark, seed):
    from pyspark.sql import functions as F

    from veduta.llm.common import cut

    rng, groups = random.Random(seed), {}
    for g in [None, *range(12)]:
        sizes = {i: rng.choice([1, 1, 3, 50, 5000]) * rng.randrange(0, 9) for i in range(rng.randrange(1, 40))}
        groups[g] = (sizes, rng.choice([0, 1, 7, 100, 900]))
    rows = [(g, i, v, sum(sizes.values()), n, len(sizes)) for g, (sizes, n) in groups.items() for i, v in sizes.items()]
    items = cut(spark.createDataFrame(rows, "g long, i long, v long, total long, n long, many long"))
    got = mixing.quotas(items, "g", "i", "v", F.col("total"), F.col("n"), F.col("many")).collect()
    want = {(g, i): k for g, (sizes, n) in groups.items() for i, k in brute.seats(sizes, n).items()}
    assert {(r.g, r.i): r.quota for r in got if r.quota} == want


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from veduta.llm.common import cut

    rng = random.Random(3)
    rows = [(rng.randrange(40), i, rng.randrange(10)) for i in range(500)]
    df = cut(spark.createDataFrame(rows, "a int, b int, v int").repartition(6))
    got = mixing.running(df, [F.col("a").desc(), F.col("b").asc()], place=F.lit(1), total=F.col("v")).collect()
    total = 0
    for k, (a, b, v) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1]))):
        (r,) = [x for x in got if (x.a, x.b) == (a, b)]
        assert (r.place, r.total) == (k, total)
        total += v
    assert mixing.running(df.limit(0), [F.col("a").asc()], place=F.lit(1)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_targets_and_tiny_sources(spark, seed):
    rng = random.Random(seed)
    names = [None, "", *[f"s{i}" for i in range(30)]]
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 40, 400])), None, s) for i, s in enumerate(rng.choices(names, [10**6 / (k + 1) ** 2 for k in range(32)], k=600))]
    rows += [(10**6 + k, "one two", None, f"tiny{k}") for k in range(5)] + [(None, "a b c", None, "")] * 200
    sizes: dict = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, got = brute.targets(sizes), {}
    for r in mixing.mix(brute.documents(spark, rows, extra=True), shard=2000).collect():
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        got[r.source] = got.get(r.source, 0) + r.taken
    assert all(abs(got[s] - t) <= 1 + 0.08 * t for s, t in want.items()) and all(got[f"tiny{k}"] > 0 for k in range(5))


def test_mixing_long_text_and_repeated_rows(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, words, None, "a"), (2, "x y", None, "b")] + [(3, "p q r", None, "b")] * 500
    docs = brute.documents(spark, rows, extra=True)
    taken = mixing.mix(docs).collect()
    assert len(taken) == len(rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.where("`a.b` <> 'own a.b'").count() == 0
    assert sum(len((r.text or "").split()) for r in out.select("text").collect()) == sum(r.taken for r in taken)


def documents_folder(spark, tmp_path, rows):
    brute.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pipeline_of_no_rows(spark, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, documents_folder(spark, tmp_path, [])).count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"the house and the garden number {'x' * i}", "en", "a") for i in range(1, 30)] + [(100 + i, f"das haus und der garten nummer {'y' * i}", "de", None) for i in range(1, 30)]
    rows += [(200, None, "en", "a"), (201, "", "de", None), (202, "12 34", None, "b"), (None, "the house of the garden", None, "a"), *rows[:3], (300, "the house and the " * 30_000, None, "c")]
    out = corpus_pipeline.run(spark, documents_folder(spark, tmp_path, rows)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {200, 201, 202} and {None, 300, 5, 105} <= ids and all(0 < r.length <= 1024 for r in out)


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language"](spark, docs, SF)
    left = [(r.doc_id, r.text) for r in told.collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best: dict = {}
    for i, t in left:
        best[t.translate(lower)] = max(best.get(t.translate(lower), i), i)
    once = stages["exact"](spark, told, SF)
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == sorted(best.values())
    rows = [(r.doc_id, r.text) for r in once.collect()]
    least: dict = {}
    for (i, _), c in zip(rows, brute.near_classes(rows), strict=True):
        least[c] = min(least.get(c, i), i)
    near = stages["near"](spark, once, SF)
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted(least.values())
    mixed = stages["mixture"](spark, near, SF)
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r.taken for r in mixing.mix(near).collect())
    packed = stages["packing"](spark, mixed, SF).collect()
    at: dict = {}
    for r in packed:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in at.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset", "length"} and out.count() > 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        if name in ("language", "exact", "near"):
            assert after.exceptAll(docs).isEmpty() and after.count() > 0.5 * docs.count()
            docs = after
    assert len(corpus_pipeline.STAGES) == 5
