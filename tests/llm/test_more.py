"""Neighbours of repeated and of few vectors, and texts that the linker must keep."""

import json

import numpy as np

from veduta.llm import chat, neighbours


def embeddings(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def nearest(rows, every=50, top=5):
    """query_id -> [vec_id], by brute force; a vec_id counts by its best row."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q in sorted({int(i) for i in ids if i % every == 0}):
        score = (v @ v[ids == q].T).max(axis=1)
        best = {int(i): score[ids == i].max() for i in set(ids.tolist()) if i != q}
        out[q] = sorted(best, key=lambda i: (-best[i], i))[:top]
    return out


def found(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def near_vectors(n, size=8, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=size)
    return [base + 0.05 * i * rng.normal(size=size) for i in range(n)]


def test_neighbours_repeated_rows(spark):
    rows = [(i, v) for i, v in enumerate(near_vectors(8))]
    assert found(neighbours.neighbours(embeddings(spark, rows * 12))) == nearest(rows)
    assert found(neighbours.neighbours(embeddings(spark, rows * 3))) == nearest(rows)


def test_neighbours_vec_id_of_many_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(near_vectors(8))]
    rows += [(1, rows[0][1] + 0.01 * rng.normal(size=8)) for _ in range(300)] + [(0, rows[0][1] + 0.01 * rng.normal(size=8)) for _ in range(20)]
    assert found(neighbours.neighbours(embeddings(spark, rows), group=32)) == nearest(rows)


def test_neighbours_of_few_vectors(spark):
    rng = np.random.default_rng(6)
    for n in (4, 6):
        rows = list(enumerate(rng.normal(size=(n, 64))))
        assert found(neighbours.neighbours(embeddings(spark, rows))) == nearest(rows)
    rows = [(0, [-1.0, 0.0])] + [(i, [1.0, 0.001 * i]) for i in range(1, 60)]
    assert found(neighbours.neighbours(embeddings(spark, rows))) == nearest(rows)


def test_neighbours_recall_by_dimension(spark):
    rows = list(enumerate(np.random.default_rng(7).normal(size=(2000, 256))))
    got, want = found(neighbours.neighbours(embeddings(spark, rows))), nearest(rows)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_chat_keeps_every_text(spark):
    rows = [
        (1, 0, "tool", "plain words"),
        (1, 1, "tool", 'before <tool_result>{"id":"a","content":1}</tool_result> after'),
        (1, 2, "assistant", "x <tool_call>{broken</tool_call><tool_result>[1]</tool_result>"),
        (1, 3, "tool", '{"id":"a","output":"payload"}'),
        (1, 4, "tool", '{"id":"a","content":"all"}'),
    ]
    got = {(r.turn, r.kind): json.loads(r.json) for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[0, "message"]["content"] == got[0, "result"]["raw"] == "plain words"
    said = got[1, "message"]["content"]
    assert said.startswith("before") and said.endswith("after") and got[1, "result"] == {"content": 1, "id": "a"}
    assert got[2, "call"] == {"raw": "{broken"} and got[2, "result"]["raw"] == "[1]"
    assert got[3, "message"]["content"] == "" and "payload" in got[3, "result"]["raw"]
    assert got[4, "result"] == {"content": "all", "id": "a"}
