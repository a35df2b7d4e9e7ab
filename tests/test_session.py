"""Changes, requests and groups of a session."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from veduta.operators.engine import Engine
from veduta.streaming.session import Expansion, Session


@pytest.fixture
def session(spark):
    s = Session(Engine(spark.range(100).withColumnRenamed("id", "i")), wait=0)
    yield s
    s.close()


def test_each_change_is_told_once(session):
    told, chosen = [], []
    stop = session.observe("view", told.append)
    session.observe("selected", chosen.append)
    session.change(quick="7")
    session.change(quick="7")
    session.change(selected=[1, 2])
    assert len(told) == 1 and told[0]["quick"] == "7" and len(chosen) == 1 and chosen[0]["selected"] == [1, 2]
    stop()
    session.change(quick="")
    assert len(told) == 1


def test_changes_are_gathered(spark):
    s, told = Session(Engine(spark.range(3)), wait=0.1), []
    s.observe("view", told.append)
    for i in range(5):
        s.change(quick=str(i))
    assert not told
    time.sleep(0.5)
    assert [x["quick"] for x in told] == ["4"]
    s.change(quick="x")
    s.flush()
    assert len(told) == 2
    s.close()


def test_view_follows(session, spark):
    sizes = []
    session.on_view(lambda v: sizes.append(len(v)))
    session.change(filters={"col": "i", "op": "lt", "value": 10})
    session.replace(Engine(spark.createDataFrame([("a",)], "s string")))
    assert sizes == [100, 10, 1] and session.state["filters"] is None


def test_requests_answer_by_number(session):
    got, done = {}, threading.Semaphore(0)

    def answer(x):
        got[x["id"]] = x
        done.release()

    session.request(1, lambda e: e.count(), answer)
    session.request(2, lambda e: e.matching({"filters": {"col": "no", "op": "eq"}}), answer)
    for _ in range(2):
        assert done.acquire(timeout=30)
    assert got[1] == {"id": 1, "ok": True, "result": 100} and got[2]["ok"] is False and "no" in got[2]["reason"]


def test_aborted_requests_are_not_answered(session):
    got, begun = [], threading.Event()

    def slow(e):
        begun.set()
        time.sleep(0.5)
        return e.source.select(F.sum("i")).first()[0]

    session.request(3, slow, got.append)
    assert begun.wait(30) and session.abort(3) and not session.abort(3)
    time.sleep(2)
    assert got == []


def test_groups_close_once():
    e = Expansion(1)
    assert e.arrived([("a",), ("a", "b")]) == [("a", "b")] and e.arrived([("a",), ("a", "b"), ("a", "c")]) == [("a", "c")]
    e.toggle(("a", "b"), True)
    assert e.arrived([("a", "b")]) == [] and e.closed == {("a", "c")}
    assert Expansion(-1).arrived([("a",)]) == [] and Expansion(0).arrived([("a",)]) == [("a",)]
