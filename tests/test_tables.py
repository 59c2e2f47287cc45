"""Table sets under manifests, histories by pushes and the graph store, killed writers included."""

import random

import pytest

from docgraph.operators.history import pollen, push_history
from docgraph.sources.tables import GraphStore, HistoryStore, TableSet


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_commits_and_broken_writers(spark, tmp_path):
    store = TableSet(spark, f"{tmp_path}/set")
    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "x int")
    assert store.numbers() == [] and store.table("a") is None
    store.commit({"a": frame(1), "b": frame(10)})
    # a writer that is killed between two tables, and one that is killed while it writes the manifest
    frame(2).write.parquet(f"{tmp_path}/set/data/a/piece=1")
    (tmp_path / "set/manifests/0000000001").mkdir()
    (tmp_path / "set/manifests/0000000001/part-0.parquet").write_bytes(b"half")
    assert store.numbers() == [0]
    assert rows(store.table("a"), "x", "piece") == [(1, 0)] and rows(store.table("b"), "x") == [(10,)]
    assert store.commit({"a": frame(3)}) == 2
    assert store.commit({"b": frame()}, replaced=["b"]) == 3
    assert rows(store.table("a"), "x") == [(1,), (3,)] and rows(store.table("b"), "x") == []
    assert rows(store.table("b", 2), "x") == [(10,)]
    store.compact("a")
    assert rows(store.table("a"), "x", "piece") == [(1, 4), (3, 4)]
    assert store.vacuum() == 4
    assert rows(TableSet(spark, f"{tmp_path}/set").table("a"), "x") == [(1,), (3,)]
    with pytest.raises(ValueError):
        store.pieces(0)


@pytest.mark.parametrize("step", [1, 3])
def test_pushes_equal_one_push(spark, tmp_path, step):
    r = random.Random(step)
    log = [(e, v, r.choice([None, "a", "b"])) for e in (1, 2, 3, None) for v in range(9) if r.random() < 0.8]
    df = spark.createDataFrame(log, "entity bigint, ver int, value string")
    store = HistoryStore(spark, f"{tmp_path}/h{step}", ["entity"])
    for a in range(0, 9, step):
        store.push(df.filter(f"ver >= {a} and ver < {a + step}"))
    want = rows(push_history(df, ["entity"]), "entity", "lo", "hi", "value")
    assert rows(store.keyframes(), "entity", "lo", "hi", "value") == want
    assert all(r.hi == 8 for r in store.table("open").collect()) and all(r.hi < 8 for r in store.table("closed").collect())
    assert store.push(df.limit(0)) == 8
    with pytest.raises(ValueError):
        store.push(df.filter("ver = 8"))


def test_graph_store(spark, tmp_path):
    store = GraphStore(spark, f"{tmp_path}/graphs")
    calls = []

    def compile(packages):
        calls.append(rows(packages, "package", "version"))
        v = packages.filter("package <> 'empty'")
        return {"vertices": v.selectExpr(f"'{len(calls)}' as name", "package", "version"), "edges": v.selectExpr("1 as source", "package", "version")}

    frame = lambda *p: spark.createDataFrame(list(p), "package string, version string")
    assert store.ensure(frame(("a", "1"), ("empty", "1"), ("a", "1")), compile) == 2
    assert store.ensure(frame(("a", "1"), ("b", "2"), ("empty", "1")), compile) == 1
    assert store.ensure(frame(("b", "2")), compile) == 0
    assert calls == [[("a", "1"), ("empty", "1")], [("b", "2")]]
    assert rows(store.read("vertices"), "name", "package", "version") == [("1", "a", "1"), ("2", "b", "2")]
    store.write(compile(frame(("a", "1"))), frame(("a", "1")))
    assert rows(store.read("vertices"), "name", "package") == [("2", "b"), ("3", "a")]
    assert rows(store.read("edges").filter("package = 'a'"), "source") == [(1,)]
    assert store.read("hints") is None and store.read("vertices").columns == ["package", "version", "name"]


def test_pollen(spark):
    opinions = spark.createDataFrame([(1, 5, 0, 1), (1, 5, 2, 3), (1, 5, 6, 6), (1, 1, 0, 9), (2, 5, 1, 1)], "host bigint, culture int, lo int, hi int")
    homes = spark.createDataFrame([(1, 0), (2, 5)], "symbol bigint, culture int")
    modules = spark.createDataFrame([(0, 0), (1, 0), (5, 2)], "module int, package int")
    assert rows(pollen(opinions, homes, modules), "host", "culture", "lo", "hi") == [(1, 5, 0, 3), (1, 5, 6, 6)]
