"""Model-based tests: histories against the observations that they were folded from."""

import random

from docgraph.operators import history


def test_round_trip(spark):
    r = random.Random(3)
    seen = {(e, v): r.choice(["a", "b", None]) for e in range(8) for v in range(20) if r.random() < 0.7}
    rows = [(e, v, x) for (e, v), x in seen.items()]
    r.shuffle(rows)
    log = spark.createDataFrame(rows, "entity int, ver int, value string")
    h = history.push_history(log, ["entity"])
    frames = sorted((f.entity, f.lo, f.hi) for f in h.collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(frames, frames[1:]))
    points = spark.createDataFrame([(e, v) for e in range(8) for v in range(20)], "entity int, ver int")
    got = {(x.entity, x.ver): x.value for x in history.history_at(h, points, ["entity"]).collect()}
    assert got == {(e, v): seen.get((e, v)) for e in range(8) for v in range(20)}
    assert {(x.entity, x.ver) for x in history.versions_of(h, ["entity"]).collect()} == set(seen)


def test_empty(spark):
    log = spark.createDataFrame([], "entity int, ver int, value string")
    assert history.push_history(log, ["entity"]).count() == 0
