"""Naturalised vertices against a scan of the symbols one by one."""

import random

from docgraph.operators import vertices

SCHEMA = "culture string, namespace string, pos bigint, id string, inferred string, path array<string>, community string, unavailable boolean, location bigint, mentions array<string>"


def interface(usr):
    """(culture, name, id) of ids like s1A2_PP..., of one-letter modules and names of less than ten letters."""
    size = int(usr[3])
    return usr[2], usr[4 : 4 + size], usr[: 5 + size]


def scan(rows):
    found, edges, locations = {}, [], []
    for r in sorted(rows, key=lambda r: r[2]):
        culture, namespace, pos, usr, inferred, path, community, unavailable, location, mentions = r
        graph = (culture, namespace)
        if usr is None:
            continue
        for m in mentions or []:
            c, name, protocol = interface(m)
            if c == culture and name[0] == "_":
                found.setdefault((*graph, protocol), ([name], "placeholder"))
        if inferred is None:
            found[(*graph, usr)] = (path, "natural")
        else:
            c, name, protocol = interface(usr)
            if inferred != culture or (*graph, usr) in found or c != culture or not (unavailable or name[0] == "_"):
                continue
            found[(*graph, usr)] = ([name, path[-1]], "inferred")
            edges.append((*graph, usr, protocol))
            if not unavailable:
                found.setdefault((*graph, protocol), ([name], "placeholder"))
        if location is not None:
            locations.append((*graph, usr, location))
    return found, edges, locations


def test_scan(spark):
    r = random.Random(8)
    rows = []
    for pos in r.sample(range(1000), 600):
        culture = r.choice("AB")
        home, name = r.choice("AAB"), r.choice(["_P", "P", "_Hid"])
        protocol = f"s1{home}{len(name)}{name}P"
        usr = protocol if r.random() < 0.05 else f"{protocol}{r.randint(1, 9)}x"
        inferred = None if usr == protocol or r.random() < 0.2 else r.choice(["A", "B"])
        mentions = r.choice([None, [], [f"s1{r.choice('AB')}{len(n)}{n}P" for n in ("_Q", "Q", "_Hid")]]) if r.random() < 0.2 else None
        rows.append((culture, r.choice(["A", "B"]), pos, usr, inferred, ["Type", f"x{usr[-2]}"], "func", r.choice([True, False, None]), r.choice([None, pos]), mentions))
    rows.append(("A", "A", 2000, None, None, None, None, None, None, None))
    v, e, at = vertices.naturalize(spark.createDataFrame(rows, SCHEMA))
    found, edges, locations = scan(rows)
    assert {(x.culture, x.namespace, x.id): (x.path, x.origin) for x in v.collect()} == found
    assert sorted((x.culture, x.namespace, x.source, x.target) for x in e.collect()) == sorted(edges)
    assert sorted((x.culture, x.namespace, x.id, x.location) for x in at.collect()) == sorted(locations)
    assert {o for _, o in found.values()} == {"natural", "inferred", "placeholder"}
    assert all(x.count() == 0 for x in vertices.naturalize(spark.createDataFrame([], SCHEMA)))


def test_ids_taken_apart_in_steps(spark):
    from pyspark.sql import functions as F

    from docgraph.functions.identity import usr_interface, with_interface

    ids = ["s1A2_PP4name", "ss6_QueuePsE5thing", "s3Lib5OtherP3ExtE1x", "s3Lib5OtherC", "c1A1PP", "s", "", "s0A1PP", "s1A05HelloP", "s9Short", "s1A2PPPsE", "s1A1PP2BBE3foo", "s1A1PP9BBE", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r.id: r.v for r in with_interface(df, F.col("id"), "v").collect()}
    assert got == {r.id: r.v for r in df.select("id", usr_interface(F.col("id")).alias("v")).collect()}
    assert sum(v is not None for v in got.values()) >= 4
