"""Shapes over versions against a walk push by push; topics and notes of made symbols."""

import random

from docgraph.operators import pages, shapes, vertices

ROUTED = "package int, ver int, namespace int, stem string, leaf string, orientation string, base bigint, host bigint, culture int"


def walked(pushed, paths, routed):
    """The same push by push: routes of the version go in first, then each symbol is judged."""
    groups, state, out = {}, {}, {}
    for ver in sorted({r[1] for r in pushed} | {r[1] for r in routed}):
        for package, v, *route, base, host, culture in routed:
            if v == ver:
                groups.setdefault((package, *route), set()).add((base, host, culture))
        for symbol, v, shape, parent in pushed:
            if v != ver or paths[symbol][3] is None:
                continue
            package, namespace, _, path = paths[symbol]
            if shape is not None:
                state[symbol], origin = (shape, parent), "said"
            elif symbol in state:
                origin = "kept"
            elif len(path) == 1:
                origin = "root"
            else:
                low = [p.lower() for p in path]
                found = groups.get((package, namespace, "\t".join(low[:-2]), low[-2], "/"), set())
                origin = "orphan"
                if len(found) == 1 and min(found)[0] == min(found)[1]:
                    state[symbol], origin = ("member", min(found)[0]), "inferred"
            out[symbol, ver] = (*state.get(symbol, (None, None)), origin)
    return out


def test_shapes_over_versions(spark):
    rng = random.Random(3)
    names = ["A", "b", "C"]
    paths = {s: (rng.randrange(2), rng.randrange(2), rng.randrange(2), [rng.choice(names) for _ in range(rng.randint(1, 3))]) for s in range(60)}
    paths[60] = (0, 0, 0, None)
    pushed = [(s, v, *(("requirement" if rng.random() < 0.3 else "member", rng.randrange(60)) if rng.random() < 0.2 else (None, None))) for s in paths for v in range(6) if rng.random() < 0.5]
    routed = []
    for s, v, *_ in pushed:
        package, namespace, culture, path = paths[s]
        if path:
            low = [p.lower() for p in path]
            kind = "." if s % 9 == 0 else "/"
            routed.append((package, v, namespace, "\t".join(low[:-1]), low[-1], kind, s, s if s % 7 else s + 1, culture))
    routed += routed[:10]
    groups = shapes.lens_groups(spark.createDataFrame(routed, ROUTED))
    given = spark.createDataFrame([(s, p, n, path) for s, (p, n, _, path) in paths.items()], "symbol bigint, package int, namespace int, path array<string>")
    got = shapes.infer_shapes(spark.createDataFrame(pushed, "symbol bigint, ver int, shape string, parent bigint"), given, groups).cache()
    want = walked(pushed, paths, routed)
    assert {(r.symbol, r.ver): (r.shape, r.parent, r.origin) for r in got.collect()} == want
    assert {w[2] for w in want.values()} == {"said", "kept", "inferred", "orphan", "root"}
    cultures = spark.createDataFrame([(s, c) for s, (_, _, c, _) in paths.items()], "symbol bigint, culture int")
    members = {(r.subject, r.ver, r.culture, r.object, r.belief) for r in shapes.inferred_members(got, cultures).collect()}
    hosts = set(want)
    expected = {(p, v, paths[s][2], s, "primary" if paths[s][2] == paths[p][2] else "accepted") for (s, v), (_, p, o) in want.items() if o == "inferred" and (p, v) in hosts}
    assert members == expected and expected


def test_groups_by_lens(spark):
    rows = [(1, 0, 5, "", "x", "/", 7, 7, 1), (1, 0, 5, "", "x", "/", 7, 7, 1), (1, 3, 5, "", "x", "/", 7, 7, 1), (1, 2, 5, "", "x", "/", 8, 9, 1), (2, 4, 5, "", "x", "/", 7, 7, 1), (None, 4, None, None, None, None, 7, 7, 1)]
    got = shapes.lens_groups(spark.createDataFrame(rows, ROUTED)).cache()
    assert sorted((r.package or 0, r.base, r.retains, r.lo, r.composites) for r in got.collect()) == [(0, 7, 1, 4, 1), (1, 7, 2, 0, 2), (1, 8, 1, 2, 2), (2, 7, 1, 4, 1)]
    alone = shapes.only_composites(got).filter("package is not null").collect()
    assert sorted((r.package, r.base, r.lo, r.hi) for r in alone) == [(1, 7, 0, 1), (2, 7, 4, None)]
    assert shapes.lens_groups(spark.createDataFrame([], ROUTED)).count() == 0


SYMBOLS = [(1, "protocol", "P", "protocol"), (2, "protocol", "Q", "protocol"), (3, "concrete", "S", "struct"), (4, "callable", "r", "instanceMethod"), (5, "callable", "f", "instanceMethod"), (6, "concrete", "K", "class"), (7, "callable", "g", "instanceMethod"), (8, "callable", "h", "instanceMethod")]
SHAPES = [(4, "requirement", 1), (5, "member", 3), (7, "member", 6), (8, "requirement", 2)]
ROLES = [(1, "refinement", 2), (1, "interface", 4), (1, "interface", 4), (4, "override", 8), (5, "implementation", 4), (5, "implementation", 8), (5, "override", 7), (5, "implementation", 99), (3, "override", 4)]


def tables(spark):
    symbols = spark.createDataFrame([(s, c, 1, n, [n], k) for s, c, n, k in SYMBOLS], "symbol bigint, class string, culture int, name string, path array<string>, community string")
    return symbols, spark.createDataFrame(SHAPES, "symbol bigint, shape string, parent bigint"), spark.createDataFrame(ROLES, "subject bigint, slot string, object bigint")


def test_topics_by_kind_of_host(spark):
    symbols, made, roles = tables(spark)
    when = [("Self", "conforms", 2)]
    rows = [(1, 1, "conformer", 3, when, "primary"), (2, 1, "refinement", 1, [], "primary"), (1, 2, "member", 5, [], "accepted"), (3, 3, "feature", 5, [], "opinion"), (3, 1, "member", 7, [], "primary"), (6, 1, "subclass", 6, [], "primary"), (3, 1, "conformance", 1, when, "primary")]
    rows += [(8, 1, "override", 4, [], "primary"), (4, 1, "implementation", 5, [], "primary"), (7, 1, "override", 5, [], "primary"), (7, 1, "implementation", 5, [], "primary"), (3, 1, "conformer", 1, [], "primary"), (99, 1, "member", 5, [], "primary"), (3, 1, "member", 99, [], "primary")]
    beliefs = spark.createDataFrame(rows, "subject bigint, culture int, slot string, object bigint, conditions array<struct<subject:string,verb:string,object:bigint>>, belief string")
    usable = spark.createDataFrame([(7, False), (5, None)], "symbol bigint, usable boolean")
    names = {n: s for s, n in pages.SECTIONS.items()}
    got = sorted((r.host, names[r.section], r.culture_class, r.culture, r.target, r.target_host, len(r.conditions)) for r in pages.topics(beliefs, roles, made, symbols, usable).collect())
    want = [(1, "conformer", 0, 1, 3, 3, 1), (1, "implication", 0, 1, 2, 2, 0), (1, "member", 1, 2, 5, 5, 0), (1, "requirement", 0, 1, 4, 4, 0), (2, "refinement", 0, 1, 1, 1, 0), (3, "conformance", 0, 1, 1, 1, 1), (3, "member", 2, 3, 5, 3, 0), (3, "removed", 0, 1, 7, 7, 0)]
    want += [(4, "implementation", 0, 1, 5, 5, 0), (6, "subclass", 0, 1, 6, 6, 0), (7, "override", 0, 1, 5, 5, 0), (8, "restatement", 0, 1, 4, 4, 0)]
    assert got == want


def test_notes_of_composites(spark):
    symbols, made, roles = tables(spark)
    composites = spark.createDataFrame([(4, 4, 1), (5, 5, 1), (5, 6, 2), (5, 6, 2), (3, 3, 1), (8, 8, 1), (99, 99, 1)], "base bigint, host bigint, culture int")
    bounds = spark.createDataFrame([(5, [("A", "conforms", "B")]), (3, []), (4, None)], "symbol bigint, constraints array<struct<subject:string,verb:string,object:string>>")
    got = {}
    for r in vertices.page_notes(composites, symbols, made, roles, bounds).orderBy("rank").collect():
        got.setdefault((r.base, r.host), []).append((r.rank, r.note, r.link))
    assert got == {
        (4, 4): [(1, "Required.", None), (2, "Restates requirement of Q.", 8)],
        (8, 8): [(1, "Required.", None)],
        (5, 5): [(1, "Overrides member of K.", 7), (2, "Implements requirement of P.", 4), (3, "Implements requirement of Q.", 8), (4, "Available when A conforms to B.", None)],
        (5, 6): [(1, "Available because Self conforms to S.", 5), (2, "Available when A conforms to B.", None)],
    }
    modules = spark.createDataFrame([(1, "One"), (2, "Two")], "module int, name string")
    facts = {(r.base, r.host): (r.title, r.kind, r.culture_name, r.namespace, r.base_module) for r in vertices.page_facts(composites.distinct(), symbols, modules).collect()}
    assert facts == {(4, 4): ("r", "instanceMethod", "One", None, None), (5, 5): ("f", "instanceMethod", "One", None, None), (5, 6): ("f", "instanceMethod", "Two", "One", "One"), (3, 3): ("S", "struct", "One", None, None), (8, 8): ("h", "instanceMethod", "One", None, None)}
