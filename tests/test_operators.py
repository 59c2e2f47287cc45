"""Operators on small made cases: depths, chains, cycles, ties, nulls and every form of link."""

from pyspark.sql import functions as F

from docgraph.functions.doc_fields import doc_fields
from docgraph.functions.storage import shared_dir
from docgraph.operators import composites, docs, facts, links, packages, pages, registry, routes
from docgraph.sources import graphs


def test_first_seen_after_a_single_known_key(spark):
    known = spark.createDataFrame([("a", 0)], "key string, idx bigint")
    arrivals = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("b", 1)], "key string, at int")
    got = packages.register_first_seen(arrivals, "key", ["at"], known)
    assert {r.key: r.idx for r in got.collect()} == {"a": 0, "b": 1, "c": 2}
    assert packages.register_first_seen(arrivals.limit(0), "key", ["at"]).count() == 0


def brute_prune(rows):
    """The scan by symbol, as it stands: an origin that was pruned before no longer matches."""
    comments = {s: c for s, _, c in rows}
    for s, o, c in sorted(rows):
        if c is not None and o is not None and comments.get(o) == c:
            comments[s] = None
    return comments


def test_long_chains_of_equal_comments(spark):
    rows = [(0, None, "same")] + [(i, i - 1, "same") for i in range(1, 60)] + [(100, None, "x"), (101, 100, "y"), (102, 101, None), (103, 109, "z"), (109, None, "z"), (110, 103, "z"), (111, 999, "z"), (112, 113, "q"), (113, 112, "q")]
    table = spark.createDataFrame(rows, "symbol bigint, origin bigint, comment string")
    assert {r.symbol: r.comment for r in docs.prune_comments(table).collect()} == brute_prune(rows)


def test_deep_paths_and_cycles(spark):
    rows = [(i, f"n{i}", i - 1 if i else None) for i in range(21)] + [(50, "lone", 999), (60, "a", 61), (61, "b", 60), (62, "c", 61)]
    got = {r.symbol: r.path for r in routes.symbol_paths(spark.createDataFrame(rows, "symbol bigint, name string, parent bigint")).collect()}
    assert got[20] == [f"n{i}" for i in range(21)] and got[0] == ["n0"] and got[50] == ["lone"]
    assert got[60] is got[61] is got[62] is None and len(got) == len(rows)


def test_paths_below_a_cycle_stay_short(spark):
    """Tens of thousands of symbols below one cycle, beside paths that end."""
    rows = spark.range(50_000).selectExpr("id as symbol", "concat('n', id) as name", "case when id = 0 then 1 when id < 45000 then id div 2 when id > 45000 then nullif(id - (id - 45000) % 3, id) end as parent", "'c' as culture")
    got = routes.symbol_paths(rows)
    assert got.count() == 50_000 and got.columns == ["symbol", "name", "parent", "culture", "path", "trail"]
    assert got.filter("path is null and trail is null").count() == 45_000
    assert got.filter("symbol >= 45000").selectExpr("max(size(path)) as n", "min(trail[size(trail) - 1] - symbol) as same").first() == (2, 0)


def test_module_order_of_a_long_chain(spark):
    modules = spark.createDataFrame([(i, 0) for i in range(70)], "module int, package int")
    deps = spark.createDataFrame([(i, i - 1) for i in range(1, 70)], "module int, dep int")
    assert {r.module: r.depth for r in packages.module_order(modules, deps).collect()} == {i: i for i in range(70)}


def test_graph_tables_are_written_once(spark):
    path = f"{shared_dir(spark)}/graph-test"
    rows = spark.createDataFrame([(1, "a", 1, "1.0"), (2, "b", 2, "1.0")], "symbol bigint, name string, package int, version string")
    for _ in range(2):
        graphs.write_graph(rows, path)
    graphs.write_graph(spark.createDataFrame([(3, "c", 2, "1.0")], rows.schema), path)
    got = graphs.read_graph(spark, path, "symbol bigint, name string, package int, version string").collect()
    assert sorted((r.symbol, r.package) for r in got) == [(1, 1), (3, 2)]


def test_doc_fields_of_nulls_and_repeats(spark):
    table = spark.createDataFrame([(1, "# A"), (2, None), (3, ""), (1, "# A")], "id bigint, text string")
    assert [(r.id, r.field, r.content) for r in doc_fields(table, "id", "text").collect()] == [(1, "headline", "A")] * 2


def test_section_order(spark):
    topics = spark.createDataFrame([(1, 6, 0, 1, 10), (1, 6, 0, 1, 11), (1, 7, 2, 2, 12), (1, 7, 2, 3, 12), (1, 7, 0, 1, 12), (1, 6, 1, 2, 10)], "host bigint, section int, culture_class int, culture int, target bigint")
    symbols = spark.createDataFrame([(10, "instanceMethod"), (11, "initializer"), (12, "struct")], "symbol bigint, community string")
    modules = spark.createDataFrame([(1, 5, "M"), (2, 9, "B"), (3, 7, "C")], "module int, package int, name string")
    got = pages.sort_sections(topics, symbols, modules, modules.select("package")).orderBy("rank").collect()
    assert [(r.section, r.sublist, r.culture_class, r.culture, r.cards) for r in got] == [(6, "initializer", 0, 1, 1), (6, "instanceMethod", 0, 1, 1), (6, "instanceMethod", 1, 2, 1), (7, None, 0, 1, 1), (7, None, 2, 3, 1), (7, None, 2, 2, 1)]


def test_links_of_every_form(spark):
    modules = spark.createDataFrame([(1, 10, "Own"), (2, 20, "Other"), (3, 20, "Third"), (4, 30, "Hidden")], "module int, package int, name string")
    owners = spark.createDataFrame([(10, "mine"), (20, "theirs"), (30, "far")], "package int, name string")
    scopes = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "culture int, namespace int")
    rows = [(100, 1, "", "type", "/", 1), (101, 1, "type", "go()", ".", 1), (102, 2, "", "type", "/", 2), (103, 2, "", "there", "/", 2), (104, 3, "", "both", "/", 3), (105, 2, "", "both", "/", 2), (106, 2, "type", "twin", ".", 2), (107, 2, "type", "twin", ".", 2), (108, 4, "", "unseen", "/", 4), (109, 2, "", "gone", "/", 2), (110, 1, "", "guide", "/", 1)]
    held = [(n, stem, leaf, o, b, b, c, 0, 2 if b == 109 else 9) for b, n, stem, leaf, o, c in rows]
    groups = composites.grouped(spark.createDataFrame(held, "namespace int, stem string, leaf string, orientation string, base bigint, host bigint, culture int, lo bigint, hi bigint"), modules)
    kinds = spark.createDataFrame([(r[0], {106: "instanceMethod", 107: "typeMethod"}.get(r[0], "struct")) for r in rows], "symbol bigint, community string")
    articles = spark.createDataFrame([(1, "guide", 900), (2, "guide", 901)], "module int, name string, article bigint")
    pins = spark.createDataFrame([(10, 10, 5), (10, 20, 5)], "package int, dep int, dep_ver int")
    latest = spark.createDataFrame([(p, 9) for p in (10, 20, 30)], "package int, ver int")
    asked = {
        1: ("type", "visible", ["go()"], None, (101, "symbol", "one")),  # below the nest, dotted
        2: ("", "visible", ["type"], None, (100, "symbol", "one")),  # own before imported
        3: ("", "visible", ["other", "type"], None, (102, "symbol", "one")),  # by module
        4: ("", "visible", ["there"], None, (103, "symbol", "one")),  # imported
        5: ("", "visible", ["both"], None, (None, None, "none")),  # in two imported modules
        6: ("", "absolute", ["theirs", "other", "type"], None, (102, "symbol", "one")),
        7: ("", "absolute", ["type"], None, (None, None, "none")),  # no fallthrough
        8: ("", "absolute", ["far", "hidden", "unseen"], None, (108, "symbol", "one")),  # out of scope, which only matters for visible links
        9: ("", "visible", ["other", "type", "twin"], None, (None, None, "many")),
        10: ("", "visible", ["other", "type", "twin"], "typeMethod", (107, "symbol", "one")),
        11: ("", "visible", ["gone"], None, (None, None, "none")),  # not at the pinned version
        12: ("", "doc", ["guide"], None, (900, "article", "one")),
        13: ("", "visible", ["guide"], None, (110, "symbol", "one")),
        14: ("", "doc", ["type"], None, (100, "symbol", "one")),  # no such article
        15: ("", "visible", [], None, (None, None, "none")),
        16: (None, "visible", None, None, (None, None, "none")),
    }
    log = [(i, 1, [n] if n else [], 1, form, path, "/", kind) for i, (n, form, path, kind, _) in asked.items()]
    log = spark.createDataFrame(log, "link bigint, culture int, nest array<string>, nest_namespace int, form string, path array<string>, orientation string, community string")
    got = links.resolve_links(log, groups, scopes, modules, owners, articles, kinds, pins, latest)
    assert {r.link: (r.target, r.kind, r.status) for r in got.collect()} == {i: want for i, (*_, want) in asked.items()}


EDGE = "source bigint, relation string, target bigint, pos bigint, constraints array<struct<subject:string,verb:string,object:bigint>>"
KINDS = [(1, 1, 1, "struct", "concrete"), (2, 1, 1, "protocol", "protocol"), (3, 1, 1, "protocol", "protocol"), (4, 2, 2, "protocol", "protocol"), (5, 2, 2, "struct", "concrete")]


def placed(spark, edges):
    symbols = spark.createDataFrame(KINDS, "symbol bigint, culture int, namespace int, community string, class string")
    scopes = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "culture int, namespace int")
    return facts.resolve_edges(spark.createDataFrame(edges, EDGE), symbols, scopes)


def test_edges_fall_with_their_constraints(spark):
    far, near, lost = ("Self", "conforms", 4), ("Self", "conforms", 3), ("T", "is", 99)
    edges = [(1, "conformer", 2, 1, None), (1, "conformer", 2, 2, [near]), (1, "conformer", 2, 3, [near, far]), (1, "conformer", 2, 4, [lost]), (1, "conformer", 4, 5, []), (1, "conformer", 98, 6, []), (97, "conformer", 2, 7, []), (5, "conformer", 2, 8, [near, far]), (1, "conformer", 2, 2, [near])]
    got = sorted((r.pos, r.resolved) for r in placed(spark, edges).collect())
    assert got == [(1, True), (2, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False), (8, True)]
    assert placed(spark, []).count() == 0


def test_conditions_of_conformances(spark):
    near, other = ("Self", "conforms", 3), ("Self", "is", 2)
    edges = [(1, "conformer", 2, 1, [near]), (1, "conformer", 2, 5, [other]), (1, "conformer", 2, 3, []), (2, "conformer", 3, 1, [near]), (2, "conformer", 3, 2, None), (1, "member", 2, 1, [near])]
    said = facts.edge_statements(placed(spark, edges).filter("resolved"))
    rejects = [(r.subject, r.object, r.pos) for r in said.filter("verb IS NULL").collect()]
    assert rejects == [(2, 3, 1)]
    held = {(r.subject, r.slot, r.object): [tuple(c) for c in r.conditions] for r in facts.traits(said).collect()}
    assert held == {(1, "conformance", 2): [other], (2, "conformer", 1): [other], (3, "refinement", 2): [], (2, "member", 1): []}
    folded = facts.fold_traits(facts.traits(said)).filter("slot = 'conformer'").first()
    assert folded.objects == [1] and [[tuple(c) for c in e] for e in folded.conditions] == [[other]]


def test_beliefs_after_a_push(spark):
    where = "array<struct<subject:string,verb:string,object:bigint>>"
    one, none = [("Self", "conforms", 3)], []
    # modules 1 and 2 are of one package, 3 of another; symbols 1 and 2 are at home in module 1, only 1 was pushed
    long = [(1, 1, "member", 7, none), (1, 2, "member", 7, none), (1, 2, "conformance", 8, one), (1, 1, "conformance", 8, none), (1, 2, "member", 9, none), (1, 3, "member", 7, none), (2, 1, "member", 7, none), (2, 2, "member", 7, none)]
    rows = spark.createDataFrame(long, f"subject bigint, culture int, slot string, object bigint, conditions {where}")
    symbols = spark.createDataFrame([(1, 1), (2, 1)], "symbol bigint, culture int")
    modules = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "module int, package int")
    got = facts.split_beliefs(rows, symbols, modules, spark.createDataFrame([(1,), (1,)], "symbol bigint"))
    want = [(1, 1, "conformance", 8, "primary"), (1, 1, "member", 7, "primary"), (1, 2, "conformance", 8, "accepted"), (1, 2, "member", 9, "accepted"), (1, 3, "member", 7, "opinion"), (2, 1, "member", 7, "opinion"), (2, 2, "member", 7, "opinion")]
    assert sorted((r.subject, r.culture, r.slot, r.object, r.belief) for r in got.collect()) == want


def test_cards_and_relations_by_path(spark):
    paths = spark.createDataFrame([(1, ["B", "a"]), (2, ["A", "a"]), (3, ["Z"]), (4, ["A"])], "symbol bigint, path array<string>")
    topics = spark.createDataFrame([(0, 9, 0, 1, t) for t in (1, 2, 3, 4)] + [(0, 9, 1, 2, 3)], "host bigint, section int, culture_class int, culture int, target bigint")
    articles = spark.createDataFrame([(0, 9, 0, 1, 70, ["z"]), (0, 9, 0, 1, 71, ["b"])], "host bigint, section int, culture_class int, culture int, article bigint, path array<string>")
    got = [(r.kind, r.target) for r in pages.sort_cards(topics, paths, articles).orderBy("rank").collect()]
    assert got == [("article", 71), ("article", 70), ("symbol", 4), ("symbol", 3), ("symbol", 2), ("symbol", 1), ("symbol", 3)]
    beliefs = spark.createDataFrame([(0, c, "member", o) for c in (1, 2) for o in (1, 2, 3, 4)], "subject bigint, culture int, slot string, object bigint")
    ranked = pages.sort_relations(beliefs, paths).orderBy("culture", "rank").collect()
    assert [(r.culture, r.object) for r in ranked] == [(c, o) for c in (1, 2) for o in (4, 2, 1, 3)]


def test_catalogs_rejects_and_snippets(spark):
    good = '{"catalog_tools_version":3,"package":"p","brand":"B","modules":[{"module":"M","dependencies":[{"package":"q","modules":["X","Y"]}]},{"module":"N"}],"snippets":[{"snippet":"S","sources":["s.swift"],"dependencies":[]}]}'
    texts = [f"[{good}]", '[{"catalog_tools_version":2,"package":"old","modules":[{"module":"O"}]}]', "no json", None, '[{"package":"none"}]', "[]"]
    got = graphs.read_package_catalog(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    kept = sorted((r.package, r.brand, r.kind, r.name, r.dep_package, r.dep_module) for r in got if r.why is None and r.dep_module)
    assert kept == [("p", "B", "module", "M", "q", "X"), ("p", "B", "module", "M", "q", "Y")]
    assert sorted((r.kind, r.name, r.sources) for r in got if r.why is None and not r.dep_module) == [("module", "N", None), ("snippet", "S", ["s.swift"])]
    assert sorted(str((r.package, r.why)) for r in got if r.why) == sorted(map(str, [("old", "tools_version"), ("none", "tools_version"), (None, "json"), (None, "json"), (None, "json")]))


def test_symbols_with_and_without_lists(spark):
    whole = '{"identifier":{"precise":"s:1"},"pathComponents":["T"],"kind":{"identifier":"swift.struct"},"availability":[{"isUnconditionallyDeprecated":true},{"domain":"macOS","introduced":{"major":10,"minor":15}}],"swiftGenerics":{"parameters":[{"name":"B","index":0,"depth":1},{"name":"A","index":1,"depth":0}],"constraints":[{"kind":"superclass","lhs":"A","rhs":"C"},{"kind":"odd","lhs":"B","rhs":"D"}]}}'
    bare = '{"identifier":{"precise":"s:2"},"pathComponents":["U"],"kind":{"identifier":"swift.enum"}}'
    edge = '{"source":"s:1","target":"s:2","kind":"conformsTo","swiftConstraints":[{"kind":"%s","lhs":"A","rhs":"C","rhsPrecise":"s:3"}]}'
    text = '{"module":{"name":"M"},"symbols":[%s,%s],"relationships":[%s,%s]}' % (whole, bare, edge % "sameType", edge % "odd")
    good, bad = graphs.read_symbol_graphs(spark.createDataFrame([("M.symbols.json", text)], "file string, text string"))
    one, two = graphs.read_symbols(good).orderBy("id").collect()
    assert one.generics == ["A", "B"] and [tuple(c) for c in one.constraints] == [("A", "subclasses", None, "C"), ("B", None, None, "D")]
    assert one.availability.general == "deprecated" and [tuple(p) for p in one.availability.platforms] == [("macOS", "available", "10.15")]
    assert two.generics == two.constraints == two.extension_constraints == two.signature == [] and two.availability.general is None
    assert [(r.relation, r.why, [tuple(c) for c in r.constraints]) for r in graphs.read_relationships(good).orderBy("pos").collect()] == [("conformer", None, [("A", "is", "s:3", "C")]), (None, "constraint", [("A", None, "s:3", "C")])]
    assert bad.count() == 0


def test_numbers_and_sets_of_a_large_module(spark):
    vertices = spark.createDataFrame([(f"v{i}", 9 - i, 1, 1) for i in range(5)] + [("v0", 1, 2, 9), ("far", 20, 1, 7)], "id string, pos bigint, culture int, namespace int")
    scopes = spark.createDataFrame([(1, 1), (2, 2), (2, 9)], "culture int, namespace int")
    known = spark.createDataFrame([("v2", 1, 0), ("v3", 5, 1)], "id string, module int, idx bigint")
    got = {r.id: (r.module, r.idx, r.status) for r in registry.register_symbols(vertices, scopes, known).collect()}
    assert got == {"v0": (2, 2, "new"), "v4": (1, 3, "new"), "v1": (1, 4, "new"), "v2": (1, 0, "known"), "v3": (5, 1, "moved"), "far": (1, None, "colony")}
    paths = spark.range(1000).select(F.lit(1).alias("culture"), F.col("id").alias("symbol"), F.array(F.lit("x")).alias("path")).union(spark.createDataFrame([(1, 7, ["x"]), (1, 2000, ["x", "y"])], "culture int, symbol bigint, path array<string>"))
    none = spark.createDataFrame([], "culture int, article bigint")
    sets = registry.module_sets(paths, spark.createDataFrame([(1, 5), (1, 3)], "module int, dep int"), none).collect()
    assert sorted((r.member, r.rank) for r in sets if r.kind == "toplevel") == [(i, i + 1) for i in range(1000)]
    assert sorted((r.member, r.rank) for r in sets if r.kind == "dependency") == [(3, 1), (5, 2)] and len(sets) == 1002


def test_composites_by_belief(spark):
    modules = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "module int, package int")
    homes = spark.createDataFrame([(10, 1)], "symbol bigint, culture int")
    natural = spark.createDataFrame([(5, 2, 4), (5, 6, 6)], "symbol bigint, lo int, hi int")
    features = spark.createDataFrame([(10, 5, 1, "primary", 0, 3), (10, 5, 2, "accepted", 2, 2), (10, 5, 3, "opinion", 1, 1), (10, 5, 2, "opinion", 5, 5)], "host bigint, base bigint, culture int, belief string, lo int, hi int")
    asked = [(5, 5, 1, v) for v in (1, 3, 5, 6)] + [(5, 10, 1, 3), (5, 10, 1, 4), (5, 10, 2, 2), (5, 10, 2, 5), (5, 10, 3, 1), (5, 10, 3, 1), (5, 11, 1, 1)]
    got = registry.composite_exists(spark.createDataFrame(asked, "base bigint, host bigint, culture int, ver int"), natural, features, homes, modules).collect()
    there = sorted((r.base, r.host, r.culture, r.ver) for r in got if r.exists)
    assert there == [(5, 5, 1, 3), (5, 5, 1, 6), (5, 10, 1, 3), (5, 10, 2, 2), (5, 10, 3, 1), (5, 10, 3, 1)] and len(got) == len(asked)
