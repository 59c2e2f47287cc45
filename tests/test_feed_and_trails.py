"""Feeds, article URIs, trails of composites, resolved declarations and consumers on made tables."""

from docgraph.operators import packages, pages, routes, uris, vertices


def test_feed_of_articles(spark):
    texts = {
        1: ("# First steps\n\nOne line\nand  another.\n\nA second paragraph.", "First steps", "One line and  another."),
        2: ("Plain title", "Plain title", ""),
        3: (None, "", ""),
        4: ("# List first\n- item", "List first", ""),
        5: ("## Code\n```\nx\n```", "Code", ""),
        6: ("#\n\n\n2 apples", "", "2 apples"),
        7: ("# T\n\n2. numbered", "T", ""),
    }
    articles = spark.createDataFrame([(a, t) for a, (t, *_) in texts.items()] + [(8, "# no uri")], "article bigint, text string")
    at = spark.createDataFrame([(a, f"/learn/m/{a}") for a in texts], "article bigint, uri string")
    got = {r.article: (r.title, r.snippet, r.link) for r in pages.article_feed(articles, at, "https://d.example").collect()}
    assert got == {a: (title, snippet, f"https://d.example/learn/m/{a}") for a, (_, title, snippet) in texts.items()}
    assert pages.article_feed(articles.limit(0), at, "x").count() == 0


def test_article_uris_follow_the_last_move(spark):
    articles = spark.createDataFrame([(1, 10, "Intro/A b"), (2, 11, "x"), (3, 12, "x"), (4, 13, "x"), (5, 99, "x")], "article bigint, module int, name string")
    modules = spark.createDataFrame([(10, 1, "Core"), (11, 2, "Mine"), (12, 2, "Moved"), (13, 2, "Back")], "module int, package int, name string")
    owners = spark.createDataFrame([(1, "swift", 0), (2, "pkg", 2)], "package int, name string, rank int")
    moves = spark.createDataFrame([("article", 12, "/old", 3), ("article", 12, "/new", 7), ("article", 13, "/past", 6), ("module", 11, "/m", 7)], "kind string, module int, uri string, ver int")
    latest = spark.createDataFrame([(1, 7), (2, 7)], "package int, ver int")
    got = {r.article: r.uri for r in uris.latest_article_uris(articles, modules, owners, moves, latest).collect()}
    assert got == {1: "/learn/core/intro/a%20b", 2: "/learn/pkg/mine/x", 3: "/new/x", 4: "/learn/pkg/back/x"}


def test_trails_of_composites(spark):
    symbols = spark.createDataFrame([(1, "A", None), (2, "B", 1), (3, "f", 2), (4, "P", None), (5, "g", 4), (6, "x", 7), (7, "y", 6)], "symbol bigint, name string, parent bigint")
    composites = spark.createDataFrame([(3, 3, 1), (5, 2, 1), (5, 1, 2), (1, 1, 1), (5, 6, 1), (5, 99, 1)], "base bigint, host bigint, culture int")
    got = {}
    for r in routes.composite_breadcrumbs(composites, routes.symbol_paths(symbols)).orderBy("level").collect():
        got.setdefault((r.base, r.host, r.culture), []).append((r.level, r.ancestor))
    assert got == {(3, 3, 1): [(0, 1), (1, 2)], (5, 2, 1): [(0, 1), (1, 2)], (5, 1, 2): [(0, 1)]}


def test_declarations_with_constraints(spark):
    pieces = spark.createDataFrame([(1, 1, 0, "Int", "sInt"), (1, 1, 1, "plain", None), (1, 1, 2, "C", "cThing"), (2, 2, 0, "Int", "sInt"), (1, 1, 3, "Int", "sInt")], "symbol bigint, culture int, pos int, text string, link string")
    bounds = spark.createDataFrame([(1, 1, "extension", 0, "Self", "conforms", "P", "sP"), (1, 1, "generic", 0, "T", "is", "Int", "sInt")], "symbol bigint, culture int, list string, pos int, subject string, verb string, text string, link string")
    known = spark.createDataFrame([(1, "sInt", 70), (2, "sInt", None)], "culture int, id string, symbol bigint")
    made, kept, warnings = vertices.resolve_declarations(pieces, bounds, known)
    assert sorted((r.symbol, r.pos, r.text, r.target or 0) for r in made.collect()) == [(1, 0, "Int", 70), (1, 1, "plain", 0), (1, 2, "C", 0), (1, 3, "Int", 70), (2, 0, "Int", 0)]
    assert sorted((r.list, r.text, r.target or 0) for r in kept.collect()) == [("extension", "P", 0), ("generic", "Int", 70)]
    assert sorted((r.symbol, r.culture, r.link) for r in warnings.collect()) == [(1, 1, "sP"), (2, 2, "sInt")]


def test_consumers_in_order(spark):
    pins = spark.createDataFrame([(3, 1, 5), (2, 1, 5), (2, 1, 5), (4, 1, 6), (None, 1, 5), (7, 2, None)], "package int, dep int, dep_ver int")
    got = sorted((r.dep, r.dep_ver, r.consumer, r.rank) for r in packages.consumers(pins).collect())
    assert got == [(1, 5, 2, 1), (1, 5, 3, 2), (1, 6, 4, 1)]
