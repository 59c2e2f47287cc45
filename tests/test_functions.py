"""Worked examples of the scalar functions, and rejects of the sources."""

import pytest
from pyspark.sql import functions as F

from docgraph.functions import identity, uri
from docgraph.functions.doc_fields import fields
from docgraph.functions.versions import parse_version, version_string
from docgraph.operators import packages
from docgraph.sources import graphs


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("usr", "want"),
    [("ss6_QueuePsE5drainyyF", ("Swift", "_Queue", "ss6_QueueP")), ("s5Depot6_CrateP4YardE", ("Yard", "_Crate", "s5Depot6_CrateP")), ("s05DepotP", None), ("c5Depot6_CrateP", None)],
)
def test_usr_interface(spark, usr, want):
    got = one(spark, identity.usr_interface(F.col("u")), u=usr)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("path", "components", "fold"),
    [("/one//two\\three/../four./.five/%2e%2e/", ["one", "two", "four.", ".five", ".."], 5), ("/../../a", ["a"], 0), ("/a%20b/c+d", ["a b", "c+d"], 0), ("", [], 0)],
)
def test_normalize_uri(spark, path, components, fold):
    got = one(spark, uri.path_components(F.col("p")), p=path)
    assert got.components == components and got.fold == fold


@pytest.mark.parametrize(
    ("link", "want"),
    [("crate", (["crate"], "/", None)), ("stack(onto:)", (["stack(onto:)"], ".", None)), ("crate.stack(onto:)", (["crate", "stack(onto:)"], ".", None)), (".lid", (["lid"], ".", None)), ("labels-swift.func", (["labels"], "/", "swift.func")), (">(_:_:)", ([">(_:_:)"], ".", None)), ("...(_:_:)", (["...(_:_:)"], ".", None)), ("Span...(_:)", (["Span", "..(_:)"], ".", None)), ("", ([], "/", None))],
)
def test_symbol_link(link, want):
    got = uri.symbol_link(link)
    assert (got[0], got[1], got[2]) == want


@pytest.mark.parametrize(("text", "want"), [("1", "1"), ("1.2.3.4", "1.2.3.4"), ("2024-1-31-b", "2024-1-31-b"), ("2024-1-31", "2024-1-31"), ("65536", None), ("1.2.3.4.5", None), ("v1", None), ("", None)])
def test_parse_version(spark, text, want):
    assert one(spark, version_string(parse_version(F.col("t"))), t=text) == want


def test_doc_fields():
    text = "@import(A)\n@path(x/y)\n# ``Foo/bar``\nFirst line\nof summary.\n\n- Note: careful\n- Parameter x: a value\n- Returns: it\n## Big\nin big\n### Small\nin small, see <doc:Other>\n## Next\n```swift\nlet x = 1\n```\n"
    rows = [(f, n, level, c) for f, n, level, _, c in fields(text)]
    assert ("directive", "import", 0, "A") in rows and ("binding", None, 0, "Foo/bar") in rows
    assert ("summary", None, 0, "First line of summary.") in rows and ("aside", "note", 0, "careful") in rows
    assert ("parameter", "x", 0, "a value") in rows and ("returns", None, 0, "it") in rows
    assert ("section", "Big", 2, "in big\n### Small\nin small, see <doc:Other>") in rows and ("section", "Small", 3, "in small, see <doc:Other>") in rows
    assert ("code", None, 0, "let x = 1") in rows and ("link", None, 0, "Other") in rows
    assert list(fields(None)) == list(fields(""))  == []


def test_cycle_has_no_order(spark):
    modules = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "module int, package int")
    deps = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "module int, dep int")
    assert {r.module: r.depth for r in packages.module_order(modules, deps).collect()} == {1: None, 2: None, 3: 0}


def test_graph_rejects(spark):
    files = spark.createDataFrame([("A.symbols.json", '{"module":{"name":"A"},"symbols":[],"relationships":[]}'), ("A@A.symbols.json", '{"module":{"name":"A"}}'), ("B.symbols.json", '{"module":{"name":"C"}}'), ("C@D@E.symbols.json", "{}"), ("D.symbols.json", "broken"), ("E@F.symbols.json", '{"module":{"name":"E"},"symbols":[]}')], "file string, text string")
    good, bad = graphs.read_symbol_graphs(files)
    assert [(r.culture, r.namespace) for r in good.collect()] == [("E", "F")]
    assert {r.file: r.why for r in bad.collect()} == {"A.symbols.json": "duplicate", "A@A.symbols.json": "duplicate", "B.symbols.json": "module", "C@D@E.symbols.json": "name", "D.symbols.json": "module"}
