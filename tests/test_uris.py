"""URIs at versions: every composite's leads back to it; moves, old versions and canonical URIs on made cases."""

from pyspark.sql import functions as F

from docgraph.functions import versions as V
from docgraph.functions.storage import stored
from docgraph.operators import composites, uris
from docgraph.plans import adapters as A
from docgraph.plans import queries_requests as Q


def test_composites_come_back_from_their_uris(spark, sf_dir):
    eco = Q.ecosystem(spark, sf_dir)
    depths = stored(composites.overload_spans(Q._lensed(spark, sf_dir)), "depths")
    masks = V.abbreviate_version(A.versions(spark, sf_dir))
    book = uris.Book(eco, masks, Q._moves(eco), depths, stored(Q._symbol_names(spark, sf_dir), "names"))
    at = depths.select("package", *composites.COMPOSITE, F.explode(F.array(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("ver")).distinct()
    key = F.concat_ws("-", "package", *composites.COMPOSITE, "ver")
    asked = stored(uris.composite_uris(at.withColumn("exhibit", F.lit(None).cast("int")), book).withColumn("request", key), "asked")
    log = asked.select("request", F.transform(F.split(F.substring("path", F.lit(2), F.length("path")), "/"), F.url_decode).alias("path"), "params")
    back = {r.request: r for r in uris.respond(log, book).collect()}
    found = {r.request: r for r in Q.requests.resolve_requests(log, eco).collect()}
    rows = asked.collect()
    assert len(rows) > 500 and len(back) == len(rows)
    latest = {r.package: r.ver for r in eco.index.filter("mask is null").collect()}
    for r in rows:
        got = found[r.request]
        # a version that can be written only by a longer mask leads to itself as well
        assert (got.kind, got.package, got.ver, got.base, got.host, got.culture) == ("symbol", r.package, r.ver, r.base, r.host, r.culture), (r, got)
        assert back[r.request].response == "match", (r, back[r.request])
        natural = r.base == r.host
        assert (back[r.request].canonical is None) == (natural and r.ver == latest[r.package])
    assert {p.key for r in rows for p in r.params} >= {"from"}


def test_moves_and_old_versions(spark):
    frame = spark.createDataFrame
    packages = frame([(0, "swift", 0), (2, "my-lib", 2)], "package int, name string, rank int")
    modules = frame([(0, 0, "Std"), (2, 2, "Lib")], "module int, package int, name string")
    masks = frame([(p, v, f"semantic:{v}" if v < 2 else None) for p in (0, 2) for v in (0, 1, 2)], "package int, ver int, mask string")
    index = frame([(p, m, v) for p in (0, 2) for m, v in (("semantic:0", 0), ("semantic:1", 1), ("semantic:2", 2), (None, 2))], "package int, mask string, ver int")
    articles = frame([(70, 2, "Getting Started/More")], "article bigint, module int, name string")
    none = frame([], "namespace int, stem string, leaf string, orientation string, base bigint, host bigint, culture int, lo bigint, hi bigint")
    symbols = frame([], "symbol bigint, id string, community string, package int, module int")
    eco = Q.requests.Ecosystem(packages, index, modules, articles, composites.grouped(none, modules), symbols, frame([("sitemap", 2)], "kind string, package int"), ["my-lib"])
    moves = frame([("module", 2, "/old", 0), ("module", 2, "/new", 1), ("article", 2, "/guides", 1), ("module", 0, "/standard", 2)], "kind string, module int, uri string, ver int")
    depths = composites.overload_spans(none.withColumn("package", F.lit(2)))
    book = uris.Book(eco, masks, moves, depths, frame([], "symbol bigint, module int, namespace int, path array<string>, dotted boolean"))
    cases = {
        "reference/my-lib": ("/reference/my-lib", None, "match"),
        "reference/my-lib/2": ("/reference/my-lib", None, "permanent"),
        "reference/my-lib/1": ("/reference/my-lib/1", "/reference/my-lib", "match"),
        "reference/my-lib/0/lib": ("/reference/my-lib/0/lib", "/reference/my-lib/lib", "match"),  # only the last move counts
        "reference/my-lib/1/lib": ("/new", "/reference/my-lib/lib", "permanent"),
        "new": ("/new", "/reference/my-lib/lib", "match"),
        "old": ("/reference/my-lib/0/lib", "/reference/my-lib/lib", "permanent"),
        "reference/std": ("/standard", None, "permanent"),
        "standard": ("/standard", None, "match"),
        "reference/swift/1/std": ("/reference/1/std", "/standard", "permanent"),
        "learn/my-lib/lib/getting started/more": ("/learn/my-lib/lib/getting%20started/more", None, "match"),
        "learn/my-lib/1/lib/getting started/more": ("/guides/getting%20started/more", "/learn/my-lib/lib/getting%20started/more", "permanent"),
        "guides/getting started/more": ("/guides/getting%20started/more", "/learn/my-lib/lib/getting%20started/more", "match"),
        "guides": (None, None, "none"),
        "sitemaps/my-lib.txt": (None, None, "match"),
    }
    log = frame([(c, c.split("/"), None) for c in cases] + [("null", None, None)], "request string, path array<string>, params array<struct<key:string,value:string>>")
    got = {r.request: (r.uri, r.canonical, r.response) for r in uris.respond(log, book).collect()}
    assert got.pop("null") == (None, None, "none")
    assert got == cases
