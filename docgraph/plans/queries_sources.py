"""Queries over sources and streams; the files they read are written by Spark from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.availability import availability_labels
from docgraph.functions.storage import shared_dir, stored
from docgraph.operators import routes
from docgraph.operators.registry import module_set_members as module_sets_of
from docgraph.plans import adapters as A
from docgraph.plans.adapters import with_tables
from docgraph.plans.queries_core import KEYFRAMES
from docgraph.plans.queries_routes import PATHS
from docgraph.plans.registering import query
from docgraph.sources import graphs as G
from docgraph.sources.tables import GraphStore, HistoryStore
from docgraph.streaming.history import stream_push_history as fold_stream




#: Symbol numbers that one graph file of a module may span: files grow in number with the table, not in size.
GRAPH_SYMBOLS = 2500


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): graphs of a module and namespace, from a bounded number of its symbols and their edges each."""
    s = A.symbols(spark, sf_dir)
    kind = F.create_map(*[F.lit(x) for kv in {"protocol": "swift.protocol", "struct": "swift.struct", "typealias": "swift.typealias", "class": "swift.class", "enum": "swift.enum", "instanceProperty": "swift.property", "instanceMethod": "swift.method", "initializer": "swift.init", "func": "swift.func", "associatedtype": "swift.associatedtype"}.items() for x in kv])
    usr = lambda c: F.concat(F.lit("s:"), c.cast("string"))
    piece = lambda kind, text: F.struct(text.alias("spelling"), F.lit(kind).alias("kind"))
    bound = lambda kind, subject, target: F.struct(F.lit(kind).alias("kind"), F.lit(subject).alias("lhs"), F.concat(F.lit("P"), target.cast("string")).alias("rhs"), usr(target).alias("rhsPrecise"))
    generic = F.struct(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("index"), F.lit(0).alias("depth")) for n, i in (("U", 1), ("T", 0))]).alias("parameters"), F.array(bound("conformance", "T", F.col("namespace") * 10)).alias("constraints"))
    symbol = F.struct(
        F.struct(usr(F.col("symbol")).alias("precise")).alias("identifier"), F.array("name").alias("pathComponents"), F.struct(kind[F.col("community")].alias("identifier")).alias("kind"),
        F.struct(F.array(piece("keyword", F.col("community")), piece("text", F.lit(" ")), piece("identifier", F.col("name"))).alias("subHeading")).alias("names"),
        F.when(F.col("symbol") % 6 < 2, F.array(F.struct(F.when(F.col("symbol") % 6 == 0, "Swift").alias("domain"), (F.col("symbol") % 6 == 1).alias("isUnconditionallyDeprecated"), F.when(F.col("symbol") % 6 == 0, F.struct(F.lit(5).alias("major"), (F.col("symbol") % 9).alias("minor"))).alias("introduced")))).alias("availability"),
        F.when(F.col("symbol") % 4 == 0, generic).alias("swiftGenerics"), F.when(F.col("symbol") % 5 == 0, F.struct(F.array(bound("sameType", "Self", F.col("symbol") + 1)).alias("constraints"))).alias("swiftExtension"),
        F.struct(F.concat(F.lit("file://"), F.expr("symbol div 100").cast("string")).alias("uri"), F.struct((F.col("symbol") % 97).cast("int").alias("line"), (F.col("symbol") % 7).cast("int").alias("character")).alias("position")).alias("location"),
        F.when(F.col("symbol") % 3 == 0, F.struct(F.array(F.struct(F.col("name").alias("text")), F.struct(F.lit("second").alias("text"))).alias("lines"))).alias("docComment"),
    )
    part = F.expr(f"symbol div {GRAPH_SYMBOLS}").alias("part")
    symbols = s.groupBy("culture", part).agg(F.array_sort(F.collect_list(symbol)).alias("symbols"))
    back = F.create_map(*[F.lit(x) for a, b in G.RELATIONSHIPS.items() for x in (b, a)])
    e = A.edges(spark, sf_dir).join(s.select(F.col("symbol").alias("source"), "culture", part), "source")
    feature = F.col("relation") == "feature"
    relationship = F.struct(F.when(feature, F.concat(usr(F.col("source")), F.lit("::SYNTHESIZED::"), usr(F.col("target") + F.col("pos") % 2))).otherwise(usr(F.col("source"))).alias("source"), usr(F.col("target")).alias("target"), F.when(feature, "memberOf").otherwise(F.try_element_at(back, F.col("relation"))).alias("kind"), F.transform("constraints", lambda c: F.struct(F.when(c["verb"] == "is", "sameType").otherwise("conformance").alias("kind"), c["subject"].alias("lhs"), F.lit("P").alias("rhs"), usr(c["object"]).alias("rhsPrecise"))).alias("swiftConstraints"))
    relationships = e.groupBy("culture", "part").agg(F.collect_list(relationship).alias("relationships"))
    name = A.modules(spark, sf_dir).select(F.col("module").alias("culture"), F.translate("name", " ", "_").alias("name"))
    whole = symbols.join(relationships, ["culture", "part"], "left").join(name, "culture")
    text = F.to_json(F.struct(F.struct(F.when(F.col("culture") == 3, "other").otherwise(F.col("name")).alias("name")).alias("module"), "symbols", F.coalesce("relationships", F.array()).alias("relationships")))
    return whole.select(F.concat("name", F.when(F.col("culture") == 4, "@a").otherwise(""), F.lit("@n"), F.col("part").cast("string"), F.lit(".symbols.json")).alias("file"), text.alias("text"))


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return G.read_symbol_graphs(_graph_files(spark, sf_dir))


_NAMED = "g AS (SELECT s.*, replace(m.name, ' ', '_') AS module_name FROM symbols s JOIN modules m ON m.module = s.culture WHERE s.culture NOT IN (3, 4))"


@query(with_tables("symbols", "modules", then="c AS (SELECT DISTINCT culture, symbol // 2500 AS part FROM symbols) SELECT replace(m.name, ' ', '_') || CASE WHEN culture = 4 THEN '@a' ELSE '' END || '@n' || part AS file, CASE culture WHEN 3 THEN 'module' WHEN 4 THEN 'name' ELSE 'ok' END AS why FROM c JOIN modules m ON m.module = c.culture"))
def read_symbol_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = _graphs(spark, sf_dir)
    return good.select(F.concat_ws("@", "culture", "namespace").alias("file"), F.lit("ok").alias("why")).unionByName(bad.select(F.regexp_replace("file", r"\.symbols\.json$", "").alias("file"), "why"))


def _written(constraints: str) -> Column:
    return F.array_join(F.transform(constraints, lambda c: F.concat_ws(":", c["subject"], c["verb"], c["object"])), ";").alias(constraints)


@query(with_tables("symbols", "modules", then=_NAMED + """ SELECT module_name AS culture, 's:' || symbol AS id, name AS path, community, 'file://' || (symbol // 100) AS uri, (symbol % 97)::INT AS line, CASE WHEN symbol % 3 = 0 THEN name || chr(10) || 'second' END AS comment,
 'keywordText:' || community || '|text: |identifier:' || name AS signature, CASE WHEN symbol % 4 = 0 THEN 'T,U' ELSE '' END AS generics, CASE WHEN symbol % 4 = 0 THEN 'T:conforms:s:' || namespace * 10 ELSE '' END AS constraints,
 CASE WHEN symbol % 5 = 0 THEN 'Self:is:s:' || (symbol + 1) ELSE '' END AS extension_constraints,
 CASE symbol % 6 WHEN 0 THEN 'Available since 5.' || symbol % 9 WHEN 1 THEN 'Deprecated' ELSE '' END AS availability FROM g"""))
def read_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    signature = F.array_join(F.transform("signature", lambda f: F.concat(f["color"], F.lit(":"), f["text"])), "|").alias("signature")
    return G.read_symbols(_graphs(spark, sf_dir)[0]).select("culture", "id", F.array_join("path", ".").alias("path"), "community", "uri", "line", "comment", signature, F.array_join("generics", ",").alias("generics"), _written("constraints"), _written("extension_constraints"), F.array_join(availability_labels(F.col("availability")), ",").alias("availability"))


@query(with_tables("symbols", "modules", "edges", then="""e2 AS (SELECT m.name, e.*, relation = 'feature' AND pos % 2 = 1 AS odd FROM edges e JOIN symbols s ON s.symbol = e.source JOIN modules m ON m.module = s.culture WHERE s.culture NOT IN (3, 4))
 SELECT replace(name, ' ', '_') AS culture, 's:' || source AS source, CASE WHEN NOT odd THEN relation END AS relation, 's:' || target AS target, CASE WHEN odd THEN 'synthesized' END AS why,
   CASE WHEN cx IS NULL THEN '' ELSE 'Self:conforms:s:' || cx || CASE WHEN cy IS NULL THEN '' ELSE ';Element:is:s:' || cy END END AS constraints FROM e2"""))
def read_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.read_relationships(_graphs(spark, sf_dir)[0]).select("culture", "source", "relation", "target", "why", _written("constraints"))


@query(with_tables("symbols", "modules", then=_NAMED + " SELECT 'file://' || (symbol // 100) AS uri, string_agg('s:' || symbol, ',' ORDER BY symbol % 97, symbol % 7, 's:' || symbol) AS features FROM g GROUP BY symbol // 100"))
def source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.source_map(G.read_symbols(_graphs(spark, sf_dir)[0])).select("uri", F.array_join(F.transform("features", lambda f: f["id"]), ",").alias("features"))


@query("""SELECT o_custkey AS customer, 'dep' || (o_orderkey % 5) AS package, arg_max(CASE o_orderkey % 4 WHEN 0 THEN '1.' || (o_orderkey % 50) || '.0' WHEN 1 THEN '5.' || (o_orderkey % 9) WHEN 2 THEN 'none' ELSE '5.' || (o_orderkey % 7) || '.1' END, o_orderkey) AS version FROM orders GROUP BY ALL HAVING version <> 'none'""")
def read_package_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    state = F.struct(F.when(k % 4 == 0, F.concat(F.lit("1."), k % 50, F.lit(".0"))).alias("version"), F.when(k % 4 == 1, F.concat(F.lit("5."), k % 9)).when(k % 4 == 2, "main").when(k % 4 == 3, F.concat(F.lit("swift-5."), k % 7, F.lit(".1-RELEASE"))).alias("branch"))
    pin = F.struct(k.alias("_k"), F.concat(F.lit("Dep"), k % 5).alias("identity"), state.alias("state"))
    files = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(pin)).alias("pins")).select(F.col("o_custkey").cast("string").alias("file"), F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct(F.lit(2).alias("version"), "pins"))).otherwise(F.to_json(F.struct(F.lit(1).alias("version"), F.struct(F.transform("pins", lambda p: F.struct(p["identity"].alias("package"), p["state"].alias("state"))).alias("pins")).alias("object")))).alias("text"))
    return G.read_package_resolved(files).select(F.col("file").cast("bigint").alias("customer"), "package", "version")


@query("""WITH rows AS (SELECT s_nationkey AS n, s_suppkey AS s FROM supplier)
 SELECT 'p' || s AS package, CASE WHEN s % 2 = 0 THEN 'brand ' || n END AS brand, 'module' AS kind, 'm' || n AS name, NULL AS source, CASE WHEN s % 3 > 0 THEN 'core' END AS dep_package, CASE WHEN s % 3 > 0 THEN 'd' || k END AS dep_module, NULL AS why
   FROM rows, (SELECT unnest(range(2)) AS k) WHERE s % 7 > 0 AND CASE WHEN s % 3 = 0 THEN k = 0 ELSE k < s % 3 END
 UNION ALL SELECT 'p' || s, CASE WHEN s % 2 = 0 THEN 'brand ' || n END, 'snippet', 'S' || s, 'S' || s || '.swift', NULL, NULL, NULL FROM rows WHERE s % 7 > 0 AND s % 5 = 0
 UNION ALL SELECT 'p' || s, CASE WHEN s % 2 = 0 THEN 'brand ' || n END, NULL, NULL, NULL, NULL, NULL, 'tools_version' FROM rows WHERE s % 7 = 0""")
def read_package_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog for each supplier; some of another tools version, some with a snippet."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    deps = F.when(s % 3 > 0, F.array(F.struct(F.lit("core").alias("package"), F.transform(F.sequence(F.lit(1), (s % 3).cast("int")), lambda k: F.concat(F.lit("d"), (k - 1).cast("string"))).alias("modules"))))
    mods = F.array(F.struct(F.concat(F.lit("m"), n.cast("string")).alias("module"), deps.alias("dependencies")))
    title = F.concat(F.lit("S"), s.cast("string"))
    snippets = F.when(s % 5 == 0, F.array(F.struct(title.alias("snippet"), F.array(F.concat(title, F.lit(".swift"))).alias("sources"), F.array().alias("dependencies"))))
    one = F.struct(F.when(s % 7 == 0, 2).otherwise(3).alias("catalog_tools_version"), F.concat(F.lit("p"), s.cast("string")).alias("package"), F.when(s % 2 == 0, F.concat(F.lit("brand "), n.cast("string"))).alias("brand"), mods.alias("modules"), snippets.alias("snippets"))
    files = A.table(spark, sf_dir, "supplier").select(F.to_json(F.array(one)).alias("text"))
    return G.read_package_catalog(files).select("package", "brand", "kind", "name", F.array_join("sources", ",").alias("source"), "dep_package", "dep_module", "why")


@query("""SELECT DISTINCT dir, version FROM (SELECT unnest(['swift-5.' || (s_suppkey % 9) || '-RELEASE', '5.' || (s_suppkey % 4) || '.2', 'x' || s_suppkey]) AS dir, unnest(['5.' || (s_suppkey % 9), '5.' || (s_suppkey % 4) || '.2', NULL]) AS version FROM supplier) WHERE version LIKE '5.3%'""")
def list_toolchains(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.table(spark, sf_dir, "supplier").select(F.expr("concat('swift-5.', s_suppkey % 9, '-RELEASE\n 5.', s_suppkey % 4, '.2\tx', s_suppkey)").alias("text"))
    return G.list_toolchains(files, "5.3")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'moved/' || doc_id ELSE 'Doc-' || doc_id || '-of-' || lang END AS name, length(text) AS length FROM documents")
def read_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    files = d.select(F.concat(F.lit("Doc "), "doc_id", F.lit(" of "), "lang", F.lit(".md")).alias("file"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("@path(old)\n@path(moved/"), "doc_id", F.lit(")\n"), "text")).otherwise(F.col("text")).alias("text"))
    return G.read_articles(files).select("name", F.length(F.regexp_replace("text", r"^@path\(old\)\n@path\([^)]*\)\n", "")).cast("bigint").alias("length"))


#: Every namespace is a package of two versions; the second has two symbols of three.
_COMPILED = """v AS (SELECT s.*, unnest(CASE WHEN symbol % 3 = 0 THEN ['1.0'] ELSE ['1.0', '1.1'] END) AS version FROM symbols s),
 rows AS (SELECT 'vertex' AS kind, namespace AS package, version, symbol AS a, name AS b FROM v
   UNION ALL SELECT 'edge', namespace, version, e.source, e.relation || ' ' || e.target || ' ' || e.pos FROM v JOIN edges e ON e.source = v.symbol)"""


def _compile(spark: SparkSession, sf_dir: str, packages: DataFrame) -> dict[str, DataFrame]:
    """The vertices and edges of packages (package, version)."""
    version = F.explode(F.when(F.col("symbol") % 3 == 0, F.array(F.lit("1.0"))).otherwise(F.array(F.lit("1.0"), F.lit("1.1"))))
    vertices = A.symbols(spark, sf_dir).select("symbol", "name", F.col("namespace").alias("package"), version.alias("version")).join(packages, ["package", "version"], "left_semi")
    edges = A.edges(spark, sf_dir).drop("constraints").join(vertices.select(F.col("symbol").alias("source"), "package", "version"), "source")
    return {"vertices": vertices, "edges": edges}


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.symbols(spark, sf_dir).select(F.col("namespace").alias("package")).distinct().select("package", F.explode(F.array(F.lit("1.0"), F.lit("1.1"))).alias("version"))


@query(with_tables("symbols", "edges", then=_COMPILED + " SELECT kind, package, version, count(*) AS rows, package % 2 = 0 AND version = '1.0' AS before FROM rows GROUP BY kind, package, version"))
def write_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the packages compiled first, then what is missing; ``before`` tells which were there after the first commit."""
    store = GraphStore(spark, _folder(spark, "graphs"))
    wanted = _wanted(spark, sf_dir)
    store.ensure(wanted.filter("package % 2 = 0 and version = '1.0'"), lambda p: _compile(spark, sf_dir, p))
    first = store.compiled().withColumn("before", F.lit(True)).drop("piece")
    store.ensure(wanted, lambda p: _compile(spark, sf_dir, p))
    rows = store.read("vertices").select(F.lit("vertex").alias("kind"), "package", "version").unionByName(store.read("edges").select(F.lit("edge").alias("kind"), "package", "version"))
    return rows.groupBy("kind", "package", "version").agg(F.count(F.lit(1)).alias("rows")).join(first, ["package", "version"], "left").withColumn("before", F.coalesce("before", F.lit(False)))


@query(with_tables("symbols", "edges", then=_COMPILED + " SELECT kind, package, version, a, b FROM rows"))
def read_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packages compiled, some of them again, and read back."""
    store = GraphStore(spark, _folder(spark, "graphs"))
    wanted = _wanted(spark, sf_dir)
    store.ensure(wanted, lambda p: _compile(spark, sf_dir, p))
    again = wanted.filter("package % 5 = 0")
    store.write(_compile(spark, sf_dir, again), again)
    vertices = store.read("vertices").select(F.lit("vertex").alias("kind"), "package", "version", F.col("symbol").alias("a"), F.col("name").alias("b"))
    return vertices.unionByName(store.read("edges").select(F.lit("edge").alias("kind"), "package", "version", F.col("source").alias("a"), F.concat_ws(" ", "relation", "target", "pos").alias("b")))


@query(with_tables("observations", then=KEYFRAMES + " SELECT entity, lo, hi, value FROM keyframes"))
def merge_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations pushed a few versions at a time into a stored history."""
    store = HistoryStore(spark, _folder(spark, "history"), ["entity"])
    seen = A.observations(spark, sf_dir)
    for a, b in ((0, 5), (5, 6), (6, 7), (7, 18), (18, 1000)):
        store.push(seen.filter((F.col("ver") >= a) & (F.col("ver") < b)))
    return store.keyframes().select("entity", "lo", "hi", "value")


@query(with_tables("modules", "module_deps", "symbols", then=PATHS + """, sets AS (SELECT culture AS module, 'toplevel' AS kind, symbol AS member FROM paths WHERE len(path) = 1
   UNION SELECT module, 'dependency', dep FROM module_deps UNION SELECT doc_id % 25, 'guide', doc_id FROM documents),
 held_at AS (SELECT DISTINCT module, kind, member, v FROM sets, (SELECT unnest(range(12)) AS v) WHERE (member * 7 + v // 3 * 5) % 4 > 0)
 SELECT module::INT AS module, kind, member::BIGINT AS member, min(v)::INT AS lo, max(v)::INT AS hi FROM (SELECT *, v - row_number() OVER (PARTITION BY module, kind, member ORDER BY v) AS island FROM held_at) GROUP BY module, kind, member, island"""))
def module_set_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs to each module over twelve versions, pushed in three steps; a member comes and goes every three versions."""
    articles = A.table(spark, sf_dir, "documents").select((F.col("doc_id") % 25).cast("int").alias("culture"), F.col("doc_id").alias("article"))
    members = module_sets_of(routes.symbol_paths(A.symbols(spark, sf_dir)), A.module_deps(spark, sf_dir), articles)
    at = stored(members, "members").select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("ver")).filter("(member * 7 + ver div 3 * 5) % 4 > 0").withColumn("value", F.lit(True))
    store = HistoryStore(spark, _folder(spark, "sets"), ["module", "kind", "member"])
    for a, b in ((0, 4), (5, 7), (8, 11)):
        store.push(at.filter(F.col("ver").between(a, b)))
    return store.keyframes().drop("value")


@query(with_tables("observations", then=KEYFRAMES + " SELECT entity, lo, hi, value FROM keyframes"))
def stream_push_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of days that arrive one after another, and a last one that closes every entity's open keyframe.

    A slice has as many files as it needs; the stream takes up what has arrived and keeps its state between."""
    base, last = _folder(spark, "stream"), 1_000_000
    seen = A.observations(spark, sf_dir)
    slices = [seen.filter(days) for days in ("ver < 10", "ver >= 10 AND ver < 20", "ver >= 20")]
    slices.append(seen.select("entity").distinct().select("entity", F.lit(last).alias("ver"), F.lit(None).cast("string").alias("value")))
    for i, rows in enumerate(slices):
        rows.write.parquet(f"{base}/in/{i}")
        arrived = spark.readStream.schema("entity bigint, ver int, value string").parquet(f"{base}/in/*")
        out = fold_stream(arrived).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
    return spark.read.schema("entity bigint, lo int, hi int, value string, late boolean").parquet(f"{base}/out").filter((F.col("hi") < last) & ~F.col("late")).select("entity", "lo", "hi", "value")
