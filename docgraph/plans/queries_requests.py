"""Queries over composites that come and go with the versions, and over requests for them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import versions as V
from docgraph.functions.identity import KINDS
from docgraph.functions.storage import shared_dir, stored
from docgraph.operators import composites, links, requests, uris
from docgraph.plans import adapters as A
from docgraph.plans.adapters import with_tables
from docgraph.plans.queries_core import _FACT_TABLES, _MASKS, PINS, _pins, _scopes
from docgraph.plans.queries_routes import ALL_ROUTES, _paths, _routes
from docgraph.plans.registering import query

#: The packages that are searched where a path names none of them.
WHITELIST = ["asia", "swift", "middle-east", "core"]
ROUTE = ", ".join(composites.ROUTE)

#: Up to three stretches of versions for a natural composite, two for an inherited one; an end before its start is none.
HELD = """held AS (SELECT * FROM (SELECT namespace, stem, leaf, orientation, base, host, culture, s.lo AS lo, s.hi AS hi FROM (SELECT *, unnest(CASE WHEN base = host THEN
   [{'lo': base % 7, 'hi': 12 + base % 9}, {'lo': 13 + base % 9 + base % 4, 'hi': CASE WHEN base % 3 = 0 THEN least(29, 13 + base % 9 + base % 4 + base % 11) ELSE -1 END}, {'lo': 22, 'hi': CASE WHEN base % 3 <> 0 AND base % 5 <> 0 THEN 29 ELSE -1 END}]
   ELSE [{'lo': (host + base) % 11, 'hi': least(29, (host + base) % 11 + 3 + base % 13)}, {'lo': (host + base) % 11 + 5 + base % 13, 'hi': CASE WHEN (host + base) % 2 = 0 THEN 29 ELSE -1 END}] END) AS s FROM every)) WHERE lo <= hi)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route, base, host, culture, lo, hi), repeated where a route is."""
    b, x = F.col("base"), F.col("host") + F.col("base")
    span = lambda lo, hi: F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    own = F.array(
        span(b % 7, 12 + b % 9),
        span(13 + b % 9 + b % 4, F.when(b % 3 == 0, F.least(F.lit(29), 13 + b % 9 + b % 4 + b % 11)).otherwise(-1)),
        span(F.lit(22), F.when((b % 3 != 0) & (b % 5 != 0), 29).otherwise(-1)),
    )
    inherited = F.array(span(x % 11, F.least(F.lit(29), x % 11 + 3 + b % 13)), span(x % 11 + 5 + b % 13, F.when(x % 2 == 0, 29).otherwise(-1)))
    rows = _routes(spark, sf_dir).withColumn("s", F.explode(F.when(b == F.col("host"), own).otherwise(inherited)))
    return rows.select(*composites.ROUTE, *composites.COMPOSITE, "s.lo", "s.hi").filter("lo <= hi")


def _lensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held composites, each once, with the package in whose groups they are."""
    held = stored(_held(spark, sf_dir).groupBy(*composites.ROUTE, *composites.COMPOSITE, "lo").agg(F.max("hi").alias("hi")), "held")
    return held.join(A.modules(spark, sf_dir).select(F.col("module").alias("culture"), "package"), "culture")


_POINTS = "points AS (SELECT package, namespace, stem, leaf, orientation, base, host, culture, unnest(range(lo, hi + 1)) AS ver FROM held JOIN modules ON module = culture), at_once AS (SELECT DISTINCT * FROM points)"
_ISLANDS = "SELECT base, host, culture, min(ver) AS lo, max(ver) AS hi FROM (SELECT *, ver - row_number() OVER (PARTITION BY base, host, culture ORDER BY ver) AS island FROM (SELECT DISTINCT base, host, culture, ver FROM {0})) GROUP BY base, host, culture, island"


@query(with_tables(*_FACT_TABLES, then=ALL_ROUTES + """, features AS (SELECT DISTINCT base, host, e.culture, e.culture = h.culture AS own, a.package = b.package AS same FROM every e JOIN symbols h ON h.symbol = e.host JOIN modules a ON a.module = e.culture JOIN modules b ON b.module = h.culture WHERE base <> host),
 there AS (SELECT base, host, culture, unnest(range((host + base) % 5, (host + base) % 5 + 4)) + CASE WHEN own THEN 0 WHEN same THEN 7 ELSE 15 END + n * 6 AS ver FROM features, (SELECT unnest([0, 1]) AS n)
   UNION ALL SELECT DISTINCT base, host, culture, unnest(list_concat(range(base % 9, base % 9 + 6), range(base % 9 + 6 + base % 2, 20))) FROM every WHERE base = host) """ + _ISLANDS.format("there")))
def composite_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts hold their features in two keyframes of each belief, at versions of its own; natural ones in two, half of which touch."""
    asked = stored(_routes(spark, sf_dir).select(*composites.COMPOSITE).distinct(), "asked")
    symbols = A.symbols(spark, sf_dir)
    x, s = F.col("host") + F.col("base"), F.col("symbol")
    beliefs = F.array(*[F.struct(F.lit(b).alias("belief"), F.lit(k).alias("k")) for b, k in (("primary", 0), ("accepted", 7), ("opinion", 15))])
    features = asked.filter("base <> host").select("*", F.explode(beliefs).alias("b"), F.lit(0).alias("_"))
    features = features.select("host", "base", "culture", "b.belief", F.explode(F.array(x % 5 + F.col("b.k"), x % 5 + F.col("b.k") + 6)).alias("lo")).withColumn("hi", F.col("lo") + 3)
    natural = symbols.select("symbol", F.explode(F.array(F.struct((s % 9).alias("lo"), (s % 9 + 5).alias("hi")), F.struct((s % 9 + 6 + s % 2).alias("lo"), F.lit(19).cast("bigint").alias("hi")))).alias("k")).select("symbol", "k.lo", "k.hi")
    return composites.composite_spans(asked, natural, features, symbols.select("symbol", "culture"), A.modules(spark, sf_dir))


@query(with_tables(*_FACT_TABLES, then=ALL_ROUTES + ", " + HELD + ", " + _POINTS + f""", told AS (SELECT *, count(*) OVER (PARTITION BY package, {ROUTE}, ver) AS r, count(*) OVER (PARTITION BY package, {ROUTE}, base, ver) AS b FROM at_once),
 flagged AS (SELECT *, r > b OR b > 1 AS need_base, b > 1 AS need_host FROM told),
 islands AS (SELECT *, ver - row_number() OVER (PARTITION BY {ROUTE}, base, host, culture, need_base, need_host ORDER BY ver) AS island FROM flagged)
 SELECT base, host, culture, need_base, need_host, min(ver) AS lo, max(ver) AS hi FROM islands GROUP BY {ROUTE}, base, host, culture, need_base, need_host, island"""))
def overload_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.overload_spans(_lensed(spark, sf_dir)).select(*composites.COMPOSITE, "need_base", "need_host", "lo", "hi")


def ecosystem(spark: SparkSession, sf_dir: str) -> requests.Ecosystem:
    """Symbols have the ids s0, s1 ...; every document is an article of its own name; some packages have resources."""
    modules, packages = A.modules(spark, sf_dir), A.packages(spark, sf_dir)
    groups = composites.grouped(_held(spark, sf_dir), modules)
    at = modules.select(F.col("module").alias("culture"), "package")
    symbols = A.symbols(spark, sf_dir).join(at, "culture").select("symbol", F.concat(F.lit("s"), F.col("symbol")).alias("id"), "community", "package", F.col("culture").alias("module"))
    articles = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article"), (F.col("doc_id") % 25).cast("int").alias("module"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("name"))
    kind = F.explode(F.array_compact(F.array(F.when(F.col("package") % 2 == 0, "sitemap"), F.when(F.col("package") % 3 != 0, "search"))))
    return requests.Ecosystem(packages, stored(V.version_index(A.versions(spark, sf_dir)), "index"), modules, articles, stored(groups, "groups"), stored(symbols, "symbols"), packages.select("package", kind.alias("kind")), WHITELIST)


def _mask(package: Column, one: Column, two: Column) -> Column:
    """A version as it is written in a path: a day of the standard library, a minor version of the others."""
    return F.when(package == 0, F.concat(F.lit("2024-1-"), one % 31 + 1)).otherwise(F.concat((one % 3).cast("string"), F.lit("."), (two % 3).cast("string")))


def request_log(spark: SparkSession, sf_dir: str, eco: requests.Ecosystem) -> DataFrame:
    """(request, path, params): for every composite one of ten ways to ask, for every document its article."""
    owners = eco.modules.join(eco.packages.withColumnRenamed("name", "pname"), "package").select(F.col("module").alias("namespace"), "package", "pname", "rank", F.lower("name").alias("mname"))
    lenses = owners.select(F.col("namespace").alias("culture"), F.col("package").alias("lens"), F.col("pname").alias("lens_name"))
    kinds = F.create_map(*[F.lit(x) for k, c in KINDS.items() for x in (c, k)])
    named = A.symbols(spark, sf_dir).select(F.col("symbol").alias("base"), F.element_at(kinds, F.col("community")).alias("kind"))
    b, h = F.col("base"), F.col("host")
    c = eco.groups.drop("package", "spans", "newest").join(owners, "namespace").join(lenses, "culture").join(named, "base").withColumn("v", (b * 7 + h * 3 + F.col("culture")) % 10)
    v = F.col("v")
    stem = F.when(F.col("stem") == "", F.array().cast("array<string>")).otherwise(F.split("stem", "\t"))
    leaf = F.when(v == 9, F.concat("leaf", F.lit("-"), "kind")).otherwise(F.col("leaf"))
    dotted = (F.col("orientation") == ".") & (v != 4)
    top = F.size(stem) == 0
    tail = F.when(dotted & top, F.array(F.concat(F.lit("."), leaf))).when(dotted, F.concat(F.slice(stem, F.lit(1), F.size(stem) - 1), F.array(F.concat(F.element_at(stem, -1), F.lit("."), leaf)))).otherwise(F.concat(stem, F.array(leaf)))
    mask = _mask(F.col("package"), b, h)
    dated = v.isin(1, 2) | (v.isin(6, 7) & (b % 2 == 0))
    wrong = (v == 8) & (b % 4 == 0)
    root = F.when(v == 5, "Learn").when((v == 8) & (b % 4 == 2), "docs").otherwise("Reference")
    shown = (F.col("rank") == 2) | (b % 2 == 0) | v.isin(7, 8)
    head = F.array_compact(F.array(root, F.when(wrong, "nowhere").when(shown, F.upper("pname")), F.when(dated, mask), F.when((v == 8) & (b % 4 == 1), "nomodule").when(v != 7, F.col("mname"))))
    by_id = (v == 8) & (b % 4 == 3)
    path = F.when(by_id, F.array(root)).when(v.isin(6, 7), head).otherwise(F.concat(head, tail))
    param = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    sid = lambda n: F.concat(F.lit("s"), n)
    params = F.array_compact(F.array(
        F.when(v == 3, param("from", F.concat("lens_name", F.when(b % 2 == 0, F.concat(F.lit("/"), _mask(F.col("lens"), b, h))).otherwise("")))),
        F.when(by_id | ((v == 4) & (b % 4 == 1)), param("overload", sid(b))),
        F.when(by_id, param("self", sid(h))),
    ))
    symbols = c.select(F.concat(F.lit("s"), b, F.lit("-"), h, F.lit("-"), F.col("culture")).alias("request"), path.alias("path"), params.alias("params"))
    a = F.col("article")
    docs = eco.articles.join(owners.withColumnRenamed("namespace", "module"), "module")
    docs = docs.select(F.concat(F.lit("a"), a).alias("request"), F.array_compact(F.array(F.lit("learn"), F.when(F.col("rank") == 2, F.col("pname")), F.when(a % 3 == 0, _mask(F.col("package"), a, a)), F.col("mname"), F.when(a % 7 == 0, "doc-none").otherwise(F.col("name")))).alias("path"), F.array().cast(symbols.schema["params"].dataType).alias("params"))
    p = eco.packages
    none = F.array().cast(symbols.schema["params"].dataType).alias("params")
    maps = p.select(F.concat(F.lit("m"), F.col("package")).alias("request"), F.array(F.lit("sitemaps"), F.concat("name", F.lit(".txt"))).alias("path"), none)
    search = p.select(F.concat(F.lit("q"), F.col("package")).alias("request"), F.array(F.lit("lunr"), F.col("name"), F.lit("types")).alias("path"), none)
    return symbols.unionByName(docs).unionByName(maps).unionByName(search)


_CASES = HELD + """, standing AS (SELECT m.package, h.* FROM held h JOIN modules m ON m.module = h.culture),
 mv AS (SELECT package, CASE WHEN package = 0 THEN 'd' || c ELSE 's' || a || '.' || b END AS mk, max(ver) AS ver FROM versions GROUP BY 1, 2),
 comps AS (SELECT DISTINCT e.namespace, e.stem, e.leaf, e.orientation, e.base, e.host, e.culture, n.package AS p, l.package AS lens, y.community, (e.base * 7 + e.host * 3 + e.culture) % 10 AS v, e.base % 4 AS f,
   CASE WHEN n.package = 0 THEN 'd' || (e.base % 31 + 1) ELSE 's' || e.base % 3 || '.' || e.host % 3 END AS mk, CASE WHEN l.package = 0 THEN 'd' || (e.base % 31 + 1) ELSE 's' || e.base % 3 || '.' || e.host % 3 END AS lmk
   FROM held e JOIN modules n ON n.module = e.namespace JOIN modules l ON l.module = e.culture JOIN symbols y ON y.symbol = e.base),
 req AS (SELECT c.*, 's' || base || '-' || host || '-' || culture AS request, CASE WHEN v IN (1, 2) OR (v IN (6, 7) AND base % 2 = 0) THEN mv.ver ELSE 29 END AS ver, CASE WHEN base % 2 = 0 THEN ml.ver ELSE 29 END AS lens_ver
   FROM comps c LEFT JOIN mv ON mv.package = p AND mv.mk = c.mk LEFT JOIN mv ml ON ml.package = lens AND ml.mk = lmk),
 asks AS (SELECT request, v = 5 AS learn, v = 3 AS lensed, CASE WHEN v = 3 THEN lens ELSE p END AS package, CASE WHEN v = 3 THEN lens_ver ELSE ver END AS ver, p AS home, namespace, stem, leaf, CASE WHEN v = 4 THEN '/' ELSE orientation END AS orientation,
   CASE WHEN v = 4 AND f = 1 THEN base END AS base_id, CASE WHEN v = 9 THEN community END AS community FROM req WHERE v IN (0, 1, 2, 3, 4, 5, 9)),
 met AS (SELECT a.request, a.ver, g.orientation <> a.orientation AS redirected, a.ver BETWEEN g.lo AND g.hi AS now, g.hi, g.base, g.host, g.culture FROM asks a JOIN standing g ON g.package = a.package AND g.namespace = a.namespace AND g.stem = a.stem AND g.leaf = a.leaf
   AND (a.orientation = '/' OR g.orientation = '.') JOIN symbols y ON y.symbol = g.base WHERE a.ver IS NOT NULL AND (a.base_id IS NULL OR a.base_id = g.base) AND (a.community IS NULL OR a.community = y.community)),
 counted AS (SELECT request, redirected, any_value(ver) AS asked, count(DISTINCT (base, host, culture)) FILTER (WHERE now) AS n, min((base, host, culture)) FILTER (WHERE now) AS c, count(DISTINCT (base, host, culture)) AS n_all, min((base, host, culture)) AS c_all, max(hi) AS newest FROM met GROUP BY request, redirected),
 sel AS (SELECT request, n, c, asked AS ver, NULL::BIGINT AS exhibit, redirected FROM counted WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY request ORDER BY redirected) = 1),
 past AS (SELECT * FROM (SELECT request, n_all AS n, c_all AS c, newest AS ver, asked AS exhibit, redirected FROM counted WHERE request NOT IN (SELECT request FROM sel) QUALIFY row_number() OVER (PARTITION BY request ORDER BY redirected) = 1) WHERE n = 1),
 shown AS (SELECT * FROM sel UNION ALL SELECT * FROM past),
 places AS (SELECT package, list_position(['asia', 'swift', 'middle-east', 'core'], name) AS position FROM packages WHERE name IN ('asia', 'swift', 'middle-east', 'core')),
 old AS (SELECT a.request, q.package, q.position, g.orientation <> a.orientation AS redirected, count(DISTINCT (g.base, g.host, g.culture)) AS n, min((g.base, g.host, g.culture)) AS c FROM asks a JOIN places q ON q.package <> a.home
   JOIN standing g ON g.package = q.package AND g.namespace = a.namespace AND g.stem = a.stem AND g.leaf = a.leaf AND (a.orientation = '/' OR g.orientation = '.') AND 29 BETWEEN g.lo AND g.hi JOIN symbols y ON y.symbol = g.base
   WHERE NOT a.learn AND NOT a.lensed AND a.request NOT IN (SELECT request FROM shown) AND (a.base_id IS NULL OR a.base_id = g.base) AND (a.community IS NULL OR a.community = y.community) GROUP BY 1, 2, 3, 4),
 legacy AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY request ORDER BY position, redirected) = 1),
 home AS (SELECT y.symbol, y.culture, m.package FROM symbols y JOIN modules m ON m.module = y.culture JOIN places USING (package)),
 doc AS (SELECT 'a' || doc_id AS request, doc_id, (doc_id % 25)::INT AS module, m.package AS p, CASE WHEN doc_id % 3 = 0 THEN mv.ver ELSE 29 END AS ver FROM documents JOIN modules m ON m.module = doc_id % 25 LEFT JOIN mv ON mv.package = m.package AND mv.mk = CASE WHEN m.package = 0 THEN 'd' || (doc_id % 31 + 1) ELSE 's' || doc_id % 3 || '.' || doc_id % 3 END),
 answers AS (
  SELECT r.request, CASE WHEN s.n = 1 THEN 'symbol' ELSE 'choices' END AS kind, a.package, s.ver, s.exhibit, NULL::INT AS module, NULL::BIGINT AS article, CASE WHEN s.n = 1 THEN s.c END AS c, s.n, s.redirected OR r.v = 5 AS redirected FROM req r JOIN asks a USING (request) JOIN shown s USING (request)
  UNION ALL SELECT request, CASE WHEN n = 1 THEN 'symbol' ELSE 'choices' END, package, 29, NULL, NULL, NULL, CASE WHEN n = 1 THEN c END, n, redirected FROM legacy
  UNION ALL SELECT request, CASE v WHEN 6 THEN 'module' ELSE 'package' END, p, ver, NULL, CASE WHEN v = 6 THEN namespace END, NULL, NULL, NULL, FALSE FROM req WHERE v IN (6, 7) AND ver IS NOT NULL
  UNION ALL SELECT request, 'symbol', h.package, 29, NULL, NULL, NULL, (r.base, r.host, h.culture), 1, FALSE FROM req r JOIN home b ON b.symbol = r.base JOIN home h ON h.symbol = r.host WHERE v = 8 AND f = 3
  UNION ALL SELECT request, 'article', p, ver, NULL, module, doc_id, NULL, NULL, FALSE FROM doc WHERE ver IS NOT NULL AND doc_id % 7 <> 0
  UNION ALL SELECT 'm' || package, 'resource', package, NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM packages WHERE package % 2 = 0
  UNION ALL SELECT 'q' || package, 'resource', package, NULL, NULL, NULL, NULL, NULL, NULL, FALSE FROM packages WHERE package % 3 <> 0),
 everyone AS (SELECT request FROM req UNION ALL SELECT request FROM doc UNION ALL SELECT 'm' || package FROM packages UNION ALL SELECT 'q' || package FROM packages)"""
REQUESTS = with_tables(*_FACT_TABLES, "versions", then=ALL_ROUTES + ", " + _CASES + """ SELECT request, coalesce(kind, 'none') AS kind, package::INT AS package, ver::INT AS ver, exhibit::INT AS exhibit, module, article, c[1]::BIGINT AS base, c[2]::BIGINT AS host, c[3]::INT AS culture, n::BIGINT AS n, coalesce(redirected, FALSE) AS redirected
 FROM everyone LEFT JOIN answers USING (request)""")


@query(REQUESTS)
def resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    eco = ecosystem(spark, sf_dir)
    return requests.resolve_requests(request_log(spark, sf_dir, eco), eco)


@query(REQUESTS)
def stream_resolve_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of request files against the static tables; a batch that runs again writes its folder again."""
    base = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    eco = ecosystem(spark, sf_dir)
    log = request_log(spark, sf_dir, eco)
    log.repartition(3).write.parquet(f"{base}/in")

    def resolve(batch: DataFrame, number: int) -> None:
        requests.resolve_requests(batch, eco).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in").writeStream.foreachBatch(resolve).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(*requests.COLUMNS)


@query(with_tables(*_FACT_TABLES, then=ALL_ROUTES + ", " + HELD + """, standing AS (SELECT m.package, h.* FROM held h JOIN modules m ON m.module = h.culture),
 misses AS (SELECT DISTINCT base || '-' || host || '-' || culture AS request, package, (base + host) % 30 AS asked, namespace, stem, leaf FROM standing),
 met AS (SELECT q.request, q.package, q.asked, g.orientation = '.' AS redirected, g.base, g.host, g.culture, g.lo, g.hi FROM misses q JOIN standing g USING (package, namespace, stem, leaf)),
 single AS (SELECT request, redirected, any_value(package) AS package, any_value(asked) AS asked, count(DISTINCT (base, host, culture)) AS n, min((base, host, culture)) AS c, max(hi) AS ver FROM met GROUP BY request, redirected),
 first AS (SELECT * FROM single QUALIFY row_number() OVER (PARTITION BY request ORDER BY redirected) = 1)
 SELECT request, c[1]::BIGINT AS base, c[2]::BIGINT AS host, c[3]::INT AS culture, ver::INT AS ver, asked::INT AS exhibit, redirected FROM first WHERE n = 1 AND request NOT IN (SELECT request FROM met WHERE asked BETWEEN lo AND hi)"""))
def select_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every composite's route, asked for as a component, at a version at which nothing stands there."""
    eco = ecosystem(spark, sf_dir)
    key = F.concat_ws("-", "base", "host", "culture")
    none = F.lit(None).cast("string")
    asked = eco.groups.select(key.alias("key"), "package", ((F.col("base") + F.col("host")) % 30).alias("ver"), "namespace", "stem", "leaf", F.lit("/").alias("orientation"), none.alias("base_id"), none.alias("host_id"), none.alias("community"))
    found = composites.selected(asked, eco.groups, eco.symbols).filter("how = 'historical'")
    return found.join(asked.select("key", F.col("ver").alias("exhibit")), "key").select(F.col("key").alias("request"), "base", "host", "culture", F.col("ver").cast("int").alias("ver"), F.col("exhibit").cast("int").alias("exhibit"), "redirected")


#: A link for every line, in the documentation of its part, to a symbol that another number of the line gives: by name, as a
#: dotted name, by module, absolute (also to a package or a module alone), to an article, by kind, to an inherited member.
LINKS = """named AS (SELECT l_orderkey * 10 + l_linenumber AS link, l_linenumber AS n, l_suppkey AS supp, s.culture, s.namespace AS nest_namespace, [lower(s.name)] AS nest, lower(s.name) AS own, lower(t.name) AS leaf, t.community, lower(m.name) AS module, lower(q.name) AS near, p.name AS package, lower(y.name) AS host
   FROM lineitem JOIN symbols s ON s.symbol = l_partkey JOIN symbols t ON t.symbol = (l_orderkey * 7 + l_suppkey) % (SELECT max(p_partkey) + 1 FROM part) JOIN modules m ON m.module = t.namespace JOIN packages p ON p.package = m.package
   JOIN modules q ON q.module = s.namespace LEFT JOIN symbols y ON y.symbol = t.parent),
 links AS (SELECT link, culture, nest_namespace, nest, CASE n WHEN 4 THEN 'absolute' WHEN 5 THEN 'doc' ELSE 'visible' END AS form, CASE WHEN n = 2 THEN '.' ELSE '/' END AS orientation, CASE WHEN n = 6 THEN community END AS community,
   CASE n WHEN 3 THEN [module, leaf] WHEN 4 THEN CASE supp % 4 WHEN 0 THEN [package] WHEN 1 THEN [package, module] ELSE [package, module, leaf] END WHEN 5 THEN ['doc-' || supp] WHEN 7 THEN CASE WHEN supp % 3 = 0 THEN [near] ELSE [leaf, own] END ELSE CASE WHEN host IS NOT NULL AND supp % 2 = 0 THEN [host, leaf] ELSE [leaf] END END AS path FROM named)"""


def link_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m, p = A.symbols(spark, sf_dir), A.modules(spark, sf_dir), A.packages(spark, sf_dir)
    n = A.table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    line = A.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("symbol"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("other"))
    owner = m.join(p.select("package", F.col("name").alias("package_name")), "package").select(F.col("module").alias("to"), F.lower("name").alias("module"), F.col("package_name").alias("package"))
    near = m.select(F.col("module").alias("nest_namespace"), F.lower("name").alias("near"))
    source = s.select("symbol", "culture", F.col("namespace").alias("nest_namespace"), F.lower("name").alias("own")).join(near, "nest_namespace")
    target = s.select(F.col("symbol").alias("other"), F.lower("name").alias("leaf"), "community", F.col("namespace").alias("to"), F.col("parent").alias("up")).join(owner, "to")
    target = target.join(s.select(F.col("symbol").alias("up"), F.lower("name").alias("host")), "up", "left")
    rows = line.join(source, "symbol").join(target, "other")
    k, supp = F.col("n"), F.col("supp")
    form = F.when(k == 4, "absolute").when(k == 5, "doc").otherwise("visible")
    absolute = F.when(supp % 4 == 0, F.array("package")).when(supp % 4 == 1, F.array("package", "module")).otherwise(F.array("package", "module", "leaf"))
    plain = F.when(F.col("host").isNotNull() & (supp % 2 == 0), F.array("host", "leaf")).otherwise(F.array("leaf"))
    seventh = F.when(supp % 3 == 0, F.array("near")).otherwise(F.array("leaf", "own"))
    path = F.when(k == 3, F.array("module", "leaf")).when(k == 4, absolute).when(k == 5, F.array(F.concat(F.lit("doc-"), supp.cast("string")))).when(k == 7, seventh).otherwise(plain)
    return rows.select("link", "culture", form.alias("form"), path.alias("path"), F.when(k == 2, ".").otherwise("/").alias("orientation"), "nest_namespace", F.array("own").alias("nest"), F.when(k == 6, F.col("community")).alias("community"))


@query(with_tables(*_FACT_TABLES, "versions", then=ALL_ROUTES + ", " + PINS + ", " + HELD + ", " + LINKS + """, pinned AS (SELECT package, dep, dep_ver FROM pins UNION ALL SELECT package, package, 12 + package * 3 FROM packages),
 standing AS (SELECT DISTINCT h.namespace, h.stem, h.leaf, h.orientation, h.base, h.host, h.culture, h.lo, h.hi, m.package AS lens, y.community FROM held h JOIN modules m ON m.module = h.culture JOIN symbols y ON y.symbol = h.base),
 q AS (SELECT DISTINCT culture, form, path, orientation, nest_namespace, nest, community FROM links),
 q2 AS (SELECT q.*, m.package AS package FROM q JOIN modules m ON m.module = q.culture),
 keys AS (
  SELECT q2.*, 2 AS level, nest_namespace AS ns, array_to_string(list_concat(nest, path[1:len(path) - 1]), chr(9)) AS stem FROM q2 WHERE form <> 'absolute'
  UNION ALL SELECT q2.*, 3, q2.culture, array_to_string(path[1:len(path) - 1], chr(9)) FROM q2 WHERE form <> 'absolute'
  UNION ALL SELECT q2.*, 4, x.namespace, array_to_string(path[1:len(path) - 1], chr(9)) FROM q2 JOIN scopes x ON x.culture = q2.culture AND x.namespace <> q2.culture WHERE form <> 'absolute'
  UNION ALL SELECT q2.*, 1, x.namespace, array_to_string(path[2:len(path) - 1], chr(9)) FROM q2 JOIN scopes x ON x.culture = q2.culture JOIN modules n ON n.module = x.namespace AND lower(n.name) = path[1] WHERE form <> 'absolute' AND len(path) > 1),
 near AS (SELECT DISTINCT k.culture, k.form, k.path, k.orientation, k.nest_namespace, k.nest, k.community, k.level, k.ns, (s.orientation <> k.orientation)::INT AS dotted, s.base, s.host, s.culture AS c
   FROM keys k JOIN standing s ON s.namespace = k.ns AND s.stem = k.stem AND s.leaf = k.path[-1] AND (k.orientation = '/' OR s.orientation = '.') AND (k.community IS NULL OR k.community = s.community)
   JOIN pinned p ON p.package = k.package AND p.dep = s.lens AND p.dep_ver BETWEEN s.lo AND s.hi JOIN scopes x ON x.culture = k.culture AND x.namespace = s.culture),
 far AS (SELECT DISTINCT q.culture, q.form, q.path, q.orientation, q.nest_namespace, q.nest, q.community, 0 AS level, n.module AS ns, (s.orientation <> q.orientation)::INT AS dotted, s.base, s.host, s.culture AS c
   FROM q JOIN packages p ON p.name = path[1] JOIN modules n ON n.package = p.package AND lower(n.name) = path[2] JOIN standing s ON s.lens = p.package AND s.namespace = n.module AND s.stem = array_to_string(path[3:len(path) - 1], chr(9)) AND s.leaf = path[-1]
   AND 29 BETWEEN s.lo AND s.hi AND (q.orientation = '/' OR s.orientation = '.') AND (q.community IS NULL OR q.community = s.community) WHERE form = 'absolute' AND len(path) > 2),
 per AS (SELECT culture, form, path, orientation, nest_namespace, nest, community, dotted, level, ns, count(*) AS n, min((base, host, c)) AS h FROM (SELECT * FROM near UNION ALL SELECT * FROM far) GROUP BY ALL),
 spots AS (SELECT culture, form, path, orientation, nest_namespace, nest, community, dotted, level, max(n) AS n, count(*) AS mods, min(h) AS h FROM per GROUP BY ALL),
 answers AS (
  SELECT culture, form, path, orientation, nest_namespace, nest, community, dotted * 10 + level AS place, n, 'symbol' AS kind, h[1] AS target, h[2] AS host, h[3] AS c FROM spots WHERE n > 1 OR mods = 1
  UNION ALL SELECT q.*, -1, 1, 'article', doc_id, NULL, NULL FROM q JOIN documents ON path[1] = 'doc-' || doc_id AND q.culture = doc_id % 25 WHERE form = 'doc'
  UNION ALL SELECT q.*, 1, 1, 'module', n.module, NULL, NULL FROM q JOIN scopes x ON x.culture = q.culture JOIN modules n ON n.module = x.namespace AND lower(n.name) = path[1] WHERE form <> 'absolute' AND len(path) = 1
  UNION ALL SELECT q.*, 0, 1, 'package', package, NULL, NULL FROM q JOIN packages p ON p.name = path[1] WHERE form = 'absolute' AND len(path) = 1
  UNION ALL SELECT q.*, 0, 1, 'module', n.module, NULL, NULL FROM q JOIN packages p ON p.name = path[1] JOIN modules n ON n.package = p.package AND lower(n.name) = path[2] WHERE form = 'absolute' AND len(path) = 2),
 best AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY culture, form, path, orientation, nest_namespace, nest, community ORDER BY place) = 1)
 SELECT l.link, CASE WHEN b.n IS NULL THEN 'none' WHEN b.n = 1 THEN 'one' ELSE 'many' END AS status, CASE WHEN b.n = 1 THEN b.kind END AS kind, CASE WHEN b.n = 1 THEN b.target END::BIGINT AS target, CASE WHEN b.n = 1 THEN b.host END::BIGINT AS host, CASE WHEN b.n = 1 THEN b.c END::INT AS culture
 FROM links l LEFT JOIN best b ON l.culture = b.culture AND l.form = b.form AND l.path = b.path AND l.orientation = b.orientation AND l.nest_namespace = b.nest_namespace AND l.nest = b.nest AND l.community IS NOT DISTINCT FROM b.community"""))
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    eco = ecosystem(spark, sf_dir)
    latest = eco.index.filter("mask is null").select("package", "ver")
    pins = _pins(spark, sf_dir).select("package", "dep", "dep_ver").unionByName(eco.packages.select("package", F.col("package").alias("dep"), (F.col("package") * 3 + 12).alias("dep_ver")))
    return links.resolve_links(link_log(spark, sf_dir), eco.groups, _scopes(spark, sf_dir), eco.modules, eco.packages, eco.articles, eco.symbols, pins, latest)


def _moves(eco: requests.Ecosystem) -> DataFrame:
    """Every third module moves at version 12 and again at 25, the articles of every other one at 20."""
    m = eco.modules.select("module")
    to = lambda kind, ver, when: m.filter(when).select(F.lit(kind).alias("kind"), "module", F.concat(F.lit(f"/moved-{kind}-{ver}/m"), "module").alias("uri"), F.lit(ver).alias("ver"))
    return to("module", 12, "module % 3 = 0").unionByName(to("module", 25, "module % 3 = 0")).unionByName(to("article", 20, "module % 2 = 0"))


@query(with_tables("packages", "modules", "versions", then=_MASKS + """, short AS (SELECT m.package, m.ver, CASE WHEN m.ver <> max(m.ver) OVER (PARTITION BY m.package) THEN arg_min(m.mask, m.n) FILTER (WHERE m.n > 0 AND i.ver = m.ver) END AS mask
   FROM masked m LEFT JOIN idx i ON m.package = i.package AND m.mask = i.mask GROUP BY m.package, m.ver),
 head AS (SELECT s.package, s.ver, p.rank, p.name, CASE WHEN mask LIKE 'toolchain%' THEN replace(mask[11:], ':', '-') ELSE replace(mask[10:], ':', '.') END AS written FROM short s JOIN packages p USING (package)),
 spot AS (SELECT h.*, m.module, '/' || CASE WHEN h.rank = 2 THEN h.name || '/' ELSE '' END || CASE WHEN written IS NULL THEN '' ELSE written || '/' END || replace(lower(m.name), ' ', '%20') AS tail FROM head h JOIN modules m USING (package))
 SELECT 'package' AS kind, package, ver, NULL::INT AS module, NULL::BIGINT AS article, '/reference/' || name || CASE WHEN written IS NULL THEN '' ELSE '/' || written END AS uri FROM head
 UNION ALL SELECT 'module', package, ver, module, NULL, CASE WHEN module % 3 = 0 AND ver = 25 THEN '/moved-module-25/m' || module ELSE '/reference' || tail END FROM spot
 UNION ALL SELECT 'article', package, ver, module, doc_id, CASE WHEN module % 2 = 0 AND ver = 20 THEN '/moved-article-20/m' || module ELSE '/learn' || tail END || '/doc-' || doc_id FROM documents JOIN spot ON module = doc_id % 25 AND ver IN (doc_id % 30, 20, 29)"""))
def entity_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages and modules at every version and each article at some, with what moved."""
    eco = ecosystem(spark, sf_dir)
    versions = A.versions(spark, sf_dir).select("package", "ver")
    none = lambda t: F.lit(None).cast(t)
    packages = versions.select(F.lit("package").alias("kind"), "package", "ver", none("int").alias("module"), none("bigint").alias("article"))
    modules = versions.join(eco.modules.select("module", "package"), "package").select(F.lit("module").alias("kind"), "package", "ver", "module", none("bigint").alias("article"))
    vers = F.explode(F.array_distinct(F.array((F.col("article") % 30).cast("int"), F.lit(20), F.lit(29))))
    articles = eco.articles.join(eco.modules.select("module", "package"), "module").select(F.lit("article").alias("kind"), "package", vers.alias("ver"), "module", "article")
    return uris.place_uris(packages.unionByName(modules).unionByName(articles), eco, V.abbreviate_version(A.versions(spark, sf_dir)), _moves(eco)).select("kind", "package", "ver", "module", "article", "uri")


@query(None)
def respond_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request log and requests for moved modules and articles, with URI, canonical URI and redirection."""
    eco = ecosystem(spark, sf_dir)
    moves = _moves(eco)
    log = request_log(spark, sf_dir, eco)
    gone = moves.select(F.concat(F.lit("u"), "uri").alias("request"), F.split(F.substring(F.col("uri"), F.lit(2), F.length("uri")), "/").alias("path"), F.array().cast(log.schema["params"].dataType).alias("params"))
    book = uris.Book(eco, V.abbreviate_version(A.versions(spark, sf_dir)), moves, stored(composites.overload_spans(_lensed(spark, sf_dir)), "depths"), _symbol_names(spark, sf_dir))
    return uris.respond(log.unionByName(gone), book)


def _symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, module, namespace, path, dotted): what URIs are written from."""
    return _paths(spark, sf_dir).select("symbol", F.col("culture").alias("module"), "namespace", "path", F.col("class").isin("callable", "global").alias("dotted"))
