"""Queries over registration, availability, page URIs and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import versions as V
from docgraph.functions.availability import availability_labels as labels
from docgraph.functions.availability import lower_availability as lowered
from docgraph.functions.storage import stored
from docgraph.operators import docs, facts, packages, registry, routes
from docgraph.plans import adapters as A
from docgraph.plans.adapters import with_tables
from docgraph.plans.queries_core import _FACT_TABLES, _MASKS, KEYFRAMES, SCOPES, STATEMENTS, TRAITS, _history, _scopes, _statements
from docgraph.plans.queries_pages import URIS
from docgraph.plans.queries_routes import PATHS, _paths, _routes
from docgraph.plans.registering import query

_VERTICES = "vertices AS (SELECT name AS id, culture, namespace, symbol AS pos FROM symbols), known AS (SELECT name AS id, min(culture) AS module, row_number() OVER (ORDER BY name) - 1 AS idx FROM symbols WHERE symbol % 4 = 0 GROUP BY name)"
_JUDGED = _VERTICES + """, first AS (SELECT id, min((pos, culture, namespace)) AS v FROM vertices GROUP BY id),
 judged AS (SELECT f.id, coalesce(k.module, f.v[2])::INT AS module, CASE WHEN k.module <> f.v[2] THEN 'moved' WHEN k.module IS NOT NULL THEN 'known' WHEN x.culture IS NULL THEN 'colony' ELSE 'new' END AS status, k.idx, f.v[1] AS pos
   FROM first f LEFT JOIN known k USING (id) LEFT JOIN scopes x ON x.culture = f.v[2] AND x.namespace = f.v[3])"""


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.symbols(spark, sf_dir).select(F.col("name").alias("id"), "culture", "namespace", F.col("symbol").alias("pos"))


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vertices(spark, sf_dir)
    had = v.filter("pos % 4 = 0").groupBy("id").agg(F.min("culture").alias("module"))
    return registry.register_symbols(v, _scopes(spark, sf_dir), had.join(packages.register_first_seen(had, "id", ["id"]), "id"))


@query(with_tables("packages", "modules", "module_deps", "symbols", then=SCOPES + ", " + _JUDGED + " SELECT id, module, CASE WHEN status = 'new' THEN (SELECT count(*) FROM known) + row_number() OVER (PARTITION BY status ORDER BY pos, id) - 1 ELSE idx END AS idx, status FROM judged"))
def register_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir)


@query(with_tables("packages", "modules", "module_deps", "symbols", then=SCOPES + ", " + _JUDGED + " SELECT DISTINCT v.culture, v.id FROM vertices v JOIN judged j ON j.id = v.id AND j.module = v.culture"))
def updated_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.updated_symbols(_vertices(spark, sf_dir), _registered(spark, sf_dir))


@query(with_tables("modules", "module_deps", then="SELECT DISTINCT a.package, d.dep FROM module_deps d JOIN modules a USING (module) JOIN modules b ON b.module = d.dep WHERE a.package = b.package", wide=True))
def union_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.union_dependencies(A.modules(spark, sf_dir, wide=True), A.module_deps(spark, sf_dir, wide=True))


@query(with_tables("modules", "module_deps", "symbols", then=PATHS + """, sets AS (SELECT culture AS module, 'toplevel' AS kind, symbol AS member FROM paths WHERE len(path) = 1
   UNION SELECT module, 'dependency', dep FROM module_deps UNION SELECT doc_id % 25, 'guide', doc_id FROM documents)
 SELECT module::INT AS module, kind, member::BIGINT AS member, row_number() OVER (PARTITION BY module, kind ORDER BY member) AS rank FROM sets"""))
def module_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = A.table(spark, sf_dir, "documents").select((F.col("doc_id") % 25).cast("int").alias("culture"), F.col("doc_id").alias("article"))
    return registry.module_sets(_paths(spark, sf_dir), A.module_deps(spark, sf_dir), articles)


@query(with_tables(*_FACT_TABLES, then=STATEMENTS + ", " + PATHS + """, roles AS (SELECT DISTINCT subject, object FROM statements WHERE verb = 'is')
 SELECT subject, object, (row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN len(path) > 1 THEN path[1:len(path) - 1] ELSE path END, path, object))::INT AS rank FROM roles JOIN paths ON symbol = object"""))
def sort_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sort_roles(_statements(spark, sf_dir).filter("verb = 'is'").select("subject", "object").distinct(), _paths(spark, sf_dir))


@query(with_tables("packages", "modules", "versions", then=_MASKS + """, short AS (SELECT m.package, m.ver, CASE WHEN m.ver <> max(m.ver) OVER (PARTITION BY m.package) THEN arg_min(m.mask, m.n) FILTER (WHERE m.n > 0 AND i.ver = m.ver) END AS mask
   FROM masked m LEFT JOIN idx i ON m.package = i.package AND m.mask = i.mask GROUP BY m.package, m.ver),
 head AS (SELECT s.package, s.ver, '/reference' || CASE WHEN p.rank = 2 THEN '/' || p.name ELSE '' END || CASE WHEN mask IS NULL THEN '' ELSE '/' || CASE WHEN mask LIKE 'toolchain%' THEN replace(mask[11:], ':', '-') ELSE replace(mask[10:], ':', '.') END END AS head FROM short s JOIN packages p USING (package))
 SELECT package, ver, NULL::INT AS module, head AS uri FROM head UNION ALL SELECT h.package, ver, module, head || '/' || replace(lower(m.name), ' ', '%20') FROM head h JOIN modules m USING (package)""", wide=True))
def entity_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.entity_uri(A.modules(spark, sf_dir, wide=True), A.packages(spark, sf_dir, wide=True), V.abbreviate_version(A.versions(spark, sf_dir, wide=True)))


def _uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.composite_uri(routes.overload_depth(_routes(spark, sf_dir)), A.modules(spark, sf_dir), A.packages(spark, sf_dir))


@query(with_tables(*_FACT_TABLES, then=TRAITS + ", " + URIS + " SELECT u.base, u.host, u.uri, CASE WHEN u.base <> u.host THEN n.uri END AS canonical FROM uris u LEFT JOIN uris n ON n.base = u.base AND n.host = u.base"))
def canonical_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.canonical_uri(_uris(spark, sf_dir))


@query(with_tables(*_FACT_TABLES, then=TRAITS + ", " + URIS + """, nat AS (SELECT base, uri FROM uris WHERE base = host)
 SELECT p_partkey AS request, uri, CASE WHEN uri IS NULL THEN 'none' WHEN p_partkey % 3 = 0 THEN 'match' WHEN p_partkey % 2 = 0 THEN 'temporary' ELSE 'permanent' END AS kind FROM part LEFT JOIN nat ON base = p_partkey AND p_partkey % 7 <> 0"""))
def redirect_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    uris = _uris(spark, sf_dir)
    natural = uris.filter("base = host").select(F.col("base").alias("k"), F.col("uri").alias("right"))
    r = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request")).join(natural, F.col("request") == F.col("k"), "left")
    key = F.when(F.col("request") % 7 != 0, F.col("request"))
    asked = r.select("request", F.when(F.col("request") % 3 == 0, F.col("right")).otherwise("/old").alias("asked"), key.alias("base"), key.alias("host"), (F.col("request") % 2 == 0).alias("redirected"))
    return registry.redirect_table(asked, uris)


@query(with_tables("packages", "versions", then="SELECT o_orderkey AS link, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 7 ELSE o_custkey % 5 END::INT AS package, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 40 ELSE o_custkey % 30 END::INT AS ver FROM orders WHERE CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 7 < 5 AND o_custkey % 40 < 30 ELSE TRUE END".replace("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 7 ELSE o_custkey % 5 END::INT", "(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 7 ELSE o_custkey % 5 END)::INT").replace("CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 40 ELSE o_custkey % 30 END::INT", "(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 40 ELSE o_custkey % 30 END)::INT")))
def localize_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    lens = F.col("o_orderkey") % 2 == 0
    links = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link"), (c % 5).cast("int").alias("package"), (c % 30).cast("int").alias("ver"), F.when(lens, c % 7).cast("int").alias("lens_package"), F.when(lens, c % 40).cast("int").alias("lens_ver"))
    return registry.localize_pins(links, A.versions(spark, sf_dir))


@query(with_tables("modules", "observations", then=KEYFRAMES + """, c AS (SELECT DISTINCT entity AS base, CASE WHEN entity % 3 = 0 THEN entity ELSE entity + 1 END AS host, ((entity + k * 5 + k // 2) % 25)::INT AS culture, ((entity * 7 + k * 5) % 32)::INT AS ver FROM observations, (SELECT unnest(range(4)) AS k)),
 sides AS (SELECT c.*, CASE WHEN c.culture = c.host % 25 THEN 'primary' WHEN a.package = b.package THEN 'accepted' ELSE 'opinion' END AS belief FROM c JOIN modules a ON a.module = c.culture JOIN modules b ON b.module = c.host % 25)
 SELECT base, host, culture, ver, EXISTS (SELECT 1 FROM keyframes f WHERE s.ver BETWEEN f.lo AND f.hi AND f.entity = s.base
   AND (s.base = s.host OR CASE s.belief WHEN 'primary' THEN f.value = 'click' WHEN 'accepted' THEN f.value IN ('click', 'view') ELSE f.value <> 'click' END)) AS "exists" FROM sides s"""))
def composite_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's latest event says how the next user holds it as a feature."""
    h = _history(spark, sf_dir)
    base = F.col("base")
    host = F.when(base % 3 == 0, base).otherwise(base + 1)
    seen = A.observations(spark, sf_dir).select(F.col("entity").alias("base")).distinct().select("base", host.alias("host"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    asked = seen.select("base", "host", ((base + F.col("k") * 5 + F.expr("k div 2")) % 25).cast("int").alias("culture"), ((base * 7 + F.col("k") * 5) % 32).cast("int").alias("ver")).distinct()
    value = F.col("value")
    held = F.array_compact(F.array(F.when(value == "click", "primary"), F.when(value.isin("click", "view"), "accepted"), F.when(value != "click", "opinion")))
    features = h.select((F.col("entity") + 1).alias("host"), F.col("entity").alias("base"), F.explode(held).alias("belief"), "lo", "hi").join(asked.select("host", "base", "culture").distinct(), ["host", "base"])
    homes = asked.select(F.col("host").alias("symbol"), (F.col("host") % 25).cast("int").alias("culture")).distinct()
    return registry.composite_exists(asked, h.select(F.col("entity").alias("symbol"), "lo", "hi"), features, homes, A.modules(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    no = F.lit(None).cast("string")
    r = lambda domain, a, b, i, d, o: F.struct(F.lit(domain).alias("domain"), a.alias("unavailable"), b.alias("deprecatedAlways"), i.alias("introduced"), d.alias("deprecated"), o.alias("obsoleted"))
    f, text = F.lit(False), n.cast("string")
    records = F.array(r("*", k % 7 == 0, k % 5 == 0, no, no, no), r("Swift", F.lit(True), f, F.when(k % 2 == 0, F.concat(F.lit("5."), text)), F.when(k % 11 == 0, text), F.when(k % 13 == 0, text)), r("macOS", k % 3 == 0, f, text, F.when(k % 4 == 0, text), no), r("iOS", f, k % 6 == 0, text, no, no))
    twice = F.when(k % 17 == 0, F.concat(records, F.array(r("iOS", f, f, no, no, no)))).otherwise(records)
    return A.table(spark, sf_dir, "part").select(k.alias("id"), F.explode(F.array(lowered(twice))).alias("v"))


_AVAILABLE = """a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'unavailable' WHEN p_partkey % 5 = 0 THEN 'deprecated' END AS general, CASE WHEN p_partkey % 2 = 0 THEN '5.' || p_size END AS introduced,
   CASE WHEN p_partkey % 11 = 0 THEN p_size::VARCHAR END AS deprecated, CASE WHEN p_partkey % 13 = 0 THEN p_size::VARCHAR END AS obsoleted, p_partkey % 17 = 0 AS error,
   CASE WHEN p_partkey % 3 = 0 THEN 'unavailable' WHEN p_partkey % 4 = 0 THEN 'deprecated since ' || p_size ELSE p_size || '+' END AS mac, CASE WHEN p_partkey % 6 = 0 THEN 'deprecated' ELSE p_size || '+' END AS ios FROM part)"""


@query(f"WITH {_AVAILABLE} SELECT id, general, introduced, deprecated, obsoleted, error FROM a")
def lower_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", "v.general", "v.introduced", "v.deprecated", "v.obsoleted", "v.error")


@query(f"""WITH {_AVAILABLE} SELECT id, concat_ws('; ', CASE general WHEN 'unavailable' THEN 'Unavailable' WHEN 'deprecated' THEN 'Deprecated' END,
 CASE WHEN obsoleted IS NOT NULL THEN 'Obsolete' WHEN deprecated IS NOT NULL THEN 'Deprecated' WHEN introduced IS NOT NULL THEN 'Available since ' || introduced END, 'iOS ' || ios, 'macOS ' || mac) AS labels FROM a""")
def availability_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", F.array_join(labels(F.col("v")), "; ").alias("labels"))


#: Documentation over versions: what a document says at first, and later; a bare one inherits from a smaller number.
_HISTORY = """docs AS (SELECT symbol, 0 AS lo, 9 + symbol % 5 AS hi, origin, comment FROM comments
   UNION ALL SELECT symbol, 10 + symbol % 5 + CASE WHEN symbol % 3 = 0 THEN 1 ELSE 0 END, 29, CASE WHEN comment IS NULL THEN symbol // 3 ELSE origin END, CASE WHEN symbol % 6 <> 1 THEN comment END FROM comments),
 pins AS (SELECT v.package, v.ver, d.package AS dep, CASE WHEN v.package = d.package THEN v.ver ELSE (v.ver * 3 + d.package * 7 + v.package) % 30 END AS dep_ver FROM versions v, packages d),
 pages AS (SELECT (symbol % 5)::INT AS package, unnest([symbol % 7, 20])::INT AS ver, symbol FROM comments)"""


@query(with_tables("comments", "packages", "versions", then=_HISTORY + """, walk AS (SELECT package, ver, symbol, symbol AS loc, 0 AS hops FROM pages
   UNION ALL SELECT w.package, w.ver, w.symbol, d.origin, hops + 1 FROM walk w JOIN pins p ON p.package = w.package AND p.ver = w.ver AND p.dep = w.loc % 5 JOIN docs d ON d.symbol = w.loc AND p.dep_ver BETWEEN d.lo AND d.hi WHERE d.comment IS NULL AND d.origin IS NOT NULL),
 ends AS (SELECT package, ver, symbol, arg_max(loc, hops) AS target, max(hops) AS hops FROM walk GROUP BY package, ver, symbol)
 SELECT e.package, e.ver, e.symbol, target, hops::BIGINT AS hops, md5(coalesce(d.comment, '')) AS comment FROM ends e JOIN pins p ON p.package = e.package AND p.ver = e.ver AND p.dep = e.target % 5 LEFT JOIN docs d ON d.symbol = e.target AND p.dep_ver BETWEEN d.lo AND d.hi"""))
def expand_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's page at two versions; what it inherits crosses packages at the versions they are pinned at."""
    c = stored(A.comments(spark, sf_dir), "comments")
    n = F.col("symbol")
    later = F.struct((10 + n % 5 + F.when(n % 3 == 0, 1).otherwise(0)).alias("lo"), F.lit(29).cast("bigint").alias("hi"), F.when(F.col("comment").isNull(), F.expr("symbol div 3")).otherwise(F.col("origin")).alias("origin"), F.when(n % 6 != 1, F.col("comment")).alias("comment"))
    first = F.struct(F.lit(0).cast("bigint").alias("lo"), (9 + n % 5).alias("hi"), F.col("origin").alias("origin"), F.col("comment").alias("comment"))
    history = c.select("symbol", F.explode(F.array(first, later)).alias("k")).select("symbol", "k.*")
    dep = F.col("dep")
    at = F.when(F.col("package") == dep, F.col("ver")).otherwise((F.col("ver") * 3 + dep * 7 + F.col("package")) % 30)
    pins = A.versions(spark, sf_dir).select("package", "ver", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dep")).select("package", "ver", "dep", at.cast("int").alias("dep_ver"))
    homes = c.select("symbol", (n % 5).cast("int").alias("package"))
    pages = c.select((n % 5).cast("int").alias("package"), F.explode(F.array((n % 7).cast("int"), F.lit(20))).alias("ver"), "symbol").distinct()
    return docs.expand_templates(pages, history, pins, homes).withColumn("comment", F.md5("comment"))


_PACKAGE = """own AS (SELECT symbol, symbol % 25 AS module, CASE WHEN symbol % 13 = 5 THEN -symbol ELSE origin END AS origin, comment FROM comments),
 eq AS (SELECT c.symbol, c.origin FROM own c JOIN own o ON o.symbol = c.origin AND o.comment = c.comment AND o.module <> c.module AND o.symbol < c.symbol),
 chain AS (SELECT symbol, TRUE AS gone FROM eq WHERE origin NOT IN (SELECT symbol FROM eq) UNION ALL SELECT e.symbol, NOT c.gone FROM eq e JOIN chain c ON c.symbol = e.origin),
 scanned AS (SELECT o.symbol, o.origin, CASE WHEN c.gone THEN NULL ELSE o.comment END AS comment, coalesce(c.gone, FALSE) AS gone FROM own o LEFT JOIN chain c USING (symbol) WHERE o.comment IS NOT NULL OR o.origin IS NOT NULL),
 follow AS (SELECT symbol, origin AS loc, 0 AS skipped FROM scanned WHERE comment IS NULL UNION ALL SELECT f.symbol, s.origin, skipped + 1 FROM follow f JOIN scanned s ON s.symbol = f.loc WHERE s.comment IS NULL),
 ends AS (SELECT symbol, arg_max(loc, skipped) AS loc, max(skipped) AS skipped FROM follow GROUP BY symbol),
 judged AS (SELECT s.*, e.loc, e.skipped, s.comment IS NULL AND e.loc >= 0 AND e.loc IN (SELECT symbol FROM own) AND e.loc NOT IN (SELECT symbol FROM scanned) AS lost FROM scanned s LEFT JOIN ends e USING (symbol))"""


def _package_comments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, int]]:
    """All documents as one package; one in thirteen inherits from another package."""
    n = F.col("symbol")
    own = A.comments(spark, sf_dir).select("symbol", (n % 25).cast("int").alias("module"), n.alias("pos"), F.when(n % 13 == 5, -n).otherwise(F.col("origin")).alias("origin"), "comment")
    return docs.package_comments(stored(own, "comments"))


@query(with_tables("comments", then=_PACKAGE + " SELECT symbol, CASE WHEN comment IS NULL THEN loc ELSE origin END AS origin, md5(comment) AS comment FROM judged WHERE NOT lost"))
def package_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _package_comments(spark, sf_dir)[0].withColumn("comment", F.md5("comment"))


@query(with_tables("comments", then=_PACKAGE + " SELECT count(*) FILTER (WHERE gone) AS pruned, coalesce(sum(skipped) FILTER (WHERE comment IS NULL AND NOT lost), 0)::BIGINT AS shortened, count(*) FILTER (WHERE lost) AS dropped FROM judged"))
def comment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _package_comments(spark, sf_dir)[1]
    return spark.createDataFrame([tuple(counts[c] for c in ("pruned", "shortened", "dropped"))], "pruned bigint, shortened bigint, dropped bigint")
