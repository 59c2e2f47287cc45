"""Queries over paths, routes, URIs and documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.storage import stored
from docgraph.operators import docs, facts, routes, shapes
from docgraph.plans import adapters as A
from docgraph.plans.adapters import with_tables
from docgraph.plans.queries_core import _FACT_TABLES, STATEMENTS, TRAITS, _statements
from docgraph.plans.registering import query

PATHS = """walk AS (SELECT symbol AS s, [name] AS path, [symbol] AS trail, parent AS up FROM symbols
   UNION ALL SELECT w.s, list_prepend(p.name, w.path), list_prepend(p.symbol, w.trail), p.parent FROM walk w JOIN symbols p ON p.symbol = w.up),
 tops AS (SELECT s, arg_max(path, len(path)) AS path, arg_max(trail, len(trail)) AS trail FROM walk GROUP BY s),
 paths AS (SELECT y.*, t.path, t.trail FROM symbols y JOIN tops t ON t.s = y.symbol)"""
NATURAL = """natural_routes AS (SELECT namespace, lower(array_to_string(path[1:len(path) - 1], chr(9))) AS stem, lower(path[-1]) AS leaf,
   CASE WHEN class IN ('callable', 'global') THEN '.' ELSE '/' END AS orientation, symbol AS base, symbol AS host, culture FROM paths)"""
SYNTHETIC = """synthetic AS (SELECT h.namespace, lower(array_to_string(h.path, chr(9))) AS stem, lower(f.path[-1]) AS leaf, CASE WHEN f.class IN ('callable', 'global') THEN '.' ELSE '/' END AS orientation,
   f.symbol AS base, h.symbol AS host, t.culture FROM traits t JOIN paths h ON h.symbol = t.subject JOIN paths f ON f.symbol = t.object WHERE t.slot = 'feature'),
 every AS (SELECT * FROM natural_routes UNION ALL SELECT * FROM synthetic)"""
ALL_ROUTES = TRAITS + ", " + PATHS + ", " + NATURAL + ", " + SYNTHETIC


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.symbol_paths(A.symbols(spark, sf_dir))


def _routes(spark: SparkSession, sf_dir: str, paths: DataFrame | None = None) -> DataFrame:
    p = _paths(spark, sf_dir) if paths is None else paths
    features = facts.traits(_statements(spark, sf_dir)).filter("slot = 'feature'").select(F.col("subject").alias("host"), F.col("object").alias("feature"), "culture")
    return routes.natural_routes(p).unionByName(routes.synthetic_routes(p, features))


@query(with_tables("symbols", then=PATHS + " SELECT symbol, array_to_string(path, '.') AS path, len(path)::INT AS depth FROM paths"))
def symbol_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("symbol", F.array_join("path", ".").alias("path"), F.size("path").alias("depth"))


@query(with_tables("symbols", then=PATHS + ", x AS (SELECT symbol, unnest(trail) AS ancestor, generate_subscripts(trail, 1) - 1 AS level FROM paths) SELECT symbol, level::INT AS level, ancestor FROM x WHERE ancestor <> symbol"))
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.breadcrumbs(_paths(spark, sf_dir))


@query(with_tables("symbols", then=PATHS + ", " + NATURAL + " SELECT base, namespace, replace(stem, chr(9), '|') AS stem, leaf, orientation FROM natural_routes"))
def route_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.natural_routes(_paths(spark, sf_dir)).select("base", "namespace", F.replace("stem", F.lit("\t"), F.lit("|")).alias("stem"), "leaf", "orientation")


@query(with_tables(*_FACT_TABLES, then=ALL_ROUTES + """, held AS (SELECT namespace, stem, leaf, orientation, base, host, culture, count(*) AS retains FROM every GROUP BY ALL)
 SELECT namespace, replace(stem, chr(9), '|') AS stem, leaf, orientation, base, host, culture, retains, count(*) OVER (PARTITION BY namespace, stem, leaf, orientation) AS composites FROM held"""))
def route_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.route_groups(_routes(spark, sf_dir)).withColumn("stem", F.replace("stem", F.lit("\t"), F.lit("|")))


DEPTHS = """distinct_routes AS (SELECT DISTINCT namespace, stem, leaf, orientation, base, host, culture FROM every),
 depths AS (SELECT *, count(*) OVER r > count(*) OVER b OR count(*) OVER b > 1 AS need_base, count(*) OVER b > 1 AS need_host FROM distinct_routes
   WINDOW r AS (PARTITION BY namespace, stem, leaf, orientation), b AS (PARTITION BY namespace, stem, leaf, orientation, base))"""


@query(with_tables(*_FACT_TABLES, then=ALL_ROUTES + ", " + DEPTHS + " SELECT base, host, culture, need_base, need_host FROM depths"))
def overload_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.overload_depth(_routes(spark, sf_dir)).select("base", "host", "culture", "need_base", "need_host")


@query(with_tables(*_FACT_TABLES, then=ALL_ROUTES + ", " + DEPTHS + """, enc AS (SELECT d.base, d.host, d.culture, orientation, CASE WHEN p.rank = 2 THEN '/' || p.name ELSE '' END || '/' || replace(lower(m.name), ' ', '%20') AS head,
   CASE WHEN stem = '' THEN '' ELSE '/' || replace(stem, chr(9), '/') END AS mid, stem, leaf, need_base, need_host FROM depths d JOIN modules m ON m.module = d.namespace JOIN packages p USING (package))
 SELECT base, host, culture, head || mid || CASE WHEN orientation = '.' AND stem <> '' THEN '.' ELSE '/' END || leaf
   || CASE WHEN need_base OR need_host THEN '?' ELSE '' END || CASE WHEN need_base THEN 'overload=s' || base ELSE '' END || CASE WHEN need_host THEN CASE WHEN need_base THEN '&' ELSE '' END || 'self=s' || host ELSE '' END AS uri FROM enc"""))
def composite_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.composite_uri(routes.overload_depth(_routes(spark, sf_dir)), A.modules(spark, sf_dir), A.packages(spark, sf_dir))


#: Symbols pushed at 64 versions, some with what the facts of the version say of their parent.
PUSHES = """pushes AS (SELECT symbol, ver, f[1] AS shape, f[2] AS parent FROM (SELECT l_partkey AS symbol, (l_orderkey % 64)::INT AS ver,
   min((CASE WHEN l_linenumber % 2 = 1 THEN 'member' ELSE 'requirement' END, (l_orderkey * 7 + l_suppkey) % n)) FILTER (WHERE l_suppkey % 5 = 0) AS f FROM lineitem, (SELECT max(p_partkey) + 1 AS n FROM part) GROUP BY 1, 2))"""
HELD = """held AS (SELECT m.package, namespace, stem, leaf, orientation, base, host, culture, count(DISTINCT ver) AS retains, min(ver) AS lo FROM {routes} r JOIN pushes p ON p.symbol = r.host JOIN modules m ON m.module = r.culture GROUP BY ALL)"""
INFERRED = PUSHES + ", " + PATHS + ", " + NATURAL + ", " + HELD.format(routes="natural_routes") + """,
 asked AS (SELECT p.*, m.package, y.namespace, y.path FROM pushes p JOIN paths y ON y.symbol = p.symbol JOIN modules m ON m.module = y.culture),
 tried AS (SELECT a.symbol, a.ver, CASE WHEN count(*) = 1 AND min(h.base) = min(h.host) THEN min(h.base) END AS found FROM asked a JOIN held h ON h.package = a.package AND h.namespace = a.namespace AND h.orientation = '/'
   AND h.leaf = lower(a.path[-2]) AND h.stem = lower(array_to_string(a.path[1:len(a.path) - 2], chr(9))) AND h.lo <= a.ver WHERE len(a.path) > 1 AND a.shape IS NULL GROUP BY a.symbol, a.ver),
 stated AS (SELECT a.*, t.found, last_value(a.shape IGNORE NULLS) OVER w AS ls, last_value(a.parent IGNORE NULLS) OVER w AS lp, first_value(t.found IGNORE NULLS) OVER w AS ff FROM asked a LEFT JOIN tried t USING (symbol, ver) WINDOW w AS (PARTITION BY a.symbol ORDER BY a.ver ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 inferred AS (SELECT symbol, ver, coalesce(ls, CASE WHEN ff IS NOT NULL THEN 'member' END) AS shape, coalesce(lp, ff) AS parent,
   CASE WHEN shape IS NOT NULL THEN 'said' WHEN lag(coalesce(lp, ff)) OVER (PARTITION BY symbol ORDER BY ver) IS NOT NULL THEN 'kept' WHEN found IS NOT NULL THEN 'inferred' WHEN len(path) > 1 THEN 'orphan' ELSE 'root' END AS origin FROM stated)"""


def _pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    said = F.struct(F.when(F.col("l_linenumber") % 2 == 1, "member").otherwise("requirement").alias("shape"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("parent"))
    rows = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), (F.col("l_orderkey") % 64).cast("int").alias("ver"))
    return rows.agg(F.min(F.when(F.col("l_suppkey") % 5 == 0, said)).alias("s")).select("symbol", "ver", "s.shape", "s.parent")


def _lens_groups(routes_: DataFrame, pushes: DataFrame, modules: DataFrame) -> DataFrame:
    """Groups after the pushes of the composites' hosts; the lens is the package of a composite's culture."""
    lens = modules.select(F.col("module").alias("culture"), "package")
    return shapes.lens_groups(routes_.join(pushes.select(F.col("symbol").alias("host"), "ver"), "host").join(lens, "culture"))


@query(with_tables(*_FACT_TABLES, then=ALL_ROUTES + ", " + PUSHES + ", " + HELD.format(routes="every") + " SELECT package, replace(stem, chr(9), '|') AS stem, namespace, leaf, orientation, base, host, culture, retains, lo, count(*) OVER (PARTITION BY package, namespace, stem, leaf, orientation) AS composites FROM held"))
def lens_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lens_groups(_routes(spark, sf_dir), _pushes(spark, sf_dir), A.modules(spark, sf_dir)).withColumn("stem", F.replace("stem", F.lit("\t"), F.lit("|")))


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    pushes, modules = _pushes(spark, sf_dir), A.modules(spark, sf_dir)
    owned = p.join(modules.select(F.col("module").alias("culture"), "package"), "culture")
    return shapes.infer_shapes(pushes, owned, _lens_groups(routes.natural_routes(p), pushes, modules))


@query(with_tables("modules", "symbols", then=INFERRED + " SELECT symbol, ver, shape, parent, origin FROM inferred"))
def infer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, sf_dir)


@query(with_tables("modules", "symbols", then=INFERRED + """ SELECT i.parent AS subject, i.ver, o.culture, 'member' AS slot, i.symbol AS object, CASE WHEN o.culture = s.culture THEN 'primary' ELSE 'accepted' END AS belief
 FROM inferred i JOIN symbols o ON o.symbol = i.symbol JOIN symbols s ON s.symbol = i.parent WHERE origin = 'inferred' AND EXISTS (SELECT 1 FROM pushes p WHERE p.symbol = i.parent AND p.ver = i.ver)"""))
def inferred_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.inferred_members(stored(_inferred(spark, sf_dir), "shapes"), A.symbols(spark, sf_dir))


@query(with_tables(*_FACT_TABLES, then=STATEMENTS + """ SELECT culture, count(*) FILTER (WHERE verb IS NULL) AS rejected, count(*) FILTER (WHERE verb = 'is') AS roles, count(*) FILTER (WHERE verb = 'has') AS traits FROM statements GROUP BY culture"""))
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verb")
    return _statements(spark, sf_dir).groupBy("culture").agg(F.count(F.when(v.isNull(), 1)).alias("rejected"), F.count(F.when(v == "is", 1)).alias("roles"), F.count(F.when(v == "has", 1)).alias("traits"))


@query("""WITH h AS (SELECT l_partkey AS source, (l_orderkey * 3 + l_suppkey) % (SELECT max(p_partkey) + 1 FROM part) AS origin, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000 AS pos FROM lineitem),
 last AS (SELECT source, arg_max(origin, (pos, origin)) AS origin FROM h WHERE source <> origin GROUP BY source)
 SELECT p_partkey AS symbol, l.origin, CASE WHEN p_size % 3 <> 0 THEN 'extends' WHEN l.origin IS NULL THEN 'none' ELSE 'inherits' END AS raw,
   CASE WHEN p_size % 3 = 0 AND l.origin IS NULL THEN 'none' WHEN p_size % 3 = 0 THEN 'inherits' ELSE 'extends' END AS state FROM part LEFT JOIN last l ON l.source = p_partkey""".replace("CASE WHEN p_size % 3 <> 0 THEN 'extends' WHEN l.origin IS NULL THEN 'none' ELSE 'inherits' END AS raw,\n", ""))
def apply_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = A.table(spark, sf_dir, "part")
    n = part.agg(F.max("p_partkey") + 1).first()[0]
    pos = F.struct((F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 10_000 + F.col("l_suppkey") % 10_000).alias("p"), F.col("origin"))
    hints = A.table(spark, sf_dir, "lineitem").withColumn("origin", (F.col("l_orderkey") * 3 + F.col("l_suppkey")) % n).select(F.col("l_partkey").alias("source"), "origin", pos.alias("pos"))
    vertices = part.select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("comment"))
    return docs.apply_hints(vertices, hints).select("symbol", "origin", "state")


@query(with_tables("comments", then="""eq AS (SELECT c.symbol, c.origin FROM comments c JOIN comments o ON o.symbol = c.origin AND o.comment = c.comment),
 chain AS (SELECT symbol, origin, TRUE AS pruned FROM eq WHERE origin NOT IN (SELECT symbol FROM eq)
   UNION ALL SELECT e.symbol, e.origin, NOT (c.pruned AND e.origin < e.symbol) FROM eq e JOIN chain c ON c.symbol = e.origin)
 SELECT c.symbol, c.origin, CASE WHEN h.pruned THEN NULL ELSE md5(c.comment) END AS comment FROM comments c LEFT JOIN chain h USING (symbol)"""))
def prune_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.prune_comments(stored(A.comments(spark, sf_dir), "comments")).select("symbol", "origin", F.md5("comment").alias("comment"))


@query(with_tables("comments", then="""follow AS (SELECT symbol, origin AS loc, 1 AS hops FROM comments WHERE comment IS NULL AND origin IS NOT NULL
   UNION ALL SELECT f.symbol, c.origin, f.hops + 1 FROM follow f JOIN comments c ON c.symbol = f.loc WHERE c.comment IS NULL AND c.origin IS NOT NULL),
 ends AS (SELECT symbol, arg_max(loc, hops) AS loc, max(hops) AS hops FROM follow GROUP BY symbol)
 SELECT e.symbol, CASE WHEN c.comment IS NOT NULL THEN e.loc END AS target, e.hops::BIGINT AS hops, CASE WHEN c.comment IS NOT NULL THEN 'found' ELSE 'dropped' END AS state FROM ends e LEFT JOIN comments c ON c.symbol = e.loc"""))
def doc_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.doc_inheritance(A.comments(spark, sf_dir))
