"""Queries over vertices, declarations, extensions, page facts, and comment fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.doc_fields import doc_fields as split_fields
from docgraph.functions.storage import stored
from docgraph.operators import facts, routes, shapes, vertices
from docgraph.plans import adapters as A
from docgraph.plans.adapters import with_tables
from docgraph.plans.queries_core import _FACT_TABLES, ROLES, SCOPES, SHAPES, TRAITS, _scopes, _statements
from docgraph.plans.queries_routes import PATHS, _paths
from docgraph.plans.registering import query

_COPIES = """copies AS (SELECT l_partkey % 25 AS culture, CASE WHEN l_linenumber = 1 THEN (l_partkey + 1) % 25 ELSE l_partkey % 25 END AS namespace, l_partkey AS id, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000 AS pos,
   l_orderkey % 5 = 0 AS nat, l_suppkey % 2 = 0 AS unavailable, CASE WHEN l_suppkey % 3 = 0 THEN '_P' ELSE 'P' END AS protocol, CASE WHEN l_linenumber % 3 > 0 THEN l_partkey % 25 END AS pc FROM lineitem)"""


@query(f"""WITH {_COPIES}, legal AS (SELECT * FROM copies WHERE nat OR (culture = namespace AND pc = culture AND (unavailable OR protocol = '_P'))),
 r AS (SELECT *, row_number() OVER (PARTITION BY culture, namespace, id ORDER BY nat DESC, CASE WHEN nat THEN -pos ELSE pos END) AS k FROM legal)
 SELECT culture, namespace, id, pos, nat AS "natural" FROM r WHERE k = 1""")
def natural_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, s = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    copies = A.table(spark, sf_dir, "lineitem").select((k % 25).alias("culture"), F.when(n == 1, (k + 1) % 25).otherwise(k % 25).alias("namespace"), k.alias("id"), (F.col("l_orderkey") * 100_000 + n * 10_000 + s % 10_000).alias("pos"), (F.col("l_orderkey") % 5 == 0).alias("natural"), (s % 2 == 0).alias("unavailable"), F.when(s % 3 == 0, "_P").otherwise("P").alias("protocol"), F.when(n % 3 > 0, k % 25).alias("protocol_culture"))
    return vertices.natural_vertices(copies).select("culture", "namespace", "id", "pos", "natural")


#: Copies of members of forty protocols a module, half of them hidden; a third of the rows names one in a constraint.
_MEMBERS = """rows AS (SELECT 'M' || l_suppkey % 25 AS culture, 'M' || CASE WHEN l_linenumber = 1 THEN (l_suppkey + 1) % 25 ELSE l_suppkey % 25 END AS namespace, l_orderkey * 100000 + l_linenumber * 10000 + l_partkey % 10000 AS pos,
   l_partkey % 40 AS g, CASE WHEN l_partkey % 40 % 2 = 0 THEN '_' ELSE '' END || 'P' || l_partkey % 40 AS protocol, 'M' || CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey % 25 ELSE (l_suppkey + 7) % 25 END AS home, 'm' || l_partkey % 90 AS member,
   l_orderkey % 7 = 0 AS nat, CASE WHEN l_orderkey % 7 > 0 THEN 'M' || CASE WHEN l_orderkey % 4 = 0 THEN (l_suppkey + 3) % 25 ELSE l_suppkey % 25 END END AS inferred, l_orderkey % 3 = 0 AS unavailable, CASE WHEN l_orderkey % 5 < 2 THEN l_orderkey END AS location,
   CASE WHEN l_orderkey % 3 = 1 THEN CASE WHEN l_orderkey % 2 = 0 THEN '_' ELSE '' END || 'Q' || l_orderkey % 11 END AS said FROM lineitem),
 ids AS (SELECT *, 's' || length(home) || home || length(protocol) || protocol || 'P' AS pid, pid || length(member) || member AS id FROM rows),
 graph AS (SELECT culture, namespace, min(pos) AS pos, id, any_value(pid) AS pid, any_value(protocol) AS protocol, any_value(home) AS home, any_value(member) AS member, nat, inferred, unavailable, location, said FROM ids GROUP BY culture, namespace, id, nat, inferred, unavailable, location, said),
 nats AS (SELECT culture, namespace, id, max(pos) AS pos, min(pos) AS first FROM graph WHERE nat GROUP BY ALL),
 legal AS (SELECT * FROM graph WHERE NOT nat AND inferred = culture AND home = culture AND (unavailable OR protocol LIKE '\\_%' ESCAPE '\\') QUALIFY row_number() OVER (PARTITION BY culture, namespace, id ORDER BY pos) = 1),
 counted AS (SELECT l.*, n.first FROM legal l LEFT JOIN nats n USING (culture, namespace, id) WHERE n.first IS NULL OR l.pos < n.first),
 met AS (SELECT culture, namespace, 's' || length(culture) || culture || length(said) || said || 'P' AS id, said AS name FROM graph WHERE said LIKE '\\_%' ESCAPE '\\' UNION SELECT culture, namespace, pid, protocol FROM counted WHERE NOT unavailable)"""


def _member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, s, o = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_orderkey")
    module = lambda i: F.concat(F.lit("M"), (i % 25).cast("string"))
    name = lambda even, letter, i: F.concat(F.when(even, "_").otherwise(""), F.lit(letter), i.cast("string"))
    protocol_id = lambda home, protocol: F.concat(F.lit("s"), F.length(home), home, F.length(protocol), protocol, F.lit("P"))
    member = F.concat(F.lit("m"), (k % 90).cast("string"))
    home = F.when(n % 3 > 0, module(s)).otherwise(module(s + 7))
    pid = protocol_id(home, name(k % 40 % 2 == 0, "P", k % 40))
    said = protocol_id(module(s), name(o % 2 == 0, "Q", o % 11))
    rows = A.table(spark, sf_dir, "lineitem").select(
        module(s).alias("culture"), F.when(n == 1, module(s + 1)).otherwise(module(s)).alias("namespace"), (o * 100_000 + n * 10_000 + k % 10_000).alias("pos"), F.concat(pid, F.length(member), member).alias("id"),
        F.when(o % 7 != 0, F.when(o % 4 == 0, module(s + 3)).otherwise(module(s))).alias("inferred"), F.array(F.lit("Type"), member).alias("path"), F.lit("instanceMethod").alias("community"), (o % 3 == 0).alias("unavailable"), F.when(o % 5 < 2, o).alias("location"), F.when(o % 3 == 1, F.array(said)).alias("mentions"),
    )
    kept = [c for c in rows.columns if c != "pos"]
    return rows.groupBy(*kept).agg(F.min("pos").alias("pos"))


@query("WITH " + _MEMBERS + """ SELECT 'vertex' AS kind, culture, namespace, id, 'Type.' || any_value(member) AS a, 'natural' AS b, n.pos FROM nats n JOIN graph g USING (culture, namespace, id) GROUP BY culture, namespace, id, n.pos
 UNION ALL SELECT 'vertex', culture, namespace, id, protocol || '.' || member, 'inferred', pos FROM counted WHERE first IS NULL
 UNION ALL SELECT DISTINCT 'vertex', culture, namespace, id, name, 'placeholder', NULL::BIGINT FROM met WHERE (culture, namespace, id) NOT IN (SELECT (culture, namespace, id) FROM nats)
 UNION ALL SELECT 'edge', culture, namespace, id, 'member', pid, NULL FROM counted
 UNION ALL SELECT 'location', culture, namespace, id, location::VARCHAR, NULL, NULL FROM graph WHERE nat AND location IS NOT NULL UNION ALL SELECT 'location', culture, namespace, id, location::VARCHAR, NULL, NULL FROM counted WHERE location IS NOT NULL""")
def naturalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, at = vertices.naturalize(_member_rows(spark, sf_dir))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    v = v.select(F.lit("vertex").alias("kind"), "culture", "namespace", "id", F.array_join("path", ".").alias("a"), F.col("origin").alias("b"), "pos")
    e = e.select(F.lit("edge").alias("kind"), "culture", "namespace", F.col("source").alias("id"), F.col("relation").alias("a"), F.col("target").alias("b"), number.alias("pos"))
    at = at.select(F.lit("location").alias("kind"), "culture", "namespace", "id", F.col("location").cast("string").alias("a"), none.alias("b"), number.alias("pos"))
    return v.unionByName(e).unionByName(at)


@query(with_tables("packages", "modules", "module_deps", "symbols", "edges", then=SCOPES + """, links AS (SELECT e.source AS symbol, s.culture, e.pos, e.relation, t.name AS link, e.target % 2 = 0 AS generic FROM edges e JOIN symbols s ON s.symbol = e.source JOIN symbols t ON t.symbol = e.target),
 known AS (SELECT i.culture, i.link, min(s.symbol) AS symbol FROM (SELECT DISTINCT culture, link FROM links) i JOIN symbols s ON s.name = i.link JOIN scopes x ON x.culture = i.culture AND x.namespace = s.culture GROUP BY i.culture, i.link HAVING count(DISTINCT s.symbol) = 1),
 found AS (SELECT l.*, k.symbol AS target FROM links l LEFT JOIN known k ON k.culture = l.culture AND k.link = l.link)
 SELECT 'fragment' AS part, symbol, pos, link AS text, target FROM found WHERE relation <> 'conformer' UNION ALL SELECT CASE WHEN generic THEN 'generic' ELSE 'extension' END, symbol, pos, 'Self conforms ' || link, target FROM found WHERE relation = 'conformer'
 UNION ALL SELECT DISTINCT 'warning', symbol, NULL::BIGINT, link, NULL::BIGINT FROM found WHERE target IS NULL AND link LIKE 's%'"""))
def resolve_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = A.symbols(spark, sf_dir), A.edges(spark, sf_dir)
    ends = e.join(s.select(F.col("symbol").alias("source"), "culture"), "source").join(s.select(F.col("symbol").alias("target"), F.col("name").alias("link")), "target")
    told = ends.select(F.col("source").alias("symbol"), "culture", "pos", "relation", F.col("link").alias("text"), "link", F.when(F.col("target") % 2 == 0, "generic").otherwise("extension").alias("list"), F.lit("Self").alias("subject"), F.lit("conforms").alias("verb"))
    known = facts.resolve_identifiers(told.select("culture", F.col("link").alias("id")).distinct(), s.select(F.col("name").alias("id"), "symbol", F.col("culture").alias("module")), _scopes(spark, sf_dir))
    pieces, bounds, warnings = vertices.resolve_declarations(told.filter("relation <> 'conformer'"), told.filter("relation = 'conformer'"), known)
    none = F.lit(None).cast("bigint")
    rows = pieces.select(F.lit("fragment").alias("part"), "symbol", "pos", "text", "target")
    rows = rows.unionByName(bounds.select(F.col("list").alias("part"), "symbol", "pos", F.concat_ws(" ", "subject", "verb", "text").alias("text"), "target"))
    return rows.unionByName(warnings.select(F.lit("warning").alias("part"), "symbol", none.alias("pos"), F.col("link").alias("text"), none.alias("target")))


@query("""WITH e AS (SELECT doc_id AS extension, doc_id AS pos, CASE WHEN doc_id % 4 > 0 THEN doc_id % 97 END AS target FROM documents)
 SELECT extension, target, CASE WHEN target IS NULL THEN 'unknown' WHEN pos = max(pos) OVER (PARTITION BY target) THEN 'bound' ELSE 'lost' END AS status FROM e""")
def bind_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("extension"), F.col("doc_id").alias("pos"))
    return vertices.bind_extensions(d, d.filter("extension % 4 > 0").select("extension", (F.col("extension") % 97).alias("target")))


COMPOSITES = "composites AS (SELECT symbol AS base, symbol AS host, culture FROM symbols UNION SELECT object, subject, culture FROM traits WHERE slot = 'feature')"


def _composites(spark: SparkSession, sf_dir: str, statements: DataFrame) -> DataFrame:
    """Every symbol at its own place, and features at their hosts."""
    natural = A.symbols(spark, sf_dir).select(F.col("symbol").alias("base"), F.col("symbol").alias("host"), "culture")
    features = facts.traits(statements).filter("slot = 'feature'").select(F.col("object").alias("base"), F.col("subject").alias("host"), "culture")
    return natural.unionByName(features).distinct()


@query(with_tables(*_FACT_TABLES, then=TRAITS + ", " + COMPOSITES + """ SELECT c.base, c.host, c.culture, y.name AS title, y.community AS kind, m.name AS culture_name, CASE WHEN h.culture <> c.culture THEN a.name END AS namespace, CASE WHEN y.culture <> c.culture THEN b.name END AS base_module
 FROM composites c JOIN symbols y ON y.symbol = c.base JOIN symbols h ON h.symbol = c.host LEFT JOIN modules m ON m.module = c.culture LEFT JOIN modules a ON a.module = h.culture LEFT JOIN modules b ON b.module = y.culture"""))
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _composites(spark, sf_dir, _statements(spark, sf_dir))
    return vertices.page_facts(found, A.symbols(spark, sf_dir), A.modules(spark, sf_dir))


@query(with_tables(*_FACT_TABLES, then=TRAITS + ", " + SHAPES + ", " + ROLES + ", " + COMPOSITES + ", " + PATHS + """,
 page AS (SELECT c.*, y.class, s.shape, s.parent FROM composites c JOIN symbols y ON y.symbol = c.base LEFT JOIN shapes s ON s.symbol = c.base),
 up AS (SELECT r.subject, r.slot, r.object, t.name, t.path, t.community FROM roles r JOIN symbols o ON o.symbol = r.object LEFT JOIN shapes s ON s.symbol = r.object
   JOIN paths t ON t.symbol = coalesce(CASE WHEN o.class IN ('callable', 'associatedtype') THEN s.parent END, r.object)),
 told AS (SELECT base, host, g.culture, 0 AS section, NULL::VARCHAR[] AS path, base AS link, 'Available because Self conforms to ' || t.name || '.' AS note FROM page g JOIN symbols t ON t.symbol = g.parent WHERE shape = 'member' AND base <> host
   UNION ALL SELECT base, host, culture, 0, NULL, NULL, 'Required.' FROM page WHERE shape = 'requirement'
   UNION ALL SELECT DISTINCT base, host, g.culture, 1, u.path, u.object, CASE WHEN shape = 'requirement' THEN 'Restates requirement of ' WHEN u.community = 'protocol' THEN 'Implements requirement of ' ELSE 'Overrides member of ' END || u.name || '.' FROM page g JOIN up u ON u.subject = g.base
     WHERE (shape = 'requirement' AND slot = 'override') OR (shape = 'member' AND base = host AND class = 'callable' AND slot IN ('override', 'implementation') AND u.community IN ('protocol', 'class'))
   UNION ALL SELECT base, host, culture, 2, NULL, NULL, CASE p_size % 4 WHEN 1 THEN 'Available when A conforms to ' || p_brand || '.' WHEN 2 THEN 'Available when A conforms to ' || p_brand || ' and B is ' || p_type || '.'
     ELSE 'Available when A conforms to ' || p_brand || ', B is ' || p_type || ', and C inherits from ' || p_name || '.' END FROM page JOIN part ON p_partkey = base WHERE p_size % 4 > 0)
 SELECT base, host, culture, row_number() OVER (PARTITION BY base, host, culture ORDER BY section, path, link, note) AS rank, note, link FROM told"""))
def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = stored(_statements(spark, sf_dir), "statements")
    bound = lambda subject, verb, of: F.struct(F.lit(subject).alias("subject"), F.lit(verb).alias("verb"), F.col(of).alias("object"))
    every = F.array(bound("A", "conforms", "p_brand"), bound("B", "is", "p_type"), bound("C", "subclasses", "p_name"))
    bounds = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.slice(every, F.lit(1), F.col("p_size") % 4).alias("constraints"))
    return vertices.page_notes(_composites(spark, sf_dir, said), _paths(spark, sf_dir), shapes.first_shapes(said), shapes.role_rows(said), bounds)


@query(with_tables(*_FACT_TABLES, then=TRAITS + ", " + COMPOSITES + ", " + PATHS + """, crumbs AS (SELECT c.base, c.host, c.culture, unnest(p.trail) AS ancestor, generate_subscripts(p.trail, 1) - 1 AS level FROM composites c JOIN paths p ON p.symbol = c.host)
 SELECT base, host, culture, level::INT AS level, ancestor FROM crumbs WHERE base <> host OR ancestor <> base"""))
def composite_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.composite_breadcrumbs(_composites(spark, sf_dir, _statements(spark, sf_dir)), _paths(spark, sf_dir))


@query(None)
def doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    text = F.concat(F.lit("@import(m)\n# Title "), "doc_id", F.lit("\n\n"), "text", F.lit("\n\n- Note: see ``Target"), "doc_id", F.lit("``\n- Parameter x: the value\n- Returns: it\n## Details\nmore\n```\ncode\n```\n"))
    return split_fields(d.select("doc_id", text.alias("text")), "doc_id", "text")
