"""Queries over pages and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.identity import classify_fragments, is_usable
from docgraph.functions.storage import stored
from docgraph.operators import links, pages, routes, shapes, uris
from docgraph.plans import adapters as A
from docgraph.plans.adapters import with_tables
from docgraph.plans.queries_core import _FACT_TABLES, BELIEFS, ROLES, SHAPES, _beliefs, _statements, _written
from docgraph.plans.queries_routes import DEPTHS, NATURAL, PATHS, SYNTHETIC, _paths, _routes
from docgraph.plans.registering import query

#: Kinds of hosts, the slots that they list, and the sections' numbers; a member that is not usable is in section 11.
TOPICS = BELIEFS + ", " + SHAPES + ", " + ROLES + """, usable AS (SELECT p_partkey AS symbol, p_size % 9 > 2 AS usable FROM part),
 listed(kind, slot, n) AS (VALUES ('requirement', 'override', 3), ('requirement', 'implementation', 2), ('protocol', 'conformer', 7), ('protocol', 'refinement', 1), ('protocol', 'member', 6),
   ('concrete', 'conformance', 8), ('concrete', 'subclass', 9), ('concrete', 'member', 6), ('concrete', 'feature', 6), ('callable', 'override', 4)),
 topics AS (SELECT b.subject AS host, CASE WHEN l.n = 6 AND NOT u.usable THEN 11 ELSE l.n END AS section, CASE belief WHEN 'primary' THEN 0 WHEN 'accepted' THEN 1 ELSE 2 END AS culture_class, b.culture, b.object AS target,
   CASE WHEN b.slot = 'feature' THEN b.subject ELSE b.object END AS target_host, b.conditions
   FROM beliefs b JOIN symbols h ON h.symbol = b.subject LEFT JOIN shapes s ON s.symbol = b.subject JOIN usable u ON u.symbol = b.object
   JOIN listed l ON l.slot = b.slot AND l.kind = CASE WHEN s.shape = 'requirement' THEN 'requirement' ELSE h.class END
   UNION ALL SELECT DISTINCT r.subject, CASE WHEN t.class = 'protocol' THEN 10 ELSE 5 END, 0, h.culture, r.object, r.object, '' FROM roles r JOIN symbols h ON h.symbol = r.subject AND h.class = 'protocol' JOIN symbols t ON t.symbol = r.object)"""
URIS = PATHS + ", " + NATURAL + ", " + SYNTHETIC + ", " + DEPTHS + """, uris AS (SELECT d.base, d.host, d.culture, CASE WHEN p.rank = 2 THEN '/' || p.name ELSE '' END || '/' || replace(lower(m.name), ' ', '%20')
   || CASE WHEN stem = '' THEN '' ELSE '/' || replace(stem, chr(9), '/') END || CASE WHEN orientation = '.' AND stem <> '' THEN '.' ELSE '/' END || leaf
   || CASE WHEN need_base OR need_host THEN '?' ELSE '' END || CASE WHEN need_base THEN 'overload=s' || base ELSE '' END || CASE WHEN need_host THEN CASE WHEN need_base THEN '&' ELSE '' END || 'self=s' || host ELSE '' END AS uri
   FROM depths d JOIN modules m ON m.module = d.namespace JOIN packages p USING (package))"""
INDEX = """, idx AS (SELECT m.package, p.culture AS module, p.symbol, p.class, array_to_string(p.path, '.') AS title, array_to_string(CASE WHEN p.class = 'global' THEN [p.name, t.p_brand] ELSE [p.name] END, ',') AS keywords, u.uri
   FROM paths p JOIN part t ON t.p_partkey = p.symbol JOIN modules m ON m.module = p.culture JOIN uris u ON u.base = p.symbol AND u.host = p.symbol WHERE p.symbol % 11 <> 0)"""
_WITH_TRAITS = BELIEFS


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = stored(_statements(spark, sf_dir), "statements")
    s = A.symbols(spark, sf_dir)
    size = F.col("p_size") % 9
    standing = is_usable(F.when(size == 0, "unavailable").when(size == 1, "deprecated"), F.when(size == 2, "5.1"), F.lit(None).cast("string"))
    usable = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), standing.alias("usable"))
    return pages.topics(_beliefs(spark, sf_dir, said), shapes.role_rows(said), shapes.first_shapes(said), s, usable)


@query(with_tables(*_FACT_TABLES, then=TOPICS + " SELECT host, section, culture_class, culture, target, target_host, conditions FROM topics"))
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topics(spark, sf_dir).withColumn("conditions", _written("conditions"))


@query(with_tables(*_FACT_TABLES, then=TOPICS + ", " + PATHS + """, cards AS (SELECT host, section, culture_class, t.culture, 'symbol' AS kind, target, path FROM topics t JOIN paths p ON p.symbol = target
   UNION ALL SELECT y.symbol, 6, 0, y.culture, 'article', doc_id, ['doc-' || doc_id % 40] FROM documents JOIN symbols y ON y.symbol = doc_id * 7 % (SELECT max(p_partkey) + 1 FROM part))
 SELECT host, section, culture_class, culture, kind, target, (row_number() OVER (PARTITION BY host, section ORDER BY culture_class, culture, kind, path[-1], path[1:len(path) - 1], target))::INT AS rank FROM cards"""))
def sort_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    home = A.symbols(spark, sf_dir).select(F.col("symbol").alias("host"), "culture")
    texts = A.table(spark, sf_dir, "documents").select((F.col("doc_id") * 7 % n).alias("host"), F.col("doc_id").alias("article"), F.array(F.concat(F.lit("doc-"), (F.col("doc_id") % 40).cast("string"))).alias("path"))
    articles = texts.join(home, "host").withColumns({"section": F.lit(pages.SECTIONS["member"]), "culture_class": F.lit(0)})
    return pages.sort_cards(_topics(spark, sf_dir), _paths(spark, sf_dir), articles)


@query(with_tables(*_FACT_TABLES, then=BELIEFS + ", " + PATHS + """ SELECT b.subject, b.culture, b.slot, b.object, (row_number() OVER (PARTITION BY b.subject, b.slot, b.culture ORDER BY p.path, b.object))::INT AS rank FROM beliefs b JOIN paths p ON p.symbol = b.object"""))
def sort_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sort_relations(_beliefs(spark, sf_dir), _paths(spark, sf_dir))


@query(with_tables(*_FACT_TABLES, then=TOPICS + """, lists AS (SELECT t.host, t.section, CASE WHEN t.section IN (5, 6, 11) THEN y.community END AS sublist, t.culture_class, t.culture, count(*) AS cards FROM topics t JOIN symbols y ON y.symbol = t.target GROUP BY ALL)
 SELECT host, section, sublist, culture_class, l.culture, cards, (row_number() OVER (PARTITION BY host ORDER BY section, coalesce(list_position(['case', 'associatedtype', 'typealias', 'initializer', 'deinitializer', 'typeSubscript', 'instanceSubscript', 'typeProperty', 'instanceProperty', 'typeMethod', 'instanceMethod', 'var', 'func', 'operator', 'typeOperator', 'enum', 'struct', 'class', 'actor', 'protocol'], sublist), 0), culture_class, CASE WHEN culture_class = 2 THEN m.package ELSE -1 END, lower(m.name), l.culture))::INT AS rank
 FROM lists l JOIN modules m ON m.module = l.culture"""))
def sort_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.sort_sections(_topics(spark, sf_dir), A.symbols(spark, sf_dir), A.modules(spark, sf_dir), A.packages(spark, sf_dir))


@query(with_tables("modules", then="SELECT package, module, (row_number() OVER (PARTITION BY package ORDER BY lower(name), module))::INT AS rank FROM modules", wide=True))
def module_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.module_list(A.modules(spark, sf_dir, wide=True))


def _uris(spark: SparkSession, sf_dir: str, paths: DataFrame) -> DataFrame:
    return routes.composite_uri(routes.overload_depth(_routes(spark, sf_dir, paths)), A.modules(spark, sf_dir), A.packages(spark, sf_dir))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, fragments): a keyword and the name; a function's argument, labelled by the brand, and its type."""
    piece = lambda kind, spelling: F.struct(F.lit(kind).alias("kind"), spelling.alias("spelling"))
    s = A.symbols(spark, sf_dir).join(A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), "p_brand", "p_type"), "symbol")
    head = F.array(piece("keyword", F.col("community")), piece("text", F.lit(" ")), piece("identifier", F.col("name")))
    tail = F.array(piece("text", F.lit("(")), piece("externalParam", F.col("p_brand")), piece("text", F.lit(": ")), piece("typeIdentifier", F.col("p_type")), piece("text", F.lit(")")))
    return s.select("symbol", classify_fragments(F.when(F.col("class") == "global", F.concat(head, tail)).otherwise(head)).alias("fragments"))


@query(with_tables(*_FACT_TABLES, then=_WITH_TRAITS + ", " + URIS + INDEX + " SELECT package, module, symbol, title, keywords, uri FROM idx WHERE class IN ('protocol', 'typealias', 'concrete', 'global')"))
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    found = pages.search_index(p, A.modules(spark, sf_dir), p.filter("symbol % 11 <> 0").select("symbol"), _uris(spark, sf_dir, p), _signatures(spark, sf_dir))
    return found.withColumn("keywords", F.array_join("keywords", ","))


@query(with_tables(*_FACT_TABLES, then=_WITH_TRAITS + ", " + URIS + INDEX + """, places AS (SELECT m.package, m.module, 'https://docs.example.com' || CASE WHEN p.rank = 2 THEN '/' || p.name ELSE '' END || '/' || replace(lower(m.name), ' ', '%20') AS line FROM modules m JOIN packages p USING (package))
 SELECT package, module, 0 AS kind, line FROM places UNION ALL SELECT package, module, 1, line || '/doc-' || doc_id % 40 FROM documents JOIN places ON module = doc_id % 25
 UNION ALL SELECT package, module, 2, 'https://docs.example.com' || uri FROM idx"""))
def sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    articles = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article"), (F.col("doc_id") % 25).cast("int").alias("culture"), F.concat(F.lit("doc-"), (F.col("doc_id") % 40).cast("string")).alias("name"))
    return pages.sitemap(A.modules(spark, sf_dir), A.packages(spark, sf_dir), articles, p, p.filter("symbol % 11 <> 0").select("symbol"), _uris(spark, sf_dir, p), "https://docs.example.com")


@query(with_tables("packages", "modules", then="""a AS (SELECT conv_id AS article, '# ' || string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
 t AS (SELECT article, string_split(text, chr(10))[1] AS head, regexp_replace(text[length(string_split(text, chr(10))[1]) + 2:], '^[ \n\r\t]+', '') AS rest FROM a),
 b AS (SELECT article, trim(regexp_replace(head, '^#+', ''), ' ') AS title, trim(string_split(rest, chr(10) || chr(10))[1], ' ') AS block FROM t)
 SELECT article, title, CASE WHEN regexp_matches(block, '^(#|[-*+>] |```|[0-9]+[.)] )') THEN '' ELSE regexp_replace(block, '[ \t\r]*\n[ \t\r]*', ' ', 'g') END AS snippet,
   'https://docs.example.com' || CASE WHEN module % 2 = 0 THEN '/texts/' || module ELSE '/learn' || CASE WHEN p.rank = 2 THEN '/' || p.name ELSE '' END || '/' || replace(lower(m.name), ' ', '%20') END || '/note-' || article AS link
 FROM b JOIN modules m ON m.module = article % 25 JOIN packages p USING (package)"""))
def article_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = A.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("article")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    texts = turns.select("article", F.concat(F.lit("# "), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")).alias("text"))
    named = turns.select("article", (F.col("article") % 25).cast("int").alias("module"), F.concat(F.lit("Note-"), F.col("article").cast("string")).alias("name"))
    modules, packages = A.modules(spark, sf_dir), A.packages(spark, sf_dir)
    latest = packages.select("package", F.lit(29).alias("ver"))
    moves = modules.select(F.lit("article").alias("kind"), "module", F.concat(F.lit("/texts/"), F.col("module").cast("string")).alias("uri"), F.when(F.col("module") % 2 == 0, 29).otherwise(20).alias("ver"))
    return pages.article_feed(texts, uris.latest_article_uris(named, modules, packages, moves, latest), "https://docs.example.com")


@query(with_tables(*_FACT_TABLES, then=BELIEFS + ", " + PATHS + ", " + NATURAL + ", " + SYNTHETIC + """, held AS (SELECT DISTINCT namespace, stem, leaf, orientation, base, host, culture FROM every),
 many AS (SELECT *, count(*) OVER (PARTITION BY namespace, stem, leaf, orientation) AS n FROM held)
 SELECT h.base, h.host, h.culture, (row_number() OVER (PARTITION BY namespace, stem, leaf, orientation ORDER BY p.name, lower(m.name), base, host))::INT AS rank FROM many h JOIN modules m ON m.module = h.culture JOIN packages p USING (package) WHERE n > 1"""))
def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.choices(routes.route_groups(_routes(spark, sf_dir)), A.modules(spark, sf_dir), A.packages(spark, sf_dir)).select("base", "host", "culture", "rank")


@query(with_tables("modules", "symbols", then="""f AS (SELECT o_orderkey AS query, arg_min(s.symbol, (m.package, s.symbol)) AS symbol FROM orders JOIN part p ON p.p_partkey = o_custkey % (SELECT count(*) FROM part) JOIN symbols s ON s.name = replace(p.p_name, ' ', '_') JOIN modules m ON m.module = s.culture WHERE m.package < 3 GROUP BY o_orderkey)
 SELECT o_orderkey AS query, symbol FROM orders LEFT JOIN f ON f.query = o_orderkey"""))
def resolve_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.symbols(spark, sf_dir).join(A.modules(spark, sf_dir).select(F.col("module").alias("culture"), "package"), "culture").select(F.col("name").alias("id"), "symbol", "package")
    part = A.table(spark, sf_dir, "part")
    n = part.count()
    ids = part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("id"))
    # part grows, and its compressed files say little of its rows: it is not broadcast
    q = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), (F.col("o_custkey") % n).alias("p_partkey")).join(ids.hint("merge"), "p_partkey", "left").select("query", "id")
    return links.resolve_by_rank(q, s, A.packages(spark, sf_dir).filter("package < 3").select("package", F.col("package").alias("rank")))
