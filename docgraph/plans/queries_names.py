"""Queries over names, identifiers, URIs and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import identity as I
from docgraph.functions import uri as U
from docgraph.plans import adapters as A
from docgraph.plans.registering import query


@query("SELECT n_nationkey AS module, repeat('_', n_nationkey % 3) || n_name AS raw, n_name AS title, lower(n_name) AS value FROM nation")
def normalize_module_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("module"), F.expr("concat(repeat('_', cast(n_nationkey % 3 as int)), n_name)").alias("raw"))
    return n.withColumn("v", I.normalize_module_id(F.col("raw"))).select("module", "raw", "v.title", "v.value")


_PACKAGE_NAMES = "names AS (SELECT c_custkey AS id, ['Swift-Stdlib', 'swift-core-libraries', 'STDLIB', 'Swift', 'core', lower(c_name), c_name, 'standard-library'][c_custkey % 8 + 1] AS raw FROM customer)"


@query(f"""WITH {_PACKAGE_NAMES}, k AS (SELECT id, raw, CASE WHEN lower(raw) IN ('swift-standard-library', 'standard-library', 'swift-stdlib', 'stdlib') THEN 0 WHEN lower(raw) IN ('swift-core-libraries') THEN 1 ELSE 2 END AS rank FROM names)
 SELECT id, ['swift', 'core', 'community'][rank + 1] AS kind, CASE rank WHEN 0 THEN 'swift' WHEN 1 THEN 'core' ELSE lower(raw) END AS name, rank FROM k""")
def normalize_package_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer")
    raw = F.element_at(F.array(*map(F.lit, ["Swift-Stdlib", "swift-core-libraries", "STDLIB", "Swift", "core"]), F.lower("c_name"), F.col("c_name"), F.lit("standard-library")), (F.col("c_custkey") % 8).cast("int") + 1)
    v = c.select(F.col("c_custkey").alias("id"), I.normalize_package_id(raw).alias("v"))
    return v.select("id", "v.kind", "v.name", "v.rank")


_USRS = "usrs AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 's:' || p_partkey || 'AB' WHEN 1 THEN 'c' || 'x@' || p_partkey WHEN 2 THEN 's:F' || p_partkey || '::SYNTHESIZED::s:H' || p_size WHEN 3 THEN 'q:' || p_partkey ELSE 's:a-' || p_partkey END AS usr FROM part)"


@query(f"""WITH {_USRS} SELECT id, CASE id % 5 WHEN 0 THEN 's' || id || 'AB' WHEN 1 THEN 'cx@' || id WHEN 2 THEN 'sF' || id END AS base, CASE id % 5 WHEN 2 THEN 'sH' || p_size END AS host FROM usrs JOIN part ON p_partkey = id""")
def parse_usr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE p_partkey % 5 WHEN 0 THEN concat('s:', p_partkey, 'AB') WHEN 1 THEN concat('cx@', p_partkey) WHEN 2 THEN concat('s:F', p_partkey, '::SYNTHESIZED::s:H', p_size) WHEN 3 THEN concat('q:', p_partkey) ELSE concat('s:a-', p_partkey) END AS usr")
    return p.withColumn("v", I.parse_usr(F.col("usr"))).select("id", "v.base", "v.host")


@query("""WITH m AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, replace(p_brand, '#', '') AS brand FROM part)
 SELECT id, CASE id % 4 WHEN 0 THEN 'Swift' WHEN 1 THEN brand WHEN 2 THEN 'Ext' || (id % 7) END AS culture, CASE WHEN id % 4 < 3 THEN name END AS protocol,
  CASE id % 4 WHEN 0 THEN 'ss' || length(name) || name || 'P' WHEN 1 THEN 's' || length(brand) || brand || length(name) || name || 'P' WHEN 2 THEN 's' || length(brand) || brand || length(name) || name || 'P' END AS id_text FROM m""")
def usr_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "replace(p_name, ' ', '_') AS name", "replace(p_brand, '#', '') AS brand")
    usr = m.selectExpr("id", "CASE id % 4 WHEN 0 THEN concat('ss', length(name), name, 'PsE4findyF') WHEN 1 THEN concat('s', length(brand), brand, length(name), name, 'P4findyF') WHEN 2 THEN concat('s', length(brand), brand, length(name), name, 'P4Ext', id % 7, 'E4findyF') ELSE concat('s0', name, 'P') END AS usr")
    return usr.withColumn("v", I.usr_interface(F.col("usr"))).select("id", "v.culture", "v.protocol", F.col("v.id").alias("id_text"))


@query("""SELECT l_linenumber AS line, l_suppkey AS supp, CASE WHEN l_linenumber = 1 THEN 'protocol' WHEN l_linenumber = 2 THEN 'struct' WHEN l_linenumber = 3 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'operator' ELSE 'typeOperator' END WHEN l_linenumber = 4 THEN 'initializer' WHEN l_linenumber = 5 THEN 'case' WHEN l_linenumber = 6 THEN 'typeMethod' END AS community, count(*) AS n FROM lineitem GROUP BY ALL""")
def decode_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = A.table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ["swift.protocol", "swift.struct", "swift.func.op", "swift.init", "swift.enum.case", "swift.type.method", "swift.macro"])), F.col("l_linenumber").cast("int"))
    path = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return line.select(F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), I.decode_community(kind, path).alias("community")).groupBy("line", "supp", "community").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS t, CASE WHEN doc_id % 2 = 0 THEN doc_id // 2 END AS origin FROM documents)
 SELECT id, CASE WHEN coalesce(t, '') = '' AND origin IS NULL THEN 'none' WHEN coalesce(t, '') = '' THEN 'inherits' ELSE 'extends' END AS state, origin, nullif(t, '') AS comment FROM c""")
def assemble_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    lines = F.when(F.col("doc_id") % 3 != 0, F.split("text", "\n"))
    return d.select(F.col("doc_id").alias("id"), I.assemble_comment(lines, F.when(F.col("doc_id") % 2 == 0, F.expr("doc_id div 2"))).alias("v")).select("id", "v.state", "v.origin", "v.comment")


@query("""SELECT p_partkey AS id, 'keywordIdentifier:init identifier:' || p_name || ' -:(' || CASE WHEN p_size % 2 = 0 THEN ' keywordText:let type:' || p_brand ELSE '' END AS colored FROM part""")
def classify_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("spelling"))
    p = A.table(spark, sf_dir, "part")
    base = F.array(f("keyword", F.lit("init")), f("identifier", F.col("p_name")), f("unknown", F.lit("(")))
    more = F.when(F.col("p_size") % 2 == 0, F.concat(base, F.array(f("keyword", F.lit("let")), f("typeIdentifier", F.col("p_brand"))))).otherwise(base)
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.transform(I.classify_fragments(more), lambda x: F.concat_ws(":", F.coalesce(x["color"], F.lit("-")), x["text"])), " ").alias("colored"))


@query("SELECT doc_id AS id, quality = 1 AND NOT (toxic = 1) AND doc_id % 7 <> 0 AS usable FROM labels")
def is_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = A.table(spark, sf_dir, "labels")
    general = F.when(F.col("quality") == 0, "deprecated")
    return lab.select(F.col("doc_id").alias("id"), I.is_usable(general, F.when(F.col("toxic") == 1, "5.1"), F.when(F.col("doc_id") % 7 == 0, "5.2")).alias("usable"))


@query("""SELECT p_partkey AS id, CASE p_size % 4 WHEN 1 THEN 'Available when A conforms to ' || p_brand || '.' WHEN 2 THEN 'Available when A conforms to ' || p_brand || ' and B is ' || p_type || '.'
 WHEN 3 THEN 'Available when A conforms to ' || p_brand || ', B is ' || p_type || ', and C inherits from ' || p_name || '.' END AS sentence FROM part""")
def constraint_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda s, v, o: F.struct(F.lit(s).alias("subject"), F.lit(v).alias("verb"), F.col(o).alias("object"))
    every = F.array(c("A", "conforms", "p_brand"), c("B", "is", "p_type"), c("C", "subclasses", "p_name"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), I.constraint_sentence(F.slice(every, F.lit(1), F.col("p_size") % 4)).alias("sentence"))


@query("SELECT DISTINCT (l_orderkey * 7 + l_suppkey) % (SELECT max(p_partkey) * 2 FROM part) AS id FROM lineitem EXCEPT SELECT p_partkey FROM part")
def outlined_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "part").agg(F.max("p_partkey") * 2).first()[0]
    return I.outlined_ids(A.table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("id")), A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


_PATHS = r"""urls AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS rest FROM pages),
 paths AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') || ['', '/../x%20y', '/./z', '//%2E%2E/q', '/a\b/../..'][page_id % 5 + 1] AS path, regexp_extract(rest, '\?([^#]*)', 1) AS query FROM urls)"""


_NORMAL = r"""parts AS (SELECT page_id, query, list_transform(string_split(replace(path, '\', '/'), '/'), lambda x: {'c': [x], 'f': 0::BIGINT}) AS s FROM paths),
 reduced AS (SELECT page_id, query, list_reduce(list_prepend({'c': []::VARCHAR[], 'f': 0::BIGINT}, s), lambda acc, x: CASE
   WHEN x.c[1] IN ('', '.') THEN {'c': acc.c, 'f': len(acc.c)}
   WHEN x.c[1] = '..' THEN {'c': acc.c[1:greatest(len(acc.c) - 1, 0)], 'f': greatest(len(acc.c) - 1, 0)::BIGINT}
   ELSE {'c': list_append(acc.c, url_decode(x.c[1])), 'f': acc.f} END) AS v FROM parts)"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["", "/../x%20y", "/./z", "//%2E%2E/q", "/a\\b/../.."]
    rest = F.regexp_replace("url", "^https?://[^/]*", "")
    return A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract(rest, "^[^?#]*", 0), F.element_at(F.array(*map(F.lit, tails)), (F.col("page_id") % 5).cast("int") + 1)).alias("path"), F.regexp_extract(rest, r"\?([^#]*)", 1).alias("query"))


@query(f"WITH {_PATHS}, p AS (SELECT page_id, path FROM paths), x AS (SELECT page_id, unnest(string_split(replace(path, '\\', '/'), '/')) AS s, generate_subscripts(string_split(replace(path, '\\', '/'), '/'), 1) AS i FROM p) SELECT page_id, count(*) FILTER (WHERE s NOT IN ('', '.', '..')) AS names, count(*) FILTER (WHERE s = '..') AS pops FROM x GROUP BY page_id")
def uri_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _paths(spark, sf_dir).select("page_id", F.explode(F.split(F.regexp_replace("path", r"\\", "/"), "/")).alias("s"))
    return s.groupBy("page_id").agg(F.count(F.when(~F.col("s").isin("", ".", ".."), 1)).alias("names"), F.count(F.when(F.col("s") == "..", 1)).alias("pops"))


@query(f"""WITH {_PATHS}, {_NORMAL} SELECT page_id, array_to_string(v.c, '|') AS components, v.f::INT AS fold,
 coalesce(array_to_string(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&'), '') AS params FROM reduced""")
def normalize_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _paths(spark, sf_dir).withColumn("v", U.path_components(F.col("path")))
    return v.select("page_id", F.array_join("v.components", "|").alias("components"), F.col("v.fold").alias("fold"), F.array_join(F.transform(U.query_parameters(F.col("query")), lambda p: F.concat_ws("=", p["key"], p["value"])), "&").alias("params"))


@query("SELECT p_partkey AS id, '/' || replace(p_name, ' ', '%20') || '/' || replace(p_brand, '#', '%23') || '/' || replace(p_type, ' ', '%20') || '%2A~:' AS uri FROM part")
def encode_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), U.encode_uri(F.array("p_name", "p_brand", F.concat("p_type", F.lit("*~:")))).alias("uri"))


@query("SELECT l_orderkey AS a, l_linenumber AS b, l_suppkey AS c, l_partkey % 2 = 0 AND l_suppkey <> l_partkey AS same, count(*) AS n FROM lineitem GROUP BY ALL")
def uri_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda k, v: F.struct(k.cast("string").alias("key"), v.cast("string").alias("value"))
    x, y = F.col("l_suppkey"), F.col("l_partkey")
    left, right = F.array(p(x, y), p(y, x)), F.array(p(y, x), p(x, y))
    path = F.array(F.lit("m"))
    same = U.uri_equivalent(path, left, F.when(y % 2 == 0, path).otherwise(F.array(F.lit("n"))), right)
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_suppkey").alias("c"), same.alias("same")).groupBy("a", "b", "c", "same").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN n WHEN 1 THEN 'T' || p_size || ',' || n || '(_:)' WHEN 2 THEN n || '(x:)' WHEN 3 THEN n WHEN 4 THEN n END AS segments,
 CASE WHEN p_partkey % 5 IN (0, 4) THEN '/' ELSE '.' END AS orientation, CASE p_partkey % 5 WHEN 4 THEN 'swift.struct' WHEN 2 THEN 'abc' END AS suffix FROM (SELECT *, replace(replace(p_name, ' ', '_'), '-', '_') AS n FROM part)""")
def parse_symbol_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part").withColumn("n", F.translate("p_name", " -", "__"))
    link = F.expr("CASE p_partkey % 5 WHEN 0 THEN n WHEN 1 THEN concat('T', p_size, '.', n, '(_:)') WHEN 2 THEN concat('.', n, '(x:)-abc') WHEN 3 THEN concat('.', n) ELSE concat(n, '-swift.struct') END")
    v = p.select(F.col("p_partkey").alias("id"), U.parse_symbol_link(link).alias("v"))
    return v.select("id", F.array_join("v.segments", ",").alias("segments"), "v.orientation", "v.suffix")


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'community' WHEN 1 THEN 'hash' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 'swift.struct' WHEN 1 THEN ((o_custkey % 36) * 36 + o_custkey // 36 % 36)::VARCHAR END AS value FROM orders""")
def parse_disambiguator(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    digit = lambda n: F.lower(F.conv(n.cast("string"), 10, 36))
    suffix = F.when(F.col("o_orderkey") % 3 == 0, "swift.struct").when(F.col("o_orderkey") % 3 == 1, F.concat(digit(F.col("o_custkey") % 36), digit(F.expr("o_custkey div 36 % 36")))).otherwise("zzzzzzz")
    return o.select(F.col("o_orderkey").alias("id"), U.parse_disambiguator(suffix, list(I.KINDS)).alias("v")).select("id", "v.kind", "v.value")


@query("""SELECT o_orderkey AS id, 's' || o_custkey AS base, CASE WHEN o_orderkey % 2 = 0 THEN 'h' || o_orderkey ELSE 'own' END AS host, 'pkg' AS package, CASE WHEN o_orderkey % 3 = 0 THEN '0.1.' || o_custkey END AS version FROM orders""")
def parse_link_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("concat('x=1&overload=old&from=a&overload=s', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('&self=h', o_orderkey) ELSE '::SYNTHESIZED::own' END, '&from=pkg', CASE WHEN o_orderkey % 3 = 0 THEN concat('/0.1.', o_custkey) ELSE '' END)")
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), U.parse_link_query(U.query_parameters(q)).alias("v")).select("id", "v.base", "v.host", "v.package", "v.version")
