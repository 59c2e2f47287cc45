"""Queries over histories, versions, packages and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import versions as V
from docgraph.functions.storage import stored
from docgraph.operators import facts, history, packages
from docgraph.plans import adapters as A
from docgraph.plans.adapters import with_tables
from docgraph.plans.registering import query

KEYFRAMES = """
 marked AS (SELECT *, CASE WHEN lag(ver) OVER w = ver - 1 AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS fresh
   FROM observations WINDOW w AS (PARTITION BY entity ORDER BY ver)),
 islands AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY ver) AS island FROM marked),
 keyframes AS (SELECT entity, min(ver)::INT AS lo, max(ver)::INT AS hi, min(value) AS value FROM islands GROUP BY entity, island)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.push_history(A.observations(spark, sf_dir), ["entity"])


@query(with_tables("observations", then=KEYFRAMES + " SELECT entity, lo, hi, value FROM keyframes"))
def push_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("entity", "lo", "hi", "value")


@query(with_tables("observations", then=KEYFRAMES + """, points AS (SELECT DISTINCT entity, (entity * 7 + k * 5) % 32 AS ver FROM observations, (SELECT unnest(range(4)) AS k))
 SELECT p.entity, p.ver::INT AS ver, coalesce(value, '<unavailable>') AS value FROM points p LEFT JOIN keyframes k ON p.entity = k.entity AND p.ver BETWEEN lo AND hi"""))
def history_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = A.observations(spark, sf_dir).select("entity").distinct().select("entity", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((F.col("entity") * 7 + k * 5) % 32).cast("int"))).alias("ver")).distinct()
    return history.history_at(_history(spark, sf_dir), points, ["entity"], default=F.lit("<unavailable>")).select("entity", "ver", "value")


@query(with_tables("observations", then="SELECT DISTINCT entity, ver FROM observations"))
def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions_of(_history(spark, sf_dir), ["entity"])


@query(with_tables("modules", "observations", then="""o AS (SELECT DISTINCT entity // 3 AS host, (entity % 25)::INT AS culture, ver FROM observations),
 abroad AS (SELECT o.* FROM o JOIN modules a ON a.module = culture JOIN modules b ON b.module = host % 25 WHERE a.package <> b.package)
 SELECT host, culture, min(ver) AS lo, max(ver) AS hi FROM (SELECT *, ver - row_number() OVER (PARTITION BY host, culture ORDER BY ver) AS island FROM abroad) GROUP BY host, culture, island"""))
def pollen(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir).select(F.expr("entity div 3").alias("host"), (F.col("entity") % 25).cast("int").alias("culture"), "lo", "hi")
    homes = h.select(F.col("host").alias("symbol"), (F.col("host") % 25).cast("int").alias("culture")).distinct()
    return history.pollen(h, homes, A.modules(spark, sf_dir))


@query(with_tables("observations", then="SELECT entity, arg_max(value, ver) AS value, max(ver)::INT AS hi FROM observations GROUP BY entity"))
def current_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(_history(spark, sf_dir), ["entity"]).select("entity", "value", "hi")


_TEXTS = "texts AS (SELECT DISTINCT unnest([l_linenumber || '.' || (l_suppkey % 70000), l_linenumber || '', '2024-' || l_linenumber || '-' || (l_suppkey % 28 + 1) || '-b', 'v' || l_linenumber, l_suppkey || '.' || (l_orderkey * 9) || '.3.4', '2024-1-' || l_linenumber, 'swift-5.' || l_linenumber || '.' || (l_suppkey % 10) || '-RELEASE', 'swift-DEVELOPMENT-SNAPSHOT-2022-' || l_linenumber || '-03-a']) AS text FROM lineitem)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "lineitem").select(F.explode(F.array(*map(F.expr, [
        "concat(l_linenumber, '.', l_suppkey % 70000)", "concat(l_linenumber, '')", "concat('2024-', l_linenumber, '-', l_suppkey % 28 + 1, '-b')", "concat('v', l_linenumber)",
        "concat(l_suppkey, '.', l_orderkey * 9, '.3.4')", "concat('2024-1-', l_linenumber)", "concat('swift-5.', l_linenumber, '.', l_suppkey % 10, '-RELEASE')", "concat('swift-DEVELOPMENT-SNAPSHOT-2022-', l_linenumber, '-03-a')"]))).alias("text")).distinct()


_PARSED = r"""p AS (SELECT text, regexp_full_match(text, '[0-9]+(\.[0-9]+){0,3}') AS sem, regexp_full_match(text, '[0-9]+-[0-9]+-[0-9]+(-[a-z])?') AS dat FROM texts),
 q AS (SELECT text, sem, dat, string_split(text, CASE WHEN sem THEN '.' ELSE '-' END) AS parts FROM p),
 r AS (SELECT text, sem, dat, CASE WHEN sem OR dat THEN try_cast(parts[1] AS BIGINT) END AS a, CASE WHEN sem OR dat THEN try_cast(parts[2] AS BIGINT) END AS b, CASE WHEN sem OR dat THEN try_cast(parts[3] AS BIGINT) END AS c,
   CASE WHEN sem THEN try_cast(parts[4] AS BIGINT) WHEN dat AND len(parts) = 4 THEN ascii(parts[4]) END AS d FROM q),
 s AS (SELECT *, (sem OR dat) AND coalesce(a, 0) <= 65535 AND coalesce(b, 0) <= 65535 AND coalesce(c, 0) <= 65535 AND coalesce(d, 0) <= 65535 AS ok FROM r)"""


@query(f"""WITH {_TEXTS}, {_PARSED} SELECT text, CASE WHEN ok THEN CASE WHEN sem THEN 'semantic' ELSE 'toolchain' END END AS kind,
 CASE WHEN ok THEN CASE WHEN sem THEN concat_ws('.', a, b, c, d) ELSE concat_ws('-', a, b, c, chr(d::INT)) END END AS version FROM s""")
def parse_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return _texts(spark, sf_dir).withColumn("v", V.parse_version(F.col("text"))).select("text", v["kind"].alias("kind"), V.version_string(v).alias("version"))


@query(f"""WITH {_TEXTS} SELECT text, CASE WHEN regexp_full_match(text, 'swift-[0-9]+\\.[0-9]+(\\.[0-9]+)?-RELEASE') THEN regexp_extract(text, '[0-9.]+')
  WHEN regexp_full_match(text, 'swift-DEVELOPMENT-SNAPSHOT-[0-9]+-[0-9]+-[0-9]+(-[a-z])?') THEN regexp_replace(replace(text, 'swift-DEVELOPMENT-SNAPSHOT-', ''), '-0([0-9])', '-\\1', 'g') END AS version FROM texts""")
def parse_toolchain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("v", V.parse_toolchain(F.col("text"))).select("text", V.version_string(F.col("v")).alias("version"))


@query(f"""WITH {_TEXTS}, {_PARSED} SELECT text, CASE WHEN ok AND dat THEN concat_ws('-', a, b, c, chr(coalesce(d, 97)::INT)) WHEN ok THEN concat_ws('.', a, coalesce(b, 0), coalesce(c, 0), coalesce(d, 0)) ELSE '0.0.0.0' END AS version FROM s""")
def precise_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("v", V.precise_version(V.parse_version(F.col("text")))).select("text", V.version_string(F.col("v")).alias("version"))


@query(with_tables("versions", then="""masks AS (SELECT package, ver, mask FROM (SELECT package, ver, (ver % 3) AS a, CASE WHEN ver % 2 = 0 THEN ver % 3 END AS b FROM versions) m, LATERAL (SELECT a || coalesce('.' || b, '') AS mask))
 SELECT v.package, v.ver, count(*) FILTER (WHERE v.kind = 'semantic' AND v.a = m.ver % 3 AND (m.ver % 2 = 1 OR v.b = m.ver % 3)) AS n FROM versions v JOIN masks m USING (package) GROUP BY v.package, v.ver""", wide=True))
def match_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.versions(spark, sf_dir, wide=True)
    mask = F.struct(F.lit("semantic").alias("kind"), (F.col("ver") % 3).alias("a"), F.when(F.col("ver") % 2 == 0, F.col("ver") % 3).alias("b"), F.lit(None).cast("int").alias("c"), F.lit(None).cast("int").alias("d"))
    pairs = v.join(v.select("package", mask.alias("mask")), "package")
    hit = V.match_version(F.col("mask"), F.struct("kind", "a", "b", "c", "d"))
    return pairs.groupBy("package", "ver").agg(F.sum(hit.cast("long")).alias("n"))


_MASKS = """masked AS (SELECT package, ver, kind, n, CASE n WHEN 1 THEN concat_ws(':', kind, a) WHEN 2 THEN concat_ws(':', kind, a, b) WHEN 3 THEN concat_ws(':', kind, a, b, c) WHEN 4 THEN concat_ws(':', kind, a, b, c, d) END AS mask
   FROM versions, (SELECT unnest([0, 1, 2, 3, 4]) AS n) WHERE kind = 'semantic' OR n IN (0, 3, 4)),
 idx AS (SELECT package, mask, max(ver) AS ver FROM masked GROUP BY package, mask)"""


@query(with_tables("versions", then=_MASKS + " SELECT package, mask, ver FROM idx", wide=True))
def version_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.version_index(A.versions(spark, sf_dir, wide=True))


@query(with_tables("versions", then=_MASKS + """ SELECT m.package, m.ver, CASE WHEN m.ver <> max(m.ver) OVER (PARTITION BY m.package) THEN arg_min(m.mask, m.n) FILTER (WHERE m.n > 0 AND i.ver = m.ver) END AS mask
 FROM masked m LEFT JOIN idx i ON m.package = i.package AND m.mask = i.mask GROUP BY m.package, m.ver""", wide=True))
def abbreviate_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.abbreviate_version(A.versions(spark, sf_dir, wide=True))


@query(with_tables("versions", then="""l AS (SELECT package, ver, CASE WHEN kind = 'toolchain' THEN concat_ws('-', a, b, c) ELSE concat_ws('.', a, b, c) END
   || CASE WHEN count(*) OVER (PARTITION BY package, kind, a, b, c) > 1 THEN CASE WHEN kind = 'toolchain' THEN '-' || chr(d) ELSE '.' || d END ELSE '' END AS label FROM versions)
 SELECT package, ver, label, ver = CASE WHEN package * 9 - 3 < 0 THEN 0 ELSE least(package * 9 - 3, 29) END AS is_current FROM l""", wide=True))
def version_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.version_labels(A.versions(spark, sf_dir, wide=True), A.packages(spark, sf_dir, wide=True).select("package", (F.col("package") * 9 - 3).alias("ver")))


SCOPES = """ranked AS (SELECT module, rank FROM modules JOIN packages USING (package)),
 scopes AS (SELECT module AS culture, module AS namespace FROM modules UNION SELECT module, dep FROM module_deps
   UNION SELECT a.module, b.module FROM ranked a, ranked b WHERE b.rank < a.rank)"""


def _scopes(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return packages.module_scopes(*(t(spark, sf_dir, wide) for t in (A.modules, A.module_deps, A.packages)))


@query(with_tables("packages", "modules", "module_deps", then=SCOPES + " SELECT culture::INT AS culture, namespace::INT AS namespace FROM scopes", wide=True))
def module_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scopes(spark, sf_dir, wide=True)


@query(with_tables("packages", "modules", "module_deps", then=SCOPES + """ SELECT culture::INT AS culture, namespace::INT AS namespace FROM scopes
 WHERE culture = namespace OR (culture + namespace) % 3 = 0 OR namespace IN (SELECT module FROM modules WHERE package = 0)""", wide=True))
def import_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scopes(spark, sf_dir, wide=True)
    return packages.import_scope(s, s.filter((F.col("culture") + F.col("namespace")) % 3 == 0), A.modules(spark, sf_dir, wide=True).filter("package = 0").select(F.col("module").alias("namespace")))


@query(with_tables("modules", "module_deps", then="""inside AS (SELECT d.module, d.dep FROM module_deps d JOIN modules a USING (module) JOIN modules b ON b.module = d.dep WHERE a.package = b.package),
 walk AS (SELECT module, 0 AS depth FROM modules UNION SELECT i.module, w.depth + 1 FROM walk w JOIN inside i ON i.dep = w.module)
 SELECT module, max(depth)::INT AS depth FROM walk GROUP BY module""", wide=True))
def module_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.module_order(A.modules(spark, sf_dir, wide=True), A.module_deps(spark, sf_dir, wide=True))


PINS = _MASKS + """, pairs AS (SELECT DISTINCT a.package, b.package AS dep FROM scopes JOIN modules a ON a.module = culture JOIN modules b ON b.module = namespace WHERE a.package <> b.package),
 pins AS (SELECT p.package, p.dep, coalesce(l.ver, n.ver)::INT AS dep_ver FROM pairs p LEFT JOIN idx l ON l.package = p.dep AND (p.package + p.dep) % 2 = 0 AND l.mask = 'semantic:1:' || (p.package % 3)
   JOIN idx n ON n.package = p.dep AND n.mask IS NULL)"""


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins of packages whose lockfiles name every other dependency, some at versions that do not exist."""
    pairs = stored(packages.upstream_packages(_scopes(spark, sf_dir, wide=True), A.modules(spark, sf_dir, wide=True)), "upstream")
    wanted = pairs.filter("(package + dep) % 2 = 0").withColumn("mask", F.concat(F.lit("semantic:1:"), (F.col("package") % 3).cast("string")))
    return packages.upstream_pins(pairs, wanted, V.version_index(A.versions(spark, sf_dir, wide=True)))


@query(with_tables("packages", "modules", "module_deps", "versions", then=SCOPES + ", " + PINS + " SELECT package, dep, dep_ver FROM pins", wide=True))
def upstream_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pins(spark, sf_dir)


@query(with_tables("packages", "modules", "module_deps", "versions", then=SCOPES + ", " + PINS + " SELECT dep, dep_ver, package AS consumer, row_number() OVER (PARTITION BY dep, dep_ver ORDER BY package) AS rank FROM pins", wide=True))
def consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.consumers(_pins(spark, sf_dir))


@query("SELECT l_partkey AS part, (row_number() OVER (ORDER BY first, l_partkey) - 1)::BIGINT AS idx FROM (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY l_partkey)")
def register_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return packages.register_first_seen(line, "part", ["at"])


RESOLVED = SCOPES + """, resolved AS (SELECT e.*, s.culture, s.class AS sc, t.class AS tc, s.community AS sm, t.community AS tm,
   x.culture IS NOT NULL AND (cx IS NULL OR ax.culture IS NOT NULL) AND (cy IS NULL OR bx.culture IS NOT NULL) AS ok,
   CASE WHEN cx IS NULL THEN '' ELSE 'Self:conforms:' || cx || CASE WHEN cy IS NULL THEN '' ELSE ';Element:is:' || cy END END AS bounds
   FROM edges e LEFT JOIN symbols s ON s.symbol = e.source LEFT JOIN symbols t ON t.symbol = e.target LEFT JOIN scopes x ON x.culture = s.culture AND x.namespace = t.namespace
   LEFT JOIN symbols a ON a.symbol = e.cx LEFT JOIN scopes ax ON ax.culture = s.culture AND ax.namespace = a.namespace
   LEFT JOIN symbols b ON b.symbol = e.cy LEFT JOIN scopes bx ON bx.culture = s.culture AND bx.namespace = b.namespace)"""
STATEMENTS = RESOLVED + """, judged AS (SELECT *, CASE
    WHEN relation = 'feature' AND sc = 'callable' AND tc = 'concrete' THEN 'feature'
    WHEN relation = 'member' AND sc IN ('concrete', 'typealias', 'callable') AND tc IN ('concrete', 'protocol') THEN 'member'
    WHEN relation = 'conformer' AND sc = 'concrete' AND tc = 'protocol' THEN 'conformance'
    WHEN relation = 'conformer' AND sc = 'protocol' AND tc = 'protocol' AND bounds = '' THEN 'refinement'
    WHEN relation = 'subclass' AND sm = 'class' AND tm = 'class' THEN 'subclass'
    WHEN relation = 'override' AND sc = tc AND sc IN ('associatedtype', 'callable') THEN 'override'
    WHEN relation = 'requirement' AND sc IN ('associatedtype', 'callable') AND tc = 'protocol' THEN 'requirement'
    WHEN relation = 'defaultImplementation' AND sc = 'callable' AND tc = 'callable' THEN 'implementation' END AS rule FROM resolved WHERE ok),
 statements AS (
  SELECT source AS subject, CASE rule WHEN 'conformance' THEN 'has' ELSE 'is' END AS verb, rule AS slot, target AS object, CASE rule WHEN 'conformance' THEN bounds ELSE '' END AS conditions, relation, culture, pos FROM judged WHERE rule IS NOT NULL AND rule <> 'feature'
  UNION ALL SELECT target, CASE rule WHEN 'requirement' THEN 'is' ELSE 'has' END, CASE rule WHEN 'conformance' THEN 'conformer' WHEN 'requirement' THEN 'interface' ELSE rule END, source, CASE rule WHEN 'conformance' THEN bounds ELSE '' END, relation, culture, pos FROM judged WHERE rule IS NOT NULL
  UNION ALL SELECT source, NULL, NULL, target, '', relation, culture, pos FROM judged WHERE rule IS NULL)"""
_FACT_TABLES = ("packages", "modules", "module_deps", "symbols", "edges")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.resolve_edges(A.edges(spark, sf_dir), A.symbols(spark, sf_dir), _scopes(spark, sf_dir))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.edge_statements(_resolved(spark, sf_dir).filter("resolved"))


@query(with_tables(*_FACT_TABLES, then=RESOLVED + " SELECT culture, relation, count(*) AS edges, count(*) FILTER (WHERE NOT ok) AS dropped FROM resolved GROUP BY culture, relation"))
def resolve_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).groupBy("culture", "relation").agg(F.count(F.lit(1)).alias("edges"), F.sum((~F.col("resolved")).cast("long")).alias("dropped"))


@query(with_tables(*_FACT_TABLES, then=SCOPES + """, ids AS (SELECT DISTINCT s.culture, t.name AS id FROM edges e JOIN symbols s ON s.symbol = e.source JOIN symbols t ON t.symbol = e.target),
 seen AS (SELECT i.culture, i.id, count(DISTINCT s.symbol) AS n, min(s.symbol) AS symbol FROM ids i JOIN symbols s ON s.name = i.id JOIN scopes x ON x.culture = i.culture AND x.namespace = s.culture GROUP BY i.culture, i.id)
 SELECT culture, id, CASE WHEN n = 1 THEN symbol END AS symbol, coalesce(n, 0) AS n FROM ids LEFT JOIN seen USING (culture, id)"""))
def resolve_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = A.symbols(spark, sf_dir), A.edges(spark, sf_dir)
    ids = e.join(s.select(F.col("symbol").alias("source"), "culture"), "source").join(s.select(F.col("symbol").alias("target"), F.col("name").alias("id")), "target").select("culture", "id").distinct()
    return facts.resolve_identifiers(ids, s.select(F.col("name").alias("id"), "symbol", F.col("culture").alias("module")), _scopes(spark, sf_dir))


@query(with_tables(*_FACT_TABLES, then=STATEMENTS + " SELECT subject, verb, slot, object, conditions, relation, culture, pos FROM statements"))
def edge_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statements(spark, sf_dir).withColumn("conditions", _written("conditions"))


def _written(conditions: Column | str) -> Column:
    """Conditions as text: subject:verb:object, joined by semicolons."""
    return F.array_join(F.transform(conditions, lambda c: F.concat_ws(":", c["subject"], c["verb"], c["object"].cast("string"))), ";")


TRAITS = STATEMENTS + ", traits AS (SELECT subject, culture, slot, object, max(pos) AS pos, arg_max(conditions, (pos, conditions)) AS conditions FROM statements WHERE verb = 'has' GROUP BY subject, culture, slot, object)"


@query(with_tables(*_FACT_TABLES, then=TRAITS + " SELECT subject, culture, slot, string_agg(object::VARCHAR, ',' ORDER BY object) AS objects, string_agg(conditions, '|' ORDER BY object) AS conditions FROM traits GROUP BY subject, culture, slot"))
def fold_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = facts.fold_traits(facts.traits(_statements(spark, sf_dir)))
    return folded.select("subject", "culture", "slot", F.array_join(F.col("objects").cast("array<string>"), ",").alias("objects"), F.array_join(F.transform("conditions", _written), "|").alias("conditions"))


@query(with_tables(*_FACT_TABLES, then=STATEMENTS + """, g AS (SELECT subject, count(DISTINCT (slot, object)) FILTER (WHERE slot IN ('member', 'requirement')) AS np, min((slot, object)) FILTER (WHERE slot IN ('member', 'requirement')) AS f,
   count(DISTINCT object) FILTER (WHERE slot = 'subclass') AS ns, min(object) FILTER (WHERE slot = 'subclass') AS sup, list_sort(list_distinct(list(object) FILTER (WHERE slot NOT IN ('member', 'requirement', 'subclass')))) AS r FROM statements WHERE verb = 'is' GROUP BY subject)
 SELECT subject, CASE WHEN np <= 1 AND ns <= 1 THEN f[1] END AS shape, CASE WHEN np <= 1 AND ns <= 1 THEN f[2] END AS parent, CASE WHEN np <= 1 AND ns <= 1 THEN sup END AS superclass, coalesce(array_to_string(r, ','), '') AS roles, np > 1 OR ns > 1 AS error FROM g"""))
def fold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fold_roles(_statements(spark, sf_dir)).withColumn("roles", F.array_join(F.col("roles").cast("array<string>"), ","))


BELIEFS = TRAITS + """, marked AS (SELECT t.subject, t.culture, t.slot, t.object, t.conditions, CASE WHEN t.subject % 4 = 1 THEN 'opinion' WHEN t.culture = s.culture THEN 'primary' WHEN a.package = b.package THEN 'accepted' ELSE 'opinion' END AS belief
   FROM traits t JOIN symbols s ON s.symbol = t.subject JOIN modules a ON a.module = t.culture JOIN modules b ON b.module = s.culture),
 beliefs AS (SELECT * FROM marked m WHERE belief <> 'accepted' OR NOT EXISTS (SELECT 1 FROM marked p WHERE p.belief = 'primary' AND p.subject = m.subject AND p.slot = m.slot AND p.object = m.object AND p.conditions = m.conditions))"""


#: The first statement of a symbol's parent, and its roles one by one.
SHAPES = """shapes AS (SELECT subject AS symbol, f[1] AS shape, f[2] AS parent FROM (SELECT subject, arg_min((slot, object), (pos, slot, object)) AS f FROM statements WHERE verb = 'is' AND slot IN ('member', 'requirement') GROUP BY subject))"""
ROLES = "roles AS (SELECT DISTINCT subject, slot, object FROM statements WHERE verb = 'is' AND slot NOT IN ('member', 'requirement', 'subclass'))"


def _beliefs(spark: SparkSession, sf_dir: str, statements: DataFrame | None = None) -> DataFrame:
    """Beliefs after a push that updates three symbols in four."""
    s = A.symbols(spark, sf_dir)
    said = _statements(spark, sf_dir) if statements is None else statements
    return facts.split_beliefs(facts.traits(said), s, A.modules(spark, sf_dir), s.filter("symbol % 4 <> 1").select("symbol"))


@query(with_tables(*_FACT_TABLES, then=BELIEFS + " SELECT subject, culture, slot, object, conditions, belief FROM beliefs"))
def split_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _beliefs(spark, sf_dir).withColumn("conditions", _written("conditions"))


@query(with_tables(*_FACT_TABLES, then=TRAITS + " SELECT DISTINCT subject, slot, object, conditions FROM traits WHERE culture % 2 = 0 EXCEPT SELECT subject, slot, object, conditions FROM traits WHERE culture % 2 = 1"))
def subtract_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["subject", "slot", "object", "conditions"]
    t = facts.traits(_statements(spark, sf_dir))
    return facts.subtract_traits(t.filter("culture % 2 = 0").select(*keys).distinct(), t.filter("culture % 2 = 1"), keys).withColumn("conditions", _written("conditions"))
