"""The given tables as symbol-graph tables: in Spark, and as the DuckDB SQL that the oracles start from.

Integer arithmetic only, so that both sides derive the same rows. Communities follow ``p_partkey % 10``.

Wide tables have many rows for each supplier that is read, which Spark's estimates by file sizes do not see, so they carry
the hint to be sorted and merged in joins instead of being broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Community by p_partkey % 10, and the class that the fact rules look at.
COMMUNITIES = ["protocol", "struct", "typealias", "class", "enum", "instanceProperty", "instanceMethod", "initializer", "func", "associatedtype"]
CLASSES = {"protocol": "protocol", "struct": "concrete", "typealias": "typealias", "class": "concrete", "enum": "concrete", "instanceProperty": "callable", "instanceMethod": "callable", "initializer": "callable", "func": "global", "associatedtype": "associatedtype"}
RELATIONS = ["member", "conformer", "subclass", "override", "requirement", "defaultImplementation", "feature"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def packages(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """(package, name, rank): package 0 plays the standard library, 1 the core libraries; wide: a package for each
    supplier too."""
    r = table(spark, sf_dir, "region")
    name = F.when(F.col("r_regionkey") == 0, "swift").when(F.col("r_regionkey") == 1, "core").otherwise(F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")))
    few = r.select(F.col("r_regionkey").cast("int").alias("package"), name.alias("name"), F.least(F.col("r_regionkey"), F.lit(2)).cast("int").alias("rank"))
    if not wide:
        return few
    return few.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 5).cast("int").alias("package"), F.concat(F.lit("lib-"), "s_suppkey").alias("name"), F.lit(2).alias("rank"))).hint("merge")


def modules(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """(module, package, name); wide: four modules for each supplier's package too."""
    n = table(spark, sf_dir, "nation")
    few = n.select(F.col("n_nationkey").cast("int").alias("module"), F.col("n_regionkey").cast("int").alias("package"), F.col("n_name").alias("name"))
    if not wide:
        return few
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return few.unionByName(s.select((F.col("s_suppkey") * 4 + F.col("k") + 25).cast("int").alias("module"), (F.col("s_suppkey") + 5).cast("int").alias("package"), F.concat(F.lit("Lib "), (F.col("s_suppkey") * 7 % 10).cast("string"), F.lit(" part "), F.col("k").cast("string")).alias("name"))).hint("merge")


def module_deps(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """(module, dep); wide: a supplier's modules need the one before in their package and, from the second supplier on, that
    of the supplier with half its key, so that no chain is long."""
    few = modules(spark, sf_dir).select("module", F.explode(F.array(F.col("module") - 5, F.col("module") - 1)).alias("dep")).filter("dep >= 0")
    if not wide:
        return few
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    own = F.expr("s_suppkey * 4 + k + 25")
    deps = F.array_compact(F.array(F.when(F.col("k") > 0, own - 1), F.when(F.col("s_suppkey") > 1, F.expr("s_suppkey div 2 * 4 + k + 25"))))
    return few.unionByName(s.select(own.cast("int").alias("module"), F.explode(deps.cast("array<int>")).alias("dep"))).hint("merge")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, community, class, name, parent, culture, namespace)."""
    p = table(spark, sf_dir, "part")
    k, d, r = F.col("p_partkey"), F.expr("p_partkey div 10"), F.expr("p_partkey % 10")
    community = _pick(COMMUNITIES, r)
    parent = F.when(r == 3, 10 * d + 1).when(r == 4, 10 * d + 3).when(r.between(5, 7), 10 * d + F.col("p_size") % 5).when(r == 9, 10 * d)
    culture = F.when(F.col("p_size") % 7 == 0, (d % 25 + 5) % 25).when(F.col("p_size") % 7 == 1, (d % 25 + 1) % 25).otherwise(d % 25)
    return p.select(k.alias("symbol"), community.alias("community"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), parent.cast("bigint").alias("parent"), culture.cast("int").alias("culture"), (d % 25).cast("int").alias("namespace")).withColumn("class", _pick([CLASSES[c] for c in COMMUNITIES], F.col("symbol") % 10))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, relation, target, pos, constraints): pos orders the rows of a relation; a third of them have constraints."""
    n = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    line = table(spark, sf_dir, "lineitem")
    pos = F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 10_000 + F.col("l_suppkey") % 10_000
    many = (F.col("l_orderkey") + F.col("l_suppkey")) % 6
    bound = lambda subject, verb, target: F.struct(F.lit(subject).alias("subject"), F.lit(verb).alias("verb"), (target % n).cast("bigint").alias("object"))
    one, two = bound("Self", "conforms", F.col("l_partkey") + F.col("l_orderkey")), bound("Element", "is", F.col("l_partkey") + 7)
    constraints = F.when(many == 0, F.array(one)).when(many == 1, F.array(one, two)).otherwise(F.array().cast("array<struct<subject:string,verb:string,object:bigint>>"))
    return line.select(F.col("l_partkey").alias("source"), _pick(RELATIONS, (F.col("l_linenumber") - 1) % 7).alias("relation"), ((F.col("l_orderkey") * 7 + F.col("l_suppkey")) % n).alias("target"), pos.alias("pos"), constraints.alias("constraints"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, ver, value): the last event type of a user on each day."""
    e = table(spark, sf_dir, "events")
    ver = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(F.col("user_id").alias("entity"), ver.alias("ver")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"))


def versions(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """(package, ver, kind, a, b, c, d): 30 versions a package; package 0 has toolchain dates."""
    own = packages(spark, sf_dir, wide).select("package")
    if wide:  # a few files of suppliers give very many versions: these are made side by side, and each package's stay together
        own = own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "package")
    p = own.select("package", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("ver"))
    tool = F.col("package") == 0
    ver = F.col("ver")
    return p.select("package", "ver", F.when(tool, "toolchain").otherwise("semantic").alias("kind"), F.when(tool, 2024).otherwise(F.expr("ver div 12")).cast("int").alias("a"), F.when(tool, 1).otherwise(F.expr("(ver div 4) % 3")).cast("int").alias("b"), F.when(tool, ver + 1).otherwise(ver % 4).cast("int").alias("c"), F.when(tool, 97).otherwise(0).cast("int").alias("d"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, origin, comment): documents; every eleventh length inherits, equal texts extend the first."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("symbol"), "text", (F.col("n_chars") % 11 == 0).alias("bare"))
    first = d.groupBy("text").agg(F.min("symbol").alias("first"))
    joined = d.join(first, "text")
    origin = F.when(F.col("bare") & (F.col("symbol") > 0), F.expr("symbol div 2")).when(~F.col("bare") & (F.col("first") != F.col("symbol")), F.col("first"))
    return joined.select("symbol", origin.alias("origin"), F.when(~F.col("bare"), F.col("text")).alias("comment"))


_COMMUNITY_SQL = "[" + ", ".join(f"'{c}'" for c in COMMUNITIES) + "]"
_CLASS_SQL = "[" + ", ".join(f"'{CLASSES[c]}'" for c in COMMUNITIES) + "]"
_RELATION_SQL = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"

#: DuckDB definitions of the same tables, by name.
SQL = {
    "packages": "SELECT r_regionkey::INT AS package, CASE r_regionkey WHEN 0 THEN 'swift' WHEN 1 THEN 'core' ELSE replace(lower(r_name), ' ', '-') END AS name, least(r_regionkey, 2)::INT AS rank FROM region",
    "modules": "SELECT n_nationkey::INT AS module, n_regionkey::INT AS package, n_name AS name FROM nation",
    "module_deps": "SELECT module, dep FROM (SELECT module, unnest([module - 5, module - 1]) AS dep FROM modules) WHERE dep >= 0",
    "symbols": f"""SELECT p_partkey AS symbol, {_COMMUNITY_SQL}[p_partkey % 10 + 1] AS community, replace(p_name, ' ', '_') AS name,
        (CASE WHEN p_partkey % 10 = 3 THEN p_partkey // 10 * 10 + 1 WHEN p_partkey % 10 = 4 THEN p_partkey // 10 * 10 + 3
          WHEN p_partkey % 10 BETWEEN 5 AND 7 THEN p_partkey // 10 * 10 + p_size % 5 WHEN p_partkey % 10 = 9 THEN p_partkey // 10 * 10 END)::BIGINT AS parent,
        (CASE p_size % 7 WHEN 0 THEN (p_partkey // 10 % 25 + 5) % 25 WHEN 1 THEN (p_partkey // 10 % 25 + 1) % 25 ELSE p_partkey // 10 % 25 END)::INT AS culture,
        (p_partkey // 10 % 25)::INT AS namespace, {_CLASS_SQL}[p_partkey % 10 + 1] AS class FROM part""",
    "edges": f"""SELECT l_partkey AS source, {_RELATION_SQL}[(l_linenumber - 1) % 7 + 1] AS relation,
        (l_orderkey * 7 + l_suppkey) % (SELECT max(p_partkey) + 1 FROM part) AS target,
        l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000 AS pos,
        CASE WHEN (l_orderkey + l_suppkey) % 6 < 2 THEN (l_partkey + l_orderkey) % (SELECT max(p_partkey) + 1 FROM part) END AS cx,
        CASE WHEN (l_orderkey + l_suppkey) % 6 = 1 THEN (l_partkey + 7) % (SELECT max(p_partkey) + 1 FROM part) END AS cy FROM lineitem""",
    "observations": """SELECT user_id AS entity, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS ver,
        arg_max(event_type, (ts, event_id)) AS value FROM events GROUP BY ALL""",
    "versions": """SELECT package, ver, CASE WHEN package = 0 THEN 'toolchain' ELSE 'semantic' END AS kind,
        (CASE WHEN package = 0 THEN 2024 ELSE ver // 12 END)::INT AS a, (CASE WHEN package = 0 THEN 1 ELSE ver // 4 % 3 END)::INT AS b,
        (CASE WHEN package = 0 THEN ver + 1 ELSE ver % 4 END)::INT AS c, (CASE WHEN package = 0 THEN 97 ELSE 0 END)::INT AS d
        FROM packages, (SELECT unnest(range(30))::INT AS ver)""",
    "comments": """SELECT doc_id AS symbol, CASE WHEN n_chars % 11 = 0 THEN CASE WHEN doc_id > 0 THEN doc_id // 2 END
          WHEN first <> doc_id THEN first END AS origin, CASE WHEN n_chars % 11 <> 0 THEN text END AS comment
        FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents)""",
}

#: The same with suppliers as packages, for queries over packages, modules and versions alone, which grow with them.
WIDE_SQL = {
    "packages": SQL["packages"] + " UNION ALL SELECT (s_suppkey + 5)::INT, 'lib-' || s_suppkey, 2 FROM supplier",
    "modules": SQL["modules"] + " UNION ALL SELECT (s_suppkey * 4 + k + 25)::INT, (s_suppkey + 5)::INT, 'Lib ' || s_suppkey * 7 % 10 || ' part ' || k FROM supplier, (SELECT unnest(range(4)) AS k)",
    "module_deps": """SELECT module, dep FROM (SELECT n_nationkey::INT AS module, unnest([n_nationkey::INT - 5, n_nationkey::INT - 1]) AS dep FROM nation) WHERE dep >= 0
        UNION ALL SELECT (s_suppkey * 4 + k + 25)::INT, (s_suppkey * 4 + k + 24)::INT FROM supplier, (SELECT unnest(range(4)) AS k) WHERE k > 0
        UNION ALL SELECT (s_suppkey * 4 + k + 25)::INT, (s_suppkey // 2 * 4 + k + 25)::INT FROM supplier, (SELECT unnest(range(4)) AS k) WHERE s_suppkey > 1""",
}

_NEEDS = {"module_deps": ["modules"], "versions": ["packages"]}


def with_tables(*names: str, then: str, wide: bool = False) -> str:
    """A query that begins with the definitions of the named tables (and of those they need), of the wide ones if asked.

    Further CTEs go in ``then`` as ``name AS (...), ... SELECT``; it starts with the word SELECT or a name.
    """
    order: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    head = "WITH RECURSIVE " + ", ".join(f"{n} AS ({(WIDE_SQL if wide and n in WIDE_SQL else SQL)[n]})" for n in order)
    then = then.strip()
    return f"{head} {then}" if then.upper().startswith("SELECT") else f"{head}, {then}"
