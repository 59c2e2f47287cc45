"""Sources: symbol graphs, package catalogs, lockfiles, toolchain lists and articles, read as text and JSON.

Every reader returns rows and rejects as separate frames or marks rejects in a column; schemas are explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.availability import GENERAL, lower_availability
from docgraph.functions.identity import assemble_comment, classify_fragments, decode_community
from docgraph.functions.versions import match_version, parse_version, parsed, precise_version, toolchain_text, version_string

FRAGMENTS = "array<struct<spelling:string,kind:string,preciseIdentifier:string>>"
CONSTRAINTS = "array<struct<kind:string,lhs:string,rhs:string,rhsPrecise:string>>"
VERSION = "struct<major:int,minor:int,patch:int>"
AVAILABILITY = f"array<struct<domain:string,isUnconditionallyUnavailable:boolean,isUnconditionallyDeprecated:boolean,introduced:{VERSION},deprecated:{VERSION},obsoleted:{VERSION}>>"
GRAPH = f"""struct<module:struct<name:string>,
 symbols:array<struct<identifier:struct<precise:string>,pathComponents:array<string>,kind:struct<identifier:string>,accessLevel:string,spi:boolean,availability:{AVAILABILITY},
  declarationFragments:{FRAGMENTS},names:struct<subHeading:{FRAGMENTS}>,swiftGenerics:struct<parameters:array<struct<name:string,index:int,depth:int>>,constraints:{CONSTRAINTS}>,swiftExtension:struct<extendedModule:string,constraints:{CONSTRAINTS}>,
  location:struct<uri:string,position:struct<line:int,character:int>>,docComment:struct<lines:array<struct<text:string>>>>>,
 relationships:array<struct<source:string,target:string,kind:string,swiftConstraints:{CONSTRAINTS},sourceOrigin:struct<identifier:string>>>>"""
DEPENDENCIES = "array<struct<package:string,modules:array<string>>>"
CATALOG = f"array<struct<catalog_tools_version:int,package:string,brand:string,modules:array<struct<module:string,include:array<string>,dependencies:{DEPENDENCIES}>>,snippets:array<struct<snippet:string,sources:array<string>,dependencies:{DEPENDENCIES}>>>>"
PIN = "array<struct<identity:string,package:string,location:string,repositoryURL:string,state:struct<revision:string,version:string,branch:string>>>"
LOCKFILE = f"struct<version:int,object:struct<pins:{PIN}>,pins:{PIN}>"
#: Relationship kinds and the relations that they become.
RELATIONSHIPS = {"memberOf": "member", "conformsTo": "conformer", "inheritsFrom": "subclass", "overrides": "override", "requirementOf": "requirement", "optionalRequirementOf": "optionalRequirement", "defaultImplementationOf": "defaultImplementation"}
#: Kinds of generic constraints and their verbs.
VERBS = {"conformance": "conforms", "superclass": "subclasses", "sameType": "is"}
TOOLS_VERSION = 3


def whole_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, text) of every file below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))


def read_symbol_graphs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graphs, rejects): files ``Module[@Namespace].symbols.json``; graphs (culture, namespace, graph).

    Rejected are other names, more than two parts, a module name that differs, and a namespace that comes
    twice for one culture.
    """
    stem = F.regexp_replace(F.url_decode("file"), r"\.symbols\.json$", "")
    parts = F.split(stem, "@")
    parsed = files.select("file", F.from_json("text", GRAPH).alias("graph"), parts.alias("parts"), F.endswith("file", F.lit(".symbols.json")).alias("named"))
    parsed = parsed.select("file", "graph", F.try_element_at("parts", F.lit(1)).alias("culture"), F.coalesce(F.try_element_at("parts", F.lit(2)), F.try_element_at("parts", F.lit(1))).alias("namespace"), (F.col("named") & (F.size("parts") <= 2)).alias("named"))
    twice = parsed.filter("named").groupBy("culture", "namespace").agg(F.count(F.lit(1)).alias("copies"))
    judged = parsed.join(twice, ["culture", "namespace"], "left")
    why = F.when(~F.col("named"), "name").when(F.col("graph.module.name").isNull() | (F.col("graph.module.name") != F.col("culture")), "module").when(F.col("copies") > 1, "duplicate")
    judged = judged.withColumn("why", why)
    return judged.filter("why IS NULL").select("culture", "namespace", "graph"), judged.filter("why IS NOT NULL").select("file", "why")


def _constraints(written: Column) -> Column:
    """Constraints (subject, verb, object, text) in order, none for null; object is the precise identifier, null for a
    type without one; an unknown kind has a null verb."""
    known = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    out = F.transform(written, lambda c: F.struct(c["lhs"].alias("subject"), F.try_element_at(known, c["kind"]).alias("verb"), c["rhsPrecise"].alias("object"), c["rhs"].alias("text")))
    return F.coalesce(out, F.array().cast("array<struct<subject:string,verb:string,object:string,text:string>>"))


def _availability(written: Column) -> Column:
    """The lowered availability: a record without a domain is general, a missing flag is false, versions are text."""
    text = lambda v: F.when(v.isNotNull(), F.concat_ws(".", *[v[part].cast("string") for part in ("major", "minor", "patch")]))
    flag = lambda r, name: F.coalesce(r[name], F.lit(False))
    records = F.transform(written, lambda r: F.struct(
        F.coalesce(r["domain"], F.lit(GENERAL)).alias("domain"), flag(r, "isUnconditionallyUnavailable").alias("unavailable"), flag(r, "isUnconditionallyDeprecated").alias("deprecatedAlways"),
        *[text(r[name]).alias(name) for name in ("introduced", "deprecated", "obsoleted")]))
    none = "array<struct<domain:string,unavailable:boolean,deprecatedAlways:boolean,introduced:string,deprecated:string,obsoleted:string>>"
    return lower_availability(F.coalesce(records, F.array().cast(none)))


def read_symbols(graphs: DataFrame) -> DataFrame:
    """One row per symbol: id, path, community (null for unknown kinds), extension, location, comment, coloured
    signature, generic parameters by depth and index, own and extension constraints, lowered availability. Missing lists are empty."""
    s = graphs.select("culture", "namespace", F.posexplode("graph.symbols").alias("pos", "s"))
    comment = assemble_comment(F.coalesce(F.transform("s.docComment.lines", lambda x: x["text"]), F.array().cast("array<string>")), F.lit(None).cast("string"))["comment"]
    signature = F.coalesce(classify_fragments(F.col("s.names.subHeading")), F.array().cast("array<struct<text:string,color:string>>"))
    order = F.array_sort(F.transform("s.swiftGenerics.parameters", lambda g: F.struct(g["depth"], g["index"], g["name"])))
    generics = F.coalesce(F.transform(order, lambda g: g["name"]), F.array().cast("array<string>"))
    return s.select("culture", "namespace", "pos", F.col("s.identifier.precise").alias("id"), F.col("s.pathComponents").alias("path"), decode_community(F.col("s.kind.identifier"), F.col("s.pathComponents")).alias("community"), F.col("s.swiftExtension.extendedModule").alias("extended"), F.col("s.location.uri").alias("uri"), F.col("s.location.position.line").alias("line"), F.col("s.location.position.character").alias("character"), F.transform("s.declarationFragments", lambda x: x["spelling"]).alias("fragments"), comment.alias("comment"), signature.alias("signature"), generics.alias("generics"), _constraints(F.col("s.swiftGenerics.constraints")).alias("constraints"), _constraints(F.col("s.swiftExtension.constraints")).alias("extension_constraints"), _availability(F.col("s.availability")).alias("availability"))


def read_relationships(graphs: DataFrame) -> DataFrame:
    """(culture, namespace, pos, source, relation, target, origin, constraints, why): relation is null where why says so.

    A synthesized source is only legal for a member whose host is the target; it then is a feature. Unknown kinds of
    relationships and of constraints are rejects.
    """
    known = F.create_map(*[F.lit(x) for kv in RELATIONSHIPS.items() for x in kv])
    r = graphs.select("culture", "namespace", F.posexplode("graph.relationships").alias("pos", "r")).withColumn("constraints", _constraints(F.col("r.swiftConstraints")))
    parts = F.split("r.source", "::SYNTHESIZED::")
    host = F.try_element_at(parts, F.lit(2))
    relation = F.try_element_at(known, F.col("r.kind"))
    odd = F.exists("constraints", lambda c: c["verb"].isNull())
    why = F.when(relation.isNull(), "kind").when(host.isNotNull() & ((relation != "member") | (host != F.col("r.target"))), "synthesized").when(odd, "constraint")
    return r.select("culture", "namespace", "pos", parts[0].alias("source"), F.when(why.isNull(), F.when(host.isNotNull(), "feature").otherwise(relation)).alias("relation"), F.col("r.target").alias("target"), F.col("r.sourceOrigin.identifier").alias("origin"), "constraints", why.alias("why"))


def read_package_catalog(files: DataFrame) -> DataFrame:
    """(package, brand, kind, name, sources, dep_package, dep_module, why): the modules and snippets of catalogs, a row
    for each module that they depend on, or one with null.

    A catalog of another tools version, or without one, is one row with why ``tools_version``; a text that is no catalog
    one with why ``json``. Modules have no sources here. An empty catalog has no rows.
    """
    c = files.select(F.explode_outer(F.from_json("text", CATALOG)).alias("c"))
    why = F.when(F.col("c").isNull(), "json").when(~F.col("c.catalog_tools_version").eqNullSafe(F.lit(TOOLS_VERSION)), "tools_version")
    c = c.select("c.*", why.alias("why"))
    sources = F.lit(None).cast("array<string>")
    parts = [c.filter("why IS NULL").select("package", "brand", F.lit(kind).alias("kind"), F.explode(f"{kind}s").alias("x")).select("package", "brand", "kind", F.col(f"x.{kind}").alias("name"), (F.col("x.sources") if kind == "snippet" else sources).alias("sources"), F.explode_outer("x.dependencies").alias("d")) for kind in ("module", "snippet")]
    good = parts[0].unionByName(parts[1]).select("package", "brand", "kind", "name", "sources", F.col("d.package").alias("dep_package"), F.explode_outer("d.modules").alias("dep_module"))
    bad = c.filter("why IS NOT NULL").select("package", "brand", "why")
    return good.withColumn("why", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def read_package_resolved(files: DataFrame) -> DataFrame:
    """(file, package, version): lockfile pins of either format; the last of a package wins, without a version
    it has no pin. A pin's version is its version, else its branch as version or toolchain tag."""
    p = files.select("file", F.from_json("text", LOCKFILE).alias("l")).select("file", F.posexplode(F.coalesce("l.pins", "l.object.pins")).alias("pos", "p"))
    text = F.when(F.col("p.state.version").isNotNull(), F.col("p.state.version")).otherwise(F.coalesce(toolchain_text(F.col("p.state.branch")), F.col("p.state.branch")))
    p = parsed(p.select("file", "pos", F.lower(F.coalesce("p.identity", "p.package")).alias("package"), text.alias("text")), F.col("text"), "v")
    last = p.groupBy("file", "package").agg(F.max_by(F.struct(version_string(F.col("v")).alias("version")), "pos").alias("v"))
    return last.select("file", "package", "v.version").filter("version IS NOT NULL")


def list_toolchains(files: DataFrame, pattern: str | None) -> DataFrame:
    """(dir, version): the parsable entries of white-space separated lists that match a version pattern."""
    entry = files.select(F.explode(F.split("text", r"\s+")).alias("dir")).distinct()
    entry = parsed(entry, F.coalesce(toolchain_text(F.col("dir")), F.col("dir")), "v")
    mask = parse_version(F.lit(pattern).cast("string"))
    return entry.filter(F.col("v").isNotNull() & match_version(mask, precise_version(F.col("v")))).select("dir", version_string(F.col("v")).alias("version"))


def read_articles(files: DataFrame) -> DataFrame:
    """(name, text): the file's stem with hyphens for spaces, or the last @path of the text."""
    stem = F.regexp_replace(F.regexp_replace(F.url_decode("file"), r"\.md$", ""), " ", "-")
    path = F.try_element_at(F.regexp_extract_all("text", F.lit(r"(?m)^@path\(([^)\n]*)\)"), F.lit(1)), F.lit(-1))
    return files.select(F.coalesce(path, stem).alias("name"), "text").filter("name <> ''")


def source_map(symbols: DataFrame) -> DataFrame:
    """(uri, features): the symbols of a file by line, character and id."""
    return symbols.filter("uri IS NOT NULL").groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("line", "character", "id"))).alias("features"))


def write_graph(frame: DataFrame, path: str) -> None:
    """One compiled table, by package and version. A second run replaces the packages and versions that it has and
    leaves all others. ``tables.GraphStore`` keeps several tables together."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package", "version").parquet(path)


def read_graph(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A compiled table with its partition columns; filters on them prune folders."""
    return spark.read.schema(schema).parquet(path)
