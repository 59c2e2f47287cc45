"""Vertices of a graph: the copy that counts, resolved declarations, bound extensions, page facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions.identity import constraint_sentence, with_interface
from docgraph.operators.packages import ranked_within


def natural_vertices(copies: DataFrame) -> DataFrame:
    """(culture, namespace, id, pos, natural, hidden): one copy of each symbol of a graph.

    copies (culture, namespace, id, pos, natural, unavailable, protocol, protocol_culture): natural copies
    overwrite one another, the last one stays. A synthesized copy counts only without a natural one, in its
    own namespace, if its id names a protocol of this culture that is hidden (leading underscore) or if it is
    unavailable; the first such copy stays.
    """
    hidden = F.startswith("protocol", F.lit("_"))
    legal = F.col("natural") | ((F.col("culture") == F.col("namespace")) & F.coalesce(F.col("protocol_culture") == F.col("culture"), F.lit(False)) & (F.col("unavailable") | F.coalesce(hidden, F.lit(False))))
    order = F.when(F.col("natural"), F.struct(F.lit(1).alias("n"), F.col("pos").alias("p"))).otherwise(F.struct(F.lit(0).alias("n"), (-F.col("pos")).alias("p")))
    best = F.max_by(F.struct("pos", "natural", (~F.col("natural") & F.coalesce(hidden, F.lit(False))).alias("hidden")), order)
    return copies.filter(legal).groupBy("culture", "namespace", "id").agg(best.alias("v")).select("culture", "namespace", "id", "v.*")


def naturalize(symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, edges, locations) of graphs whose symbols come in the order of ``pos``.

    symbols (culture, namespace, pos, id, inferred, path, community, unavailable, location, mentions): culture and
    namespace are module names and make a graph, ``inferred`` is the namespace of a synthesized copy's declaration (null
    for natural ones), ``mentions`` the ids that generic constraints name. Positions are unique within a graph.

    * Natural copies overwrite one another and all others; the last one is the vertex, each has its location.
    * A synthesized copy counts only if its declaration is of the culture, a protocol of the culture is named in its id,
      it is unavailable or that protocol is hidden (a leading underscore), and nothing has given a vertex yet: it is the
      first such copy and no natural one came before. Its path is re-rooted below the protocol, it becomes a member of it and has its location;
      a natural copy that comes later takes over the vertex, but the edge and the location stay.
    * Hidden protocols of the culture that a constraint or the id of a counting available copy names get a placeholder
      vertex, unless there is a natural copy anywhere in the graph.

    vertices (culture, namespace, id, path, community, pos, origin): origin is natural, inferred or placeholder (pos null).
    edges (culture, namespace, source, relation, target), locations (culture, namespace, id, location). Ids of
    protocols are taken not to be synthesized themselves. Null ids, and null lists of mentions, count for nothing.
    """
    graph = ["culture", "namespace"]
    named = symbols.filter("id is not null")
    # taken apart once, as a column that later expressions refer to
    copies = with_interface(named.filter("inferred = culture"), F.col("id"), "_of")
    natural = named.filter("inferred is null")
    last = natural.groupBy(*graph, "id").agg(F.max_by(F.struct("path", "community", "pos"), "pos").alias("v"), F.min("pos").alias("_first"))
    hidden = F.startswith(F.col("_of.protocol"), F.lit("_"))
    unavailable = F.coalesce("unavailable", F.lit(False))
    legal = copies.filter((F.col("_of.culture") == F.col("culture")) & (unavailable | hidden))
    rooted = F.array(F.col("_of.protocol"), F.try_element_at("path", F.lit(-1))).alias("path")
    first = legal.groupBy(*graph, "id").agg(F.min_by(F.struct(rooted, "community", "pos", "location", F.col("_of.id").alias("protocol"), F.col("_of.protocol").alias("name"), unavailable.alias("unavailable")), "pos").alias("s"))
    counted = first.join(last.select(*graph, "id", "_first"), [*graph, "id"], "left").filter(F.col("_first").isNull() | (F.col("s.pos") < F.col("_first")))
    inferred = counted.filter("_first is null").select(*graph, "id", "s.path", "s.community", "s.pos", F.lit("inferred").alias("origin"))
    said = with_interface(named.select("culture", "namespace", F.explode("mentions").alias("m")).distinct(), F.col("m"), "_of").filter((F.col("_of.culture") == F.col("culture")) & hidden)
    met = said.select(*graph, F.col("_of.id").alias("id"), F.col("_of.protocol").alias("name"))
    met = met.unionByName(counted.filter(~F.col("s.unavailable")).select(*graph, F.col("s.protocol").alias("id"), F.col("s.name").alias("name")))
    holes = met.groupBy(*graph, "id").agg(F.min("name").alias("name")).join(last, [*graph, "id"], "left_anti")
    placeholders = holes.select(*graph, "id", F.array("name").alias("path"), F.lit("protocol").alias("community"), F.lit(None).cast(symbols.schema["pos"].dataType).alias("pos"), F.lit("placeholder").alias("origin"))
    vertices = last.select(*graph, "id", "v.path", "v.community", "v.pos", F.lit("natural").alias("origin")).unionByName(inferred).unionByName(placeholders)
    edges = counted.select(*graph, F.col("id").alias("source"), F.lit("member").alias("relation"), F.col("s.protocol").alias("target"))
    locations = natural.select(*graph, "id", "location").unionByName(counted.select(*graph, "id", "s.location")).filter("location is not null")
    return vertices, edges, locations


def resolve_declarations(fragments: DataFrame, constraints: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fragments, constraints, warnings): the pieces of declarations with their links resolved, in long form.

    ``fragments`` (symbol, culture, pos, text, link) become (symbol, pos, text, target), ``constraints`` (symbol, culture,
    list, pos, subject, verb, text, link) become (symbol, list, pos, subject, verb, text, target), where the list is that of the
    extension or of the generics. ``resolved`` (culture, id, symbol): each id of a culture once. An unresolved link becomes
    null and its text stays; only ids of the language (leading s) are reported, once for each declaration they are in.
    """
    known = resolved.select("culture", F.col("id").alias("link"), F.col("symbol").alias("target"))
    pieces = fragments.join(known, ["culture", "link"], "left")
    bounds = constraints.join(known, ["culture", "link"], "left")
    missing = [d.filter(F.col("target").isNull() & F.startswith("link", F.lit("s"))).select("symbol", "culture", "link") for d in (pieces, bounds)]
    return pieces.select("symbol", "pos", "text", "target"), bounds.select("symbol", "list", "pos", "subject", "verb", "text", "target"), missing[0].unionByName(missing[1]).distinct()


def bind_extensions(extensions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(target, extension, status): the last extension (by position) that binds to a target; others are lost.

    resolved (extension, target) comes from link resolution; extensions without a target are unknown.
    """
    joined = extensions.join(resolved, "extension", "left")
    last = joined.filter(F.col("target").isNotNull()).groupBy("target").agg(F.max("pos").alias("_last"))
    marked = joined.join(last, "target", "left")
    status = F.when(F.col("target").isNull(), "unknown").when(F.col("pos") == F.col("_last"), "bound").otherwise("lost")
    return marked.select("extension", "target", status.alias("status"))


def page_facts(composites: DataFrame, paths: DataFrame, modules: DataFrame) -> DataFrame:
    """One wide row per composite (base, host, culture): its title and kind, the culture's name, the host's module if
    that is another (namespace) and the base's module if that is another (base_module).

    ``paths`` (symbol, name, community, culture), ``modules`` (module, name). Composites of unknown symbols are left out; what
    is said of them otherwise is in ``page_notes``.
    """
    names = modules.select(F.col("module").alias("_m"), F.col("name").alias("_n"))
    named = lambda module, name: names.select(F.col("_m").alias(module), F.col("_n").alias(name))
    base = paths.select(F.col("symbol").alias("base"), F.col("name").alias("title"), F.col("community").alias("kind"), F.col("culture").alias("_of"))
    host = paths.select(F.col("symbol").alias("host"), F.col("culture").alias("_at"))
    placed = composites.select("base", "host", "culture").join(base, "base").join(host, "host")
    told = placed.join(named("culture", "culture_name"), "culture", "left").join(named("_at", "_host_module"), "_at", "left").join(named("_of", "_base_module"), "_of", "left")
    other = lambda module, name: F.when(F.col(module) != F.col("culture"), F.col(name))
    return told.select("base", "host", "culture", "title", "kind", "culture_name", other("_at", "_host_module").alias("namespace"), other("_of", "_base_module").alias("base_module"))


def page_notes(composites: DataFrame, paths: DataFrame, shapes: DataFrame, roles: DataFrame, constraints: DataFrame) -> DataFrame:
    """(base, host, culture, rank, note, link): the notes of composites in their order, one row each.

    * An inherited member is available because Self conforms to the type of which it is a member.
    * A callable that is a member implements requirements of protocols and overrides members of classes: one note for each
      of its roles, named by the type the role belongs to (or the role itself, if it belongs to none), by that type's path.
    * A requirement says so, and which requirements it restates.
    * Last come the constraints under which the base is available.

    ``paths`` (symbol, name, path, class, community), ``shapes`` (symbol, shape, parent), ``roles`` (subject, slot,
    object), ``constraints`` (symbol, constraints: subject, verb, object as texts; null or empty: none). ``link`` is the symbol a note leads to (null for none).
    Equal composites, and equal roles of one, are told once. Roles of unknown symbols are left out.
    """
    keys = ["base", "host", "culture"]
    shape = shapes.select(F.col("symbol").alias("base"), "shape", "parent")
    known = paths.select(F.col("symbol").alias("base"), "class")
    pages = composites.select(*keys).distinct().join(known, "base").join(shape, "base", "left")
    inherited = F.col("base") != F.col("host")
    at = lambda to: paths.select(F.col("symbol").alias(to), F.col("name").alias("_name"), F.col("path").alias("_path"), F.col("community").alias("_community"))
    row = lambda section, note, link, path: F.struct(F.lit(section).alias("section"), path.alias("path"), link.alias("link"), note.alias("note"))
    none, empty = F.lit(None).cast(paths.schema["symbol"].dataType), F.lit(None).cast("array<string>")
    because = pages.filter((F.col("shape") == "member") & inherited).join(at("parent"), "parent").select(*keys, row(0, F.concat(F.lit("Available because Self conforms to "), "_name", F.lit(".")), F.col("base"), empty).alias("n"))
    required = pages.filter(F.col("shape") == "requirement").select(*keys, row(0, F.lit("Required."), none, empty).alias("n"))
    owner = paths.filter(F.col("class").isin("callable", "associatedtype")).select(F.col("symbol").alias("object")).join(shapes.select(F.col("symbol").alias("object"), F.col("parent").alias("_type")), "object")
    upstream = roles.select(F.col("subject").alias("base"), "slot", "object").distinct().join(owner, "object", "left").withColumn("_type", F.coalesce("_type", "object")).join(at("_type"), "_type")
    met = pages.join(upstream, "base")
    prose = F.when((F.col("shape") == "requirement") & (F.col("slot") == "override"), "Restates requirement of ")
    plain = (F.col("shape") == "member") & ~inherited & (F.col("class") == "callable") & F.col("slot").isin("override", "implementation")
    prose = prose.when(plain & (F.col("_community") == "protocol"), "Implements requirement of ").when(plain & (F.col("_community") == "class"), "Overrides member of ")
    of = met.filter(prose.isNotNull()).select(*keys, row(1, F.concat(prose, F.col("_name"), F.lit(".")), F.col("object"), F.col("_path")).alias("n")).distinct()
    bounds = constraints.filter(F.size("constraints") > 0).select(F.col("symbol").alias("base"), constraint_sentence(F.col("constraints")).alias("_said"))
    when = pages.join(bounds, "base").select(*keys, row(2, F.col("_said"), none, empty).alias("n"))
    rows = because.unionByName(required).unionByName(of).unionByName(when)
    return ranked_within(rows, keys, "n").select(*keys, "rank", "n.note", "n.link")
