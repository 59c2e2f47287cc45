"""Page tables: topics, card order, module lists, search index, sitemap, feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.uri import encode_component

#: The sections of a page by name, in the order in which they stand.
SECTIONS = {"feed": 0, "refinement": 1, "implementation": 2, "restatement": 3, "override": 4, "requirement": 5, "member": 6, "conformer": 7, "conformance": 8, "subclass": 9, "implication": 10, "removed": 11}
#: Fixed values: (kind of host, slot, section). A host that is a requirement has that kind, others have their class's.
LISTED = [
    ("requirement", "override", "restatement"),
    ("requirement", "implementation", "implementation"),
    ("protocol", "conformer", "conformer"),
    ("protocol", "refinement", "refinement"),
    ("protocol", "member", "member"),
    ("concrete", "conformance", "conformance"),
    ("concrete", "subclass", "subclass"),
    ("concrete", "member", "member"),
    ("concrete", "feature", "member"),
    ("callable", "override", "override"),
]


def topics(beliefs: DataFrame, roles: DataFrame, shapes: DataFrame, symbols: DataFrame, usable: DataFrame) -> DataFrame:
    """(host, section, culture_class, culture, target, target_host, conditions): what the pages of hosts list.

    ``beliefs`` (subject, culture, slot, object, conditions, belief) are listed by what kind of symbol the host is
    (``LISTED``); slots that its kind does not list are left out. Members and features that ``usable`` (symbol, usable)
    calls unusable are removed members; a symbol without a row there, or with a null, is usable. A feature keeps its host, all
    other targets stand for themselves. ``roles`` (subject, slot, object) give protocols the protocols they refine
    (implications) and their requirements, in their own culture, usable or not. ``shapes`` (symbol, shape), ``symbols``
    (symbol, class, culture): each symbol once. Unknown hosts and targets are left out, repeated beliefs stay repeated.
    """
    kind = F.when(F.col("shape") == "requirement", "requirement").otherwise(F.col("class"))
    hosts = symbols.join(shapes.select("symbol", "shape"), "symbol", "left").select(F.col("symbol").alias("host"), kind.alias("host_kind"), F.col("culture").alias("home"), "class")
    targets = symbols.join(usable.select("symbol", "usable"), "symbol", "left").select(F.col("symbol").alias("target"), F.coalesce("usable", F.lit(True)).alias("usable"), F.col("class").alias("target_class"))
    places = beliefs.sparkSession.createDataFrame(LISTED, "host_kind string, slot string, name string")
    number = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    believed = beliefs.withColumnsRenamed({"subject": "host", "object": "target"}).join(hosts.drop("class"), "host").join(F.broadcast(places), ["host_kind", "slot"]).join(targets, "target")
    name = F.when((F.col("name") == "member") & ~F.col("usable"), "removed").otherwise(F.col("name"))
    held = F.when(F.col("belief") == "primary", 0).when(F.col("belief") == "accepted", 1).otherwise(2)
    listed = believed.select("host", F.try_element_at(number, name).alias("section"), held.alias("culture_class"), "culture", "target", F.when(F.col("slot") == "feature", F.col("host")).otherwise(F.col("target")).alias("target_host"), "conditions")
    own = roles.select(F.col("subject").alias("host"), F.col("object").alias("target")).distinct().join(hosts.filter(F.col("class") == "protocol"), "host").join(targets, "target")
    said = F.when(F.col("target_class") == "protocol", SECTIONS["implication"]).otherwise(SECTIONS["requirement"])
    none = F.array().cast(beliefs.schema["conditions"].dataType)
    return listed.unionByName(own.select("host", said.alias("section"), F.lit(0).alias("culture_class"), F.col("home").alias("culture"), "target", F.col("target").alias("target_host"), none.alias("conditions")))


def sort_cards(topics_: DataFrame, paths: DataFrame, articles: DataFrame) -> DataFrame:
    """(host, section, culture_class, culture, kind, target, rank): the cards of a host's section in their order.

    Culture class and culture first; in each, articles (host, section, culture_class, culture, article, path) stand
    before symbols; then the last path component, then the prefix, then the target. A target without a path is left out.
    """
    keys = ["host", "section", "culture_class", "culture"]
    named = topics_.join(paths.select(F.col("symbol").alias("target"), "path"), "target").select(*keys, F.lit("symbol").alias("kind"), "target", "path")
    cards = named.unionByName(articles.select(*keys, F.lit("article").alias("kind"), F.col("article").alias("target"), "path"))
    w = Window.partitionBy("host", "section").orderBy("culture_class", "culture", "kind", F.element_at("path", -1), F.slice("path", F.lit(1), F.size("path") - 1), "target")
    return cards.select(*keys, "kind", "target", F.row_number().over(w).alias("rank"))


def sort_relations(beliefs: DataFrame, paths: DataFrame) -> DataFrame:
    """(subject, culture, slot, object, rank): each list of a subject, one for a slot and culture, by the objects'
    paths, component by component; equal paths by object. Objects without a path come first."""
    named = beliefs.join(paths.select(F.col("symbol").alias("object"), "path"), "object")
    w = Window.partitionBy("subject", "slot", "culture").orderBy("path", "object")
    return named.select("subject", "culture", "slot", "object", F.row_number().over(w).alias("rank"))


#: The order in which a page's sublists show kinds of symbols.
DISPLAY = "case associatedtype typealias initializer deinitializer typeSubscript instanceSubscript typeProperty instanceProperty typeMethod instanceMethod var func operator typeOperator enum struct class actor protocol".split()


def sort_sections(topics_: DataFrame, symbols: DataFrame, modules: DataFrame, packages: DataFrame) -> DataFrame:
    """(host, section, sublist, culture_class, culture, cards, rank): a page's lists in their order.

    Sections stand in their fixed order; requirements, members and removed members are split into sublists by kind, in display order (sublist is
    null elsewhere); in each the own culture comes first, then accepted ones by name, then those of other
    packages by package and name. Counted before ranking, so that a window holds lists, not cards.
    """
    place = F.create_map(*[x for i, c in enumerate(DISPLAY) for x in (F.lit(c), F.lit(i))])
    kind = symbols.select(F.col("symbol").alias("target"), F.col("community").alias("sublist"))
    lists = topics_.join(kind, "target").withColumn("sublist", F.when(F.col("section").isin(*[SECTIONS[s] for s in ("requirement", "member", "removed")]), F.col("sublist"))).groupBy("host", "section", "sublist", "culture_class", "culture").agg(F.count(F.lit(1)).alias("cards"))
    owner = modules.join(packages.select("package"), "package").select(F.col("module").alias("culture"), "package", F.lower("name").alias("_name"))
    named = lists.join(owner, "culture").withColumn("_package", F.when(F.col("culture_class") == 2, F.col("package")).otherwise(-1))
    w = Window.partitionBy("host").orderBy("section", F.coalesce(F.try_element_at(place, "sublist"), F.lit(-1)), "culture_class", "_package", "_name", "culture")
    return named.select("host", "section", "sublist", "culture_class", "culture", "cards", F.row_number().over(w).alias("rank"))


def module_list(modules: DataFrame) -> DataFrame:
    """(package, module, rank): a package's modules by lower-cased name."""
    return modules.select("package", "module", F.row_number().over(Window.partitionBy("package").orderBy(F.lower("name"), "module")).alias("rank"))


def search_index(paths: DataFrame, modules: DataFrame, extant: DataFrame, uris: DataFrame, signatures: DataFrame) -> DataFrame:
    """(package, module, symbol, title, keywords, uri) of the protocols, aliases, types and global symbols that stand
    at the latest version (``extant``).

    ``signatures`` (symbol, fragments) are coloured fragments; the keywords are the texts of names and argument labels,
    as they stand. A symbol without a signature has no keywords.
    """
    types = paths.filter(F.col("class").isin("protocol", "typealias", "concrete", "global")).join(extant, "symbol", "left_semi")
    owner = modules.select(F.col("module").alias("culture"), "package")
    natural = uris.filter(F.col("base") == F.col("host")).select(F.col("base").alias("symbol"), "uri")
    words = F.transform(F.filter("fragments", lambda f: f["color"].isin("identifier", "keywordIdentifier", "argument")), lambda f: f["text"])
    found = types.join(owner, "culture").join(natural, "symbol").join(signatures.select("symbol", "fragments"), "symbol", "left")
    return found.select("package", F.col("culture").alias("module"), "symbol", F.array_join("path", ".").alias("title"), F.coalesce(words, F.array().cast("array<string>")).alias("keywords"), "uri")


def sitemap(modules: DataFrame, packages: DataFrame, articles: DataFrame, paths: DataFrame, extant: DataFrame, uris: DataFrame, domain: str) -> DataFrame:
    """(package, module, kind, line): a package's modules (kind 0), its articles of every version (1) and its natural
    symbols that stand at the latest version (2), one line of text each; ``articles`` are (article, culture, name)."""
    owner = modules.join(packages.select("package", F.col("name").alias("package_name"), "rank"), "package")
    parts = F.array_compact(F.array(F.lit(domain), F.when(F.col("rank") == 2, encode_component(F.col("package_name"))), encode_component(F.lower("name"))))
    at = owner.select("package", "module", F.array_join(parts, "/").alias("line"))
    own = at.select("package", "module", F.lit(0).alias("kind"), "line")
    texts = articles.select(F.col("culture").alias("module"), "name").join(at, "module").select("package", "module", F.lit(1).alias("kind"), F.concat("line", F.lit("/"), encode_component(F.col("name"))).alias("line"))
    natural = uris.filter(F.col("base") == F.col("host")).select(F.col("base").alias("symbol"), "uri")
    standing = paths.select("symbol", F.col("culture").alias("module")).join(extant, "symbol", "left_semi").join(natural, "symbol").join(modules.select("module", "package"), "module")
    return own.unionByName(texts).unionByName(standing.select("package", "module", F.lit(2).alias("kind"), F.concat(F.lit(domain), "uri").alias("line")))


def article_feed(articles: DataFrame, uris: DataFrame, domain: str) -> DataFrame:
    """(article, title, snippet, link) of ``articles`` (article, text) that have a URI (``latest_article_uris``).

    The title is the first line without its marks of a headline. The snippet is the first paragraph after it, its lines
    joined by a space; it is empty if another kind of block (headline, list, quotation, code) comes first. A null text
    has an empty title and snippet.
    """
    text = F.coalesce("text", F.lit(""))
    head = F.substring_index(text, "\n", 1)
    rest = F.regexp_replace(F.substring(text, F.length(head) + 2, F.length(text)), r"^[ \n\r\t]+", "")
    block = F.trim(F.substring_index(rest, "\n\n", 1))
    other = F.rlike(block, F.lit(r"^(#|[-*+>] |```|[0-9]+[.)] )"))
    snippet = F.when(other, "").otherwise(F.regexp_replace(block, r"[ \t\r]*\n[ \t\r]*", " "))
    return articles.join(uris.select("article", "uri"), "article").select("article", F.trim(F.regexp_replace(head, r"^#+", "")).alias("title"), snippet.alias("snippet"), F.concat(F.lit(domain), "uri").alias("link"))


def choices(composites: DataFrame, modules: DataFrame, packages: DataFrame) -> DataFrame:
    """(route columns, culture, base, rank): ambiguous selections by culture, cultures by (package, name)."""
    owner = modules.join(packages.select("package", F.col("name").alias("package_name")), "package").select(F.col("module").alias("culture"), "package_name", F.lower("name").alias("module_name"))
    route = ["namespace", "stem", "leaf", "orientation"]
    w = Window.partitionBy(*route).orderBy("package_name", "module_name", "base", "host")
    return composites.filter("composites > 1").join(owner, "culture").select(*route, "culture", "base", "host", F.row_number().over(w).alias("rank"))
