"""URIs of packages, modules, articles and composites at versions, moves of modules and articles, and responses.

A URI names a version only where it is not the latest, in its shortest form that still means it; the standard and core
libraries' modules go without their package's name. A module (or its articles) that was moved is at its new place at the
version of its last move, and at its ordinary place at all others; the new place leads to it at the version it moved at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions.storage import stored
from docgraph.functions.uri import encode_component, encode_uri, uri_equivalent
from docgraph.operators.composites import COMPOSITE
from docgraph.operators.requests import ROOTS, Ecosystem, resolve_requests

_WORD = {root: word for word, root in ROOTS.items()}
_PARAMS = "array<struct<key:string,value:string>>"


@dataclass
class Book:
    """What URIs are written from: an ecosystem, masks (package, ver, mask; ``abbreviate_version``), moves (kind module or
    article, module, uri, ver), depths (``overload_spans``) and names (symbol, module, namespace, path, dotted)."""

    eco: Ecosystem
    masks: DataFrame
    moves: DataFrame
    depths: DataFrame
    names: DataFrame


def written_mask(mask: Column) -> Column:
    """A version's mask as a path component, null for the latest."""
    parts = F.substring(mask, F.length(F.substring_index(mask, ":", 1)) + 2, F.length(mask))
    return F.replace(parts, F.lit(":"), F.when(F.startswith(mask, F.lit("toolchain")), "-").otherwise("."))


def last_moves(moves: DataFrame) -> DataFrame:
    """(kind, module, uri, ver): the last move of each module and of its articles."""
    return moves.groupBy("kind", "module").agg(F.max_by(F.struct("uri", "ver"), F.struct("ver", "uri")).alias("m")).select("kind", "module", "m.uri", "m.ver")


def place_uris(entities: DataFrame, eco: Ecosystem, masks: DataFrame, moves: DataFrame, shown: str = "ver") -> DataFrame:
    """``entities`` (kind package, module or article, package, ver, module, article, ...) with ``uri``.

    The version is written as that of the column ``shown``; moves count by ``ver``. Entities without a package at that version
    (or with an unknown module or article) have a null uri.
    """
    owners = eco.packages.select("package", F.col("name").alias("_package"), F.col("rank").alias("_rank"))
    written = masks.select("package", F.col("ver").alias("_shown"), written_mask(F.col("mask")).alias("_written"), F.lit(True).alias("_known"))
    modules = eco.modules.select("module", F.lower("name").alias("_module"))
    articles = eco.articles.select("article", F.transform(F.split(F.lower("name"), "/"), encode_component).alias("_title"))
    moved = last_moves(moves).select(F.col("kind").alias("_kind"), F.col("module").alias("_of"), F.col("uri").alias("_moved"), F.col("ver").alias("_when"))
    at = entities.withColumn("_shown", F.col(shown)).join(owners, "package", "left").join(written, ["package", "_shown"], "left").join(modules, "module", "left").join(articles, "article", "left")
    at = at.join(moved, (F.col("kind") == F.col("_kind")) & (F.col("module") == F.col("_of")) & (F.col("ver") == F.col("_when")), "left")
    prefix = F.array_compact(F.array(F.when(F.col("_rank") == 2, encode_component(F.col("_package"))), F.col("_written")))
    below = lambda word, *rest: F.concat(F.lit(f"/{word}/"), F.array_join(F.concat(*rest), "/"))
    name = F.array(encode_component(F.col("_module")))
    package = below(_WORD["master"], F.array_compact(F.array(encode_component(F.col("_package")), F.col("_written"))))
    module = F.coalesce("_moved", below(_WORD["master"], prefix, name))
    article = F.concat(F.coalesce("_moved", below(_WORD["article"], prefix, name)), F.lit("/"), F.array_join("_title", "/"))
    uri = F.when(F.col("kind") == "package", package).when(F.col("kind") == "module", module).when(F.col("kind") == "article", article)
    return at.select(*[entities[c] for c in entities.columns], F.when(F.col("_known"), uri).alias("uri"))


def latest_article_uris(articles: DataFrame, modules: DataFrame, packages: DataFrame, moves: DataFrame, latest: DataFrame) -> DataFrame:
    """(article, uri) of ``articles`` (article, module, name) at the latest version of their package.

    The URI has no version; it is below the place to which the module's articles moved last, if that was at this version. Articles
    of unknown modules are left out. ``latest`` (package, ver).
    """
    owners = modules.select("module", "package", F.lower("name").alias("_module")).join(packages.select("package", F.col("name").alias("_package"), "rank"), "package").join(latest, "package")
    moved = last_moves(moves).filter("kind = 'article'").select("module", "uri", "ver")
    placed = owners.join(moved, ["module", "ver"], "left")
    parts = F.array_compact(F.array(F.when(F.col("rank") == 2, encode_component(F.col("_package"))), encode_component(F.col("_module"))))
    root = placed.select("module", F.coalesce("uri", F.concat(F.lit(f"/{_WORD['article']}/"), F.array_join(parts, "/"))).alias("_root"))
    name = F.array_join(F.transform(F.split(F.lower("name"), "/"), encode_component), "/")
    return articles.join(root, "module").select("article", F.concat("_root", F.lit("/"), name).alias("uri"))


def composite_uris(entities: DataFrame, book: Book, query: bool = True) -> DataFrame:
    """``entities`` (package, ver, exhibit, base, host, culture, ...) with ``path`` and ``params`` of their URIs.

    package and ver are those whose groups have the composite, the exhibit, if any, is the version that is written. The path is that
    of the host and, for an inherited one, the base's name, below the host's package; only if the composite's culture is
    of that package it carries the version, else the culture's package goes into the parameter ``from``. What has to be
    told apart at ``ver`` has the base's id as ``overload`` and, if that is not enough, the host's as ``self``; a natural one
    never needs the latter. A composite that does not stand at ``ver`` is written as if it were alone.
    """
    names = book.names.select("symbol", "namespace", F.transform("path", F.lower).alias("_path"), "dotted").join(book.eco.symbols.select("symbol", "id"), "symbol")
    host = names.select(F.col("symbol").alias("host"), F.col("namespace").alias("_namespace"), F.col("_path").alias("_host_path"), F.col("id").alias("_host_id"))
    base = names.select(F.col("symbol").alias("base"), F.try_element_at("_path", F.lit(-1)).alias("_leaf"), "dotted", F.col("id").alias("_base_id"))
    owners = book.eco.modules.join(book.eco.packages.select("package", F.col("name").alias("_owner"), F.col("rank").alias("_rank")), "package").select(F.col("module").alias("_namespace"), F.lower("name").alias("_module"), F.col("package").alias("_residency"), "_owner", "_rank")
    of = book.eco.modules.select(F.col("module").alias("culture"), F.col("package").alias("_lens")).join(book.eco.packages.select(F.col("package").alias("_lens"), F.col("name").alias("_lens_name")), "_lens")
    written = book.masks.select("package", F.col("ver").alias("_shown"), written_mask(F.col("mask")).alias("_written"))
    depths = book.depths.select("package", *COMPOSITE, "lo", "hi", "need_base", "need_host")
    at = entities.withColumn("_shown", F.coalesce("exhibit", "ver")).join(host, "host", "left").join(base, "base", "left").join(owners, "_namespace", "left").join(of, "culture", "left").join(written, ["package", "_shown"], "left")
    at = at.join(depths.withColumnsRenamed({c: f"_d_{c}" for c in ("package", *COMPOSITE)}), [F.col("package") == F.col("_d_package"), *[F.col(c) == F.col(f"_d_{c}") for c in COMPOSITE], F.col("ver").between(F.col("lo"), F.col("hi"))], "left")
    home = F.col("_lens") == F.col("_residency")
    head = F.array_compact(F.array(F.when(F.col("_rank") == 2, F.col("_owner")), F.when(home, F.col("_written")), F.col("_module")))
    whole = F.when(F.col("base") == F.col("host"), F.col("_host_path")).otherwise(F.concat("_host_path", F.array("_leaf")))
    whole = F.transform(whole, encode_component)
    last, stem = F.try_element_at(whole, F.lit(-1)), F.slice(whole, F.lit(1), F.size(whole) - 1)
    tail = F.when(~F.col("dotted"), F.concat(F.lit("/"), F.array_join(whole, "/"))).when(F.size(whole) > 1, F.concat(F.lit("/"), F.array_join(stem, "/"), F.lit("."), last)).otherwise(F.concat(F.lit("/."), last))
    path = F.concat(F.lit(f"/{_WORD['master']}/"), F.array_join(F.transform(head, encode_component), "/"), tail)
    param = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    lens = F.when(~home, param("from", F.concat("_lens_name", F.coalesce(F.concat(F.lit("/"), "_written"), F.lit("")))))
    told = F.array_compact(F.array(F.when(F.col("need_base"), param("overload", F.col("_base_id"))), F.when(F.col("need_host") & (F.col("base") != F.col("host")), param("self", F.col("_host_id"))), lens))
    params = told if query else F.array().cast(_PARAMS)
    return at.select(*[entities[c] for c in entities.columns], path.alias("path"), params.alias("params"))


def redirects(moves: DataFrame, eco: Ecosystem) -> DataFrame:
    """(uri, kind, package, ver, module, article): the new places of moved modules and of the articles of moved ones, at the
    version of the move; where two moves lead to one place, the later one counts."""
    of = moves.join(eco.modules.select("module", "package"), "module")
    modules = of.filter("kind = 'module'").select("uri", "kind", "package", "ver", "module", F.lit(None).cast("bigint").alias("article"))
    title = F.transform(F.split(F.lower("name"), "/"), encode_component)
    articles = of.filter("kind = 'article'").join(eco.articles, "module", "inner").select(F.concat("uri", F.lit("/"), F.array_join(title, "/")).alias("uri"), "kind", "package", "ver", "module", "article")
    rows = modules.unionByName(articles)
    best = F.max_by(F.struct("kind", "package", "ver", "module", "article"), F.struct("ver", "kind", "module", F.coalesce("article", F.lit(-1))))
    return rows.groupBy("uri").agg(best.alias("to")).select("uri", "to.*")


def _with_uris(found: DataFrame, book: Book) -> DataFrame:
    """``found`` (kind, package, ver, exhibit, module, article, base, host, culture, ...) with path and params; none have null."""
    places = place_uris(found.filter("kind in ('package', 'module', 'article')").withColumn("_written_as", F.coalesce("exhibit", "ver")), book.eco, book.masks, book.moves, "_written_as").drop("_written_as")
    places = places.withColumnRenamed("uri", "path").withColumn("params", F.array().cast(_PARAMS))
    return places.unionByName(composite_uris(found.filter("kind = 'symbol'"), book))


def respond(requests: DataFrame, book: Book) -> DataFrame:
    """(request, kind, uri, canonical, response) of requests (request, path, params).

    What a request means comes from ``resolve_requests``; one that means nothing is looked up among the moves. response is
    match (the request is the entity's own URI, parameters in any order), permanent or temporary (the resolution was
    redirected, so it may change), or none. canonical is, for an inherited composite, the URI of its base on its own at
    its package's latest version, for an entity at an old version that at the latest one, else null. Choices and resources
    match and have no URI of their own here. uri is the path with its parameters.
    """
    asked = requests.select("request", encode_uri(F.coalesce("path", F.array().cast("array<string>"))).alias("asked"), F.coalesce("params", F.array().cast(_PARAMS)).alias("given"))
    resolved = stored(resolve_requests(requests, book.eco), "resolved")
    moved = redirects(book.moves, book.eco).withColumnRenamed("kind", "_kind")
    lost = resolved.filter("kind = 'none'").select("request").join(asked.filter(F.size("given") == 0), "request").join(moved, F.col("asked") == F.col("uri"))
    here = lost.select("request", F.col("_kind").alias("kind"), "package", "ver", F.lit(None).cast("int").alias("exhibit"), "module", "article", *[F.lit(None).cast(t).alias(c) for c, t in (("base", "bigint"), ("host", "bigint"), ("culture", "int"))], F.lit(False).alias("redirected"))
    kept = resolved.join(here.select("request"), "request", "left_anti").select(*here.columns).unionByName(here)
    found = stored(kept, "responses")
    exact = _with_uris(found, book).select("request", "path", "params")
    latest = book.eco.index.filter("mask is null").select("package", F.col("ver").alias("_latest"))
    homes = book.names.select(F.col("symbol").alias("base"), F.col("module").alias("_home")).join(book.eco.modules.select(F.col("module").alias("_home"), F.col("package").alias("_at")), "_home")
    others = found.filter("kind in ('package', 'module', 'article', 'symbol')").join(homes, "base", "left")
    bare = (F.col("kind") == "symbol") & (F.col("base") != F.col("host"))
    others = others.withColumns({"package": F.when(bare, F.col("_at")).otherwise(F.col("package")), "host": F.when(bare, F.col("base")).otherwise(F.col("host")), "culture": F.when(bare, F.col("_home")).otherwise(F.col("culture")), "_bare": bare})
    others = others.join(latest, "package").filter(F.col("_bare") | (F.col("ver") != F.col("_latest"))).withColumns({"ver": F.col("_latest"), "exhibit": F.lit(None).cast("int")}).select(*found.columns)
    canonical = _with_uris(others, book).select("request", F.col("path").alias("_path"), F.col("params").alias("_params"))
    whole = lambda path, params: F.concat(path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(F.transform(params, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&"))).otherwise(""))
    joined = requests.select("request").join(found.select("request", "kind", "redirected"), "request", "left").join(asked, "request").join(exact, "request", "left").join(canonical, "request", "left")
    same = uri_equivalent(F.col("path"), F.col("params"), F.col("asked"), F.col("given"))
    response = F.when(F.col("kind") == "none", "none").when(F.col("kind").isin("choices", "resource") | F.coalesce(same, F.lit(False)), "match").when(F.col("redirected"), "temporary").otherwise("permanent")
    return joined.select("request", "kind", whole(F.col("path"), F.col("params")).alias("uri"), whole(F.col("_path"), F.col("_params")).alias("canonical"), response.alias("response"))
