"""Symbol paths, routes, overload depth, breadcrumbs and URIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.functions.storage import stored
from docgraph.functions.uri import encode_component, route_key


def symbol_paths(symbols: DataFrame) -> DataFrame:
    """``symbols`` (symbol, name, parent, ...; each symbol once) with ``path`` (names from the root) and ``trail`` (symbols
    from the root).

    Pointer doubling: each round puts the path of a row's next ancestor before its own, so that the rounds grow with
    the logarithm of the depth. Rows that have reached their root are set apart, only the others are joined on. A
    parent that does not exist ends the path. A round that brings no row to its root leaves symbols on a cycle of parents
    and those below it: they have a null path and trail, and their arrays never outgrow the longest real path twofold.
    """
    keep, of = symbols.columns, f"array<{symbols.schema['symbol'].dataType.simpleString()}>"
    trail = F.array().cast(of)
    walk = symbols.withColumns({"path": F.array("name"), "trail": F.array("symbol"), "_next": F.col("parent")})
    settled, waiting, open_rows = walk.filter("_next is null"), None, walk.filter("_next is not null")
    while True:
        up = settled.unionByName(open_rows).select(F.col("symbol").alias("_s"), F.col("path").alias("_p"), F.col("trail").alias("_t"), F.col("_next").alias("_n"))
        on = open_rows.join(up, F.col("_next") == F.col("_s"), "left")
        longer = {"path": F.concat(F.coalesce("_p", F.array().cast("array<string>")), "path"), "trail": F.concat(F.coalesce("_t", trail), "trail"), "_next": F.col("_n")}
        walk = stored(on.withColumns(longer).select(*keep, "path", "trail", "_next"), "paths")
        settled, open_rows = settled.unionByName(walk.filter("_next is null")), walk.filter("_next is not null")
        left = open_rows.count()
        if left in (0, waiting):
            break
        waiting = left
    none = open_rows.withColumns({"path": F.lit(None).cast("array<string>"), "trail": F.lit(None).cast(of)})
    return settled.unionByName(none).drop("_next") if left else settled.drop("_next")


def breadcrumbs(paths: DataFrame) -> DataFrame:
    """(symbol, level, ancestor): from the root down to the symbol's parent."""
    return paths.select("symbol", F.posexplode(F.slice("trail", F.lit(1), F.size("trail") - 1)).alias("level", "ancestor"))


def composite_breadcrumbs(composites: DataFrame, trails: DataFrame) -> DataFrame:
    """(base, host, culture, level, ancestor): the trail of a page from the root down, levels from 0.

    A symbol at its own place has the symbols above it, an inherited one those above its host and the host. ``trails``
    (symbol, trail: from the root to the symbol, as of ``symbol_paths``); hosts with a null trail have no crumbs.
    """
    above = composites.join(trails.select(F.col("symbol").alias("host"), "trail"), "host")
    crumbs = F.when(F.col("base") == F.col("host"), F.slice("trail", F.lit(1), F.size("trail") - 1)).otherwise(F.col("trail"))
    return above.select("base", "host", "culture", F.posexplode(crumbs).alias("level", "ancestor"))


def natural_routes(paths: DataFrame) -> DataFrame:
    """(namespace, stem, leaf, orientation, base, host, culture) of every symbol at its own path."""
    return paths.filter(F.col("path").isNotNull()).withColumn("_k", route_key(F.col("path"), F.col("class"))).select("namespace", "_k.stem", "_k.leaf", "_k.orientation", F.col("symbol").alias("base"), F.col("symbol").alias("host"), "culture")


def synthetic_routes(paths: DataFrame, features: DataFrame) -> DataFrame:
    """Routes of inherited members: the host's path as stem, the feature's leaf. features (host, feature, culture)."""
    low = lambda c: F.transform(c, F.lower)
    host = paths.filter(F.col("path").isNotNull()).select(F.col("symbol").alias("host"), "namespace", F.array_join(low(F.col("path")), "\t").alias("stem"))
    feature = paths.filter(F.col("path").isNotNull()).select(F.col("symbol").alias("feature"), F.lower(F.element_at("path", -1)).alias("leaf"), F.when(F.col("class").isin("callable", "global"), ".").otherwise("/").alias("orientation"))
    return features.join(host, "host").join(feature, "feature").select("namespace", "stem", "leaf", "orientation", F.col("feature").alias("base"), "host", "culture")


ROUTE = ["namespace", "stem", "leaf", "orientation"]


def route_groups(routes: DataFrame) -> DataFrame:
    """Composites by route with their retain counts, and how many composites the route has."""
    held = routes.groupBy(*ROUTE, "base", "host", "culture").agg(F.count(F.lit(1)).alias("retains"))
    return held.join(held.groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("composites")), ROUTE)


def overload_depth(routes: DataFrame) -> DataFrame:
    """Composites with need_base (another base on the route) and need_host (the base stands there twice).

    Distinct bases come from one aggregation, so that no window has to hold a route's rows.
    """
    distinct = routes.select(*ROUTE, "base", "host", "culture").distinct()
    by_base = distinct.groupBy(*ROUTE, "base").agg(F.count(F.lit(1)).alias("same"))
    by_route = by_base.groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("bases"))
    joined = distinct.join(by_base, [*ROUTE, "base"]).join(by_route, ROUTE)
    return joined.select(*ROUTE, "base", "host", "culture", ((F.col("bases") > 1) | (F.col("same") > 1)).alias("need_base"), (F.col("same") > 1).alias("need_host"))


def composite_uri(depths: DataFrame, modules: DataFrame, packages: DataFrame) -> DataFrame:
    """(base, host, culture, uri): package (community only), module, stem and leaf; a dotted leaf hangs on the
    last stem component; overload and self where the route is shared."""
    owner = modules.join(packages.select(F.col("package"), F.col("name").alias("package_name"), "rank"), "package").select(F.col("module").alias("namespace"), F.lower("name").alias("module_name"), F.when(F.col("rank") == 2, F.col("package_name")).alias("shown"))
    parts = F.array_compact(F.array(F.col("shown"), F.col("module_name")))
    stem = F.when(F.col("stem") == "", F.array().cast("array<string>")).otherwise(F.split("stem", "\t"))
    whole = F.concat(F.transform(parts, encode_component), F.transform(stem, encode_component))
    dotted = (F.col("orientation") == ".") & (F.col("stem") != "")
    leaf = encode_component(F.col("leaf"))
    path = F.concat(F.lit("/"), F.array_join(whole, "/"), F.when(dotted, ".").otherwise("/"), leaf)
    query = F.concat_ws("&", F.when(F.col("need_base"), F.concat(F.lit("overload=s"), F.col("base").cast("string"))), F.when(F.col("need_host"), F.concat(F.lit("self=s"), F.col("host").cast("string"))))
    return depths.join(owner, "namespace").select("base", "host", "culture", F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")).alias("uri"))

