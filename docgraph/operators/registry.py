"""Registration of symbols, module sets, URIs of packages and modules, redirects and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.uri import encode_component
from docgraph.operators.packages import ranked_within, register_first_seen


def register_symbols(vertices: DataFrame, scopes: DataFrame, known: DataFrame) -> DataFrame:
    """(id, module, idx, status): ids of a package; the first module (by position) owns an id.

    status is new, known, moved (registered in another module already) or colony (its namespace is out of scope).
    ``known`` (id, module, idx) keep their numbers; new ids get the next ones in order of arrival, colonies none.
    """
    first = vertices.groupBy("id").agg(F.min(F.struct("pos", "culture", "namespace")).alias("v")).select("id", "v.pos", "v.culture", "v.namespace")
    seen = scopes.select("culture", "namespace", F.lit(True).alias("in_scope"))
    judged = first.join(seen, ["culture", "namespace"], "left").join(known.select("id", F.col("module").alias("had")), "id", "left")
    status = F.when(F.col("had").isNotNull() & (F.col("had") != F.col("culture")), "moved").when(F.col("had").isNotNull(), "known").when(F.col("in_scope").isNull(), "colony").otherwise("new")
    judged = judged.select("id", "pos", F.coalesce("had", "culture").alias("module"), status.alias("status"))
    numbers = register_first_seen(judged.filter("status = 'new'"), "id", ["pos"], known.select("id", "idx"))
    return judged.join(numbers, "id", "left").select("id", "module", "idx", "status")


def updated_symbols(vertices: DataFrame, registered: DataFrame) -> DataFrame:
    """(culture, id): a graph's own vertices whose registered module is the graph's culture."""
    return vertices.select("culture", "id").distinct().join(registered.select("id", F.col("module").alias("culture")), ["culture", "id"], "left_semi")


def union_dependencies(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """(package, dep): the modules that a package's modules depend on inside it."""
    own = modules.select("module", "package")
    inside = deps.join(own, "module").join(own.select(F.col("module").alias("dep"), F.col("package").alias("_p")), "dep")
    return inside.filter(F.col("package") == F.col("_p")).select("package", "dep").distinct()


def module_set_members(paths: DataFrame, deps: DataFrame, articles: DataFrame) -> DataFrame:
    """(module, kind, member), each once: kind is dependency (modules it depends on), toplevel (symbols without a parent) or
    guide (its articles, where it has any). Members have any type, those of all kinds the same."""
    top = paths.filter(F.size("path") == 1).select(F.col("culture").alias("module"), F.lit("toplevel").alias("kind"), F.col("symbol").alias("member"))
    needs = deps.select("module", F.lit("dependency").alias("kind"), F.col("dep").alias("member"))
    guides = articles.select(F.col("culture").alias("module"), F.lit("guide").alias("kind"), F.col("article").alias("member"))
    return top.unionByName(needs).unionByName(guides).distinct()


def module_sets(paths: DataFrame, deps: DataFrame, articles: DataFrame) -> DataFrame:
    """(module, kind, member, rank): what belongs to a module, in long form, so that no task holds a module's set.

    rank counts from 1 by member within a module and kind. A history of the sets is one of their members: a set at a
    version has the members whose keyframes cover it (``HistoryStore`` with module, kind and member as the entity).
    """
    return ranked_within(module_set_members(paths, deps, articles), ["module", "kind"], "member")


def sort_roles(roles: DataFrame, paths: DataFrame) -> DataFrame:
    """(subject, object, rank): by the path of the owning type, or of the object if it has none, then its own."""
    p = paths.select(F.col("symbol").alias("object"), F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path")).alias("host_path"), "path")
    w = Window.partitionBy("subject").orderBy("host_path", "path", "object")
    return roles.join(p, "object").select("subject", "object", F.row_number().over(w).alias("rank"))


def entity_uri(modules: DataFrame, packages: DataFrame, masks: DataFrame, root: str = "reference") -> DataFrame:
    """(package, ver, module, uri): root, package (community only), version (not the latest), module (or none)."""
    mask = F.replace(F.substring("mask", F.length(F.substring_index("mask", ":", 1)) + 2, F.length("mask")), F.lit(":"), F.when(F.startswith("mask", F.lit("toolchain")), "-").otherwise("."))
    owner = packages.join(masks, "package").withColumn("written", mask)
    head = F.array_compact(F.array(F.lit(root), F.when(F.col("rank") == 2, encode_component(F.col("name"))), F.col("written")))
    of = owner.select("package", "ver", head.alias("head"))
    own = of.select("package", "ver", F.lit(None).cast("int").alias("module"), F.concat(F.lit("/"), F.array_join("head", "/")).alias("uri"))
    each = of.join(modules, "package").select("package", "ver", "module", F.concat(F.lit("/"), F.array_join(F.concat("head", F.array(encode_component(F.lower(modules["name"])))), "/")).alias("uri"))
    return own.unionByName(each)


def canonical_uri(uris: DataFrame) -> DataFrame:
    """(base, host, uri, canonical): a synthesized composite's is that of its natural base, else none."""
    natural = uris.filter(F.col("base") == F.col("host")).select(F.col("base").alias("_b"), F.col("uri").alias("_u"))
    return uris.join(natural, F.col("base") == F.col("_b"), "left").select("base", "host", "uri", F.when(F.col("base") != F.col("host"), F.col("_u")).alias("canonical"))


def redirect_table(requests: DataFrame, uris: DataFrame) -> DataFrame:
    """(request, uri, kind): requests (request, asked, base, host, redirected) against the composites' URIs."""
    joined = requests.join(uris.select("base", "host", "uri"), ["base", "host"], "left")
    kind = F.when(F.col("uri").isNull(), "none").when(F.col("uri") == F.col("asked"), "match").when(F.col("redirected"), "temporary").otherwise("permanent")
    return joined.select("request", "uri", kind.alias("kind"))


def localize_pins(links: DataFrame, pins: DataFrame) -> DataFrame:
    """(link, package, ver): the lens's package and version, else the destination's pin; unknown ones go."""
    asked = links.select("link", F.coalesce("lens_package", "package").alias("package"), F.when(F.col("lens_package").isNotNull(), F.col("lens_ver")).otherwise(F.col("ver")).alias("ver"))
    return asked.join(pins.select("package", "ver"), ["package", "ver"], "left_semi").select("link", "package", "ver")


def composite_exists(composites: DataFrame, natural: DataFrame, features: DataFrame, homes: DataFrame, modules: DataFrame) -> DataFrame:
    """(base, host, culture, ver, exists): natural ones stand with their base's facts, others with a feature of the host.

    natural (symbol, lo, hi) and features (host, base, culture, belief, lo, hi) are histories; homes (symbol, culture)
    are the modules of the hosts. A host in the culture's own module has the feature as primary, one of the same package
    as accepted, any other as an opinion of the culture. Equality comes before the range; repeated rows stay repeated.
    """
    of = modules.select(F.col("module").alias("culture"), F.col("package").alias("_of"))
    home = homes.select(F.col("symbol").alias("host"), F.col("culture").alias("_home"))
    at = modules.select(F.col("module").alias("_home"), F.col("package").alias("_at"))
    belief = F.when(F.col("culture") == F.col("_home"), "primary").when(F.col("_of") == F.col("_at"), "accepted").otherwise("opinion")
    keys = ["base", "host", "culture", "ver"]
    asked = composites.select(*keys).distinct()
    during = F.col("ver").between(F.col("lo"), F.col("hi"))
    own = asked.filter("base = host").join(natural.select(F.col("symbol").alias("base"), "lo", "hi"), "base").filter(during).select(*keys)
    sides = asked.filter("base <> host").join(home, "host").join(of, "culture", "left").join(at, "_home", "left").withColumn("belief", belief)
    inherited = sides.join(features, ["host", "base", "culture", "belief"]).filter(during).select(*keys)
    there = own.unionByName(inherited).distinct().withColumn("there", F.lit(True))
    return composites.join(there, keys, "left").select(*keys, F.coalesce("there", F.lit(False)).alias("exists"))
