"""Facts: edges become statements, statements become traits and roles, traits split into beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (relation, source class, target class, verb and slot of the source, of the target).
RULES = [
    ("feature", "callable", "concrete", None, None, "has", "feature"),
    ("member", "concrete", "concrete", "is", "member", "has", "member"),
    ("member", "typealias", "concrete", "is", "member", "has", "member"),
    ("member", "callable", "concrete", "is", "member", "has", "member"),
    ("member", "concrete", "protocol", "is", "member", "has", "member"),
    ("member", "typealias", "protocol", "is", "member", "has", "member"),
    ("member", "callable", "protocol", "is", "member", "has", "member"),
    ("conformer", "concrete", "protocol", "has", "conformance", "has", "conformer"),
    ("conformer", "protocol", "protocol", "is", "refinement", "has", "refinement"),
    ("subclass", "concrete", "concrete", "is", "subclass", "has", "subclass"),
    ("override", "associatedtype", "associatedtype", "is", "override", "has", "override"),
    ("override", "callable", "callable", "is", "override", "has", "override"),
    ("requirement", "associatedtype", "protocol", "is", "requirement", "is", "interface"),
    ("requirement", "callable", "protocol", "is", "requirement", "is", "interface"),
    ("optionalRequirement", "associatedtype", "protocol", "is", "requirement", "is", "interface"),
    ("optionalRequirement", "callable", "protocol", "is", "requirement", "is", "interface"),
    ("defaultImplementation", "callable", "callable", "is", "implementation", "has", "implementation"),
]
_RULE_COLUMNS = "relation string, source_class string, target_class string, source_verb string, source_slot string, target_verb string, target_slot string"
CONSTRAINTS = "array<struct<subject:string,verb:string,object:bigint>>"


def resolve_identifiers(identifiers: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """(culture, id, symbol, n): the registered symbol whose module the culture sees; n > 1 is an error.

    The symbols are the deduplicated dimension; a module's scope is small and follows by equality on culture.
    """
    seen = identifiers.join(symbols.select(F.col("id").alias("_id"), "symbol", F.col("module").alias("namespace")), F.col("id") == F.col("_id")).join(scopes, ["culture", "namespace"])
    found = seen.groupBy("culture", "id").agg(F.countDistinct("symbol").alias("n"), F.min("symbol").alias("symbol"))
    return identifiers.join(found, ["culture", "id"], "left").select("culture", "id", F.when(F.col("n") == 1, F.col("symbol")).alias("symbol"), F.coalesce("n", F.lit(0)).alias("n"))


#: An edge without its constraints, which a number stands for in shuffles; at one position there is one edge.
_EDGE = ["source", "relation", "target", "pos", "bound"]


def _with_bad(placed: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """``placed`` with ``bad``: whether a constraint's target is unknown or out of the culture's scope.

    Only edges with constraints are joined back, by their ids and position and a hash of the constraints.
    """
    bounded = placed.filter(F.size("constraints") > 0).withColumn("bound", F.xxhash64("constraints"))
    asked = bounded.select(*_EDGE, "culture", F.explode("constraints.object").alias("object"))
    at = symbols.select(F.col("symbol").alias("object"), F.col("namespace").alias("object_namespace"))
    seen = scopes.select("culture", F.col("namespace").alias("object_namespace"), F.lit(True).alias("seen"))
    found = asked.join(at, "object", "left").join(seen, ["culture", "object_namespace"], "left")
    bad = found.filter(F.col("seen").isNull()).select(*[F.col(c).alias(f"_{c}") for c in _EDGE]).distinct().withColumn("bad", F.lit(True))
    same = F.lit(True)
    for c in _EDGE:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    judged = bounded.join(bad, same, "left").select(*placed.columns, F.coalesce("bad", F.lit(False)).alias("bad"))
    return placed.filter(F.size("constraints") == 0).withColumn("bad", F.lit(False)).unionByName(judged)


def resolve_edges(edges: DataFrame, symbols: DataFrame, scopes: DataFrame) -> DataFrame:
    """Edges with culture, endpoint classes and ``resolved``: does the source's culture see both ends and every
    constraint's target.

    Edges are (source, relation, target, pos, constraints), constraints (subject, verb, object) in order; null
    counts as none. An edge with an unknown end stays, unresolved (culture null if the source is unknown), so that
    dropped edges can be counted; repeated rows stay repeated.
    """
    s = symbols.select(F.col("symbol").alias("source"), F.col("culture"), F.col("class").alias("source_class"), F.col("community").alias("source_community"))
    t = symbols.select(F.col("symbol").alias("target"), F.col("class").alias("target_class"), F.col("community").alias("target_community"), "namespace")
    given = edges.withColumn("constraints", F.coalesce("constraints", F.array().cast(CONSTRAINTS)))
    placed = _with_bad(given.join(s, "source", "left"), symbols, scopes)
    scoped = scopes.select("culture", "namespace", F.lit(True).alias("in_scope"))
    ends = placed.join(t, "target", "left").join(scoped, ["culture", "namespace"], "left")
    return ends.withColumn("resolved", F.col("in_scope").isNotNull() & ~F.col("bad")).drop("in_scope", "bad")


def edge_statements(edges: DataFrame) -> DataFrame:
    """(subject, verb, slot, object, conditions, culture, pos) of resolved edges, and rows with verb null for rejects.

    Conformances keep their constraints as conditions; a protocol refines another unconditionally or not at all.
    Other relations have no conditions (an empty array).
    """
    rules = edges.sparkSession.createDataFrame(RULES, _RULE_COLUMNS)
    joined = edges.join(F.broadcast(rules), ["relation", "source_class", "target_class"], "left")
    both_classes = (F.col("source_community") == "class") & (F.col("target_community") == "class")
    unconditional = (F.col("target_slot") != "refinement") | (F.size("constraints") == 0)
    legal = F.col("target_slot").isNotNull() & ((F.col("relation") != "subclass") | both_classes) & unconditional
    conditions = F.when(F.col("target_slot") == "conformer", F.col("constraints")).otherwise(F.array().cast(CONSTRAINTS)).alias("conditions")
    side = lambda one, verb, slot, other: F.struct(F.col(one).alias("subject"), verb.alias("verb"), slot.alias("slot"), F.col(other).alias("object"), conditions)
    none = F.lit(None).cast("string")
    first = side("source", F.col("source_verb"), F.col("source_slot"), "target")
    second = side("target", F.col("target_verb"), F.col("target_slot"), "source")
    rows = F.when(legal, F.filter(F.array(first, second), lambda s: s["verb"].isNotNull())).otherwise(F.array(side("source", none, none, "target")))
    return joined.select("relation", "culture", "pos", F.explode(rows).alias("s")).select("s.*", "relation", "culture", "pos")


def traits(statements: DataFrame) -> DataFrame:
    """(subject, culture, slot, object, pos, conditions): distinct traits in long form; the last position wins,
    the greatest conditions at equal positions."""
    last = F.max(F.struct("pos", "conditions")).alias("_last")
    return statements.filter(F.col("verb") == "has").groupBy("subject", "culture", "slot", "object").agg(last).select("subject", "culture", "slot", "object", "_last.pos", "_last.conditions")


def fold_traits(long: DataFrame) -> DataFrame:
    """(subject, culture, slot, objects, conditions): the sorted objects of each slot, their conditions beside them."""
    pairs = long.groupBy("subject", "culture", "slot").agg(F.array_sort(F.collect_list(F.struct("object", "conditions"))).alias("_pairs"))
    return pairs.select("subject", "culture", "slot", F.col("_pairs.object").alias("objects"), F.col("_pairs.conditions").alias("conditions"))


def fold_roles(statements: DataFrame) -> DataFrame:
    """(subject, shape, parent, superclass, roles, error): two different parents or superclasses are an error."""
    own = statements.filter(F.col("verb") == "is")
    shape = F.col("slot").isin("member", "requirement")
    up = F.col("slot") == "subclass"
    g = own.groupBy("subject").agg(
        F.countDistinct(F.when(shape, F.struct("slot", "object"))).alias("n_parents"),
        F.min(F.when(shape, F.struct(F.col("slot"), F.col("object")))).alias("first"),
        F.countDistinct(F.when(up, F.col("object"))).alias("n_supers"),
        F.min(F.when(up, F.col("object"))).alias("superclass"),
        F.array_sort(F.collect_set(F.when(~shape & ~up, F.col("object")))).alias("roles"),
    )
    bad = (F.col("n_parents") > 1) | (F.col("n_supers") > 1)
    return g.select("subject", F.when(~bad, F.col("first.slot")).alias("shape"), F.when(~bad, F.col("first.object")).alias("parent"), F.when(~bad, F.col("superclass")).alias("superclass"), "roles", bad.alias("error"))


def subtract_traits(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without an equal row (nulls equal) in ``right`` on ``keys``."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(r, on, "left_anti")


def split_beliefs(long: DataFrame, symbols: DataFrame, modules: DataFrame, updated: DataFrame) -> DataFrame:
    """(subject, culture, slot, object, conditions, belief): primary, accepted (same package, other module) or opinion.

    Facts belong to the ``updated`` (symbol) of this push; what is said of any other host is an opinion. An accepted
    trait that the primary facts have already, under equal conditions, is dropped.
    """
    home = symbols.select(F.col("symbol").alias("subject"), F.col("culture").alias("home"))
    of = modules.select(F.col("module").alias("culture"), F.col("package").alias("culture_package"))
    at = modules.select(F.col("module").alias("home"), F.col("package").alias("home_package"))
    new = updated.select(F.col("symbol").alias("subject"), F.lit(True).alias("new")).distinct()
    sorted_ = long.join(home.join(new, "subject", "left"), "subject").join(of, "culture").join(at, "home")
    own = F.when(F.col("culture") == F.col("home"), "primary").when(F.col("culture_package") == F.col("home_package"), "accepted")
    belief = F.when(F.col("new"), F.coalesce(own, F.lit("opinion"))).otherwise("opinion")
    marked = sorted_.select("subject", "culture", "slot", "object", "conditions", belief.alias("belief"))
    primary = marked.filter(F.col("belief") == "primary")
    accepted = subtract_traits(marked.filter(F.col("belief") == "accepted"), primary, ["subject", "slot", "object", "conditions"])
    return primary.unionByName(accepted).unionByName(marked.filter(F.col("belief") == "opinion"))
