"""Shapes of symbols over versions: what facts say, what stays from before, what a path tells; groups by lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.operators.routes import ROUTE

LENS = ["package", *ROUTE]
COMPOSITE = ["base", "host", "culture"]


def first_shapes(statements: DataFrame) -> DataFrame:
    """(symbol, shape, parent): the first statement (by position, then slot and object) that makes a symbol a member or
    a requirement. Symbols of which none says so are left out; whether there are others is told by ``fold_roles``."""
    said = statements.filter((F.col("verb") == "is") & F.col("slot").isin("member", "requirement"))
    first = F.min_by(F.struct("slot", "object"), F.struct("pos", "slot", "object")).alias("s")
    return said.groupBy(F.col("subject").alias("symbol")).agg(first).select("symbol", F.col("s.slot").alias("shape"), F.col("s.object").alias("parent"))


def role_rows(statements: DataFrame) -> DataFrame:
    """(subject, slot, object), each once: the roles of symbols in long form, without members, requirements and
    superclasses, which are shapes."""
    own = statements.filter((F.col("verb") == "is") & ~F.col("slot").isin("member", "requirement", "subclass"))
    return own.select("subject", "slot", "object").distinct()


def lens_groups(pushed: DataFrame) -> DataFrame:
    """(package, route, base, host, culture, retains, lo, composites) of ``pushed`` (package, ver, route, base, host,
    culture): the composites of each route as the pushing package sees it.

    ``retains`` counts the versions that were pushed with the composite, ``lo`` is the first of them, ``composites`` how many
    share the route. Repeated rows of a version count once, null route columns are a route of their own.
    """
    held = pushed.groupBy(*LENS, *COMPOSITE).agg(F.countDistinct("ver").alias("retains"), F.min("ver").alias("lo"))
    sizes = held.groupBy(*[F.col(c).alias(f"_{c}") for c in LENS]).agg(F.count(F.lit(1)).alias("composites"))
    same = F.lit(True)
    for c in LENS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return held.join(sizes, same).select(*LENS, *COMPOSITE, "retains", "lo", "composites")


def only_composites(groups: DataFrame) -> DataFrame:
    """(package, route, base, host, culture, lo, hi): the composite that has a route to itself, from its first version to
    the one before the next composite comes (hi is null if none does). ``groups`` come from ``lens_groups``.

    Groups only grow, so that there is one such stretch at most: it begins with the first composite and is empty if two
    come at once. Both ends are aggregates; no task holds a group.
    """
    mark = F.struct("lo", *COMPOSITE)
    heads = groups.groupBy(*LENS).agg(F.min(mark).alias("_first"))
    later = groups.join(heads, LENS).filter(mark != F.col("_first")).groupBy(*LENS).agg(F.min("lo").alias("_next"))
    whole = heads.join(later, LENS, "left").select(*LENS, *[f"_first.{c}" for c in COMPOSITE], "_first.lo", (F.col("_next") - 1).alias("hi"))
    return whole.filter("hi is null or hi >= lo")


def infer_shapes(pushed: DataFrame, paths: DataFrame, groups: DataFrame) -> DataFrame:
    """(symbol, ver, shape, parent, origin) for each of ``pushed`` (symbol, ver, shape, parent), where shape and parent
    are what the facts of that version say (null: nothing; one row for each symbol and version).

    What is said counts, and stays at later versions that say nothing (origin kept). Where nothing was known, the
    composite that alone has the route of the path's prefix at that version, if it is natural, becomes the parent
    (inferred) and stays as well, until facts say another. Else the symbol is an orphan, or a root without a prefix.
    ``paths`` (symbol, package, namespace, path), ``groups`` as of ``lens_groups``; symbols without a path are left out.
    """
    low = F.transform("path", F.lower)
    stem = F.array_join(F.slice(low, F.lit(1), F.greatest(F.size("path") - 2, F.lit(0))), "\t")
    known = paths.filter("path is not null").select("symbol", "package", "namespace", stem.alias("stem"), F.try_element_at(low, F.lit(-2)).alias("leaf"), F.lit("/").alias("orientation"))
    rows = pushed.join(known, "symbol")
    alone = only_composites(groups).filter("base = host").select(*LENS, "base", "lo", "hi")
    found = rows.join(alone, LENS, "left").withColumn("_found", F.when(F.col("shape").isNull() & (F.col("ver") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("ver") <= F.col("hi"))), F.col("base")))
    order = Window.partitionBy("symbol").orderBy("ver")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = F.when(F.col("shape").isNotNull(), F.struct("shape", "parent"))
    guess = F.first("_found", ignorenulls=True).over(before)
    state = F.coalesce(F.last(said, ignorenulls=True).over(before), F.when(guess.isNotNull(), F.struct(F.lit("member").alias("shape"), guess.alias("parent"))))
    stated = found.withColumn("_state", state).withColumn("_was", F.lag("_state").over(order))
    origin = F.when(F.col("shape").isNotNull(), "said").when(F.col("_was").isNotNull(), "kept").when(F.col("_found").isNotNull(), "inferred").when(F.col("leaf").isNotNull(), "orphan").otherwise("root")
    return stated.select("symbol", "ver", F.col("_state.shape").alias("shape"), F.col("_state.parent").alias("parent"), origin.alias("origin"))


def inferred_members(shapes: DataFrame, cultures: DataFrame) -> DataFrame:
    """(subject, ver, culture, slot, object, belief): the traits that inferred parents get from ``infer_shapes``.

    Only a parent whose own facts are pushed at that version gets one; it is primary in the parent's own culture (null
    cultures equal nothing) and accepted in another. ``cultures`` are (symbol, culture).
    """
    new = shapes.filter("origin = 'inferred'").select("ver", F.col("symbol").alias("object"), F.col("parent").alias("subject"))
    hosts = shapes.select(F.col("symbol").alias("subject"), "ver").distinct()
    of = cultures.select(F.col("symbol").alias("object"), "culture")
    at = cultures.select(F.col("symbol").alias("subject"), F.col("culture").alias("home"))
    placed = new.join(hosts, ["subject", "ver"]).join(of, "object").join(at, "subject")
    return placed.select("subject", "ver", "culture", F.lit("member").alias("slot"), "object", F.when(F.col("culture") == F.col("home"), "primary").otherwise("accepted").alias("belief"))
