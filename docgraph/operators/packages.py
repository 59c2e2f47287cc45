"""Packages and modules: scopes, build order, pins and consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.functions.storage import stored


def module_scopes(modules: DataFrame, deps: DataFrame, packages: DataFrame) -> DataFrame:
    """(culture, namespace) that each module sees: itself, explicit dependencies, and the implied libraries.

    A community module implies all core and standard modules, a core one the standard modules.
    """
    ranked = modules.join(packages.select("package", "rank"), "package").select("module", "rank")
    of = F.least(F.col("rank"), F.lit(2))
    below = ranked.filter(of > 0).select(F.col("module").alias("culture"), F.explode(F.sequence(F.lit(0), of - 1)).alias("rank"))
    libraries = ranked.filter(F.col("rank") < 2).select(F.col("module").alias("namespace"), "rank")
    implied = below.join(libraries, "rank")
    own = modules.select(F.col("module").alias("culture"), F.col("module").alias("namespace"))
    explicit = deps.join(modules, deps["dep"] == modules["module"], "left_semi").select(F.col("module").alias("culture"), F.col("dep").alias("namespace"))
    return own.unionByName(explicit).unionByName(implied.select("culture", "namespace")).distinct()


def missing_dependencies(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """Dependencies on modules that do not exist: error rows."""
    return deps.join(modules.select(F.col("module").alias("dep")), "dep", "left_anti").select("module", "dep")


def import_scope(scopes: DataFrame, imports: DataFrame, always: DataFrame) -> DataFrame:
    """Scopes cut down to imported modules; a culture keeps itself and the ``always`` modules."""
    kept = scopes.filter(F.col("culture") == F.col("namespace")).unionByName(scopes.join(always, "namespace", "left_semi").select("culture", "namespace"))
    return scopes.join(imports, ["culture", "namespace"], "left_semi").unionByName(kept).distinct()


def module_order(modules: DataFrame, deps: DataFrame) -> DataFrame:
    """(module, depth): longest dependency path inside the own package; modules on a cycle have depth null.

    One round for each level of the graph, until none is added; the module graph is the small dimension of the data model.
    """
    inside = deps.join(modules.select("module", "package"), "module").join(modules.select(F.col("module").alias("dep"), F.col("package").alias("_p")), "dep").filter(F.col("package") == F.col("_p")).select("module", "dep")
    depth = modules.join(inside.select("module").distinct(), "module", "left_anti").select("module", F.lit(0).alias("depth"))
    waiting = stored(inside, "module-deps")
    known = depth.count()
    while True:
        ready = waiting.join(depth.select(F.col("module").alias("dep"), F.col("depth").alias("_d")), "dep", "left").groupBy("module").agg(F.max("_d").alias("_d"), F.sum(F.col("_d").isNull().cast("int")).alias("open")).filter(F.col("open") == 0)
        depth = stored(depth.unionByName(ready.join(depth, "module", "left_anti").select("module", (F.col("_d") + 1).alias("depth"))), "module-order")
        now = depth.count()
        if now == known:
            break
        known = now
    return modules.select("module").join(depth, "module", "left")


def upstream_packages(scopes: DataFrame, modules: DataFrame) -> DataFrame:
    """(package, dep): the packages in scope of a package's modules, other than the own one."""
    of = modules.select(F.col("module").alias("culture"), "package")
    at = modules.select(F.col("module").alias("namespace"), F.col("package").alias("dep"))
    return scopes.join(of, "culture").join(at, "namespace").filter(F.col("package") != F.col("dep")).select("package", "dep").distinct()


def upstream_pins(pairs: DataFrame, wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(package, dep, dep_ver): the ``upstream_packages`` at the lockfile's or the latest version.

    ``wanted`` (package, dep, mask) are lockfile rows; ``index`` (package, mask, ver) is the version index, which has many
    rows for each package that is read. Both grow with the packages: they are sorted and merged with the pairs, never broadcast.
    """
    named = index.filter(F.col("mask").isNotNull()).select(F.col("package").alias("dep"), "mask", F.col("ver").alias("locked")).hint("merge")
    newest = index.filter(F.col("mask").isNull()).select(F.col("package").alias("dep"), F.col("ver").alias("newest")).hint("merge")
    return pairs.join(wanted.hint("merge"), ["package", "dep"], "left").join(named, ["dep", "mask"], "left").join(newest, "dep", "left").select("package", "dep", F.coalesce("locked", "newest").alias("dep_ver"))


def consumers(pins: DataFrame) -> DataFrame:
    """(dep, dep_ver, consumer, rank): the reverse of the pins, one row a consumer, in their order from 1.

    Long, since every package may use a standard library; pins without a package or a version are left out.
    """
    used = pins.filter("package is not null and dep_ver is not null").select("dep", "dep_ver", F.col("package").alias("consumer")).distinct()
    return ranked_within(used, ["dep", "dep_ver"], "consumer")


def register_first_seen(arrivals: DataFrame, key: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """(key, idx): stable numbers in order of first arrival, after the ``known`` ones.

    Numbers within hash partitions are added to the partitions' totals, so no task sees every key.
    """
    first = arrivals.groupBy(key).agg(F.min(F.struct(*order, F.col(key).alias("_tie"))).alias("_at"))
    base = 0
    if known is not None:
        first = first.join(known, key, "left_anti")
        last = known.agg(F.max("idx")).first()[0]
        base = 0 if last is None else last + 1
    ranked = stored(first.repartitionByRange("_at").withColumn("_part", F.spark_partition_id()), "arrivals")
    counts = ranked.groupBy("_part").count()
    before = {r["_part"]: r["count"] for r in counts.collect()}
    start, total = {}, base
    for part in sorted(before):
        start[part] = total
        total += before[part]
    offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv]) if start else F.create_map(F.lit(0), F.lit(0))
    w = Window.partitionBy("_part").orderBy("_at")
    new = ranked.select(key, (F.row_number().over(w) - 1 + offset[F.col("_part")]).cast("bigint").alias("idx"))
    return new if known is None else known.select(key, "idx").unionByName(new)


def ranked_within(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """``rows`` with their rank by member within their keys, from 1; rows are taken to be distinct.

    Rows are dealt by range over keys and member, so that one very large group spreads over many tasks; a rank is that
    within the task's part of the group plus the sizes of the parts before it.
    """
    dealt = stored(rows.repartitionByRange(*keys, member).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(member))
    return dealt.join(sizes.select(*keys, "_part", before.alias("_before")), [*keys, "_part"]).select(*rows.columns, (own + F.col("_before")).cast("bigint").alias("rank"))
