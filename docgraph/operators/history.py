"""Version-interval histories: keyframes, as-of lookups and the versions of an entity.

A keyframe (entity, lo, hi, value) says that the value stood at every version from lo to hi. Version numbers
are push order. Values are compared as they are (null equals null), never by hash alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.operators.intervals import merged


def push_history(observations: DataFrame, entity: list[str], ver: str = "ver", value: str = "value") -> DataFrame:
    """Folds an observation log into keyframes: one shuffle by entity for the windows and the aggregation."""
    w = Window.partitionBy(*entity).orderBy(ver)
    grows = (F.lag(ver).over(w) == F.col(ver) - 1) & F.lag(value).over(w).eqNullSafe(F.col(value))
    marked = observations.withColumn("_new", (~F.coalesce(grows, F.lit(False))).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*entity, "_island").agg(F.min(ver).alias("lo"), F.max(ver).alias("hi"), F.first(value).alias(value)).drop("_island")


def fold(frames: DataFrame, entity: list[str], value: str = "value") -> DataFrame:
    """Keyframes (entity, lo, hi, value) with those that touch and agree made one; they may not overlap."""
    w = Window.partitionBy(*entity).orderBy("lo")
    grows = (F.lag("hi").over(w) == F.col("lo") - 1) & F.lag(value).over(w).eqNullSafe(F.col(value))
    marked = frames.withColumn("_new", (~F.coalesce(grows, F.lit(False))).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return marked.groupBy(*entity, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first(value).alias(value)).drop("_island")


def pollen(opinions: DataFrame, homes: DataFrame, modules: DataFrame) -> DataFrame:
    """(host, culture, lo, hi): at which versions of their package the modules of other packages held an opinion of a host.

    opinions (host, culture, lo, hi) are keyframes, homes (symbol, culture) the modules of the hosts, modules (module, package).
    """
    of = modules.select(F.col("module").alias("culture"), F.col("package").alias("_of"))
    at = homes.join(modules.select(F.col("module").alias("culture"), F.col("package").alias("_at")), "culture").select(F.col("symbol").alias("host"), "_at")
    abroad = merged(opinions, ["host", "culture"]).join(of, "culture").join(at, "host")
    return abroad.filter(F.col("_of") != F.col("_at")).select("host", "culture", "lo", "hi")


def history_at(history: DataFrame, points: DataFrame, entity: list[str], ver: str = "ver", value: str = "value", default: F.Column | None = None) -> DataFrame:
    """``points`` (entity columns, ver) with the value that stood there, or ``default``, in gaps null. Null entities are entities."""
    h = history.select(*[F.col(e).alias(f"_{e}") for e in entity], "lo", "hi", value)
    match = (F.col(ver) >= F.col("lo")) & (F.col(ver) <= F.col("hi"))
    for e in entity:
        match = match & F.col(e).eqNullSafe(F.col(f"_{e}"))
    found = points.join(h, match, "left").drop("lo", "hi", *[f"_{e}" for e in entity])
    return found if default is None else found.withColumn(value, F.coalesce(value, default))


def versions_of(history: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, ver) of every version that a keyframe covers; keyframes of an entity are disjoint."""
    return history.select(*entity, F.explode(F.sequence("lo", "hi")).alias("ver"))


def latest(history: DataFrame, entity: list[str], value: str = "value") -> DataFrame:
    """The newest keyframe's value of each entity."""
    return history.groupBy(*entity).agg(F.max_by(value, "lo").alias(value), F.max("hi").alias("hi"))
