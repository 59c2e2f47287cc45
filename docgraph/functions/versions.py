"""Versions: masked (missing parts) and precise ones, patterns, indexes and labels.

A version is a struct (kind, a, b, c, d): semantic major/minor/patch/edition or toolchain year/month/day/letter
(the letter as a code point). A mask has null for the parts that it leaves open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The written forms.
SEMANTIC = r"^([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:\.([0-9]+))?$"
DATE = r"^([0-9]+)-([0-9]+)-([0-9]+)(?:-([a-z]))?$"
RELEASE = r"^swift-([0-9]+\.[0-9]+(?:\.[0-9]+)?)-RELEASE$"
SNAPSHOT = r"^swift-DEVELOPMENT-SNAPSHOT-([0-9]+-[0-9]+-[0-9]+(?:-[a-z])?)$"
MOST = 65535


def parse_version(text: Column) -> Column:
    """The masked version, null if the text is none or a part exceeds 65535."""
    semantic, date = F.regexp_like(text, F.lit(SEMANTIC)), F.regexp_like(text, F.lit(DATE))
    parts = F.split(text, "[.-]")
    part = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("int")
    letter = F.when(semantic, part(4)).otherwise(F.ascii(F.nullif(F.regexp_extract(text, DATE, 4), F.lit(""))))
    fits = F.forall(parts, lambda p: (p >= "a") | (F.length(p) <= 9) & (p.try_cast("int") <= MOST))
    return F.when((semantic | date) & fits, F.struct(F.when(semantic, F.lit("semantic")).otherwise(F.lit("toolchain")).alias("kind"), part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), letter.alias("d")))


def toolchain_text(text: Column) -> Column:
    """The version within a toolchain's tag, null if it is no tag."""
    return F.when(F.regexp_like(text, F.lit(RELEASE)), F.regexp_extract(text, RELEASE, 1)).when(F.regexp_like(text, F.lit(SNAPSHOT)), F.regexp_extract(text, SNAPSHOT, 1))


def parsed(frame: DataFrame, text: Column, to: str) -> DataFrame:
    """``frame`` with the parsed version of a text as a column that later expressions refer to, not repeat."""
    return frame.withColumn(to, F.explode(F.array(parse_version(text))))


def parse_toolchain(text: Column) -> Column:
    """The version that a toolchain's tag names, null if it is no tag."""
    return parse_version(toolchain_text(text))


def version_string(v: Column) -> Column:
    """The canonical text of a masked version."""
    numbers = F.concat_ws(".", v["a"].cast("string"), v["b"].cast("string"), v["c"].cast("string"), v["d"].cast("string"))
    date = F.concat_ws("-", v["a"].cast("string"), v["b"].cast("string"), v["c"].cast("string"), F.when(v["d"].isNotNull(), F.char(v["d"])))
    return F.when(v["kind"] == "semantic", numbers).when(v["kind"] == "toolchain", date)


def precise_version(v: Column) -> Column:
    """Open parts become 0, an open letter becomes a; null becomes 0.0.0.0."""
    kind = F.coalesce(v["kind"], F.lit("semantic"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.struct(kind.alias("kind"), zero(v["a"]).alias("a"), zero(v["b"]).alias("b"), zero(v["c"]).alias("c"), F.coalesce(v["d"], F.when(kind == "toolchain", 97).otherwise(0)).alias("d"))


def match_version(mask: Column, precise: Column) -> Column:
    """Does the precise version fit the pattern; a null pattern fits all."""
    ok = mask["kind"] == precise["kind"]
    for n in "abcd":
        ok = ok & (mask[n].isNull() | (mask[n] == precise[n]))
    return mask["kind"].isNull() | F.coalesce(ok, F.lit(False))


def masks(v: dict[str, Column]) -> list[tuple[int, Column]]:
    """(length, mask text) of a precise version's masks, from short to long; toolchains have the last two."""
    text = lambda n: F.concat_ws(":", v["kind"], *[v[c].cast("string") for c in "abcd"[:n]])
    return [(n, text(n)) for n in (1, 2, 3, 4)]


def version_index(versions: DataFrame) -> DataFrame:
    """(package, mask, ver): the last pushed version of each mask; the null mask has the latest of all."""
    cols = {c: F.col(c) for c in ("kind", "a", "b", "c", "d")}
    items = [F.struct(F.lit(n).alias("n"), m.alias("mask")) for n, m in masks(cols)]
    rows = versions.select("package", "ver", "kind", F.explode(F.array(*items, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("mask")))).alias("m")).filter((F.col("kind") == "semantic") | F.col("m.n").isin(0, 3, 4))
    return rows.groupBy("package", F.col("m.mask").alias("mask")).agg(F.max("ver").alias("ver"))


def abbreviate_version(versions: DataFrame) -> DataFrame:
    """(package, ver, mask): the shortest mask that still means this version; null for the latest."""
    cols = {c: F.col(c) for c in ("kind", "a", "b", "c", "d")}
    items = [F.struct(F.lit(n).alias("n"), m.alias("mask")) for n, m in masks(cols)]
    rows = versions.select("package", "ver", "kind", F.explode(F.array(*items)).alias("m")).filter((F.col("kind") == "semantic") | (F.col("m.n") >= 3)).select("package", "ver", "m.n", "m.mask")
    newest = F.max("ver").over(Window.partitionBy("package", "mask"))
    latest = F.max("ver").over(Window.partitionBy("package"))
    own = rows.withColumn("_mask_ver", newest).withColumn("_latest", latest)
    g = own.groupBy("package", "ver").agg(F.min(F.when((F.col("_mask_ver") == F.col("ver")), F.struct("n", "mask"))).alias("short"), F.max("_latest").alias("latest"))
    return g.select("package", "ver", F.when(F.col("ver") != F.col("latest"), F.col("short.mask")).alias("mask"))


def version_labels(versions: DataFrame, current: DataFrame) -> DataFrame:
    """(package, ver, label, is_current): triplets, or quadruplets where a triplet occurs twice.

    ``current`` (package, ver) asks for a version; one that is not listed gets the nearest earlier one, or the first.
    """
    v = F.struct("kind", "a", "b", "c", "d")
    triplet = F.struct(F.col("kind").alias("kind"), F.col("a").alias("a"), F.col("b").alias("b"), F.col("c").alias("c"), F.lit(None).cast("int").alias("d"))
    same = F.count(F.lit(1)).over(Window.partitionBy("package", "kind", "a", "b", "c"))
    listed = versions.withColumn("label", F.when(same > 1, version_string(v)).otherwise(version_string(triplet))).select("package", "ver", "label")
    asked = current.select("package", F.col("ver").alias("asked"))
    chosen = listed.join(asked, "package").groupBy("package").agg(F.coalesce(F.max(F.when(F.col("ver") <= F.col("asked"), F.col("ver"))), F.min("ver")).alias("chosen"))
    return listed.join(chosen, "package", "left").select("package", "ver", "label", F.coalesce(F.col("ver") == F.col("chosen"), F.lit(False)).alias("is_current"))
