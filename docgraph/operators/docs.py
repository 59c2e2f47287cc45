"""Documentation: hints, pruning of repeated comments, and inheritance chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docgraph.functions.storage import stored


def apply_hints(vertices: DataFrame, hints: DataFrame) -> DataFrame:
    """(symbol, comment, origin, state): the last hint of a vertex wins, hints to itself do not count."""
    last = hints.filter(F.col("source") != F.col("origin")).groupBy(F.col("source").alias("symbol")).agg(F.max_by("origin", "pos").alias("origin"))
    state = F.when(F.col("comment").isNull() & F.col("origin").isNull(), "none").when(F.col("comment").isNull(), "inherits").otherwise("extends")
    return vertices.select("symbol", "comment").join(last, "symbol", "left").select("symbol", "comment", "origin", state.alias("state"))


def _followed(jumps: DataFrame) -> DataFrame:
    """(symbol, to, hops, closed): links (symbol, to, hops) followed to where they end, with the links on the way.

    Pointer doubling; links that have reached their end are set apart, and only the others are joined on, so that no
    task gets the finished ones under one key. closed is false on a cycle and for links that lead onto one: the rounds end
    when none of them finishes any more.
    """
    settled, open_links, waiting = None, jumps.select("symbol", "to", "hops"), None
    while True:
        every = open_links if settled is None else settled.unionByName(open_links)
        on = every.select(F.col("symbol").alias("_s"), F.col("to").alias("_t"), F.col("hops").alias("_h"))
        joined = open_links.join(on, F.col("to") == F.col("_s"), "left")
        walked = stored(joined.select("symbol", F.coalesce("_t", "to").alias("to"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.col("_s").isNull().alias("ended")), "chains")
        done, open_links = walked.filter("ended").drop("ended"), walked.filter("not ended").drop("ended")
        settled = done if settled is None else settled.unionByName(done)
        left = open_links.count()
        if left in (0, waiting):
            return settled.withColumn("closed", F.lit(True)).unionByName(open_links.withColumn("closed", F.lit(False)))
        waiting = left


def _equal_to_origin(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose comment is that of their origin; texts are joined by hash and compared as they are."""
    text = docs.filter(F.col("comment").isNotNull()).select(F.col("symbol").alias("_o"), F.xxhash64("comment").alias("_h"), F.col("comment").alias("_c"))
    mine = docs.filter(F.col("comment").isNotNull() & F.col("origin").isNotNull()).withColumn("_mine", F.xxhash64("comment"))
    equal = mine.join(text, (F.col("origin") == F.col("_o")) & (F.col("_mine") == F.col("_h")) & (F.col("comment") == F.col("_c")))
    return equal.drop("_o", "_h", "_c", "_mine")


def prune_comments(docs: DataFrame) -> DataFrame:
    """(symbol, origin, comment): a comment equal to that of its origin becomes inherited.

    The scan is by symbol: an origin that was pruned before no longer matches. Along a chain of equal comments
    pruned and kept alternate, down from a symbol that stands before its origin or whose origin has no equal
    origin itself. Pointer doubling counts the links to there: one round for each doubling of the longest chain.
    """
    equal = stored(_equal_to_origin(docs).select("symbol", "origin"), "equal-comments")
    # an earlier origin decides; a later one (or one without an equal origin) ends the chain
    linked = equal.filter(F.col("origin") < F.col("symbol")).join(equal.select(F.col("symbol").alias("origin")), "origin", "left_semi")
    odd = _followed(linked.select("symbol", F.col("origin").alias("to"), F.lit(1).cast("bigint").alias("hops"))).filter("hops % 2 = 1")
    gone = equal.join(odd.select("symbol"), "symbol", "left_anti").select("symbol", F.lit(True).alias("_gone"))
    return docs.join(gone, "symbol", "left").select("symbol", "origin", F.when(F.col("_gone").isNull(), F.col("comment")).alias("comment"))


def prune_across(docs: DataFrame) -> DataFrame:
    """(symbol, module, pos, origin, comment): ``docs`` (the same columns) with comments inherited that repeat those of other modules.

    The modules of a package are scanned one after another, ``pos`` being a symbol's place in the whole scan. A comment
    goes if its origin is of another module, was scanned before and still had an equal comment; an origin whose own
    comment went no longer counts. So along links to equal, earlier origins of other modules comments go and stay by turns.
    """
    origin = docs.select(F.col("symbol").alias("_s"), F.col("module").alias("_m"), F.col("pos").alias("_p"))
    equal = _equal_to_origin(docs).join(origin, F.col("origin") == F.col("_s")).filter((F.col("module") != F.col("_m")) & (F.col("_p") < F.col("pos")))
    links = equal.select("symbol", F.col("origin").alias("to"), F.lit(1).cast("bigint").alias("hops"))
    gone = _followed(stored(links, "equal-across")).filter("hops % 2 = 1").select("symbol", F.lit(True).alias("_gone"))
    return docs.join(gone, "symbol", "left").select("symbol", "module", "pos", "origin", F.when(F.col("_gone").isNull(), F.col("comment")).alias("comment"))


def doc_inheritance(docs: DataFrame) -> DataFrame:
    """(symbol, target, hops, state): where an inheriting symbol's text comes from.

    Pointer doubling: each round doubles the length of the followed chains, and is written once. State is
    found, dropped (the chain ends without text) or cycle (it has no end; target and hops are null).
    """
    bare = docs.filter(F.col("comment").isNull() & F.col("origin").isNotNull())
    ends = _followed(bare.select("symbol", F.col("origin").alias("to"), F.lit(1).cast("bigint").alias("hops")))
    text = docs.filter(F.col("comment").isNotNull()).select(F.col("symbol").alias("to"), F.lit(True).alias("has"))
    state = F.when(~F.col("closed"), "cycle").when(F.col("has"), "found").otherwise("dropped")
    return ends.join(text, "to", "left").select("symbol", F.when(F.col("closed") & F.col("has"), F.col("to")).alias("target"), F.when(F.col("closed"), F.col("hops")).alias("hops"), state.alias("state"))


def package_comments(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The documentation of a package (symbol, module, pos, origin, comment) as it is kept, and counts of what was changed.

    Comments that repeat those of other modules are pruned, chains of inheritance shortened to the first local symbol
    with text or the first symbol that is not among ``docs`` (of another package), and chains that end at a local
    symbol without text and origin dropped, as are cycles. Rows (symbol, origin, comment): a null comment inherits from the origin.

    The counts (pruned, shortened: links skipped, dropped) are taken while the result is written, by no job of their own.
    """
    across = prune_across(docs)
    seen = stored(across.join(docs.select(F.col("symbol").alias("_s"), F.col("comment").isNotNull().alias("_had")), F.col("symbol") == F.col("_s")).drop("_s"), "pruned")
    local = seen.filter("comment is not null or origin is not null")
    bare = local.filter("comment is null")
    ends = _followed(bare.select("symbol", F.col("origin").alias("to"), F.lit(1).cast("bigint").alias("hops")))
    at = seen.select(F.col("symbol").alias("to"), F.col("comment").isNotNull().alias("has"))
    ends = ends.join(at, "to", "left").select("symbol", F.when(F.col("closed") & F.coalesce("has", F.lit(True)), F.col("to")).alias("target"), "hops")
    joined = local.join(ends, "symbol", "left")
    inherits = F.col("comment").isNull()
    lost = inherits & F.col("target").isNull()
    seen_counts = Observation("package-comments")
    watched = joined.observe(
        seen_counts,
        F.count(F.when(inherits & F.col("_had"), 1)).alias("pruned"),
        F.coalesce(F.sum(F.when(inherits & ~lost, F.col("hops") - 1)), F.lit(0)).alias("shortened"),
        F.count(F.when(lost, 1)).alias("dropped"),
    )
    kept = stored(watched.filter(~lost).select("symbol", F.when(inherits, F.col("target")).otherwise(F.col("origin")).alias("origin"), "comment"), "package-comments")
    return kept, dict(seen_counts.get)


def expand_templates(pages: DataFrame, history: DataFrame, pins: DataFrame, homes: DataFrame) -> DataFrame:
    """(package, ver, symbol, target, hops, comment): the documentation that the pages of packages at their versions show.

    pages (package, ver, symbol); history (symbol, lo, hi, origin, comment): keyframes, a null comment with an origin
    inherits; pins (package, ver, dep, dep_ver): which version of each package a page sees, the own one and, for
    packages without a pin, the latest among them; homes (symbol, package).

    Each hop goes to the origin as it stands at the version that the page pins the origin's package at. Rows that have
    found their text are set apart. A symbol without a keyframe there has an empty text and ends the chain; so does a
    null comment without an origin. A chain that comes back to a symbol has no target and a null comment: rows remember a
    symbol, a new one after 1, 2, 4, ... hops, and end when they meet it.
    """
    at = homes.select(F.col("symbol").alias("to"), F.col("package").alias("dep"))
    docs = history.select(F.col("symbol").alias("to"), "lo", "hi", "origin", "comment")
    walk = pages.select("package", "ver", "symbol", F.col("symbol").alias("to"), F.lit(0).cast("bigint").alias("hops"), F.col("symbol").alias("mark"), F.lit(1).cast("bigint").alias("until"))
    done = None
    while True:
        seen = walk.join(at, "to", "left").join(pins, ["package", "ver", "dep"], "left")
        found = seen.join(docs, (seen["to"] == docs["to"]) & F.col("dep_ver").between(F.col("lo"), F.col("hi")), "left").drop(docs["to"])
        goes = F.col("comment").isNull() & F.col("origin").isNotNull()
        again = goes & (F.col("origin") == F.col("mark"))
        moved = (F.col("hops") + 1) >= F.col("until")
        step = stored(found.select("package", "ver", "symbol", F.when(goes, F.col("origin")).otherwise(F.col("to")).alias("to"), (F.col("hops") + goes.cast("bigint")).alias("hops"), F.when(moved, F.col("origin")).otherwise(F.col("mark")).alias("mark"), F.when(moved, F.col("until") * 2).otherwise(F.col("until")).alias("until"), (goes & ~again).alias("open"), again.alias("again"), "comment"), "templates")
        ended = step.filter("not open").select("package", "ver", "symbol", F.when(~F.col("again"), F.col("to")).alias("target"), F.when(~F.col("again"), F.col("hops")).alias("hops"), F.when(~F.col("again"), F.coalesce("comment", F.lit(""))).alias("comment"))
        done = ended if done is None else done.unionByName(ended)
        walk = step.filter("open").select("package", "ver", "symbol", "to", "hops", "mark", "until")
        if walk.isEmpty():
            return done
