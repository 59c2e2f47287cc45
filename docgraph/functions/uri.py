"""URIs: normalised paths, percent encoding, equivalence, route keys and symbol links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where Spark's form encoding differs from path encoding.
ENCODED = [("+", "%20"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A")]


def path_components(path: Column) -> Column:
    """(components, fold): empty and dot segments mark the fold, two dots go up (never past the root), other
    segments are percent-decoded; an encoded dot segment stays a name."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: s.isNotNull())
    start = F.struct(F.array().cast("array<string>").alias("components"), F.lit(0).alias("fold"))

    def step(acc: Column, s: Column) -> Column:
        size = F.size(acc["components"])
        decoded = F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)
        folded = F.struct(acc["components"].alias("components"), size.alias("fold"))
        popped = F.struct(F.slice(acc["components"], F.lit(1), F.greatest(size - 1, F.lit(0))).alias("components"), F.greatest(size - 1, F.lit(0)).alias("fold"))
        pushed = F.struct(F.concat(acc["components"], F.array(decoded)).alias("components"), acc["fold"].alias("fold"))
        return F.when((s == "") | (s == "."), folded).when(s == "..", popped).otherwise(pushed)

    return F.aggregate(parts, start, step)


def query_parameters(query: Column) -> Column:
    """[(key, value)] in order; parameters without a value have an empty one."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise("").alias("value")))


def encode_component(text: Column) -> Column:
    """Every byte but [0-9A-Za-z-.:_~] as %XX with capital letters."""
    out = F.url_encode(text)
    for a, b in ENCODED:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def encode_uri(components: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(components, encode_component), "/"))


def uri_equivalent(a_path: Column, a_params: Column, b_path: Column, b_params: Column) -> Column:
    """Equal paths, and equal parameters as sets with unique keys."""
    unique = lambda p: F.size(F.array_distinct(F.transform(p, lambda x: x["key"]))) == F.size(p)
    return (a_path == b_path) & unique(a_params) & unique(b_params) & (F.array_sort(a_params) == F.array_sort(b_params))


def route_key(path: Column, community_class: Column) -> Column:
    """(stem, leaf, orientation): lower-cased prefix and last component; callables and globals hang on a dot."""
    low = F.transform(path, F.lower)
    return F.struct(F.array_join(F.slice(low, F.lit(1), F.size(low) - 1), "\t").alias("stem"), F.element_at(low, -1).alias("leaf"), F.when(community_class.isin("callable", "global"), ".").otherwise("/").alias("orientation"))


_HEAD = re.compile(r"^([^.(-]+)(?:-(.+))?$")
_SIGNED = re.compile(r"^(?:([^.(]+)\.)?(?:\.(?!\.))?([^.(]*(?:\.+|[^.()]+)?\([^()]*\))(?:-(.+))?$")
_LITTLE = re.compile(r"^\.([^.(-]+)(?:-(.+))?$")
_DOTTED = re.compile(r"^([^.(-]+)\.([^.(-]+)(?:-(.+))?$")


def symbol_link(component: str | None) -> tuple[list[str], str, str | None]:
    """Segments, orientation of the last one, and the suffix behind a hyphen, of one link component."""
    if not component:
        return [], "/", None
    for pattern, kind in ((_SIGNED, "."), (_LITTLE, "."), (_DOTTED, "."), (_HEAD, "/")):
        found = pattern.match(component)
        if found:
            *names, suffix = found.groups()
            return [n for n in names if n], kind, suffix
    return [component], "/", None


def link_path(components: list[str] | None) -> tuple[list[str], list[str], str, str | None] | None:
    """(names, written names, orientation, suffix of the last) of a link's components; null if one cannot be read.

    A component with a dot inside is two names; what follows a hyphen is not part of a name, but of the written one.
    """
    names: list[str] = []
    written: list[str] = []
    orientation, suffix = "/", None
    for component in [] if components is None else components:
        segments, orientation, suffix = symbol_link(component)
        if not segments:
            return None
        names += segments
        written += [*segments[:-1], segments[-1] + ("" if suffix is None else "-" + suffix)]
    return names, written, orientation, suffix


_PATH = T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("written", T.ArrayType(T.StringType())), T.StructField("orientation", T.StringType()), T.StructField("suffix", T.StringType())])


@F.pandas_udf(_PATH)
def parse_link_path(components: pd.Series) -> pd.DataFrame:
    """``link_path`` of arrays of components; a path that cannot be read has null names."""
    got = [link_path(c) or (None, None, None, None) for c in components]
    return pd.DataFrame(got, columns=["names", "written", "orientation", "suffix"])


@F.pandas_udf(T.StructType([T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("orientation", T.StringType()), T.StructField("suffix", T.StringType())]))
def parse_symbol_link(component: pd.Series) -> pd.DataFrame:
    """One row per component, by compiled patterns over Arrow batches."""
    got = [symbol_link(c) for c in component]
    return pd.DataFrame({"segments": [g[0] for g in got], "orientation": [g[1] for g in got], "suffix": [g[2] for g in got]})


def parse_disambiguator(suffix: Column, kinds: list[str]) -> Column:
    """(kind, value): a base-36 number within 32 bits is a hash, a declaration kind filters, else null."""
    number = F.conv(suffix, 36, 10).try_cast("decimal(20,0)")
    is_hash = F.regexp_like(suffix, F.lit("^[0-9a-zA-Z]{1,7}$")) & (number <= 4294967295)
    return F.when(suffix.isin(*kinds), F.struct(F.lit("community").alias("kind"), suffix.alias("value"))).when(is_hash, F.struct(F.lit("hash").alias("kind"), number.cast("bigint").cast("string").alias("value")))


def parse_link_query(params: Column) -> Column:
    """(base, host, package, version) of overload, self and from parameters; the last of each wins."""
    last = lambda key: F.try_element_at(F.transform(F.filter(params, lambda p: p["key"] == key), lambda p: p["value"]), F.lit(-1))
    overload, lens = last("overload"), last("from")
    parts = F.split(overload, "::SYNTHESIZED::")
    own = F.try_element_at(parts, F.lit(2))
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("base"), F.coalesce(last("self"), own).alias("host"), F.nullif(F.substring_index(lens, "/", 1), F.lit("")).alias("package"), F.when(F.contains(lens, F.lit("/")), F.substring(lens, F.length(F.substring_index(lens, "/", 1)) + 2, F.length(lens))).alias("version"))
