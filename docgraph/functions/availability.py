"""Availability records: lowered to one value per symbol, and their labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Platforms in the order of their labels.
PLATFORMS = ["iOS", "macOS", "macCatalyst", "tvOS", "watchOS", "Windows", "OpenBSD"]
LANGUAGE, GENERAL = "Swift", "*"


def lower_availability(records: Column) -> Column:
    """(general, introduced, deprecated, obsoleted, platforms, error) of records (domain, unavailable,
    deprecatedAlways, introduced, deprecated, obsoleted). A domain that comes twice is an error; the language
    ignores unconditional flags, the general domain keeps only them; for a platform they beat versions."""
    of = lambda name: F.try_element_at(F.filter(records, lambda r: r["domain"] == name), F.lit(1))
    language, general = of(LANGUAGE), of(GENERAL)
    platforms = F.transform(
        F.filter(records, lambda r: r["domain"].isin(*PLATFORMS)),
        lambda r: F.struct(r["domain"].alias("domain"), F.when(r["unavailable"], "unavailable").when(r["deprecatedAlways"] | r["deprecated"].isNotNull(), "deprecated").otherwise("available").alias("state"), F.when(r["unavailable"], F.lit(None)).when(r["deprecatedAlways"], F.lit(None)).when(r["deprecated"].isNotNull(), r["deprecated"]).otherwise(r["introduced"]).alias("since")),
    )
    domains = F.transform(records, lambda r: r["domain"])
    return F.struct(
        F.when(general["unavailable"], "unavailable").when(general["deprecatedAlways"], "deprecated").alias("general"),
        language["introduced"].alias("introduced"), language["deprecated"].alias("deprecated"), language["obsoleted"].alias("obsoleted"),
        platforms.alias("platforms"), (F.size(F.array_distinct(domains)) < F.size(domains)).alias("error"),
    )


def availability_labels(v: Column) -> Column:
    """Labels of a lowered availability: general, language, then platforms in fixed order."""
    general = F.when(v["general"] == "unavailable", "Unavailable").when(v["general"] == "deprecated", "Deprecated")
    language = F.when(v["obsoleted"].isNotNull(), "Obsolete").when(v["deprecated"].isNotNull(), "Deprecated").when(v["introduced"].isNotNull(), F.concat(F.lit("Available since "), v["introduced"]))

    def platform(name: str) -> Column:
        p = F.try_element_at(F.filter(v["platforms"], lambda x: x["domain"] == name), F.lit(1))
        said = F.when(p["state"] == "unavailable", "unavailable").when((p["state"] == "deprecated") & p["since"].isNull(), "deprecated").when(p["state"] == "deprecated", F.concat(F.lit("deprecated since "), p["since"])).when(p["since"].isNotNull(), F.concat(p["since"], F.lit("+")))
        return F.when(p.isNotNull() & said.isNotNull(), F.concat(F.lit(name), F.lit(" "), said))

    return F.array_compact(F.array(general, language, *[platform(n) for n in PLATFORMS]))
