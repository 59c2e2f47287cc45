"""Names and identifiers: modules, packages, symbol ids, communities, comments, fragments, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other spellings of the standard and core libraries' names.
STANDARD_NAMES = ["swift-standard-library", "standard-library", "swift-stdlib", "stdlib"]
CORE_NAMES = ["swift-core-libraries"]
#: Declaration kinds and the communities they decode to.
KINDS = {
    "swift.associatedtype": "associatedtype", "swift.protocol": "protocol", "swift.typealias": "typealias", "swift.enum": "enum", "swift.struct": "struct", "swift.class": "class",
    "swift.enum.case": "case", "swift.init": "initializer", "swift.deinit": "deinitializer", "swift.type.property": "typeProperty", "swift.property": "instanceProperty",
    "swift.type.method": "typeMethod", "swift.method": "instanceMethod", "swift.type.subscript": "typeSubscript", "swift.subscript": "instanceSubscript", "swift.func": "func", "swift.var": "var", "swift.func.op": "operator",
}
#: Fragment kinds and their colours.
COLOURS = {
    "text": "text", "genericParameter": "generic", "identifier": "identifier", "keyword": "keywordText", "externalParam": "argument", "internalParam": "parameter",
    "attribute": "attribute", "number": "number", "string": "string", "typeIdentifier": "type",
}
_NAME = "[_A-Za-z0-9@]+"
USR = f"^([sc]):?({_NAME})(?:::SYNTHESIZED::([sc]):?({_NAME}))?$"


def normalize_module_id(name: Column) -> Column:
    """(title, value): leading underscores go; values compare without case."""
    title = F.regexp_replace(name, "^_+", "")
    return F.struct(title.alias("title"), F.lower(title).alias("value"))


def normalize_package_id(name: Column) -> Column:
    """(kind, name, rank): standard < core < community, lower-cased."""
    low = F.lower(name)
    standard, core = low.isin(*STANDARD_NAMES), low.isin(*CORE_NAMES)
    kind = F.when(standard, "swift").when(core, "core").otherwise("community")
    return F.struct(kind.alias("kind"), F.when(standard, "swift").when(core, "core").otherwise(low).alias("name"), F.when(standard, 0).when(core, 1).otherwise(2).alias("rank"))


def parse_usr(usr: Column) -> Column:
    """(base, host): the colon goes; null if the text is no identifier."""
    part = lambda i: F.nullif(F.regexp_extract(usr, USR, i), F.lit(""))
    return F.when(F.regexp_like(usr, F.lit(USR)), F.struct(F.concat(part(1), part(2)).alias("base"), F.concat(part(3), part(4)).alias("host")))


def usr_interface(usr: Column) -> Column:
    """(culture, protocol, id) of a mangled id that begins with a protocol: module, protocol name, P, and
    perhaps an extending module and E, whose module is then the culture. Lengths never begin with zero."""
    rest = F.substring(usr, F.lit(2), F.length(usr))
    standard = F.substring(rest, F.lit(1), F.lit(1)) == "s"
    digits = lambda text: F.regexp_extract(text, "^([1-9][0-9]*)", 1)
    size = lambda text: F.coalesce(F.nullif(digits(text), F.lit("")).try_cast("int"), F.lit(0))
    word = lambda text: F.substring(text, F.length(digits(text)) + 1, size(text))
    skip = lambda text: F.substring(text, F.length(digits(text)) + size(text) + 1, F.length(text))
    module = F.when(standard, "Swift").otherwise(word(rest))
    after = F.when(standard, F.substring(rest, F.lit(2), F.length(rest))).otherwise(skip(rest))
    protocol = word(after)
    tail = skip(after)
    is_protocol = (F.substring(usr, F.lit(1), F.lit(1)) == "s") & (F.length(protocol) > 0) & (F.length(protocol) == size(after)) & (F.length(module) > 0) & F.startswith(tail, F.lit("P"))
    extension = F.substring(tail, F.lit(2), F.length(tail))
    by_standard = F.startswith(extension, F.lit("sE"))
    extends = (size(extension) > 0) & F.startswith(skip(extension), F.lit("E"))
    head = F.substring(usr, F.lit(1), F.length(usr) - F.length(tail) + 1)
    culture = F.when(by_standard, "Swift").when(extends, word(extension)).otherwise(module)
    return F.when(is_protocol, F.struct(culture.alias("culture"), protocol.alias("protocol"), head.alias("id")))


def with_interface(frame: DataFrame, usr: Column, to: str) -> DataFrame:
    """``frame`` with ``usr_interface`` of an id in the column ``to``, taken apart step by step: each step's columns are referred to
    by the next one, not repeated in it."""
    step = lambda f, **columns: f.withColumn(to, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    at = lambda name: F.col(f"`{to}`.{name}")
    number = lambda text: F.regexp_extract(text, "^([1-9][0-9]*)", 1)
    size = F.coalesce(F.nullif(at("digits"), F.lit("")).try_cast("int"), F.lit(0))
    word = lambda text: F.substring(text, F.length(at("digits")) + 1, size)
    skip = lambda text: F.substring(text, F.length(at("digits")) + size + 1, F.length(text))
    tail_of = lambda text: F.substring(text, F.lit(2), F.length(text))
    whole = step(frame, usr=usr, rest=tail_of(usr), digits=number(tail_of(usr)))
    standard = F.startswith(at("rest"), F.lit("s"))
    module = step(whole, usr=at("usr"), module=F.when(standard, "Swift").otherwise(word(at("rest"))), after=F.when(standard, tail_of(at("rest"))).otherwise(skip(at("rest"))))
    counted = step(module, usr=at("usr"), module=at("module"), after=at("after"), digits=number(at("after")))
    protocol = step(counted, usr=at("usr"), module=at("module"), protocol=word(at("after")), size=size, tail=skip(at("after")))
    extended = step(protocol, usr=at("usr"), module=at("module"), protocol=at("protocol"), size=at("size"), tail=at("tail"), extension=tail_of(at("tail")), digits=number(tail_of(at("tail"))))
    is_protocol = F.startswith(at("usr"), F.lit("s")) & (F.length(at("protocol")) > 0) & (F.length(at("protocol")) == at("size")) & (F.length(at("module")) > 0) & F.startswith(at("tail"), F.lit("P"))
    by_standard = F.startswith(at("extension"), F.lit("sE"))
    extends = (size > 0) & F.startswith(skip(at("extension")), F.lit("E"))
    culture = F.when(by_standard, "Swift").when(extends, word(at("extension"))).otherwise(at("module"))
    head = F.substring(at("usr"), F.lit(1), F.length(at("usr")) - F.length(at("tail")) + 1)
    return extended.withColumn(to, F.when(is_protocol, F.struct(culture.alias("culture"), at("protocol").alias("protocol"), head.alias("id"))))


def decode_community(kind: Column, path: Column) -> Column:
    """The community of a declaration kind; an operator is global only at the top level. Unknown kinds are null."""
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.when((kind == "swift.func.op") & (F.size(path) > 1), "typeOperator").otherwise(F.try_element_at(known, kind))


def assemble_comment(lines: Column, origin: Column) -> Column:
    """(state, origin, comment): lines joined by breaks; no text and no origin is none."""
    text = F.nullif(F.array_join(lines, "\n"), F.lit(""))
    state = F.when(text.isNull() & origin.isNull(), "none").when(text.isNull(), "inherits").otherwise("extends")
    return F.struct(state.alias("state"), origin.alias("origin"), text.alias("comment"))


def classify_fragments(fragments: Column) -> Column:
    """Fragments (kind, spelling) with their colours; init, deinit and subscript are identifiers of a kind.
    An unknown kind is a reject: its colour is null."""
    known = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    special = lambda f: (f["kind"] == "keyword") & f["spelling"].isin("init", "deinit", "subscript")
    return F.transform(fragments, lambda f: F.struct(f["spelling"].alias("text"), F.when(special(f), "keywordIdentifier").otherwise(F.try_element_at(known, f["kind"])).alias("color")))


def is_usable(general: Column, swift_deprecated: Column, swift_obsoleted: Column) -> Column:
    """False for what is unavailable or deprecated in general, or deprecated or obsoleted in the language."""
    return ~F.coalesce(general.isin("unavailable", "deprecated"), F.lit(False)) & swift_deprecated.isNull() & swift_obsoleted.isNull()


def constraint_sentence(constraints: Column) -> Column:
    """'Available when A, B, and C.' of constraints (subject, verb, object); null for none."""
    said = F.transform(constraints, lambda c: F.concat_ws(" ", c["subject"], F.when(c["verb"] == "conforms", "conforms to").when(c["verb"] == "subclasses", "inherits from").otherwise("is"), c["object"]))
    n = F.size(said)
    body = F.when(n == 1, said[0]).when(n == 2, F.array_join(said, " and ")).otherwise(F.concat(F.array_join(F.slice(said, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(said, -1)))
    return F.when(n > 0, F.concat(F.lit("Available when "), body, F.lit(".")))


def outlined_ids(referenced: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct referenced ids that are not among the own vertices."""
    return referenced.select("id").distinct().join(own.select("id"), "id", "left_anti")
