"""Fields of a documentation comment, as a table function: one row per field.

A line-based subset of Markdown: directives (``@import``, ``@path``, ``@notitle``) lead, then come headline,
summary, sections that a heading owns up to the next one of its level or above, parameters (one by one or listed below
an item ``Parameters:``), returns, asides, code blocks and link targets outside of code. Items go on in indented lines. The
summary is the first block if that is a paragraph; a code block without an end goes to the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that make a list item or a quoted paragraph an aside.
ASIDES = frozenset("attention author authors bug complexity copyright date experiment important invariant mutating nonmutating note postcondition precondition remark remarks requires seealso since todo throws tip version warning".split())
_DIRECTIVE = re.compile(r"^@(\w+)(?:\(([^)]*)\))?\s*$")
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_ITEM = re.compile(r"^\s*[-*+]\s+(?:(parameter)\s+(\S+?)|([A-Za-z ]+?))\s*:\s*(.*)$", re.IGNORECASE)
_LISTED = re.compile(r"^\s{2,}[-*+]\s+(\S+?)\s*:\s*(.*)$")
_BLOCK = re.compile(r"^\s*([-*+>]\s|[0-9]+[.)]\s)")
_LINK = re.compile(r"``([^`]+)``|<doc:([^>]+)>|\]\(([^)\s]+)\)")
SCHEMA = T.StructType([T.StructField("field", T.StringType()), T.StructField("name", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("ordinal", T.IntegerType()), T.StructField("content", T.StringType())])


def fields(text: str | None) -> Iterator[tuple[str, str | None, int, int, str]]:
    """(field, name, level, ordinal, content) rows of one comment in order."""
    rows: list[tuple[str, str | None, int, str | list[str]]] = []
    lines = (text or "").split("\n")
    at = 0
    while at < len(lines) and (not lines[at].strip() or _DIRECTIVE.match(lines[at])):
        found = _DIRECTIVE.match(lines[at])
        if found:
            rows.append(("directive", found[1], 0, found[2] or ""))
        at += 1
    body = lines[at:]
    headed_links: list[str] = []
    headed = bool(body) and (first := _HEADING.match(body[0])) is not None and len(first[1]) == 1
    if headed:
        headline = _HEADING.match(body.pop(0))[2]
        rows.append(("headline", None, 1, headline))
        headed_links = [next(g for g in m.groups() if g) for m in _LINK.finditer(headline)]
        binding = re.fullmatch(r"``([^`]+)``", headline)
        if binding:
            rows.append(("binding", None, 0, binding[1]))
    spoken: list[str] = []
    fence: list[str] | None = None
    open_: list[tuple[int, str, list[str]]] = []
    sections: list[tuple[int, str, list[str]]] = []
    links: list[str] = []
    said: list[str] | None = None  # the item that indented lines go on with
    outline = False  # below an item that lists parameters
    leading = True  # nothing but the first paragraph so far
    for line in body:
        for section in open_:
            section[2].append(line)
        if line.lstrip().startswith("```"):
            leading, said, outline = False, None, False
            if fence is None:
                fence = []
            else:
                rows.append(("code", None, 0, "\n".join(fence)))
                fence = None
            continue
        if fence is not None:
            fence.append(line)
            continue
        links += [next(g for g in m.groups() if g) for m in _LINK.finditer(line)]
        if not line.strip():
            leading, said = leading and not spoken, None
            continue
        heading = _HEADING.match(line)
        if heading:
            leading, said, outline = False, None, False
            level = len(heading[1])
            for section in [s for s in open_ if s[0] >= level]:
                section[2].pop()
            open_ = [s for s in open_ if s[0] < level]
            open_.append((level, heading[2], []))
            sections.append(open_[-1])
            continue
        listed = _LISTED.match(line) if outline else None
        if listed:
            said = [listed[2]]
            rows.append(("parameter", listed[1], 0, said))
            continue
        item = _ITEM.match(line)
        if item:
            word = (item[1] or item[3]).lower().replace(" ", "")
            kind = word if word in ("parameter", "parameters", "returns") else "aside" if word in ASIDES else None
            if kind:
                leading, outline, said = False, kind == "parameters", [item[4]]
                rows.append((kind, item[2] if item[1] else word if kind == "aside" else None, 0, said))
                continue
        if said is not None and line[:2].isspace() and not _BLOCK.match(line):
            said.append(line.strip())
            continue
        said, outline = None, False
        if leading and (spoken or not _BLOCK.match(line)):
            if _BLOCK.match(line):
                leading = False
            else:
                spoken.append(line.strip())
        else:
            leading = False
    if fence is not None:
        rows.append(("code", None, 0, "\n".join(fence)))
    rows += [("section", name, level, "\n".join(content).strip()) for level, name, content in sections]
    if spoken:
        rows.append(("summary", None, 0, " ".join(spoken)))
    rows += [("link", None, 0, link) for link in headed_links + links]
    for ordinal, row in enumerate(rows):
        content = row[3] if isinstance(row[3], str) else " ".join(w for w in row[3] if w)
        yield row[0], row[1], row[2], ordinal, content


@F.udtf(returnType=SCHEMA)
class _Fields:
    def eval(self, text: str) -> Iterator[tuple]:
        yield from fields(text)


def doc_fields(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, field, name, level, ordinal, content) of every row; a null or empty text has no fields.

    Called laterally, so that no text is a join key and nothing is shuffled.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.lateralJoin(_Fields(F.col("text").outer())).drop("text")
