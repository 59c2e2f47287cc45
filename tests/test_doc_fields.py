"""Fields of comments that are written from known pieces, and cases that are no such comment."""

import random

import pytest

from docgraph.functions.doc_fields import ASIDES, doc_fields, fields

WORDS = "alpha beta gamma delta some text that says nothing".split()


def phrase(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))


def piece(rng, level):
    """(lines, fields) of one block; a link may be part of it."""
    kind = rng.choice(["paragraph", "parameter", "parameters", "returns", "aside", "code", "section", "list", "quote", "link"])
    said = phrase(rng)
    if kind == "parameter":
        more = phrase(rng)
        return [f"- Parameter p{level}: {said}", f"  {more}"], [("parameter", f"p{level}", 0, f"{said} {more}")]
    if kind == "parameters":
        names = [f"q{i}" for i in range(rng.randint(1, 3))]
        return ["- Parameters:"] + [f"  - {n}: {said}" for n in names], [("parameters", None, 0, "")] + [("parameter", n, 0, said) for n in names]
    if kind == "returns":
        return [f"* Returns: {said}"], [("returns", None, 0, said)]
    if kind == "aside":
        word = rng.choice(sorted(ASIDES))
        return [f"- {word.title()}: {said}"], [("aside", word, 0, said)]
    if kind == "code":
        return ["```swift", f"let x = ``{said}``", "", "# no heading", "```"], [("code", None, 0, f"let x = ``{said}``\n\n# no heading")]
    if kind == "section":
        depth = rng.randint(2, 4)
        return [f"{'#' * depth} {said}"], [("section", said, depth, None)]
    if kind == "list":
        return [f"- {said}"], []
    if kind == "quote":
        return [f"> {said}"], []
    if kind == "link":
        return [f"{said} ``Type/{level}`` and <doc:Note{level}>"], [("link", None, 0, f"Type/{level}"), ("link", None, 0, f"Note{level}")]
    return [said], []


@pytest.mark.parametrize("seed", range(60))
def test_comments_of_known_pieces(seed):
    rng = random.Random(seed)
    title = phrase(rng)
    blocks = [piece(rng, i) for i in range(rng.randint(0, 9))]
    lines, want = ["@import(M)", f"# {title}", ""], [("directive", "import", 0, "M"), ("headline", None, 1, title)]
    placed = []
    for block, told in blocks:
        placed.append((len(lines), block, told))
        lines += [*block, ""]
    for i, (start, block, told) in enumerate(placed):
        if told and told[0][0] == "section":
            after = [s for s, _, t in placed[i + 1 :] if t and t[0][0] == "section" and t[0][2] <= told[0][2]]
            want.append(("section", told[0][1], told[0][2], "\n".join(lines[start + 1 : after[0] if after else len(lines)]).strip()))
        else:
            want += told
    if blocks and blocks[0][0][0][:1].isalpha():
        want.append(("summary", None, 0, blocks[0][0][0]))
    got = [(f, n, level, c) for f, n, level, _, c in fields("\n".join(lines))]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_cases_beside_the_rule():
    kept = lambda text: [(f, n, c) for f, n, _, _, c in fields(text)]
    assert kept("```\nopen ``X``") == [("code", None, "open ``X``")]
    assert kept("## Late\nwords") == [("section", "Late", "words")]
    assert kept("one\ntwo\n\nthree") == [("summary", None, "one two")]
    assert kept("one\n- two") == [("summary", None, "one")]
    assert kept("- Note: a\nb\n") == [("aside", "note", "a")]
    assert kept("# See ``A``") == [("headline", None, "See ``A``"), ("link", None, "A")]
    assert kept(" \n\n") == [] and kept("@path(x)") == [("directive", "path", "x")]
    assert len(kept("word\n" * 200_000)) == 1


def test_rows_keep_their_ids(spark):
    docs = spark.createDataFrame([(1, "# A\n\nsaid"), (2, None), (None, "said")], "id bigint, text string")
    got = {(r.id, r.field, r.ordinal, r.content) for r in doc_fields(docs, "id", "text").collect()}
    assert got == {(1, "headline", 0, "A"), (1, "summary", 1, "said"), (None, "summary", 0, "said")}
