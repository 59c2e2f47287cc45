"""Operators 11 to 13 against brute force and on hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docgraph.llm import chat_parts, periodic, registry, spelling

# --- 11

PIECES = ["<", "|", "\\", "turn", "|>", "<|turn|>", "<|end|>", "</s>", "[INST]", "[", "/INST]", "<<SYS>>", "<\\|", "a", "é\n", ">"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), st.lists(st.sampled_from(PIECES), max_size=8).map("".join))
def test_turns_read_back(role, text):
    t = chat_parts.Template()
    half = len(text) // 2
    formatted, loss, _ = chat_parts.Flattener(t, chat_parts.Sizes()).turn(role, [{"kind": "text", "text": x} for x in (text[:half], text[half:])])
    assert chat_parts.Reader(t).turn(formatted) == (role, text)
    inner = formatted[len(t.turn) : -len(t.end)].replace(t.says, "\n", 1)
    assert not any(c in inner for c in t.controls())
    assert not loss


def test_template_rejects_overlaps():
    with pytest.raises(ValueError):
        chat_parts.Template(foreign=("<a<", "<b"))


def test_parts_in_order(spark):
    part = lambda kind, **k: {n: k.get(n) for n in ("text", "uri", "width", "height", "seconds", "pages")} | {"kind": kind}
    schema = f"conv_id string, turn int, role string, content {chat_parts.PARTS}, seq string, start string, loss string"
    rows = [
        ("c", 1, "assistant", [part("text", text="see "), part("image", uri="i", width=57, height=28), part("text", text="[INST]"), None, part("sonar", uri="s")], "x", "x", "x"),
        ("c", None, "user", [part("audio", uri="a", seconds=1.5), part("document", uri="d", pages=3), part("image", uri="j")], "x", "x", "x"),
        ("c", 2, None, None, "x", "x", "x"),
        (None, 1, "user", [], "x", "x", "x"),
    ]
    turns = chat_parts.format_turns(spark.createDataFrame(rows, schema), parts_col="content")
    whole = {r.conv_id: r for r in chat_parts.assemble(turns).collect()}
    got = whole["c"]
    assert got.formatted == "<|turn|>user<|says|><|audio|><|document|><|image|><|end|><|turn|>assistant<|says|>see <|image|>[\\INST]<|attachment|><|end|><|turn|><|says|><|end|>"
    assert [(a.kind, a.uri, a.tokens) for a in got.attachments] == [("audio", "a", 38), ("document", "d", 3072), ("image", "j", 256), ("image", "i", 3), ("sonar", "s", 1)]
    assert [got.formatted[a.at :].startswith("<|") for a in got.attachments] == [True] * 5
    assert [got.formatted[s.start : s.end] for s in got.loss] == ["see ", "[\\INST]"]
    assert got.expanded_tokens == 38 + 3072 + 256 + 3 + 1
    assert whole[None].formatted == "<|turn|>user<|says|><|end|>"
    back = {(r.conv_id, r.seq): (r.role, r.text, r.loss_text) for r in chat_parts.read_back(turns).collect()}
    assert back["c", 1] == ("assistant", "see [INST]", "see [INST]") and back["c", 2] == ("", "", "")


def test_text_tokens_are_counted(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(registry.TOKENIZER)
    text = "Hello there, wörld 123"
    turns = chat_parts.format_turns(chat_parts.text_parts(spark.createDataFrame([(1, 0, "user", text)], "conv_id int, turn int, role string, text string")), tokenizer=path)
    model = Tokenizer.from_file(path)
    assert turns.first().expanded_tokens == sum(len(model.encode(x, add_special_tokens=False).ids) for x in ("user", text))


def test_chat_hard_rows(spark):
    long = "x</s>" * 200_000
    rows = [(1, 0, "user", None), (1, 1, "assistant", long), (1, 1, "assistant", long), (2, 0, "assistant", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat_parts.digests(chat_parts.read_back(chat_parts.format_turns(chat_parts.text_parts(df)))).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].loss_chars, got[None].n_turns) == (3, 2 * len(long), 0, 1)
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n\nassistant\n{long}\nassistant\n{long}\n".encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((2 * long).encode()).hexdigest()
    assert chat_parts.digests(chat_parts.read_back(chat_parts.format_turns(chat_parts.text_parts(df.limit(0))))).count() == 0


# --- 12


def brute_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, times * q) and not any(w[s : s + size - p] == w[s + p : s + size] for p in range(1, q)):
                out.append((s, size, q))
    return sorted(out)


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        n = r.randint(0, 70)
        w = [r.randrange(r.choice([1, 2, 3])) for _ in range(n)]
        if n > 4 and r.random() < 0.6:
            p, a = r.randint(1, n // 2), r.randrange(n // 2)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        least, times = r.choice([(24, 3), (4, 2), (6, 3), (5, 5)])
        assert periodic.runs_of(w, least, times) == brute_runs(w, least, times)


def brute_op12(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op12_equals_brute_force(spark, tmp_path):
    r = random.Random(2)
    words = [f"w{i}" for i in range(50)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = [(i, prose(r.randint(0, 120))) for i in range(300)]
    rows += [(1000 + i, prose(20) + "\n" + (prose(r.randint(1, 12)) + " \t") * r.randint(2, 9) + "\x0b" + prose(20)) for i in range(60)]
    rows += [(i, t) for i in (None, 8, 8) for t in (None, "", " \n", "é " * 30, "日本\x85x " * 40)] + [(5000, "a b c " * 40_000 + prose(3000)), (5001, "z" * 1_000_000)]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'c' as runs", "1 as n_words").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in registry.op12_periodic(spark, str(tmp_path)).collect()]
    quick = [brute_op12(*x) for x in rows if x[0] != 5000]
    assert sorted((x for x in got if x[0] != 5000), key=repr) == sorted(quick, key=repr)
    assert sum(x[1] > 0 for x in quick) > 50
    assert periodic.find_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_runs_of_long_texts_take_linear_logarithmic_time():
    for w in ([i % 999 for i in range(60_000)], [0] * 60_000, [bin(i).count("1") % 2 for i in range(60_000)]):
        assert len(periodic.runs_of(w)) <= 1


# --- 13


def brute_spelling(rows, least=6, count=5):
    c = Counter()
    for i, text in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(x.lower() if "A" <= x <= "Z" else x for x in m)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    v = {w: n for w, n in c.items() if len(w) >= least and n >= count}
    letters = sorted(set("".join(v)))
    near = {w: {x for i in range(len(w) + 1) for x in [w[:i] + w[i + 1 :], *(w[:i] + a + w[i:] for a in letters), *(w[:i] + a + w[i + 1 :] for a in letters if i < len(w))] if x in v and x != w} for w in v}
    best = {w: min(near[w], key=lambda x: (-v[x], x)) for w in v if near[w]}
    form = {w: x for w, x in best.items() if v[x] >= 5 * v[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), v[w], len(near[w]), v[form[w]] if w in form else None) for w in v), key=repr)


def spelled(seed, n_docs=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randint(5, 7))) for _ in range(150)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "Ütter×÷y", "x" * 3000, "x" * 2999, "same" * 4 + "ab", "same" * 4 + "abc"]
    weight = [r.choice([1, 3, 20, 130]) for _ in base]
    return [(i, " ".join(w if r.random() < 0.8 else w.upper() for w in r.choices(base, weight, k=200))) for i in range(n_docs)]


@pytest.mark.parametrize("most", [10_000, 8])
def test_spelling_equals_brute_force(spark, most):
    rows = spelled(most) + [(9, "chaina " * 9 + "chainab " * 60 + "chainabc " * 400), (None, "aaaaaa aaaaaab-aaaaaa"), (3, None), (3, ""), (4, "1 2 3"), (4, "1 2 3")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' as word", "1 as n", "'c' as state")
    got = sorted((tuple(x) for x in spelling.spelling_groups(docs, most=most).collect()), key=repr)
    want = brute_spelling(rows)
    assert got == want
    assert sum(x[1] is not None for x in want) > 15 and any(x[1] != x[2] for x in want if x[1])
    assert spelling.spelling_groups(docs.limit(0), most=most).count() == 0


def test_states_are_split(spark):
    vocab = spark.createDataFrame([("prefixprefix" + a + b + c + "x", 5) for a in "abcdefg" for b in "abcdefg" for c in "abcdefg"], "word string, n bigint")
    rows = spelling.initial_states(vocab, most=60)
    assert rows.groupBy("state").count().agg({"count": "max"}).first()[0] <= 60
    got = {r.word: r.n_near for r in spelling.near_words(vocab, most=60).collect()}
    assert len(got) == 343 and set(got.values()) == {18}


def test_acceptor_is_minimal_and_exact():
    words = sorted({"".join(random.Random(i).choice("ab") for _ in range(6)) for i in range(40)})
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.known) == len(set(acceptor.known))
    got = {frozenset((words[x], words[y])) for x, y, _ in acceptor.one_edit()}
    want = {frozenset((x, y)) for x in words for y in words if sum(a != b for a, b in zip(x, y)) == 1}
    assert got == want


def test_op13_on_the_table(spark, sf_dir):
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(x) for x in registry.op13_spelling(spark, sf_dir).collect()), key=repr) == brute_spelling(rows)
