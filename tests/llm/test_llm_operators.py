"""Operators against brute-force versions on small fixtures: nulls, empty and long texts, ties, repeated rows,
empty tables and extra columns with clashing names."""

import hashlib
import json
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from docgraph.llm import bpe, decontaminate, near_copies, pages_cut, pii, quality_fm, quality_rules, secrets, simhash, suffix_dedup, warc
from docgraph.llm.common import fresh_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", ",", "er", "ing"]) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, fp string")


def row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "clash", "clash", "clash")


@pytest.fixture(scope="module")
def docs(spark):
    base = prose(120, 1)
    near = base.replace("gamma", "GAMMA", 1)
    rows = [row(1, base), row(2, base), row(3, near), row(4, None), row(5, ""), row(6, " \n\t "), row(7, prose(60, 2), None), row(None, prose(70, 3)), row(8, "spam $$ ## spam\n" * 60), row(8, "spam $$ ## spam\n" * 60), row(9, prose(5000, 4)), row(10, "Üñï 日本 " * 30), row(11, "one two")]
    return documents(spark, rows).repartition(3)


def collect(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- 1


def brute_warc(rows):
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        same = [j for j, h in rows if (h or "").encode() == raw and j is not None]
        first = min(same, default=None)
        again = len(raw) >= 100 and first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_warc_cuts_of_wide_and_heavy_ids(spark):
    low, high = -(2**63), 2**63 - 1
    ids = [low, low, high, high, 0, 7, 7, 7, 7] + list(range(1000, 1400)) + [2**40 + i * 2**20 for i in range(50)] + [None]
    sizes = [(i, 10) for i in ids] + [(5, 900)]
    got = warc.range_cuts(spark.createDataFrame(sizes, "page_id bigint, size bigint"), 100).tolist()
    again = warc.range_cuts(spark.createDataFrame(sizes[::-1], "page_id bigint, size bigint").repartition(3), 100).tolist()
    assert got == again == sorted(set(got)) and got[0] == low
    known = [(i, n) for i, n in sizes if i is not None]
    for first, last in zip(got, got[1:] + [2**63]):
        held = [(i, n) for i, n in known if first <= i < last]
        assert sum(n for _, n in held) <= 100 or len({i for i, _ in held}) == 1
    assert len(got) <= 2 * sum(n for _, n in known) // 100
    none = spark.createDataFrame([(None, 3)], "page_id bigint, size bigint")
    assert warc.range_cuts(none, 5).tolist() == warc.range_cuts(none.limit(0), 5).tolist() == []


def test_warc(spark):
    long = "<p>é" * 4000
    rows = [(5, long), (3, long), (9, long), (3, long), (None, long), (1, None), (2, ""), (4, "short"), (6, "short"), (10**15, "x" * 100), (-7, "x" * 100), (8, "x" * 99), (11, "x" * 99)]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "z") for i, h in rows], "page_id bigint, url string, html string, payload string")
    path = fresh_path(spark, "warc-test")
    manifest = warc.write_archive(pages, path, roll_bytes=300, shard_bytes=20_000).collect()
    read = warc.read_archive(spark, path, payloads=True)
    assert collect(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute_warc(rows)
    got = read.collect()
    assert all(r.intact for r in got) and len({m.name for m in manifest}) == len(manifest) > 2
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, h in rows}
    again = fresh_path(spark, "warc-test")
    digest = lambda m: sorted((x.name, x.sha256) for x in m)
    assert digest(warc.write_archive(pages.repartition(5), again, roll_bytes=300, shard_bytes=20_000).collect()) == digest(manifest)
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- 2


def brute_dedup(rows, n):
    seen = Counter(b[p : p + n] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - n + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix_dedup(spark, hot):
    p = prose(80, 9)
    rows = [(1, "a" * 300), (2, "ab" * 150), (3, None), (4, ""), (5, p * 2), (6, p[:90]), (7, p[:90]), (None, p + "xyz"), (7, p[:90]), (8, "q" + p[10:80] + "zz" + "b" * 39), (9, "b" * 41), (10, "éé" * 60)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lo string")
    got = suffix_dedup.deduplicate(table, length=40, gram=16, hot=hot)
    assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_dedup(rows, 40)
    assert collect(got, "doc_id", "n_repeat_words") == brute_passages(rows, 51)
    assert suffix_dedup.deduplicate(table.limit(0), length=40, gram=16).count() == 0


def brute_passages(rows, k):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[p : p + k]) for w in split for p in range(len(w) - k + 1))
    return sorted(((i, len({p + d for p in range(len(w) - k + 1) if seen[tuple(w[p : p + k])] > 1 for d in range(k)})) for (i, _), w in zip(rows, split)), key=repr)


def test_suffix_dedup_on_the_table(spark, sf_dir):
    """Production parameters on a whole table, with passages planted in other documents and repeated rows."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    r = random.Random(3)
    short, long = " ".join(r.choice("abcdefgh") + r.choice("ou") for _ in range(60)), prose(100, 77)
    for i in range(0, 40, 4):
        words = (rows[i][1] or "").split(" ")
        at = r.randint(0, len(words))
        rows[i] = rows[i][0], " ".join([*words[:at], short if i % 8 else long, *words[at:]])
    rows += rows[:5]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.deduplicate(table).collect()
    key = lambda r: repr((r.doc_id, r.n_bytes))
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_dedup(rows, 400)
    assert sorted(((r.doc_id, r.n_repeat_words) for r in got), key=repr) == brute_passages(rows, 51)
    assert any(r.n_repeat_words and not r.n_removed for r in sorted(got, key=key))


def test_long_texts_in_segments(monkeypatch):
    """A text scanned in segments has the same windows in its ranges, with the same owners."""
    data = np.frombuffer(prose(700, 3).encode(), np.uint8)
    offsets = np.array([0, 900, 910, len(data)])
    owners = lambda: {(d, p): (a, k) for d, a, lo, hi, k, _ in zip(*suffix_dedup.anchors(data, offsets, 60, 20)) for p in range(lo, hi + 1)}
    whole = owners()
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 333)
    assert owners() == whole and len(whole) == sum(max(0, n - 59) for n in np.diff(offsets))


def test_two_stage_sort():
    r = random.Random(2)
    base = bytes(r.choice(b"abc ") for _ in range(700))
    ranges = [base[s : s + r.randint(40, 300)] for s in (r.randint(0, 400) for _ in range(80))] + [b"a" * 90, b"\0" * 60, b"zyx" * 30]
    ranges = [x for x in ranges if len(x) >= 40]
    seen = Counter(x[i : i + 40] for x in ranges for i in range(len(x) - 39))
    for x, flags in zip(ranges, suffix_dedup.repeated_windows(ranges, 40)):
        assert [bool(f) for f in flags] == [seen[x[i : i + 40]] > 1 for i in range(len(x) - 39)]


# --- 3


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs):
    got = quality_rules.quality_rules(docs)
    want = sorted(((r.doc_id, *brute_counts(r.text)) for r in docs.collect()), key=repr)
    assert collect(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, None, 9}
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_equal_hashes_are_no_proof(spark):
    """Two different lines whose polynomial hashes are equal are no repeats."""
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    h = quality_rules.Hasher(np.frombuffer((one + other).encode(), np.uint8))
    n = len(one)
    assert h.ranges(np.array([0]), np.array([n])) == h.ranges(np.array([n]), np.array([2 * n]))
    text = f"{one}\n{other}\n{one} x y {other} x y"
    got = quality_rules.quality_rules(documents(spark, [row(1, text)])).first()
    assert (got.n_dup_lines, got.n_repeat_words) == (brute_counts(text)[3], brute_counts(text)[4])


def test_prior_of_many_small_hosts(spark):
    """Hosts of one document each that differ by chance alone are shrunk to the rate of all."""
    judged = spark.range(600).selectExpr("id AS host", "id % 10 = 0 AS failed")
    rates = [r.rate for r in quality_rules.host_rates(judged).collect()]
    assert max(rates) - min(rates) < 0.01 and abs(sum(rates) / 600 - 0.1) < 0.01
    apart = spark.range(2000).selectExpr("id % 10 AS host", "id % 10 = 0 AS failed")
    assert max(r.rate for r in quality_rules.host_rates(apart).collect()) > 0.95


def test_host_verdicts(spark):
    junk = "word $$$$ more |||| " * 3
    rows = [row(i, prose(80, i) + (junk * 4 if i < 30 else ""), "bad") for i in range(40)] + [row(100 + i, prose(80, i) + (junk * 4 if i == 0 else ""), "good") for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert all(got[i].kept == (i >= 30) for i in range(40))
    assert all(got[100 + i].kept for i in range(60))


# --- 4


def test_factorisation_machine(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = r.random() < 0.7
        rows.append(row(i, prose(60, i) if good else " ".join(f"{w}%%%" for w in prose(60, i).split())))
        labels.append((i, int(good), 0))
    rows += [row(900, None), row(None, ""), row(901, "x" * 50_000)]
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality_fm.classify(docs, known).toPandas().merge(pd.DataFrame(labels, columns=["doc_id", "quality", "t"]), on="doc_id", how="left")
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    held = got[got.held_out & got.quality.notna()]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.97
    none = quality_fm.classify(docs, known.limit(0)).toPandas()
    assert (none.score == 0.5).all()


def test_sum_of_squares_identity():
    machine = quality_fm.FactorisationMachine()
    slots, values = np.array([1, 5, 9, 700]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum(machine.factors[a] @ machine.factors[b] * x * y for i, (a, x) in enumerate(zip(slots, values)) for b, y in list(zip(slots, values))[i + 1 :])
    assert math.isclose(machine.logits(np.array([0, 4]), slots, values)[0][0], pairs, rel_tol=1e-9)


# --- 5


def test_secrets(spark):
    r = random.Random(1)
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = [row(i, f'{prose(20, i)} token = "{hexa(40)}" {prose(9, i)}') for i in range(60)]
    rows += [row(100 + i, f"{prose(9, i)} order-2024-item-{i}-of-the-list {prose(9, i)} isbn.978-3-16-148410.{i}") for i in range(60)]
    rows += [row(200, None), row(201, "Passwd: abc, SECRET='abcdef' AKIA" + "Z" * 20 + " " + "a" * 24 + " api_key=12345 token=token:abcdefgh ſecret=abcdefg"), row(None, "")]
    docs = documents(spark, rows)
    found = {x.doc_id: x for x in secrets.find_secrets(docs).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, text, *_ in rows:
        text = text or ""
        want = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = [f"{k}:{a}:{b}" for a, _, b, k in sorted(want)]
        assert found[i].base == ",".join(base)
        assert set(base) <= set(found[i].spans.split(",")) | {""}
    assert not any(found[100 + i].spans for i in range(60))
    masked = {x.doc_id: x for x in secrets.redact(docs).collect()}
    assert all("[SECRET]" in masked[i].text and masked[i].n_chars == len(masked[i].text) for i in range(60))
    assert masked[100].text == rows[60][1] and masked[200].text is None
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_network_gradient():
    x = np.random.default_rng(0).integers(0, 128, (3, secrets.WIDTH))
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)
    cnn = secrets.CharCnn()
    loss = lambda: float(np.mean(np.log1p(np.exp(-np.where(y == 1, 1, -1) * cnn._forward(x)["y"]))))
    g = cnn._gradients(x, y, w)
    for name in ("conv", "dense", "out", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = cnn.p[name][at]
        cnn.p[name][at] = old + 1e-5
        up = loss()
        cnn.p[name][at] = old - 1e-5
        down = loss()
        cnn.p[name][at] = old
        assert math.isclose((up - down) / 2e-5, g[name][at], rel_tol=1e-3)


def test_threshold_keeps_recall():
    """Positives that score low still set the threshold; where negatives score as high, it lies just above them."""
    cnn = secrets.CharCnn()
    x = np.zeros((200, secrets.WIDTH), np.int64)
    target = np.arange(200) % 2.0
    cnn.score = lambda rows: np.where(target == 1, 0.3, 0.01)[: len(rows)]
    assert cnn.calibrate(x, target, 0.98, 0.005).threshold == 0.3
    cnn.score = lambda rows: np.full(len(rows), 0.3)
    assert 0.3 < cnn.calibrate(x, target, 0.98, 0.005).threshold < 0.3001
    cnn.score = lambda rows: np.where(target == 1, 0.3, np.linspace(0, 0.6, 200))[: len(rows)]
    assert cnn.calibrate(x, target, 0.98, 0.1).alarms <= 0.1


# --- 6


def brute_fingerprint(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius):
    """{position: smallest id reachable} of (id, fingerprint) rows."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= radius:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [min((rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]


def test_simhash(spark, docs):
    rows = [(r.doc_id, brute_fingerprint(r.text, 4)) for r in docs.collect()]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows, 4))), key=repr)
    assert collect(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [50_000, 3])
def test_links(spark, hot):
    r = random.Random(4)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            y = x
            for b in r.sample(range(64), r.randint(0, 6)):
                y ^= 1 << b
            fps.add(y)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    table = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id bigint, fp bigint")
    got = dict(collect(table.join(simhash.components(table, 4, hot_bucket=hot), "fp"), "doc_id", "component_id"))
    assert [got[i] for i, _ in rows] == brute_components(rows, 4)


def test_near_dedup(spark, docs):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert got == sorted([1, 4, 7, None, 8, 9, 10, 11], key=repr)


def brute_near(rows, k, least):
    """Kept ids of (id, text) rows: the smallest of each component of similarity ``least`` at least."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted({min(rows[j][0] for j in range(len(rows)) if group[j] == g) for g in group})


def test_near_dedup_is_exact(spark):
    """Both sides of 0.8, exactly 0.8, large groups of near copies, a common passage and pairs far apart by fingerprint."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    made, passage = [], text(40)
    for _ in range(40):
        base = text(r.randint(30, 160))
        made.append(base)
        for _ in range(4):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randint(1, 4)):
                copy[at] = r.choice(vocabulary)
            made.append(copy)
    for n in (8, 9, 40, 41):
        # n shingles, of which n and one more than n / 4 or n / 4 are new in a longer text: at and below 0.8
        base = text(n + 4)
        made += [base, base + text(n // 4), base + text(n // 4 + 1)]
    base = text(120)
    made += [[*base[:at], "changed", *base[at + 1 :]] for at in range(2, 118, 2)]
    made += [passage + text(r.randint(20, 60)) for _ in range(40)]
    r.shuffle(made)
    rows = [(i, " ".join(words)) for i, words in enumerate(made)]
    pairs = [(a, b) for a in range(len(made)) for b in range(a)]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in made]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    similar = [(a, b) for a, b in pairs if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9]
    assert any((prints[a] ^ prints[b]).bit_count() > 12 for a, b in similar)
    assert any((prints[a] ^ prints[b]).bit_count() <= 12 for a, b in set(pairs) - set(similar))
    table = documents(spark, [row(i, t) for i, t in rows])
    want = brute_near(rows, 5, 0.8)
    assert sorted(x.doc_id for x in simhash.deduplicate(table).collect()) == want
    slim = table.selectExpr("doc_id", "md5(text) AS row_key", "text")
    marked, roots = near_copies.components(slim, 5, 0.8, hot_bucket=10)
    named = marked.join(roots, "node", "left").selectExpr("doc_id", "coalesce(root, node) AS root")
    assert sorted(x.least for x in named.groupBy("root").agg({"doc_id": "min"}).toDF("root", "least").collect()) == want


@pytest.mark.parametrize("radius", [4, 12, 20])
def test_trie_descent(radius):
    """Thousands of clustered fingerprints in buckets of one to a thousand, equal ones too: pairs and distances."""
    r = np.random.default_rng(radius)
    fps = []
    for base in r.integers(0, 1 << 63, 60, dtype=np.uint64):
        for _ in range(45):
            x = int(base)
            for bit in r.integers(0, 64, r.integers(0, 12)):
                x ^= 1 << int(bit)
            fps.append(x)
    cuts = np.array([0, 1, 3, 900, 1700, len(fps)])
    fps = np.concatenate([np.sort(np.array(fps[a:b], np.uint64)) for a, b in zip(cuts, cuts[1:])])
    got = [np.stack(x) for x in simhash.trie_pairs(fps, cuts[:-1], cuts[1:], radius)]
    want = []
    for a, b in zip(cuts, cuts[1:]):
        far = np.bitwise_count(fps[a:b, None] ^ fps[None, a:b]).astype(np.int64)
        i, j = np.nonzero(np.triu(far <= radius, 1))
        want.append(np.stack([i + a, j + a, far[i, j]]))
    assert sorted(np.concatenate(got, axis=1).T.tolist()) == sorted(np.concatenate(want, axis=1).T.tolist())


def test_trie_prunes(monkeypatch):
    """Node pairs beyond the budget are left: far fewer node pairs than fingerprint pairs are entered."""
    r = np.random.default_rng(5)
    fps = np.sort(r.integers(0, 1 << 63, 4000, dtype=np.uint64))
    entered = []
    children = simhash._children
    monkeypatch.setattr(simhash, "_children", lambda f, nodes, radius: entered.append(len(nodes)) or children(f, nodes, radius))
    list(simhash.trie_pairs(fps, np.array([0]), np.array([len(fps)]), 1))
    assert 0 < sum(entered) < len(fps) ** 2 / 40


def test_near_dedup_on_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = simhash.deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_near(rows, 5, 0.8)


# --- 7


def test_personal_base():
    r = random.Random(6)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(4000):
        text = "".join(r.choice("a.@b-@+ 1") for _ in range(r.randint(0, 25)))
        got = pii.base_spans(text)
        assert [s[:2] for s in got if s[2] == "email"] == [m.span() for m in email.finditer(text)]


def brute_personal(text):
    """The contract's ip, card and phone findings by its patterns as they stand."""
    out = [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 16 <= len(digits) <= 19 and (doubled + sum(digits[-1::-2])) % 10 == 0:
            out.append((*m.span(), "card"))
    return out + [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_personal_base_of_other_kinds():
    r = random.Random(8)
    cards = ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4111 1111 1111 1112", "6304000000000000000"]
    seen = Counter()
    for _ in range(4000):
        parts = [r.choice([*cards, "+1 (864) 555-8394", "10.0.0.25", "10.0.0.256", "1.2.3.4.5.6.7.8", "000255.1.1.1"]) if r.random() < 0.2 else "".join(r.choice("0123456789.+-() x") for _ in range(r.randint(0, 12))) for _ in range(4)]
        text = "".join(parts)
        got = [s for s in pii.base_spans(text) if s[2] != "email"]
        assert got == brute_personal(text)
        seen.update(k for _, _, k in got)
    assert min(seen[k] for k in ("ip", "card", "phone")) > 50


def test_personal_long_runs(spark):
    """Digits, dots and signs without end are read in linear time and never raise."""
    texts = ["1" * 300_000 + ".1.1.1", "1" * 200_000, "1." * 150_000, "+" * 100_000, "-" * 200_000 + "1" + "-" * 200_000, "@" * 100_000, "+1" + " " * 200_000]
    start = time.perf_counter()
    for text in texts:
        pii.tokens(text, pii.base_spans(text))
        pii.trimmed(text)
    assert time.perf_counter() - start < 20
    got = pii.find_personal(documents(spark, [row(i, t) for i, t in enumerate(texts)])).collect()
    assert all(r.n_ip == 0 for r in got if r.doc_id < 2) and len(got) == len(texts)


@pytest.mark.parametrize("kind", [pii.EQUAL, pii.SIMILAR])
def test_skip_edge_changes_a_label(kind):
    """A token without evidence of its own takes the label of its distant twin, and stays "none" without the edge."""
    field = pii.SkipChain(np.zeros((pii.BUCKETS, len(pii.LABELS))), np.zeros((len(pii.LABELS),) * 2), skip=(2.0, 2.0))
    field.unary[1, 4] = 1.0
    field.unary[2, 0] = 0.1
    rows = np.array([[1] * pii.FEATURES, [2] * pii.FEATURES])
    one = np.zeros(1, np.int64)
    assert field.marginals(rows, one, one + 1, np.array([kind])).argmax(1).tolist() == [4, 4]
    assert field.marginals(rows, one[:0], one[:0], one[:0]).argmax(1).tolist() == [4, 0]


def test_field_learns_skip_weights():
    """Equal tokens with equal labels raise the reward of their edges; with unequal ones it falls."""
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 8, (400, pii.FEATURES))
    first, second = np.arange(0, 400, 2), np.arange(1, 400, 2)
    kind = np.full(200, pii.EQUAL)
    agree, differ = np.repeat(rng.integers(0, 5, 200), 2), np.tile([1, 2], 200)
    weight = lambda labels: pii.SkipChain.fit(rows, labels, first, second, kind).pairs[pii.EQUAL][0, 0]
    assert weight(agree) > pii.SKIP_WEIGHTS[0] > weight(differ)


def test_message_passing_is_exact_on_chains():
    """Without skip edges a chain is a tree: loopy marginals equal those of full enumeration."""
    rng = np.random.default_rng(1)
    n, labels = 4, len(pii.LABELS)
    field = pii.SkipChain(rng.normal(0, 1, (pii.BUCKETS, labels)), rng.normal(0, 1, (labels, labels)))
    rows = rng.integers(0, pii.BUCKETS, (n, pii.FEATURES))
    first, second = np.arange(n - 1), np.arange(1, n)
    got = field.marginals(rows, first, second, np.zeros(n - 1, np.int64), rounds=60)
    unary = field.unary[rows].sum(1)
    want = np.zeros((n, labels))
    for state in np.ndindex(*(labels,) * n):
        p = math.exp(sum(unary[i, s] for i, s in enumerate(state)) + sum(field.pairs[0][state[i], state[i + 1]] for i in range(n - 1)))
        for i, s in enumerate(state):
            want[i, s] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def test_skip_edges_agree():
    doc, number, key = np.zeros(5, int), np.array([0, 1, 5, 9, 10]), np.array([7, 8, 7, 8, 7])
    first, second, kind = pii.edges(doc, number, key, np.array([0, 3, 0, 3, 0]))
    assert sorted(zip(first.tolist(), second.tolist(), kind.tolist())) == [(0, 1, 0), (0, 2, 1), (1, 3, 1), (2, 4, 1), (3, 4, 0)]
    first, second, kind = pii.edges(doc, number, np.arange(5) + 20, np.array([9, 1, 9, 0, 0]))
    assert sorted(zip(first.tolist(), second.tolist(), kind.tolist())) == [(0, 1, 0), (0, 2, 2), (3, 4, 0)]


def test_personal_query(spark):
    rows = [row(i, f"{prose(9, i)} mail{i}@example.com or +1 (864) 555-{1000 + i} {prose(5, i)} 555-{1000 + i}") for i in range(80)] + [row(200, None), row(None, ""), row(201, "no data here")]
    got = {r.doc_id: r for r in pii.find_personal(documents(spark, rows)).collect()}
    assert all(got[i].n_email == 1 and got[i].n_phone == 1 and got[i].spans.startswith(got[i].base) for i in range(80))
    assert got[200].spans == got[None].spans == got[201].spans == ""
    assert pii.find_personal(documents(spark, [])).count() == 0


# --- 8


def test_extraction(spark):
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><article><header class="article-header"><h1>Title &amp; more</h1></header>
      <p>First   paragraph with <b>bold</b> words,\n and an end.<p>Second&nbsp;one is here, unclosed.<div class="ad">Buy now and save a lot of money.</div>
      <ul><li>Item of the article, in full.</li></ul><section class="comments"><p>Great article, I read it all twice.</p></section></article>
      <aside><p>Related stories that you may like to read.</p></aside><form><p>Sign up for the letter.</p></form><script>var t="</p>";</script><footer>&copy; 2024</footer>"""
    want = "Title & more\nFirst paragraph with bold words, and an end.\nSecond one is here, unclosed.\nItem of the article, in full."
    rows = [(1, "u", page), (2, "v", None), (3, None, ""), (4, "w", "<p>cut off in <b"), (5, "w", "a < b &lt; c"), (6, "x", "<div>" * 2000 + "Deep text of some length, with an end.")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in pages_cut.extract(table).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == "" and got[3].url is None
    assert got[6].text == "Deep text of some length, with an end."


ARTICLE = "<p>The first paragraph has a number of words, as articles have.</p><p>And here is the second one, of the same kind.</p>"
ARTICLE_TEXT = "The first paragraph has a number of words, as articles have.\nAnd here is the second one, of the same kind."


@pytest.mark.parametrize("around", ['<div class="layout with-sidebar"><article>%s</article></div>', '<div class="no-sidebar"><article>%s</article></div>', '<article class="post category-legal">%s</article>', '<article class="post tag-search">%s</article>', '<main class="content with-sidebar">%s</main>', '<div class="page has-comments"><main><article>%s</article></main><div class="sidebar"><p>See what else is new here.</p></div></div>'])
def test_extraction_keeps_articles_in_named_wrappers(around):
    page = f'<html><body><nav><a href="/">Home</a></nav>{around % ARTICLE}<footer>All rights reserved.</footer></body></html>'
    assert pages_cut.main_text(page) == ARTICLE_TEXT


def test_cut_flips_a_block():
    """A short block that its own cost calls boilerplate is content between paragraphs, by the smoothness edges alone."""
    page = "<div><p>One paragraph of the text, which is long enough to be sure.</p><div>Short line</div><p>Another paragraph of the text, which is long enough too.</p></div>"
    alone = pages_cut.main_text(page, smooth=0.0)
    assert "Short line" not in alone and pages_cut.main_text(page) == alone.replace("sure.\n", "sure.\nShort line\n")


LONG = "This is a paragraph of the article that says something, and it goes on for a while."
SHORT = "Yes."


@pytest.mark.parametrize("opening", [
    '<article aria-label="A talk about social media">', '<main aria-label="Menu design basics">', '<article id="comment-driven-design">', '<article class="legal">', '<main><article class="legal">',
    '<div role="main" class="page-content nav-open">', '<div class="story-body social-share-enabled">', '<article class="post ad-free">', '<article class="story related-topics">',
])
def test_extraction_keeps_articles_whatever_they_are_called(opening):
    page = f"<body><nav><a href=a>Home</a></nav>{opening}<p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p></div><footer>Imprint</footer>"
    assert pages_cut.main_text(page) == f"{LONG}\n{SHORT}\n{LONG}"


@pytest.mark.parametrize("around", ['<section id="responses">{}</section>', '<div class="comments-area">{}</div>', '<ol class="post-comments">{}</ol>', '<section class="comments"><h2>Comments</h2>{}</section>'])
@pytest.mark.parametrize("inside", [True, False])
def test_extraction_leaves_reader_comments_out(around, inside):
    said = around.format(f'<article class="comment" id="comment-7"><p>{LONG} I agree.</p></article><article><p>{LONG} I do not.</p></article>')
    body = f"<h1>The title</h1><p>{LONG}</p>"
    page = f"<main><article>{body}{said}</article></main>" if inside else f"<main><article>{body}</article>{said}</main>"
    assert pages_cut.main_text(page) == f"The title\n{LONG}"


def test_extraction_of_given_pages_by_their_markup(spark, sf_dir):
    """The pages' articles, read by Python's own parser: paragraphs and headings outside of asides and forms."""
    from html.parser import HTMLParser

    class Articles(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.skipped, self.open, self.text = 0, 0, None, []

        def handle_starttag(self, tag, attrs):
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            self.inside += tag == "article"
            self.skipped += tag in ("aside", "nav", "form", "footer", "script", "style") or ("comment" in names and tag in ("div", "section", "ul", "ol"))
            if self.inside and not self.skipped and tag in ("p", "h1", "h2", "h3", "h4", "li", "pre", "blockquote"):
                self.text.append("")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.skipped -= tag in ("aside", "nav", "form", "footer", "script", "style")

        def handle_data(self, data):
            if self.inside and not self.skipped and self.text:
                self.text[-1] += data

    checked = 0
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        if not r.html or r.html.count("<article") != 1 or "comment" in r.html:
            continue
        reader = Articles()
        reader.feed(r.html)
        want = "\n".join(t for t in (" ".join(x.split()) for x in reader.text) if t)
        got = pages_cut.main_text(r.html)
        assert " ".join(got.split()) == " ".join(want.split()), r.page_id
        checked += 1
    assert checked > 10


def test_extraction_equals_the_article_element(spark, sf_dir):
    """On the given pages the text is that of the article without its notices, comments and the like."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60).collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", r.html or "", re.DOTALL)
        if inner:
            assert pages_cut.main_text(r.html) == pages_cut.main_text(f"<article>{inner[1]}</article>")


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        costs = rng.normal(0, 2, n)
        edges = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        value = lambda labels: sum(c for c, on in zip(costs, labels) if c > 0 and not on) - sum(c for c, on in zip(costs, labels) if c < 0 and on) + sum(w for a, b, w in edges if labels[a] != labels[b])
        best = min(value([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert math.isclose(value(pages_cut.minimum_cut(costs, edges)), best, abs_tol=1e-7)


# --- 9


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_library(library):
    mine = bpe.Bpe(bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    r = random.Random(3)
    signs = "aaab \n\t'sdmtre  .,!?-=_*#0123é日本ß 　\x1c\x1d\x85​ ﻿🙂"
    cases = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    cases += ["a" * 3000, "ab" * 2000, " " * 777 + "x", "=" * 1999, "é" * 900, "日本" * 700, "thisisaverylong" * 200, "<|endoftext|>x <|endoftext|>", "x<|endoftext|", "", "\x00"]
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text).tolist() == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_emits_early():
    mine = bpe.Bpe(bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    stream = mine.transduce(b"thisisaverylong" * 400)
    assert len([next(stream) for _ in range(5)]) == 5 and stream.gi_frame.f_locals["done"] == 0 or stream.gi_frame.f_locals["end"] < 2000


def test_bpe_new_pieces_side_by_side(library):
    """Pieces not seen before pass through the transducer together, not one call each, with the library's ids."""
    mine = bpe.Bpe(bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    r = random.Random(9)
    parts = ["er", "tion", "aux", "ç", "é", "ü", "ß", "th", "ble", "q", "a", "A", "日", "🙂", "0", "ing", "heit", "#", "\x1d"]
    texts = [" ".join("".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(2000)) for _ in range(3)]
    texts += ["", "x" * 64 + " " + "x" * 65 + " " + "日" * 21 + " " + "日" * 22, "<|endoftext|> <|endoftext|>new<|endoftext|"]
    texts.append(" ".join("".join(r.choice(parts) for _ in range(4)) for _ in range(20000)))  # over LISTED characters
    calls, one = [], mine.transduce
    mine.transduce = lambda raw: calls.append(raw) or one(raw)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        n, ids_sha, text_sha = mine.digest(text)
        assert (n, ids_sha) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert text_sha == hashlib.sha256(text.encode()).hexdigest()
    assert len(calls) == 2 and all(len(raw) > bpe.LANE_BYTES for raw in calls)


def test_bpe_stable_pairs_equal_merging():
    """Undoing merges finds the pairs that merging their bytes leaves apart; every token is its own encoding."""
    mine = bpe.Bpe(bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    r = random.Random(4)
    near = [t for t in mine.ids if len(t) < 4]
    pairs = [(r.choice(near), r.choice(near)) for _ in range(4000)] + [(a, b) for a in (b"a", b"aa", b"  ", b"==", b"====") for b in (b"a", b"aa", b" ", b"  ", b"=", b"==") if a in mine.ids and b in mine.ids]
    pairs += [(t[:k], t[k:]) for t in r.sample(sorted(mine.ids), 1500) for k in range(1, len(t)) if t[:k] in mine.ids and t[k:] in mine.ids]
    ids = np.array([(mine.ids[a], mine.ids[b]) for a, b in pairs])
    got = mine.lanes.stable(ids[:, 0], ids[:, 1])
    assert got.tolist() == [mine.merged(a + b) == [a, b] for a, b in pairs] and 0 < got.sum() < len(got)
    short = [t for t in r.sample(sorted(mine.ids), 5000) if len(t) <= bpe.LANE_BYTES]
    assert mine.lanes.run(short) == [[mine.ids[t]] for t in short]


def test_bpe_other_merge_lists():
    """A list whose tokens have unmade parts or two rules goes the slow way; one with a token out of reach has the lanes pass over it."""
    letters = {b: c for c, b in bpe.byte_letters().items()}

    def model(merges):
        vocab = [letters[b] for b in range(256)] + list(dict.fromkeys(a + b for a, b in merges))
        return bpe.Bpe(json.dumps({"model": {"vocab": {t: i for i, t in enumerate(vocab)}, "merges": [f"{a} {b}" for a, b in merges]}, "added_tokens": []}))

    r = random.Random(5)
    for merges, fast in (([("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "ab")], True), ([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], False), ([("ab", "c"), ("a", "b")], False)):
        mine = model(merges)
        assert (mine.lanes is not None) == fast
        for _ in range(200):
            text = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            assert mine.encode(text).tolist() == [mine.ids[t] for t in mine.merged(text.encode())]


def test_bpe_query(spark, docs, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert collect(bpe.token_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    encoded = bpe.encode(docs, path, keep=["doc_id"])
    assert collect(bpe.decode(encoded, path), "doc_id", "text") == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert bpe.token_digests(docs.limit(0), path).count() == 0


# --- 10


def brute_matches(rows, items, least):
    norm = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    df = Counter(g for _, t in items for g in set(gram(norm(t))))
    weight = lambda g: math.log1p(len(items) / df[g]) if df[g] else math.log1p(len(items))
    out = set()
    for i, text in rows:
        words = norm(text)
        for item, t in items:
            own = norm(t)
            if not own:
                continue
            for at in range(max(1, len(words) - len(own) + 1)):
                a, b = set(gram(words[at : at + len(own)])), set(gram(own))
                if a & b and sum(map(weight, a & b)) / sum(map(weight, a | b)) >= least:
                    out.add((i, item))
    return sorted(out, key=repr)


def test_decontamination(spark):
    items = [(k, prose(14 + 3 * k, 500 + k)) for k in range(12)] + [(50, None), (51, ""), (52, "alpha beta gamma")]
    rows = [row(k, f"{prose(50, k)}. {items[k][1].upper()}! {prose(40, k + 90)}") for k in range(12)]
    changed = items[11][1].split()
    changed[2] = "changed"
    rows += [row(20, prose(30, 77) + " " + " ".join(changed) + " " + prose(9, 5)), row(21, prose(200, 78)), row(22, None), row(23, ""), row(None, items[3][1]), row(24, "alpha beta gamma"), row(24, "alpha beta gamma")]
    docs = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_matches([(r[0], r[1]) for r in rows], items, 0.8)
    for block in (4096, 4):
        got = decontaminate.contaminated(docs, bench, block_items=block)
        pairs = collect(got.select("doc_id", "item_id").distinct(), "doc_id", "item_id")
        if block == 4096:
            assert pairs == want
        assert {(k, k) for k in range(12)} <= set(pairs) and (20, 11) in pairs
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {21, 22, 23}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_weights_are_those_of_the_whole_benchmark(spark):
    """Items that share a long passage: its shingles weigh little, in whatever block an item falls."""
    passage = prose(30, 900)
    items = [(k, f"{passage} {prose(12, 910 + k)}") for k in range(9)]
    rows = [row(k, f"{passage} {prose(12, 910 + k).replace('alpha', 'omega', 1)}") for k in range(9)] + [row(20 + k, f"{passage} {prose(12 - k, 910 + k)} {prose(k, 950)}") for k in range(9)]
    docs, bench = documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_matches([(r[0], r[1]) for r in rows], items, 0.8)
    assert 0 < len(want) < len(rows)
    whole = collect(decontaminate.contaminated(docs, bench), "doc_id", "item_id", "similarity")
    assert sorted((x[:2] for x in whole), key=repr) == want
    for block in (1, 4, 8):
        assert collect(decontaminate.contaminated(docs, bench, block_items=block), "doc_id", "item_id", "similarity") == whole
        clean = decontaminate.remove_contaminated(docs, bench, block_items=block)
        assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in want}


def test_string_ids_and_block_sizes(spark):
    """Ids of any type, and the same findings for blocks of any size."""
    items = [prose(40, 100 + i) for i in range(9)] + [prose(30, 100) + " " + prose(10, 7)]
    bench = spark.createDataFrame([(f"item-{i}", t) for i, t in enumerate(items)] + [(None, prose(50, 300))], "item_id string, text string")
    docs = spark.createDataFrame([(f"d{i}", f"{prose(30, i)} {t} {prose(20, 50 + i)}") for i, t in enumerate(items)], "doc_id string, text string")
    got = [collect(decontaminate.contaminated(docs, bench, block_items=b), "doc_id", "item_id", "similarity") for b in (1, 3, 4096)]
    assert got[0] == got[1] == got[2] and {(d, i) for d, i, _ in got[0]} >= {(f"d{i}", f"item-{i}") for i in range(10)}


def test_index_guarantee():
    rng = np.random.default_rng(8)
    index = decontaminate.Index(list(range(40)), [prose(30, k) for k in range(40)], decontaminate.RADIUS)
    queries = index.prints[rng.integers(0, 40, 400)].copy()
    for i in range(400):
        for b in rng.choice(64, int(rng.integers(0, 26)), replace=False):
            queries[i] ^= np.uint64(1) << np.uint64(b)
    q, item, _ = index.within(queries)
    want = {(i, j) for i in range(400) for j in range(40) if int(np.bitwise_count(queries[i] ^ index.prints[j])) <= decontaminate.RADIUS}
    assert set(zip(q.tolist(), item.tolist())) == want
