"""The secrets' network against all labelled findings of a table."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from docgraph.llm import secrets
from pyspark.sql import functions as F


def texts(many):
    """Texts with a key each, texts with an order number each (more than any bounded part), and copies of some."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    out = [f"{word()} {word()} token={''.join(r.choice('0123456789abcdefXYZ') for _ in range(r.randrange(12, 40)))} {word()}" for _ in range(many)]
    out += [f"{word()} order-{r.randrange(10**6)}-{word()} {word()} {word()}" for _ in range(2 * many)]
    return out + out[:3] * 400 + out[many : many + 2] * 700


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def whole_threshold(spark, rows, cnn):
    """The threshold and the share of false alarms over every held-out finding, copies included."""
    counted = Counter()
    for text in rows:
        base = secrets.base_spans(text)
        for a, b in secrets.candidates(text):
            known = any(s < b and a < e for s, e, _ in base)
            counted.update((w, known) for w in secrets.windows(text, a, b))
    found = spark.createDataFrame([(bytearray(w), k, n) for (w, k), n in counted.items()], "window binary, known boolean, n bigint")
    held = found.filter(F.pmod(F.xxhash64("window"), F.lit(3)) == 0).collect()
    score = np.repeat(cnn.score(secrets.codes([bytes(r.window) for r in held])), [r.n for r in held])
    known = np.repeat([r.known for r in held], [r.n for r in held])
    hits, misses = np.sort(score[known]), np.sort(score[~known])[::-1]
    allowed = int(secrets.FALSE_ALARMS * len(misses))
    want = max(hits[int((1 - secrets.RECALL) * len(hits))], np.nextafter(misses[allowed], 2.0))
    return float(want), float((misses >= want).mean())


def weights(cnn):
    return np.concatenate([w.ravel() for w in cnn.p.values()])


def test_training_reads_every_finding(spark):
    """Every held-out finding sets the threshold, every other one moves the weights; the layout of the table does not."""
    rows = texts(4000)
    scanned = secrets.scan(documents(spark, rows), "doc_id", "text")
    cnn = secrets.train(scanned)
    want, alarms = whole_threshold(spark, rows, cnn)
    assert np.isclose(cnn.threshold, want, rtol=1e-12, atol=0) and np.isclose(cnn.alarms, alarms)
    assert np.array_equal(weights(cnn), weights(secrets.train(scanned.orderBy(F.desc("doc_id")).repartition(3))))


def test_shards_hold_every_finding(spark):
    """The shards have each finding as often as it occurs, and about as many each, a common window's copies too."""
    rows = [(bytearray(f"{i:096d}", "ascii"), i % 3 == 0, 1 if i else 5000) for i in range(3000)]
    found = spark.createDataFrame(rows, "window binary, known boolean, n bigint")
    shards = secrets.shards_of(found, 7).collect()
    got = Counter()
    for s in shards:
        got.update({(bytes(x.window), x.known): x.copies for x in s.rows})
    assert got == {(bytes(w), k): n for w, k, n in rows}
    sizes = [sum(x.copies for x in s.rows) for s in shards]
    assert len(sizes) == 7 and max(sizes) < 1.25 * min(sizes)


def test_average_weighs_every_shard(spark):
    """A round's state is the mean of the shards' passes, each by its findings."""
    rows = [(bytearray(f"{i:048d}{i * 7919:048d}", "ascii"), i % 2 == 0, 1 + i % 3) for i in range(300)]
    shards = secrets.shards_of(spark.createDataFrame(rows, "window binary, known boolean, n bigint"), 3)
    cnn, total = secrets.CharCnn(), sum(n for _, _, n in rows)
    state, want = cnn.state(), 0
    for s in shards.collect():
        x = secrets.codes([bytes(r.window) for r in s.rows for _ in range(r.copies)])
        y = np.array([float(r.known) for r in s.rows for _ in range(r.copies)])
        want = want + cnn.epoch(state, x, y, np.ones(len(x)), (0, s.shard)) * len(x) / total
    got = secrets.averaged(shards, cnn, state, total, 0.5, 0)
    assert np.allclose(got, want, atol=1e-12) and got[-1] > 1 and not np.allclose(got[:100], state[:100])


def test_few_findings(spark):
    """Without both labels in either part nothing is added; base spans stay."""
    docs = documents(spark, ["token=abcdef123456 and more", "no finding", ""])
    assert secrets.train(secrets.scan(docs, "doc_id", "text")) is None
    assert [r.spans for r in secrets.find_secrets(docs).orderBy("doc_id").collect()] == ["assign:0:18", "", ""]


def test_pipeline_redacts_by_every_finding(spark, sf_dir, monkeypatch):
    """The network of the pipeline's stage has the threshold of all held-out findings of its rows, and masks by it."""
    made, train = [], secrets.train
    monkeypatch.setattr(secrets, "train", lambda *args: made.append(train(*args)) or made[-1])
    rows = texts(4000) + ["", "a token=abcdef123456, z", "no secret here"]
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["secrets"](spark, documents(spark, rows), sf_dir).collect()}
    want, alarms = whole_threshold(spark, rows, made[0])
    assert len(made) == 1 and np.isclose(made[0].threshold, want, rtol=1e-12, atol=0) and np.isclose(made[0].alarms, alarms)
    assert [got[i].text for i in range(len(rows) - 3, len(rows))] == ["", "a [SECRET], z", "no secret here"]
    assert all("[SECRET]" in got[i].text and got[i].n_chars == len(got[i].text) for i in range(4000))
