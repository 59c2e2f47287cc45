"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pair sum takes linear time by
the identity sum over pairs = 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2). Words are lower-cased (ASCII),
hashed into ``WORD_SLOTS`` slots and weigh log(1 + count), scaled to length one; then come standardised
statistics of the text's structure and one-hot slots of the stated length. Whole texts are read, many at a
time, without building a Python object per word.

Training uses at most ``sample`` labelled documents (smallest hash of the id first); nothing else depends on
a bound. Defined cases: a null or empty text has no words and is scored by its statistics; without labels of
both kinds every score is 0.5; a null id is never held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import SPACE, Hasher, map_slices, text_bytes, word_spans
from docgraph.llm.quality_rules import text_counts

WORD_SLOTS = 1 << 13
LENGTH_SLOTS = 24
RANK = 8
SAMPLE = 4000
EPOCHS = 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CLASSES = [
    np.isin(np.arange(256), np.frombuffer(signs, np.uint8))
    for signs in (bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b"!", b"|", b".", b",", b"#*$%&<>", b"\n", b" ", bytes(range(0x80, 0x100)), b"?;:-()\"'", b"/@_=+")
]
#: Class shares, then: words, mean word length, symbols, repeated lines, repeated words, distinct words, lines.
STATISTICS = len(_CLASSES) + 7
SLOTS = WORD_SLOTS + STATISTICS + LENGTH_SLOTS


def features(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each document, slots, values) without the statistics' standardisation.

    ``stated`` is the table's own length of each document (metadata).
    """
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    counts = text_counts(data, offsets)
    shares = []
    for flags in _CLASSES:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags[data], out=total[1:])
        shares.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    start, end, doc = word_spans(data, offsets, ~SPACE[data])
    slot = (Hasher(_LOWER[data]).ranges(start, end) % np.uint64(WORD_SLOTS)).astype(np.int64)
    pair, times = np.unique(doc * WORD_SLOTS + slot, return_counts=True)
    owner = pair // WORD_SLOTS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value = value / np.maximum(norm, 1e-9)[owner]
    distinct = np.bincount(owner, minlength=n)
    words = np.maximum(counts["n_words"], 1)
    lines = shares[7] * size + 1
    stats = [*shares, np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_symbols"] / np.maximum(counts["word_chars"], 1), counts["n_dup_lines"] / lines, counts["n_repeat_words"] / words, distinct / words, np.log1p(lines)]
    length = np.minimum(np.log2(np.maximum(stated, 0) + 1.0).astype(np.int64), LENGTH_SLOTS - 1)
    owners = np.concatenate([owner, np.repeat(np.arange(n), STATISTICS), np.arange(n)])
    slots = np.concatenate([pair % WORD_SLOTS, np.tile(WORD_SLOTS + np.arange(STATISTICS), n), WORD_SLOTS + STATISTICS + length])
    values = np.concatenate([value, np.stack(stats, 1).ravel(), np.ones(n)])
    order = np.argsort(owners, kind="stable")
    return np.searchsorted(owners[order], np.arange(n + 1)), slots[order], values[order]


class FactorisationMachine:
    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        self.bias, self.linear, self.factors = 0.0, np.zeros(SLOTS), r.normal(0, 0.05, (SLOTS, RANK))
        self.mean, self.spread = np.zeros(STATISTICS), np.ones(STATISTICS)

    def scaled(self, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values with the statistics standardised and cut off at four deviations."""
        k = slots - WORD_SLOTS
        is_stat = (k >= 0) & (k < STATISTICS)
        out = values.copy()
        out[is_stat] = np.clip((values[is_stat] - self.mean[k[is_stat]]) / self.spread[k[is_stat]], -4, 4) / 4
        return out

    def logits(self, begin: np.ndarray, slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logits, sum of v_if x_i per document); every document has at least one value."""
        vx = self.factors[slots] * values[:, None]
        first = np.add.reduceat(vx, begin[:-1], axis=0)
        second = np.add.reduceat(vx * vx, begin[:-1], axis=0)
        line = np.add.reduceat(self.linear[slots] * values, begin[:-1])
        return self.bias + line + 0.5 * (first * first - second).sum(1), first

    def fit(self, begin: np.ndarray, slots: np.ndarray, values: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, batch: int = 100, rate: float = 0.02, decay: float = 1e-5) -> FactorisationMachine:
        """AdaGrad on the cross entropy with weight decay, in a fixed order of batches."""
        stat = values[(slots >= WORD_SLOTS) & (slots < WORD_SLOTS + STATISTICS)].reshape(-1, STATISTICS)
        self.mean, self.spread = stat.mean(0), stat.std(0) + 1e-9
        values = self.scaled(slots, values)
        r = np.random.default_rng(3)
        g_linear, g_factors, g_bias = np.full(SLOTS, 1e-8), np.full((SLOTS, RANK), 1e-8), 1e-8
        share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        for _ in range(epochs):
            order = r.permutation(len(target))
            for at in range(0, len(order), batch):
                rows = np.sort(order[at : at + batch])
                size = begin[rows + 1] - begin[rows]
                local = np.concatenate([[0], np.cumsum(size)])
                take = np.arange(local[-1]) - np.repeat(local[:-1], size) + np.repeat(begin[rows], size)
                s, x = slots[take], values[take]
                y, first = self.logits(local, s, x)
                d = (1 / (1 + np.exp(-y)) - target[rows]) / len(rows)
                dd = np.repeat(d, size)
                used, place = np.unique(s, return_inverse=True)
                dl = np.bincount(place, dd * x, minlength=len(used)) + decay * self.linear[used]
                per = dd[:, None] * x[:, None] * (np.repeat(first, size, axis=0) - self.factors[s] * x[:, None])
                df = np.stack([np.bincount(place, per[:, f], minlength=len(used)) for f in range(RANK)], 1) + decay * self.factors[used]
                g_linear[used] += dl * dl
                g_factors[used] += df * df
                g_bias += d.sum() ** 2
                self.linear[used] -= 5 * rate * dl / np.sqrt(g_linear[used])
                self.factors[used] -= rate * df / np.sqrt(g_factors[used])
                self.bias -= rate * d.sum() / g_bias**0.5
        return self

    def scores(self, begin: np.ndarray, slots: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(begin, slots, self.scaled(slots, values))[0], -30, 30)))


def _slim(docs: DataFrame, id_col: str, text_col: str, length_col: str | None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    stated = F.coalesce(F.col(length_col).cast("bigint"), F.length(text).cast("bigint")) if length_col and length_col in docs.columns else F.length(text).cast("bigint")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), stated.alias("stated"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", length_col: str | None = "n_chars", sample: int = SAMPLE) -> FactorisationMachine | None:
    """The machine from the sampled labelled documents that are not held out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    slim = _slim(docs, id_col, text_col, length_col)
    drawn = slim.join(F.broadcast(chosen), slim["doc_id"] == F.col("_id")).drop("_id")

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        begin, slots, values = features(*text_bytes(part.column("text")), part.column("stated").to_numpy())
        lists = [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(a)) for a in (slots.astype(np.int16), values.astype(np.float32))]
        return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("label"), *lists], names=["id", "label", "slots", "amounts"])

    got = map_slices(drawn, "text", step, "id string, label double, slots array<smallint>, amounts array<float>").toArrow().sort_by("id").combine_chunks()
    target = got.column("label").to_numpy() if got.num_rows else np.zeros(0)
    if not 0 < target.sum() < len(target):
        return None
    slots = pc.list_flatten(got.column("slots")).to_numpy().astype(np.int64)
    values = pc.list_flatten(got.column("amounts")).to_numpy().astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(pc.list_value_length(got.column("slots")).to_numpy())]).astype(np.int64)
    return FactorisationMachine().fit(begin, slots, values, target)


def score(docs: DataFrame, machine: FactorisationMachine | None, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    slim = _slim(docs, id_col, text_col, length_col)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        s = np.full(part.num_rows, 0.5) if machine is None else machine.scores(*features(*text_bytes(part.column("text")), part.column("stated").to_numpy()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = map_slices(slim, "text", step, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, train(docs, labels, sample=sample))
