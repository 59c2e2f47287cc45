"""Personal data: base patterns, and a skip-chain conditional random field over the tokens that may hold some.

Tokens are the runs between white space; those without a digit or an @ can hold none of the labels and stand
fixed at "none". The others are the field's variables: one unary potential each (log-linear in shape and
context features), one for every pair of direct neighbours, and skip edges, however far away, from each token
to the next one of the document with the same letters and digits, and to the next similar one (of 8 letters
and digits or more, all but the last two the same), which reward equal labels. Loopy sum-product message
passing runs over all documents of a batch at once, as one graph. The weights are learned from a bounded sample
of documents (``sample``, smallest hash first) whose tokens carry the labels of the base findings: unary ones by
softmax regression first, then all of them through the field, by the difference of observed and expected counts. Tokens that the field labels with at least ``confidence`` outside base spans
are added, neighbours of one label as one span; base spans always stay.

Defined cases: a null text is empty and has no spans; without base findings in the sample nothing is added.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import map_slices, stored

#: Base patterns and kinds in their listed order.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: The look-behind and the possessive runs change no match and keep the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

LABELS = ("none", *KINDS)
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ACTIVE = re.compile(r"[0-9@]")
_KEEP = re.compile(r"[^0-9a-z]")
_FIRST, _LAST = re.compile(r"[0-9A-Za-z+(]"), re.compile(r".*[0-9A-Za-z)]", re.DOTALL)
BUCKETS, FEATURES = 4096, 8
SAMPLE = 3000
#: Documents with more active tokens than this are not drawn into the sample (they are scored like any other).
SAMPLE_TOKENS = 1000
CONFIDENCE = 0.9
#: Rewards of equal labels over skip edges to equal and to similar tokens, from which learning starts.
SKIP_WEIGHTS = (1.5, 0.5)
NEIGHBOUR, EQUAL, SIMILAR = 0, 1, 2
FIELD_STEPS, FIELD_RATE = 12, 0.3
ROUNDS = 8

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    """Is a run of digits at most 255, however long it is."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def trimmed(token: str) -> tuple[int, int]:
    """Where the token without the punctuation around it begins and ends."""
    first = _FIRST.search(token)
    if not first:
        return len(token), len(token)
    last = _LAST.match(token, first.start())
    return first.start(), last.end() if last else first.start()


def _emails(text: str) -> list[Span]:
    """Leftmost matches: the run of local signs before an @ (behind the last match) and the domain after it."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base findings in code points, by kind as listed and then by start."""
    out = _emails(text)
    if not _ACTIVE.search(text):
        return out
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def shape(token: str) -> str:
    """Digits as 0, letters as a, other signs as they are; runs of digits keep their length, of letters not."""
    return re.sub("a+", "a", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "0", token)))


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def features(token: str, before: str, after: str) -> list[int]:
    core = token[slice(*trimmed(token))]
    digits = sum(c.isdigit() for c in core)
    return [_bucket(f) for f in (f"s{shape(core)}", f"n{min(digits, 20)}", f"p{core.count('.')}{core.count('-')}{'@' in core}", f"b{shape(before)[:12]}", f"a{shape(after)[:12]}", f"e{core[:1] if not core[:1].isalnum() else 'x'}", f"d{digits == len(core)}{digits == 0}", "bias")]


def tokens(text: str, base: list[Span]) -> tuple[list, list, list, list, list, list]:
    """(starts, ends, number in the text, label, two keys of letters and digits, features) of the active tokens.

    The second key is that of similar tokens, 0 for tokens too short for one.
    """
    starts, ends, numbers, labels, keys, rows = [], [], [], [], [], []
    if not _ACTIVE.search(text):
        return starts, ends, numbers, labels, keys, rows
    spans = [m.span() for m in _TOKEN.finditer(text)]
    for i, (a, b) in enumerate(spans):
        token = text[a:b]
        if not _ACTIVE.search(token):
            continue
        before = text[slice(*spans[i - 1])] if i else ""
        after = text[slice(*spans[i + 1])] if i + 1 < len(spans) else ""
        starts.append(a)
        ends.append(b)
        numbers.append(i)
        plain = _KEEP.sub("", token.lower()).encode()
        keys += [zlib.crc32(plain), zlib.crc32(plain[:-2]) if len(plain) >= 8 else 0]
        rows += features(token, before, after)
    order = sorted(base)
    k = 0
    for a, b in zip(starts, ends):
        while k < len(order) and order[k][1] <= a:
            k += 1
        labels.append(LABELS.index(order[k][2]) if k < len(order) and order[k][0] < b else 0)
    return starts, ends, numbers, labels, keys, rows


class SkipChain:
    """Unary weights (BUCKETS x labels) and the log potentials of the three kinds of edges (3 x labels x labels)."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray, skip: tuple[float, float] = SKIP_WEIGHTS) -> None:
        self.unary = unary
        self.pairs = np.stack([pair, *(np.eye(len(LABELS)) * w for w in skip)])

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, first: np.ndarray, second: np.ndarray, kind: np.ndarray) -> SkipChain:
        """Softmax regression by Adam with weight decay and counted transitions, then steps through the field."""
        n_labels = len(LABELS)
        w = np.zeros((BUCKETS, n_labels))
        m, v = np.zeros_like(w), np.zeros_like(w)
        hot = np.eye(n_labels)[labels]
        for step in range(1, 81):
            z = w[rows].sum(1)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.zeros_like(w)
            np.add.at(g, rows.ravel(), np.repeat((p - hot) / len(rows), rows.shape[1], axis=0))
            g += 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        joint = np.ones((n_labels, n_labels)) * 0.5
        near = kind == NEIGHBOUR
        np.add.at(joint, (labels[first[near]], labels[second[near]]), 1)
        joint /= joint.sum()
        pair = np.log(joint) - np.log(joint.sum(1, keepdims=True)) - np.log(joint.sum(0, keepdims=True))
        field = cls(w, np.clip(pair, -2, 2))
        for _ in range(FIELD_STEPS):
            field.learn(rows, labels, first, second, kind)
        return field

    def learn(self, rows: np.ndarray, labels: np.ndarray, first: np.ndarray, second: np.ndarray, kind: np.ndarray) -> None:
        """One step up the likelihood: observed minus expected counts of labels and of label pairs by kind of edge.

        Skip edges have one weight each: the reward of equal labels. Weights stay within 4.
        """
        belief, joint = self.beliefs(rows, first, second, kind)
        g = np.zeros_like(self.unary)
        np.add.at(g, rows.ravel(), np.repeat((np.eye(len(LABELS))[labels] - belief) / len(rows), rows.shape[1], axis=0))
        self.unary += FIELD_RATE * (g - 1e-4 * self.unary)
        for k in (NEIGHBOUR, EQUAL, SIMILAR):
            of = kind == k
            if not of.any():
                continue
            seen = np.zeros(self.pairs[k].shape)
            np.add.at(seen, (labels[first[of]], labels[second[of]]), 1)
            gap = (seen - joint[of].sum(0)) / of.sum()
            change = gap if k == NEIGHBOUR else np.eye(len(LABELS)) * np.trace(gap)
            self.pairs[k] = np.clip(self.pairs[k] + FIELD_RATE * change, -4, 4)

    def marginals(self, rows: np.ndarray, first: np.ndarray, second: np.ndarray, kind: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities of every token."""
        return self.beliefs(rows, first, second, kind, rounds)[0]

    def beliefs(self, rows: np.ndarray, first: np.ndarray, second: np.ndarray, kind: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of every token's labels and of every edge's label pairs, by loopy message passing, all
        edges at once in each round."""
        unary = self.unary[rows].sum(1)
        n, e = unary.shape[0], len(first)
        if not e:
            return _softmax(unary), np.zeros((0, unary.shape[1], unary.shape[1]))
        psi = self.pairs[kind]
        out_of = np.concatenate([first, second])
        into = np.concatenate([second, first])
        potential = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        message = np.zeros((2 * e, unary.shape[1]))
        order = np.argsort(into, kind="stable")
        edge = np.searchsorted(into[order], np.arange(n + 1))

        def belief() -> np.ndarray:
            total = np.zeros((2 * e + 1, unary.shape[1]))
            np.cumsum(message[order], axis=0, out=total[1:])
            return unary + total[edge[1:]] - total[edge[:-1]]

        for _ in range(rounds):
            b = belief()[out_of] - message[back]
            new = _logsumexp(b[:, :, None] + potential, 1)
            message = 0.5 * message + 0.5 * (new - _logsumexp(new, 1)[:, None])
        b = belief()
        both = (b[first] - message[e:])[:, :, None] + (b[second] - message[:e])[:, None, :] + psi
        return _softmax(b), _softmax(both.reshape(e, -1)).reshape(both.shape)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def edges(doc: np.ndarray, number: np.ndarray, key: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, kind): direct neighbours, each token with the next equal one of its document, and with the next
    similar one that is not equal."""
    near = np.nonzero((doc[1:] == doc[:-1]) & (number[1:] == number[:-1] + 1))[0]
    out = [(near, near + 1, np.full(len(near), NEIGHBOUR))]
    for kind, by in ((EQUAL, key), (SIMILAR, like)):
        order = np.lexsort((number, by, doc))
        a, b = order[:-1], order[1:]
        far = (doc[a] == doc[b]) & (by[a] == by[b]) & (number[b] != number[a] + 1)
        if kind == SIMILAR:
            far &= (by[a] != 0) & (key[a] != key[b])
        out.append((a[far], b[far], np.full(int(far.sum()), kind)))
    first, second, kinds = zip(*out)
    return np.concatenate(first), np.concatenate(second), np.concatenate(kinds)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, counts, base spans and the active tokens of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "starts", "ends", "numbers", "labels", "keys", "rows", "shown"]

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in names[1:]]
        for text in part.column("text").to_pylist():
            base = base_spans(text)
            got = tokens(text, base)
            shown = []
            for a, b in zip(got[0], got[1]):
                first, last = trimmed(text[a:b])
                shown += [a + first, a + last]
            for column, value in zip(columns, [*(sum(s[2] == k for s in base) for k in KINDS), ",".join(f"{k}:{a}:{b}" for a, b, k in base), *got, shown]):
                column.append(value)
        kinds = [*[pa.int64()] * 4, pa.string(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_slices(slim, "text", step, f"doc_id {kind}, {counts}, base string, starts array<int>, ends array<int>, numbers array<int>, labels array<int>, keys array<bigint>, rows array<int>, shown array<int>")


def _graph(numbers: list[list[int]], keys: list[list[int]], rows: list[list[int]]) -> tuple[np.ndarray, ...]:
    doc = np.repeat(np.arange(len(numbers)), list(map(len, numbers)))
    flat = np.array([r for x in rows for r in x], np.int64).reshape(-1, FEATURES)
    both = np.array([k for x in keys for k in x], np.int64).reshape(-1, 2)
    return (flat, *edges(doc, np.array([i for x in numbers for i in x], np.int64), both[:, 0], both[:, 1]))


def train(scanned: DataFrame, sample: int = SAMPLE) -> SkipChain | None:
    """The field from at most ``sample`` documents that have active tokens; None if none has a base finding."""
    got = scanned.filter((F.size("starts") > 0) & (F.size("starts") <= SAMPLE_TOKENS)).orderBy(F.xxhash64("keys"), "base").limit(sample).select("numbers", "labels", "keys", "rows").collect()
    labels = np.array([x for r in got for x in r.labels], np.int64)
    if not labels.any():
        return None
    rows, first, second, kind = _graph([r.numbers for r in got], [r.keys for r in got], [r.rows for r in got])
    return SkipChain.fit(rows, labels, first, second, kind)


def added(field: SkipChain | None, batch: dict[str, list], confidence: float = CONFIDENCE) -> list[list[Span]]:
    """Spans of every document that the field labels outside base findings."""
    out: list[list[Span]] = [[] for _ in batch["numbers"]]
    if field is None or not any(batch["numbers"]):
        return out
    p = field.marginals(*_graph(batch["numbers"], batch["keys"], batch["rows"]))
    label, sure = p.argmax(1), p.max(1) >= confidence
    at = 0
    for i, numbers in enumerate(batch["numbers"]):
        last: tuple[int, int] | None = None
        for j, number in enumerate(numbers):
            k = int(label[at + j])
            if k and sure[at + j] and not batch["labels"][i][j]:
                a, b = batch["shown"][i][2 * j : 2 * j + 2]
                if last == (number - 1, k):
                    a = out[i].pop()[0]
                if a < b:
                    out[i].append((a, b, f"crf_{LABELS[k]}"))
                    last = (number, k)
        at += len(numbers)
    return out


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, confidence: float = CONFIDENCE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (kind:start:end, by kind and start) of every row."""
    scanned = stored(scan(docs, id_col, text_col), "personal-tokens")
    field = train(scanned, sample)
    kind = scanned.schema["doc_id"].dataType.simpleString()
    kept = ["doc_id", *(f"n_{k}" for k in KINDS), "base"]
    order = [*KINDS, *(f"crf_{k}" for k in KINDS)]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            more = added(field, {c: batch.column(c).to_pylist() for c in ("numbers", "keys", "rows", "labels", "shown")}, confidence)
            spans = []
            for base, extra in zip(batch.column("base").to_pylist(), more):
                tail = [f"{k}:{a}:{b}" for a, b, k in sorted(extra, key=lambda s: (order.index(s[2]), s[0]))]
                spans.append(",".join([*([base] if base else []), *tail]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(spans, pa.string())], names=[*kept, "spans"])

    return scanned.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string")
