"""Secret scans: base patterns, and a character convolutional network over every other candidate.

Base findings come from three patterns. Candidates are the unbroken tokens of 8 or more signs with letters
and digits, and those of 20 or more with letters only; a network in numpy reads each one with the characters around it. It is trained on labelled
findings: candidates that a base pattern covers are positive, all other ones negative; half of the windows of
either label lose the context before them in training, so that the token itself counts as well.

All labelled findings of the table count, each as often as it occurs. A third of the different windows (by hash) is
held out, the others are dealt into shards of about ``shard`` findings. In each of ``EPOCHS`` rounds every shard
goes on from the same weights by one pass of its own, and their states are averaged by their findings (in whole
multiples of 1 / ``UNIT``, so that the order of the sums says nothing). Logits are rounded to a grid of
1 / ``GRID`` within ``LIMIT``; so the counts by logit and label, which are exact and of a fixed size, hold all that
calibration (Platt scaling) and threshold need of the held-out findings. The threshold is the highest one that still
finds ``recall`` of the held-out positives or, where more than ``false_alarms`` of the held-out negatives would reach
that one, the lowest that they do not exceed (the labelled positives are found by their patterns in any case).
Candidates that pass are added as spans of kind ``cnn``; base spans always stay.

Defined cases: a null text is empty and has no spans; unless both labels occur in the held-out part and outside of it, no
network is trained and nothing is added; a candidate longer than a window is read in consecutive windows and has the
highest of their scores.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import drop_stored, map_slices, small_batches, stored

#: The base patterns, the shortest match of each, and the kinds in their listed order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "cnn")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{8,}")
#: Characters from which on a candidate needs no digit.
LONG = 20
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SIDE, BODY = 24, 48
WIDTH = 2 * SIDE + BODY
#: Findings that a shard trains on in one pass, about, and the passes.
SHARD, EPOCHS = 4096, 12
#: Parts of one in which the shards' states are summed; logits are multiples of 1 / GRID within LIMIT.
UNIT, GRID, LIMIT = 1 << 48, 1024, 32
RECALL = 0.98
FALSE_ALARMS = 0.005
EMBED, FILTERS, SPAN, HIDDEN = 8, 24, 5, 16

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base findings in code points, by start and then by kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if (_DIGIT.search(m[0]) or len(m[0]) >= LONG) and _LETTER.search(m[0])]


def windows(text: str, start: int, end: int) -> list[bytes]:
    """The candidate's windows: pieces of BODY characters with SIDE characters of context on either side."""
    out = []
    for at in range(start, end, BODY):
        stop = min(at + BODY, end)
        left = text[max(0, at - SIDE) : at].rjust(SIDE, "\0")
        body = text[at:stop].ljust(BODY, "\0")
        right = text[stop : stop + SIDE].ljust(SIDE, "\0")
        out.append((left + body + right).encode("ascii", "replace"))
    return out


class CharCnn:
    """Embedding, one convolution with ReLU, maximum and mean over the window, two dense layers."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (128, EMBED)),
            "conv": r.normal(0, (2 / (SPAN * EMBED)) ** 0.5, (SPAN * EMBED, FILTERS)),
            "conv_b": np.zeros(FILTERS),
            "dense": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)),
            "dense_b": np.zeros(HIDDEN),
            "out": r.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
            "out_b": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.0
        self.alarms = 0.0

    def _forward(self, x: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        e = p["embed"][x]
        cols = np.concatenate([e[:, k : x.shape[1] - SPAN + 1 + k] for k in range(SPAN)], axis=2)
        z = np.maximum(cols @ p["conv"] + p["conv_b"], 0)
        top = z.argmax(1)
        pooled = np.concatenate([np.take_along_axis(z, top[:, None, :], 1)[:, 0], z.mean(1)], axis=1)
        h = np.maximum(pooled @ p["dense"] + p["dense_b"], 0)
        return {"cols": cols, "z": z, "top": top, "pooled": pooled, "h": h, "y": h @ p["out"] + p["out_b"][0]}

    def _gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x)
        n, steps = len(x), x.shape[1] - SPAN + 1
        dy = (1 / (1 + np.exp(-f["y"])) - target) * weight / n
        g = {"out": f["h"].T @ dy, "out_b": np.array([dy.sum()])}
        dh = dy[:, None] * p["out"] * (f["h"] > 0)
        g |= {"dense": f["pooled"].T @ dh, "dense_b": dh.sum(0)}
        dp = dh @ p["dense"].T
        dz = np.repeat(dp[:, None, FILTERS:] / steps, steps, axis=1)
        np.put_along_axis(dz, f["top"][:, None, :], np.take_along_axis(dz, f["top"][:, None, :], 1) + dp[:, None, :FILTERS], 1)
        dz *= f["z"] > 0
        g |= {"conv": np.tensordot(f["cols"], dz, ([0, 1], [0, 1])), "conv_b": dz.sum((0, 1))}
        de = np.zeros((n, x.shape[1], EMBED))
        dcols = dz @ p["conv"].T
        for k in range(SPAN):
            de[:, k : k + steps] += dcols[:, :, k * EMBED : (k + 1) * EMBED]
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], x.ravel(), de.reshape(-1, EMBED))
        return g

    def state(self) -> np.ndarray:
        """The weights, both moments of Adam (zero) and its steps (none) as one vector."""
        p = np.concatenate([w.ravel() for w in self.p.values()])
        return np.concatenate([p, np.zeros(2 * len(p) + 1)])

    def load(self, state: np.ndarray) -> CharCnn:
        """Takes the weights of a state as views of it."""
        cuts = np.cumsum([0, *(w.size for w in self.p.values())])
        self.p = {k: state[a:b].reshape(w.shape) for (k, w), a, b in zip(self.p.items(), cuts, cuts[1:])}
        return self

    def epoch(self, state: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray, seed: tuple[int, int], batch: int = 64, rate: float = 0.004) -> np.ndarray:
        """The state after a pass of Adam on the cross entropy; order and masks come from the seed."""
        state = state.copy()
        self.load(state)
        p, m, v = state[:-1].reshape(3, -1)
        r = np.random.default_rng(seed)
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            part = x[rows].copy()
            bare = r.random(len(rows)) < 0.5  # of either label, so that a missing context says nothing
            part[bare, :SIDE] = 0
            state[-1] += 1
            found = self._gradients(part, target[rows], weight[rows])
            g = np.concatenate([found[k].ravel() for k in self.p])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** state[-1])) / (np.sqrt(v / (1 - 0.999 ** state[-1])) + 1e-8)
        return state

    def calibrate(self, x: np.ndarray, target: np.ndarray, recall: float, false_alarms: float, count: np.ndarray | None = None) -> CharCnn:
        """Platt scaling by gradient steps, then the threshold under both constraints, over windows or their logits
        (``x``) that occur ``count`` times each."""
        n = np.ones(len(x), np.int64) if count is None else count
        y = self.logits(x)
        for _ in range(300):
            d = (1 / (1 + np.exp(-(self.scale * y + self.shift))) - target) * n / n.sum()
            self.scale -= 0.1 * float((d * y).sum())
            self.shift -= 0.1 * float(d.sum())
        s = self.score(x)
        order = np.argsort(s, kind="stable")
        s, hits, misses = s[order], np.where(target == 1, n, 0)[order], np.where(target == 0, n, 0)[order]
        # the highest threshold that keeps the recall, and the lowest that keeps the false alarms
        keeps = float(s[np.searchsorted(np.cumsum(hits), int((1 - recall) * hits.sum()), "right")]) if hits.any() else 1.0
        allowed = int(false_alarms * misses.sum())
        quiet = float(np.nextafter(s[::-1][np.searchsorted(np.cumsum(misses[::-1]), allowed, "right")], 2.0)) if misses.sum() > allowed else 0.0
        self.threshold = max(keeps, quiet)
        self.alarms = float(misses[s >= self.threshold].sum() / misses.sum()) if misses.any() else 0.0
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        """The windows' logits on the grid; what has one dimension is logits already."""
        if x.ndim == 1:
            return x
        out = [np.clip(np.rint(self._forward(x[a : a + 512])["y"] * GRID) / GRID, -LIMIT, LIMIT) for a in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logits(x) + self.shift)))


def codes(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, WIDTH).astype(np.int64) & 127


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, counts, base spans, and the candidates' places and windows, of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "starts", "ends", "known", "owner", "windows"]

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in names[1:]]
        for text in part.column("text").to_pylist():
            base = base_spans(text)
            found = candidates(text)
            pieces = [windows(text, a, b) for a, b in found]
            row = [*(sum(s[2] == k for s in base) for k in KINDS[:3]), ",".join(f"{k}:{a}:{b}" for a, b, k in base), [a for a, _ in found], [b for _, b in found], [any(s < b and a < e for s, e, _ in base) for a, b in found], [i for i, p in enumerate(pieces) for _ in p], [w for p in pieces for w in p]]
            for column, value in zip(rows, row):
                column.append(value)
        kinds = [*[pa.int64()] * 3, pa.string(), *[pa.list_(pa.int32())] * 2, pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(rows, kinds))], names=names)

    return map_slices(slim, "text", step, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base string, starts array<int>, ends array<int>, known array<boolean>, owner array<int>, windows array<binary>")


def labelled(scanned: DataFrame) -> DataFrame:
    """window, known, n (how often it occurs) and held (is it held out) of every labelled finding."""
    found = scanned.select(F.explode(F.arrays_zip("owner", "windows")).alias("w"), "known").select(F.col("w.windows").alias("window"), F.element_at("known", F.col("w.owner") + 1).alias("known"))
    return found.groupBy("window", "known").agg(F.count(F.lit(1)).alias("n")).withColumn("held", F.pmod(F.xxhash64("window"), F.lit(3)) == 0)


def shards_of(found: DataFrame, shards: int) -> DataFrame:
    """shard and rows (window, known and copies) of the findings; the copies of a window are dealt over the shards."""
    dealt = found.withColumn("parts", F.least("n", F.lit(shards))).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
    home = F.pmod(F.xxhash64(F.lit("shard"), "window"), F.lit(shards))
    row = F.struct(F.xxhash64("window").alias("hash"), "window", "known", F.expr("n div parts + if(part < n % parts, 1, 0)").alias("copies"))
    placed = dealt.select(F.pmod(home + F.col("part"), F.lit(shards)).cast("int").alias("shard"), row.alias("row"))
    return placed.repartition(shards, "shard").groupBy("shard").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def averaged(shards: DataFrame, cnn: CharCnn, state: np.ndarray, total: int, share: float, turn: int) -> np.ndarray:
    """The mean of the states after one pass over each shard, each weighing its part of the ``total`` findings."""

    def run(batches):  # noqa: ANN001, ANN202
        sums = np.zeros(len(state), np.int64)
        for batch in batches:
            for shard, scalar in zip(batch.column("shard").to_pylist(), batch.column("rows")):
                rows = scalar.as_py()
                copies = [r["copies"] for r in rows]
                x, target = np.repeat(codes([r["window"] for r in rows]), copies, 0), np.repeat([float(r["known"]) for r in rows], copies)
                after = cnn.epoch(state, x, target, np.where(target == 1, 0.5 / share, 0.5 / (1 - share)), (turn, shard))
                sums += np.rint(after * (len(x) / total) * UNIT).astype(np.int64)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["at", "part"])

    out = np.zeros(len(state))
    for r in shards.mapInArrow(run, "at int, part bigint").groupBy("at").agg(F.sum("part").alias("part")).collect():
        out[r.at] = r.part / UNIT
    return out


def logit_counts(found: DataFrame, cnn: CharCnn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, label, findings) of the findings: at most one entry for each logit of the grid and label."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if batch.num_rows:
                y = cnn.logits(codes(batch.column("window").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(y * GRID).astype(np.int32)), batch.column("known"), batch.column("n")], names=["y", "known", "n"])

    counts = found.select("window", "known", "n").mapInArrow(run, "y int, known boolean, n bigint").groupBy("y", "known").agg(F.sum("n").alias("n"))
    rows = sorted((r.y, r.known, r.n) for r in counts.collect())
    return np.array([y / GRID for y, _, _ in rows]), np.array([float(k) for _, k, _ in rows]), np.array([n for _, _, n in rows])


def train(scanned: DataFrame, recall: float = RECALL, false_alarms: float = FALSE_ALARMS, shard: int = SHARD) -> CharCnn | None:
    """The network from all labelled findings; None unless both labels are held out and trained on."""
    small_batches(scanned.sparkSession)
    found = stored(labelled(scanned), "secret-windows")
    n = {(r.held, r.known): r.n for r in found.groupBy("held", "known").agg(F.sum("n").alias("n")).collect()}
    if len(n) < 4:
        drop_stored(found)
        return None
    total = n[False, True] + n[False, False]
    share = min(max(n[False, True] / total, 0.01), 0.99)
    shards = stored(shards_of(found.filter(~F.col("held")), max(1, round(total / shard))), "secret-shards")
    cnn = CharCnn()
    state = cnn.state()
    for turn in range(EPOCHS):
        state = averaged(shards, cnn, state, total, share, turn)
    cnn.load(state)
    y, target, count = logit_counts(found.filter("held"), cnn)
    drop_stored(shards)
    drop_stored(found)
    return cnn.calibrate(y, target, recall, false_alarms, count)


def accepted(cnn: CharCnn | None, starts: list[int], ends: list[int], known: list[bool], owner: list[int], raw: list[bytes]) -> list[Span]:
    """The candidates outside base findings whose best window reaches the threshold."""
    if cnn is None or not starts or all(known):
        return []
    best = np.zeros(len(starts))
    scores = [cnn.score(codes(raw[a : a + 512])) for a in range(0, len(raw), 512)]
    np.maximum.at(best, np.array(owner), np.concatenate(scores))
    return [(a, b, "cnn") for a, b, k, s in zip(starts, ends, known, best) if not k and s >= cnn.threshold]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (its spans) and spans (kind:start:end, by start) of every row."""
    scanned = stored(scan(docs, id_col, text_col), "secret-candidates")
    cnn = train(scanned, recall)
    kind = scanned.schema["doc_id"].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            more = [accepted(cnn, *row) for row in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "known", "owner", "windows")))]
            spans = []
            for base, added in zip(batch.column("base").to_pylist(), more):
                every = [(int(s[1]), int(s[2]), s[0]) for s in (x.split(":") for x in base.split(",") if x)] + added
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in sorted(every, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex", "base")), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return scanned.mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]", recall: float = RECALL) -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; ``length_col`` (if there) follows in code points."""
    cnn = train(stored(scan(docs.select(F.lit(0).alias("_id"), text_col), "_id", text_col).filter(F.size("starts") > 0).select("known", "owner", "windows"), "secret-candidates"), recall)
    names = docs.columns
    lengths = length_col in names

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        found = candidates(text)
        spans = base_spans(text)
        if found:
            pieces = [windows(text, a, b) for a, b in found]
            known = [any(s < b and a < e for s, e, _ in spans) for a, b in found]
            spans = sorted(spans + accepted(cnn, [a for a, _ in found], [b for _, b in found], known, [i for i, p in enumerate(pieces) for _ in p], [w for p in pieces for w in p]))
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        old = part.column(text_col).to_pylist()
        new = [masked(t) for t in old]
        columns = {c: part.column(c) for c in names}
        columns[text_col] = pa.array(new, pa.string())
        if lengths:
            kind = part.column(length_col).type
            columns[length_col] = pa.array([n if a == b else len(b) for n, a, b in zip(part.column(length_col).to_pylist(), old, new)], kind)
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return map_slices(docs, text_col, step, docs.schema)

