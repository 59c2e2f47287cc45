"""Quality rules with host-level verdicts.

Per document, counts come from one vectorised scan of the UTF-8 bytes. Rule failures are then summed by
host, each host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts (method of
moments), and the verdict is joined back: on a host whose shrunk rate reaches ``host_rate`` a document must
also pass the strict rules. A document that breaks no rule is kept on any host.

Defined cases: a null text counts as no words and fails the base rule; documents with a null host form a
host of their own; repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import SPACE, Hasher, map_slices, mix, stored, text_bytes, word_spans

#: Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Strict rules, which count towards a host's failures: symbols per 100 characters, repeated lines per 100 words.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINES_PERCENT = 2
#: A host whose shrunk failure rate is at least this many percent gets the strict rules.
HOST_PERCENT = 10
#: Hosts up to this number are broadcast (their verdicts take a few dozen bytes each); more are shuffled.
BROADCAST_HOSTS = 100_000

#: Bytes of a word from which on its document's windows are compared by their words, not by hashes.
LONG_WORD = 256

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _with_equal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: does an equal key stand anywhere, and does one stand earlier."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order][1:] == key[order][:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    either, earlier = np.empty(len(key), bool), np.empty(len(key), bool)
    either[order], earlier[order] = shared, again
    return either, earlier


def _repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows found twice or more, on the words themselves."""
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for k in range(3)}
    return len(hit)


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of every document of a slice."""
    n = len(offsets) - 1
    inside = ~SPACE[data]
    start, end, doc = word_spans(data, offsets, inside)
    hasher = Hasher(data)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    code_points = (data & 0xC0) != 0x80
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": _per_document(code_points & inside, offsets), "n_symbols": _per_document(_SYMBOL[data], offsets)}
    word = hasher.ranges(start, end)
    repeat = np.zeros(len(word), bool)
    if len(word) > 2:
        whole = doc[2:] == doc[:-2]
        at = np.nonzero(whole)[0]
        key = mix(word[at] * np.uint64(3) + mix(word[at + 1] * np.uint64(5) + mix(word[at + 2]))) ^ salt[doc[at]]
        at = at[_with_equal(key)[0]]
        for k in range(3):
            repeat[at + k] = True
    out["n_repeat_words"] = np.bincount(doc[repeat], minlength=n)
    line_start, line_end, line_doc = word_spans(data, offsets, data != 0x0A)
    words_before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=words_before[1:])
    full = words_before[line_end] > words_before[line_start]
    line_start, line_end, line_doc = line_start[full], line_end[full], line_doc[full]
    earlier = _with_equal(hasher.ranges(line_start, line_end) ^ salt[line_doc])[1]
    n_dup = np.bincount(line_doc[earlier], minlength=n)
    # equal hashes are no proof: documents that have some are counted on their bytes
    raw = data.tobytes()
    for d in np.nonzero(n_dup)[0].tolist():
        a, b = np.searchsorted(line_doc, [d, d + 1])
        n_dup[d] = b - a - len({raw[x:y] for x, y in zip(line_start[a:b].tolist(), line_end[a:b].tolist())})
    out["n_dup_lines"] = n_dup
    long = np.unique(doc[(end - start) > LONG_WORD])
    for d in long.tolist():
        a, b = np.searchsorted(doc, [d, d + 1])
        out["n_repeat_words"][d] = _repeat_words([raw[x:y] for x, y in zip(start[a:b].tolist(), end[a:b].tolist())])
    return {k: v.astype(np.int64) for k, v in out.items()}


def document_counts(docs: DataFrame, text_col: str = "text", drop_text: bool = True, prefix: str = "") -> DataFrame:
    """The columns of ``docs`` and the five counts under ``prefix``; the text goes if ``drop_text``."""
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{prefix}{c}` bigint" for c in COUNTS])
    names = [f.name for f in kept]

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        counts = text_counts(*text_bytes(pc.fill_null(part.column(text_col), "")))
        return pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(counts[c]) for c in COUNTS], names=[*names, *[prefix + c for c in COUNTS]])

    return map_slices(docs, text_col, step, schema)


def base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(prefix + "n_words"))


def strict_failed(prefix: str = "") -> Column:
    symbols = 100 * F.col(prefix + "n_symbols") > MAX_SYMBOL_PERCENT * F.col(prefix + "word_chars")
    return symbols | (100 * F.col(prefix + "n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col(prefix + "n_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """host, n, failed, rate: failure rates shrunk by the beta prior that fits all hosts.

    ``judged`` has ``host`` and a boolean ``failed``. The fit is that of a beta-binomial by moments: m is the rate of
    all documents, and of the hosts' spread around it (each weighing its documents) what exceeds the sampling
    noise gives the correlation rho within a host; the prior weighs k = 1/rho - 1 documents, between 1 and 10000
    (10000 where the hosts differ no more than by chance).
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    sums = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n")).alias("ff")).first()
    m, weight = 0.0, 10_000.0
    if sums["h"]:
        m = sums["f"] / sums["n"]
        room = sums["n"] - sums["nn"] / sums["n"] - (sums["h"] - 1)
        if 0 < m < 1 and room > 0:
            rho = ((sums["ff"] - sums["n"] * m * m) / (m * (1 - m)) - (sums["h"] - 1)) / room
            weight = min(max(1 / rho - 1, 1.0), 10_000.0) if rho > 0 else 10_000.0
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(m * weight)) / (F.col("n") + F.lit(weight)))


def with_verdicts(counted: DataFrame, host_col: str = "host", prefix: str = "", host_percent: float = HOST_PERCENT) -> DataFrame:
    """``counted`` with base_failed, host_rate (of hosts with the strict rules, else null) and kept, under ``prefix``."""
    judged = counted.withColumn(prefix + "base_failed", base_failed(prefix)).withColumn(prefix + "strict_failed", strict_failed(prefix))
    rates = host_rates(judged.select(F.col(host_col).alias("host"), (F.col(prefix + "base_failed") | F.col(prefix + "strict_failed")).alias("failed")))
    bad = rates.filter(F.col("rate") * 100 >= host_percent).select(F.col("host").alias("_bad_host"), F.col("rate").alias(prefix + "host_rate"))
    if bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        bad = F.broadcast(bad)
    joined = judged.join(bad, judged[host_col].eqNullSafe(bad["_bad_host"]), "left").drop("_bad_host")
    kept = ~F.col(prefix + "base_failed") & (F.col(prefix + "host_rate").isNull() | ~F.col(prefix + "strict_failed"))
    return joined.withColumn(prefix + "kept", kept).drop(prefix + "strict_failed")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_percent: float = HOST_PERCENT) -> DataFrame:
    """doc_id, host, the five counts, base_failed, host_rate and kept for every row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    counted = stored(document_counts(slim), "quality-counts")
    return with_verdicts(counted, "host", "", host_percent)


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_percent: float = HOST_PERCENT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``; no text crosses the network."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    counted = stored(document_counts(docs, text_col, drop_text=False, prefix=prefix), "quality-documents")
    return with_verdicts(counted, host_col, prefix, host_percent).filter(F.col(prefix + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
