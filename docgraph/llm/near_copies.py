"""Near copies: candidates by minimum hashes and the SimHash trie self-join, links by exact similarity.

Two texts link when the Jaccard similarity of their sets of word shingles reaches ``similarity``; linked texts
form components.

1. Texts with equal shingle sets are one node. A node has a SimHash (64 bits) of its set and ``BANDS`` hashes of
   ``ROWS`` minima each, under fixed multiplications.
2. Nodes with an equal band hash are a bucket. In it the fingerprints' trie self-join (``simhash.trie_pairs``)
   gives the pairs within ``RADIUS`` bits; sizes that rule the similarity out leave. A bucket over
   ``hot_bucket`` nodes is dealt out as pairs of its parts, so that no task gets it whole.
3. Of a bucket's pairs a spanning forest is verified first, nearest pairs first, each pair on both whole sets.
4. Buckets of three nodes or more that are not of one component by then are settled: the whole sets go to the
   bucket's task, and each node outside the largest component is compared with all nodes of the bucket.

All tables between these steps but the sketches are written in as few files as their rows need.

Nothing but a pair's own similarity makes a link, and no pair of a bucket is left undecided. A pair at
similarity s shares a bucket with the chance 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8, more above; at 0.8 the
radius leaves out another 0.0005 or less.

Defined cases: words are separated by ASCII white space, A-Z are lower-cased; fewer words than a shingle make
one shingle of them all; texts without words (null ones too) equal one another and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import SPACE, Hasher, map_slices, mix, packed, small_batches, stored, text_bytes, word_spans
from docgraph.llm.simhash import HOT_BUCKET, by_bucket, connected, trie_pairs

BANDS, ROWS = 12, 3
#: Differing bits of 64 up to which a pair is a candidate: at similarity 0.8 they are 9.7 on average, deviation 2.9.
RADIUS = 20
#: Pairs that a bucket's task holds before it takes their forest.
HELD_PAIRS = 2_000_000
#: Whole sets in one file: about 30 MB at 350 shingles each.
FILE_SETS = 10_000
EPSILON = 1e-9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TURNS = np.random.Generator(np.random.PCG64(20240502)).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every distinct shingle of each document, by document and hash."""
    start, end, doc = word_spans(data, offsets, ~SPACE[data])
    word = Hasher(_LOWER[data]).ranges(start, end)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    at = np.arange(len(word)) - first[doc]
    key = np.zeros(len(word), np.uint64)
    for k in range(words - 1, -1, -1):
        other = np.zeros(len(word), np.uint64)
        m = max(0, len(word) - k)
        same = doc[k:] == doc[:m]
        other[:m][same] = word[k:][same]
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + other)
    whole = (at <= n_words[doc] - words) | (at == 0)
    key, doc = key[whole], doc[whole]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def fingerprints(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes that begins at ``first``: a bit is set if over half of them have it."""
    out = np.zeros(len(first), np.uint64)
    size = np.diff(np.append(first, len(key)))
    for bit in range(64):
        ones = np.add.reduceat((key >> np.uint64(bit)) & np.uint64(1), first).astype(np.int64)
        out |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    return out


def bands(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(run, band): each band's hash of its minima over the run's hashes."""
    out = np.zeros((len(first), BANDS), np.uint64)
    for k, turn in enumerate(_TURNS):
        low = np.minimum.reduceat(key * turn, first)
        out[:, k // ROWS] = mix(out[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + low)
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and row_key of ``docs`` with node (a hash of the text's shingle set), n (its size), fp and bands."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        key, doc = shingle_sets(*text_bytes(part.column("text")), words)
        cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
        n = np.diff(cut)
        full = np.nonzero(n)[0]
        raw = key.tobytes()
        node = np.array([xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], np.uint64)
        fp, band = np.zeros(part.num_rows, np.uint64), np.zeros((part.num_rows, BANDS), np.uint64)
        if len(full):
            fp[full], band[full] = fingerprints(key, cut[:-1][full]), bands(key, cut[:-1][full])
        ends = pa.array((np.arange(part.num_rows + 1) * BANDS).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(band.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), pa.array(node.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(fp.view(np.int64)), lists], names=["doc_id", "row_key", "node", "n", "fp", "bands"])

    return map_slices(docs.select("doc_id", "row_key", "text"), "text", step, f"doc_id {kinds['doc_id']}, row_key string, node bigint, n bigint, fp bigint, bands array<bigint>")


def buckets(nodes: DataFrame, hot_bucket: int) -> DataFrame:
    """(k1, k2, fp, node, n) of the buckets of two nodes or more; parts of a hot bucket come in pairs."""
    rows = nodes.filter(F.col("n") > 0).select("node", "n", "fp", F.posexplode("bands").alias("band", "k2")).select(F.col("band").cast("bigint").alias("k1"), "k2", "fp", "node", "n")
    sizes = rows.groupBy("k1", "k2").count().filter(F.col("count") > 1)
    rows = packed(rows.join(sizes, ["k1", "k2"]), "buckets")
    hot = rows.filter(F.col("count") > hot_bucket)
    calm = rows.filter(F.col("count") <= hot_bucket).drop("count")
    if hot.isEmpty():
        return calm
    parts = F.ceil(F.col("count") / (hot_bucket // 2)).cast("int")
    dealt = hot.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.xxhash64("k1", "k2", F.least("part", "other"), F.greatest("part", "other"))
    return calm.unionByName(dealt.select(F.lit(-1).cast("bigint").alias("k1"), pair.alias("k2"), "fp", "node", "n"))


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (best first) tie the labels' trees together; ``label`` follows."""
    at, chosen = np.arange(len(i)), []
    while len(at):
        li, lj = label[i[at]], label[j[at]]
        open_ = li != lj
        at, li, lj = at[open_], li[open_], lj[open_]
        if not len(at):
            break
        low, high = np.minimum(li, lj), np.maximum(li, lj)
        root, best = np.unique(high, return_index=True)
        chosen.append(at[best])
        label[root] = low[best]
        while not np.array_equal(jumped := label[label], label):
            label[:] = jumped
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def candidates(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of each bucket's pairs within the radius whose sizes allow the similarity.

    ``rows`` have k1, k2, fp, node and n.
    """

    def step(columns: dict[str, np.ndarray], begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, n = columns["node"], columns["n"].astype(np.float64)
        label = np.arange(len(node))
        held: list[np.ndarray] = []

        def forest() -> pa.RecordBatch:
            i, j, d = np.concatenate(held, axis=1)
            order = np.lexsort((node[j], node[i], d))
            i, j = i[order], j[order]
            tied = _forest(label, i, j)
            a, b = node[i[tied]], node[j[tied]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for i, j, d in trie_pairs(columns["fp"].view(np.uint64), begin, end, RADIUS):
            fits = (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - EPSILON)
            if fits.any():
                held.append(np.stack([i[fits], j[fits], d[fits]]))
            if sum(x.shape[1] for x in held) > HELD_PAIRS:
                yield forest()
                held = []
        if held:
            yield forest()

    return by_bucket(rows.select("k1", "k2", "fp", "node", "n"), step, "a bigint, b bigint").distinct()


def whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, raw): the sorted hashes of each node's set as bytes."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        key, doc = shingle_sets(*text_bytes(part.column("text")), words)
        cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
        return pa.RecordBatch.from_arrays([part.column("node"), pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["node", "raw"])

    return map_slices(texts.select("node", "text"), "text", step, "node bigint, raw binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the similarity."""
    one = sets.select(F.col("node").alias("a"), F.col("raw").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("raw").alias("y"))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(part.column("x"), part.column("y")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            good.append(common >= similarity * (len(x) + len(y) - common) - EPSILON)
        return part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_slices(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y"), "x", step, "a bigint, b bigint")


def _settled(node: np.ndarray, root: np.ndarray, raw: list[bytes], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between the components of one bucket: a forest of its similar pairs of different roots."""
    n = np.array([len(r) // 8 for r in raw], np.int64)
    _, code = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
    first = np.cumsum(n) - n
    _, at, tree, size = np.unique(root, return_index=True, return_inverse=True, return_counts=True)
    label = at[tree]
    there = np.zeros(int(code.max()) + 1, np.int32)
    ends: list[np.ndarray] = []
    for i in np.nonzero(tree != size.argmax())[0].tolist():
        mine = code[first[i] : first[i] + n[i]]
        there[mine] = 1
        common = np.add.reduceat(there[code], first)
        there[mine] = 0
        j = np.nonzero((common >= similarity * (n + n[i] - common) - EPSILON) & (label != label[i]))[0]
        if len(j):
            pair = np.full(len(j), i), j
            tied = _forest(label, *pair)
            ends.append(np.stack([node[pair[0][tied]], node[j[tied]]]))
    return tuple(np.concatenate(ends, axis=1)) if ends else (np.zeros(0, np.int64),) * 2


def settled(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) within the buckets of ``rows`` (k1, k2, node, root, raw) between different components."""
    small_batches(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch:
            node, root, raw = zip(*held)
            a, b = _settled(np.array(node), np.array(root), list(raw), similarity)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for k1, k2, *rest in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "node", "root", "raw"))):
                if (k1, k2) != key:
                    if len(held) > 1:
                        yield links()
                    key, held = (k1, k2), []
                held.append(rest)
        if len(held) > 1:
            yield links()

    return rows.select("k1", "k2", "node", "root", "raw").repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(run, "a bigint, b bigint")


def components(docs: DataFrame, words: int, similarity: float, hot_bucket: int = HOT_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(marked, roots) of ``docs`` (doc_id, row_key, text without nulls): marked has doc_id, row_key and node of every
    row, roots (node, root) every node that links with another one, root being the smallest node it reaches."""
    marked = stored(sketches(docs, words), "sketches")
    nodes = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    rows = buckets(nodes, hot_bucket)
    pairs = packed(candidates(rows, similarity), "candidates")
    # every node with a candidate is in the forests
    open_ = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # a shingle set may hold any share of the rows: they are combined before the join
    asked = marked.groupBy("node").agg(F.min("row_key").alias("row_key")).join(open_, "node", "left_semi")
    texts = docs.select("row_key", "text").join(asked, "row_key").select("node", "text")
    sets = packed(whole_sets(texts, words), "shingle-sets", FILE_SETS)
    links = packed(verified(pairs, sets, similarity), "near-copies")
    roots = connected(links).withColumnRenamed("id", "node")
    known = sets.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    named = packed(rows.select("k1", "k2", "node").join(known, "node"), "open-buckets")
    unsettled = named.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("size > 2 and low < high").select("k1", "k2")
    more = packed(settled(named.join(unsettled, ["k1", "k2"]).join(sets, "node"), similarity), "near-copies")
    return marked.select("doc_id", "row_key", "node"), connected(links.unionByName(more)).withColumnRenamed("id", "node")
