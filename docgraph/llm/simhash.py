"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 hashes of its word
shingles. Fingerprints link when at most ``radius`` bits differ; linked documents form components.

The join is exact. The 64 bits are cut into radius + 1 blocks, so two linked fingerprints agree on one block
at least; each fingerprint goes once to the bucket of each of its block values. In a bucket the sorted
fingerprints are the leaves of a binary trie: node pairs are walked together from the root down to single
fingerprints, differing bits add up along the way, and a pair of nodes is left as soon as its sum exceeds the
radius. The tries of many buckets are walked at once. A bucket that holds
more than ``hot_bucket`` fingerprints is cut again by blocks of the bits that are left, so that no task gets
an unbounded bucket. A bucket returns a spanning forest of its links, never all pairs of a group; components
follow from min-label rounds with pointer jumping over those edges, each written to the shared folder.

Defined cases: a null or empty text has the fingerprint zero, which links like any other; fewer words than
a shingle make one shingle of them all; equal texts share a fingerprint and so a component; a null id is
never the smallest one (a component of null ids only has a null id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import map_slices, packed, small_batches, spread_join, stored

BITS = 64
SEED = 42
#: Fingerprints of one bucket that a task takes as one trie; larger buckets are cut again.
HOT_BUCKET = 50_000
#: Rows of whole buckets that a task takes at a time (or one bucket).
BUCKET_ROWS = 20_000
#: Node pairs of the trie that one numpy step takes, and pairs of equal fingerprints that it lists at a time.
STEP_NODES, STEP_PAIRS = 20_000, 2_000_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | bytes | None, words: int) -> int:
    """The fingerprint of one text; A-Z are lower-cased, other letters stay."""
    raw = text.encode() if isinstance(text, str) else text or b""
    parts = raw.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[min(words, len(parts)) - 1 :].tolist())]
    lanes = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int, keys: list[str], text_col: str = "text") -> DataFrame:
    """The ``keys`` columns and ``fp`` (the fingerprint as a signed bigint) of every row."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    frame = docs.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_text"))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(t, words) for t in part.column("_text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(got)], names=[*keys, "fp"])

    return map_slices(frame, "_text", step, ", ".join([f"`{k}` {fields[k]}" for k in keys] + ["fp bigint"]))


def block_masks(bits: list[int], blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of the given bit numbers, as even as can be."""
    cuts = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bit_length(x: np.ndarray) -> np.ndarray:
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return np.bitwise_count(x).astype(np.int64)


def _low(bit: np.ndarray) -> np.ndarray:
    """Masks of the bits below ``bit`` (0 to 64)."""
    return np.where(bit == 0, np.uint64(0), np.uint64(2**64 - 1) >> (np.uint64(BITS) - np.maximum(bit, 1).astype(np.uint64)))


def trie_pairs(fps: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of all pairs i < j within ``radius`` bits in each bucket [begin, end) of ``fps``.

    A bucket's fingerprints are sorted: its trie is the ranges that share their upper bits. Node pairs are rows
    (a0, a1, b0, b1, errors, bit): two ranges that share their bits above ``bit`` and differ in ``errors`` bits
    there. Runs of bits that no node of a pair branches on are passed at once; leaves are equal fingerprints.
    """
    zero = np.zeros(len(begin), np.int64)
    stack = [np.stack([begin, end, begin, end, zero, zero + BITS], 1)]
    while stack:
        nodes = stack.pop()
        if len(nodes) > STEP_NODES:
            stack += [nodes[STEP_NODES:], nodes[:STEP_NODES]]
            continue
        nodes = _descended(fps, nodes)
        nodes = nodes[nodes[:, 4] <= radius]
        yield from _leaf_pairs(nodes[nodes[:, 5] == 0])
        nodes = nodes[nodes[:, 5] > 0]
        if len(nodes):
            stack.append(_children(fps, nodes, radius))


def _descended(fps: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The node pairs at the next bit on which one of them branches, with the errors on the way."""
    a0, a1, b0, b1, errors, bit = nodes.T
    one, two = fps[a0], fps[b0]
    branch = _bit_length((one ^ fps[a1 - 1]) | (two ^ fps[b1 - 1]))
    passed = (one ^ two) & _low(bit) & ~_low(branch)
    return np.stack([a0, a1, b0, b1, errors + np.bitwise_count(passed), branch], 1)


def _split(fps: np.ndarray, first: np.ndarray, end: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the entries with ``bit`` set begin in each range that shares the bits above: a binary search in each."""
    shift = bit.astype(np.uint64)
    border = ((fps[first] >> shift) | np.uint64(1)) << shift
    low, high = first.copy(), end.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = fps[np.minimum(middle, len(fps) - 1)] < border
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def _children(fps: np.ndarray, nodes: np.ndarray, radius: int) -> np.ndarray:
    a0, a1, b0, b1, errors, bit = nodes.T
    bit = bit - 1
    am, bm = _split(fps, a0, a1, bit), _split(fps, b0, b1, bit)
    same = a0 == b0
    out = [
        np.stack([a0, am, b0, bm, errors, bit], 1),
        np.stack([am, a1, bm, b1, errors, bit], 1),
        np.stack([a0, am, bm, b1, errors + 1, bit], 1),
        np.stack([am, a1, b0, bm, errors + 1, bit], 1)[~same],
    ]
    rows = np.concatenate(out)
    return rows[(rows[:, 0] < rows[:, 1]) & (rows[:, 2] < rows[:, 3]) & (rows[:, 4] <= radius)]


def _leaf_pairs(leaves: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs under leaf pairs, at most about STEP_PAIRS (or one row of a product) at a time."""
    single = (leaves[:, 0] == leaves[:, 2]) & (leaves[:, 1] - leaves[:, 0] == 1)
    leaves = leaves[~single]
    if not len(leaves):
        return
    # one row for each entry of the first range
    size = leaves[:, 1] - leaves[:, 0]
    row = np.repeat(np.arange(len(leaves)), size)
    i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + leaves[row, 0]
    first = np.where(leaves[row, 0] == leaves[row, 2], i + 1, leaves[row, 2])
    width = leaves[row, 3] - first
    total = np.cumsum(width)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP_PAIRS, "right")))
        w = width[at:stop]
        of = np.repeat(np.arange(at, stop), w)
        j = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w) + first[of]
        yield np.minimum(i[of], j), np.maximum(i[of], j), leaves[row[of], 4]
        at = stop


def trie_forest(fps: np.ndarray, begin: np.ndarray, end: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) of a spanning forest of all links within each bucket of distinct fingerprints."""
    label = np.arange(len(fps))
    for i, j, _ in trie_pairs(fps, begin, end, radius):
        _unite(label, i, j)
    linked = np.nonzero(label != np.arange(len(fps)))[0]
    return fps[linked], fps[label[linked]]


def _unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i[k] and j[k]; afterwards label holds the smallest index of each."""
    while len(i):
        li, lj = label[i], label[j]
        open_ = li != lj
        if not open_.any():
            return
        i, j, li, lj = i[open_], j[open_], li[open_], lj[open_]
        np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped


def by_bucket(rows: DataFrame, step: Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``step`` on whole buckets of ``rows`` (k1, k2, fp and more bigint columns), many at a time.

    It gets the columns sorted by bucket and fingerprint, and where the buckets of two rows or more begin and end.
    """
    small_batches(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            columns = dict(zip(names, table))
            fps = columns["fp"].view(np.uint64)
            order = np.lexsort((fps, columns["k2"], columns["k1"]))
            columns = {k: v[order] for k, v in columns.items()}
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(columns["k1"]) != 0) | (np.diff(columns["k2"]) != 0)
            begin = np.nonzero(new)[0]
            end = np.append(begin[1:], len(order))
            several = end - begin > 1
            if several.any():
                yield from step(columns, begin[several], end[several])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy() for c in names]))
            if sum(x.shape[1] for x in held) < BUCKET_ROWS:
                continue
            table = np.concatenate(held, axis=1)
            # the last bucket may go on in the next batch
            inner = np.nonzero((table[0] != table[0, -1]) | (table[1] != table[1, -1]))[0]
            last = int(inner[-1]) + 1 if len(inner) else 0
            held = [table[:, last:]]
            if last:
                yield from solve(table[:, :last])
        if held:
            yield from solve(np.concatenate(held, axis=1))

    return rows.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(run, schema)


def bucket_edges(keyed: DataFrame, radius: int) -> DataFrame:
    """Forest edges (a, b) of each bucket of ``keyed`` (k1, k2, fp)."""

    def step(columns: dict[str, np.ndarray], begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = trie_forest(columns["fp"].view(np.uint64), begin, end, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return by_bucket(keyed.select("k1", "k2", "fp"), step, "a bigint, b bigint")


def links(nodes: DataFrame, radius: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Forest edges (a, b) that connect all distinct fingerprints (column fp) within ``radius`` bits."""
    masks = block_masks(list(range(BITS)), radius + 1)

    blocks = F.array(*[F.struct(F.lit(i).cast("bigint").alias("k1"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k2")) for i, m in enumerate(masks)])
    first = nodes.select("fp", F.explode(blocks).alias("k")).select("fp", "k.k1", "k.k2")
    hot = first.groupBy("k1", "k2").count().filter(F.col("count") > hot_bucket).drop("count")
    if hot.isEmpty():
        return bucket_edges(first, radius)
    hot = stored(hot, "hot-buckets")
    calm = first.join(hot, ["k1", "k2"], "left_anti")
    warm = first.join(hot, ["k1", "k2"], "left_semi")
    again = None
    for i, mask in enumerate(masks):
        rest = block_masks([b for b in range(BITS) if not mask >> b & 1], radius + 1)
        inner = F.array(*[F.struct(F.xxhash64(F.lit(i), F.col("k2"), F.lit(j)).alias("k1"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k2")) for j, m in enumerate(rest)])
        part = warm.filter(F.col("k1") == i).select("fp", F.explode(inner).alias("k")).select("fp", "k.k1", "k.k2")
        again = part if again is None else again.unionByName(part)
    return bucket_edges(calm, radius).unionByName(bucket_edges(again, radius))


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with about one edge per node: each node keeps its smallest root, and its other
    roots hang on that one. A node has one root per bucket at most, so its set of roots is small."""
    roots = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("roots")).withColumn("low", F.least(F.col("a"), F.col("roots")[0]))
    ends = roots.select(F.explode(F.concat(F.array("a"), "roots")).alias("a"), F.col("low").alias("b"))
    return ends.filter(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) of every end of an edge; root is the smallest id that it reaches.

    Rounds of min-label over the edges and one pointer jump, until none changes; every round is written to
    the shared folder, in as few files as its rows need. The links' forests are shallow, so a handful of rounds are enough.
    """
    edges = contracted(edges)
    both = packed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = packed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels["id"] == near["a"], "left").select("id", F.least("root", "near").alias("up"), F.col("root").alias("was"))
        top = hooked.select(F.col("id").alias("top"), F.col("up").alias("root"))
        jumped = packed(hooked.join(top, hooked["up"] == top["top"]).select("id", "root", "was"), "labels")
        labels = jumped.select("id", "root")
        if jumped.filter(F.col("root") != F.col("was")).isEmpty():
            return labels


def distinct_fingerprints(marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A stored table with fp, least_id (the smallest id that has it) and rows (how many of ``marked`` do)."""
    return stored(marked.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("rows")), "fingerprints")


def components(marked: DataFrame, radius: int, id_col: str = "doc_id", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint; component_id is the smallest id in its component."""
    return named_components(distinct_fingerprints(marked, id_col), radius, hot_bucket)


def named_components(nodes: DataFrame, radius: int, hot_bucket: int) -> DataFrame:
    """(fp, component_id) of the rows of ``distinct_fingerprints``."""
    roots = connected(links(nodes, radius, hot_bucket))
    linked = nodes.join(roots, nodes["fp"] == roots["id"]).select("fp", "root", "least_id")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    return nodes.join(named, nodes["fp"] == named["linked_fp"], "left").select("fp", F.when(F.col("linked_fp").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = stored(fingerprints(slim, words, ["doc_id"]), "simhash")
    nodes = distinct_fingerprints(marked)
    found = named_components(nodes, radius, hot_bucket)
    # a fingerprint may hold any share of the rows: its rows are dealt by their ids
    return spread_join(marked, found, ["fp"], nodes, ["doc_id"], "inner").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with its own columns: that of the smallest id, then text.

    Documents link when their sets of word shingles reach the similarity: the trie self-join gives the candidates
    and each of their links is verified on the whole sets (``near_copies``). Identical rows (same id and text)
    count as copies of one another; texts without words, null ones too, are copies of one another. A column of
    ``docs`` may have any name.
    """
    from docgraph.llm import near_copies  # imports this module

    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    slim = docs.select(F.col(id_col).alias("doc_id"), key.alias("row_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked, roots = near_copies.components(slim, words, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    nodes = marked.groupBy("node").agg(first)
    chosen = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("component")).agg(F.min("first").alias("first"))
    kept = chosen.select(F.col("first.row_key").alias("row_key"))
    whole = docs.select(key.alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select("row.*")
