"""Benchmark decontamination by SimHash windows.

Texts are read as words (runs of letters, digits and other non-ASCII bytes; ASCII and Latin-1 capitals
lower-cased, so that case and punctuation do not hide a passage) and five-word shingles (fewer words: the
whole item). A window has as many words as a benchmark item. Only windows that share a shingle with an item
of their size can be similar to one, so windows are laid where a document's shingle is some item's shingle,
in line with its place in that item. Each such window gets a SimHash over its shingles. A multi-index of the
items' SimHashes, four blocks of 16 bits with up to radius/4 differing bits each, returns every item within
the radius (by the pigeonhole principle none is missed). Candidates are then verified exactly: the weighted
Jaccard similarity of window and item, each shingle weighing log(1 + items / items with it), must reach
``similarity``. Items are counted over the whole benchmark; a shingle that no item has weighs as one of one item.

The benchmark is taken in blocks of ``block_items`` items (by item_id), each small enough to send to every
task; documents are scanned once a block. With each block go the counts of the shingles that two items or more
of the benchmark have. Defined cases: null or empty texts match nothing; items without
words are ignored; of equal item_ids each text counts; a document's window is clipped to the document's
end, so a document shorter than the item can match with the words that it has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docgraph.llm.common import Hasher, map_slices, mix, stored, text_bytes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: Shingle sets with a weighted similarity of 0.8 differ in 9.6 of 64 bits on average; 19 is 3.5 deviations more.
RADIUS = 19
BLOCK_ITEMS = 4096
BLOCK_BITS = 16

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of U+00C0..U+00DE lower-cased."""
    out = _LOWER[data]
    if len(data) > 1:
        latin = np.zeros(len(data), bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[latin] += 32
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word within the document) of every shingle, and words a document.

    A document of fewer words than a shingle has one, of them all.
    """
    start, end, doc = word_spans(data, offsets, _INSIDE[data])
    word = Hasher(lowered(data)).ranges(start, end)
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n_words) - n_words
    # words run on as zeros behind a document's end, so that one formula serves short documents too
    at = np.arange(len(word)) - first[doc]
    key = np.zeros(len(word), np.uint64)
    for k in range(size - 1, -1, -1):
        other = np.zeros(len(word), np.uint64)
        m = max(0, len(word) - k)
        same = doc[k:] == doc[:m]
        other[:m][same] = word[k:][same]
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + other)
    whole = (at <= n_words[doc] - size) | (at == 0)
    return key[whole], doc[whole], n_words


#: Items; sorted shingles that two items or more have, and in how many each is.
Counts = tuple[int, np.ndarray, np.ndarray]


class Index:
    """The items of one block: shingles, weights, fingerprints and their multi-index.

    ``counts`` holds the number of items of the whole benchmark, and of those with each shingle that at least
    two have (sorted hashes, counts); without it the block is the benchmark.
    """

    def __init__(self, ids: list, texts: list[str], radius: int, counts: Counts | None = None) -> None:
        column = pa.array([t or "" for t in texts], pa.string())
        key, item, n_words = shingles(*text_bytes(column))
        self.radius = radius
        self.ids, self.n_words = ids, n_words
        self.n_shingles = np.maximum(n_words - SHINGLE + 1, np.minimum(n_words, 1))
        first = np.cumsum(self.n_shingles) - self.n_shingles
        place = np.arange(len(key)) - first[item]
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        pair = np.unique(np.stack([key, item.astype(np.uint64)], 1), axis=0) if len(key) else np.zeros((0, 2), np.uint64)
        self.known, count = np.unique(pair[:, 0], return_counts=True)
        self.counts = counts or (len(ids), self.known[count > 1], count[count > 1])
        self.pair_item, self.pair_key = pair[:, 1].astype(np.int64), pair[:, 0]
        by_item = np.lexsort((self.pair_key, self.pair_item))
        self.pair_item, self.pair_key = self.pair_item[by_item], self.pair_key[by_item]
        self.total = np.bincount(self.pair_item, self.weights(self.pair_key), minlength=len(ids))
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(self.known >> np.uint64(48)).astype(np.int64)] = True
        self.prints = simhashes(key, first[self.n_shingles > 0], len(key))
        self.print_item = np.nonzero(self.n_shingles > 0)[0]
        self.blocks = [self._block(b) for b in range(64 // BLOCK_BITS)]

    def weights(self, key: np.ndarray) -> np.ndarray:
        """log(1 + items / items with it) of each shingle, over the whole benchmark."""
        items, common, count = self.counts
        having = np.ones(len(key), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, key), len(common) - 1)
            having = np.where(common[at] == key, count[at], 1)
        return np.log1p(items / having)

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin of each block value, item places): for every value, the items within radius/4 bits."""
        near = [0] + [sum(1 << i for i in c) for d in range(1, self.radius // (64 // BLOCK_BITS) + 1) for c in combinations(range(BLOCK_BITS), d)]
        value = (self.prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & 0xFFFF
        key = (value[:, None] ^ np.array(near)[None, :]).ravel()
        owner = np.repeat(np.arange(len(self.prints), dtype=np.int32), len(near))
        order = np.argsort(key, kind="stable")
        return np.searchsorted(key[order], np.arange((1 << BLOCK_BITS) + 1)), owner[order]

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, distance) of all pairs within the radius."""
        found = []
        for b, (begin, owner) in enumerate(self.blocks):
            value = (prints >> np.uint64(b * BLOCK_BITS)).astype(np.int64) & 0xFFFF
            query, at = ranges(begin[value], begin[value + 1])
            found.append(query * len(self.prints) + owner[at])
        pair = np.unique(np.concatenate(found))
        query, item = pair // max(1, len(self.prints)), pair % max(1, len(self.prints))
        distance = np.bitwise_count(prints[query] ^ self.prints[item]).astype(np.int64)
        hit = distance <= self.radius
        return query[hit], self.print_item[item[hit]], distance[hit]


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every index of every range [begin, end)."""
    size = np.maximum(end - begin, 0)
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row]


def simhashes(keys: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each run of keys that begins at ``first``."""
    if not len(first):
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(keys.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    size = np.diff(np.append(first, n))
    return np.packbits(2 * ones > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def matches(data: np.ndarray, offsets: np.ndarray, index: Index, similarity: float) -> tuple[np.ndarray, ...]:
    """(document, item, first word, similarity, distance) of the best window of each pair."""
    key, doc, n_words = shingles(data, offsets)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0), np.zeros(0, np.int64))
    if not len(key) or not len(index.key):
        return none
    hit = np.nonzero(index.hint[(key >> np.uint64(48)).astype(np.int64)])[0]
    left, right = np.searchsorted(index.key, key[hit], "left"), np.searchsorted(index.key, key[hit], "right")
    row, at = ranges(left, right)
    if not len(row):
        return none
    where, item = hit[row], index.item[at]
    n_shingles = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n_shingles) - n_shingles
    owner = doc[where]
    # a window lies within the document; its size is that of the item
    begin = np.clip(where - first[owner] - index.place[at], 0, np.maximum(n_shingles[owner] - index.n_shingles[item], 0))
    size = np.minimum(index.n_shingles[item], n_shingles[owner])
    window = np.unique(np.stack([owner, begin, size], 1), axis=0)
    wrow, wat = ranges(first[window[:, 0]] + window[:, 1], first[window[:, 0]] + window[:, 1] + window[:, 2])
    wkey = key[wat]
    prints = simhashes(wkey, np.cumsum(window[:, 2]) - window[:, 2], len(wkey))
    query, item, distance = index.within(prints)
    same_size = (index.n_shingles[item] == window[query, 2]) | (n_shingles[window[query, 0]] < index.n_shingles[item])
    query, item, distance = query[same_size], item[same_size], distance[same_size]
    score = weighted_similarity(query, item, wrow, wkey, len(window), index)
    keep = score >= similarity
    query, item, distance, score = query[keep], item[keep], distance[keep], score[keep]
    order = np.lexsort((window[query, 1], -score, item, window[query, 0]))
    query, item, distance, score = query[order], item[order], distance[order], score[order]
    owner = window[query, 0]
    best = np.ones(len(query), bool)
    best[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1])
    return owner[best], item[best], window[query[best], 1], score[best], distance[best]


def weighted_similarity(query: np.ndarray, item: np.ndarray, wrow: np.ndarray, wkey: np.ndarray, n: int, index: Index) -> np.ndarray:
    """Sum of the weights that window and item share, over the sum of the weights of either."""
    if not len(query):
        return np.zeros(0)
    pair = np.unique(np.stack([wrow.astype(np.uint64), wkey], 1), axis=0)
    row, key = pair[:, 0].astype(np.int64), pair[:, 1]
    weight = index.weights(key)
    total = np.bincount(row, weight, minlength=n)
    begin = np.searchsorted(row, np.arange(n + 1))
    p, k = ranges(begin[query], begin[query + 1])
    packed = mix(index.pair_key ^ mix(index.pair_item.astype(np.uint64)))
    there = np.isin(mix(key[k] ^ mix(item[p].astype(np.uint64))), packed)
    shared = np.bincount(p[there], weight[k[there]], minlength=len(query))
    return shared / (total[query] + index.total[item] - shared)


_built: dict[str, Index] = {}


def _index(block: tuple[str, list, list[str]], radius: int, counts: Counts) -> Index:
    """One index a worker process and block, so that it lasts over tasks."""
    name, ids, texts = block
    if name not in _built:
        _built.clear()
        _built[name] = Index(ids, texts, radius, counts)
    return _built[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, first_word, similarity, distance): each document with each item that it holds."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _search(slim, ["doc_id"], benchmark, item_col, item_text_col, similarity, radius, block_items)


def _counts(benchmark: DataFrame, text_col: str) -> Counts:
    """Item counts over the whole benchmark; only shingles that two items or more have reach the driver."""
    texts = benchmark.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        key, item, _ = shingles(*text_bytes(part.column("t")))
        pair = np.unique(np.stack([key, item.astype(np.uint64)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].view(np.int64))], names=["key"])

    common = map_slices(texts, "t", step, "key bigint").groupBy("key").count().filter(F.col("count") > 1).toArrow()
    key, count = common.column("key").to_numpy().view(np.uint64), common.column("count").to_numpy()
    order = np.argsort(key)
    return texts.count(), key[order], count[order]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_items: int) -> Iterator[tuple[list, list[str], bool]]:
    """(ids, texts, whether it is the only one) of each block of the stated query set, read one at a time."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator()
    ids, texts, only = [], [], True
    for r in rows:
        if len(ids) == block_items:
            only = False
            yield ids, texts, only
            ids, texts = [], []
        ids.append(r.i)
        texts.append(r.t)
    yield ids, texts, only


def _search(slim: DataFrame, keys: list[str], benchmark: DataFrame, item_col: str, item_text_col: str, similarity: float, radius: int, block_items: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    counts = slim.sparkSession.sparkContext.broadcast(_counts(benchmark, item_text_col))
    found = None
    for ids, texts, only in _blocks(benchmark, item_col, item_text_col, block_items):
        sent = slim.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ids, texts))

        def step(part: pa.RecordBatch, sent: Broadcast = sent) -> pa.RecordBatch:
            index = _index(sent.value, radius, counts.value)
            doc, item, first, score, distance = matches(*text_bytes(pc.fill_null(part.column("text"), "")), index, similarity)
            at = pa.array(doc)
            return pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in keys), pa.array([index.ids[i] for i in item.tolist()], item_type), pa.array(first), pa.array(np.round(score, 6)), pa.array(distance)], names=[*keys, "item_id", "first_word", "similarity", "distance"])

        one = map_slices(slim, "text", step, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"item_id {item_kind}, first_word bigint, similarity double, distance bigint"]))
        # the findings of one block of several are written, so that no plan holds all blocks
        one = one if only else stored(one, "matches")
        found = one if found is None else found.unionByName(one)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns; no text moves between tasks."""
    schema = docs.schema
    counts = docs.sparkSession.sparkContext.broadcast(_counts(benchmark, "text"))
    for ids, texts, only in _blocks(benchmark, "item_id", "text", block_items):
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, ids, texts))

        def step(part: pa.RecordBatch, sent: Broadcast = sent) -> pa.RecordBatch:
            doc = matches(*text_bytes(pc.fill_null(part.column(text_col), "")), _index(sent.value, radius, counts.value), similarity)[0]
            clean = np.ones(part.num_rows, bool)
            clean[doc] = False
            return part.filter(pa.array(clean))

        docs = map_slices(docs, text_col, step, schema)
        docs = docs if only else stored(docs, "clean")
    return docs
