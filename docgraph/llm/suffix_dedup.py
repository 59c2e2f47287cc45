"""Exact substring deduplication with suffix arrays built by two-stage sorting.

Every byte that a ``length``-byte string covers is removed if that string also starts anywhere else in the
corpus. No suffix of all the corpus is sorted: a filter that loses nothing leaves the few places that can
match, and suffix arrays decide those.

1. Anchors. Each window of ``length`` bytes owns the smallest hash among its ``GRAM``-byte strings; equal
   windows own equal strings at equal places. Runs of windows with one owner are one row: the owner's hash,
   the windows' range and a hash of all their bytes. Owners that occur once in the corpus cannot match.
2. Of the rest, ranges whose bytes occur twice as a whole are removed at once. The others, and one range of
   each kind with their owner, go with their bytes to the task of their owner's hash.
3. A task takes its ranges in batches of whole owners and builds one suffix array for each: suffixes smaller
   than their successors are sorted directly (only those that a window can depend on), all other ones are
   induced by scanning the buckets from the smallest, and the common prefixes of neighbours give the windows
   that occur twice.
4. An owner with more than ``hot`` different ranges is never taken to one task: its ranges are cut in cells
   at fixed distances from the owner, in rounds (32, 4 and 1 windows wide), and counted: cells whose common
   bytes occur once are done, cells that occur twice as a whole are removed, the rest is cut again.

Beside the removed bytes, the words of passages of ``words`` words that start elsewhere too are counted (a passage
of 51 short words has less than 400 bytes): the same anchors over words, whole runs and then single windows by
their hashes.

Defined cases: a null text is empty; shorter texts than ``length`` lose nothing; repeated rows lose every
byte that lies in a long enough text, each of them; a null id is an id like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import SPACE, Hasher, drop_stored, map_slices, mix, small_batches, spread_join, stored, text_bytes, word_spans

LENGTH = 400
GRAM = 128
HOT = 1000
CELLS = (32, 4, 1)
#: Passages of so many words are reported too, whatever their length in bytes; each window owns a gram of so many.
PASSAGE_WORDS, PASSAGE_GRAM = 51, 12
#: Bytes of ranges that one suffix array holds, unless one owner has more (at most ``hot`` ranges).
BATCH_BYTES = 1 << 20
#: Window starts that are scanned at a time; a longer text is scanned in segments that overlap by a window.
SEGMENT_BYTES = 4 << 20
#: Bits of a key that hold the place of the hash; the others hold the hash.
PLACE_BITS = np.uint64(28)
COMPARE_ROWS = 2048


def row_key(id_col: Column, text: Column) -> Column:
    """128 bits that name a row by its id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), text)))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, place of the owner, first window, last window, owner hash, range hash) of a slice.

    Places count from the slice's beginning.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    n, width = len(data), length - gram + 1
    if n < length:
        return none
    if n > SEGMENT_BYTES + length - 1:
        parts = []
        for start in range(0, n, SEGMENT_BYTES):
            stop = min(n, start + SEGMENT_BYTES + length - 1)
            doc, at, lo, hi, kh, uh = anchors(data[start:stop], np.clip(offsets, start, stop) - start, length, gram)
            parts.append((doc, at + start, lo + start, hi + start, kh, uh))
        return tuple(map(np.concatenate, zip(*parts)))
    hasher = Hasher(data)
    grams = np.arange(n - gram + 1)
    h = hasher.ranges(grams, grams + gram)
    key = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h >> PLACE_BITS << PLACE_BITS) | grams.astype(np.uint64)
    blocks = key.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    doc_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.nonzero(np.arange(n) + length <= offsets[doc_of + 1])[0]
    if not len(windows):
        return none
    owner = (np.minimum(after[windows], before[windows + width - 1]) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) != 1) | (np.diff(owner) != 0) | (doc_of[windows][1:] != doc_of[windows][:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(windows)) - 1
    lo, hi, at = windows[first], windows[last], owner[first]
    kh = h[at]
    # the range's bytes, and where the owner stands in them
    uh = mix(digests(data.tobytes(), lo, hi + length) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return doc_of[lo], at, lo, hi, kh, uh


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of each byte range: what ranges are told apart by wherever equal hashes stand for equal bytes."""
    view = memoryview(raw)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def anchor_rows(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(row_key, kh, uh, at, lo, hi, n) by document; n = 0 marks a range that its own document repeats."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column("text"))
        doc, at, lo, hi, kh, uh = anchors(data, offsets, length, gram)
        key = mix(kh ^ mix(uh + doc.astype(np.uint64)))
        _, first, place, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        n = np.zeros(len(doc), np.int64)
        n[first] = count
        base = offsets[doc]
        # repeats within a document need no partner elsewhere; neighbouring ones become one row
        order = np.lexsort((lo, n > 0, doc))
        doc, at, lo, hi, kh, uh, n, base = (x[order] for x in (doc, at, lo, hi, kh, uh, n, base))
        start = np.ones(len(doc), bool)
        start[1:] = (n[1:] > 0) | (n[:-1] > 0) | (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)
        begin = np.nonzero(start)[0]
        end = np.append(begin[1:], len(doc)) - 1
        ints = lambda x: pa.array((x - base[begin]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [part.column("row_key").take(pa.array(doc[begin])), pa.array(kh[begin].view(np.int64)), pa.array(uh[begin].view(np.int64)), ints(at[begin]), ints(lo[begin]), ints(hi[end]), pa.array(n[begin].astype(np.int32))],
            names=["row_key", "kh", "uh", "at", "lo", "hi", "n"],
        )

    return map_slices(keyed, "text", step, "row_key binary, kh bigint, uh bigint, at int, lo int, hi int, n int")


def induced_order(symbols: np.ndarray, active: np.ndarray, smaller: np.ndarray, direct: np.ndarray) -> np.ndarray:
    """The active suffixes in order, given the sorted ``direct`` ones (those smaller than their successors).

    ``symbols`` are 0 at the end of each range and 1 + byte elsewhere. Buckets are scanned from the smallest:
    a suffix that is larger than its successor follows the order of the successors.
    """
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray) -> None:
        before = found - 1
        before = before[before >= 0]
        before = before[active[before] & ~smaller[before]]
        if len(before):
            bucket = symbols[before]
            order = np.argsort(bucket, kind="stable")
            bucket, before = bucket[order], before[order]
            cut = np.nonzero(np.diff(bucket))[0] + 1
            for b, part in zip(bucket[np.concatenate([[0], cut])].tolist(), np.split(before, cut)):
                waiting[b].append(part)

    induce(np.nonzero(symbols == 0)[0])
    edges = np.searchsorted(symbols[direct], np.arange(258))
    for bucket in range(1, 257):
        for part in waiting[bucket]:  # grows while it is scanned: runs of one symbol
            out.append(part)
            induce(part)
        own = direct[edges[bucket] : edges[bucket + 1]]
        if len(own):
            out.append(own)
            induce(own)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_windows(ranges: list[bytes], length: int) -> list[np.ndarray]:
    """For each range (windows start at all but its last length - 1 bytes): does the window occur twice."""
    sizes = np.array(list(map(len, ranges)), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    raw = b"\0".join(ranges) + b"\0"
    symbols = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
    symbols[ends] = 0
    n = len(symbols)
    # smaller than its successor: the next different symbol is larger
    change = np.nonzero(np.diff(symbols) != 0)[0]
    nearest = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
    smaller = symbols[nearest] < symbols[np.minimum(nearest + 1, n - 1)]
    smaller[ends] = False
    # windows need the order of what follows them up to the next directly sorted suffix
    owner = np.repeat(np.arange(len(ranges)), sizes + 1)
    window = np.arange(n) <= (ends - length)[owner]
    small_at = np.nonzero(smaller)[0]
    follow = np.searchsorted(small_at, ends - length)
    reach = np.minimum(np.where(follow < len(small_at), small_at[np.minimum(follow, max(0, len(small_at) - 1))], n), ends - 1) if len(small_at) else ends - 1
    active = np.arange(n) <= reach[owner]
    active[ends] = False
    todo = np.nonzero(active & smaller)[0]
    stop = np.minimum(todo + length, ends[owner[todo]])
    text = [raw[a:b] for a, b in zip(todo.tolist(), stop.tolist())]
    direct = todo[np.array(sorted(range(len(todo)), key=text.__getitem__), np.int64)]
    order = induced_order(symbols, active, smaller, direct)
    order = order[window[order]]
    twice = np.zeros(n, bool)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), length)
    for a in range(0, len(order) - 1, COMPARE_ROWS):
        x, y = order[a : a + COMPARE_ROWS], order[a + 1 : a + 1 + COMPARE_ROWS]
        x = x[: len(y)]
        prefix = _common_prefix(view[x], view[y])
        same = prefix >= length
        twice[x[same]] = True
        twice[y[same]] = True
    return [twice[a : e - length + 1] for a, e in zip(begins.tolist(), ends.tolist())]


def _common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of set flags."""
    padded = np.concatenate([[False], flags, [False]])
    edge = np.nonzero(np.diff(padded.astype(np.int8)))[0]
    return edge[::2], edge[1::2] - 1


def decide(fragments: DataFrame, length: int) -> DataFrame:
    """Removed window ranges (row_key, lo, hi) among fragments (kh, row_key, lo, open, raw), by suffix arrays."""
    spark = fragments.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def solve(rows: list[tuple[bytes, int, bool, bytes]]) -> pa.RecordBatch:
        keys, lows, highs = [], [], []
        for (key, lo, open_, _), flags in zip(rows, repeated_windows([r[3] for r in rows], length)):
            if open_:
                first, last = runs(flags)
                keys += [key] * len(first)
                lows += (first + lo).tolist()
                highs += (last + lo).tolist()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names=["row_key", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, bool, bytes]] = []
        held, last = 0, None
        for batch in batches:
            for kh, key, lo, open_, raw in zip(*(batch.column(c).to_pylist() for c in ("kh", "row_key", "lo", "open", "raw"))):
                if kh != last and held >= BATCH_BYTES:
                    yield solve(rows)
                    rows, held = [], 0
                last = kh
                rows.append((key, lo, open_, raw))
                held += len(raw)
        if rows:
            yield solve(rows)

    return fragments.select("kh", "row_key", "lo", "open", "raw").repartition(n, "kh").sortWithinPartitions("kh").mapInArrow(run, "row_key binary, lo int, hi int")


def cells(parts: DataFrame, width: int, length: int) -> DataFrame:
    """Ranges cut at multiples of ``width`` from their owner: (ck, uk) hash the cell's common and whole bytes."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column("raw"))
        lo, hi, at = (part.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "at"))
        nearest, farthest = (at - hi) // width, (at - lo) // width
        count = farthest - nearest + 1
        row = np.repeat(np.arange(len(lo)), count)
        c = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + nearest[row]
        high, low = at[row] - c * width, at[row] - (c + 1) * width + 1
        p0, p1 = np.maximum(low, lo[row]), np.minimum(high, hi[row])
        shift = offsets[row] - lo[row]
        raw = data.tobytes()
        ck = mix(digests(raw, high + shift, low + length + shift) ^ mix(part.column("kh").to_numpy().view(np.uint64)[row] + c.astype(np.uint64)))
        uk = mix(digests(raw, p0 + shift, p1 + length + shift) + mix(ck + (at[row] - p0).astype(np.uint64)))
        cut = [raw[a:b] for a, b in zip((p0 + shift).tolist(), (p1 + length + shift).tolist())]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays([part.column("kh").take(take), part.column("row_key").take(take), part.column("open").take(take), pa.array(at[row].astype(np.int32)), pa.array(p0.astype(np.int32)), pa.array(p1.astype(np.int32)), pa.array(cut, pa.binary()), pa.array(ck.view(np.int64)), pa.array(uk.view(np.int64))], names=["kh", "row_key", "open", "at", "lo", "hi", "raw", "ck", "uk"])

    return map_slices(parts.select("kh", "row_key", "open", "at", "lo", "hi", "raw"), "raw", step, "kh bigint, row_key binary, open boolean, at int, lo int, hi int, raw binary, ck bigint, uk bigint")


def decide_hot(parts: DataFrame, length: int) -> DataFrame:
    """Removed window ranges of owners with very many ranges, by counting ever smaller cells."""
    found = None
    for width in CELLS:
        cut = stored(cells(parts, width, length), "cells")
        whole = stored(cut.groupBy("ck", "uk").agg(F.count(F.lit(1)).alias("rows")), "cell-counts")
        common = stored(whole.groupBy("ck").agg(F.count(F.lit(1)).alias("rows"), F.sum("rows").alias("total")).filter(F.col("total") > 1), "cell-counts")
        known = stored(spread_join(whole, common.select("ck"), ["ck"], common, ["uk"]), "cell-counts")
        alive = spread_join(cut, known.select("ck", "uk", F.col("rows").alias("same")), ["ck", "uk"], known, ["row_key", "lo"], "inner")
        alive = stored(alive.select("kh", "row_key", "open", "at", "lo", "hi", "raw", "same"), "cells")
        drop_stored(cut)
        done = alive.filter((F.col("same") > 1) & F.col("open")).select("row_key", "lo", "hi")
        found = done if found is None else found.unionByName(done)
        # a settled range stays as a partner of open ones, once
        parts = alive.filter(F.col("same") == 1).unionByName(alive.filter(F.col("same") > 1).dropDuplicates(["kh", "at", "lo", "hi", "raw"]).withColumn("open", F.lit(False))).drop("same")
    return found


def passage_anchors(data: np.ndarray, offsets: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first word, first byte, end byte, owner hash, range hash) of the runs of ``words``-word windows
    that own one gram; words and bytes count from the document's beginning."""
    start, end, doc = word_spans(data, offsets, ~SPACE[data])
    n, width = len(start), words - gram + 1
    if n < words:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    word = Hasher(data).ranges(start, end)
    hasher = Hasher(word)
    grams = np.arange(n - gram + 1)
    h = hasher.ranges(grams, grams + gram)
    windows = np.nonzero(doc[words - 1 :] == doc[: n - words + 1])[0]
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    least = [view[windows[a : a + COMPARE_ROWS]].argmin(1) for a in range(0, len(windows), COMPARE_ROWS)]
    owner = windows + np.concatenate([*least, np.zeros(0, np.int64)]).astype(np.int64)
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) != 1) | (np.diff(owner) != 0) | (np.diff(doc[windows]) != 0)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(windows)) - 1
    lo, hi, at = windows[first], windows[last], owner[first]
    of = doc[lo]
    uh = mix(hasher.ranges(lo, hi + words) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    return of, lo - (np.cumsum(n_words) - n_words)[of], start[lo] - offsets[of], end[hi + words - 1] - offsets[of], h[at], uh


def passage_rows(keyed: DataFrame, words: int, gram: int) -> DataFrame:
    """(row_key, kh, uh, lo, begin, end) of every run: ``lo`` is its first word, begin and end are bytes."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        doc, lo, begin, end, kh, uh = passage_anchors(*text_bytes(part.column("text")), words, gram)
        ints = [pa.array(x.astype(np.int32)) for x in (lo, begin, end)]
        return pa.RecordBatch.from_arrays([part.column("row_key").take(pa.array(doc)), pa.array(kh.view(np.int64)), pa.array(uh.view(np.int64)), *ints], names=["row_key", "kh", "uh", "lo", "begin", "end"])

    return map_slices(keyed, "text", step, "row_key binary, kh bigint, uh bigint, lo int, begin int, end int")


def passage_windows(fragments: DataFrame, words: int) -> DataFrame:
    """(h, row_key, lo, open): the hash of every window of fragments (row_key, lo, open, raw), lo being its first word."""

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column("raw"))
        start, end, doc = word_spans(data, offsets, ~SPACE[data])
        hasher = Hasher(Hasher(data).ranges(start, end))
        at = np.nonzero(doc[words - 1 :] == doc[: max(0, len(doc) - words + 1)])[0]
        h = hasher.ranges(at, at + words)
        of = doc[at]
        n_words = np.bincount(doc, minlength=part.num_rows)
        take = pa.array(of)
        lo = part.column("lo").to_numpy()[of] + at - (np.cumsum(n_words) - n_words)[of]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("row_key").take(take), pa.array(lo.astype(np.int32)), part.column("open").take(take)], names=["h", "row_key", "lo", "open"])

    return map_slices(fragments, "raw", step, "h bigint, row_key binary, lo int, open boolean")


def repeated_ranges(keyed: DataFrame, length: int, gram: int, hot: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Ranges of window starts that occur twice in the corpus: (row_key, lo, hi) in bytes and (row_key, lo, n) in words."""
    rows = stored(anchor_rows(keyed.filter(F.octet_length("text") >= length), length, gram), "anchors")
    own = stored(rows.filter(F.col("n") == 0).select("row_key", "lo", "hi"), "own-repeats")
    whole, asked = _shared(rows.filter(F.col("n") > 0), "n", F.struct("row_key", "lo", "hi", "at"))
    drop_stored(rows)
    whole = whole.select("row_key", "lo", "hi")
    asked = asked.select("kh", "one.row_key", "one.lo", "one.hi", "one.at", "open", "ranges", F.col("one.lo").alias("begin"), (F.col("one.hi") + length).alias("end"), F.lit(True).alias("bytes"))

    spoken = stored(passage_rows(keyed, words, PASSAGE_GRAM), "passages")
    said, asked_w = _shared(spoken.withColumn("n", F.lit(1)), "n", F.struct("row_key", "lo", "begin", "end"))
    drop_stored(spoken)
    said = said.select("row_key", "begin", "end", "lo")
    asked_w = asked_w.select("kh", "one.row_key", "one.lo", F.lit(0).alias("hi"), F.lit(0).alias("at"), "open", F.lit(0).cast("bigint").alias("ranges"), "one.begin", "one.end", F.lit(False).alias("bytes"))

    # the bytes of both kinds, by one join with the texts
    raw = F.substring(F.col("text").cast("binary"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    both = keyed.join(asked.unionByName(asked_w), "row_key").select("kh", "row_key", "lo", "hi", "at", "open", "ranges", "bytes", raw.alias("raw"))
    fragments = stored(both.dropDuplicates(["bytes", "kh", "row_key", "lo"]), "fragments")
    cut = fragments.filter("bytes")
    found = own.unionByName(whole).unionByName(decide(cut.filter(F.col("ranges") <= hot), length))
    crowded = cut.filter(F.col("ranges") > hot)
    if not crowded.isEmpty():
        found = found.unionByName(decide_hot(crowded, length))

    windows = stored(passage_windows(fragments.filter("not bytes").select("row_key", "lo", "open", "raw"), words), "passage-windows")
    again = stored(windows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1), "repeated-windows")
    single = spread_join(windows.filter("open"), again.select("h"), ["h"], again, ["row_key", "lo"]).select("row_key", "lo", F.lit(0).alias("begin"), F.lit(0).alias("end"))
    return found, single.unionByName(said)


def _shared(marks: DataFrame, n: str, one: Column) -> tuple[DataFrame, DataFrame]:
    """(marks whose range occurs twice; one row for each kind of range of owners with ranges that occur once).

    A common owner or range may hold any share of the marks: counts are combined before they are shuffled, and
    joins with the marks deal such keys over many tasks."""
    owners = stored(marks.groupBy("kh").agg(F.sum(n).alias("total"), F.count(F.lit(1)).alias("rows")).filter(F.col("total") > 1), "owners")
    near = stored(spread_join(marks, owners.select("kh"), ["kh"], owners, ["row_key", "lo"]), "shared-anchors")
    kinds = stored(near.groupBy("kh", "uh").agg(F.sum(n).alias("same"), F.count(F.lit(1)).alias("rows"), F.min(one).alias("one")), "ranges")
    twice = kinds.filter(F.col("same") > 1)
    whole = spread_join(near, twice.select("kh", "uh"), ["kh", "uh"], twice, ["row_key", "lo"])
    ranges = stored(kinds.groupBy("kh").agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("same") == 1).cast("int")).alias("unsure")).filter((F.col("unsure") > 0) & (F.col("rows") > 1)), "open-owners")
    asked = spread_join(kinds.drop("rows"), ranges.select("kh", F.col("rows").alias("ranges")), ["kh"], ranges, ["uh"], "inner")
    return whole, asked.select("kh", "one", (F.col("same") == 1).alias("open"), "ranges")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeat_words (and ``kept``, the bytes left) of every row.

    n_repeat_words are the words of passages of ``words`` words that start elsewhere too, whatever their bytes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), text).alias("row_key"), text.alias("text"))
    found, said = repeated_ranges(keyed.select("row_key", "text"), length, gram, hot, words)
    # sets: a repeated row has its ranges once
    one = found.select("row_key", F.struct("lo", "hi").alias("cut"), F.lit(None).cast("struct<lo:int,begin:int,end:int>").alias("said"))
    two = said.select("row_key", F.lit(None).cast("struct<lo:int,hi:int>").alias("cut"), F.struct("lo", "begin", "end").alias("said"))
    ranges = one.unionByName(two).groupBy("row_key").agg(F.collect_set("cut").alias("ranges"), F.collect_set("said").alias("said"))
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def repeat_words(raw: np.ndarray, said: list[dict]) -> int:
        """Words under the windows: single ones by their first word, whole runs by their bytes."""
        start, end, _ = word_spans(raw, np.array([0, len(raw)]), ~SPACE[raw])
        change = np.zeros(len(start) + words + 1, np.int64)
        for r in said:
            stop = r["lo"] + words if r["end"] == 0 else int(np.searchsorted(end, r["end"], "right"))
            change[r["lo"]] += 1
            change[stop] -= 1
        return int((np.cumsum(change)[: len(start)] > 0).sum())

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column("text"))
        rows: list[tuple] = []
        for i, (found, said) in enumerate(zip(part.column("ranges").to_pylist(), part.column("said").to_pylist())):
            raw = data[offsets[i] : offsets[i + 1]]
            change = np.zeros(len(raw) + 1, np.int64)
            for r in found or ():
                change[r["lo"]] += 1
                change[r["hi"] + length] -= 1
            gone = np.cumsum(change)[:-1] > 0
            kept = raw[~gone].tobytes()
            rows.append((len(raw), int(gone.sum()), len(runs(gone)[0]), repeat_words(raw, said) if said else 0, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows))
        arrays = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_repeat_words", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(columns[5], pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, n_repeat_words bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return map_slices(keyed.join(ranges, "row_key", "left").select("doc_id", "text", "ranges", "said"), "text", step, schema)
