"""Periodic runs of words: found with a suffix automaton and link-cut access, then collapsed to one period.

A run is a stretch of words with smallest period q that no neighbouring word extends, of at least
``min_words`` words and ``exponent`` periods. For the words of a candidate stretch a suffix automaton is built; its
link tree is kept in preferred paths (splay trees), each coloured with the place where its strings ended last.
Appending word t accesses the tree at the state of the prefix of t words: every path segment met on the way
to the root says that the last h words also ended d words earlier, h being the longest string of the segment, and
with d <= h the last h + d words have period d and no word before extends it. The access recolours the path with t.
Segments of one start and period are one run, which ends where the last of them does. An access meets
O(log n) segments on average, so a stretch of n words takes O(n log n) steps whatever it repeats.

Candidate stretches: a run of period q repeats each of its windows of ``min_words - min_words // exponent`` words
within q words, so words outside such windows are in no run. Windows are compared by hash, which can only add
candidates; runs are found on the words themselves.

Each row is treated by itself, without a shuffle. Defined cases: a null text has no words, no runs and an empty
collapsed text; repeated rows and null ids give a row each; an empty table gives an empty result. Memory is
proportional to a slice of texts, or to one text where it is longer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import SPACE, Hasher, map_slices, mix, text_bytes, word_spans

#: Smallest run: so many words, and so many periods.
MIN_WORDS = 24
EXPONENT = 3

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, prefix states) of the suffix automaton; state 1 is the initial one, 0 stands for none."""
    length, link, arcs, prefixes = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for i, c in enumerate(words):
        new = len(length)
        length.append(i + 1)
        arcs.append({})
        link.append(1)
        p = last
        while p and c not in arcs[p]:
            arcs[p][c] = new
            p = link[p]
        if p:
            q = arcs[p][c]
            if length[p] + 1 != length[q]:
                clone = len(length)
                length.append(length[p] + 1)
                arcs.append(arcs[q].copy())
                link.append(link[q])
                link[q] = clone
                while p and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
                q = clone
            link[new] = q
        prefixes.append(new)
        last = new
    return length, link, prefixes


class PreferredPaths:
    """A fixed tree in preferred paths, each a splay tree by depth; ``up`` leads from its root to the path above."""

    def __init__(self, parents: list[int]) -> None:
        self.up = parents
        self.left = [0] * len(parents)
        self.right = [0] * len(parents)
        self.colour = [0] * len(parents)

    def splay(self, x: int) -> None:
        """Makes x the root of its path's splay tree; the path's colour is kept at the root."""
        up, left, right = self.up, self.left, self.right
        path_root = x
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                turns = (p, x)
            elif inner:
                turns = (x, x)
            else:
                turns = (x,)
            for y in turns:
                above = up[y]
                top = up[above]
                if left[above] == y:
                    moved = right[y]
                    left[above] = moved
                    right[y] = above
                else:
                    moved = left[y]
                    right[above] = moved
                    left[y] = above
                if moved:
                    up[moved] = above
                up[above] = y
                up[y] = top
                if top:
                    if left[top] == above:
                        left[top] = y
                    elif right[top] == above:
                        right[top] = y
            if not inner:
                path_root = p
                break
            path_root = g
        if path_root != x:
            self.colour[x] = self.colour[path_root]

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Recolours the path from the root to ``node``; (old colour, deepest node) of each segment, lowest first."""
        up, right, colours = self.up, self.right, self.colour
        met, below, x = [], 0, node
        while x:
            self.splay(x)
            old = colours[x]
            if old:
                met.append((old, x))
            cut = right[x]
            if cut:
                colours[cut] = old
            right[x] = below
            below = x
            x = up[x]
        colours[below] = colour
        return met


def runs_of(words: Sequence[int], min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    length, link, prefixes = _automaton(words)
    paths = PreferredPaths([0 if p == 1 else p for p in link])
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefixes):
        end = i + 1
        for before, node in paths.access(state, end):
            period, same = end - before, length[node]
            if period <= same and same + period >= max(min_words, exponent * period):
                found[end - same - period, period] = same + period
    return sorted((start, size, period) for (start, period), size in found.items())


def _stretches(key: np.ndarray, first: np.ndarray, width: int, n: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words under windows (``key`` of the one from word ``first``) that recur
    within a part ``1 / exponent`` of their stretch. ``key`` tells documents apart."""
    order = np.argsort(key, kind="stable")
    near = key[order][1:] == key[order][:-1]
    a, b = first[order][:-1][near], first[order][1:][near]
    while True:
        edge = np.zeros(n + 1, np.int64)
        for at in (a, b):
            edge += np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1)
        inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).view(np.int8), [0]])
        start, end = np.nonzero(np.diff(inside) == 1)[0], np.nonzero(np.diff(inside) == -1)[0]
        if not len(a):
            return start, end
        of = np.searchsorted(start, a, "right") - 1
        fits = (b < end[of]) & ((b - a) * exponent <= end[of] - start[of])
        if fits.all():
            return start, end
        a, b = a[fits], b[fits]


def _find(part: pa.RecordBatch, min_words: int, exponent: int) -> pa.RecordBatch:
    data, offsets = text_bytes(part.column("text"))
    raw, n = data.tobytes(), len(offsets) - 1
    start, end, doc = word_spans(data, offsets, ~SPACE[data])
    first_word = np.searchsorted(doc, np.arange(n + 1))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    width = max(1, min_words - min_words // exponent)
    if len(start) >= width:
        at = np.nonzero(doc[width - 1 :] == doc[: len(doc) - width + 1])[0]
        windows = Hasher(Hasher(data).ranges(start, end)).ranges(at, at + width)
        salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
        for a, b in zip(*(x.tolist() for x in _stretches(windows ^ salt[doc[at]], at, width, len(start), exponent))):
            cuts = np.searchsorted(first_word, [a, b - 1], "right") - 1
            for d in range(int(cuts[0]), int(cuts[1]) + 1):  # stretches of neighbouring documents may touch
                x, y = max(a, int(first_word[d])), min(b, int(first_word[d + 1]))
                if y - x < min_words:
                    continue
                ids: dict[bytes, int] = {}
                words = [ids.setdefault(raw[s:e], len(ids)) for s, e in zip(start[x:y].tolist(), end[x:y].tolist())]
                base = x - int(first_word[d])
                runs[d] += [(base + s, size, period) for s, size, period in runs_of(words, min_words, exponent)]
    texts = []
    for d in range(n):
        words = raw[offsets[d] : offsets[d + 1]].split()
        if runs[d]:
            drop = np.zeros(len(words) + 1, np.int64)
            for s, size, period in runs[d]:
                drop[s + period] += 1
                drop[s + size] -= 1
            words = [w for w, k in zip(words, np.cumsum(drop).tolist()) if not k]
        texts.append(b" ".join(words))
    listed = pa.array([[{"start": s, "length": size, "period": p} for s, size, p in r] for r in runs], pa.list_(RUN))
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(np.diff(first_word), pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and collapsed: the words that no run
    contains behind its first period, joined by one space. One row for each row of ``docs``."""
    if exponent < 2 or min_words < exponent:
        raise ValueError("a run has at least two periods and a word for each")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return map_slices(slim, "text", lambda part: _find(part, min_words, exponent), schema)
