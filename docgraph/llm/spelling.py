"""Spelling variants: pairs of vocabulary words one edit apart, by composing finite-state machines.

The pairs are what the composition of the vocabulary's minimal acceptor, a transducer that makes exactly one edit, and
the acceptor again accepts. It is enumerated per initial state, the states being the halves of words: a pair whose edit
lies in the second half of its shorter word has read the same first half, and starts from the acceptor's state behind
it; a pair whose edit lies in the first half shares the second, a state of the acceptor of reversed words.
A word belongs to three such states at most, and a pair is accepted at exactly one of them. The words of a state go to one
task, are made a minimal acceptor there, and the composition walks it: both sides in the same state before the edit,
and after it in two states whose common right language is enumerated (and remembered, as a minimal acceptor
meets the same two states again). Words are named by their rank, which the acceptor's counts give along a path.

A state of more than ``STATE_WORDS`` words is split by the halves of what its words have not yet read, until none is
left; so no task holds more words of a state, whatever prefix the vocabulary shares. Each task sums its pairs by
word before the shuffle: rows stay within three for each word, however many neighbours it has.

Defined cases: a null text has no words; a null id is an empty string before the colon; repeated rows count again; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import slices, small_batches, stored

#: A word has so many code points and occurrences at least; a form has so many times its variant's occurrences.
MIN_LENGTH = 6
MIN_COUNT = 5
TIMES = 5
#: A run is altered where this divides its hash.
ALTER = 199
#: Words of a state up to which one task enumerates it; two letters make no more than 8,191 of the 90 there are.
STATE_WORDS = 10_000
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: The contract's letters.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_STEP = re.compile("([PS])([0-9]+):")


def altered_runs(doc_id: str, text: str, alter: int = ALTER) -> Counter:
    """Occurrences of the runs of a text, lower-cased and, where the hash of id and run says so, less one letter."""
    head = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for word, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
        h = zlib.crc32(word.encode(), head)
        if h % alter == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, alter: int = ALTER) -> DataFrame:
    """word, n: all words of ``min_length`` code points and ``min_count`` occurrences at least."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    small_batches(docs.sparkSession)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for word, n in altered_runs(doc_id, text, alter).items():
                        if len(word) >= min_length:
                            counts[word] += n
                if len(counts) > COUNTED:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return slim.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """The states one step further: each row (word, n, state, a, b; code points a to b are unread) under each half that
    a pair of it may share. ``state`` spells out the steps: P or S, the number of letters, a colon, the letters."""
    unread = F.col("b") - F.col("a")
    half = [F.greatest(F.floor((unread - k) / 2), F.lit(0)).cast("int") for k in (0, 1)]
    rest = [F.greatest(unread - k, F.lit(0)).cast("int") - half[k] for k in (0, 1)]

    def front(m: Column) -> Column:
        state = F.concat("state", F.lit("P"), m.cast("string"), F.lit(":"), F.substring(F.col("word"), F.col("a") + 1, m))
        return F.struct(state.alias("state"), (F.col("a") + m).alias("a"), F.col("b").alias("b"))

    def back(m: Column) -> Column:
        state = F.concat("state", F.lit("S"), m.cast("string"), F.lit(":"), F.substring(F.col("word"), F.col("b") - m + 1, m))
        return F.struct(state.alias("state"), F.col("a").alias("a"), (F.col("b") - m).alias("b"))

    steps = F.array_distinct(F.array(*[front(m) for m in half], *[back(m) for m in rest]))
    return rows.select("word", "n", F.explode(steps).alias("step")).select("word", "n", "step.state", "step.a", "step.b")


def initial_states(vocab: DataFrame, most: int = STATE_WORDS) -> DataFrame:
    """word, n, state, a, b with at most ``most`` words a state, but for those whose words differ in two letters only."""
    length = F.length("word").cast("int")
    rows = stored(_halves(vocab.select("word", "n", F.lit("").alias("state"), F.lit(0).alias("a"), length.alias("b"))), "spelling-states")
    while True:
        sizes = rows.groupBy("state").agg(F.count(F.lit(1)).alias("words"), F.max(F.col("b") - F.col("a")).alias("unread"))
        large = stored(sizes.filter((F.col("words") > most) & (F.col("unread") > 2)).select("state"), "spelling-large")
        if large.isEmpty():
            return rows
        rows = stored(rows.join(large, "state", "left_anti").unionByName(_halves(rows.join(large, "state", "left_semi"))), "spelling-states")


class Acceptor:
    """The minimal acceptor of sorted different strings. ``arcs[q]`` lists (letter, state, words skipped) in order."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[list[tuple[str, int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        self.forks: list[bool] = []
        self.known: dict[tuple, int] = {}
        open_arcs: list[list] = [[]]
        ends, before = [False], ""
        for word in words:
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            self._close(open_arcs, ends, same)
            for letter in word[same:]:
                open_arcs[-1].append((letter, -1))
                open_arcs.append([])
                ends.append(False)
            ends[-1] = True
            before = word
        self._close(open_arcs, ends, 0)
        self.initial = self._state(ends[0], open_arcs[0])

    def _close(self, open_arcs: list[list], ends: list[bool], depth: int) -> None:
        while len(ends) - 1 > depth:
            state = self._state(ends.pop(), open_arcs.pop())
            open_arcs[-1][-1] = (open_arcs[-1][-1][0], state)

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.arcs)
            skipped, listed = int(final), []
            for letter, to in arcs:
                listed.append((letter, to, skipped))
                skipped += self.words[to]
            self.arcs.append(listed)
            self.final.append(final)
            self.words.append(skipped)
            # an edit can only be made below a state that has a choice
            self.forks.append(len(arcs) + final > 1 or any(self.forks[to] for _, to in arcs))
        return state

    def common(self, s: int, t: int, barred: str = "") -> list[tuple[int, int]]:
        """The common right language of two states as ranks below each; ``barred`` may not be its first letter."""
        out = [(0, 0)] if self.final[s] and self.final[t] else []
        stack = [(s, t, 0, 0, barred)]
        while stack:
            s, t, i, j, barred = stack.pop()
            other = {letter: (to, k) for letter, to, k in self.arcs[t]}
            for letter, to, k in self.arcs[s]:
                if letter != barred and letter in other:
                    to2, k2 = other[letter]
                    if self.final[to] and self.final[to2]:
                        out.append((i + k, j + k2))
                    stack.append((to, to2, i + k, j + k2, ""))
        return out

    def one_edit(self) -> Iterator[tuple[int, int, int]]:
        """(rank, rank, letters before the edit) of each pair of words one edit apart, once; an inserted letter counts
        as the last of a run of its kind."""
        met: dict[tuple[int, int, str], list[tuple[int, int]]] = {}
        stack = [(self.initial, 0, 0)]
        while stack:
            q, rank, depth = stack.pop()
            arcs = self.arcs[q]
            if len(arcs) + self.final[q] > 1:
                pairs = [(q, to, 0, k, letter) for letter, to, k in arcs]
                pairs += [(x[1], y[1], x[2], y[2], "") for x, y in itertools.combinations(arcs, 2)]
                for s, t, i, j, barred in pairs:
                    key = (s, t, barred)
                    ranks = met.get(key)
                    if ranks is None:
                        ranks = met[key] = self.common(s, t, barred)
                    for x, y in ranks:
                        yield rank + i + x, rank + j + y, depth
            stack += [(to, rank + k, depth + 1) for _, to, k in arcs if self.forks[to]]


def _accepted_here(steps: list[tuple[str, int]], first: int, second: int, same: int) -> bool:
    """Whether a pair of words of these lengths, with ``same`` letters before the edit, takes these steps."""
    read = 0
    for kind, letters in steps:
        unread = min(first, second) - read
        half = unread // 2
        if same - read >= half:
            if (kind, letters) != ("P", half):
                return False
            read += half
        else:
            if (kind, letters) != ("S", unread - half):
                return False
            first, second = first - letters, second - letters
    return True


def _steps(state: str) -> list[tuple[str, int]]:
    out, at = [], 0
    while at < len(state):
        step = _STEP.match(state, at)
        out.append((step[1], int(step[2])))
        at = step.end() + int(step[2])
    return out


def _enumerate(state: str, group: list[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, neighbours here, n of the best, the best) of the words of a state that have neighbours."""
    steps = _steps(state)
    group.sort(key=lambda r: r[0][r[2] : r[3]])
    near: dict[int, list] = {}
    for x, y, depth in Acceptor([w[a:b] for w, _, a, b in group]).one_edit():
        one, two = group[x], group[y]
        if not _accepted_here(steps, len(one[0]), len(two[0]), one[2] + depth):
            continue
        for me, other in ((x, two), (y, one)):
            seen = near.get(me)
            rank = (-other[1], other[0])
            if seen is None:
                near[me] = [1, rank]
            else:
                seen[0] += 1
                seen[1] = min(seen[1], rank)
    for i, (count, (n, word)) in near.items():
        yield group[i][0], count, -n, word


def near_words(vocab: DataFrame, most: int = STATE_WORDS) -> DataFrame:
    """word, n_near, near_n, near: the words of ``vocab`` (word, n; each word once) that have others one edit away, how
    many, and of those the most frequent (the smallest of equals)."""
    rows = initial_states(vocab, most)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "near_n", "near"])

        flat = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("state", "word", "n", "a", "b"))))
        for state, group in itertools.groupby(flat, key=lambda r: r[0]):
            members = [r[1:] for r in group]
            if len(members) > 1:
                out.extend(_enumerate(state, members))
            if len(out) > 10_000:
                yield batch_of()
                out.clear()
        if out:
            yield batch_of()

    dealt = rows.repartition("state").sortWithinPartitions("state")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    found = dealt.mapInArrow(walk, "word string, n_near bigint, near_n bigint, near string").groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): forms followed to the last, each round doubling the steps. Forms are more
    frequent than their words by a factor, so chains are short and end."""
    at = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = at.alias("x").join(at.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        at = stored(further.select("x.word", F.coalesce("y.root", "x.root").alias("root"), F.col("y.word").isNotNull().alias("moved")), "spelling-roots")
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, alter: int = ALTER, most: int = STATE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary.

    The form is the most frequent near word (the smallest of equals) if it has ``times`` the word's occurrences, else
    null; the root is where following forms ends.
    """
    vocab = stored(vocabulary(docs, id_col, text_col, min_length, min_count, alter), "spelling-vocabulary")
    near = near_words(vocab, most)
    is_form = F.col("near_n") >= times * F.col("n")
    joined = vocab.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    joined = stored(joined, "spelling-forms")
    roots = _roots(joined.filter("form is not null").select("word", "form"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
