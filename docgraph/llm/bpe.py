"""Byte-level BPE as a bounded-lookahead streaming transducer, and the decoder for it.

A string's BPE tokens are the one sequence whose neighbours are all *stable pairs*: two tokens are stable
when merging their joined bytes by the merge list gives the two again. So the last token of every prefix can
be found from left to right: of the tokens that end there, it is the one that is stable behind the last
token of what is left. A token has at most ``lookahead`` bytes (computed from the merge list), so whatever
comes next can only hang on the prefixes of the last ``lookahead`` bytes; tokens on the path that all of
those share are final. The transducer emits them at once and forgets them, which keeps the memory constant
however long the input is.

Texts are cut beforehand as the byte-level pre-tokenizer does (contractions, letters, digits, other signs,
white space). Pieces that a worker meets for the first time pass through the transducer side by side, as arrays
(``Lanes``): one step reads the next byte of thousands of them. Longer pieces pass one by one. Decoding maps ids
to bytes and runs them through an incremental UTF-8 state machine.

Defined cases: a null text counts as empty (no ids); the special token's string in a text becomes its id.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import map_slices

#: Pieces up to this many bytes are remembered with their ids; longer ones are streamed each time.
REMEMBERED_BYTES = 64
#: Remembered pieces of a worker in each of two generations; when the young one is full it becomes the old.
MEMORY = 300_000
#: Ids that the decoder feeds to its state machine at a time.
DECODE_IDS = 4096
#: Characters of a text up to which its pieces are listed at once; a longer one gives them one by one.
LISTED = 1 << 16
#: Bytes after which a long piece's final tokens are emitted.
EMIT_EVERY = 256
#: Pieces that pass through the transducer side by side, and the bytes that one of them may have.
LANES = 1 << 15
LANE_BYTES = 64
#: The characters of the Unicode property White_Space, and the pre-tokenizer's pattern.
_WHITE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WHITE}\\p{{L}}\\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Table:
    """A fixed dictionary from different int64 keys to int32 values for whole arrays: a perfect hash by displaced buckets.

    Each bucket has the first displacement that puts its keys into free slots; the slots hold the keys, so a key
    that is not in the dictionary is told from all that are.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(6, (2 * len(keys)).bit_length())
        self.to_bucket, self.to_slot = np.uint64(64 - bits + 3), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        self.shift = np.zeros(1 << (bits - 3), np.uint64)
        x, todo, turn = keys.astype(np.uint64) * _ODD[0], np.arange(len(keys)), 0
        owner = np.zeros(1 << bits, np.int64)
        while len(todo):
            turn += 1
            shift = np.uint64(turn * int(_ODD[1]) % (1 << 64))
            bucket = x[todo] >> self.to_bucket
            slot = ((x[todo] ^ shift) * _ODD[2]) >> self.to_slot
            owner[slot] = todo
            clash = np.zeros(len(self.shift), bool)
            clash[bucket[(owner[slot] != todo) | (self.keys[slot] >= 0)]] = True
            fits = ~clash[bucket]
            self.shift[bucket[fits]] = shift
            self.keys[slot[fits]], self.values[slot[fits]] = keys[todo[fits]], values[todo[fits]]
            todo = todo[~fits]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 for other keys."""
        x = keys.astype(np.uint64) * _ODD[0]
        slot = ((x ^ self.shift[x >> self.to_bucket]) * _ODD[2]) >> self.to_slot
        return np.where(self.keys[slot] == keys, self.values[slot], np.int32(-1))


_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)


class Lanes:
    """The transducer's step for many short pieces at a time: the last token of the next prefix of each.

    A pair of tokens is found to be stable without merging its bytes: the merges inside of both are undone, latest
    first, and no two parts that meet at the boundary meanwhile may have a merge that comes before the one just undone
    (of equal ones the left one is made first). That holds for merge lists that make each token by one rule,
    after its parts (``suits``).
    """

    def __init__(self, ids: dict[bytes, int], rank: dict[tuple[bytes, bytes], int]) -> None:
        size = max(ids.values(), default=-1) + 1
        #: Each token's merge (-1: a byte), its parts and its length; ``size`` stands for the start of a piece.
        self.start, self.order = size, np.full(size + 1, -1, np.int32)
        self.left, self.right, self.length = np.zeros(size + 1, np.int32), np.zeros(size + 1, np.int32), np.zeros(size + 1, np.int32)
        for token, i in ids.items():
            self.length[i] = len(token)
        rules = np.array([(ids[a], ids[b], ids[a + b], r) for (a, b), r in rank.items()], np.int64).reshape(-1, 4)
        a, b, made, r = rules.T
        self.left[made], self.right[made], self.order[made] = a, b, r
        self.ranks = Table(a * (size + 1) + b, r.astype(np.int32))
        whole = self.stable(a, b, inside=True)
        known = {i for token, i in ids.items() if len(token) == 1}
        for x, y, i, ok in zip(a.tolist(), b.tolist(), made.tolist(), whole.tolist()):
            if ok and x in known and y in known:
                known.add(i)
        # the tokens, read backwards from their ends
        nodes: dict[int, int] = {}
        token_at = [-1]
        for token, i in ids.items():
            if i in known and len(token) <= LANE_BYTES:
                node = 0
                for byte in reversed(token):
                    below = nodes.get(node << 8 | byte)
                    if below is None:
                        below = nodes[node << 8 | byte] = len(token_at)
                        token_at.append(-1)
                    node = below
                token_at[node] = i
        self.nodes, self.token_at = Table(np.fromiter(nodes.keys(), np.int64), np.fromiter(nodes.values(), np.int32)), np.array(token_at, np.int32)

    @staticmethod
    def suits(ids: dict[bytes, int], rank: dict[tuple[bytes, bytes], int]) -> bool:
        made: dict[bytes, int] = {}
        for (a, b), r in sorted(rank.items(), key=lambda item: item[1]):
            if a + b in made or a + b not in ids or not all(len(t) == 1 and t in ids or t in made for t in (a, b)):
                return False
            made[a + b] = r
        return all(bytes([b]) in ids for b in range(256))

    def stable(self, a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        """Whether each two tokens stay apart; ``inside`` leaves out the merge of the two themselves."""
        out = np.ones(len(a), bool)
        at = np.nonzero(a != self.start)[0]
        u, v = a[at].astype(np.int64), b[at].astype(np.int64)
        limit = np.full(len(at), np.iinfo(np.int32).max, np.int32)
        while len(at):
            if not inside:
                r = self.ranks.get(u * (self.start + 1) + v)
                bad = (r >= 0) & (r < limit)
                out[at[bad]] = False
            else:
                bad, inside = np.zeros(len(at), bool), False
            first, second = self.order[u], self.order[v]
            on = np.nonzero(~bad & ((first >= 0) | (second >= 0)))[0]
            at, u, v, first, second = at[on], u[on], v[on], first[on], second[on]
            later = first > second
            limit = np.where(later, first, second + 1)
            u, v = np.where(later, self.right[u], u), np.where(later, v, self.left[v])
        return out

    def run(self, raws: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(sizes + 1) - 1  # each piece has a place for its start before its bytes
        data = np.frombuffer(b"\0" + b"\0".join(raws), np.uint8)
        step = np.arange(len(data)) - np.repeat(ends - sizes, sizes + 1)
        # all tokens that end at each byte
        end = np.nonzero(step)[0]
        node, n, found = np.zeros(len(end), np.int64), 0, []
        while len(end):
            node = self.nodes.get(node << 8 | data[end - n]).astype(np.int64)
            n += 1
            token = self.token_at[node]
            hit = np.nonzero((node >= 0) & (token >= 0))[0]
            found.append((end[hit], token[hit]))
            on = np.nonzero((node >= 0) & (step[end] > n))[0]
            end, node = end[on], node[on]
        end, token = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        by = np.argsort(step[end].astype(np.uint8), kind="stable")
        end, token = end[by], token[by]
        cuts = np.searchsorted(step[end], np.arange(1, int(sizes.max(initial=0)) + 2))
        # byte by byte: of the tokens that end there, the stable one
        last = np.full(len(data), self.start, np.int32)
        for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
            e, t = end[x:y], token[x:y]
            ok = self.stable(last[e - self.length[t]], t)
            last[e[ok]] = t[ok]
        # the path back from each piece's end
        lane, place, back = np.nonzero(sizes)[0], ends[sizes > 0], []
        while len(lane):
            t = last[place]
            if (t == self.start).any():
                raise ValueError("the merge list has no token for a byte")
            back.append((lane, t))
            place = place - self.length[t]
            on = step[place] > 0
            lane, place = lane[on], place[on]
        lane, token = (np.concatenate(c) for c in zip(*back[::-1])) if back else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        token = token[np.argsort(lane, kind="stable")].tolist()
        stops = np.cumsum(np.bincount(lane, minlength=len(raws))).tolist()
        return [token[x:y] for x, y in zip([0, *stops], stops)]


class Bpe:
    """Vocabulary and merge list, and the transducer over them."""

    def __init__(self, description: str) -> None:
        model = json.loads(description)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        spell = {token: bytes(letters[c] for c in token) for token in model["model"]["vocab"]}
        self.rank = {(spell[a], spell[b]): r for r, (a, b) in enumerate(pairs)}
        #: Bytes that a later token can reach back: the sufficient lookahead of this merge list.
        self.lookahead = max(map(len, self.ids))
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        # token lengths, longest first, by the last bytes (three, or all of a shorter beginning)
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            ends.setdefault(token[-3:], set()).add(len(token))
        for tail in [t for t in ends if len(t) == 3] + [t for t in ends if len(t) == 2]:
            ends[tail] |= ({2} if tail[-2:] in self.ids else set()) | {1}
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.lanes = Lanes(self.ids, self.rank) if Lanes.suits(self.ids, self.rank) else None

    def merged(self, raw: bytes) -> list[bytes]:
        """The tokens of a short byte string by the merge list itself."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        rank = self.rank
        while len(parts) > 1:
            best, at = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == pair[0] and parts[i + 1] == pair[1]:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def is_stable(self, left: bytes, right: bytes) -> bool:
        got = self.stable.get((left, right))
        if got is None:
            if len(self.stable) >= 4 * MEMORY:
                self.stable.clear()
            whole = [left, right] if left else [right]
            got = self.stable[left, right] = self.merged(left + right) == whole
        return got

    def transduce(self, raw: bytes) -> Iterator[bytes]:
        """The tokens of one piece, each emitted as soon as no further byte can change it.

        ``last[k]`` is the last token of the first ``done + k`` bytes; what ends at ``done`` is final.
        """
        done, last = 0, [b""]
        for end in range(1, len(raw) + 1):
            last.append(self._token(raw, end, done, last))
            if len(last) > EMIT_EVERY + self.lookahead and end % EMIT_EVERY == 0:
                final = self._common(last)
                yield from self._path(last, final)
                last = last[final:]
                done += final
        yield from self._path(last, len(last) - 1)

    def _token(self, raw: bytes, end: int, done: int, last: list[bytes]) -> bytes:
        lengths, ids, stable = self.lengths, self.ids, self.stable
        tail = raw[max(done, end - 3) : end]
        for n in lengths.get(tail) or lengths.get(tail[-2:]) or (1,):
            if n <= end - done:
                token = raw[end - n : end]
                if token in ids:
                    pair = (last[end - n - done], token)
                    found = stable.get(pair)
                    if found is None:
                        found = self.is_stable(*pair)
                    if found:
                        return token
        raise ValueError("the merge list has no token for a byte")

    def _common(self, last: list[bytes]) -> int:
        """The end of the longest token path that every prefix within the lookahead shares."""
        live = set(range(max(0, len(last) - self.lookahead), len(last)))
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(top - len(last[top]))
        return live.pop()

    @staticmethod
    def _path(last: list[bytes], end: int) -> list[bytes]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _remember(self, piece: str, ids: list[int]) -> tuple[str, int, bytes]:
        got = ",".join(map(str, ids)), len(ids), b"".join([self.bytes[i] for i in ids])
        if len(piece) <= REMEMBERED_BYTES:
            if len(self.pieces) >= MEMORY:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = got
        return got

    def piece(self, piece: str) -> tuple[str, int, bytes]:
        """(ids joined by commas, number of ids, bytes that the ids decode to) of a piece."""
        if piece in self.special:
            return str(self.special[piece]), 1, self.bytes[self.special[piece]]
        return self.older.get(piece) or self._remember(piece, [self.ids[t] for t in self.transduce(piece.encode())])

    def learn(self, pieces: Iterable[str]) -> None:
        """Passes the short pieces that are not remembered through the transducer side by side."""
        new = []
        for piece in set(pieces).difference(self.pieces, self.special):
            if got := self.older.get(piece):
                self.pieces[piece] = got
            elif len(piece) <= REMEMBERED_BYTES and len(raw := piece.encode()) <= LANE_BYTES and self.lanes:
                new.append((piece, raw))
        for k in range(0, len(new), LANES):
            part = new[k : k + LANES]
            for (piece, _), ids in zip(part, self.lanes.run([raw for _, raw in part])):
                self._remember(piece, ids)

    def cut(self, text: str) -> Iterator[list[str]]:
        """The text's pieces and special strings in lists: one for each stretch between special strings, of a long one one for each ``DECODE_IDS`` pieces."""
        for part in self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]:
            if part in self.special:
                yield [part]
            elif len(part) <= LISTED:
                yield _PIECE.findall(part)
            else:
                found = (m[0] for m in _PIECE.finditer(part))
                while some := list(islice(found, DECODE_IDS)):
                    yield some

    def chunks(self, texts: list[str]) -> Iterator[Iterator[list[tuple[str, int, bytes]]]]:
        """For each text the lists of its pieces' results. Texts of up to ``LISTED`` characters learn new pieces together, longer ones list by list."""
        lists = [list(self.cut(t)) if len(t) <= LISTED else None for t in texts]
        self.learn(chain.from_iterable(chain.from_iterable(filter(None, lists))))
        for text, cut in zip(texts, lists):
            yield self._results(text, cut)

    def _results(self, text: str, cut: list[list[str]] | None) -> Iterator[list[tuple[str, int, bytes]]]:
        for found in self.cut(text) if cut is None else cut:
            if cut is None:
                self.learn(found)
            get, piece = self.pieces.get, self.piece
            if got := [get(p) or piece(p) for p in found]:
                yield got

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.fromstring(",".join([g[0] for got in lists for g in got]), np.int32, sep=",") for lists in self.chunks([t or "" for t in texts])]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """Ids to text through the incremental byte-to-text state machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        todo, out = iter(ids), []
        while part := b"".join([self.bytes[i] for i in islice(todo, DECODE_IDS)]):
            out.append(machine.decode(part))
        return "".join([*out, machine.decode(b"", True)])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text) of each text, fed as pieces come."""
        out = []
        for lists in self.chunks(texts):
            n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
            machine = codecs.getincrementaldecoder("utf-8")("replace")
            for got in lists:
                ids, counts, raws = zip(*got)
                ids_sha.update(("," if n else "").encode() + ",".join(ids).encode())
                text_sha.update(machine.decode(b"".join(raws)).encode())
                n += sum(counts)
            text_sha.update(machine.decode(b"", True).encode())
            out.append((n, ids_sha.hexdigest(), text_sha.hexdigest()))
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        return self.digests([text])[0]


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> str:
    """The tokenizer's description, read on the driver (a fixed vocabulary file of a few MB)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def loaded(name: str, description: str) -> Bpe:
    """One instance a worker process, so that what it remembers lasts over tasks."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Bpe(description)
    return _loaded[name]


def token_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer(path))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path, sent.value)
        n, ids, text = zip(*bpe.digests(part.column("text").to_pylist()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(slim, "text", step, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all but the text if None), ids array<int>, n_tokens, and decoded_sha256 of the ids' text."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer(path))
    own = ("ids", "n_tokens", "decoded_sha256")  # columns of these names give way
    fields = [f for f in docs.schema.fields if (f.name in keep if keep is not None else f.name != text_col) and f.name.lower() not in own]
    names = [f.name for f in fields]

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = loaded(path, sent.value)
        ids = bpe.encode_all(part.column(text_col).to_pylist())
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
        shas = [hashlib.sha256(bpe.decode(i.tolist()).encode()).hexdigest() for i in ids]
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(shas, pa.string())], names=[*names, "ids", "n_tokens", "decoded_sha256"])

    return map_slices(docs, text_col, step, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>, n_tokens bigint, decoded_sha256 string"]))


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """``tokens`` with the decoded text of the ids in a string column ``to``; null ids give a null text."""
    sent = tokens.sparkSession.sparkContext.broadcast(tokenizer(path))
    names = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields] + [f"`{to}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = loaded(path, sent.value)
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return tokens.mapInArrow(run, names)
