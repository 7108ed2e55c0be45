"""Exact byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can end its encoding. A suffix automaton of the
vocabulary reads the piece once; at each byte its suffix links list the tokens that end there, longest first.
A token fits if the last token of the prefix before it may stand on its left: undoing the merges of both
from the latest backwards, no pair that met at their border would have merged earlier. The token that fits
is stored for the prefix, and back-pointers from the end give the ids.

Everything runs on arrays: the pieces of a few megabytes of text are found with byte classes, distinct ones
are packed into machine words, and the pieces not met before advance together, one byte at a time. The
vocabulary's tables are built on the driver from the tokenizer's file (their size is bound by the vocabulary,
whatever the corpus) and broadcast; texts are scanned once and never shuffled.

Defined results: a null text encodes as the empty text (no ids, empty decoding); special tokens inside a text
become their ids, as the library does by default; null or repeated ids are passed through, one row out for
every row in; very long texts are encoded whole, and a piece without a border takes a step for each byte; ties do not
arise, since one token fits each prefix; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dyadspark.llm._common import ranges, steps

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE, _LETTERS, _DIGITS, _OTHER = 0, 1, 2, 3
#: Pieces up to this many bytes are packed into words and encoded together; longer ones go one by one.
_PACKED = 32


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def character_classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTERS, r"\p{L}+"), (_DIGITS, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


class IntTable:
    """Immutable map from non-negative 64-bit keys to 32-bit values, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several keys for a slot the last one stays
            won = self.keys[slot] == keys
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MULT >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 for absent ones."""
        slot = self._slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        again = np.flatnonzero((found != keys) & (found != -1))
        while len(again):
            slot[again] = (slot[again] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[again]]
            hit = found == keys[again]
            out[again[hit]] = self.values[slot[again[hit]]]
            again = again[~hit & (found != -1)]
        return out


def suffix_automaton(words: list[bytes]) -> tuple[list[dict], list[int], list[int], list[int]]:
    """``(transitions, links, lengths, state of each word)`` of the automaton of all substrings of the words."""
    step: list[dict] = [{}]
    link, length, ends = [-1], [0], []

    def state(n: int, moves: dict, to: int) -> int:
        step.append(moves)
        length.append(n)
        link.append(to)
        return len(step) - 1

    def split(p: int, c: int, q: int) -> int:
        clone = state(length[p] + 1, dict(step[q]), link[q])
        link[q] = clone
        while p != -1 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    for word in words:
        last = 0
        for c in word:
            q = step[last].get(c)
            if q is not None:  # another word has brought this string already
                last = q if length[q] == length[last] + 1 else split(last, c, q)
                continue
            new = state(length[last] + 1, {}, 0)
            p = last
            while p != -1 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p != -1:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
            last = new
        ends.append(last)
    return step, link, length, ends


class Codec:
    """Tables of one tokenizer file, and encoding and decoding of byte arrays with them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space")
        to_byte = {c: b for b, c in enumerate(byte_characters())}
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        names: list[bytes] = [b""] * size
        usable = {}
        for text, i in vocab.items():
            if text.encode() not in self.special:
                names[i] = bytes(to_byte[c] for c in text)
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for m, (a, b) in enumerate(merges):
            i = vocab[a + b]
            if self.rank[i] < 0 and len(a + b) > 1:
                self.rank[i], self.left[i], self.right[i] = m, vocab[a], vocab[b]
        usable = [i for i in range(size) if names[i] and (len(names[i]) == 1 or self.rank[i] >= 0)]
        self.size = size
        self.pairs = IntTable(np.array([vocab[a] * size + vocab[b] for a, b in merges]), np.arange(len(merges)))
        step, link, length, ends = suffix_automaton([names[i] for i in usable])
        keys = np.fromiter((s << 8 | c for s, moves in enumerate(step) for c in moves), np.int64)
        self.moves = IntTable(keys, np.fromiter((q for moves in step for q in moves.values()), np.int64))
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.token = np.full(len(step), -1, np.int32)
        self.token[ends] = usable
        # nearest state on the suffix links, itself included, whose longest string is a token
        self.top = np.zeros(len(step), np.int32)
        for s in np.argsort(self.length, kind="stable")[1:]:
            self.top[s] = s if self.token[s] >= 0 else self.top[self.link[s]]
        for text, i in self.special.items():
            names[i] = text
        self.names, self.name_at = _arena(names)
        self.digits, self.digits_at = _arena([b"%d," % i for i in range(size)])
        self.classes = character_classes()
        self.find_special = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "ids", "fits")}

    # -- pieces ---------------------------------------------------------------------------------------------

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|spaces before a space|spaces``."""
        n = len(data)
        kind = self.classes[:256][data]  # right for ASCII; the others follow
        inner = data & 0xC0 == 0x80
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = [data[np.minimum(lead + j, n - 1)].astype(np.int64) for j in range(4)]
            two, three = b[0] < 0xE0, b[0] < 0xF0
            code = np.where(two, (b[0] & 31) << 6 | b[1] & 63, np.where(three, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63))
            own = self.classes[np.minimum(code, 0x10FFFF)]
            kind[lead] = own
            for j, more in ((1, np.ones(len(lead), bool)), (2, ~two), (3, ~three)):
                at = lead[more] + j
                ok = at < n
                kind[at[ok]] = own[more][ok]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        marked = self._special_places(data, offsets)
        for a, b in marked:
            edge[a] = edge[b] = True
        begins = edge[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        before = np.zeros(n, np.uint8)  # the byte before, 0 at an edge
        before[1:] = data[:-1]
        before[edge[:n]] = 0
        starts = begins & (space | (before != 0x20))
        # the last white space before something else begins a piece
        after = np.flatnonzero(begins & ~space & ~edge[:n])
        after = after[space[after - 1]] - 1
        for _ in range(3):
            after -= inner[after]
        starts[after] = True
        quote = np.flatnonzero((data == 0x27) & starts & begins)
        if len(quote):
            quote = quote[(quote + 1 < n)]
            quote = quote[~edge[quote + 1]]
            c1 = data[quote + 1]
            c2 = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], data[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(c1, list(b"stmd"))
            two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            size = np.where(one, 2, np.where(two, 3, 0))
            quote, size = quote[size > 0], size[size > 0]
            starts[quote + 1] = False
            rest = quote + size
            rest = rest[rest < n]
            starts[rest] = True  # a piece begins after a contraction, unless a space before it already began one
            glued = rest[(before[rest] == 0x20)]
            starts[glued] = False
        for a, b in marked:
            starts[a + 1 : b] = False
        return np.flatnonzero(starts)

    def _special_places(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        if not self.special:
            return []
        raw = data.tobytes()
        if not self.find_special.search(raw):
            return []
        return [(m.start() + int(a), m.end() + int(a)) for a, b in zip(offsets[:-1], offsets[1:], strict=True) for m in self.find_special.finditer(raw[a:b])]

    # -- encoding -------------------------------------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token ``b`` may follow token ``a``."""
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(at):
            m = self.pairs.get(a * self.size + b).astype(np.int64)
            bad = (m >= 0) & (2 * m < limit)
            out[at[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            a, b, at, ra, rb = a[go], b[go], at[go], ra[go], rb[go]
            undo = ra > rb  # of equal merges the right one came later
            limit = np.where(undo, 2 * ra, 2 * rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`compatible` behind a direct-mapped memory of pairs."""
        keys, vals = self.__dict__.setdefault("fits", (np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)))
        key = a * self.size + b
        slot = (key.astype(np.uint64) * _MULT >> np.uint64(46)).astype(np.int64)
        out = vals[slot]
        miss = np.flatnonzero(keys[slot] != key)
        if len(miss):
            out[miss] = self.compatible(a[miss], b[miss])
            keys[slot[miss]], vals[slot[miss]] = key[miss], out[miss]
            clash = miss[keys[slot[miss]] != key[miss]]  # two new pairs in one slot: forget the slot
            keys[slot[clash]] = -1
        return out

    def encode_pieces(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of the pieces, all advancing together by one byte."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        n, most = len(sizes), int(sizes[0]) if len(sizes) else 0
        last = np.full((most + 1, n), -1, np.int64)
        state, match = np.zeros(n, np.int64), np.zeros(n, np.int64)
        active = n - np.searchsorted(sizes[::-1], np.arange(most), side="right")
        for j in range(most):
            k = int(active[j])
            c = text[starts[:k] + j].astype(np.int64)
            s, l = state[:k], match[:k]
            to = self.moves.get(s << 8 | c)
            lost = np.flatnonzero(to < 0)
            while len(lost):
                s[lost] = self.link[s[lost]]
                l[lost] = self.length[s[lost]]
                to[lost] = self.moves.get(s[lost] << 8 | c[lost])
                lost = lost[to[lost] < 0]
            s[:] = to
            l += 1
            tok = self.top[np.where(l == self.length[s], s, self.link[s])]
            open_ = np.arange(k)
            while len(open_):
                v = tok[open_]
                t = self.token[v].astype(np.int64)
                before = j + 1 - self.length[v]
                prev = last[before, open_]
                ok = before == 0
                inside = np.flatnonzero(~ok)
                ok[inside] = self._fits(prev[inside], t[inside])
                last[j + 1, open_[ok]] = t[ok]
                open_ = open_[~ok]
                tok[open_] = self.top[self.link[tok[open_]]]
        at, rows = sizes.copy(), np.arange(n)
        found = []
        width = np.diff(self.name_at)
        while len(rows):
            t = last[at[rows], rows]
            found.append((rows, t))
            at[rows] -= width[t]
            rows = rows[at[rows] > 0]
        piece = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
        ids = np.concatenate([t for _, t in found]) if found else np.zeros(0, np.int64)
        turn = np.repeat(np.arange(len(found)), [len(r) for r, _ in found]) if found else piece
        home = np.lexsort((-turn, order[piece]))
        return ids[home].astype(np.int32), np.bincount(order[piece], minlength=n)

    def encode(self, data: np.ndarray, offsets: np.ndarray, remember: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of whole texts."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts = self.pieces(data, offsets)
        sizes = np.diff(np.append(starts, len(data)))
        entry = self._entries(data, starts, sizes, remember)
        pool, at, many = self.ids
        ids = pool[ranges(at[entry], many[entry])]
        ends = np.concatenate([[0], np.cumsum(many[entry])])
        return ids, ends[np.searchsorted(starts, offsets)]

    def _entries(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, remember: int) -> np.ndarray:
        """The place in the memory of encoded pieces of each piece; new ones are encoded first."""
        known: dict[bytes, int] = self.__dict__.setdefault("known", {})
        if len(known) > remember or "ids" not in self.__dict__:
            known.clear()
            self.ids = (np.fromiter(self.special.values(), np.int32, len(self.special)), np.arange(len(self.special)), np.ones(len(self.special), np.int64))
            known.update({x: i for i, x in enumerate(self.special)})
        first, kind = _distinct_pieces(data, starts, sizes)
        raw = data.tobytes()
        a, b = starts[first].tolist(), (starts + sizes)[first].tolist()
        names = [raw[i:j] for i, j in zip(a, b, strict=True)]
        entry = np.fromiter((known.get(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(entry < 0)
        if len(new):
            # each name once: distinct pieces may meet again by the same bytes only if they are long
            fresh = dict.fromkeys(names[i] for i in new)
            text = np.frombuffer(b"".join(fresh), np.uint8)
            width = np.fromiter(map(len, fresh), np.int64, len(fresh))
            at = np.concatenate([[0], np.cumsum(width)[:-1]])
            ids, counts = self._encode_new(text, at, width)
            pool, old_at, old_many = self.ids
            self.ids = (np.concatenate([pool, ids]), np.concatenate([old_at, len(pool) + np.concatenate([[0], np.cumsum(counts)[:-1]])]), np.concatenate([old_many, counts]))
            known.update(zip(fresh, range(len(old_at), len(old_at) + len(fresh)), strict=True))
            entry[new] = np.fromiter((known[names[i]] for i in new), np.int64, len(new))
        return entry[kind]

    def _encode_new(self, text: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Short pieces together; long ones in groups of like length, so that the table of prefixes stays small."""
        order = np.argsort(width, kind="stable")
        counts = np.zeros(len(width), np.int64)
        parts, a = [], 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * (int(width[order[b]]) + 1) <= 4_000_000:
                b = min(len(order), b + max(1, (b - a) // 8))
            rows = np.sort(order[a:b])
            ids, n = self.encode_pieces(text, at[rows], width[rows])
            counts[rows] = n
            parts.append((rows, ids, n))
            a = b
        out = np.zeros(int(counts.sum()), np.int32)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        for rows, ids, n in parts:
            out[ranges(begin[rows], n)] = ids
        return out, counts

    # -- decoding -------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes, offsets)`` of the texts that the ids spell."""
        return _spell(self.names, self.name_at, ids, offsets)

    def spelled_ids(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Decimal ids joined by commas."""
        text, at = _spell(self.digits, self.digits_at, ids, offsets)
        raw, at = text.tobytes(), at.tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def _arena(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])


def _spell(text: np.ndarray, at: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = np.diff(at)[ids]
    return text[ranges(at[ids], width)], np.concatenate([[0], np.cumsum(width)])[offsets]


def _distinct_pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, kind)``: one piece of each kind, and the kind of every piece; equal short pieces share a kind."""
    key = np.concatenate([data, np.zeros(_PACKED, np.uint8)]).astype(np.uint64)
    width = 1
    while width < 8:
        key = key[:-width] << np.uint64(8 * width) | key[width:]
        width *= 2
    mask = np.array([0] + [(1 << 64) - (1 << 8 * (8 - j)) for j in range(1, 9)], np.uint64)
    words = []
    mixed = sizes.astype(np.uint64)
    for j in range(0, _PACKED, 8):
        some = np.flatnonzero(sizes > j)
        w = np.zeros(len(starts), np.uint64)
        w[some] = key[starts[some] + j] & mask[np.minimum(sizes[some] - j, 8)]
        words.append(w)
        mixed = (mixed ^ w) * _MULT
        mixed ^= mixed >> np.uint64(32)
    long = np.flatnonzero(sizes > _PACKED)
    mixed[long] = np.arange(len(long), dtype=np.uint64)  # never taken for equal
    first, kind = _first_of(mixed)
    same = sizes == sizes[first][kind]
    for w in words:
        same &= w == w[first][kind]
    odd = np.flatnonzero(~same)  # two kinds with one hash: each such piece for itself
    kind[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), kind


def _first_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    kind = np.empty(len(values), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


def apply(docs: DataFrame, codec: Codec, make: Callable, schema: str) -> DataFrame:
    """``make(part, codec, ids, offsets)`` for batches of ``docs``, a record batch each, of the given schema."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        own = shared.value
        for part, data, offsets in steps(batches):
            yield make(part, own, *own.encode(data, offsets))

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row, with the byte-level BPE file at ``path``."""
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def make(part, codec, ids, at):
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    return apply(given, Codec(path), make, f"doc_id {kind}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; bytes that are not UTF-8 become U+FFFD, null ids an empty text."""
    given = encoded.select("doc_id", "ids")
    kind = given.schema["doc_id"].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(path))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at = np.concatenate([[0], np.cumsum(np.diff(np.asarray(lists.offsets)))])
            data, ends = shared.value.decode(lists.flatten().to_numpy().astype(np.int64), at)
            raw = data.tobytes()
            text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return given.mapInArrow(run, f"doc_id {kind}, text string")
