"""Encoding of a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation works without regex on whole batches. Code points map to class
numbers; each class is a transition function of a small automaton, the functions
are closed under composition (a monoid of some dozens of elements) and an
inclusive scan over the composition table, doubling the distance each round,
gives the state after every code point. The scan stops as soon as all composed
functions are constant. States and neighbouring classes mark the slices, which
look up their ids in a cache; a slice not seen yet is merged pair by pair in rank
order. Byte offsets of the tokens can be kept for decoding.

Defined results: null and empty text give the empty list; strings of special
tokens in a text are ordinary text; an unpaired surrogate counts as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.rolling import mix
from millrace.session import spread

DEFAULT_FOLDER = "/opt/tokenizers"
#: White_Space of Unicode. Fixed values.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Classes of code points; the letters of contractions have their own.
OTHER, LETTER, DIGIT, SPACE, WHITE, QUOTE, ONE, TWO_E, TWO_L, E_, L_, EDGE = range(12)
#: States: what the current slice is.
BEGIN, IN_L, IN_N, IN_O, AFTER_SP, AFTER_W, Q, Q_E, Q_L, DONE = range(10)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    table = np.zeros(0x110001, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        table[c] = LETTER if kind == "L" else DIGIT if kind == "N" else OTHER
    for c in _SPACES:
        table[ord(c)] = WHITE
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    # endings of contractions: 's 't 'm 'd, 're 've, 'll
    for c in "stmd":
        table[ord(c)] = ONE
    for c in "rv":
        table[ord(c)] = TWO_E
    table[ord("l")], table[ord("e")] = L_, E_
    table[0x110000] = EDGE
    return table


def _step(state: int, cls: int) -> int:
    if cls == EDGE:
        return BEGIN
    if cls == SPACE:
        return AFTER_SP
    if cls == WHITE:
        return AFTER_W
    if cls == DIGIT:
        return IN_N
    if cls == QUOTE:
        # only at the start of a slice can an apostrophe open a contraction
        return IN_O if state in (IN_O, AFTER_SP, Q) else Q
    if cls == OTHER:
        return IN_O
    if state == Q:
        return DONE if cls == ONE else Q_E if cls == TWO_E else Q_L if cls == L_ else IN_L
    if state == Q_E:
        return DONE if cls == E_ else IN_L
    if state == Q_L:
        return DONE if cls == L_ else IN_L
    return IN_L


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class; composition table (first, second); state each element
    reaches from BEGIN; whether it is constant."""
    base = [tuple(_step(s, c) for s in range(10)) for c in range(12)]
    known = {f: i for i, f in enumerate(dict.fromkeys(base))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in base:
            if (h := tuple(g[s] for s in f)) not in known:
                known[h] = len(known)
                todo.append(h)
    both = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], np.uint8)
    assert len(known) < 256
    return np.array([known[f] for f in base], np.uint8), both, np.array([f[BEGIN] for f in known], np.uint8), np.array([len(set(f)) == 1 for f in known])


def states(cls: np.ndarray) -> np.ndarray:
    """State after each code point by a scan with composed transition functions."""
    of_class, both, reached, constant = monoid()
    scan, reach = of_class[cls], 1
    while reach < len(scan) and not constant[scan].all():
        scan = np.concatenate([scan[:reach], both[scan[:-reach], scan[reach:]]])
        reach *= 2
    return reached[scan]


def slice_starts(points: np.ndarray) -> np.ndarray:
    """Starts of all slices of code points in which 0x110000 separates texts; the
    separators are slices of their own. Ends with the length."""
    cls = classes()[points]
    state = states(cls)
    kind = np.array([1, 1, 2, 3, 4, 4, 3, 1, 1, 1], np.uint8)  # BEGIN unused; Q counts as symbol
    group = kind[state]
    group[cls == EDGE] = 5
    start = np.empty(len(points) + 1, bool)
    start[0] = start[-1] = True
    np.not_equal(group[1:], group[:-1], out=start[1:-1])
    start[:-1] |= group == 5
    white = group == 4
    solid = np.append(~white & (group != 5), False)
    # the last blank of a run before a solid character leaves the run; a plain space joins that character
    last = white & solid[1:]
    start[:-1] |= last
    joins = np.flatnonzero(last & (cls == SPACE)) + 1
    start[joins] = False
    # a finished contraction is one slice, whatever letters follow
    done = np.flatnonzero(state == DONE)
    length = np.where(state[done - 1] == Q, 2, 3) if len(done) else done
    start[done - length + 2] = False
    start[done + 1] = True
    return np.flatnonzero(start)


class Vocabulary:
    """Ranks of byte strings and a cache of merged slices, bounded by ``most`` entries.

    Slices of up to seven bytes are known by their bytes and length packed into one
    integer, and a direct-mapped table finds them for a whole batch at once; the others,
    and those whose place in the table another holds, are looked up one by one."""

    _BITS = 18

    def __init__(self, path: str, most: int = 1 << 19):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {i: p for p, i in self.ranks.items()}
        self.octets = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # all pairs of entries that together are an entry, sorted
        ranks = self.ranks
        joins = sorted((a << 32 | b, i) for p, i in ranks.items() for k in range(1, len(p)) if (a := ranks.get(p[:k])) is not None and (b := ranks.get(p[k:])) is not None)
        self.pairs, self.joined = np.array([k for k, _ in joins], np.int64), np.array([i for _, i in joins], np.int64)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.flat, self.first = array("i"), array("q", [0])
        self.keys, self.held = np.zeros(1 << self._BITS, np.uint64), np.zeros(1 << self._BITS, np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.joined[at], _NONE)

    def merge(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many slices, (slice number, id) in order: in each round every slice joins its
        neighbouring pair of lowest rank, the leftmost of equals, until no slice has one."""
        lengths = np.fromiter(map(len, slices), np.int64, len(slices))
        ids = self.octets[np.frombuffer(b"".join(slices), np.uint8)]
        owner = np.repeat(np.arange(len(slices)), lengths)
        done = []
        ranks = np.full(len(ids), _NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inner] = self._pair_ranks(ids[inner], ids[inner + 1])
        while len(ids):
            start = np.flatnonzero(np.diff(owner, prepend=-1))
            low = np.minimum.reduceat(ranks, start)
            low = np.repeat(low, np.diff(start, append=len(ids)))
            if (ended := low == _NONE).any():
                done.append((owner[ended], ids[ended]))
                going = ~ended
                ids, owner, ranks, low = ids[going], owner[going], ranks[going], low[going]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == low)
            at = at[np.diff(owner[at], prepend=-1) != 0]
            ids[at] = ranks[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, ranks = ids[keep], owner[keep], ranks[keep]
            at -= np.arange(len(at))
            # the joined entry has a new pair on either side
            for left in (at, at - 1):
                inside = (left >= 0) & (left + 1 < len(ids))
                left = left[inside]
                pair = owner[left] == owner[left + 1]
                ranks[left[~pair]] = _NONE
                ranks[left[pair]] = self._pair_ranks(ids[left[pair]], ids[left[pair] + 1])
            ranks[-1] = _NONE
        if not done:
            return owner, ids
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return owner[order], ids[order]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one slice with a heap and a linked list: O(n log n) for any length."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j < 0 or j >= n or end[j] != stop:  # one of the two has changed since
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _learn(self, slices: list[bytes]) -> None:
        """Merge slices that aren't in the cache and keep them."""
        parts = []
        whole = [(k, i) for k, p in enumerate(slices) if (i := self.ranks.get(p)) is not None]
        parts.append((np.array([k for k, _ in whole], np.int64), np.array([i for _, i in whole], np.int64)))
        rest = np.array([k for k, p in enumerate(slices) if p not in self.ranks and len(p) <= _SHORT], np.int64)
        if len(rest):
            number, ids = self.merge([slices[k] for k in rest])
            parts.append((rest[number], ids))
        for k, p in enumerate(slices):
            if len(p) > _SHORT and p not in self.ranks:
                ids = np.array(self._merge_long(p), np.int64)
                parts.append((np.full(len(ids), k), ids))
        owner, ids = (np.concatenate(x) for x in zip(*parts))
        ids = ids[np.argsort(owner, kind="stable")].astype(np.int32)
        ends = len(self.flat) + np.cumsum(np.bincount(owner, minlength=len(slices)))
        base = len(self.first) - 1
        self.flat.frombytes(ids.tobytes())
        self.first.frombytes(ends.astype(np.int64).tobytes())
        self.cache.update(zip(slices, range(base, base + len(slices))))

    def _numbers(self, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Cache numbers of all slices, given by byte ranges."""
        octets = np.frombuffer(data + bytes(8), np.uint8)
        length = end - start
        keys = np.minimum(length, 8).astype(np.uint64) << np.uint64(56)
        for i in range(7):
            keys |= np.where(length > i, octets[start + i], 0).astype(np.uint64) << np.uint64(8 * i)
        slot = (mix(keys) >> np.uint64(64 - self._BITS)).astype(np.int64)
        numbers = self.held[slot]
        rest = np.flatnonzero((self.keys[slot] != keys) | (length > 7))
        slices = [data[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())]
        if new := [p for p in dict.fromkeys(slices) if p not in self.cache]:
            self._learn(new)
        numbers[rest] = np.fromiter(map(self.cache.__getitem__, slices), np.int64, len(rest))
        # of several slices with one place in the table one wins; equal keys have equal numbers
        short = rest[length[rest] <= 7]
        self.keys[slot[short]] = keys[short]
        won = short[self.keys[slot[short]] == keys[short]]
        self.held[slot[won]] = numbers[won]
        return numbers

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (with the end)."""
        if len(self.cache) > self.most:
            self.forget()
        texts = [_LONE.sub("\ufffd", t) if t else "" for t in texts]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        # U+0000 holds the places of the separators in the joined text
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        widths = np.ones(len(points) + 1, np.int64)
        widths[0] = 0
        wide = np.flatnonzero(points > 0x7F)
        widths[wide + 1] += 1 + (points[wide] > 0x7FF) + (points[wide] > 0xFFFF)
        octet = np.cumsum(widths)
        points[ends - 1] = 0x110000
        starts = slice_starts(points)
        edges = np.searchsorted(starts, ends - 1)  # slice number of each separator
        bounds = octet[starts]
        numbers = self._numbers(joined.encode("utf-8"), bounds[:-1], bounds[1:])
        # views, gone before the cache grows again
        first, flat = np.frombuffer(self.first, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32)
        count = first[numbers + 1] - first[numbers]
        count[edges] = 0
        total = np.concatenate([[0], np.cumsum(count)])
        # ragged gather: position inside the slice plus the slice's place in the cache
        ids = flat[np.repeat(first[numbers] - total[:-1], count) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total[edges]])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.pieces[i] for i in ids)

    def widths(self) -> np.ndarray:
        out = np.zeros(max(self.pieces) + 1, np.int32)
        for i, p in self.pieces.items():
            out[i] = len(p)
        return out


@lru_cache(maxsize=2)
def kept_vocabulary(path: str) -> Vocabulary:
    """One per Python worker, so later tasks find its cache filled."""
    return Vocabulary(path)


_NONE = np.int64(1 << 40)
#: Longer slices are merged one by one.
_SHORT = 64
_LONE = re.compile("[\ud800-\udfff]")


#: Longer texts are encoded piece by piece.
LONG = 1 << 22
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str, size: int) -> Iterator[str]:
    """A long text cut before single blanks between solid characters, where slices begin
    whatever stands around; pieces are longer than ``size`` only where there is no such place."""
    lo = 0
    while len(text) - lo > size and (cut := _CUT.search(text, lo + size)):
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


def _chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held > size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = DEFAULT_FOLDER, offsets: bool = False) -> DataFrame:
    """(doc_id, ids ARRAY<INT>), one row per row of the table; with ``offsets`` also
    ``ends`` ARRAY<INT>, the exclusive byte offset in the UTF-8 text of each token.
    A narrow map (small inputs are spread over all cores); each Python worker reads the vocabulary once from ``folder``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = kept_vocabulary(f"{folder}/{vocabulary}")
        widths = vocab.widths() if offsets else None
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                if any(t and len(t) > LONG for t in texts[lo:hi]):
                    parts = [[vocab.encode([p])[0] for p in pieces(t or "", LONG // 4)] for t in texts[lo:hi]]
                    ids = np.concatenate([x for part in parts for x in part])
                    at = np.cumsum([0, *(sum(map(len, part)) for part in parts)])
                else:
                    ids, at = vocab.encode(texts[lo:hi])
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                if offsets:
                    ends = np.cumsum(widths[ids], dtype=np.int64)
                    before = np.concatenate([[0], ends])[at[:-1]]
                    lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ends - np.repeat(before, np.diff(at)), pa.int32())))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *lists], names=["doc_id", "ids", "ends"][: 1 + len(lists)])

    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(docs).mapInArrow(work, "doc_id BIGINT, ids ARRAY<INT>" + ", ends ARRAY<INT>" * offsets)
