"""Evaluation texts leaking into training text, by spaced-seed hashing.

Words are the maximal runs of ``a-z0-9`` after lower-casing ASCII letters. Each
13-word window of the held-out items is hashed under fixed masks that ignore
some positions; any ``subs`` positions are ignored together by one of the masks, so a
window with so many substituted words still meets the item's, and an unchanged window
meets under all masks. Training windows are hashed the same way and joined with the
item hashes, and hits are verified word by word along their diagonals: the longest
exact overlap and the longest overlap with at most ``subs`` substituted words.

Repeated words can't blow up a document's work: hits of one seed whose surroundings (as
far as an item with that seed reaches) are equal word for word are one hit, so text with
a short period is verified once a period, and items with equal words are matched once.
Texts longer than ``LONG`` are taken in pieces that overlap by twice the longest item.

The items are the stated query set. Up to ``block`` items of ``block_chars`` characters
in all go to every executor, and the corpus is scanned once without a shuffle. A larger
set never goes to the driver: a bit filter of its seeds (``_BITS`` bits at most) lets
through the seeds of the corpus, which meet the items' by a shuffle join; the documents
that met an item are then verified with up to ``_AT_ONCE`` of their items at a time.

Defined results: null, empty and wordless texts and items of fewer than 13 words
match nothing; repeated documents are each reported; items with equal text are
each reported; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.rolling import Hasher, U, mix
from millrace.session import spread, written

WORDS = 13
#: Positions fall into so many classes by their remainder; each mask ignores ``subs`` of them.
_CLASSES = {0: 1, 1: 3, 2: 4, 3: 6}
_FILTER_BITS = 22
_BITS = 28
_SEGMENT = 1 << 21
#: Pairs of places, and words compared, that are held at once.
_PAIRS = 1 << 18
_CELLS = 1 << 18
_AT_ONCE = 100
#: Longer texts are matched piece by piece.
LONG = 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = True
_WORD = re.compile(rb"[a-z0-9]+")
_FOUND = "doc_id BIGINT, item_id BIGINT, exact_words INT, overlap_words INT, substituted INT"


@lru_cache
def masks(subs: int) -> tuple[tuple[bool, ...], ...]:
    """Kept positions of each mask; whichever ``subs`` positions differ, one mask ignores all."""
    if subs not in _CLASSES:
        raise ValueError(f"at most {max(_CLASSES)} substituted words can be guaranteed in {WORDS}")
    n = _CLASSES[subs]
    return tuple(tuple(i % n not in ignored for i in range(WORDS)) for ignored in combinations(range(n), subs))


def plain(text: str | None) -> bytes:
    """UTF-8 with ASCII letters lower-cased."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER.tobytes())


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text)


class Words:
    """The words of some lower-cased texts: hashes, owning text, byte range in ``data``."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\0".join(texts) + b"\0"
        points = np.frombuffer(self.data, np.uint8)
        edge = np.diff(_IN_WORD[points].view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(r) + 1 for r in texts), np.int64, len(texts))
        self.text = np.searchsorted(np.cumsum(lengths), self.start, side="right")
        #: First word of each text, and the number of words.
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        # a word's hash doesn't depend on its place, so long data is hashed in segments
        self.hash = np.zeros(len(self.start), U)
        cuts = np.searchsorted(self.start, np.arange(0, len(points), _SEGMENT))
        for a, b in zip(cuts, [*cuts[1:], len(self.start)]):
            if a < b:
                lo = self.start[a]
                self.hash[a:b] = Hasher(points[lo : self.end[b - 1]]).at(self.start[a:b] - lo, self.end[a:b] - lo)

    def seeds(self, subs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By mask: the first words of whole windows and their masked hashes."""
        n = len(self.start) - WORDS + 1
        if n <= 0:
            return
        first = np.flatnonzero(self.text[:n] == self.text[WORDS - 1 :])
        for m, mask in enumerate(masks(subs)):
            total = np.full(n, U(m))
            for i, keep in enumerate(mask):
                if keep:
                    total += self.hash[i : i + n] * U(2 * pow(0x9E3779B1, i + 3, 1 << 62) + 1)
            yield first, mix(total)[first]

    def slice(self, lo: int, hi: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist())]


def overlaps(equal: np.ndarray, subs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a truth table: its longest run, and its longest stretch that starts
    and ends true with at most ``subs`` false inside, with how many it has."""
    n, m = equal.shape
    at = np.broadcast_to(np.arange(m), (n, m))
    # last[:, j + 1]: the last false place up to j, counted from 1; 0 if there is none
    last = np.zeros((n, m + 1), np.int64)
    np.maximum.accumulate(np.where(equal, 0, at + 1), axis=1, out=last[:, 1:])
    exact = (np.where(equal, at + 1 - last[:, 1:], 0)).max(axis=1, initial=0)
    # the stretch that ends at j begins behind the false place number subs + 1 before it, at the next true place
    begin = last[:, 1:]
    for _ in range(subs):
        begin = np.where(begin > 0, np.take_along_axis(last, np.maximum(begin - 1, 0), axis=1), 0)
    next_true = np.full((n, m + 1), m)
    next_true[:, :m] = np.minimum.accumulate(np.where(equal, at, m)[:, ::-1], axis=1)[:, ::-1]
    start = np.take_along_axis(next_true, begin, axis=1)
    false = np.zeros((n, m + 1), np.int64)
    np.cumsum(~equal, axis=1, out=false[:, 1:])
    used = false[:, 1:] - np.take_along_axis(false, np.minimum(start, m), axis=1)
    score = np.where(equal, (at + 1 - start) * (subs + 1) - used, 0)
    best = score.max(axis=1, initial=0)
    length = -(-best // (subs + 1))
    return exact, length, length * (subs + 1) - best


def _distinct(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    return order[new]


class Matcher:
    """The seeds of some items (id, text), to match texts against."""

    def __init__(self, items: Iterable[tuple[int, str]], subs: int):
        masks(subs)
        self.subs = subs
        owners: dict[bytes, list[int]] = {}
        for i, t in items:
            owners.setdefault(b" ".join(words_of(plain(t))), []).append(i)
        self.owners = list(owners.values())
        self.words = found = Words(list(owners))
        self.length = np.diff(found.first)
        self.longest = int(self.length.max(initial=0))
        parts = [(h, found.text[f], f - found.first[found.text[f]]) for f, h in found.seeds(subs)]
        seed, item, place = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (U, np.int64, np.int64))
        order = np.argsort(seed, kind="stable")
        self.item, self.place = item[order], place[order]
        #: Distinct seeds, where the entries of each begin, and how far an item reaches that has it.
        self.seed, self.begin = np.unique(seed[order], return_index=True)
        self.count = np.diff(self.begin, append=len(order))
        self.reach = np.maximum.reduceat(self.length[self.item], self.begin) if len(order) else self.begin
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.seed >> U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _hits(self, docs: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows of the texts with a seed of the items: first word, number of the seed; of those
        with equal surroundings in one text the first."""
        places, seeds = [], []
        for first, h in docs.seeds(self.subs):
            hit = np.flatnonzero(self.maybe[(h >> U(64 - _FILTER_BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.seed, h[hit]), len(self.seed) - 1)
            hit, at = (x[self.seed[at] == h[hit]] for x in (hit, at))
            places.append(first[hit])
            seeds.append(at)
        place, seed = np.concatenate(places), np.concatenate(seeds)
        if not len(place):
            return place, seed
        text, reach = docs.text[place], self.reach[seed]
        lo, hi = np.maximum(place - reach, docs.first[text]), np.minimum(place + reach, docs.first[text + 1])
        near = Hasher(docs.hash).at(lo, hi)
        kept = _distinct(text, seed, place - lo, near)
        kept = kept[np.argsort(place[kept], kind="stable")]  # neighbours share diagonals
        return place[kept], seed[kept]

    def _diagonals(self, docs: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, shift): word k of the item lies at word shift + k of the texts."""
        place, seed = self._hits(docs)
        ends = np.cumsum(self.count[seed])
        parts, lo = [], 0
        # a diagonal as one number: item by item of each text, shifts from the longest item's length below 0
        room, items = len(docs.hash) + self.longest + 1, len(self.length)
        while lo < len(place):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + _PAIRS, side="right")))
            n = self.count[seed[lo:hi]]
            entry = np.repeat(self.begin[seed[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(place[lo:hi], n)
            parts.append(np.unique((docs.text[at] * items + self.item[entry]) * room + at - self.place[entry] + self.longest))
            lo = hi
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        pair, shift = np.divmod(np.unique(np.concatenate(parts)), room)
        text, item = np.divmod(pair, items)
        shift -= self.longest
        # diagonals over equal words give equal overlaps
        a, b = np.maximum(shift, docs.first[text]), np.minimum(shift + self.length[item], docs.first[text + 1])
        kept = _distinct(text, item, a - shift, Hasher(docs.hash).at(a, b))
        return text[kept], item[kept], shift[kept]

    def _verified(self, docs: Words, text: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
        """Longest exact run, longest overlap and substitutions along each diagonal."""
        out = np.zeros((3, len(text)), np.int64)
        order = np.argsort(self.length[item], kind="stable")
        lo = 0
        while lo < len(order):
            # rows of nearly equal length share a table
            width = int(self.length[item[order[lo]]])
            widths = self.length[item[order[lo : lo + max(1, _CELLS // max(1, width))]]]
            fits = np.flatnonzero(widths * np.arange(1, len(widths) + 1) > _CELLS)
            hi = lo + max(1, int(fits[0]) if len(fits) else len(widths))
            rows = order[lo:hi]
            width = int(self.length[item[rows[-1]]])
            k = np.arange(width)
            at = shift[rows][:, None] + k
            inside = (at >= docs.first[text[rows]][:, None]) & (at < docs.first[text[rows] + 1][:, None]) & (k < self.length[item[rows]][:, None])
            own = np.minimum(self.words.first[item[rows]][:, None] + k, len(self.words.hash) - 1)
            equal = inside & (docs.hash[np.where(inside, at, 0)] == self.words.hash[own])
            out[:, rows] = overlaps(equal, self.subs)
            lo = hi
        return tuple(out)

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item id, exact, overlap, substituted), the best over the diagonals of each pair
        that overlap by at least 13 words; the longest exact run and the longest tolerant
        overlap may lie on different ones."""
        if not len(self.seed):
            return
        docs = Words(texts)
        if len(docs.hash) < WORDS:
            return
        text, item, shift = self._diagonals(docs)
        if not len(text):
            return
        exact, overlap, used = self._verified(docs, text, item, shift)
        kept = overlap >= WORDS
        text, item, exact, overlap, used = (x[kept] for x in (text, item, exact, overlap, used))
        if not len(text):
            return
        best = overlap * (self.subs + 1) - used
        order = np.lexsort((best, item, text))
        start = np.flatnonzero(np.diff(text[order], prepend=-1) | np.diff(item[order], prepend=-1))
        longest, best = np.maximum.reduceat(exact[order], start), np.maximum.reduceat(best[order], start)
        overlap = -(-best // (self.subs + 1))
        used = overlap * (self.subs + 1) - best
        for n, i, e, o, u in zip(text[order][start].tolist(), item[order][start].tolist(), longest.tolist(), overlap.tolist(), used.tolist()):
            for owner in self.owners[i]:
                yield n, owner, e, o, u

    def long_matches(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(item id, exact, overlap, substituted) of one long text, from pieces that overlap so far
        that every place has the longest item's length around it in one of them."""
        best: dict[int, tuple[int, int, int]] = {}
        lo = cut = 0
        while cut < len(text):
            border = _BORDER.search(text, min(cut + LONG, len(text)))
            cut = border.start() if border else len(text)
            piece = text[lo:cut]
            for _, i, e, o, u in self.matches([piece]):
                have = best.get(i, (0, 0, 0))
                best[i] = (max(e, have[0]), *max((o, u), have[1:], key=lambda x: (x[0], -x[1])))
            starts = Words([piece]).start
            back = 2 * self.longest + WORDS
            lo += int(starts[-back]) if len(starts) > back else 0
        for i, (e, o, u) in best.items():
            yield i, e, o, u


_BORDER = re.compile(rb"[^a-z0-9]")


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a million characters; a long text is alone."""
    lo = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if n > LONG:
            if lo < k:
                yield lo, k
            yield k, k + 1
            lo, size = k + 1, 0
            continue
        size += n
        if size > 1 << 20:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _matched(matcher: Matcher, ids: list[int], texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    for lo, hi in _groups(texts):
        if hi == lo + 1 and len(texts[lo] or "") > LONG:
            yield from ((ids[lo], *x) for x in matcher.long_matches(plain(texts[lo])))
        else:
            yield from ((ids[lo + n], *x) for n, *x in matcher.matches([plain(t) for t in texts[lo:hi]]))


def _frame(rows: Iterable[tuple]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["doc_id", "item_id", "exact_words", "overlap_words", "substituted"])


def _by_scan(corpus: DataFrame, held: list[tuple[int, str]], subs: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(held, subs)
        for b in batches:
            yield _frame(_matched(matcher, b["doc"].tolist(), b["text"].tolist()))

    return corpus.mapInPandas(work, _FOUND)


def _seed_rows(df: DataFrame, subs: int, bits: np.ndarray | None = None) -> DataFrame:
    """(seed, id): the distinct seeds of each text (id, text), with ``bits`` those it may hold."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts = b["id"].to_numpy(), b["text"].tolist()
            for lo, hi in _groups(texts):
                found = Words([plain(t) for t in texts[lo:hi]])
                for first, h in found.seeds(subs):
                    if bits is not None:
                        at = (h >> U(64 - _BITS)).astype(np.int64)
                        hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                        first, h = first[hit], h[hit]
                    kept = _distinct(found.text[first], h)
                    yield pd.DataFrame({"seed": h[kept].view(np.int64), "id": ids[lo + found.text[first[kept]]]})

    return df.mapInPandas(work, "seed BIGINT, id BIGINT")


def _seed_bits(seeds: DataFrame) -> np.ndarray:
    """The filter: a bit per seed, by its high bits. Parts of it are made by tasks; it has
    2**_BITS / 8 bytes however many seeds there are."""
    part = 20  # bits of a part

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << part, bool)
        bits[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    at = F.shiftrightunsigned("seed", 64 - _BITS)
    places = seeds.select(F.shiftright(at, part).alias("part"), at.bitwiseAND(F.lit((1 << part) - 1)).alias("bit")).distinct()
    out = np.zeros(1 << (_BITS - 3), np.uint8)
    size = 1 << (part - 3)
    for r in places.groupBy("part").applyInPandas(fill, "part BIGINT, bits BINARY").toLocalIterator():
        out[r.part * size : (r.part + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _by_join(corpus: DataFrame, items: DataFrame, subs: int) -> DataFrame:
    seeds = written(_seed_rows(items.select(F.col("i").alias("id"), F.col("t").alias("text")), subs), "item_seeds")
    met = _seed_rows(corpus.select(F.col("doc").alias("id"), "text"), subs, _seed_bits(seeds)).withColumnRenamed("id", "doc")
    pairs = written(met.join(seeds.withColumnRenamed("id", "i"), "seed").select("doc", "i").distinct(), "met")
    # a document's items in portions of about _AT_ONCE
    portions = pairs.groupBy("doc").agg(F.ceil(F.count("*") / _AT_ONCE).alias("n"))
    part = pairs.join(portions, "doc").withColumn("part", F.expr("pmod(xxhash64(i), n)")).drop("n")
    held = part.join(items, "i").groupBy("doc", "part").agg(F.collect_list(F.struct("i", "t")).alias("items"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text, own in zip(b["doc"].tolist(), b["text"].tolist(), b["items"].tolist()):
                yield _frame(_matched(Matcher([(x["i"], x["t"]) for x in own], subs), [doc], [text]))

    return corpus.join(held, "doc").select("doc", "text", "items").mapInPandas(work, _FOUND)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", subs: int = 1, block: int = 20_000, block_chars: int = 1 << 25
) -> DataFrame:
    """(doc_id, item_id, exact_words, overlap_words, substituted): pairs with at least 13
    words of overlap with at most ``subs`` (0 to 3) substituted words in it."""
    masks(subs)
    corpus = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    if n <= block and chars <= block_chars:
        return _by_scan(spread(corpus), [(r.i, r.t) for r in rows.collect()], subs)
    return _by_join(spread(corpus), rows, subs)


def leaked_documents(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """(doc_id, item_id): documents with 13 or more consecutive words of an item; the
    rows are distinct even if ids repeat."""
    return find_leaks(docs, items, **names).where(F.col("exact_words") >= WORDS).select("doc_id", "item_id").distinct()
