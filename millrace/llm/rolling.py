"""Rabin-Karp hashes of every fixed-length window of code points, in numpy.

``window_runs`` hashes each window of ``span`` code points of each text and
returns them run-length packed. Inside a window the ``gram``-long sub-window
with the smallest hash (the leftmost of equals) is its anchor; neighbouring
windows mostly share one anchor, so a *run* is a maximal series of consecutive
windows with the same anchor. A run depends only on the characters it spans:
two texts sharing a stretch of at least ``span`` code points share a window,
hence an anchor hash, and inside the stretch they share whole runs. No window
is dropped; a run with n windows stands for n hashes. Text with a short period
repeats one run over and over; such runs in a row are one, with how many times.

Hashes are polynomials modulo 2**64 with an odd base over mixed code points.
Prefix sums give the hash of any stretch in O(1).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bits of a packed minimum that hold the position inside a batch.
POS_BITS = 22
_LIMIT = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high bits depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pow(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = U(1)
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n; grown by doubling and kept."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = _powers[0] = (_pow(BASE, size), _pow(pow(BASE, -1, 1 << 64), size))
    return have


class Hasher:
    """Prefix hashes of one array of code points."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U)
        values = mix(points.astype(U) + U(0x51ED270B7F4A7C15))
        np.cumsum(values * up[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all windows of a length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours by block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def _batches(texts: list[str], span: int):
    """Joins short texts and cuts long ones; yields (points, text number, offset, first start, starts) arrays."""
    held: list[str] = []
    numbers: list[int] = []
    size = 0

    def flush():
        lengths = np.array([len(t) for t in held], np.int64)
        ends = np.cumsum(lengths)
        return code_points("".join(held)), np.array(numbers, np.int64), np.zeros(len(held), np.int64), ends - lengths, ends

    for i, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        if len(text) > _LIMIT:
            for at in range(0, len(text) - span + 1, _LIMIT):
                piece = text[at : at + _LIMIT + span - 1]
                yield code_points(piece), np.array([i]), np.array([at]), np.array([0]), np.array([len(piece)])
            continue
        if held and size + len(text) > _LIMIT // 2:
            yield flush()
            held, numbers, size = [], [], 0
        held.append(text)
        numbers.append(i)
        size += len(text)
    if held:
        yield flush()


def window_runs(texts: list[str], span: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of the texts: ``text`` (position in the list), ``anchor``, ``content``
    (64-bit hashes), ``start`` (code point of the first window), ``windows``
    (how many), ``times`` (how often the run repeats, each time ``windows`` further on) and
    ``again`` (the text has had this anchor before). Null texts and texts shorter than
    ``span`` have none."""
    parts = []
    width = span - gram + 1
    mask = U((1 << POS_BITS) - 1)
    for points, number, offset, first, end in _batches(texts, span):
        hasher = Hasher(points)
        grams = hasher.every(gram)
        best = sliding_min((grams & ~mask) | np.arange(len(grams), dtype=U), width)
        where = (best & mask).astype(np.int64)
        # windows that lie inside one text
        owner = np.repeat(np.arange(len(first)), end - first)[: len(where)]
        whole = np.arange(len(where)) + span <= end[owner]
        new = np.empty(len(where), bool)
        new[0] = True
        np.not_equal(where[1:], where[:-1], out=new[1:])
        new[1:] |= owner[1:] != owner[:-1]
        # a window that crosses a border ends the run before it
        starts = np.flatnonzero(new & whole)
        marks = np.flatnonzero(new | ~whole)
        after = np.append(marks, len(where))[np.searchsorted(marks, starts, side="right")]
        anchor = where[starts]
        content = hasher.at(starts, after + span - 1)
        content = mix(content + (anchor - starts).astype(U) * U(BASE))
        whose, windows = owner[starts], after - starts
        fresh = np.ones(len(starts), bool)
        fresh[1:] = (content[1:] != content[:-1]) | (windows[1:] != windows[:-1]) | (whose[1:] != whose[:-1]) | (starts[1:] != after[:-1]) | (grams[anchor[1:]] != grams[anchor[:-1]])
        at = np.flatnonzero(fresh)
        whose = whose[at]
        parts.append((number[whose], grams[anchor[at]], content[at], starts[at] - first[whose] + offset[whose], windows[at], np.diff(at, append=len(starts))))
    names = ("text", "anchor", "content", "start", "windows", "times")
    if not parts:
        return dict(zip((*names, "again"), (np.zeros(0, t) for t in (np.int64, U, U, np.int64, np.int64, np.int64, bool))))
    out = {n: np.concatenate(x) for n, x in zip(names, zip(*parts))}
    order = np.lexsort((out["anchor"], out["text"]))
    same = (out["anchor"][order][1:] == out["anchor"][order][:-1]) & (out["text"][order][1:] == out["text"][order][:-1])
    out["again"] = np.zeros(len(order), bool)
    out["again"][order[1:]] = same
    return out
