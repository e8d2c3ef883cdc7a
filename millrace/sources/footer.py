"""Parquet footers: read, adjust and write, without touching encoded pages.

Footers are Thrift structs in the compact protocol. They are held generically as
``{field id: (wire type, value)}``, so fields this module doesn't know survive.
"""

from __future__ import annotations

import struct
from typing import Any

MAGIC = b"PAR1"
# wire types of the compact protocol. Fixed values.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
_INTS = (I16, I32, I64)

Fields = dict[int, tuple[int, Any]]


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def integer(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int) -> Any:
        if kind in _INTS:
            return self.integer()
        if kind == BINARY:
            n = self.varint()
            self.at += n
            return self.data[self.at - n : self.at]
        if kind == STRUCT:
            return self.fields()
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 < 15 else self.varint()
            inner = head & 15
            return inner, [self.value(BYTE if inner in (TRUE, FALSE) else inner) for _ in range(n)]
        if kind == BYTE:
            self.at += 1
            return self.data[self.at - 1]
        if kind == DOUBLE:
            self.at += 8
            return self.data[self.at - 8 : self.at]
        if kind == MAP:
            n = self.varint()
            if not n:
                return 0, 0, []
            kinds = self.data[self.at]
            self.at += 1
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        raise ValueError(f"unknown wire type {kind}")

    def fields(self) -> Fields:
        out: Fields = {}
        last = 0
        while (head := self.data[self.at]) != 0:
            self.at += 1
            last = last + (head >> 4) if head >> 4 else self.integer()
            kind = head & 15
            out[last] = (kind, None if kind in (TRUE, FALSE) else self.value(kind))
        self.at += 1
        return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def list_head(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + _varint(n)


def packed(kind: int, value: Any) -> bytes:
    if kind in _INTS:
        return _varint(value << 1 if value >= 0 else (-value << 1) - 1)
    if kind == BINARY:
        return _varint(len(value)) + value
    if kind == STRUCT:
        return packed_fields(value)
    if kind in (LIST, SET):
        inner, items = value
        return list_head(inner, len(items)) + b"".join(packed(BYTE if inner in (TRUE, FALSE) else inner, x) for x in items)
    if kind == BYTE:
        return bytes([value])
    if kind == DOUBLE:
        return value
    if kind == MAP:
        a, b, items = value
        return _varint(len(items)) + (bytes([a << 4 | b]) + b"".join(packed(a, x) + packed(b, y) for x, y in items) if items else b"")
    raise ValueError(f"unknown wire type {kind}")


def packed_fields(fields: Fields, ready: dict[int, bytes] | None = None) -> bytes:
    """A struct; ``ready`` has the bytes of field values that are packed already."""
    out, last = [], 0
    for i in sorted(fields):
        kind, value = fields[i]
        step = i - last
        out.append(bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + packed(I32, i))
        if kind not in (TRUE, FALSE):
            out.append(ready[i] if ready and i in ready else packed(kind, value))
        last = i
    return b"".join(out) + b"\0"


def read_footer(data: bytes) -> Fields:
    """The file's metadata struct; ``data`` is a whole file or ends like one."""
    if data[-4:] != MAGIC:
        raise ValueError("not a Parquet file, or its footer is encrypted")
    n = struct.unpack("<I", data[-8:-4])[0]
    return Reader(data[-8 - n : -8]).fields()


def column_range(chunk: Fields) -> tuple[int, int]:
    """Start and length of the encoded pages of a column chunk."""
    if 1 in chunk:
        raise ValueError("column data in another file")
    if 3 not in chunk or 8 in chunk or 9 in chunk:
        raise ValueError("encrypted column")
    meta = chunk[3][1]
    start = meta[9][1]
    if 11 in meta and 0 < meta[11][1] < start:
        start = meta[11][1]
    return start, meta[7][1]


def moved_column(chunk: Fields, shift: int) -> Fields:
    """The chunk's metadata after its pages moved by ``shift`` bytes. Page and Bloom
    indexes lie outside the pages and aren't copied, so pointers to them go."""
    meta = {i: f for i, f in chunk[3][1].items() if i not in (14, 15)}
    for i in (9, 10, 11):
        if i in meta and meta[i][1] > 0:
            meta[i] = (I64, meta[i][1] + shift)
    return {2: (I64, 0), 3: (STRUCT, meta)}


# encodings whose pages need the dictionary page of their chunk. Fixed values.
DICTIONARY = {2, 8}


def is_plain(group: Fields) -> bool:
    """Every page of the row group can be read without a dictionary page, so its chunks can go on in
    one chunk with those of another file."""
    metas = [chunk[3][1] for chunk in group[1][1][1]]
    return all(not (11 in m and m[11][1] > 0) and not DICTIONARY & set(m[2][1][1]) for m in metas)


def row_groups(footer: Fields) -> list[Fields]:
    """Those that hold rows; others have no pages to copy."""
    return [g for g in footer[4][1][1] if g[3][1] > 0]


class Joined:
    """A file under way that takes row groups of others as they are encoded.

    Chunks without dictionary pages of successive files are laid one behind the other into
    one chunk, until a row group holds ``group_bytes``; others stay row groups of their
    own. Pages are copied byte for byte either way. One such row group is in memory."""

    def __init__(self, sink: Any, group_bytes: int = 16 << 20):
        self.sink, self.at, self.group_bytes = sink, len(MAGIC), group_bytes
        self.schema = self.base = None
        self.groups: list[bytes] = []
        self.rows = self.blocks = 0
        self._clear()
        sink.write(MAGIC)

    def _clear(self) -> None:
        self.kind: tuple = ()
        self.pages: list[list[bytes]] = []
        self.metas: list[Fields] = []
        self.open_rows = self.open_bytes = self.open_size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Append a file's row groups; its rows and row groups. Raises if its schema differs."""
        footer = read_footer(data)
        schema = packed(*footer[2])
        if self.schema is None:
            self.schema, self.base = schema, footer
        elif schema != self.schema:
            raise ValueError("the schemas differ")
        groups, rows = row_groups(footer), 0
        for group in groups:
            chunks = group[1][1][1]
            places = [column_range(c) for c in chunks]
            if any(start < len(MAGIC) or start + length > len(data) for start, length in places):
                raise ValueError("column pages outside the file")
            pages = [data[start : start + length] for start, length in places]
            if is_plain(group):
                self._merge(group, [c[3][1] for c in chunks], pages)
            else:
                self._close_group()
                columns, first = [], self.at
                for chunk, (start, length), page in zip(chunks, places, pages):
                    self.sink.write(page)
                    columns.append(moved_column(chunk, self.at - start))
                    self.at += length
                new = group | {1: (LIST, (STRUCT, columns)), 5: (I64, first)}
                new.pop(7, None)  # the ordinal is 16 bits wide; optional
                self.groups.append(packed_fields(new))
            rows += group[3][1]
        if rows != footer[3][1]:
            raise ValueError(f"row groups hold {rows} rows, the footer says {footer[3][1]}")
        self.rows += rows
        self.blocks += len(groups)
        return rows, len(groups)

    def _merge(self, group: Fields, metas: list[Fields], pages: list[bytes]) -> None:
        kind = tuple((packed(*m[3]), m[1][1], m[4][1]) for m in metas)  # path, type, codec
        if kind != self.kind or self.open_bytes >= self.group_bytes:
            self._close_group()
            # sizes, counts and encodings add up; statistics and indexes of single files go
            self.kind, self.pages = kind, [[] for _ in metas]
            self.metas = [{i: m[i] for i in (1, 3, 4)} | {2: (LIST, (I32, [])), 5: (I64, 0), 6: (I64, 0), 7: (I64, 0)} for m in metas]
        for held, own, page, kept in zip(self.metas, metas, pages, self.pages):
            kept.append(page)
            held[2] = (LIST, (I32, sorted({*held[2][1][1], *own[2][1][1]})))
            for i in (5, 6, 7):
                held[i] = (I64, held[i][1] + own[i][1])
            self.open_bytes += len(page)
        self.open_rows += group[3][1]
        self.open_size += group[2][1]

    def _close_group(self) -> None:
        if self.kind:
            columns, first = [], self.at
            for meta, kept in zip(self.metas, self.pages):
                columns.append({2: (I64, 0), 3: (STRUCT, meta | {9: (I64, self.at)})})
                for page in kept:
                    self.sink.write(page)
                    self.at += len(page)
            self.groups.append(packed_fields({1: (LIST, (STRUCT, columns)), 2: (I64, self.open_size), 3: (I64, self.open_rows), 5: (I64, first), 6: (I64, self.at - first)}))
        self._clear()

    def close(self) -> int:
        """Write the footer; the size of the file."""
        if self.base is None:
            raise ValueError("no file was added")
        self._close_group()
        fields = self.base | {3: (I64, self.rows), 4: (LIST, None)}
        footer = packed_fields(fields, {4: list_head(STRUCT, len(self.groups)) + b"".join(self.groups)})
        self.sink.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        return self.at + len(footer) + 8
