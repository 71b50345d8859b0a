"""MOBI files: the layout of their records, and texts from them."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd

_GATE = re.compile(rb"isbn|97[89][0-9 Xx-]{10,}", re.IGNORECASE)


@dataclass(frozen=True)
class Layout:
    compression: int
    records: int
    offsets: tuple[int, ...]
    exth: int | None
    text: int


def layout(data: bytes) -> Layout | None:
    """None: no such file."""
    if len(data) < 78:
        return None
    count = int.from_bytes(data[76:78], "big")
    if not count or len(data) < 78 + 8 * count:
        return None
    offsets = tuple(int.from_bytes(data[78 + 8 * i : 82 + 8 * i], "big") for i in range(count))
    at = offsets[0]
    if len(data) < at + 24 or data[at + 16 : at + 20] != b"MOBI":
        return None
    compression, records = struct.unpack_from(">H6xH", data, at)
    exth = text = at + 16 + int.from_bytes(data[at + 20 : at + 24], "big")
    has = data[exth : exth + 4] == b"EXTH"
    if has and len(data) >= exth + 12:
        size = int.from_bytes(data[exth + 4 : exth + 8], "big")
        if size >= 12 and exth + size <= len(data):
            text = exth + size
    return Layout(compression, max(1, min(records, count)), offsets, exth if has else None, text)


def exth_values(data: bytes, lay: Layout, kind: int = 104) -> Iterator[bytes]:
    if lay.exth is None or len(data) < lay.exth + 12:
        return
    size, count = struct.unpack_from(">LL", data, lay.exth + 4)
    at, end = lay.exth + 12, lay.exth + size
    for _ in range(count if end <= len(data) else 0):
        if at + 8 > end:
            return
        k, n = struct.unpack_from(">LL", data, at)
        if n < 8:
            return
        if k == kind:
            yield data[at + 8 : at + n]
        at += n


def chunks(data: bytes, lay: Layout, whole: bool = False) -> Iterator[bytes]:
    """The rest of record 0 and the text records, but the last (whole: with it)."""
    ends = [*lay.offsets[1:], len(data)]
    if lay.text < ends[0]:
        yield data[lay.text : ends[0]]
    for i in range(1, min(lay.records + whole, len(lay.offsets))):
        if lay.offsets[i] < ends[i]:
            yield data[lay.offsets[i] : ends[i]]


def unpacked(data: bytes) -> bytes:
    """PalmDoc: runs of literals, plain bytes, a blank with a letter, or a copy of what came before."""
    out, i = bytearray(), 0
    while i < len(data):
        b = data[i]
        i += 1
        if 0 < b < 9:
            if i + b > len(data):
                break
            out += data[i : i + b]
            i += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((0x20, b ^ 0x80))
        else:
            if i == len(data):
                break
            pair = b << 8 | data[i]
            i += 1
            back, length = pair >> 3 & 0x7FF, (pair & 7) + 3
            if not 0 < back <= len(out):
                break
            for _ in range(length):
                out.append(out[-back])
    return bytes(out)


def _decoded(data: bytes) -> str:
    for codec in ("utf-8", "utf-16-le", "gb18030", "big5"):
        try:
            return data.decode(codec)
        except UnicodeError:
            continue
    return data.decode("utf-8", "ignore")


def first_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """source, ordinal, text, error: of each file the texts that pass the gate, EXTH first."""
    for batch in batches:
        rows = []
        for path, data in zip(batch["path"], batch["content"]):
            data = bytes(data or b"")
            lay = layout(data)
            if lay is None:
                rows.append((path, -1, None, "corrupt"))
                continue
            rows += [(path, 0, _decoded(v), None) for v in exth_values(data, lay)]
            for k, c in enumerate(chunks(data, lay), 1):
                plain = unpacked(c) if lay.compression == 2 else c
                if _GATE.search(plain):
                    rows.append((path, k, _decoded(plain), None))
        yield pd.DataFrame(rows, columns=["source", "ordinal", "text", "error"])
