"""Byte contexts of Arrow text columns, and a lookup table for them."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

ORDER = 4  # bytes of context
CHUNK = 1 << 18  # bytes handled at once
MERGE = 32  # chunks whose counts are merged at once
PAD = "\0" * ORDER  # goes before each text, so that its first bytes have a whole context

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8), offsets


def contexts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: the last ``ORDER`` bytes and the byte itself as one number each, the owners of
    runs, and where the runs start; bytes of the padding are left out. A long text spans chunks."""
    for at in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        to = min(at + CHUNK, int(offsets[-1]))
        low = max(at - ORDER, 0)
        part = np.concatenate([np.zeros(ORDER - (at - low), np.uint64), data[low:to].astype(np.uint64)])
        keys = np.zeros(to - at, np.uint64)
        for back in range(ORDER, -1, -1):
            keys = (keys << np.uint64(8)) | part[ORDER - back : len(part) - back]
        first, last = np.searchsorted(offsets, [at, to - 1], "right") - 1
        begin = np.maximum(offsets[first : last + 1] + ORDER, at) - at
        end = np.minimum(offsets[first + 1 : last + 2], to) - at
        owner = np.arange(first, last + 1)
        some = end > begin
        begin, end, owner = begin[some], end[some], owner[some]
        if not len(begin):
            continue
        keep = np.zeros(to - at + 1, np.int8)
        np.add.at(keep, begin, 1)
        np.add.at(keep, end, -1)
        sizes = end - begin
        yield keys[np.cumsum(keep[:-1]).astype(bool)], owner, np.cumsum(sizes) - sizes


def count_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct grams of a column and their counts; ``None`` without any."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for keys, _, _ in contexts(data, offsets):
        parts.append(np.unique(keys, return_counts=True))
        if len(parts) == MERGE:
            parts = [counted(parts)]
    return counted(parts) if parts else None


def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


class Lookup:
    """Row numbers of distinct 64-bit keys. A key that finds its slot taken goes to a further, smaller table."""

    def __init__(self, keys: np.ndarray) -> None:
        keys, rest, self.tables = keys.astype(np.uint64), np.arange(len(keys), dtype=np.int32), []
        draw = np.random.default_rng(1)
        while len(rest):
            bits = int(np.ceil(np.log2(4 * len(rest))))
            factor = np.uint64(int(draw.integers(1 << 62, 1 << 63)) * 2 + 1)
            shift = np.uint64(64 - bits)
            rows, filed = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
            slots = (keys[rest] * factor) >> shift
            rows[slots] = rest
            won = rows[slots] == rest
            filed[slots[won]] = keys[rest[won]]
            self.tables.append((factor, shift, filed, rows))
            rest = rest[~won]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        todo = None
        for factor, shift, filed, rows in self.tables:
            now = keys if todo is None else keys[todo]
            slots = (now * factor) >> shift
            row = rows[slots]
            same = filed[slots] == now
            good = same & (row >= 0)
            if todo is None:
                out = np.where(good, row, np.int32(-1))
                todo = np.flatnonzero(~same & (row >= 0))
            else:
                out[todo[good]] = row[good]
                todo = todo[~same & (row >= 0)]
            if not len(todo):
                break
        return out
