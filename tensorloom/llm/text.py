"""Vectorised text kernels shared by the operators: Arrow batches to byte buffers, unit spans, polynomial hashes.

A chunk is (rows, buf, offs): Arrow columns of some rows, their UTF-8 bytes end to end as uint8, and len(rows)+1
offsets into them. A null text has no bytes. Hash work runs over segments of a quarter megabyte, so memory follows the
number of units rather than 8 bytes for each byte of text, however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes (bytes to unit, units to window).
BYTE_BASE = 0x9E3779B97F4A7C15
UNIT_BASE = 0xD6E8FEB86659FD93
SEGMENT = 1 << 18
CHUNK_BYTES, CHUNK_ROWS = 6 << 20, 1 << 16


def _classes(inside: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


#: Bytes that belong to a unit. WORDS: all but blank and \t to \r. ITEM_WORDS: ASCII letters, digits, bytes from 0x80.
WORDS = _classes(bytes(b for b in range(256) if b != 0x20 and not 9 <= b <= 13))
ITEM_WORDS = _classes(bytes(b for b in range(256) if b >= 0x80 or chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Regroup Arrow batches so that each chunk has about ``size`` bytes of text, and ``rows`` rows at most; one longer text is a chunk alone."""

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        column = table.column(text).combine_chunks()
        return table, *_buffer(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)

    held: list[pa.RecordBatch] = []
    n = count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _buffer(batch.column(batch.schema.get_field_index(text)))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size - n, "right")) - 1) if n < size else at
            to = min(to, at + rows - count)
            if to > at and held and n + ends[to] - ends[at] > size:
                to = at
            if to > at:
                held.append(batch.slice(at, to - at))
                n, count = n + int(ends[to] - ends[at]), count + to - at
                at = to
            if n >= size or count >= rows or at < batch.num_rows:
                yield out(held)
                held, n, count = [], 0, 0
    if held:
        yield out(held)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = 1 << max(10, int(n - 1).bit_length())
        back = pow(base, -1, 1 << 64)
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, back))
        if m <= SEGMENT * 2:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits, so that every bit of a polynomial hash counts."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of ``inside`` bytes; a run never crosses texts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = inside[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    first = m.copy()
    first[1:] &= ~m[:-1] | cut[1:-1]
    last = m
    last[:-1] &= ~m[1:] | cut[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each line; newline ends a line, an empty text has none."""
    full = np.flatnonzero(offs[1:] > offs[:-1])
    ends = np.flatnonzero(buf == 10)
    doc = np.concatenate([np.searchsorted(offs, ends, "right") - 1, full])
    cuts, begins = np.concatenate([ends, offs[full + 1]]), np.concatenate([ends + 1, offs[full]])
    by = np.lexsort((cuts, doc))  # a newline as a text's last byte opens a last, empty line
    cuts, begins, doc = cuts[by], begins[np.lexsort((begins, doc))], doc[by]
    return begins, cuts, doc


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of each span's bytes after ``fold``; spans are in order and do not overlap."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + SEGMENT, "right")))
        hi = int(end[to - 1])
        up, down = powers(BYTE_BASE, hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((fold[buf[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(UNIT_BASE))
        at = to
    return out


def window_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """The rolling polynomial hash of every k consecutive units, ignoring texts' ends; len(units)-k+1 of them."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, SEGMENT):
        hi = min(n, lo + SEGMENT)
        part = units[lo : hi + k - 1]
        up, down = powers(UNIT_BASE, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=total[1:])
        out[lo:hi] = mix((total[k:] - total[:-k]) * down[: hi - lo])
    return out


def window_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For units dealt to texts by ``bounds`` (offsets), the unit index of each window inside one text, and its text."""
    n = np.maximum(np.diff(bounds) - (k - 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return np.arange(int(n.sum())) - first[doc] + bounds[:-1][doc], doc
