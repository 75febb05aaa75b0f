"""Vectorised word statistics on UTF-8 bytes. Words are runs of bytes other than space and \\t\\n\\v\\f\\r.

All separators are ASCII, so a word of the text is a word of its bytes. Texts are worked on in
segments of about SEGMENT bytes, whole texts one after another or a long text piece by piece (cut at a
separator), so that memory does not follow the length of a text but for 8 bytes a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def _segments(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """(bytes, [(text number, end in bytes)]): several texts joined by a separator, or a piece of a long one."""
    held: list[bytes] = []
    ends: list[tuple[int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > SEGMENT:
            if ends:
                yield b"\n".join(held), ends
                held, ends, size = [], [], 0
            at = 0
            while at < len(t):
                to = at + SEGMENT
                while to < len(t) and not _SEP[t[to]]:
                    to += 1
                piece = t[at:to]
                yield piece, [(i, len(piece))]
                at = to
            continue
        held.append(t)
        size += len(t)
        ends.append((i, size + len(held) - 1))
        if size >= SEGMENT:
            yield b"\n".join(held), ends
            held, ends, size = [], [], 0
    if ends:
        yield b"\n".join(held), ends


def words(texts: list[bytes], symbols: bytes = b"") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, n_words, word_chars, n_symbols): hashes of all words in order, and for each text the
    number of its words, of code points in them and of bytes that are in `symbols`."""
    n = len(texts)
    n_words, chars, found = (np.zeros(n, np.int64) for _ in range(3))
    mark = np.zeros(256, bool)
    mark[list(symbols)] = True
    parts = []
    for data, ends in _segments(texts):
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            continue
        sep = _SEP[b]
        edge = np.diff(sep.view(np.int8), prepend=np.int8(1), append=np.int8(1))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        power, inverse = _power(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        parts.append(mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64)))
        which, to = np.array([i for i, _ in ends]), np.array([e for _, e in ends])
        at = np.r_[0, to[:-1]]
        np.add.at(n_words, which, np.searchsorted(starts, to) - np.searchsorted(starts, at))
        lead = np.r_[0, np.cumsum(~sep & ((b & 0xC0) != 0x80))]
        np.add.at(chars, which, lead[to] - lead[at])
        if symbols:
            marked = np.r_[0, np.cumsum(mark[b])]
            np.add.at(found, which, marked[to] - marked[at])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), n_words, chars, found


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; empty if there are fewer."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[i : i + n]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text; of all its words, if it has fewer than k."""
    hashes, counts, _, _ = words(texts)
    out, at = [], 0
    for c in counts.tolist():
        own = hashes[at : at + c]
        at += c
        out.append(np.unique(windows(own, min(k, c))) if c else np.zeros(0, np.uint64))
    return out


def slices(rows: pa.Table, text: str, most: int = 4 << 20) -> Iterator[pa.Table]:
    """Runs of rows with about `most` bytes of text at most, or one longer row."""
    start, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(rows.column(text)), 0).to_pylist()):
        if held and held + size > most:
            yield rows.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < rows.num_rows:
        yield rows.slice(start)
    release()


def release() -> None:
    """Give memory that is free again back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if trim is not None:
        trim(0)
