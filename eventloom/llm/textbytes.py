"""Vectorised work on the bytes of many texts at once: words, rolling hashes, segments."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 1_000_000

_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give memory that is no longer used back to the system: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def powers(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of runs of about CHUNK_BYTES. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def latin_lower(data: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the two-byte capitals of Latin-1."""
    out = ascii_lower(data)
    if len(out) > 1:
        accent = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accent] += 32
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at row boundaries."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if n else inside
    after = np.concatenate([inside[1:], [False]]) if n else inside
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1 : n + 1])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of anything but space and 0x09-0x0D."""
    return runs(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ASCII letters and digits and of bytes beyond ASCII."""
    return runs((data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)), offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with hash(a, b) = (h[b] - h[a]) * INVERSE ** a for the bytes from a to b."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), MULTIPLIER, "up"), out=out[1:])
    return out


def hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs."""
    down = powers(len(prefix), INVERSE, "down")
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_of(text: str) -> int:
    """The hash that ``hashes`` gives to a run of these bytes."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hashes(prefix_hash(data), np.array([0]), np.array([len(data)]))[0])
