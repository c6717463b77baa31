"""Sorted 64-bit keys in Elias-Fano blocks, and files of named arrays that tasks map into memory."""

from __future__ import annotations

import json
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

BLOCK = 16


def _bits(x: np.ndarray) -> np.ndarray:
    """Length of each number in binary."""
    n, x = np.zeros(x.shape, dtype=np.uint64), x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = x >= (np.uint64(1) << np.uint64(s))
        n += np.where(big, np.uint64(s), np.uint64(0))
        x = np.where(big, x >> np.uint64(s), x)
    return n + x


def encode(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of 16 rising keys: a head, the high parts of the differences to it in unary within one word, and their low bits, packed.

    ``at`` points to the low bits of each block, in units of 16 bits; it rises monotonically.
    """
    n = len(keys)
    blocks = -(-n // BLOCK)
    k = np.concatenate([keys, np.repeat(keys[-1:], blocks * BLOCK - n)]).reshape(blocks, BLOCK)
    heads = k[:, 0].copy()
    d = k - heads[:, None]
    bits = _bits(d[:, -1])
    width = np.where(bits > 5, bits - np.uint64(5), np.uint64(0))
    high = np.zeros(blocks, dtype=np.uint64)
    for j in range(BLOCK):
        high |= np.uint64(1) << ((d[:, j] >> width) + np.uint64(j))
    at = np.concatenate([[0], np.cumsum(width)]).astype(np.uint64)
    low = np.zeros(int(at[-1]) * 2 + 16, dtype=np.uint8)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for i in range(0, len(own) if w else 0, 1 << 13):
            b = own[i:i + (1 << 13)]
            raw = ((d[b][:, :, None] >> np.arange(w, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low[(at[b] * np.uint64(2)).astype(np.int64)[:, None] + np.arange(2 * int(w))] = np.packbits(raw.reshape(len(b), -1), axis=1, bitorder="little")
    return {"heads": heads, "high": high, "width": width.astype(np.uint8), "at": at, "low": low[: len(low) // 8 * 8].view(np.uint64)}


def find(level: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Place of each key, or -1. Within the block the unary word tells which elements share the key's high part; only their low bits are read."""
    out = np.full(len(keys), -1, dtype=np.int64)
    if not len(level["heads"]) or not len(keys):
        return out
    b = np.searchsorted(level["heads"], keys, side="right") - 1
    inside = np.flatnonzero(b >= 0)
    b, q = b[inside], keys[inside]
    d, w = q - level["heads"][b], level["width"][b].astype(np.uint64)
    h, high = d >> w, level["high"][b]
    mask = (np.uint64(1) << w) - np.uint64(1)
    start, words = level["at"][b] * np.uint64(BLOCK), level["low"]
    got = np.full(len(b), -1, dtype=np.int64)
    for j in range(BLOCK):
        one = high & (~high + np.uint64(1))
        c = np.flatnonzero((np.bitwise_count(one - np.uint64(1)) == h + np.uint64(j)) & (got < 0))
        if len(c):
            bit = start[c] + np.uint64(j) * w[c]
            word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            upper = np.where(shift > 0, words[np.minimum(word + 1, len(words) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            same = (((words[word] >> shift) | upper) & mask[c]) == (d[c] & mask[c])
            got[c[same]] = b[c[same]] * BLOCK + j
        high = high ^ one
    out[inside] = got
    return out


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays; it appears whole or not at all, so a repeated task does no harm."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    head, at = {}, 0
    for key, a in arrays.items():
        head[key] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
            out.write(b"\0" * (-a.nbytes % 8))
    system.move(part, f"{path}/{name}")


@lru_cache(maxsize=4096)
def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file; mapped into memory where the shared folder is a mounted path, read otherwise. A missing file has no arrays."""
    system, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    if isinstance(system, fs.LocalFileSystem):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
    else:
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), dtype=np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    return {k: raw[8 + size + at:8 + size + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in json.loads(raw[8:8 + size].tobytes()).items()}
