"""Words of many texts at once: where runs of bytes of a kind lie, and XXH64 and CRC-32 of many stretches of bytes, in numpy.

A call for each word costs more than the hash of it. Stretches are taken by their length, so that all of one length go
through the same steps together; lengths that few have go through the library one by one."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import xxhash

_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Stretches that are hashed at a time, those of one length below which the library does it, bytes beyond which too.
SOME, FEW, LONG = 1 << 16, 24, 512


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> np.uint32(1) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()


def runs(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one kind other than 0 begin and end (before)."""
    edge = np.flatnonzero(np.diff(kinds, prepend=0, append=0))
    begin, end = edge[:-1], edge[1:]
    if not len(begin):
        return begin, end
    real = kinds[begin] != 0
    return begin[real], end[real]


def _by_size(data: bytes, start: np.ndarray, size: np.ndarray, out: np.ndarray, alone: Callable[[bytes], int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, starts and places of the stretches of each length that many have; the others are done."""
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 1 << 16 else size, kind="stable")
    ordered = size[order]
    edges = np.flatnonzero(np.diff(ordered)) + 1
    for at in np.split(order, edges):
        if not len(at):
            continue
        n = int(size[at[0]])
        if len(at) < FEW or n > LONG:
            out[at] = [alone(data[s : s + n]) for s in start[at].tolist()]
        else:
            yield n, start[at], at


def crc32s(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """zlib.crc32 of the stretches."""
    raw, out = np.frombuffer(data, np.uint8), np.zeros(len(start), dtype=np.uint32)
    for n, at, of in _by_size(data, start, size, out, zlib.crc32):
        crc = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            crc = _CRC[(crc ^ raw[at + k]) & np.uint32(255)] ^ crc >> np.uint32(8)
        out[of] = ~crc
    return out


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return x << _U(bits) | x >> _U(64 - bits)


def _lane(x: np.ndarray) -> np.ndarray:
    return _turned(x * _P2, 31) * _P1


def xxh64s(data: bytes, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the stretches, which come in the order of their starts."""
    out = np.zeros(len(start), dtype=np.uint64)
    alone = lambda x: xxhash.xxh64_intdigest(x, seed)
    for k in range(0, len(start), SOME):
        s, n_, o = start[k : k + SOME], size[k : k + SOME], out[k : k + SOME]
        base = int(s[0])
        part = data[base : int((s + n_).max())]
        # eight bytes from each place on
        eight = np.ascontiguousarray(np.ndarray((len(part) + 1,), "<u8", part + bytes(8), strides=(1,)))
        for n, at, of in _by_size(part, s - base, n_, o, alone):
            read = lambda k: eight[at + k]  # noqa: B023, E731
            if n < 32:
                h, k_ = np.full(len(at), (seed + int(_P5) + n) % 2**64, dtype=np.uint64), 0
            else:
                one, two = int(_P1), int(_P2)
                v = [np.full(len(at), x % 2**64, dtype=np.uint64) for x in (seed + one + two, seed + two, seed, seed - one)]
                for k_ in range(0, n - 31, 32):
                    v = [_turned(x + read(k_ + 8 * j) * _P2, 31) * _P1 for j, x in enumerate(v)]
                h = sum(_turned(x, bits) for x, bits in zip(v, (1, 7, 12, 18)))
                for x in v:
                    h = (h ^ _lane(x)) * _P1 + _P4
                h, k_ = h + _U(n), n // 32 * 32
            for k_ in range(k_, n - 7, 8):
                h = _turned(h ^ _lane(read(k_)), 27) * _P1 + _P4
            k_ = n // 8 * 8
            if n & 4:
                h = _turned(h ^ (read(k_) & _U(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
                k_ += 4
            for k_ in range(k_, n):
                h = _turned(h ^ (read(k_) & _U(255)) * _P5, 11) * _P1
            h = (h ^ h >> _U(33)) * _P2
            h = (h ^ h >> _U(29)) * _P3
            o[of] = h ^ h >> _U(32)
    return out


def shingles(texts: list[bytes], size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of `size` words of each text, text after text, with repeats, and where each text's begin (and the last
    one's end). Words are runs of other than ASCII white space, A-Z lower-cased, joined by spaces; a text of fewer is one run,
    one without words none."""
    plain = [b" ".join(x.lower().split()) for x in texts]
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in plain], dtype=np.int64)
    data = b" ".join(x for x in plain if x)
    begin = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1])
    end = np.append(begin[1:] - 1, len(data))
    of = np.maximum(counts - size + 1, counts > 0)
    bounds = np.concatenate([[0], np.cumsum(of)])
    first = np.cumsum(counts) - counts
    word = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], of)
    last = np.minimum(word + size, np.repeat(first + counts, of)) - 1
    if not len(word):
        return np.zeros(0, dtype=np.uint64), bounds
    start = begin[word]
    return xxh64s(data, start, end[last] - start, seed), bounds


def majorities(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each stretch of 64-bit words, the bits that over half of them have; none of an empty one. Eight bits of a word are
    added up in its bytes at once, which hold the sums of up to 255 words."""
    n = np.diff(bounds)
    blocks = -(-n // 255)
    of = np.cumsum(blocks) - blocks
    out = np.zeros(len(n), dtype=np.uint64)
    real = np.flatnonzero(n)
    if not len(real):
        return out
    at = np.repeat(bounds[:-1], blocks) + (np.arange(int(blocks.sum())) - np.repeat(of, blocks)) * 255
    for k in range(8):
        sums = np.add.reduceat(x >> _U(k) & _U(0x0101010101010101), at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums, of[real], axis=0, dtype=np.int64)
        most = (2 * ones > n[real, None]).astype(np.uint64) << (np.arange(8, dtype=np.uint64) * _U(8) + _U(k))
        out[real] |= np.bitwise_or.reduce(most, axis=1)
    return out
