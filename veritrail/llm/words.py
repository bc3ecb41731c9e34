"""Vectorised word and shingle hashes over runs of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64

PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Byte tables: what separates words. Whitespace is space and 0x09-0x0D; plain words are
#: ASCII letters and digits and anything beyond ASCII.
WHITESPACE = np.zeros(256, bool)
WHITESPACE[[9, 10, 11, 12, 13, 32]] = True
PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BASE_INVERSE)):
                _powers[k] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + n // 2, base, np.uint64))])
    return _powers[0], _powers[1]


def _pieces(text: bytes, gap: np.ndarray) -> Iterator[bytes]:
    """A long text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE:
        tail = np.frombuffer(text, np.uint8, PIECE, at)
        ends = np.flatnonzero(gap[tail])
        if len(ends):
            step = int(ends[-1]) + 1
        else:  # one word longer than a piece stays whole
            rest = np.flatnonzero(gap[np.frombuffer(text, np.uint8, offset=at + PIECE)])
            step = PIECE + (int(rest[0]) + 1 if len(rest) else len(text))
        yield text[at : at + step]
        at += step
    if at < len(text):
        yield text[at:]


def word_hashes(texts: list[bytes], gap: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words of all texts in order, words by text)."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    run: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text, gap):
            run.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                hashes.append(_hash_run(run, gap, fold, counts))
                run, size = [], 0
    if run:
        hashes.append(_hash_run(run, gap, fold, counts))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def _hash_run(run: list[tuple[int, bytes]], gap: np.ndarray, fold: np.ndarray | None, counts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(b" ".join(p for _, p in run) + b" ", np.uint8)
    inked = ~gap[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inked, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw if fold is None else fold[raw]] * power[: len(raw)], dtype=np.uint64)])
        out = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    lengths = np.array([len(p) + 1 for _, p in run])
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    np.add.at(counts, np.array([i for i, _ in run])[owner], 1) if len(starts) else None
    return out


def shingles(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words, by start, over text borders too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(width + (seed << 8)), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            out = out * _BASE + hashes[j : j + n]
    return mix64(out)


def positions_in(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, position of each word in its text)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
