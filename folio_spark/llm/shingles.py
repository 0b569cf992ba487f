"""Hashed word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

SPACES = b"\t\n\x0b\x0c\r "
SPACE = np.isin(np.arange(256), list(SPACES))
U64 = np.uint64
#: Multipliers: any odd numbers with well-mixed bits do.
BASE = 0x9E3779B97F4A7C15
PLACES = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], U64
)
#: Bytes of text hashed together.
BLOCK = 2 << 20
POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of it."""
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


BYTES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker."""
    if "up" not in POWERS or len(POWERS["up"]) < size:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(size, BLOCK + 1), base, U64)
            steps[0] = 1
            POWERS[name] = np.cumprod(steps, dtype=U64)
    return POWERS["up"], POWERS["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each word of ``data``."""
    raw = np.frombuffer(data, "u1")
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum(BYTES[raw] * up[: len(raw)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(U64)), begins


def lowered(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def words_of_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and each text's number of words."""
    found, counts = [np.zeros(0, U64)], np.zeros(len(texts), "i8")
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) < BLOCK):
            size += len(texts[end]) + 1
            end += 1
        data = lowered(b"\n".join(texts[begin:end]))
        if end - begin > 1 or len(data) <= BLOCK:
            hashes, places = word_hashes(data)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts[begin:end]])
            counts[begin:end] = np.diff(np.searchsorted(places, starts))
            found.append(hashes)
        else:
            at = 0
            while at < len(data):
                # A block of one long text ends at white space, so that no word is cut.
                stop = at + BLOCK
                while stop < len(data) and data[stop] not in SPACES:
                    stop += 1
                hashes, _ = word_hashes(data[at:stop])
                counts[begin] += len(hashes)
                found.append(hashes)
                at = stop
        begin = end
    return np.concatenate(found), counts


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts in order (repeats included), and the text of each.

    A text of fewer words, but not none, is one shingle of all its words.
    """
    words, counts = words_of_all(texts)
    owner = np.repeat(np.arange(len(texts), dtype="i4"), counts)
    n = max(0, len(words) - width + 1)
    full = np.zeros(n, U64)
    for k in range(width):
        full += words[k : k + n] * PLACES[k]
    whole = owner[:n] == owner[width - 1 : width - 1 + n]
    hashes, owners = mix(full[whole]), owner[:n][whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        made = [
            (words[first[i] : first[i] + counts[i]] * PLACES[: counts[i]]).sum(dtype=U64) + U64(counts[i])
            for i in short
        ]
        hashes = np.concatenate([hashes, mix(np.array(made, U64))])
        owners = np.concatenate([owners, short.astype("i4")])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners
