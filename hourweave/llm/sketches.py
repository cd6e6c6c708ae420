"""MinHash signatures and bands of lines in numpy, on one machine: what tests of op3's recall measure the job against.

``lines`` works with built-in functions and other hashes; signature, runs and starts follow the same rules.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 8
SIGNATURE, RUN, FIRST = 44, 4, 4
#: Characters that are hashed together; a longer line is hashed in parts.
_CHUNK = 1 << 17
#: Odd multipliers, and the bits of a hash beside a line's number.
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
_BITS = np.uint64(48)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def _distinct(values: np.ndarray) -> np.ndarray:
    """In order; sorting is many times as fast here as numpy's ``unique``, which hashes."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of SHINGLE characters, in order and with repeats, line after line, and each line's number of them.

    A shorter line is one window, filled up with NUL.
    """
    lines = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.array([len(x) for x in lines], np.int64)
    h = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    # windows of two, four and eight characters, each from those of half its length
    for width, odd in zip((1, 2, 4), _ODD):
        h = h[:-width] * odd + h[width:]
    whole = np.ones(int(sizes.sum()), bool)
    whole[(np.cumsum(sizes)[:, None] - np.arange(1, SHINGLE)).ravel()] = False
    return _mixed(h[whole[: len(h)]]), sizes - (SHINGLE - 1)


def shingle_set(line: str) -> np.ndarray:
    """The distinct hashes in order."""
    parts = [line[i : i + _CHUNK + SHINGLE - 1] for i in range(0, max(1, len(line) - SHINGLE + 1), _CHUNK)]
    sets = [_distinct(hashed([p])[0]) for p in parts]
    return sets[0] if len(sets) == 1 else _distinct(np.concatenate(sets))


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The smallest distinct hashes of each of up to 2^16 lines, cut to 48 bits, in order (a row each, filled with 0), and how many.

    Of long lines only hashes below a bound that about three signatures pass are sorted; where repeats leave too few of them, all are.
    """
    h, n = hashed(lines)
    key = (np.repeat(np.arange(len(lines), dtype=np.uint64), n) << _BITS) | (h >> np.uint64(16))
    bound = np.where(n > 6 * SIGNATURE, 3.0 * SIGNATURE / n, 1.0) * 2.0**48
    kept = _distinct(key[(h >> np.uint64(16)) < np.repeat(bound.astype(np.uint64), n)])
    found = np.bincount((kept >> _BITS).astype(np.int64), minlength=len(lines))
    few = (n > 6 * SIGNATURE) & (found < SIGNATURE)
    if few.any():
        kept = _distinct(np.concatenate([kept, key[np.repeat(few, n)]]))
        found = np.bincount((kept >> _BITS).astype(np.int64), minlength=len(lines))
    place = np.arange(len(kept)) - np.repeat(np.cumsum(found) - found, found)
    kept, place = kept[place < SIGNATURE], place[place < SIGNATURE]
    out = np.zeros((len(lines), SIGNATURE), np.uint64)
    out[(kept >> _BITS).astype(np.int64), place] = kept & np.uint64((1 << 48) - 1)
    return out, np.minimum(found, SIGNATURE)


def _long_signature(line: str) -> tuple[np.ndarray, np.ndarray]:
    """The signature of one line, worked out in parts."""
    smallest = np.zeros(0, np.uint64)
    for i in range(0, len(line) - SHINGLE + 1, _CHUNK):
        values, n = signatures([line[i : i + _CHUNK + SHINGLE - 1]])
        smallest = _distinct(np.concatenate([smallest, values[0, : n[0]]]))[:SIGNATURE]
    out = np.zeros((1, SIGNATURE), np.uint64)
    out[0, : len(smallest)] = smallest
    return out, np.array([len(smallest)])


def runs(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands of all signatures, one after the other, and each one's number of them."""
    wide = np.concatenate([values, np.zeros((len(values), RUN - 1), np.uint64)], 1)
    run = wide[:, :SIGNATURE]
    for j in range(1, RUN):
        run = _mixed(run * _ODD[1] + wide[:, j : j + SIGNATURE])
    place = np.arange(SIGNATURE)
    bits = np.where(sizes < SIGNATURE, 1, 3).astype(np.uint64)[:, None]
    starts = (place == 0) | (((place < FIRST) | (values & bits == 0)) & (place <= sizes[:, None] - RUN))
    return run[starts].view(np.int64), starts.sum(1)
