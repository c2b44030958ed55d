"""Vectorised word and n-gram hashing over UTF-8 buffers.

Words are maximal runs of bytes other than space and ``\\x09``-``\\x0D``.  A word's
hash reads it in lanes of eight bytes through a multiply-xorshift mixer; an
n-gram's hash joins the hashes of its halves, so a 35-gram takes seven passes.
"""

from __future__ import annotations

import numpy as np
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = np.array([0] + [(1 << (8 * i)) - 1 for i in range(1, 8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG = 64
#: Bytes of text that are hashed at a time, unless one text is longer.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _C2
    x ^= x >> np.uint64(27)
    x *= _C3
    x ^= x >> np.uint64(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two halves."""
    return mix(a * _C1 + b)


def _spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[buf], [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words begin (one more entry)."""
    buf = b"\n".join(texts) + b"\n" + b"\0" * 8
    raw = np.frombuffer(buf, dtype=np.uint8)[:-8]
    starts, ends = _spans(raw)
    lens = (ends - starts).astype(np.int64)
    lanes = np.ndarray(shape=(len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    h = (lens.astype(np.uint64) + np.uint64(1)) * _C1
    live = np.flatnonzero(lens <= _LONG)
    k = 0
    while live.size:
        rest = lens[live] - k
        h[live] = mix(h[live] ^ (lanes[starts[live] + k] & _MASK[np.minimum(rest, 8)]) * _C1)
        k += 8
        live = live[rest > 8]
    for i in np.flatnonzero(lens > _LONG):
        h[i] = xxhash.xxh64_intdigest(buf[starts[i] : ends[i]], seed=7)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return h, np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each word; the last n-1 words start none."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out, length, power, step = None, 0, words, 1
    while True:
        if n & step:
            if out is None:
                out, length = power, step
            else:
                m = len(words) - length - step + 1
                out, length = join(out[:m], power[length : length + m]), length + step
        if step * 2 > n:
            return out
        power, step = join(power[:-step], power[step:]), step * 2


def chunks(texts: list[bytes]):
    """Runs of positions in ``texts`` of about CHUNK bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield range(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield range(at, len(texts))


class Buckets:
    """Deals 64-bit hashes to ``n`` buckets by range; inside one, 32 bits tell them apart.

    The rest of a hash is dropped, so different hashes may meet, at
    32 + log2(n) bits.  Only counts that may come out too high are made of them.
    """

    def __init__(self, n: int):
        self.n, self.bits = n, 32 + n.bit_length() - 1
        lows = [-(-(b << self.bits) // n) for b in range(n)]
        self.low = np.array(lows, dtype=np.uint64)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def split(self, keys: np.ndarray):
        """Of sorted keys: each bucket that has some, its slice, and their 32 bits there."""
        cuts = np.append(np.searchsorted(keys, self.low), len(keys))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            yield int(b), s, (keys[s] - self.low[b]).astype(np.uint32)
