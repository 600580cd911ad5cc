"""Vectorised text kernels shared by the operators.

A chunk is a run of whole texts of one Arrow batch, held as one byte array with offsets. Everything below works on
all texts of a chunk at once; nothing loops over characters. A chunk holds about CHUNK bytes, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
#: An odd factor.
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: The prime of the polynomial hashes, a base below it, and masks of its products' halves.
P = U((1 << 61) - 1)
SEED = 0x0F2A_7E61_9C3B_58D5
LOW32, LOW29 = U((1 << 32) - 1), U((1 << 29) - 1)
STEP = 1 << 13


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo P."""
    x = (x & P) + (x >> U(61))
    np.subtract(x, P, out=x, where=x >= P)
    return x


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b modulo P, of numbers below P: halves of 32 bits, some thousands at a time so that they stay in cache."""
    out = np.empty(len(a), np.uint64)
    room = np.empty((5, min(STEP, max(1, len(a)))), np.uint64)
    for lo in range(0, len(a), STEP):
        x, y, o = a[lo : lo + STEP], b[lo : lo + STEP], out[lo : lo + STEP]
        x1, x0, y1, y0, m = room[:, : len(x)]
        np.right_shift(x, U(32), out=x1)
        np.bitwise_and(x, LOW32, out=x0)
        np.right_shift(y, U(32), out=y1)
        np.bitwise_and(y, LOW32, out=y0)
        np.multiply(x1, y0, out=m)
        np.multiply(x0, y1, out=o)
        m += o
        x0 *= y0
        x1 *= y1
        x1 <<= U(3)  # 2**64 is 8
        np.right_shift(x0, U(61), out=o)
        x1 += o
        x0 &= P
        x1 += x0
        np.right_shift(m, U(29), out=o)  # 2**61 is 1
        x1 += o
        m &= LOW29
        m <<= U(32)
        x1 += m
        np.right_shift(x1, U(61), out=o)
        x1 &= P
        o += x1
        np.subtract(o, P, out=o, where=o >= P)
    return out


BYTE_CODES = reduced(mix(np.arange(1, 257, dtype=np.uint64) * U(BASE)))


class _Powers:
    """Powers modulo P of the base and of its inverse, as many as have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = SEED % int(P)
            self.up, self.down = (self._grown(x, b, n) for x, b in ((self.up, base), (self.down, pow(base, -1, int(P)))))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grown(x: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(x) < n:
            x = np.concatenate([x, product(x, np.full(len(x), pow(base, len(x), int(P)), np.uint64))])
        return x


_POWERS = _Powers()


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """H with span_hash(H, s, e) the polynomial hash of codes[s:e] modulo P, alike wherever the span stands. A power of
    two as modulus would not do: there strings like Thue and Morse's collide under every base."""
    up, _ = _POWERS.get(len(codes) + 1)
    term = product(codes, up[:-1])
    out = np.zeros(len(codes) + 1, np.uint64)
    # sums of both halves stay below 2**64; high ones then weigh 2**32
    high = reduced(np.cumsum(term >> U(32), dtype=np.uint64))
    low = reduced(np.cumsum(term & LOW32, dtype=np.uint64))
    out[1:] = reduced(((high & LOW29) << U(32)) + (high >> U(29)) + low)
    return out


def span_hash(prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, down = _POWERS.get(len(prefix))
    return product(reduced(prefix[e] + (P - prefix[s])), down[s])


#: Bytes from which on a span is hashed by itself.
LONG_SPAN = 256


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf as a number; zeros follow its end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), np.uint64, padded, 0, (1,))


#: For 0 to 8 bytes, which bits of a number they fill; for spans of 0 to LONG_SPAN bytes, what their hashes begin with.
FILLED = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
BEGIN = mix(np.arange(LONG_SPAN + 1, dtype=np.uint64) + U(BASE))


def span_codes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans s..e of buf: eight bytes after eight, each mixed into what came before."""
    size = np.minimum(e - s, LONG_SPAN)
    view = eights(buf)
    out = mix(BEGIN[size] ^ (view[s] & FILLED[np.minimum(size, 8)]) * U(BASE))
    at, own = 8, np.flatnonzero((size > 8) & (size < LONG_SPAN))
    while len(own):
        left = size[own] - at
        out[own] = mix(out[own] ^ (view[s[own] + at] & FILLED[np.minimum(left, 8)]) * U(BASE))
        own = own[left > 8]
        at += 8
    for i in np.flatnonzero(size == LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[s[i] : e[i]], digest_size=8).digest(), "little")
    return out


def run_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k successive numbers."""
    n = max(0, len(codes) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out + codes[j : j + n])
    return out


class Texts:
    """The texts of a chunk as UTF-8 bytes; nulls are empty."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    @classmethod
    def of(cls, texts: list[str | bytes | None]) -> Texts:
        raw = [(x or "").encode() if not isinstance(x, bytes) else x for x in texts]
        off = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=off[1:])
        return cls(np.frombuffer(b"".join(raw), np.uint8), off)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def sums(self, mask: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value held for every byte."""
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[self.off])

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, pos, side="right") - 1

    def lower(self) -> Texts:
        """A-Z lower-cased."""
        return Texts(_LOWER[self.buf], self.off)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes with inside true: starts, ends, text numbers. Runs never cross texts."""
        if not len(inside):
            z = np.zeros(0, np.int64)
            return z, z, z
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = self.off[:-1][self.off[:-1] < len(inside)]
        first[at] = inside[at]
        at = self.off[1:][self.off[1:] > 0] - 1
        last[at] = inside[at]
        s = np.flatnonzero(first)
        return s, np.flatnonzero(last) + 1, self.doc_of(s)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_table(members: bytes | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Bytes of words: letters and digits, and every byte of a code point beyond ASCII.
WORD_BYTES = byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
CONTINUATION = byte_table(list(range(0x80, 0xC0)))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows lo..hi of a batch with their texts; a run ends once it holds limit bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, len(col), lo + 20_000)
        yield lo, hi, Texts(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Words:
    """The words of the texts of a chunk: byte spans, text numbers, hashes."""

    def __init__(self, texts: Texts, table: np.ndarray):
        self.texts = texts
        self.inside = table[texts.buf]
        self.s, self.e, self.doc = texts.spans(self.inside)
        self.hash = span_codes(texts.buf, self.s, self.e)
        self.count = np.bincount(self.doc, minlength=texts.n).astype(np.int64)
        #: Number of the first word of each text, and one past the last.
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of k words of one text."""
        n = len(self.s) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        i = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return i, run_hashes(self.hash, k)[i]

    def digests(self) -> list[bytes | None]:
        """128 bits of each text's words in order, by a cryptographic hash; of a text without words, of its bytes; of an
        empty text, nothing."""
        buf, off = self.texts.buf, self.texts.off
        keep = self.inside.copy()
        # one space behind each word that does not end its text
        ends = self.e[self.e < off[self.doc + 1]]
        keep[ends] = True
        spaced = buf.copy()
        spaced[ends] = 32
        out: list[bytes | None] = []
        for n, lo, hi in zip(self.count.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
            if n:
                out.append(hashlib.blake2b(spaced[lo:hi][keep[lo:hi]].tobytes().rstrip(b" "), digest_size=16).digest())
            else:
                raw = buf[lo:hi].tobytes()
                out.append(hashlib.blake2b(raw, digest_size=16, person=b"no words").digest() if raw else None)
        return out

    def bytes(self, i: int, k: int = 1) -> list[bytes]:
        return [self.texts.buf[self.s[j] : self.e[j]].tobytes() for j in range(i, i + k)]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands more than once."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of k words; a text of fewer words, but not none, has one run of them all."""
    i, h = words.windows(k)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        hs = words.count[short].astype(np.uint64)
        for j in range(k - 1):
            own = words.count[short] > j
            hs[own] = mix(hs[own] + words.hash[words.first[short[own]] + j])
        return np.concatenate([words.doc[i], short]), np.concatenate([h, hs])
    return words.doc[i], h
