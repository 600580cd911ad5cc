"""Suffix-array dedup: removes every byte covered by a 50-byte string that also starts in a document of smaller id.

Every 50-byte window belongs to its smallest 16-byte gram, by hash: its anchor. Equal windows have equal anchors, so
windows need to meet only by anchor. Successive windows of one anchor form a run, about 19 windows long.

1. Tasks send their runs as rows, less those whose bytes they hold in a smaller document too.
2. Rows are dealt and sorted by anchor and read as a stream. A run with the hash of a smaller document's run becomes a
   claim: that it equals the other one. Where an anchor has runs of different bytes, these are asked for their text.
3. Claims of one document on another that continue each other are joined, and written with the questions.
4. Documents meet the questions by id and send the asked stretches, which are dealt and sorted by anchor again. The
   suffixes at all their window starts are sorted (suffix_order: prefix polynomial hashes and binary search give each
   comparison's common extension, inside a mergesort; neighbours found equal are verified byte by byte). Of equal
   windows, all but those of the smallest document are covered.
5. Documents meet what is covered, and the bytes that their claims are on: what is not equal byte for byte stays.

Rows follow the runs of the text, not partitions; no step holds more than a stream's part and one anchor's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .kernels import BYTE_CODES, FILLED, Texts, chunks, eights, mix, prefix_hashes, repeated, span_codes, span_hash

LENGTH, GRAM = 50, 16


@dataclass(frozen=True)
class Bounds:
    """How much a task holds: bytes of texts in whose runs it looks for repeats, rows of a stream, windows sorted at
    once; and the rows of an anchor from which on its windows are dealt by their own bytes."""

    flush: int = 8 << 20
    rows: int = 200_000
    part: int = 200_000
    hot: int = 50_000


NO_ID = np.iinfo(np.int64).max
#: Bits of a document's second name, of a window's place in its text, and of a run's length.
TAG, PLACE, COUNT = 25, 31, 6
RUN = "a long, b long, id long, tag int"
MARK = "kind int, id long, tag int, s int, e int, other long, otag int, os int"
STRETCH = "key long, id long, tag int, s int, e int, bytes binary"
SPAN = "id long, tag int, s int, e int"
DONE, CLAIM, ASK = 0, 1, 2


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    """Columns as a batch with the names and types of a schema of numbers, or a ready array."""
    types = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [c if isinstance(c, pa.Array) else pa.array(np.asarray(c).astype(np.int64), pa.int64()).cast(types[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def parts(batches: Iterator[pa.RecordBatch], shift: int, rows: int, hot: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A stream sorted by its first column, cut into batches of about rows, each with a mask of its hot rows.

    Rows whose first column is alike but for its last shift bits are a group, and stay together. But a group of over hot
    rows is cut where the whole column changes; all its rows are hot.
    """
    held: list[pa.RecordBatch] = []
    size, wait, open_ = 0, rows, None

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < wait:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        full = whole.column(0).to_numpy().view(np.uint64)
        group = full >> np.uint64(shift)
        change = np.flatnonzero(group[1:] != group[:-1])
        if not len(change) and hot is not None and size > hot:
            change = np.flatnonzero(full[1:] != full[:-1])
            open_ = group[0] if len(change) else open_
        end = int(change[-1]) + 1 if len(change) else 0
        held, wait = [whole.slice(end)], max(rows, 2 * (size - end))
        size -= end
        if end:
            yield whole.slice(0, end), group[:end] == open_ if open_ is not None else np.zeros(end, bool)
    if size:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        group = whole.column(0).to_numpy().view(np.uint64) >> np.uint64(shift)
        yield whole, group == open_ if open_ is not None else np.zeros(len(group), bool)


def numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The columns of a batch of numbers; nulls are 0."""
    return [c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns]


def smallest(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w successive values."""
    out, span = x.copy(), 1
    while span < w:
        step = min(span, w - span)
        out[:-step] = np.minimum(out[:-step], out[step:])
        span += step
    return out[: len(x) - w + 1]


def runs(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text number, first and last window start (in the buffer) of every run."""
    n, w = len(texts.buf), LENGTH - GRAM + 1
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    view = eights(texts.buf)
    least = smallest(mix(view[: n - GRAM + 1] + mix(view[8 : n - GRAM + 9])), w)
    sizes = np.diff(texts.off)
    inside = np.zeros(n + 1, np.int8)  # window starts of texts that are long enough
    long = sizes >= LENGTH
    np.add.at(inside, texts.off[:-1][long], 1)
    np.add.at(inside, texts.off[1:][long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
    if not len(at):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    key = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    # where a text repeats itself its grams tie: such a run is cut
    new |= (np.arange(len(at)) - begin[np.cumsum(new) - 1]) % w == 0
    begin = np.flatnonzero(new)
    s, e = at[begin], at[np.append(begin[1:], len(at)) - 1]
    return mix(key[begin]), texts.doc_of(s), s, e


def equal_spans(buf: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from x and from y are the same, so many of each."""
    out, view, own, at = np.ones(len(x), bool), eights(buf), np.flatnonzero(size > 0), 0
    while len(own):
        left = size[own] - at
        same = (view[x[own] + at] ^ view[y[own] + at]) & FILLED[np.minimum(left, 8)] == 0
        out[own[~same]] = False
        own = own[same & (left > 8)]
        at += 8
    return out


def heads(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows, which begin a group of equal keys; the first row of each row's group."""
    new = np.ones(len(keys[0]), bool)
    for k in keys if len(new) else ():
        new[1:] &= k[1:] == k[:-1]
    new[1:] = ~new[1:]
    first = np.flatnonzero(new)
    return new, first[np.cumsum(new) - 1] if len(first) else first


def merged(ids: np.ndarray, tags: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Spans s..e of documents, joined where they meet."""
    order = np.lexsort((s, tags, ids))
    ids, tags, s, e = ids[order], tags[order], s[order], e[order]
    if not len(s):
        return [ids, tags, s, e]
    new, _ = heads(ids, tags)
    # furthest end so far, within a document: documents are lifted apart
    lift = (np.cumsum(new) - 1).astype(np.int64) * (int(e.max()) + 2)
    far = np.maximum.accumulate(e + lift)
    new[1:] |= (s + lift)[1:] > far[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(s)) - 1
    return [ids[at], tags[at], s[at], far[last] - lift[last]]


def send_runs(bounds: Bounds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, tag, text: the runs of texts, a row each; spans that an earlier document of the same flush covers."""
    held: list[tuple[Texts, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found, at, doc = [], 0, 0
        for texts, _, _ in held:
            anchor, number, s, e = runs(texts)
            found.append((anchor, span_codes(texts.buf, s, e + LENGTH), number + doc, s + at, e + at))
            at, doc = at + len(texts.buf), doc + texts.n
        buf = np.concatenate([t.buf for t, _, _ in held])
        ids, tags = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        begin = np.cumsum([0, *[x for t, _, _ in held for x in np.diff(t.off).tolist()]])
        anchor, kind, number, s, e = map(np.concatenate, zip(*found, strict=True))
        held.clear()
        # equal runs of a greater id, compared byte by byte with the one of the smallest
        order = np.lexsort((ids[number], kind, anchor))
        _, first = heads(anchor[order], kind[order])
        maybe = np.flatnonzero(ids[number[order]] > ids[number[order[first]]])
        x, y = order[maybe], order[first[maybe]]
        x = x[(e[x] - s[x] == e[y] - s[y]) & equal_spans(buf, s[x], s[y], np.minimum(e[x] - s[x], e[y] - s[y]) + LENGTH)]
        own = number[x]
        done = merged(ids[own], tags[own], s[x] - begin[own], e[x] - begin[own] + LENGTH)
        stay = np.ones(len(s), bool)
        stay[x] = False
        anchor, kind, number, s, e = (v[stay] for v in (anchor, kind, number, s, e))
        a = (anchor & ~np.uint64(0xFFFF)) | (kind >> np.uint64(48))
        part = ((kind >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.int64)
        b = part << (PLACE + COUNT) | (s - begin[number]) << COUNT | (e - s)
        # a covered span: b is negative, and tells its start and length; a spreads it over the tasks
        spans = -1 - (done[2] << PLACE | (done[3] - done[2]))
        spread = mix(done[0].astype(np.uint64) ^ spans.astype(np.uint64))
        cat = np.concatenate
        return batch_of(RUN, cat([a, spread]).view(np.int64), cat([b, spans]), cat([ids[number], done[0]]), cat([tags[number], done[1]]))

    for batch in batches:
        ids, tags = numbers(batch.select(["id", "tag"]))
        for lo, hi, texts in chunks(batch, "text"):
            held.append((texts, ids[lo:hi], tags[lo:hi].astype(np.int64)))
            size += len(texts.buf)
            if size >= bounds.flush:
                yield flush()
                size = 0
    if held:
        yield flush()


def settle(bounds: Bounds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by anchor, claims and questions; spans that are covered already pass."""
    for batch, cut in parts(batches, 16, bounds.rows, bounds.hot):
        a, b, ids, tags = numbers(batch)
        done, run = np.flatnonzero(b < 0), np.flatnonzero(b >= 0)
        span = -1 - b[done]
        s = span >> PLACE
        z = np.zeros(len(done), np.int64)
        yield batch_of(MARK, z + DONE, ids[done], tags[done], s, s + (span & ((1 << PLACE) - 1)), z, z, z)
        a, b, ids, tags, cut = a[run].view(np.uint64), b[run], ids[run], tags[run], cut[run]
        anchor = a >> np.uint64(16)
        kind = ((a & np.uint64(0xFFFF)) << np.uint64(24)) | (b >> (PLACE + COUNT)).astype(np.uint64)
        s = (b >> COUNT) & ((1 << PLACE) - 1)
        e = s + (b & ((1 << COUNT) - 1)) + LENGTH
        order = np.lexsort((s, ids, kind, anchor))
        anchor, kind, s, e, ids, tags, cut = (x[order] for x in (anchor, kind, s, e, ids, tags, cut))
        new_a, _ = heads(anchor)
        new, first = heads(anchor, kind)
        x = np.flatnonzero(ids > ids[first])
        y = first[x]
        z = np.zeros(len(x), np.int64)
        yield batch_of(MARK, z + CLAIM, ids[x], tags[x], s[x], e[x], ids[y], tags[y], s[y])
        # of each kind, the runs of its smallest document: one suffices as a source, but each place can itself be covered
        # by another kind's
        group = np.cumsum(new_a) - 1
        n = int(group[-1]) + 1 if len(group) else 0
        least, most = np.full(n, NO_ID), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, group, ids)
        np.maximum.at(most, group, ids)
        hot = cut | (np.bincount(group, minlength=n) > bounds.hot)[group]
        ask = (ids == ids[first]) & (hot | ((np.bincount(group[new], minlength=n) > 1) & (least < most))[group])
        z = np.zeros(int(ask.sum()), np.int64)
        yield batch_of(MARK, z + ASK, ids[ask], tags[ask], s[ask], e[ask], anchor[ask], hot[ask], z)


def join_claims(bounds: Bounds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted by document, with claims of one document on another that continue each other made one."""
    for batch, _ in parts((b.select(["id", *[c for c in b.schema.names if c != "id"]]) for b in batches), 0, bounds.rows):
        ids, kind, tags, s, e, other, otag, os = numbers(batch)
        off = os - s
        order = np.lexsort((s, off, otag, other, tags, ids, kind))
        kind, ids, tags, s, e, other, otag, off = (x[order] for x in (kind, ids, tags, s, e, other, otag, off))
        new, _ = heads(kind, ids, tags, other, otag, off)
        new |= kind != CLAIM
        new[1:] |= s[1:] > e[:-1]
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(s)) - 1
        yield batch_of(MARK, kind[at], ids[at], tags[at], s[at], e[last], other[at], otag[at], s[at] + off[at])


def gathered(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after the other."""
    before = np.cumsum(size) - size
    return buf[np.repeat(start - before, size) + np.arange(int(size.sum()))]


def binaries(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(gathered(buf, start, size))])


#: Stretches, and windows, that are made at once.
AT_ONCE = 50_000


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, tag, text, asks: the stretches that are asked for. Windows of hot anchors go by their own bytes, less those
    that a smaller document of the same chunk covers."""
    for batch in batches:
        ids, tags = numbers(batch.select(["id", "tag"]))
        asks = batch.column(batch.schema.get_field_index("asks"))
        off, fields = asks.offsets.to_numpy(), [asks.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
        for lo, hi, texts in chunks(batch, "text"):
            count = np.diff(off[lo : hi + 1])
            row = np.repeat(np.arange(hi - lo), count)
            s, e, anchor, hot = (f[off[lo] : off[hi]].astype(np.int64) for f in fields)
            start, own, tag = texts.off[row] + s, ids[lo:hi][row], tags[lo:hi][row]
            for k in np.array_split(np.flatnonzero(hot == 0), max(1, len(s) // AT_ONCE)):
                yield batch_of(STRETCH, anchor[k], own[k], tag[k], s[k], e[k], binaries(texts.buf, start[k], e[k] - s[k]))
            k = np.flatnonzero(hot)
            if not len(k):
                continue
            m = e[k] - s[k] - LENGTH + 1
            w = np.repeat(k, m)
            step = np.arange(len(w)) - np.repeat(np.cumsum(m) - m, m)
            at, place = start[w] + step, s[w] + step
            key = span_codes(texts.buf, at, at + LENGTH)
            order = np.lexsort((own[w], key))
            _, first = heads(key[order])
            maybe = np.flatnonzero(own[w[order]] > own[w[order[first]]])
            x, y = order[maybe], order[first[maybe]]
            x = x[equal_spans(texts.buf, at[x], at[y], np.full(len(x), LENGTH))]
            spans = merged(own[w[x]], tag[w[x]], place[x], place[x] + LENGTH)
            spread = mix(spans[0].astype(np.uint64) ^ spans[2].astype(np.uint64)).view(np.int64)
            yield batch_of(STRETCH, spread, *spans, pa.nulls(len(spread), pa.binary()))
            stay = np.ones(len(w), bool)
            stay[x] = False
            for j in np.array_split(np.flatnonzero(stay), max(1, len(w) // AT_ONCE)):
                yield batch_of(STRETCH, key[j].view(np.int64), own[w[j]], tag[w[j]], place[j], place[j] + LENGTH, binaries(texts.buf, at[j], np.full(len(j), LENGTH)))


def extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common bytes of the strings of LENGTH bytes at x and at y: binary search over prefix hashes."""
    lo, step = np.zeros(len(x), np.int64), 1 << (LENGTH.bit_length() - 1)
    while step:
        longer = lo + step
        fits = longer <= LENGTH
        end = np.where(fits, longer, 0)
        same = fits & (span_hash(prefix, x, x + end) == span_hash(prefix, y, y + end))
        lo = np.where(same, longer, lo)
        step >>= 1
    return lo


class Suffixes:
    """Strings of LENGTH bytes at places of a buffer, compared by hashes. Two of equal whole hash are equal; else eight
    bytes behind the LEAD that a group has in common mostly tell, and the common extension where these are equal too."""

    LEAD = 12

    def __init__(self, buf: np.ndarray, prefix: np.ndarray, at: np.ndarray):
        self.buf, self.prefix, self.at = buf, prefix, at
        self.whole = span_hash(prefix, at, at + LENGTH)
        self.key = np.zeros(len(at), np.uint64)
        for j in range(8):
            self.key = (self.key << np.uint64(8)) | buf[at + self.LEAD + j]

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """x before y, by numbers of suffixes of one group; where or_equal, or equal to it."""
        kx, ky = self.key[x], self.key[y]
        out = kx < ky
        tie = np.flatnonzero(kx == ky)
        same = self.whole[x[tie]] == self.whole[y[tie]]
        out[tie[same]] = or_equal[tie[same]]
        tie = tie[~same]
        if len(tie):
            px, py = self.at[x[tie]], self.at[y[tie]]
            common = np.minimum(extension(self.prefix, px, py), LENGTH - 1)
            out[tie] = self.buf[px + common] < self.buf[py + common]
        return out


def suffix_order(suffixes: Suffixes, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by group and then by their first LENGTH bytes: a mergesort of all groups at
    once. Returns the order and the sorted groups' starts."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(g)))
    mine = np.cumsum(new) - 1
    inside = np.arange(len(g)) - first[mine]
    width = 1
    while len(size) and width < size.max():
        # places whose run of this width has a sibling
        k = np.flatnonzero(size[mine] > width)
        run = inside[k] // width
        begin = first[mine[k]] + (run ^ 1) * width  # of the sibling
        stop = np.minimum(begin + width, first[mine[k]] + size[mine[k]])
        has = begin < stop
        k, run, begin, stop = k[has], run[has], begin[has], stop[has]
        right = (run & 1).astype(bool)
        # in the sibling, how many stand before: lesser ones for the left run, lesser or equal ones for the right
        lo, hi = begin.copy(), stop.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            before = suffixes.less(order[mid], order[k[open_]], right[open_])
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        pair = first[mine[k]] + (run & ~1) * width
        own = k - (first[mine[k]] + run * width)
        moved = order.copy()
        moved[pair + own + (lo - begin)] = order[k]
        order = moved
        width *= 2
    return order, new


def compare(bounds: Bounds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans among stretches sorted by key, part by part: a part has whole keys, and about bounds.part windows."""
    for batch, _ in parts(batches, 0, bounds.rows // 4):
        bare = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        key, ids, tags, s, e = numbers(batch.select(range(5)))
        yield batch_of(SPAN, ids[bare], tags[bare], s[bare], e[bare])
        full = np.flatnonzero(~bare)
        _, own = heads(key[full])
        some = np.bincount(own, minlength=len(full))[own] > 1  # alone with its key: nothing to meet
        full = full[some]
        if not len(full):
            continue
        key, ids, tags, s, size = key[full].view(np.uint64), ids[full], tags[full], s[full], (e - s)[full]
        whole = batch.column(5)
        off = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
        start = off[full]
        buf = np.frombuffer(whole.buffers()[2], np.uint8)
        windows = np.cumsum(size - LENGTH + 1)
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
        lo = 0
        while lo < len(key):
            before = windows[lo - 1] if lo else 0
            k = np.searchsorted(windows[ends - 1], before + bounds.part, side="right")
            hi = int(ends[min(max(k - 1, np.searchsorted(ends, lo, side="right")), len(ends) - 1)])
            spans = covered_windows(key[lo:hi], ids[lo:hi], tags[lo:hi], s[lo:hi], size[lo:hi], gathered(buf, start[lo:hi], size[lo:hi]))
            if len(spans[0]):
                yield batch_of(SPAN, *spans)
            lo = hi


def covered_windows(anchor: np.ndarray, ids: np.ndarray, tags: np.ndarray, s: np.ndarray, size: np.ndarray, buf: np.ndarray) -> list[np.ndarray]:
    """Documents' spans of windows that also stand in a smaller document's stretch of the same anchor."""
    start = np.cumsum(size) - size
    m = size - LENGTH + 1
    own = np.repeat(np.arange(len(m)), m)
    step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    at = start[own] + step
    prefix = prefix_hashes(BYTE_CODES[buf])
    group = mix(anchor)[own] ^ span_hash(prefix, at, at + Suffixes.LEAD)
    some = repeated(group)  # windows that are alone in their group need no sort
    own, step, at, group = own[some], step[some], at[some], group[some]
    if not len(at):
        return merged(*[np.zeros(0, np.int64)] * 4)
    suffixes = Suffixes(buf, prefix, at)
    order, new = suffix_order(suffixes, group)
    x, y = at[order[:-1]], at[order[1:]]
    same = ~new[1:] & (suffixes.whole[order[:-1]] == suffixes.whole[order[1:]])
    k = np.flatnonzero(same)
    for lo in range(0, len(k), 100_000):  # verified byte by byte
        part = k[lo : lo + 100_000]
        span = np.arange(LENGTH)
        same[part] = (buf[x[part, None] + span] == buf[y[part, None] + span]).all(1)
    klass = np.cumsum(np.concatenate([[True], ~same])) - 1
    d = ids[own[order]]
    least = np.full(int(klass[-1]) + 1, NO_ID)
    np.minimum.at(least, klass, d)
    hit = order[d > least[klass]]
    o = own[hit]
    place = s[o] + step[hit]
    return merged(ids[o], tags[o], place, place + LENGTH)


def verified(raw: bytes, s: int, e: int, claim: bytes | None) -> list[tuple[int, int]]:
    """Which bytes of a covered span are covered, given the bytes that it is claimed to equal: all, if they do, else
    those in stretches of LENGTH equal ones or more."""
    if claim is None or raw[s:e] == claim:
        return [(s, e)]
    n = min(e - s, len(claim))
    same = np.frombuffer(raw, np.uint8, n, s) == np.frombuffer(claim, np.uint8, n)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]]).astype(np.int8)))
    return [(s + a, s + b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= LENGTH]


def cut(raw: bytes, spans: list[tuple[int, int, bytes | None]], characters: bool) -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of a text, and its removed spans; characters: a code point that loses a byte is lost whole."""
    out: list[list[int]] = []
    for a, b in sorted(x for span in spans for x in verified(raw, *span)):
        if characters:
            while 0 < a < len(raw) and raw[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    kept, at = [], 0
    for a, b in out:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), [(a, b) for a, b in out]


def finish(digest: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row (a struct of a document's columns), spans: the documents less what is covered."""
    for batch in batches:
        row, spans = batch.column(0), batch.column(1)
        names = row.type.names
        columns = dict(zip(names, row.flatten(), strict=True))
        texts = pa.RecordBatch.from_pydict({"text": columns["text"]})
        for lo, hi, own in chunks(texts, "text"):
            todo = [[(x["s"], x["e"], x["bytes"]) for x in v or ()] for v in spans.slice(lo, hi - lo).to_pylist()]
            found = [cut(own.text(i), x, not digest) for i, x in enumerate(todo)]
            part = {c: v.slice(lo, hi - lo) for c, v in columns.items()}
            if digest:
                cols = {
                    "doc_id": part["doc_id"].cast(pa.int64()),
                    "n_bytes": pa.array(np.diff(own.off)),
                    "n_removed": pa.array([sum(b - a for a, b in x) for _, x in found], pa.int64()),
                    "n_spans": pa.array([len(x) for _, x in found], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t, _ in found], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(cols)
                continue
            old = part["text"].to_pylist()
            new = [o if not x else t.decode("utf-8", "ignore") for o, (t, x) in zip(old, found, strict=True)]
            part["text"] = pa.array(new, part["text"].type)
            if "n_chars" in part and pa.types.is_integer(part["n_chars"].type):
                count = [o if not x else len(t) for o, t, (_, x) in zip(part["n_chars"].to_pylist(), new, found, strict=True)]
                part["n_chars"] = pa.array(count, part["n_chars"].type)
            fields = [row.type.field(i) for i in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([part[c] for c in names], fields=fields)], ["row"])


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def mapped(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """fn on the stream of df's batches; Arrow gives back at the end of a task what making its batches took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def marks(named: DataFrame, bounds: Bounds) -> DataFrame:
    """Of documents (id, tag, text): covered spans, claims on other documents, questions."""
    rows = mapped(named.select("id", "tag", "text"), lambda it: send_runs(bounds, it), RUN)
    rows = rows.repartition(F.shiftrightunsigned("a", 16)).sortWithinPartitions("a")
    rows = mapped(rows, lambda it: settle(bounds, it), MARK)
    rows = rows.repartition("id", "tag").sortWithinPartitions("id", "tag")
    return mapped(rows, lambda it: join_claims(bounds, it), MARK)


def deduplicated(docs: DataFrame, digest: bool = False, bounds: Bounds | None = None) -> DataFrame:
    """docs less every byte covered by a LENGTH-byte string that also starts in a document of smaller doc_id.

    Strings are judged on the input. A code point that loses some of its bytes is lost whole. n_chars, where docs has it
    as an integer, becomes the number of code points left of a text that lost some. digest: instead, doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs) and kept_sha256, of bytes. Null texts are empty and stay null; null ids
    count as 2**63 - 1, greater than all others; rows of equal id never take from one another, and are told apart by
    TAG bits of a hash of their texts. Every row stays, if need be with an empty text. All other columns are kept,
    whatever their names.
    """
    bounds = bounds or Bounds()
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    named = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << TAG) - 1)).cast("int").alias("tag"),
        text.alias("text"),
        *([] if digest else [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]),
    )
    found = written(marks(named, bounds), "marks")
    texts = named.select("id", "tag", "text")
    asks = found.where(F.col("kind") == ASK).groupBy("id", "tag").agg(F.collect_list(F.struct("s", "e", "other", "otag")).alias("asks"))
    asked = mapped(texts.join(asks, ["id", "tag"]).select("id", "tag", "text", "asks"), stretches, STRETCH)
    met = mapped(asked.repartition("key").sortWithinPartitions("key"), lambda it: compare(bounds, it), SPAN)
    claims = found.where(F.col("kind") == CLAIM).select(F.col("id").alias("own"), F.col("tag").alias("own_tag"), "s", "e", F.col("other").alias("id"), F.col("otag").alias("tag"), "os")
    claims = claims.join(texts, ["id", "tag"]).select(
        F.col("own").alias("id"), F.col("own_tag").alias("tag"), "s", "e", F.substring(F.col("text").cast("binary"), F.col("os") + 1, F.col("e") - F.col("s")).alias("bytes")
    )
    done = found.where(F.col("kind") == DONE).select("id", "tag", "s", "e").unionByName(met).withColumn("bytes", F.lit(None).cast("binary"))
    spans = claims.unionByName(done).groupBy("id", "tag").agg(F.collect_list(F.struct("s", "e", "bytes")).alias("spans"))
    whole = named.join(spans, ["id", "tag"], "left")
    if digest:  # of the columns that the other joins deal, so that documents are dealt once
        row = F.struct(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text").alias("row")
        return mapped(whole.select(row, "spans"), lambda it: finish(True, it), DIGEST)
    return mapped(whole.select("row", "spans"), lambda it: finish(False, it), whole.select("row").schema).select("row.*")
