"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import WORD_BYTES, Texts, Words, chunks, run_hashes

SHINGLE = 5
#: Bytes of benchmark text that are indexed and sent to the executors at once; more text makes more blocks.
BLOCK_BYTES = 8 << 20
SCHEMA = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def folded(texts: Texts) -> Texts:
    """A-Z and the capital letters of Latin-1 lower-cased."""
    out = texts.lower()
    b = out.buf
    if len(b) > 1:
        up = np.zeros(len(b), bool)
        up[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        out.buf = b + up.astype(np.uint8) * np.uint8(32)
    return out


def grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of size words of one text."""
    n = len(words.s) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    i = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    return i, run_hashes(words.hash, size)[i]


class Index:
    """Items of a block by their smallest shingle hashes.

    An item of n distinct shingles of which a text holds the fraction t misses at most n - ceil(t n) of them there, so
    the text holds one at least of its n - ceil(t n) + 1 smallest hashes. Items are partitioned by powers of two of n;
    a partition's signature has as many MinHash values as its largest n needs, so no item is lost.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float):
        self.threshold, self.ids, self.full, self.words = threshold, [], [], []
        key, item = [], []
        texts = folded(Texts.of([t for _, t in items]))
        words = Words(texts, WORD_BYTES)
        sizes = {k: grams(words, k) for k in {min(SHINGLE, int(c)) for c in words.count if c}}
        self.sizes = sorted(sizes)
        for x in np.flatnonzero(words.count):
            size = min(SHINGLE, int(words.count[x]))
            i, h = sizes[size]
            lo, hi = np.searchsorted(words.doc[i], [x, x + 1])
            own = np.unique(h[lo:hi])
            signature = self.signature(len(own))
            key.append(own[: min(len(own), signature)])
            item.append(np.full(len(key[-1]), len(self.ids)))
            self.ids.append(items[x][0])
            self.full.append(own)
            spoken = words.bytes(int(words.first[x]), int(words.count[x]))
            self.words.append({tuple(spoken[j : j + size]) for j in range(len(spoken) - size + 1)})
        key = np.concatenate(key) if key else np.zeros(0, np.uint64)
        item = np.concatenate(item) if item else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.item = key[order], item[order]

    def signature(self, n: int) -> int:
        top = (1 << n.bit_length()) - 1  # largest n of the partition
        return top - int(np.ceil(self.threshold * top - 1e-9)) + 1

    def matches(self, texts: Texts) -> list[tuple[int, int, int, int]]:
        """Text, item, shingles of the item, of these in the text."""
        words = Words(folded(texts), WORD_BYTES)
        pairs, own, starts = [], [], []
        for size in self.sizes:
            i, h = grams(words, size)
            own.append((words.doc[i], h))
            starts.append(i)
            if not len(self.key):
                continue
            lo = np.searchsorted(self.key, h, "left")
            hit = np.flatnonzero(self.key[np.minimum(lo, len(self.key) - 1)] == h)
            lo, hi = lo[hit], np.searchsorted(self.key, h[hit], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pairs.append(np.unique(np.stack([np.repeat(words.doc[i[hit]], n), self.item[at]]), axis=1))
        if not pairs:
            return []
        out = []
        for doc, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T:
            size = len(next(iter(self.words[item])))
            d, h = own[self.sizes.index(size)]
            lo, hi = np.searchsorted(d, [doc, doc + 1])
            total = len(self.full[item])
            if np.isin(self.full[item], h[lo:hi]).sum() < self.threshold * total - 1e-9:
                continue
            # the words of these places alone
            at = starts[self.sizes.index(size)][lo:hi][np.isin(h[lo:hi], self.full[item])]
            there = {tuple(words.bytes(int(j), size)) for j in at}
            found, total = len(self.words[item] & there), len(self.words[item])
            if found >= self.threshold * total - 1e-9:
                out.append((int(doc), int(item), total, found))
        return out


def indexes(items: DataFrame, threshold: float, block_bytes: int) -> Iterator[Index]:
    """Indexes of the benchmark's blocks, each built from at most about block_bytes of text on the driver."""
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield Index([tuple(r) for r in block.collect()], threshold)


def uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those for which contamination() has a row; nothing is shuffled, null and empty texts stay.

    A document that reaches the threshold exactly goes. Equal rows are judged alike, so all of them stay or go; all
    columns stay as they are, whatever their names; an empty benchmark or table takes nothing out."""
    for index in indexes(items, threshold, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, texts in chunks(batch, "text"):
                keep[[lo + d for d, *_ in sent.value.matches(texts)]] = False
            yield batch.filter(pa.array(keep))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item of whose five-word shingles it holds the fraction threshold.

    Words are lower-cased runs of letters and digits. An item of fewer than five words is one shingle of them all; an
    item without words matches nothing, nor does a null or empty document. Equal items and equal documents each give
    their own rows. The benchmark is indexed in blocks of block_bytes of text, each sent to the executors and held
    against all documents, so that nothing sent grows with either table; documents are never shuffled.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    parts = []
    for index in indexes(items, threshold, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            for lo, _, texts in chunks(batch, "text"):
                if rows := sent.value.matches(texts):
                    ids = batch.column(0)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([ids[lo + d].as_py() for d, *_ in rows], pa.int64()),
                            "item_id": pa.array([sent.value.ids[i] for _, i, *_ in rows], pa.int64()),
                            "n_shingles": pa.array([t for *_, t, _ in rows], pa.int64()),
                            "n_found": pa.array([f for *_, f in rows], pa.int64()),
                            "containment": pa.array([f / t for *_, t, f in rows], pa.float64()),
                        }
                    )

        parts.append(map_arrow(own, run, SCHEMA))
    return reduce(DataFrame.unionByName, parts)
