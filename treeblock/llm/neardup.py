"""Near-duplicates of documents: BagMinHash signatures, bands, exact multiset overlap, connected classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, removed, written
from .contamination import folded
from .kernels import WORD_BYTES, Texts, Words, chunks, mix, shingles

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of a signature and registers of a band: a pair at the threshold shares a band but for 3 in a million times.
BANDS, ROWS = 24, 4


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text: text numbers, hashes, multiplicities."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    return d[at], x[at], np.diff(np.append(at, len(d)))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the leading 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def bag_min_hash(doc: np.ndarray, x: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """n signatures of m registers of weighted sets. Two registers of one place agree with the probability of the sets'
    weighted Jaccard similarity.

    Each element has a Poisson process over time and weight: for weights [0, 1), [1, 2), [2, 4), [4, 8) ... one stream
    of points each, at a rate that is the interval's width; a point has a register and a weight, and counts where that
    lies under the element's own weight. A register holds the earliest point that counts. Streams are followed up to a
    time by which a set of the whole weight has a point in all registers but for rare cases; these are followed further.
    """
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    at = np.repeat(np.arange(len(x)), levels)
    k = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(k > 0, 2.0 ** (k - 1), 1.0)
    low = np.where(k > 0, width, 0.0)
    stream = mix(x[at] + mix(k.astype(np.uint64)))
    owner, limit = doc[at], weight[at]
    total = np.bincount(doc, weight, n)
    until = m * (np.log(m) + 5) / np.maximum(total, 1)
    time = np.full(n * m, np.inf)
    point = np.zeros(n * m, np.uint64)
    since = np.zeros(len(at))
    count = np.zeros(len(at), np.uint64)
    alive = np.arange(len(at))
    seed = mix(stream)
    since = -np.log(uniform(seed)) / width
    wanted = total > 0
    while wanted.any():
        alive = np.flatnonzero(wanted[owner] & (since <= until[owner]))
        while len(alive):
            r = mix(seed[alive] + np.uint64(0x632BE59BD9B4E019))
            register = (r % np.uint64(m)).astype(np.int64)
            level = low[alive] + uniform(mix(r)) * width[alive]
            own = np.flatnonzero(level <= limit[alive])
            slot = owner[alive[own]] * m + register[own]
            t = since[alive[own]]
            late = np.argsort(-t, kind="stable")
            slot, t, who = slot[late], t[late], r[own][late]
            earlier = t < time[slot]
            slot, t, who = slot[earlier], t[earlier], who[earlier]
            time[slot] = t  # of several, the last, earliest one stays
            point[slot] = who
            count[alive] += np.uint64(1)
            seed[alive] = mix(stream[alive] + count[alive] * np.uint64(0x9E3779B97F4A7C15))
            since[alive] += -np.log(uniform(seed[alive])) / width[alive]
            alive = alive[since[alive] <= until[owner[alive]]]
        wanted &= np.isinf(time.reshape(n, m)).any(1)
        until[wanted] *= 2
    return point.reshape(n, m)


def signed(docs: DataFrame) -> DataFrame:
    """id, node and bands of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, texts in chunks(batch, "text", 1 << 19):
            low = folded(texts)
            words = Words(low, WORD_BYTES)
            doc, x, weight = counted(*shingles(words, SHINGLE))
            registers = bag_min_hash(doc, x, weight, texts.n, BANDS * ROWS).reshape(texts.n, BANDS, ROWS)
            band = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), (texts.n, BANDS)).copy()
            for j in range(ROWS):
                band = mix(band + registers[:, :, j]).reshape(texts.n, BANDS)
            flat = pa.array(band.astype(np.int64).reshape(-1))
            offsets = np.concatenate([[0], np.cumsum((words.count > 0) * BANDS)]).astype(np.int32)
            keep = np.repeat(words.count > 0, BANDS)
            bands = pa.ListArray.from_arrays(pa.array(offsets), flat.filter(pa.array(keep)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(lo, hi - lo), "node": pa.array(words.digests(), pa.binary()), "bands": bands})

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "id long, node binary, bands array<long>")


def with_nodes(docs: DataFrame) -> DataFrame:
    """id, row (a struct of all columns) and node of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, texts in chunks(batch, "text"):
            low = folded(texts)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(Words(low, WORD_BYTES).digests(), pa.binary())], ["id", "row", "node"])

    return map_arrow(rows, run, rows.select("id", "row").schema.add("node", "binary"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """A text of every node, compressed; tasks send one each."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for _, _, texts in chunks(batch, "text"):
            low = folded(texts)
            packed = [z.compress(low.text(i)) for i in range(texts.n)]
            yield pa.RecordBatch.from_pydict({"node": pa.array(Words(low, WORD_BYTES).digests(), pa.binary()), "packed": pa.array(packed, pa.binary())})

    return map_arrow(docs.select("text"), run, "node binary, packed binary").groupBy("node").agg(F.any_value("packed").alias("packed")).withColumn("size", F.octet_length("packed"))


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    n = len(left)
    words = Words(folded(Texts.of([*left, *right])), WORD_BYTES)
    doc, x, weight = counted(*shingles(words, SHINGLE))
    key = mix(x ^ mix((doc % n).astype(np.uint64)))
    total = np.bincount(doc % n, weight, n)
    side = doc >= n
    _, a, b = np.intersect1d(key[~side], key[side], assume_unique=True, return_indices=True)
    both = np.minimum(weight[~side][a], weight[side][b])
    shared = np.bincount(doc[~side][a], both, n)
    return shared / np.maximum(total - shared, 1)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs a, b of nodes with whether their texts are as similar as threshold."""
    of = lambda side: texts.select(F.col("node").alias(side), F.col("packed").alias(f"{side}_text"))
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_text", "b_text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        a, b, at, bt = (batch.column(i) for i in range(4))
        size, lo = 0, 0
        for i in range(batch.num_rows + 1):
            if i == batch.num_rows or size > 1 << 20:
                if i > lo:
                    left, right = ([z.decompress(x.as_py()) for x in c.slice(lo, i - lo)] for c in (at, bt))
                    like = overlaps(left, right) >= threshold - 1e-9
                    yield pa.RecordBatch.from_pydict({"a": a.slice(lo, i - lo), "b": b.slice(lo, i - lo), "alike": pa.array(like)})
                lo, size = i, 0
            if i < batch.num_rows:
                size += 3 * (len(at[i].as_buffer()) + len(bt[i].as_buffer()))

    return map_arrow(rows, run, "a binary, b binary, alike boolean")


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in links (a, b): the least node of its component. Labels fall to the least among
    neighbours and then to the label's own label, until nothing changes; every round is written."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        next_ = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        next_ = next_.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        next_ = written(next_, "labels")
        removed(labels)
        labels = next_.select("node", "label")
        if next_.where("label < old").isEmpty():
            removed(edges)
            return labels


#: Nodes of a block, in which all pairs are compared at once; shingles of a slice of that comparison.
BLOCK, SLICE = 256, 1 << 15
#: Packed bytes of a block's texts, but for chance and single larger texts.
BLOCK_BYTES = 4 << 20


class Bags:
    """The shingle multisets of a block's texts as a set each: the i-th copy of a shingle is an element of its own."""

    def __init__(self, texts: list[bytes]):
        words = Words(folded(Texts.of(texts)), WORD_BYTES)
        doc, x, weight = counted(*shingles(words, SHINGLE))
        copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        self.doc = np.repeat(doc, weight)
        self.element = mix(np.repeat(x, weight) + mix(copy.astype(np.uint64)))
        self.size = np.bincount(self.doc, minlength=len(texts)).astype(np.float32)


def similarities(a: Bags, b: Bags) -> np.ndarray:
    """Weighted Jaccard similarity of every text of a with every one of b: products of incidence matrices, slice by
    slice of the elements that both have."""
    common = np.intersect1d(a.element, b.element)
    shared = np.zeros((len(a.size), len(b.size)), np.float32)
    sides = []
    for bag in (a, b):
        k = np.minimum(np.searchsorted(common, bag.element), max(0, len(common) - 1))
        has = common[k] == bag.element if len(common) else np.zeros(len(bag.element), bool)
        sides.append((bag.doc[has], k[has]))
    for lo in range(0, len(common), SLICE):
        width = min(SLICE, len(common) - lo)
        parts = []
        for bag, (doc, k) in zip((a, b), sides, strict=True):
            own = (k >= lo) & (k < lo + width)
            m = np.zeros((len(bag.size), width), np.float32)
            m[doc[own], k[own] - lo] = 1
            parts.append(m)
        shared += parts[0] @ parts[1].T
    return shared / np.maximum(a.size[:, None] + b.size[None] - shared, 1)


def blocked(meeting: DataFrame, sizes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links a, b between nodes of different labels in the buckets of sizes: all pairs are compared, by pairs of blocks
    of about BLOCK nodes; of the links of two blocks, a forest that connects as much."""
    rows = meeting.join(sizes.select("bucket"), "bucket")
    large = rows.join(texts.select("node", "size"), "node").groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    rows = rows.join(large, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.join(texts, "node").groupBy("bucket", "block").agg(F.collect_list(F.struct("node", "label", "packed")).alias("members"))
    other = rows.select("bucket", F.col("block").alias("block_b"), F.col("members").alias("members_b"))
    pairs = rows.join(other, "bucket").where("block <= block_b").select(F.col("members"), F.when(F.col("block") < F.col("block_b"), F.col("members_b")).alias("members_b"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for left, right in zip(batch.column(0), batch.column(1), strict=True):
            a = left.as_py()
            b = right.as_py() if right.is_valid else a
            bag_a = Bags([z.decompress(m["packed"]) for m in a])
            bag_b = bag_a if b is a else Bags([z.decompress(m["packed"]) for m in b])
            i, j = np.nonzero(similarities(bag_a, bag_b) >= threshold - 1e-6)
            parent: dict[bytes, bytes] = {}

            def root(x: bytes, parent=parent) -> bytes:
                while parent.setdefault(x, x) != x:
                    x = parent[x]
                return x

            found = []
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                x, y = root(a[p]["label"]), root(b[q]["label"])
                if x != y:
                    parent[x] = y
                    found.append((a[p]["node"], b[q]["node"]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return map_arrow(pairs, run, "a binary, b binary", 16)


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Signed documents, and the labels of nodes that are linked to others.

    Nodes that share a bucket of one band are compared unless they are already connected. First by stars: all of a
    bucket with the one that has most company in its buckets, such as the text that others were copied from. Where
    nodes of different components are then left in a bucket of three or more, all its pairs are compared in blocks.
    """
    sig = written(signed(docs), "signed")
    nodes = sig.where(F.size("bands") > 0).groupBy("node").agg(F.any_value("bands").alias("bands"))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = written(rows.join(full, "bucket"), "buckets")
    company = rows.groupBy("node").agg(F.sum("n").alias("company"))
    rows = rows.select("bucket", "node")
    texts = written(packed_texts(docs).join(company.select("node"), "node", "left_semi"), "texts")
    ranked = rows.join(company, "node")
    hub = ranked.groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("hub"))
    pairs = rows.join(hub, "bucket").where("node != hub.node").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    links = written(verified(pairs, texts, threshold).where("alike").select("a", "b"), "links")
    labels = components(links)
    own = labels.withColumnRenamed("node", "n").withColumnRenamed("label", "l")
    meeting = written(rows.join(own, F.col("node") == F.col("n"), "left").select("bucket", "node", F.coalesce("l", "node").alias("label")), "meeting")
    counts = meeting.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    sizes = counts.where("n > 2 and k > 1")
    more = written(blocked(meeting, sizes, texts, threshold), "links")
    if not more.isEmpty():
        old, labels = labels, components(links.unionByName(more))
        removed(old)
    for table in (rows, texts, links, meeting, more):
        removed(table)
    return sig, labels


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, kept of every document.

    Two documents are linked if the weighted Jaccard similarity of their multisets of five-word shingles reaches the
    threshold; classes are what links connect. Words are lower-cased runs of letters and digits; a text of fewer than
    five words is one shingle. Texts of equal words are one node and never paired. Texts without words are alike only
    if their bytes are equal; null and empty texts are each a class of their own. class_id is the least doc_id of the
    class, and kept tells its document; a class without ids has the class_id null. Rows of one id and equal words are
    one document. Other columns are left out.
    """
    sig, labels = linked(docs, threshold)
    own = labels.withColumnRenamed("node", "n")
    rows = sig.select("id", "node").join(own, F.col("node") == F.col("n"), "left")
    # empty texts: a key of their own
    rows = rows.select("id", "node", F.coalesce("label", "node", F.encode(F.concat(F.lit("-"), F.uuid()), "UTF-8")).alias("label"))
    rows = written(rows, "classes")
    heads = rows.groupBy("label").agg(first_document(), F.count("*").alias("class_size"))
    return rows.join(heads, "label").select(
        F.col("id").alias("doc_id"),
        F.col("head.id").alias("class_id"),
        "class_size",
        (F.col("id").eqNullSafe(F.col("head.id")) & F.col("node").eqNullSafe(F.col("head.node"))).alias("kept"),
    )


def first_document() -> F.Column:
    """The first document of a class: of least id, null ids last."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("head")


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class of classes(): that of the least doc_id, whole.

    Null and empty texts all stay. Of a class without ids, one row stays; of rows with equal id and equal words, one (which
    of their spellings is left open). All columns stay as they are, whatever their names; an empty table stays empty.
    """
    sig, labels = linked(docs, threshold)
    own = labels.withColumnRenamed("node", "n")
    rows = sig.where("node is not null").select("id", "node").join(own, F.col("node") == F.col("n"), "left")
    heads = rows.groupBy(F.coalesce("label", "node").alias("label")).agg(first_document())
    heads = heads.select(F.col("head.id").alias("h"), F.col("head.node").alias("n"))
    named = with_nodes(docs)
    stay = named.join(heads, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("h")), "left_semi").dropDuplicates(["id", "node"])
    return stay.unionByName(named.where("node is null")).select("row.*")
