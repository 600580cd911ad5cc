"""Quality rules with suffix-array repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow
from .kernels import CONTINUATION, Texts, Words, byte_table, chunks, mix, repeated, span_codes

WORDS = ~byte_table([0x20, *range(0x09, 0x0E)])
SYMBOLS = byte_table(b"#*$%&|<>")
NEWLINE = 10
#: Words of a window, and of the shortest repeat that counts towards max_covered: pairs of words recur in any long prose.
WINDOW, SHORT = 8, 3
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_covered_words long, n_short_covered long, longest_repeat long, n_maximal long, kept boolean"
)


class Repeats:
    """Repeated word strings of each text of a chunk, from a suffix array.

    Only suffixes whose first word stands twice in their text can share a word with another suffix; these are sorted by
    prefix doubling over the ranks of their words. Neighbours' common extensions come from the ranks of each doubling,
    longest first. shared(): for each such suffix, the longest extension it shares.
    """

    def __init__(self, words: Words):
        i, h = words.windows(1)
        own = mix(h ^ mix(words.doc[i].astype(np.uint64)))
        twice = repeated(own)
        self.at, n = i[twice], len(words.s)
        self.words, m = words, len(self.at)
        self.order, self.lcp = np.arange(m), np.zeros(max(m - 1, 0), np.int64)
        if not m:
            return
        slot = np.full(n + 1, -1, np.int64)  # of each word that is repeated
        slot[self.at] = np.arange(m)
        _, rank = np.unique(own[twice], return_inverse=True)
        levels, length = [rank], 1
        while True:
            nxt = slot[np.minimum(self.at + length, n)]
            second = np.where(nxt >= 0, rank[nxt], -1 - np.arange(m))  # what is not repeated differs from all
            self.order = np.lexsort((second, rank))
            a, b = rank[self.order], second[self.order]
            new = np.ones(m, bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            rank = np.empty(m, np.int64)
            rank[self.order] = np.cumsum(new) - 1
            if new.all():
                break
            levels.append(rank)
            length *= 2
        x, y = self.at[self.order[:-1]], self.at[self.order[1:]]
        common = np.zeros(m - 1, np.int64)
        # ranks tell texts apart, so that no extension leaves its text
        for k in range(len(levels) - 1, -1, -1):
            sx, sy = slot[np.minimum(x + common, n)], slot[np.minimum(y + common, n)]
            same = (sx >= 0) & (sy >= 0) & (levels[k][sx] == levels[k][sy])
            common += same * (1 << k)
        self.lcp = common

    def shared(self) -> np.ndarray:
        """Words that each suffix of self.at shares with some other suffix of its text."""
        out = np.zeros(len(self.at), np.int64)
        if len(self.lcp):
            np.maximum.at(out, self.order[1:], self.lcp)
            np.maximum.at(out, self.order[:-1], self.lcp)
        return out

    def maximal(self) -> np.ndarray:
        """Per text, the number of places where a maximal repeat of SHORT words or more stands: shared strings that no
        longer one contains."""
        shared, words = self.shared(), self.words
        whole = np.ones(len(self.at), bool)
        whole[1:] = ~((self.at[1:] == self.at[:-1] + 1) & (shared[1:] == shared[:-1] - 1))
        return np.bincount(words.doc[self.at[whole & (shared >= SHORT)]], minlength=words.texts.n)


def union(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def repeats_of(texts: Texts, s: np.ndarray, e: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per text, how many of the spans s..e have the bytes of an earlier one. Spans meet by hash; those that meet are
    compared byte by byte."""
    key = mix(span_codes(texts.buf, s, e) ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.zeros(texts.n, np.int64)
    seen: set[bytes] = set()
    # single ones are left out, and a group is gone through in page order
    group = np.flatnonzero(~new | np.append(~new[1:], False))
    for first, i in zip(new[group].tolist(), order[group].tolist(), strict=True):
        line = texts.buf[s[i] : e[i]].tobytes()
        if first:
            seen = {line}
        elif line in seen:
            out[doc[i]] += 1
        else:
            seen.add(line)
    return out


def measure(texts, max_covered: float, max_longest: int, min_words: int, max_repeat: int) -> dict[str, np.ndarray]:
    words = Words(texts, WORDS)
    inside = WORDS[texts.buf]
    newline = np.flatnonzero(texts.buf == NEWLINE)
    starts = np.sort(np.concatenate([texts.off[:-1], newline + 1]))
    ends = np.sort(np.concatenate([texts.off[1:], newline]))
    # a text's end and the newline at its end sort alike; an empty text has one empty line
    begun = np.zeros(len(texts.buf) + 1, np.int64)
    begun[words.s + 1] = 1
    begun = np.cumsum(begun)
    full = (begun[ends] - begun[starts]) > 0
    s, e = starts[full], ends[full]
    doc = texts.doc_of(s)
    lines = repeats_of(texts, s, e, doc)
    i, h = words.windows(WINDOW)
    twice = i[repeated(mix(h ^ mix(words.doc[i].astype(np.uint64))))]
    n_repeat = np.bincount(words.doc[union(twice, twice + WINDOW, len(words.s))], minlength=texts.n)
    found = Repeats(words)
    shared = found.shared()

    def covered(least: int) -> np.ndarray:
        some = shared >= least
        return np.bincount(words.doc[union(found.at[some], (found.at + shared)[some], len(words.s))], minlength=texts.n)

    n_short = covered(SHORT)
    long = shared >= WINDOW
    longest = np.zeros(texts.n, np.int64)
    np.maximum.at(longest, words.doc[found.at[long]], shared[long])
    failed = (words.count < min_words) | (100 * n_repeat > max_repeat * words.count)
    good = (n_short <= max_covered * np.maximum(words.count, 1)) & (longest <= max_longest)
    return {
        "n_words": words.count,
        "word_chars": texts.sums(inside & ~CONTINUATION[texts.buf]),
        "n_symbols": texts.sums(SYMBOLS[texts.buf]),
        "n_dup_lines": lines,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "n_covered_words": covered(WINDOW),
        "n_short_covered": n_short,
        "longest_repeat": longest,
        "n_maximal": found.maximal(),
        "kept": ~failed & good,
    }


def quality_rules(
    docs: DataFrame, max_covered: float = 0.3, max_longest: int = 200, min_words: int = 20, max_repeat: int = 30
) -> DataFrame:
    """Counts, repeats and a verdict for every document; one pass, no shuffle.

    A document fails the base rules with fewer than min_words words or over max_repeat percent of its words in windows
    of eight words that repeat. Beyond these, maximal repeated strings of SHORT words or more may cover the fraction
    max_covered of its words (n_short_covered; n_covered_words are those of eight words or more), and the longest may
    have max_longest words. A null or empty text has no words and fails.
    Rows with equal ids are judged one by one; other columns of docs are left out.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, texts in chunks(batch, "text"):
            out = measure(texts, max_covered, max_longest, min_words, max_repeat)
            cols = {"doc_id": batch.column(0).slice(lo, hi - lo)} | {k: pa.array(v) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, SCHEMA)
