"""Language ID with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import chunks, letters, mix

ORDER = 4
#: Bounds of the training sample: code points of a text, code points in all of a language, languages.
MAX_TEXT, MAX_CHARS, MAX_LANGS = 200_000, 600_000, 500
#: Every so many sampled texts of a language, one calibrates the rejection instead of training.
CALIBRATE = 8
#: Rejected: further from the learned languages, for its length, than the quantile QUANTILE of calibration texts and a
#: margin; at least so many deviations, for samples too small to have a tail. A text may change its language from piece to
#: piece of so many code points. Texts, beside the sampled ones, whose distances calibrate.
QUANTILE, MARGIN, LEAST, PIECE, MAX_CALIBRATE = 0.999, 1.1, 6.0, 64, 8000
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, n_scored long, rejected boolean"
SPACE = 32
FACTORS = mix(np.arange(1, ORDER + 2, dtype=np.uint64)) | np.uint64(1)


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each run of others than letters one space, and a space on either side;
    offsets of the texts. A text without letters has none."""
    low = [f" {(t or '').lower()} " for t in texts]
    raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in low])
    keep = letters()[raw]
    code = np.where(keep, raw, np.uint32(SPACE))
    first = np.ones(len(raw), bool)  # of a run of others than letters
    first[1:] = keep[:-1]
    first[ends[:-1]] = True
    keep = keep | first
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return code[keep], np.concatenate([[0], total[ends]])


def gram_keys(code: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Key of the n code points up to each place, or to each of some; the n - 1 first places of code have none."""
    if at is None:
        key = np.full(len(code), n, np.uint64)
        for j in range(n):
            key[j:] += (code[: len(code) - j] + np.uint64(1)) * FACTORS[j]
    else:
        key = np.full(len(at), n, np.uint64)
        for j in range(n):
            key += (code[at - j] + np.uint64(1)) * FACTORS[j]
    return mix(key)


class Sorted:
    """A sorted array of hashes with a directory by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length() + 1))
        self.start = np.searchsorted(keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key or of the next greater one (the last, if none), and whether it is there."""
        k = self.start[keys >> self.shift]
        last = len(self.keys) - 1
        np.minimum(k, last, out=k)
        at = self.keys[k]
        less = np.flatnonzero(at < keys)
        while len(less):
            less = less[k[less] < last]
            k[less] += 1
            at[less] = self.keys[k[less]]
            less = less[at[less] < keys[less]]
        return k, at == keys


class Model:
    """Sorted hash arrays of each order: the languages' log probability of a gram's last code point after the others,
    and the log weight that its history leaves to shorter histories."""

    def __init__(self, by_lang: dict[str, list[str]]):
        self.langs = sorted(by_lang)
        if not self.langs:
            return
        train = {k: [t for i, t in enumerate(by_lang[k]) if len(by_lang[k]) < CALIBRATE or i % CALIBRATE] for k in self.langs}
        codes = {k: self._padded(v) for k, v in train.items()}
        self.alphabet = max(2, len(np.unique(np.concatenate([c for c, _ in codes.values()]))) if codes else 2)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.left: list[tuple[np.ndarray, np.ndarray]] = []
        count = [self._counts(c, ok) for c, ok in codes.values()]
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([c[n][0] for c in count]))
            histories = np.unique(np.concatenate([c[n][2] for c in count]))
            p, left = np.zeros((len(keys), len(count))), np.zeros((len(histories), len(count)))
            for k, c in enumerate(count):
                own, number, history, _, shorter = c[n]
                some = number[number <= 2]
                ones, twos = (some == 1).sum(), (some == 2).sum()
                discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
                h, inverse = np.unique(history, return_inverse=True)
                total, kinds = np.bincount(inverse, number, len(h)), np.bincount(inverse, minlength=len(h))
                weight = np.ones(len(histories))
                weight[np.searchsorted(histories, h)] = discount * kinds / total
                left[:, k] = weight
                p[np.searchsorted(keys, own), k] = np.maximum(number - discount, 0) / total[inverse]
            # the gram's history and its shorter form, from whichever language has it
            of = np.concatenate([c[n][0] for c in count])
            first = np.searchsorted(keys, of)
            history, shorter = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            history[first] = np.concatenate([c[n][2] for c in count])
            shorter[first] = np.concatenate([c[n][4] for c in count])
            weight = left[np.searchsorted(histories, history)]
            below = 1 / self.alphabet if n == 1 else np.exp(self.logp[-1][np.searchsorted(self.keys[-1], shorter)])
            self.keys.append(keys)
            self.logp.append(np.log(p + weight * below).astype(np.float32))
            self.left.append((histories, np.log(np.maximum(left, 1e-12)).astype(np.float32)))
        self.find = [Sorted(k) for k in self.keys]
        self.find_left = [Sorted(k) for k, _ in self.left]
        self.mean, far, size, within = np.zeros(len(self.langs)), [], [], []
        for k, lang in enumerate(self.langs):
            held = [t for i, t in enumerate(by_lang[lang]) if i % CALIBRATE == 0]
            h, n = self.entropies(held)
            own = h[:, k]
            pieces = [(i, t[j : j + PIECE]) for i, t in enumerate(held) for j in range(0, len(t or ""), PIECE)]
            ph, pn = self.entropies([t for _, t in pieces])
            within.append((ph[:, k] - own[[i for i, _ in pieces]]) ** 2 * pn)
            if n.any():
                best = self.distances(held)[1]
                self.mean[k] = np.average(best, weights=n)
                far.append((best - self.mean[k])[n > 0])
                size.append(n[n > 0])
        # variance of a code point within texts, and of texts of any length; of all languages together, since one has
        # too few calibration texts for a tail. The latter by the median, for the tail is what the bound is about
        within = np.concatenate(within) if within else np.zeros(0)
        self.within = max(0.25, float(within.mean())) if len(within) else 0.25
        self.among, self.far, self.size = 0.001, np.zeros(0), np.zeros(0)
        if far:
            self.far, self.size = np.concatenate(far), np.concatenate(size)
            self.among = max(self.among, float(np.median(self.far**2 - self.within / self.size)))
        self.calibrate(np.zeros(0), np.zeros(0))

    def calibrate(self, far: np.ndarray, n: np.ndarray) -> None:
        """Set the bound from the sampled calibration texts and further ones: nats beyond the mean, code points."""
        z = self.distance(np.concatenate([self.far, far]), np.concatenate([self.size, n]))
        self.bound = max(LEAST, MARGIN * float(np.quantile(z, QUANTILE))) if len(z) else LEAST

    def distance(self, far: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Nats beyond a language's mean of texts of n code points, in deviations for their length."""
        return far / np.sqrt(self.among + self.within / np.maximum(n, 1))

    @staticmethod
    def _padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code, off = characters(texts)
        inside = np.arange(len(code)) - np.repeat(off[:-1], np.diff(off))
        return code, inside

    @staticmethod
    def _counts(code: np.ndarray, inside: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
        """Per order: grams, their counts (of the longest) or numbers of different code points before them, histories."""
        out, longer = {}, None
        code = code.astype(np.uint64)
        keys = {n: gram_keys(code, n) for n in range(1, ORDER + 1)}
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(inside >= n - 1)
            own = keys[n][at]
            uniq, first, number = np.unique(own, return_index=True, return_counts=True)
            if longer is not None:  # each different longer gram that ends in this one
                found = np.unique(keys[n][longer], return_counts=True)
                number = np.zeros(len(uniq), np.int64)
                number[np.searchsorted(uniq, found[0])] = found[1]
                number = np.maximum(number, 1)
            at = at[first]
            history = keys[n - 1][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
            shorter = keys[n - 1][at] if n > 1 else np.zeros(len(at), np.uint64)
            out[n] = (uniq, number.astype(float), history, None, shorter)
            longer = at
        return out

    def _log(self, n: int, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of the code points at places, each after the n - 1 before it."""
        if n == 0:
            return np.full((len(at), len(self.langs)), -np.log(self.alphabet), np.float32)
        k, seen = self.find[n - 1].find(gram_keys(code, n, at))
        out = self.logp[n - 1][k]
        if len(miss := np.flatnonzero(~seen)):
            at = at[miss]
            out[miss] = self._log(n - 1, code, at)
            k, seen = self.find_left[n - 1].find(gram_keys(code, n - 1, at - 1) if n > 1 else np.zeros(len(at), np.uint64))
            out[miss[seen]] += self.left[n - 1][1][k[seen]]
        return out

    def _logs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of all code points under each language; offsets of the texts. The first space is given."""
        code, off = characters(texts)
        start = off[:-1]
        code = code.astype(np.uint64)
        logs = np.empty((len(code), len(self.langs)), np.float32)
        k, seen = self.find[ORDER - 1].find(gram_keys(code, ORDER))
        logs[:] = self.logp[ORDER - 1][k]
        for j in range(ORDER - 1):  # places with less than a whole history
            at = start[off[1:] - start > j] + j
            seen[at] = True
            logs[at] = self._log(j + 1, code, at) if j else 0
        if len(miss := np.flatnonzero(~seen)):
            logs[miss] = self._log(ORDER - 1, code, miss)
            own, known = self.find_left[ORDER - 1].find(gram_keys(code, ORDER - 1, miss - 1))
            logs[miss[known]] += self.left[ORDER - 1][1][own[known]]
        return logs, off

    def distances(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats a code point of each text under each language; under the best language of each of its pieces; code points
        scored."""
        logs, off = self._logs(texts)
        n = np.diff(off) - 1
        inside = np.arange(len(logs)) - np.repeat(off[:-1], np.diff(off))
        cut = np.flatnonzero(inside % PIECE == 0)
        total, best = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        if len(cut):
            doc = np.searchsorted(off, cut, side="right") - 1
            pieces = np.add.reduceat(logs, cut, axis=0, dtype=np.float64)
            full, first = np.unique(doc, return_index=True)
            total[full] = np.add.reduceat(pieces, first, axis=0)
            best[full] = np.add.reduceat(pieces.max(1), first)
        size = np.maximum(n, 1)
        return -total / size[:, None], -best / size, n

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a code point of each text under each language; code points scored."""
        h, _, n = self.distances(texts)
        return h, n

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        if not self.langs:  # nothing was learned
            none = np.zeros(len(texts))
            return {"lang_pred": ["und"] * len(texts), "score": none, "cross_entropy": none, "n_scored": np.maximum(np.diff(characters(texts)[1]) - 1, 0), "rejected": none == 0}
        h, mixed, n = self.distances(texts)
        best = h.argmin(1)
        own = h[np.arange(len(h)), best]
        score = 1 / np.exp(own[:, None] - h).sum(1)
        some = n > 0
        far = mixed - self.mean[best]
        reject = ~some | (self.distance(far, n) > self.bound)
        return {
            "lang_pred": [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)],
            "score": np.where(some, score, 0.0),
            "cross_entropy": np.where(some, own, 0.0),
            "n_scored": n,
            "rejected": reject,
            "far": far,
        }


def fit(labelled: DataFrame, max_chars: int = MAX_CHARS, max_text: int = MAX_TEXT) -> Model:
    """A model from a bounded sample of rows with columns doc_id, text, lang, the same for the same rows.

    A language's texts of at most max_text code points are sampled by a hash of their ids, at the rate that gives
    max_chars code points of it; what reaches the driver is bounded by max_chars for each of at most MAX_LANGS languages.
    The rejection is calibrated on every CALIBRATE-th of these and on the distances of some MAX_CALIBRATE other texts.
    """
    rows = labelled.where("lang is not null and text is not null").where(F.char_length("text").between(1, max_text))
    stats = rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("n"), F.count("*").alias("texts")).limit(MAX_LANGS + 1).collect()
    if len(stats) > MAX_LANGS:
        raise ValueError(f"{len(stats)} languages or more have labelled text; up to {MAX_LANGS} are supported")
    if not stats:
        return Model({})
    rate = F.element_at(F.create_map(*[F.lit(x) for r in stats for x in (r["lang"], max_chars / max(r["n"], 1))]), F.col("lang"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # over the bound only by chance: cut in id order
    picked = rows.where(part < rate).select("lang", "doc_id", "text").collect()
    by_lang: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in sorted(picked, key=lambda r: (r["doc_id"], r["text"])):
        if size.get(r["lang"], 0) < 2 * max_chars:
            by_lang.setdefault(r["lang"], []).append(r["text"])
            size[r["lang"]] = size.get(r["lang"], 0) + len(r["text"])
    for r in stats:  # a language whose rows the hash has missed
        if r["lang"] not in by_lang:
            by_lang[r["lang"]] = [x["text"] for x in rows.where(F.col("lang") == r["lang"]).orderBy("doc_id").limit(5).collect()]
    model = Model(by_lang)
    # further texts for the tail, by the next hashes; two numbers of each reach the driver
    sent = rows.sparkSession.sparkContext.broadcast(model)
    more = rows.where((part >= rate) & (part < rate + MAX_CALIBRATE / sum(r["texts"] for r in stats)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, _ in chunks(batch, "text", 1 << 19):
            out = sent.value.predict(batch.column(0).slice(lo, hi - lo).to_pylist())
            some = out["n_scored"] > 0
            yield pa.RecordBatch.from_pydict({"far": pa.array(out["far"][some]), "n": pa.array(out["n_scored"][some])})

    found = map_arrow(more.select("text"), run, "far double, n long").toPandas()
    model.calibrate(found["far"].to_numpy(), found["n"].to_numpy())
    return model


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def learned(docs: DataFrame) -> Model:
    """The model of docs' labelled rows whose crc32(doc_id) modulo 5 is not 0."""
    return fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The language of every whole text: the learned one of least cross-entropy a code point.

    Trained, where no model is given, by learned(). score is the language's share of the likelihoods of one average code
    point. rejected tells a text that is further from the learned languages, piece by piece, than the quantile QUANTILE of
    calibration texts for its length, by a margin (Model.bound), and texts that are null or have no letter, whose language is und and score 0. Where no text is
    labelled, all are und and rejected; an empty table gives an empty result. Rows with equal ids are judged one by one;
    other columns are left out. Of languages that tie, the first by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or learned(docs))
    own = ["lang_pred", "score", "cross_entropy", "n_scored", "rejected"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, _ in chunks(batch, "text", 1 << 19):
            part = batch.slice(lo, hi - lo)
            out = sent.value.predict(part.column(1).to_pylist())
            cols = {"doc_id": part.column(0), "held_out": part.column(2)}
            yield pa.RecordBatch.from_pydict(cols | {k: pa.array(out[k]) for k in own})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return map_arrow(rows, run, SCHEMA)


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs less the rows that identify() rejects; all columns stay as they are, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learned(docs))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(batch.schema.get_field_index("text"))
        for lo, hi, _ in chunks(batch, "text", 1 << 19):
            out = sent.value.predict(texts.slice(lo, hi - lo).to_pylist())
            yield batch.slice(lo, hi - lo).filter(pa.array(~out["rejected"]))

    return map_arrow(docs, run, docs.schema)
