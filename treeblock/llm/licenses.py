"""License scans through a positional index of rare tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .kernels import Texts, Words, byte_table, chunks

WORDS = byte_table([*range(48, 58), *range(97, 123), *range(128, 256)])
#: Base phrases and their labels (fixed values).
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Notices of licences (fixed values): label, text, and the key phrases that must stand in a file.
NOTICES = [
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at. Unless required by applicable law or agreed to in writing, software distributed under the
        License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.""",
        ["apache license"],
    ),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions. The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. The software is provided "as is", without warranty of any kind, express or implied, including
        but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the
        authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or
        otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.""",
        ["permission is hereby granted", "free of charge"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. The software is provided "as is" and the author
        disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.""",
        ["with or without fee"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution.""",
        ["source and binary forms"],
    ),
    (
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at.""",
        ["mozilla public license"],
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation. This library is distributed in the hope that it will be useful, but without any warranty;
        without even the implied warranty of merchantability or fitness for a particular purpose.""",
        ["lesser general public license"],
    ),
    (
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation. You should have received a copy of the GNU Affero General Public License along with this
        program.""",
        ["affero general public license"],
    ),
    (
        "epl",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at.""",
        ["eclipse public license"],
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means.""",
        ["public domain"],
    ),
    (
        "zlib",
        """This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely.""",
        ["alter it and redistribute it freely"],
    ),
    ("lgpl", "GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl", "GNU Affero General Public License", ["affero general public license"]),
    ("cc0", "CC0 1.0 Universal", ["cc0"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", ["attribution sharealike"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution"]),
    ("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related rights.", ["cc0"]),
]
#: The fraction of a clause's words that must stand in place, and the fewest words of a clause of its own.
AGREE, CLAUSE = 0.6, 5
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Clause:
    """Words of a template that stand together, to be found as a whole; base phrases must be there word by word."""

    def __init__(self, template: int, words: list[bytes], base: bool):
        self.template, self.words, self.base = template, words, base
        #: Words that must be in place, and so many of the rarest that one at least of them then is.
        self.need = len(words) if base else int(np.ceil(AGREE * len(words) - 1e-9))
        self.rare = len(words) - self.need + 1


class Template:
    def __init__(self, label: str, text: str, keys: list[str], base: bool):
        self.label, self.base = label, base
        split = lambda t: [w.encode() for w in re.findall("[0-9a-z]+", t.lower())]
        self.clauses: list[list[bytes]] = []
        for part in re.split(r"[.,;:](?=\s|$)", text):
            words = split(part)
            if self.clauses and len(words) < CLAUSE:
                self.clauses[-1] += words
            else:
                self.clauses.append(words)
        self.keys = [split(k) for k in keys]


def templates() -> list[Template]:
    return [Template(v, k, [], True) for k, v in BASE.items()] + [Template(a, b, c, False) for a, b, c in NOTICES]


def vocabulary() -> list[bytes]:
    return sorted({w for t in templates() for k in [*t.clauses, *t.keys] for w in k})


def word_hashes(vocab: list[bytes]) -> np.ndarray:
    return Words(Texts.of(vocab), WORDS).hash


def document_frequency(docs: DataFrame) -> dict[bytes, int]:
    """In how many documents each licence word stands: one row a word reaches the driver, whatever the corpus."""
    vocab = vocabulary()
    code = word_hashes(vocab)
    order = np.argsort(code)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocab), np.int64)
        for _, _, texts in chunks(batch, "text"):
            words = Words(texts.lower(), WORDS)
            at, which = find(words.hash, code[order])
            pairs = np.unique(words.doc[at] * len(vocab) + order[which])
            total += np.bincount(pairs % len(vocab), minlength=len(vocab))
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(len(vocab), dtype=np.int32)), "n": pa.array(total)})

    rows = map_arrow(docs.select("text"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(vocab, 0) | {vocab[r["word"]]: r["n"] for r in rows}


def find(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes that stand in the sorted array known, and where."""
    k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    at = np.flatnonzero(known[k] == hashes)
    return at, k[at]


class Index:
    """Postings of rare words: word -> its places in clauses of templates.

    A word is rare in a clause if it is among so many of highest IDF that a text with the fraction AGREE of the
    clause in place has one at least of them there, so a file's lookups of rare words miss no clause.
    """

    def __init__(self, frequency: dict[bytes, int]):
        self.templates, vocab = templates(), vocabulary()
        code = word_hashes(vocab)
        by = dict(zip(vocab, code, strict=True))
        self.clauses = [Clause(i, w, t.base) for i, t in enumerate(self.templates) for w in t.clauses]
        for t in self.templates:
            t.size = sum(map(len, t.clauses))
            t.key_hash = [np.array([by[w] for w in k]) for k in t.keys]
        posted: dict[bytes, list[tuple[int, int]]] = {}
        for k, x in enumerate(self.clauses):
            x.hash = np.array([by[w] for w in x.words])
            for j in sorted(range(len(x.words)), key=lambda j: (frequency[x.words[j]], j))[: x.rare]:
                posted.setdefault(x.words[j], []).append((k, j))
        known = sorted(posted, key=lambda w: by[w])
        self.known = np.array([by[w] for w in known])
        self.count = np.array([len(posted[w]) for w in known])
        self.begin = np.cumsum(self.count) - self.count
        flat = np.array([p for w in known for p in posted[w]], np.int64)
        self.clause, self.place = flat[:, 0], flat[:, 1]

    def scan(self, texts: Texts) -> dict[str, list]:
        words = Words(texts.lower(), WORDS)
        at, which = find(words.hash, self.known)
        # each looked-up word's postings, by the start of the clause that they imply
        n = self.count[which]
        post = np.repeat(self.begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        at = np.repeat(at, n)
        clause, start, doc = self.clause[post], at - self.place[post], words.doc[at]
        order = np.lexsort((start, doc, clause))
        clause, start, doc = clause[order], start[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (clause[1:] != clause[:-1]) | (start[1:] != start[:-1]) | (doc[1:] != doc[:-1])
        clause, start, doc = clause[new], start[new], doc[new]
        cuts = np.searchsorted(clause, np.arange(len(self.clauses) + 1))
        total, lo, hi = np.zeros(texts.n, np.int64), np.full(texts.n, -1, np.int64), np.full(texts.n, -1, np.int64)
        base: list[set] = [set() for _ in range(texts.n)]
        every: list[set] = [set() for _ in range(texts.n)]
        score = np.zeros(texts.n)
        found = np.zeros((len(self.templates), texts.n))  # words of each template in place
        for k, x in enumerate(self.clauses):
            d, p = doc[cuts[k] : cuts[k + 1]], start[cuts[k] : cuts[k + 1]]
            hit = np.zeros(len(p), np.int64)
            for j, h in enumerate(x.hash):
                q = p + j
                own = (q >= words.first[d]) & (q < words.first[d + 1])
                hit += own & (words.hash[np.clip(q, 0, max(0, len(words.hash) - 1))] == h)
            d, p, hit = (v[hit >= x.need] for v in (d, p, hit))
            if not x.base:
                best = np.zeros(texts.n)
                np.maximum.at(best, d, hit)
                found[x.template] += best
                continue
            same = [words.bytes(int(q), len(x.words)) == x.words for q in p]
            d, p = d[same], p[same] - words.first[d[same]]
            np.add.at(total, d, 1)
            np.maximum.at(hi, d, p)
            lo[d] = np.where(lo[d] < 0, np.iinfo(np.int64).max, lo[d])
            np.minimum.at(lo, d, p)
            for y in np.unique(d):
                base[y].add(self.templates[x.template].label)
                every[y].add(self.templates[x.template].label)
                score[y] = 1.0
        for t, part in zip(self.templates, found, strict=True):
            for y in np.flatnonzero(part):
                own = words.hash[words.first[y] : words.first[y + 1]]
                whole = all(phrase_in(own, k) for k in t.key_hash)
                score[y] = max(score[y], part[y] / t.size * (1 if whole else 0.5))
                if whole:
                    every[y].add(t.label)
        join = lambda x: ",".join(sorted(x))
        none = lambda x: [None if v < 0 else int(v) for v in x]
        return {"n_words": words.count, "n_base": total, "first_word": none(lo), "last_word": none(hi), "base_labels": [*map(join, base)], "labels": [*map(join, every)], "score": score}


def phrase_in(hashes: np.ndarray, phrase: np.ndarray) -> bool:
    p = np.flatnonzero(hashes[: max(0, len(hashes) - len(phrase) + 1)] == phrase[0])
    for j in range(1, len(phrase)):
        p = p[hashes[p + j] == phrase[j]]
    return bool(len(p))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence phrases and labels of every document.

    A first pass counts in how many documents each licence word stands. The second looks up each file's words of high IDF
    by their places in the text; starts of a clause that they imply are compared word by word with the clause. Of base
    phrases every word must be there, compared byte by byte; clauses of notices need the fraction AGREE of their words in
    place, and a notice with such a clause is a label if its key phrases stand anywhere in the text. score: 1 for a base
    phrase, else the largest fraction of a notice in place, halved where its key phrases are missing. Null or empty texts
    have no words, empty labels and score 0; words of equal IDF are taken in their order. Rows with equal ids are scanned
    one by one; other columns are left out.
    """
    index = Index(document_frequency(docs))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, texts in chunks(batch, "text"):
            out = index.scan(texts)
            cols = {"doc_id": batch.column(0).slice(lo, hi - lo)}
            cols |= {k: pa.array(v, pa.int64() if k in ("first_word", "last_word") else None) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, SCHEMA)
