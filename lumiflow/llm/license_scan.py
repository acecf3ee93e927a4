"""Licence scan with a positional index of rare licence words.

Templates (base phrases and licence notices) are words at positions.  A word's IDF is that of all
files: one pass counts how many hold each licence word (a count for each word of a fixed vocabulary comes
back).  A template is posted under the ``ANCHORS`` rarest words of its first mandatory phrase.  A file
walks its own licence words from the highest IDF down; a word looks up the templates of which it is
the rarest anchor, its places and those of the other anchors say where the template would begin, and
beginnings on which all anchors agree are candidates.  A candidate counts only if every mandatory key
phrase of the template stands there, word for word: the first at its place, later ones at most
``SLACK`` words off, as notices differ between them.  The share of the template's words that stand at
their places is its score.  A base phrase is its own mandatory phrase, so all its places are found, in texts
of any length.

Defined cases: null and empty texts have no words, labels or places, and score 0; ties keep all
labels; repeated rows and ids are scanned each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, slices, texts_column, words_of

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices of public licences as words, each with its label and mandatory key phrases.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache license version 2 0", "except in compliance with the license", "without warranties or conditions of any kind")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge to any person",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("hereby granted free of charge to any person", "deal in the software without restriction", "shall be included in all copies or substantial portions")),
    ("mit-notice", "released under the mit license", ("released under the mit license",)),
    ("bsd-3-clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce", "without specific prior written permission")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-attribution", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright and related",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("proprietary", "proprietary and confidential all rights reserved", ("proprietary and confidential",)),
)

#: Rare words under which a template is posted; words by which a later key phrase may be off its place.
ANCHORS, SLACK = 3, 12


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool


def _templates(phrases, notices) -> list[Template]:
    out = [Template(label, tuple(p.split()), ((0, tuple(p.split())),), True) for p, label in phrases.items()]
    for label, notice, keys in notices:
        words = tuple(notice.split())
        at = []
        for key in keys:
            k = tuple(key.split())
            places = [i for i in range(len(words)) if words[i : i + len(k)] == k]
            if not places:
                raise ValueError(f"{label}: the key phrase isn't in the notice")
            at.append((places[0], k))
        out.append(Template(label, words, tuple(at), False))
    return out


class Index:
    """Positional postings of the templates' rarest words, by how many of ``files`` hold each word."""

    def __init__(self, phrases=BASE_PHRASES, notices=NOTICES, held: dict[str, int] | None = None, files: int = 0) -> None:
        self.templates = _templates(phrases, notices)
        self.vocabulary = sorted({w for t in self.templates for w in t.words})
        held = held or {}
        self.idf = {w: math.log((1 + files) / (1 + held.get(w, 0))) for w in self.vocabulary}
        self.hashes = np.array(words_of(pa.array(self.vocabulary, pa.string()), ALNUM).hashes())
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.rarest: dict[str, list[int]] = defaultdict(list)
        self.anchors: list[list[tuple[str, int]]] = []
        for i, t in enumerate(self.templates):
            at, key = t.keys[0]
            places = sorted(range(len(key)), key=lambda p, key=key: (-self.idf[key[p]], p))[:ANCHORS]
            self.anchors.append([(key[p], at + p) for p in places])
            self.rarest[key[places[0]]].append(i)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of licence words, their numbers in the vocabulary)."""
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        places = np.flatnonzero(self.sorted[at] == h)
        return places, self.order[at[places]]

    def scan(self, places: list[int], words: list[str]):
        """(base places, base labels, all labels, score) of a text's licence words at their places."""
        at = dict(zip(places, words, strict=True))
        where: dict[str, list[int]] = defaultdict(list)
        for p, w in at.items():
            where[w].append(p)
        starts, base, labels, score = [], set(), set(), 0.0
        for word in sorted(where, key=lambda w: (-self.idf[w], w)):
            for i in self.rarest.get(word, ()):
                template = self.templates[i]
                (_, first), *others = self.anchors[i]
                begins = {p - first for p in where[word]}
                for w, q in others:
                    begins.intersection_update([p - q for p in where.get(w, ())])
                for start in begins:
                    if not self._stands(at, template, start):
                        continue
                    labels.add(template.label)
                    score = max(score, sum(at.get(start + j) == w for j, w in enumerate(template.words)) / len(template.words))
                    if template.base:
                        starts.append(start)
                        base.add(template.label)
        return starts, base, labels, score

    @staticmethod
    def _stands(at: dict[int, str], template: Template, start: int) -> bool:
        """Every key phrase stands word for word: the first at its place, the others near theirs."""
        for n, (p, key) in enumerate(template.keys):
            near = range(-SLACK, SLACK + 1) if n else (0,)
            if not any(all(at.get(start + p + d + j) == w for j, w in enumerate(key)) for d in near):
                return False
        return True


def _held(own: DataFrame, index: Index) -> tuple[dict[str, int], int]:
    """(files that hold each word of the index, files) of (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, files = np.zeros(len(index.vocabulary), dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(texts_column(part, "text"), ALNUM)
                places, numbers = index.known(w.hashes())
                both = np.unique(w.text_of_word()[places] * len(index.vocabulary) + numbers)
                total += np.bincount(both % len(index.vocabulary), minlength=len(index.vocabulary))
                files += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(["", *index.vocabulary]), pa.array([files, *total.tolist()], pa.int64())], names=["word", "n"])

    found = {r["word"]: r["n"] for r in own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def license_report(docs: DataFrame, phrases=None, notices=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of base phrases, labels and score."""
    phrases, notices = BASE_PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    index = Index(phrases, notices, *_held(own, Index(phrases, notices)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(texts_column(part, "text"), ALNUM)
                counts = w.counts()
                places, numbers = index.known(w.hashes())
                text = w.text_of_word()[places] if len(places) else places
                cut = np.searchsorted(text, np.arange(part.num_rows + 1))
                rows = []
                for k in range(part.num_rows):
                    lo, hi = cut[k], cut[k + 1]
                    own_places = (places[lo:hi] - w.first[k]).tolist()
                    rows.append(index.scan(own_places, [index.vocabulary[i] for i in numbers[lo:hi]]) if hi > lo else ((), (), (), 0.0))
                columns = {
                    "n_words": pa.array(counts, pa.int64()),
                    "n_base": pa.array([len(r[0]) for r in rows], pa.int64()),
                    "first_word": pa.array([min(r[0]) if r[0] else None for r in rows], pa.int64()),
                    "last_word": pa.array([max(r[0]) if r[0] else None for r in rows], pa.int64()),
                    "base_labels": pa.array([",".join(sorted(r[1])) for r in rows], pa.string()),
                    "labels": pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                    "score": pa.array([r[3] for r in rows], pa.float64()),
                }
                yield pa.RecordBatch.from_arrays([texts_column(part, "doc_id"), *columns.values()], names=["doc_id", *columns])

    return own.mapInArrow(scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
