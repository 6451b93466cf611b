"""License scans by a positional index of rare words.

Every licence template is indexed by its words: word -> postings (template, position). A word's weight is its inverse document
frequency over the whole corpus. A template's *keys* are its rarest words, as many as it takes until the words left over could not
make up the share of the template that must agree. For a file the operator looks up the postings of its licence words, the rarest
first; templates none of whose keys stand in the file are out, and so a file without keys is left at once. For the others the postings
of all their words are intersected by relative position: each place of a word in the file votes for (template, place in file minus place
in template), and a template whose votes for neighbouring places agree on enough weight is a candidate. A candidate counts once its
mandatory phrases stand in the file near the place the votes give. The score is the weighted share of the template's words found there.

Independently of votes the base phrases are counted wherever their words stand consecutively.

Words: letters A-Z are lower-cased, then runs of ASCII letters and digits and of non-ASCII characters.

Defined cases: a null text has no words; a text without licence words has no labels and score 0; ties between templates keep both
labels; repeated rows are judged each; an empty table gives an empty result; other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, empty_if_null, id_type, map_batches

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Template:
    """A licence notice; each of ``mandatory`` must stand in the file within the template's extent."""

    label: str
    text: str
    mandatory: tuple[str, ...]


#: Opening words and notices of public licences, shortened to what identifies them.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted", "to deal in the software without restriction")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("free software", "gnu general public license")),
    Template("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc", "4 0")),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa", "4 0")),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution International License", ("creative commons attribution",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights, CC0 1.0 Universal", ("cc0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", ("unless required by applicable law or agreed to in writing", "without warranties or conditions of any kind")),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name", "endorse or promote products derived from this software")),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "in no event will the authors be held liable")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)

_ASCII = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_ASCII).split()


class Index:
    """Words, postings and phrases of the templates. Its size is that of the templates, whatever the corpus holds."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None):
        self.templates = templates
        self.phrases = {tuple(words_of(k.encode())): v for k, v in (BASE_PHRASES if phrases is None else phrases).items()}
        self.words = [words_of(t.text.encode()) for t in templates]
        self.mandatory = [[tuple(words_of(m.encode())) for m in t.mandatory] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for q, w in enumerate(words):
                self.postings[w].append((t, q))
        self.known = frozenset(self.postings) | {w for p in self.phrases for w in p} | {w for ms in self.mandatory for m in ms for w in m}


def word_frequencies(docs: DataFrame, index: Index, *, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and documents holding each licence word, over the whole table. Counted per batch in the tasks, then summed;
    the result has one row per licence word."""
    known = index.known

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[bytes, int] = defaultdict(int)
        for text in bytes_of(batch.column(0)):
            for w in known.intersection(words_of(text)):
                counts[w] += 1
        counts[b""] = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = map_batches(docs.select(empty_if_null(text_col).cast("binary").alias("t")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


@dataclass(frozen=True)
class Weighed:
    """An index with the corpus's weights. ``agree``: the weighted share of a template's words that must vote for one place; ``slack``:
    how far votes for one place may lie apart."""

    index: Index
    weight: dict[bytes, float]
    agree: float = 0.5
    slack: int = 3
    keys: dict[bytes, list[int]] = field(init=False)
    totals: list[float] = field(init=False)

    def __post_init__(self):
        keys: dict[bytes, list[int]] = defaultdict(list)
        totals = [sum(self.weight[w] for w in own) for own in self.index.words]
        for t, own in enumerate(self.index.words):
            left = totals[t]
            for w in sorted(set(own), key=lambda w: (-self.weight[w], w)):
                # Without the keys so far, too little is left to agree.
                if left < self.agree * totals[t] - 1e-9:
                    break
                keys[w].append(t)
                left -= self.weight[w] * own.count(w)
        object.__setattr__(self, "keys", dict(keys))
        object.__setattr__(self, "totals", totals)


def scan_words(words: list[bytes], weighed: Weighed) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """Places of base phrases, first and last of them, base labels, all labels, and the score, for the words of one text."""
    index, weight, slack = weighed.index, weighed.weight, weighed.slack
    seen = index.known.intersection(words)
    if not seen:
        return 0, None, None, set(), set(), 0.0
    possible = {t for w in seen if w in weighed.keys for t in weighed.keys[w] if all(m[0] in seen for m in index.mandatory[t])}
    starts = {p[0] for p in index.phrases} & seen
    if not possible and not starts:
        return 0, None, None, set(), set(), 0.0
    places: dict[bytes, list[int]] = {w: [] for w in seen}
    for i, w in enumerate(words):
        if w in places:
            places[w].append(i)

    def at(phrase: tuple[bytes, ...], i: int) -> bool:
        return tuple(words[i : i + len(phrase)]) == phrase

    hits, base = [], set()
    for phrase, label in index.phrases.items():
        found = [i for i in places.get(phrase[0], ()) if at(phrase, i)]
        if found:
            hits += found
            base.add(label)
    labels, score = set(base), 0.0
    # Postings of the file's words, the rarest first, intersected by the place at which a template would begin.
    votes: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
    if possible:
        for w in sorted(seen & index.postings.keys(), key=lambda w: (-weight[w], w)):
            for t, q in index.postings[w]:
                if t in possible:
                    for p in places[w]:
                        votes[t, (p - q) // slack][q] = weight[w]
    best: dict[int, float] = {}
    for t, bin_no in votes:
        share = sum((votes[t, bin_no] | votes.get((t, bin_no + 1), {})).values()) / weighed.totals[t]
        if share >= weighed.agree - 1e-9 and share > best.get(t, 0.0):
            low, high = bin_no * slack - slack, (bin_no + 2) * slack + len(index.words[t]) + slack
            if all(any(low <= i <= high and at(m, i) for i in places[m[0]]) for m in index.mandatory[t]):
                best[t] = share
    for t, share in best.items():
        labels.add(index.templates[t].label)
        score = max(score, min(1.0, share))
    if base:
        score = max(score, 0.5)
    return len(hits), min(hits, default=None), max(hits, default=None), base, labels, score


def license_scan(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row: two passes, no shuffle of texts."""
    index = Index(templates, phrases)
    n, counts = word_frequencies(docs, index, text_col=text_col)
    weighed = Weighed(index, {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 0.1 for w in index.known})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in bytes_of(batch.column(1)):
            words = words_of(text)
            places, first, last, base, labels, score = scan_words(words, weighed)
            rows.append((len(words), places, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    source = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).cast("binary").alias("t"))
    return map_batches(source, run, f"doc_id {id_type(docs, id_col)}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
