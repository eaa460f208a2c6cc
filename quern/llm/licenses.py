"""License scans with a positional index of rare template words.

Document frequencies of all template words are counted over all documents. Each
template is indexed by its rarest words and their positions. A file looks up all
of those words that it holds; postings that agree on where the template would
start are one candidate, which stands if the words around support enough of the
template's IDF and each of its key phrases is there word by word.

Null texts are empty and have no words; ties in IDF are broken by the word; repeated
rows each get a row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, text_or_empty

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII letters, blanks the rest.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Phrases whose places are counted, with their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


#: Licence wording as it stands in files (fixed values), with the phrases that must be there.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "this work is licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("free of charge", "obtaining a copy")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("reserved", "copyright all rights reserved", ("all rights reserved",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("specific language governing permissions",)),
    Template("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license", "january 2004")),
    Template("artistic-2.0", "the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("artistic license 2 0",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("source code must retain", "binary form must reproduce")),
    Template("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products",)),
    Template("bsl-1.0", "boost software license version 1 0 august 17th 2003", ("boost software license",)),
    Template("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("related or neighboring rights",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license",)),
    Template("gpl", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("gnu general public license",)),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license",)),
    Template("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("free of charge", "without limitation the rights")),
    Template("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("copy of the mpl",)),
    Template("odbl", "this database is made available under the open database license any rights in individual contents of the database are licensed under the database contents license", ("open database license",)),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("compiled binary",)),
    Template("wtfpl", "do what the fuck you want to public license version 2 december 2004", ("you want to public license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors",)),
)

#: Rarest words by which a template is found, how far words may be shifted, and the support that a candidate needs.
RARE_WORDS, SHIFT, SUPPORT = 3, 2, 0.6


def normal(text: str) -> bytes:
    """The words with a blank before and after each."""
    return b" " + b" ".join(text.encode().translate(WORDS).split()) + b" "


def places(data: bytes, phrase: str) -> list[int]:
    """Where the phrase stands in normal bytes; places may share a blank."""
    found, want, at = [], f" {phrase} ".encode(), -1
    while (at := data.find(want, at + 1)) >= 0:
        found.append(at)
    return found


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents and, for each template word, of those that hold it; over all rows."""
    vocabulary = frozenset(w.encode() for t in templates for w in t.text.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = defaultdict(int)
        for _, texts in by_bytes(batches, "text"):
            counts[""] += len(texts)
            for t in texts:
                for w in vocabulary.intersection(t.encode().translate(WORDS).split()):
                    counts[w.decode()] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text_or_empty(F.col(text)).alias("text")).mapInArrow(run, "word string, n long")
    found = {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # the templates' words at most
    return found.pop("", 0), found


class Index:
    """Postings (template, position) of each template's rarest words."""

    def __init__(self, documents: int, frequencies: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.templates = templates
        self.words = [[w.encode() for w in t.text.split()] for t in templates]
        self.idf = {w: log((documents + 1) / (frequencies.get(w.decode(), 0) + 1)) + 1e-9 for ws in self.words for w in ws}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            for w in sorted(set(ws), key=lambda w: (-self.idf[w], w))[:RARE_WORDS]:
                self.postings[w] += [(t, p) for p, x in enumerate(ws) if x == w]
        self.rare = frozenset(self.postings)

    def scan(self, data: bytes, words: list[bytes]) -> tuple[set[str], float]:
        """Labels of the templates found, and the best support among them."""
        present = sorted(self.rare.intersection(words), key=lambda w: (-self.idf[w], w))
        if not present:
            return set(), 0.0
        blanks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
        starts: dict[tuple[int, int], None] = {}
        for w in present:
            for at in np.searchsorted(blanks, places(data, w.decode())).tolist():
                for t, p in self.postings[w]:
                    starts[t, at - p] = None
        labels, best = set(), 0.0
        for t, start in starts:
            if self.templates[t].label in labels and best >= 1:
                continue
            support = self.support(t, start, words)
            if support >= SUPPORT and self.has_phrases(t, start, words):
                labels.add(self.templates[t].label)
                best = max(best, support)
        return labels, best

    def support(self, t: int, start: int, words: list[bytes]) -> float:
        """The share of the template's IDF that stands at its place, or shifted by a few words."""
        total = got = 0.0
        for p, w in enumerate(self.words[t]):
            total += self.idf[w]
            at = start + p
            if w in words[max(0, at - SHIFT) : max(0, at + SHIFT + 1)]:
                got += self.idf[w]
        return min(1.0, got / total)

    def has_phrases(self, t: int, start: int, words: list[bytes]) -> bool:
        near = b" " + b" ".join(words[max(0, start - SHIFT) : start + len(self.words[t]) + SHIFT]) + b" "
        return all(f" {p} ".encode() in near for p in self.templates[t].phrases)


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: base places and labels, and with the index's labels added, and its support."""
    index = Index(*document_frequencies(docs, templates, text), templates)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "text"):
            rows = []
            for x in texts:
                data = normal(x)
                words = data.split()
                base, at = set(), []
                for phrase, label in BASE.items():
                    if found := places(data, phrase):
                        base.add(label)
                        at += found
                labels, support = index.scan(data, words)
                first, last = (data.count(b" ", 0, f(at)) for f in (min, max)) if at else (None, None)
                rows.append((len(words), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), max(support, 1.0 if base else 0.0)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
