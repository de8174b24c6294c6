"""Licence scans with a positional index of rare words.

A licence is a set of passages.  Each passage's rarest words, those of the
highest IDF among the passages, are posted with their positions: as many that
a text which agrees with the passage in the wanted share of places must hold
some of them, each at its place.  A file looks up the posted words it
holds, highest IDF first; a lookup votes for the passages that post the word,
at the offset that would lay the passage over the file, and where enough words
agree on an offset the passage is compared there place by place.  A label is
given if the wanted share agrees and the passage's mandatory phrases stand
word for word at their places.

IDF is that of the passages, so a file's labels depend on the file alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.common import own_name, tidy

#: The same as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over lower-cased UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Phrases that give a label wherever their words stand consecutively.
BASE_PHRASES: Mapping[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    """A passage of a licence, or of a notice that names one, and the phrases without which it is none."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Passages of public licences and notices.
TEMPLATES: tuple[Template, ...] = (
    Template("mit", "released under the MIT License", ("mit license",)),
    Template("mit", "licensed under the MIT license", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("copyright notice and this permission notice shall be included",)),
    Template("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ("the authors or copyright holders be liable for any claim", "other dealings in the software")),
    Template("apache", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2 0", "except in compliance with the license")),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("unless required by applicable law or agreed to in writing", "language governing permissions and limitations under the license")),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu general public license", "free software foundation")),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license",)),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program", ("gnu general public license",)),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license", "free software foundation")),
    Template("agpl", "licensed under the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license", "free software foundation")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", ("redistributions of source code must retain the above copyright notice",)),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ("redistributions in binary form must reproduce the above copyright notice",)),
    Template("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("may be used to endorse or promote products derived from this software",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("the author disclaims all warranties with regard to this software",)),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("in no event will the authors be held liable for any damages",)),
    Template("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", ("the origin of this software must not be misrepresented",)),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost software license",)),
    Template("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ("any person or organization obtaining a copy of the software", "prepare derivative works of the software")),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at", ("a copy of the mpl was not distributed with this file",)),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("eclipse public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("free and unencumbered software released into the public domain",)),
    Template("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("anyone is free to copy modify publish use compile sell or distribute this software",)),
    Template("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", ("changing it is allowed as long as the name is changed",)),
    Template("cc-by", "licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-nc", "licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("creative commons attribution noderivatives",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0 1 0 universal",)),
)

#: The share of a passage's places that must agree.
THRESHOLD = 0.8


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall(text.lower()) if text else []


def _split(phrase: str) -> tuple[bytes, ...]:
    return tuple(words_of(phrase.encode()))


@dataclass
class Index:
    """What is sent to the executors; its size depends on the passages only."""

    templates: Sequence[Template]
    threshold: float = THRESHOLD
    words: list[tuple[bytes, ...]] = field(default_factory=list)
    idf: dict[bytes, float] = field(default_factory=dict)
    #: Word to (passage, position): each passage's rarest words.
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=dict)
    #: How many posted words must agree on an offset.
    need: list[int] = field(default_factory=list)
    #: (position, words) of each passage's mandatory phrases.
    phrases: list[list[tuple[int, tuple[bytes, ...]]]] = field(default_factory=list)


def build_index(templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> Index:
    """The positional index of the passages' rarest words.

    Of a passage of L words ceil(threshold * L) places must agree.  With
    L - that + n words posted, n of them agree in any match, so the index
    misses none.
    """
    out = Index(tuple(templates), threshold, [_split(t.text) for t in templates])
    held: dict[bytes, int] = {}
    for ws in out.words:
        for w in set(ws):
            held[w] = held.get(w, 0) + 1
    out.idf = {w: math.log(1 + len(templates) / n) for w, n in held.items()}
    for t, ws in enumerate(out.words):
        if not ws:
            raise ValueError("a template without words")
        out.need.append(2 if len(ws) >= 8 else 1)
        most = len(ws) - math.ceil(threshold * len(ws)) + out.need[t]
        rarest = sorted(range(len(ws)), key=lambda i: (-out.idf[ws[i]], -len(ws[i]), i))[:most]
        for i in sorted(rarest):
            out.postings.setdefault(ws[i], []).append((t, i))
        places = []
        for p in map(_split, templates[t].phrases):
            at = next((i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p), None)
            if at is None:
                raise ValueError(f"a mandatory phrase is no part of its template: {b' '.join(p).decode()}")
            places.append((at, p))
        out.phrases.append(places)
    return out


def agreement(words: Sequence[bytes], index: Index, t: int, offset: int) -> float:
    """The share of passage ``t``'s places that agree at an offset; 0 if a mandatory phrase doesn't stand at its place."""
    for at, p in index.phrases[t]:
        at += offset
        if at < 0 or tuple(words[at : at + len(p)]) != p:
            return 0.0
    own = index.words[t]
    skip = max(0, -offset)
    return sum(map(bytes.__eq__, own[skip:], words[offset + skip : offset + len(own)])) / len(own)


def scan(text: bytes | None, index: Index, base: Mapping[str, str] = BASE_PHRASES) -> tuple:
    """The values of ``FIELDS`` for one whole text."""
    words = words_of(text)
    ends: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = {}
    for phrase, label in base.items():
        p = _split(phrase)
        ends.setdefault(p[-1], []).append((p, label))
    wanted = index.postings.keys() | ends.keys()
    at: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in wanted:
            at.setdefault(w, []).append(i)
    starts, base_labels = [], set()
    for w, phrases in ends.items():
        for i in at.get(w, ()):
            for p, label in phrases:
                j = i - len(p) + 1
                if j >= 0 and tuple(words[j : i + 1]) == p:
                    starts.append(j)
                    base_labels.add(label)
    votes: dict[tuple[int, int], int] = {}
    best: dict[int, float] = {}
    for w in sorted((w for w in at if w in index.postings), key=lambda w: (-index.idf[w], w)):
        open_ = [(t, j) for t, j in index.postings[w] if best.get(t, 0.0) < 1.0]  # a whole passage was found: no better place
        for i in at[w] if open_ else ():
            for t, j in open_:
                n = votes[t, i - j] = votes.get((t, i - j), 0) + 1
                if n == index.need[t]:
                    best[t] = max(best.get(t, 0.0), agreement(words, index, t, i - j))
    scores: dict[str, float] = {}
    for t, share in best.items():
        if share >= index.threshold:
            label = index.templates[t].label
            scores[label] = max(scores.get(label, 0.0), share)
    labels = sorted(base_labels | scores.keys())
    score = max([*scores.values(), 1.0 if base_labels else 0.0])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(labels), score)


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
_TYPE = T.StructType([T.StructField(n, T.LongType() if i < 4 else T.StringType() if i < 6 else T.DoubleType()) for i, n in enumerate(FIELDS)])


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without its text, with the fields of ``FIELDS``.

    One pass over the texts, no shuffle.  Null and empty texts have no words,
    empty labels and score 0; texts of any length are scanned whole; repeated
    rows get the same values each; an empty table gives an empty one.  Of
    several places of a passage the best counts, and ties give the same
    values.  A base label alone scores 1.  Columns of ``docs`` that have one
    of the fields' names are replaced.
    """
    index = docs.sparkSession.sparkContext.broadcast(build_index(templates, threshold))

    @F.arrow_udf(_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        own = index.value
        rows = [scan(x.as_py(), own) for x in texts.cast(pa.large_binary())]
        columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return tidy(pa.StructArray.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=list(FIELDS)))

    (f,) = own_name(docs, "found__")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c.lower() not in FIELDS]
    return docs.select(*kept, found(F.col(f"`{text_col}`")).alias(f)).select(*kept, *[F.col(f"{f}.{x}").alias(x) for x in FIELDS])
