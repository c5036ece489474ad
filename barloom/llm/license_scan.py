"""License scans: matching statistics of files against an automaton of licence texts.

All words of a text stream through a generalised suffix automaton of the template words. Runs that
cannot be extended and have at least ``min_run`` words are anchors; anchors of one template that
advance in both the text and the template are chained, and a chain that covers enough of the
template is a licence span. Fixed phrases are found by the same automaton.

Defined cases: null and empty texts have no words, no places and score 0; repeated rows give
repeated rows; a phrase inside a longer licence text counts; further columns pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import build, inherited, matching_statistics, run_states
from .words import text_bytes, word_list

# Phrases and the label each stands for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Characteristic passages of public licence texts.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the
License, or (at your option) any later version.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone
to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to
copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

SCAN = ("struct<n_words: long, places: array<struct<label: string, first: long, last: long>>, "
        "spans: array<struct<label: string, first: long, last: long, coverage: double>>>")
_SCAN_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("places", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                                  ("coverage", pa.float64())]))),
])


def prepare(templates: dict[str, str], phrases: dict[str, str]) -> tuple:
    """Automaton of templates and phrases; where each run stands in the templates; phrase marks."""
    texts = [(label, word_list(text.encode())) for label, text in templates.items()]
    short = [(label, word_list(text.encode())) for text, label in phrases.items()]
    moves, link, longest = build(words for _, words in [*texts, *short])
    ends: dict[int, tuple] = {}
    for k, (_, words) in enumerate(texts):
        for at, state in enumerate(run_states(words, moves)):
            ends[state] = ends.get(state, ()) + ((k, at),)
    for state in sorted(range(1, len(link)), key=longest.__getitem__, reverse=True):  # a run stands where longer ones do
        if link[state] > 0:
            ends[link[state]] = tuple(set(ends.get(link[state], ()) + ends.get(state, ())))
    marks: dict[int, tuple] = {}
    for label, words in short:
        if words:
            state = run_states(words, moves)[-1]
            marks[state] = marks.get(state, ()) + ((len(words), label),)
    return (moves, link, longest, ends, inherited(link, longest, marks),
            [(label, len(words)) for label, words in texts])


def chains(anchors: list[tuple[int, int, int]], gap: int) -> list[list[tuple[int, int, int]]]:
    """Anchors (text start, template start, length) of one template linked where both advance.

    Each anchor continues the chain that leaves the smallest gap, if any is within ``gap`` words.
    """
    done: list[list] = []
    open_: list[list] = []
    for anchor in sorted(anchors):
        start, at, size = anchor
        open_, old = [c for c in open_ if start - sum(c[-1][::2]) <= gap], open_
        done += [c for c in old if c not in open_]
        fit = [c for c in open_ if start >= c[-1][0] + 1 and at > c[-1][1] and 0 <= at + size - c[-1][1] - c[-1][2]
               and at - c[-1][1] - c[-1][2] <= gap]
        if fit:
            min(fit, key=lambda c: (abs((start - at) - (c[-1][0] - c[-1][1])), -len(c))).append(anchor)
        else:
            open_.append([anchor])
    return done + open_


def scan_words(words: list[bytes], pack: tuple, min_run: int, gap: int, min_coverage: float) -> tuple[list, list]:
    """Phrase places, and template spans with their coverage."""
    moves, link, longest, ends, marks, texts = pack
    places, anchors = [], {}
    last_state = last_length = 0
    for i, (state, length) in enumerate([*matching_statistics(words, moves, link, longest), (0, 0)]):
        if last_length >= min_run and length <= last_length:  # the run before could not be extended
            for k, at in ends.get(last_state, ()):
                anchors.setdefault(k, []).append((i - last_length, at - last_length + 1, last_length))
        if length and state in marks:
            for size, label in marks[state]:
                if size <= length:
                    places.append({"label": label, "first": i - size + 1, "last": i})
        last_state, last_length = state, length
    spans = []
    for k, found in anchors.items():
        label, size = texts[k]
        for chain in chains(found, gap):
            covered = set()
            for _, at, run in chain:
                covered.update(range(at, at + run))
            if len(covered) >= min_coverage * size:
                spans.append({"label": label, "first": chain[0][0], "last": max(s + n - 1 for s, _, n in chain),
                              "coverage": len(covered) / size})
    return places, sorted(spans, key=lambda s: (s["first"], s["last"], s["label"]))


def scan_licenses(docs: DataFrame, *, text: str = "text", templates: dict[str, str] | None = None,
                  phrases: dict[str, str] | None = None, min_run: int = 5, gap: int = 40,
                  min_coverage: float = 0.5, into: str = "licenses") -> DataFrame:
    """``docs`` with a struct column: words, phrase places and covered template spans (word positions)."""
    pack = docs.sparkSession.sparkContext.broadcast(
        prepare(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases))

    @F.arrow_udf(SCAN)
    def scanned(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            words = word_list(value.as_py())
            places, spans = scan_words(words, pack.value, min_run, gap, min_coverage)
            out.append({"n_words": len(words), "places": places, "spans": spans})
        return pa.array(out, type=_SCAN_ARROW)

    return docs.withColumn(into, scanned(text_bytes(text)))


def license_digest(licenses: str, phrases: dict[str, str] | None = None) -> list[Column]:
    """Counts, labels and a score (best coverage of a template; a named licence alone counts half)."""
    places, spans = F.col(f"{licenses}.places"), F.col(f"{licenses}.spans")
    base = F.transform(places, lambda p: p["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform(spans, lambda s: s["coverage"])), F.lit(0.0))
    return [
        F.col(f"{licenses}.n_words").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["first"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform(spans, lambda s: s["label"]))).alias("labels"),
        F.greatest(best, F.when(F.size(places) > 0, 0.5).otherwise(0.0)).alias("score"),
    ]
