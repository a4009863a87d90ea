"""License scans: matching statistics against a generalised suffix automaton of license texts.

One automaton over words holds every template. A file's words stream through it; after each word the
automaton knows the longest run of words, ending there, that occurs in any template (its matching
statistic). Where that run cannot grow, it is a maximal match. Matches of ``min_match`` words or more
are chained, in order and with bounded gaps, into spans of one template, and a span that covers
enough of its template names the license. Short base phrases are templates of the same automaton: a phrase
ends at a word exactly when its state is on the suffix path of the state reached and the run is long enough.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import ship
from .common import column, slices, utf8_bytes
from .license_texts import TEXTS

#: Most bytes of templates read from a table or folder.
MOST_BYTES = 64 << 20

# Base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices of public licenses, by SPDX-like label.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license, version 2.0",
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
    ],
    "bsd": [
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license, version 3",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/",
    ],
    "cc-by-nc-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-4.0": ["this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0-1.0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
}
_NOTICE = "this {} is free software: you can redistribute it and/or modify it under the terms of the gnu {}general public license as published by the free software foundation, either version {} of the license, or (at your option) any later version."
for _label, _what, _kind, _version in (("gpl-2.0", "program", "", "2"), ("agpl-3.0", "program", "affero ", "3"), ("lgpl-2.1", "library", "lesser ", "2.1"), ("lgpl-3.0", "program", "lesser ", "3")):
    TEMPLATES[_label] = [f"licensed under the gnu {_kind}general public license, version {_version}", _NOTICE.format(_what, _kind, _version)]


def passages(text: str, least: int = 40) -> list[str]:
    """The text's paragraphs, one a line; short ones go with those after them, or at the end before them."""
    out, held = [], []
    for line in text.strip().split("\n"):
        held += line.split()
        if len(held) >= least:
            out.append(held)
            held = []
    if held:
        out[-1:] = [out[-1] + held] if out else [held]
    return [" ".join(x) for x in out]


#: Notices, whole texts, and each passage of a whole text: a part of a license names it too.
for _label, _text in TEXTS.items():
    TEMPLATES[_label] = list(dict.fromkeys([*TEMPLATES.get(_label, []), " ".join(_text.split()), *passages(_text)]))

#: Bytes outside the word class become blanks; A-Z become a-z.
_TABLE = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


class TemplateAutomaton:
    """Generalised suffix automaton of word sequences, with the ends of each state's runs in the templates."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.link, self.length, self.next = [-1], [0], [{}]
        self.sequences: list[tuple[str, int]] = []  # label and number of words
        ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
        paths: list[list[int]] = []
        for label, texts in templates.items():
            for text in texts:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text.encode())]
                for at, state in enumerate(self._add(ids)):
                    ends[state].add((len(self.sequences), at))
                self.sequences.append((label, len(ids)))
        for phrase in phrases:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(phrase.encode())]
            self._add(ids)
            paths.append(ids)
        order = sorted(range(1, len(self.link)), key=lambda s: -self.length[s])
        for s in order:
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(ends[s]) for s in range(len(self.link))]
        phrase_state = {}
        for k, ids in enumerate(paths):
            s = 0
            for w in ids:
                s = self.next[s][w]
            phrase_state.setdefault(s, []).append((k, len(ids)))
        self.phrases_at: list[list[tuple[int, int]]] = [[] for _ in self.link]
        for s in reversed(order):
            self.phrases_at[s] = phrase_state.get(s, []) + (self.phrases_at[self.link[s]] if self.link[s] > 0 else [])
        self.labels = list(phrases.values())
        #: Words of the shortest and longest template and of the shortest phrase.
        self.shortest, self.longest = (f((n for _, n in self.sequences if n), default=1) for f in (min, max))
        self.briefest = min((len(p) for p in paths if p), default=1)

    def _add(self, ids: list[int]) -> list[int]:
        """Extends the automaton by one sequence; the state of each of its prefixes."""
        last, states = 0, []
        for w in ids:
            if w in self.next[last]:
                old = self.next[last][w]
                last = old if self.length[old] == self.length[last] + 1 else self._split(last, w, old)
            else:
                new = self._state(self.length[last] + 1, {})
                p = last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p < 0:
                    self.link[new] = 0
                else:
                    old = self.next[p][w]
                    self.link[new] = old if self.length[old] == self.length[p] + 1 else self._split(p, w, old)
                last = new
            states.append(last)
        return states

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.link.append(0)
        self.length.append(length)
        self.next.append(edges)
        return len(self.link) - 1

    def _split(self, p: int, w: int, old: int) -> int:
        half = self._state(self.length[p] + 1, dict(self.next[old]))
        self.link[half], self.link[old] = self.link[old], half
        while p >= 0 and self.next[p].get(w) == old:
            self.next[p][w] = half
            p = self.link[p]
        return half

    def run(self, ids: np.ndarray, offset: int):
        """Yields (position, state, run length) after each word of a stretch of known words."""
        state, n, nxt, link, length = 0, 0, self.next, self.link, self.length
        for i, w in enumerate(ids.tolist(), offset):
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            yield i, state, n


def scan_words(words: list[bytes], automaton: TemplateAutomaton, min_match: int = 3, max_gap: int = 8, min_cover: float = 0.6) -> dict:
    """Base hits, spans and labels of one file's words. A template shorter than ``min_match`` words matches as a whole."""
    get = automaton.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words))
    known = np.flatnonzero(ids)
    base: list[tuple[int, int]] = []
    matches: list[tuple[int, int, int]] = []  # end position, run length, state
    least = min(min_match, automaton.shortest)
    cuts = np.flatnonzero(np.diff(known) > 1) + 1
    for lo, hi in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(known)].tolist(), strict=True):
        if hi - lo < min(least, automaton.briefest):
            continue
        first, previous = int(known[lo]), None
        for step in automaton.run(ids[first : first + hi - lo], first):
            i, state, n = step
            for k, size in automaton.phrases_at[state]:
                if n >= size:
                    base.append((i - size + 1, k))
            if previous and n <= previous[2] and previous[2] >= least:
                matches.append((previous[0], previous[2], previous[1]))
            previous = step
        if previous[2] >= least:
            matches.append((previous[0], previous[2], previous[1]))
    spans = chain(matches, automaton, min_match, max_gap)
    found = [s for s in spans if s["covered"] >= min_cover * automaton.sequences[s["sequence"]][1]]
    return {"base": base, "spans": strongest(found)}


def strongest(spans: list[dict]) -> list[dict]:
    """Without those spans that lie within another label's span of more covered words: licenses share passages."""
    if len({s["label"] for s in spans}) < 2:
        return spans
    start, end, covered = (np.array([s[k] for s in spans]) for k in ("start", "end", "covered"))
    label = np.array([s["label"] for s in spans], dtype=object)
    return [s for s in spans if not ((start <= s["start"]) & (end >= s["end"]) & (covered > s["covered"]) & (label != s["label"])).any()]


_AUTOMATA: dict[str, TemplateAutomaton] = {}


def built(templates: dict[str, list[str]], phrases: dict[str, str]) -> TemplateAutomaton:
    """The worker's automaton, kept between tasks."""
    key = repr((templates, phrases))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = TemplateAutomaton(templates, phrases)
    return _AUTOMATA[key]


def chain(matches: list[tuple[int, int, int]], automaton: TemplateAutomaton, min_match: int, max_gap: int) -> list[dict]:
    """Spans of templates: per template, the chains of matches that cover most, by dynamic programming.

    Each place of a match in a template is an anchor (file words, template words). An anchor may follow another one that ends
    before it in both, after an overlap is cut from its front, if the gap is ``max_gap`` words or fewer in both. The best
    chain up to an anchor covers its own words and the best chain before it. Chains are taken from the best end down,
    as long as they share no file word with one taken; so a template that starts again is a span of its own.
    """
    anchors: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # sequence: (file end, template end, words)
    for end, n, state in matches:
        for sequence, at in automaton.ends[state]:
            size = automaton.sequences[sequence][1]
            run = min(n, at + 1)
            if run >= min(min_match, size):
                anchors[sequence].append((end, at, run))
    out = []
    for sequence, found in anchors.items():
        found.sort()
        best, before, begin = [], [], []
        first = 0
        for i, (end, at, run) in enumerate(found):
            cover, link = run, -1
            while found[first][0] < end - run - max_gap:  # no later anchor is nearer: ends only grow
                if found[first][0] >= end - automaton.longest - max_gap:
                    break
                first += 1
            for j in range(i - 1, first - 1, -1):
                e, a, _ = found[j]
                cut = max(0, e - (end - run), a - (at - run))
                if cut >= run or e >= end or a >= at:
                    continue
                if end - run + cut - e <= max_gap and at - run + cut - a <= max_gap and best[j] + run - cut > cover:
                    cover, link = best[j] + run - cut, j
            best.append(cover)
            before.append(link)
            begin.append(begin[link] if link >= 0 else end - run + 1)
        taken: list[tuple[int, int]] = []
        for i in sorted(range(len(found)), key=lambda i: (-best[i], found[i][0])):
            start, end = begin[i], found[i][0]
            if all(end < s or start > e for s, e in taken):
                taken.append((start, end))
                out.append({"sequence": sequence, "label": automaton.sequences[sequence][0], "start": start, "end": end, "covered": best[i]})
    return sorted(out, key=lambda s: (s["start"], s["end"], s["sequence"]))


def read_templates(spark: SparkSession, source: str) -> dict[str, list[str]]:
    """Templates of a catalog table or a folder of Parquet (label, text), or of a folder of text files named by their labels.

    They go to every executor, so their size is checked: ``MOST_BYTES`` at most.
    """
    if "/" not in source:
        rows = spark.table(source).select("label", "text")
    elif source.rstrip("/").endswith(".parquet"):
        rows = spark.read.parquet(source).select("label", "text")
    else:
        files = spark.read.text(source, wholetext=True).withColumn("label", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1))
        rows = files.select("label", F.col("value").alias("text"))
    rows = rows.filter("label IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    if size > MOST_BYTES:
        raise ValueError(f"{size} bytes of templates are more than {MOST_BYTES}")
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("label", "text").collect():
        out[r.label] = list(dict.fromkeys([*out.get(r.label, []), " ".join(r.text.split()), *passages(r.text)]))
    return out


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None, min_match: int = 3, max_gap: int = 8, min_cover: float = 0.6) -> DataFrame:
    """Spans and labels of every file: one pass over whole texts, without a shuffle.

    Null and empty texts have no words, no labels and the score 0. A row of the result stands for each row of
    the input, repeated ones too; other columns are left out. ``score`` is the largest covered share of a
    template, 1 where a base phrase stands. ``spans`` lists the label, first and last word and cover of each span. A null key
    stays null.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = built(templates or TEMPLATES, phrases or BASE_PHRASES)
        for batch in batches:
            for part in slices(batch, 512):
                rows: dict[str, list] = defaultdict(list)
                for raw in utf8_bytes(column(part, text)):
                    words = words_of(raw)
                    got = scan_words(words, automaton, min_match, max_gap, min_cover)
                    base, spans = got["base"], got["spans"]
                    labels = sorted({automaton.labels[k] for _, k in base})
                    rows["n_words"].append(len(words))
                    rows["n_base"].append(len(base))
                    rows["first_word"].append(min((i for i, _ in base), default=None))
                    rows["last_word"].append(max((i for i, _ in base), default=None))
                    rows["base_labels"].append(",".join(labels))
                    rows["labels"].append(",".join(sorted({*labels, *(s["label"] for s in spans)})))
                    covers = [s["covered"] / automaton.sequences[s["sequence"]][1] for s in spans]
                    rows["score"].append(min(1.0, max([1.0 if base else 0.0, *covers])))
                    rows["spans"].append([{"label": s["label"], "first": s["start"], "last": s["end"], "cover": c} for s, c in zip(spans, covers, strict=True)])
                kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("cover", pa.float64())]))}
                yield pa.RecordBatch.from_arrays([column(part, key), *(pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items())], [key, *rows])

    schema = f"{key} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,cover:double>>"
    return docs.select(key, text).mapInArrow(run, schema)
