"""Operator 7, licence scans: a generalised suffix automaton of licence tokens and chained long matches.

The automaton is built from the token sequences of all templates and phrases (a fixed, small set). Each text's words
stream through it; a position's matching statistic is the length of the longest run of template tokens that ends
there. Statistics above one need neighbouring words that are neighbours in a template, so only such stretches are
streamed; the rest is known to be 0 or 1. Where the statistic reaches ``MIN_MATCH``, each template's own matches of at
least that many tokens are collected: those that this template cannot extend, whether or not another one goes on. They
are chained per template, in order in text and template, over gaps of at most ``MAX_GAP`` words; a chain that covers at
least ``MIN_COVER`` of its template gives a span and the template's label. Spans of one template do not overlap. A span
that leaves tokens of its template out gives way to a template of another label that matches all of its words and more
(versions of a licence differ in few words). The base phrases are found in the same stream.

Null and empty texts have no words and no labels; repeated rows, null ids and extra columns are kept as they are.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, hash_words, slices, table
from .registry import query

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence notices and texts, by label.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "Licensed under the BSD License",
    ],
    "isc": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "gpl-2.0": [
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ],
    "lgpl": [
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation""",
        "Licensed under the GNU Lesser General Public License",
    ],
    "agpl": ["Licensed under the GNU Affero General Public License", "terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
}
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 6, 0.75


def tokens(text: str) -> list[str]:
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    return "".join(chr(b) if ALNUM[b] else " " for b in lowered).split() if lowered.isascii() else lowered.decode().split()


class Automaton:
    """A suffix automaton over several token sequences; each state knows where its strings end in the templates."""

    def __init__(self, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None):
        self.phrases = [(tokens(p), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        given = TEMPLATES if templates is None else templates
        self.templates = [(tokens(t), label) for label, some in given.items() for t in some]
        words = sorted({w for seq, _ in [*self.templates, *self.phrases] for w in seq})
        self.ids = {w: k for k, w in enumerate(words)}
        hashes = hash_words(words)
        self.order = np.argsort(hashes)
        self.known = hashes[self.order]
        self.pairs = np.zeros((len(words) + 1, len(words) + 1), dtype=bool)
        self.places_of: dict[int, list[int]] = {}  # of each token, over all templates in a row, one place between them
        self.origin: list[tuple[int, int]] = []  # per such place: template, tokens up to and with it
        for k, (seq, _) in enumerate(self.templates):
            for at, w in enumerate(seq):
                self.places_of.setdefault(self.ids[w], []).append(len(self.origin))
                self.origin.append((k, at + 1))
            self.origin.append((k, 0))
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, (seq, _) in enumerate([*self.templates, *self.phrases]):
            ids = [self.ids[w] for w in seq]
            self.pairs[ids[:-1], ids[1:]] = True
            last = 0
            for at, c in enumerate(ids):
                last = self._extend(last, c)
                self.ends[last].add((k, at + 1))
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        holder = {}  # the state whose strings include a phrase
        for p, (seq, _) in enumerate(self.phrases):
            state = 0
            for w in seq:
                state = self.next[state][self.ids[w]]
            holder.setdefault(state, []).append((p, len(seq)))
        self.phrase_at = []  # per state: phrases that its longest string ends with
        for s in range(len(self.size)):
            own, up = [], s
            while up > 0:
                own += holder.get(up, [])
                up = self.link[up]
            self.phrase_at.append(own)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, c, q)
        cur = self._state(self.size[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, size: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.size.append(size)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._state(self.size[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers of word hashes; the last number stands for all unknown words."""
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.order[at], len(self.known))

    def stream(self, codes: list[int], base: int, places: list, matches: list) -> int:
        """Feed one stretch that starts at word ``base``; collect phrase places and the matches that no sequence extends.

        Returns the largest matching statistic.
        """
        state = length = most = 0
        for at, c in enumerate([*codes, -1]):
            was, had = state, length
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                state = length = 0
            most = max(most, length)
            if length <= had and had >= MIN_MATCH:
                for k, end in self.ends[was]:
                    if k < len(self.templates):
                        matches.append((k, base + at - had, end - had, had))
            for p, size in self.phrase_at[state]:
                if length >= size:
                    places.append((base + at + 1 - size, p))
        return most

    def runs(self, codes: list[int], base: int, matches: list) -> None:
        """Collect from one stretch, for each template, the matches that this template does not extend."""
        live: dict[int, int] = {}  # by the place that would go on: tokens so far
        for at, c in enumerate([*codes, -1]):
            following = {g + 1: live.get(g, 0) + 1 for g in self.places_of.get(c, ())}
            for g, n in live.items():
                if n >= MIN_MATCH and g + 1 not in following:
                    k, end = self.origin[g - 1]
                    matches.append((k, base + at - n, end - n, n))
            live = following

    def chains(self, matches: list) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, label, covered share) of each covered template span."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, start, at, size in sorted(set(matches)):
            by.setdefault(k, []).append((start, at, size))
        best = {k: self._best(found, len(self.templates[k][0])) for k, found in by.items()}

        def words(k: int, i: int) -> set[int]:
            """Words matched by the chain that ends with match ``i``."""
            held: set[int] = set()
            while i >= 0:
                start, _, size = by[k][i]
                held.update(range(start, start + size))
                i = best[k][i][2]
            return held

        def explained(k: int, i: int) -> bool:
            """Whether a template of another label matches all words of this chain and more."""
            own = words(k, i)
            last = max(own)
            for other, found in by.items():
                if self.templates[other][1] == self.templates[k][1]:
                    continue
                total = len(self.templates[other][0])
                for j in range(bisect_right(found, last, key=lambda m: m[0]) - 1, -1, -1):
                    start, _, size = found[j]
                    if start + total <= last:
                        break
                    if start + size > last and own < words(other, j):
                        return True
            return False

        out = []
        for k, found in by.items():
            total = len(self.templates[k][0])
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(found)), key=lambda i: (-best[k][i][0], found[i])):
                covered, first, end = best[k][i][0], -best[k][i][1], found[i][0] + found[i][2]
                if covered < MIN_COVER * total:
                    break
                at = bisect_right(taken, (first, end))
                if (at and taken[at - 1][1] > first) or (at < len(taken) and taken[at][0] < end) or (covered < total and explained(k, i)):
                    continue
                insort(taken, (first, end))
                out.append((first, end, self.templates[k][1], min(1.0, covered / total)))
        return sorted(out)

    @staticmethod
    def _best(found: list[tuple[int, int, int]], total: int) -> list[tuple[int, int, int]]:
        """Per match of a template: covered tokens and negative first word of the best chain that ends with it, and the match before it or -1."""
        best: list[tuple[int, int, int]] = []
        for i, (start, at, size) in enumerate(found):
            value = (size, -start, -1)
            for j in range(i - 1, -1, -1):
                s, a, n = found[j]
                if s + total + MAX_GAP < start:
                    break
                over = max(0, s + n - start, a + n - at)
                if start > s and at > a and over < size and start - (s + n) <= MAX_GAP and at - (a + n) <= MAX_GAP:
                    value = max(value, (best[j][0] + size - over, best[j][1], j))
            best.append(value)
        return best


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))),
    T.StructField("covered", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()),
        T.StructField("share", T.DoubleType())])))])
_PLACES = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_COVERED = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``places`` (word, label) of phrases and ``covered`` template spans (first, end, label, share)."""
    def run(batches):
        found = Automaton()
        for part, texts in slices(batches, text):
            words = Words(texts, ALNUM)
            codes = found.codes(words.hash)
            joined = found.pairs[codes[:-1], codes[1:]] if len(codes) > 1 else np.zeros(0, bool)
            starts = words.lo[1:]
            starts = starts[(starts > 0) & (starts < len(codes))]
            joined[starts - 1] = False
            places, matches = {}, {}
            edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                r = int(np.searchsorted(words.lo, a, "right")) - 1
                stretch, base = codes[a : b + 1].tolist(), a - int(words.lo[r])
                if found.stream(stretch, base, places.setdefault(r, []), []) >= MIN_MATCH:
                    found.runs(stretch, base, matches.setdefault(r, []))
            rows = range(len(texts))
            places = [[{"word": w, "label": found.phrases[p][1]} for w, p in sorted(places.get(r, ()))] for r in rows]
            covered = [[dict(zip(("first", "end", "label", "share"), c)) for c in found.chains(matches[r])] if matches.get(r) else [] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(words.counts().astype(np.int64)), pa.array(places, _PLACES), pa.array(covered, _COVERED)],
                names=[*part.schema.names, *RESULT.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *RESULT.fields]))


@query("op7_licence_scan")
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("covered", lambda c: c["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    start = F.transform("places", lambda p: p["word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("covered", lambda c: c["share"])), F.lit(0.0))).alias("score"))
