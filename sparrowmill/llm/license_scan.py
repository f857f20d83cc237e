"""Licence scan with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template.  A text is streamed through it once,
word by word: the state gives the longest run of template words that ends at this word (the
matching statistic).  Runs of `LEAST` words or more that can't be extended are matches; matches of
one template that lie in order in text and template are chained into a span, and the share of
the template that the chain covers is its score.  A template is reported from `SHARE` on.

Templates share passages, so a match may be part of a longer run of another template.  Matches whose
run no template extends lead: what they alone cover counts always.  A span that needs others is
reported if the template stands there whole in one run, or if its words outside the leading spans of
other labels reach `SHARE`; so a notice of one licence isn't also read as its near variants.

The three base phrases are templates of their own: one ends at a word if it is a suffix of the
current run, which each state knows.

The score is the largest share that a reported span covers of its template, or the share of the text's
words that stand in base phrases, whichever is more.

Defined results: null and empty texts have no words, no labels and score 0; a text that holds
the same template twice reports one label and, in `spans`, both places; repeated rows get equal
results; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, map_batches, pick, table, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST, SHARE, GAP = 4, 0.6, 12

#: Phrase -> label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Texts, openings and notices of public licences, label -> text (-short and -text: another template of the same label).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-short": "Licensed under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-short": "Licensed under the GNU General Public License",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "cc-by-nc-short": "Licensed under CC BY NC 4.0",
    "cc-by-sa-short": "Licensed under CC BY SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License",
    "cc-by-nd-short": "Licensed under CC BY ND 4.0",
    "cc-by-nc-sa": "This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License",
    "cc-by-nc-sa-short": "Licensed under CC BY NC SA 4.0",
    "cc-by-nc-nd": "This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License",
    "cc-by-nc-nd-short": "Licensed under CC BY NC ND 4.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-short": "Licensed under the GNU Affero General Public License",
    "lgpl-short": "Licensed under the GNU Lesser General Public License",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. Do what the fuck you want to public license terms and conditions for copying, distribution and modification. You just do what the fuck you want to.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty run."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (sequence, place of the last word)
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].add((k, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _new(self, nxt: dict[int, int], link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._new(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._new({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur


class Scanner:
    """Scans texts for templates and base phrases."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, base: dict[str, str] = BASE) -> None:
        names = [*templates, *base]
        seqs = [words_of(t) for t in [*templates.values(), *base]]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for s in seqs for w in s))}
        seqs_ids = [[self.ids[w] for w in s] for s in seqs]
        self.auto = Automaton(seqs_ids)
        self.names, self.sizes, self.n_templates = names, [len(s) for s in seqs], len(templates)
        self.base = base
        #: per state and then along its suffix links: (longest run, template, place of the last word, the template's next word or -1),
        #: each place once, at the longest run that ends there
        self.places: list[list[tuple[int, int, int, int]]] = [[] for _ in self.auto.next]
        for s in range(1, len(self.auto.next)):
            u, seen = s, set()
            while u > 0 and self.auto.length[u] >= LEAST:
                new = {(t, e) for t, e in self.auto.ends[u] - seen if t < self.n_templates}
                self.places[s] += [(self.auto.length[u], t, e, seqs_ids[t][e + 1] if e + 1 < len(seqs[t]) else -1) for t, e in sorted(new)]
                seen |= new
                u = self.auto.link[u]
        phrases = {tuple(self.ids[w] for w in words_of(p)): p for p in base}
        #: per state, the base phrases that its longest run ends with
        self.closing: list[list[tuple[int, str]]] = [[] for _ in self.auto.next]
        for p, name in phrases.items():
            s = 0
            for c in p:
                s = self.auto.next[s][c]
            for t in range(1, len(self.auto.next)):
                u = t
                while u > 0 and u != s:
                    u = self.auto.link[u]
                if u == s and self.auto.length[t] >= len(p):
                    self.closing[t].append((len(p), name))

    def label(self, name: str) -> str:
        return name.removesuffix("-short").removesuffix("-text")

    def statistics(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(place, state, length of the run that ends there), where that length isn't 0."""
        nxt, link, length, ids = self.auto.next, self.auto.link, self.auto.length, self.ids
        out, state, run, last = [], 0, 0, -2
        for i in [i for i, w in enumerate(words) if w in ids]:
            c = ids[words[i]]
            if i != last + 1:
                state = run = 0
            last = i
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state, run = nxt[state][c], run + 1
                out.append((i, state, run))
        return out

    def scan(self, text: str) -> dict:
        words = words_of(text)
        stats = self.statistics(words)
        found: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        leading: dict[int, list[tuple[int, int, int]]] = {}
        for k, (i, s, run) in enumerate(stats):
            for n, phrase in self.closing[s]:
                if run >= n:
                    found.append((i - n + 1, phrase))
            if run >= LEAST:
                longer = k + 1 < len(stats) and stats[k + 1][0] == i + 1 and stats[k + 1][2] == run + 1
                after = self.ids.get(words[i + 1]) if i + 1 < len(words) else None
                for longest, t, end, follows in self.places[s]:
                    if follows != after:
                        n = min(run, longest)
                        matches.setdefault(t, []).append((i - n + 1, end - n + 1, n))
                        if n == run and not longer:
                            leading.setdefault(t, []).append(matches[t][-1])
        spans = [(self.label(self.names[t]), a, b, round(share, 6)) for t, a, b, share in self._spans(matches, leading)]
        base = sorted({self.base[p] for _, p in found})
        labels = sorted({*base, *(x[0] for x in spans)})
        # a base phrase covers its own words only
        named = len({w for a, p in found for w in range(a, a + len(p.split()))})
        score = max(named / max(1, len(words)), *(x[3] for x in spans), 0.0)
        starts = [a for a, _ in found]
        return {"n_words": len(words), "n_base": len(found), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": ",".join(base), "labels": ",".join(labels), "score": score, "spans": ",".join(f"{n}:{a}:{b}" for n, a, b, _ in sorted(spans, key=lambda x: (x[1], x[2], x[0])))}

    def _spans(self, matches: dict[int, list], leading: dict[int, list]) -> list[tuple[int, int, int, float]]:
        """Reported spans (template, first word, last word + 1, share of the template)."""
        strong = {t: self._chains(t, rows) for t, rows in leading.items()}
        taken: dict[str, set[int]] = {}  # per label, the words of its leading spans
        for t, chains in strong.items():
            taken.setdefault(self.label(self.names[t]), set()).update(w for *_, chain in chains for a, _, n in chain for w in range(a, a + n))
        out = []
        for t, rows in matches.items():
            own = strong.get(t, [])
            open_rows = {x for *_, chain in own for x in chain}
            others = set().union(*(w for name, w in taken.items() if name != self.label(self.names[t])))
            for first, last, share, chain in self._chains(t, rows):
                free = sum(w not in others for a, _, n in chain for w in range(a, a + n))
                whole = any(n == self.sizes[t] for *_, n in chain)
                if whole or free >= SHARE * self.sizes[t] or not open_rows.isdisjoint(chain):
                    out.append((t, first, last, share))
                    open_rows.difference_update(chain)
            out += [(t, first, last, share) for first, last, share, chain in own if open_rows.issuperset(chain)]
        return out

    def _chains(self, t: int, rows: list[tuple[int, int, int]]) -> list[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """Spans (first word, last word + 1, share of the template, matches): a match goes on with the chain of most words
        among those it lies after in text and template, within GAP words; each match is in one span at most."""
        rows = sorted(rows)
        best, before = [], []
        ending: dict[int, list[int]] = {}  # by first word after the match
        for j, (a, b, n) in enumerate(rows):
            ahead = [i for at in range(a - GAP, a + 1) for i in ending.get(at, ()) if rows[i][1] + rows[i][2] <= b]
            i = max(ahead, key=best.__getitem__, default=-1)
            before.append(i)
            best.append(n + (best[i] if i >= 0 else 0))
            ending.setdefault(a + n, []).append(j)
        out, used = [], set()
        for j in sorted(range(len(rows)), key=lambda j: (-best[j], j)):
            chain = []
            while j >= 0 and j not in used:
                used.add(j)
                chain.append(rows[j])
                j = before[j]
            n = sum(x[2] for x in chain)
            if n >= SHARE * self.sizes[t]:
                out.append((chain[-1][0], chain[0][0] + chain[0][2], min(1.0, n / self.sizes[t]), chain))
        return out


def scanner() -> Scanner:
    return held(Scanner, Scanner)


COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.string()}


def _scan(batch: pa.RecordBatch) -> dict:
    rows = [scanner().scan(t) for t in texts_of(batch.column(1))]
    return {"doc_id": batch.column(0)} | {k: pa.array([r[k] for r in rows], kind) for k, kind in COLUMNS.items()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label:first:end of words)."""
    return map_batches(pick(docs, "doc_id", "text"), _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *[F.col(c) for c in COLUMNS])


QUERIES = {"op1_license_scan": query}
