"""License scans by template markup: templates compile to token automata that accept exact mandatory wording.

Markup: <<optional>>...<<end>> may be absent; <<either>>...<<or>>...<<end>> is one of its parts; <<any:N>> stands for up to N words of the text's own.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow

#: Phrases and labels found wherever their words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates by label, in the markup above. Public licence wording; a *-text or *-notice runs to the licence's last
#: mandatory word, its disclaimer included.
TEMPLATES = {
    "mit-reference": "<<optional>>This <<any:4>> is<<end>> <<optional>>released<<end>> <<optional>>licensed<<end>> <<optional>>distributed<<end>> under the <<optional>>terms of the<<end>> MIT License",
    "apache-2.0-reference": "Licensed under the <<optional>>terms of the<<end>> Apache License <<optional>>,<<end>> Version 2.0",
    "gpl-2.0-reference": "licensed under the <<optional>>terms of the<<end>> <<optional>>GNU<<end>> General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 2",
    "gpl-3.0-reference": "licensed under the <<optional>>terms of the<<end>> <<optional>>GNU<<end>> General Public License <<optional>>as published by the Free Software Foundation<<end>> <<optional>>either<<end>> version 3",
    "cc-by-reference": "Licensed under <<optional>>the terms of the<<end>> <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY <<optional>>4.0<<end>>",
    "cc-by-nc-reference": "Licensed under <<optional>>the terms of the<<end>> <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY NC <<optional>>4.0<<end>>",
    "cc-by-sa-reference": "Licensed under <<optional>>the terms of the<<end>> <<optional>>a<<end>> <<optional>>Creative Commons<<end>> CC BY SA <<optional>>4.0<<end>>",
    "all-rights-reserved": "Copyright <<optional>>c<<end>> <<any:8>> All rights reserved",
    "mit-text": "Permission is hereby granted free of charge to any person obtaining a copy of <<any:6>> and associated documentation files <<optional>>the Software<<end>> to deal in <<any:3>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of <<any:3>> and to permit persons to whom <<any:3>> is furnished to do so subject to the following conditions The above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of <<any:3>> the Software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<either>>noninfringement<<or>>non infringement<<end>> in no event shall <<any:20>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the Software or the use or other dealings in the Software",
    "isc-text": "Permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<any:20>> <<either>>disclaims<<or>>disclaim<<end>> all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<any:20>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<<end>> Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution This software is provided by <<any:20>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:20>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<optional>>1<<end>> Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<optional>>2<<end>> Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<optional>>3<<end>> Neither the name of <<any:20>> nor the names of <<any:10>> contributors may be used to endorse or promote products derived from this software without specific prior written permission This software is provided by <<any:20>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<any:20>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "apache-2.0-notice": "Licensed under the Apache License Version 2.0 the License you may not use <<any:4>> except in compliance with the License You may obtain a copy of the License at <<optional>>http<<end>> <<optional>>https<<end>> www apache org licenses LICENSE 2.0 <<optional>>txt<<end>> <<optional>>html<<end>> Unless required by applicable law or agreed to in writing software distributed under the License is distributed on an as is basis without warranties or conditions of any kind either express or implied See the License for the specific language governing permissions and limitations under the License",
    "unlicense-text": "This is free and unencumbered software released into the public domain Anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or <<either>>non commercial<<or>>noncommercial<<end>> and by any means In jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the Software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<either>>noninfringement<<or>>non infringement<<end>> in no event shall <<any:20>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the Software or the use or other dealings in the Software",
}


def _gnu_notice(licence: str, version: str) -> str:
    """The notice of a GNU licence, which names the licence three times."""
    return f"is free software you can redistribute it and or modify it under the terms of the GNU {licence} as published by the Free Software Foundation <<either>>either version {version} of the License or at your option any later version<<or>>version {version} <<optional>>of the License<<end>><<end>> <<any:8>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose See the GNU {licence} for more details"


TEMPLATES |= {
    "gpl-2.0-notice": _gnu_notice("General Public License", "2"),
    "gpl-3.0-notice": _gnu_notice("General Public License", "3"),
    "lgpl-2.1-notice": _gnu_notice("Lesser General Public License", "2.1"),
    "lgpl-3.0-notice": _gnu_notice("Lesser General Public License", "3"),
    "agpl-3.0-notice": _gnu_notice("Affero General Public License", "3"),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0 If a copy of the MPL was not distributed with this file You can obtain one at <<optional>>http<<end>> <<optional>>https<<end>> <<optional>>www<<end>> mozilla org MPL 2.0",
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A part of a word that templates are held against: letters, digits and their marks.
_PART = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_LOWER = {k: k + 32 for k in range(65, 91)}
_MARK = re.compile(r"<<(optional|either|or|end|any:\d+)>>")


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def template_words(w: list[str]) -> tuple[list[str], list[int] | None]:
    """The words that templates see, and the place of each in w (None: the same). Signs beyond ASCII, such as
    typographic quotes, dashes and the copyright sign, are letters of base words but part words here."""
    if all(x.isascii() for x in w):
        return w, None
    parts, places = [], []
    for k, x in enumerate(w):
        for part in (x,) if x.isascii() else _PART.findall(x):
            parts.append(part)
            places.append(k)
    return parts, places


class Either:
    """Parts of a template of which one must stand."""

    def __init__(self, parts: list[list]):
        self.parts = parts


class Automaton:
    """A template's states: (word, or None for any word; states that follow). State -1 accepts."""

    def __init__(self, template: str):
        self.steps: list[tuple[str | None, tuple[int, ...]]] = []
        items: list = []
        depth, parts, at = [items], [], 0  # parts: of open eithers, None for optionals
        for m in _MARK.finditer(template):
            depth[-1] += words(template[at : m.start()])
            at = m.end()
            if m[1] == "optional":
                depth[-1].append(part := [])
                depth.append(part)
                parts.append(None)
            elif m[1] == "either":
                parts.append([[]])
                depth[-1].append(Either(parts[-1]))
                depth.append(parts[-1][0])
            elif m[1] == "or":
                parts[-1].append([])
                depth[-1] = parts[-1][-1]
            elif m[1] == "end":
                depth.pop()
                parts.pop()
            else:
                depth[-1].append(int(m[1][4:]))
        depth[-1] += words(template[at:])
        self.starts = self._build(items, (-1,))
        self.anchors = {self.steps[s][0] for s in self.starts}
        #: Words that every accepted text holds.
        self.mandatory = frozenset(x for x in items if isinstance(x, str))

    def _build(self, items: list, after: tuple[int, ...]) -> tuple[int, ...]:
        """Entry states of the items, from the last to the first."""
        for x in reversed(items):
            if isinstance(x, str):
                self.steps.append((x, after))
                after = (len(self.steps) - 1,)
            elif isinstance(x, Either):
                after = tuple(dict.fromkeys(s for p in x.parts for s in self._build(p, after)))
            elif isinstance(x, int):
                for _ in range(x):
                    self.steps.append((None, after if not _ else tuple(dict.fromkeys((*after, *entry)))))
                    entry = (len(self.steps) - 1,)
                after = tuple(dict.fromkeys((*after, *entry))) if x else after
            elif x:
                after = tuple(dict.fromkeys((*self._build(x, after), *after)))
        return after

    def match(self, w: list[str], start: int) -> int:
        """The end of the longest accepted run of words from start, -1 without one."""
        now, best, k, steps = set(self.starts), -1, start, self.steps
        while now and k < len(w):
            x, then = w[k], set()
            for s in now:
                if steps[s][0] is None or steps[s][0] == x:
                    then.update(steps[s][1])
            k += 1
            if -1 in then:
                best = k
                then.discard(-1)
            now = then
        return best


class Scanner:
    def __init__(self, phrases=None, templates=None):
        self.phrases = [(tuple(words(p)), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.automata = {k: Automaton(t) for k, t in (TEMPLATES if templates is None else templates).items()}
        firsts = {p[0] for p, _ in self.phrases} | {a for x in self.automata.values() for a in x.anchors}
        self.by_first = {f: ([(p, l) for p, l in self.phrases if p[0] == f], [(l, x) for l, x in self.automata.items() if f in x.anchors and None not in x.anchors]) for f in firsts if f}
        #: Templates that may begin with any word.
        self.anywhere = [(l, x) for l, x in self.automata.items() if None in x.anchors]

    def scan(self, text: str) -> dict:
        """n_words, base places (start, label), template spans (start, end, label)."""
        w = words(text)
        held = set(w)
        base, spans = [], []
        if any(all(x in held for x in p) for p, _ in self.phrases):
            for k, x in enumerate(w):
                for p, l in self.by_first.get(x, ((), ()))[0]:
                    if tuple(w[k : k + len(p)]) == p:
                        base.append((k, l))
        t, places = template_words(w)
        held = held if places is None else set(t)
        live = {l for l, x in self.automata.items() if x.mandatory <= held}
        if live:
            for k, x in enumerate(t):
                for l, a in self.by_first.get(x, ((), ()))[1]:
                    if l in live and (end := a.match(t, k)) > 0:
                        spans.append((k, end, l))
            for l, x in self.anywhere:
                if l in live:
                    spans += ((k, end, l) for k in range(len(t)) if (end := x.match(t, k)) > 0)
            if places is not None:
                spans = [(places[a], places[b - 1] + 1, l) for a, b, l in spans]
            spans.sort()
        return {"n_words": len(w), "base": base, "spans": spans}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (start, end, label), word places of accepted templates; templates pass over punctuation of
    any script, base phrases only over ASCII. first_word and last_word are
    the smallest and largest start of a base phrase, null without one. labels: base and template labels,
    distinct, sorted, comma-joined, empty without one. score: 1 with an accepted template, 0.5 with a
    phrase alone, else 0. A null text is empty. Repeated rows stay repeated; other columns are ignored.
    """
    held: list[Scanner] = []
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:int,end:int,label:string>>"

    def one(batch):
        if not held:
            held.append(Scanner())
        rows = []
        for x in batch.column("text"):
            r = held[0].scan(x.as_py() or "")
            at = [k for k, _ in r["base"]]
            names = {l for _, l in r["base"]}
            rows.append((r["n_words"], len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | {l for *_, l in r["spans"]})), 1.0 if r["spans"] else 0.5 if at else 0.0, [{"start": a, "end": b, "label": l} for a, b, l in r["spans"]]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))]
        cols = list(zip(*rows)) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), one, schema)
