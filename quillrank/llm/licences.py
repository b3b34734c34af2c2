"""Licence recognition by sentence rules.

A text is cut into sentences; each is normalised (case, marks, symbol noise and
white space go) and looked up among known licence sentences, whose open parts
(years, holders) match any words.  The sequence of identifiers found in a text
is then matched against ordered rules: an earlier rule consumes its sentences,
so a full licence wins over a notice that shares a sentence with it.  Known
sentences that no rule consumes are reported as ``unmatched``.  The identifier
of an SPDX line carries its expression (``spdx:GPL-3.0-only``).

Defined cases: null, empty and blank texts have no licences; a licence that
occurs twice is listed twice; repeated rows are scanned each; an empty table
gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import documents, map_slices

# Sentences of public licences, by identifier, as they read after normalisation ("*": any words).
SENTENCES = {
    "mit-released": ["released under the mit license", "licensed under the mit license", "distributed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as-is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache2-licensed": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at *"],
    "apache2-as-is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl3-work": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this work is licensed under the gnu general public license version 3 0"],
    "gpl2-work": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-redistribute-3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-redistribute-2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "lgpl-redistribute": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "gpl-hope": ["this * is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-see": ["see the gnu general public license for more details", "see the gnu lesser general public license for more details"],
    "gpl-received": ["you should have received a copy of the gnu general public license along with this program"],
    "ccbync4": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccby4": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa4": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0": ["this work is dedicated to the public domain under cc0 1 0", "licensed under cc0 1 0"],
    "bsd-grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-endorse": ["neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-as-is": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "mpl2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "spdx": ["spdx license identifier *"],
}

#: Licence, the sentences of its rule in order ("?" marks those that may be missing).  Earlier rules win.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is?"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is?"]),
    ("MIT", ["mit-released?", "mit-grant", "mit-notice", "as-is?", "mit-liability?"]),
    ("Apache-2.0", ["apache2-licensed", "apache2-comply", "apache2-copy", "apache2-as-is?", "apache2-see?"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3", "gpl-hope?", "gpl-see?", "gpl-received?"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2", "gpl-hope?", "gpl-see?", "gpl-received?"]),
    ("LGPL-2.1-or-later", ["lgpl-redistribute", "gpl-hope?", "gpl-see?"]),
    ("ISC", ["isc-grant", "as-is?"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-2.0-only", ["gpl2-work"]),
    ("Apache-2.0", ["apache2-licensed"]),
    ("MIT", ["mit-released"]),
    ("CC-BY-NC-4.0", ["ccbync4"]),
    ("CC-BY-SA-4.0", ["ccbysa4"]),
    ("CC-BY-4.0", ["ccby4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl2"]),
    ("Unlicense", ["unlicense"]),
    ("SPDX", ["spdx"]),
]

_NOISE = re.compile(r"[#*$%&|<>!\"“”«»(){}\[\]]+|//")
#: A run of marks is tried once, where it begins.  A colon alone after "identifier" ends nothing.
_CUT = re.compile(r"(?<![.;?:])(?!(?<=[Ii]dentifier):(?![.;?:]))[.;?:]++(?=\s|$)|\n\s*\n")
_WORD = re.compile(r"[^\W_]+")
_ID = r"\(*[ \t]*(?:DocumentRef-[A-Za-z0-9.-]+:)?[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?(?:[ \t]*\))*"
#: An SPDX tag wherever it stands in a line, with its expression, which ends the sentence.
_SPDX = re.compile(rf"SPDX[\W_]License[\W_]Identifier[^\w\n(]*(?:\n[^\w\n(]*)?((?-i:{_ID}(?:(?:[ \t]+(?:AND|OR|WITH)[ \t]+|/){_ID})*))", re.I)
_EXACT = {s: k for k, own in SENTENCES.items() for s in own if "*" not in s}
_OPEN_PART = r"[^\W_]+(?: [^\W_]+)*"
_OPEN = [(re.compile(re.escape(s).replace(r"\*", _OPEN_PART)), k) for k, own in SENTENCES.items() for s in own if "*" in s]
#: The same over several pieces, which " | " divides.  An open part spans pieces only within four words of known text and more.
_ACROSS = [(re.compile(re.escape(s).replace(r"\ ", r"(?: \|)? ").replace(
    r"\*", r"[^\W_]+(?:(?: \|)? [^\W_]+)*" if len(s.split("*")[0].split()) >= 4 and not s.endswith("*") else _OPEN_PART)), s.endswith("*"))
    for own in SENTENCES.values() for s in own if "*" in s]
#: Sentences that end in an open part; it ends with the line.
_ENDS_OPEN = {k for k, own in SENTENCES.items() for s in own if s.endswith("*")}
#: Longer than any known sentence.
_LONGEST = 1200
#: The first three words of each known sentence, or those before an open part.
_STARTS = {tuple(s.split("*")[0].split()[:3]) for own in SENTENCES.values() for s in own}
_LAST_OPEN = {s.split()[0] for own in SENTENCES.values() for s in own if "*" in s}
#: Every known sentence has one of these words, so a text without them has no licence.
ANCHORS = r"(?i)licen[sc]e|permission|permitted|copyright|warranty|redistribut|unencumbered|cc0"


def sentences(text: str) -> list[tuple[int, int, str]]:
    """start, end and normal form of each sentence with a word.  A single line break inside a sentence is white space;
    a line that ends a sentence without a mark ends it where the next line starts one that is known by itself.
    A known sentence may have marks inside ("free software: you can", "v. 2.0"): its pieces are joined."""
    out = []
    at = 0
    tags = [m.span() for m in _SPDX.finditer(text)] if "spdx" in text.lower() else []
    cuts = {m.end() for m in _CUT.finditer(text)} - {x for a, b in tags for x in range(a + 1, b)}
    for stop in sorted(cuts.union(*tags, [len(text)])):
        out += _lines(text, at, stop)
        at = stop
    return _joined(out)


def _joined(pieces: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Pieces with runs of unknown ones that together are a known sentence joined, the longest run first."""
    out, i = [], 0
    while i < len(pieces):
        start, end, form = pieces[i]
        last = i
        if _may_start(form) and not identify(form):
            whole, marked = form, form
            is_open = form.split(" ", 1)[0] in _LAST_OPEN
            for j in range(i + 1, len(pieces)):
                piece = pieces[j][2]
                whole, marked = f"{whole} {piece}", f"{marked} | {piece}"
                if len(whole) > _LONGEST or identify(piece):
                    break
                hit = next((ends_open for p, ends_open in _ACROSS if p.fullmatch(marked)), None) if is_open else None
                if hit is not None or whole in _EXACT:
                    last, end, form = j, pieces[j][1], whole
                if hit or not is_open and not any(s.startswith(whole) for s in _EXACT):
                    break
        out.append((start, end, form))
        i = last + 1
    return out


def _normal(raw: str) -> str:
    return " ".join(_WORD.findall(_NOISE.sub(" ", raw).lower()))


def identify(sentence: str) -> str | None:
    known = _EXACT.get(sentence)
    if known is None and sentence.split(" ", 1)[0] in _LAST_OPEN:
        known = next((k for p, k in _OPEN if p.fullmatch(sentence)), None)
    return known


def _may_start(form: str) -> bool:
    """Whether a line can be the beginning of a known sentence."""
    words = tuple(form.split(" ", 3)[:3])
    return any(words[:len(s)] == s[:len(words)] for s in _STARTS) if len(words) < 3 else any(words[:k] in _STARTS for k in (1, 2, 3))


def _lines(text: str, at: int, stop: int) -> list[tuple[int, int, str]]:
    """The run of text as one sentence if it is known, else its lines joined greedily to known sentences, else line by line."""
    whole = _normal(text[at:stop])
    if not whole:
        return []
    known = identify(whole)
    if known and known not in _ENDS_OPEN or "\n" not in text[at:stop].strip("\n"):
        return [(at, stop, whole)]
    ends = [at + m.end() for m in re.finditer("\n", text[at:stop])] + [stop]
    starts = [at, *ends[:-1]]
    forms = [_normal(text[a:b]) for a, b in zip(starts, ends)]
    out, i = [], 0
    while i < len(forms):
        joined, found = forms[i], None
        if joined and _may_start(joined):
            for j in range(i, len(forms)):
                joined = forms[i] if j == i else f"{joined} {forms[j]}"
                if len(joined) > _LONGEST:
                    break
                if known := identify(joined):
                    found = j, joined
                    if known in _ENDS_OPEN:
                        break
        if found:
            out.append((starts[i], ends[found[0]], found[1]))
            i = found[0] + 1
        else:
            if forms[i]:
                out.append((starts[i], ends[i], forms[i]))
            i += 1
    return out


def recognise(text: str | None) -> list[tuple[str, int, int, str]]:
    """identifier, start, end and sentence of the known sentences of a text, in order."""
    return [(f"{k}:{_expression(m[1])}" if k == "spdx" and (m := _SPDX.search(text, a, b)) else k, a, b, s)
            for a, b, s in sentences(text or "") if (k := identify(s))]


def _expression(raw: str) -> str:
    """An SPDX expression with single spaces and without the brackets that nothing opens or closes."""
    out = " ".join(raw.split())
    while out.count("(") > out.count(")") and out.startswith("("):
        out = out[1:].lstrip()
    while out.count(")") > out.count("(") and out.endswith(")"):
        out = out[:-1].rstrip()
    return out


def match(found: list[str]) -> list[tuple[str, list[int]]]:
    """Licences and the positions of their sentences, in the order of their first one; the rest is "unmatched"."""
    found = [f.split(":", 1)[0] for f in found]
    free = [True] * len(found)
    out = []
    for licence, rule in RULES:
        at = 0
        while at < len(found):
            taken, place = [], at
            for step in rule:
                name, may = step.rstrip("?"), step.endswith("?")
                hit = next((i for i in range(place, len(found)) if free[i] and found[i] == name), None) if taken or not may \
                    else (place if free[place] and found[place] == name else None)
                if hit is None and not may:
                    taken = []
                    break
                if hit is not None:
                    taken.append(hit)
                    place = hit + 1
                    if place >= len(found) and any(not s.endswith("?") for s in rule[rule.index(step) + 1:]):
                        taken = []
                        break
            if not taken:
                break
            for i in taken:
                free[i] = False
            out.append((licence, taken))
            at = taken[0] + 1
    out += [("unmatched", [i]) for i, f in enumerate(free) if f]
    return sorted(out, key=lambda x: x[1])


_OUT = "doc_id bigint, licences array<string>, sentence_ids array<string>, spans array<struct<start:bigint,end:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (in text order), identifiers of the known sentences and their code-point spans, for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [recognise(t) for t in batch.column("text").to_pylist()]
        ids = [[r[0] for r in own] for own in rows]
        spans = [[{"start": r[1], "end": r[2]} for r in own] for own in rows]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array([[m[0] for m in match(own)] for own in ids], pa.list_(pa.string())),
            pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "licences", "sentence_ids", "spans"])

    may = F.coalesce(F.col("text").rlike(ANCHORS), F.lit(False))
    none = [F.array().cast(t) for t in ("array<string>", "array<string>", "array<struct<start:bigint,end:bigint>>")]
    without = docs.where(~may).select("doc_id", *(c.alias(n) for c, n in zip(none, ("licences", "sentence_ids", "spans"))))
    return map_slices(docs.where(may).select("doc_id", "text"), run, _OUT).unionAll(without)


def op10(spark, sf_dir):
    return scan(documents(spark, sf_dir))
