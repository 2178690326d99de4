"""Licence scan: known licence sentences become identifiers, ordered rules read sequences of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexivec.plans.batches import small_batches

# Licence sentences by identifier.  Compared as lower-case words, marks left out.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-notice-the": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2",
    "gpl-redistribute-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-redistribute-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "This work is licensed under CC0 1.0",
    "lgpl2.1-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-no-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "artistic2-notice": "Licensed under the Artistic License 2.0",
    "bsd-released": "Released under the BSD 3-Clause License",
    "apache-released": "Released under the Apache License 2.0",
}
# Ordered rules; the first that fits at a place wins.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice-the", "apache-comply", "apache-obtain", "apache-as-is")),
    ("Apache-2.0", ("apache-notice-the", "apache-comply")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-redistribute-3", "gpl-no-warranty")),
    ("GPL-3.0-or-later", ("gpl-redistribute-3",)),
    ("GPL-2.0-or-later", ("gpl-redistribute-2", "gpl-no-warranty")),
    ("GPL-2.0-or-later", ("gpl-redistribute-2",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-4.0", ("cc-by-4-long",)),
    ("CC0-1.0", ("cc0",)),
    ("LGPL-2.1-or-later", ("lgpl2.1-redistribute", "lgpl-no-warranty")),
    ("LGPL-2.1-or-later", ("lgpl2.1-redistribute",)),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute", "gpl-no-warranty")),
    ("LGPL-3.0-or-later", ("lgpl3-redistribute",)),
    ("AGPL-3.0-or-later", ("agpl3-redistribute", "gpl-no-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-redistribute",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("Unlicense", ("unlicense-domain", "unlicense-anyone")),
    ("Unlicense", ("unlicense-domain",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Artistic-2.0", ("artistic2-notice",)),
    ("BSD-3-Clause", ("bsd-released",)),
    ("Apache-2.0", ("apache-released",)),
)
#: Code points, at most, between neighbouring sentences of one statement: clause numbers, blank lines, a name.
MAX_GAP = 200
# Every sentence has one of these, so a text without any has no sentence.
ANCHORS = ("licens", "permission", "redistribut", "warrant", "liable", "free software", "copyright", "unencumbered", "as-is", "anyone is free")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?;:](?=\s|$)|\n")


def sentence_words(sentence: str) -> tuple[str, ...]:
    """The words of a sentence as they are compared."""
    return tuple(_WORD.findall(sentence.lower()))


_KNOWN: dict[tuple[str, str], list[tuple[tuple[str, ...], str]]] = {}
for _name, _sentence in SENTENCES.items():
    _KNOWN.setdefault(sentence_words(_sentence)[:2], []).append((sentence_words(_sentence), _name))
for _found in _KNOWN.values():
    _found.sort(key=lambda x: -len(x[0]))
_START = re.compile("(?<![^\\W_])(" + "|".join(f"{a}[\\W_]+{b}" for a, b in sorted(_KNOWN)) + ")(?![^\\W_])")


def _words_from(low: str, at: int, n: int) -> list[re.Match[str]]:
    """Up to ``n`` words from a place on."""
    out = []
    for m in _WORD.finditer(low, at):
        out.append(m)
        if len(out) == n:
            break
    return out


def _parted(low: str, begin: int, end: int) -> bool:
    """Whether a sentence ends between two words, or before the first or after the last one."""
    return begin == 0 or end == len(low) or _END.search(low[begin : end + 1], 0, end - begin) is not None


def _gap(low: str, at: int, step: int) -> int:
    """The end of the run of marks and blanks that leads from a place backwards or on."""
    while 0 <= at < len(low) and not low[at].isalnum():
        at += step
    return at


def sentences(text: str) -> list[tuple[str, int, int]]:
    """``(identifier, begin, end)`` of the known sentences of a text, in order.

    A sentence starts after a mark that ends one, after a line end or at the start, and ends likewise;
    line ends within are blanks, so that wrapped sentences are found.  Of several the longest counts.
    Only places with the first two words of a known sentence are looked at, so a very long text needs
    no more memory than its lower-case copy.
    """
    low = text.lower()
    if len(low) != len(text):  # a few capitals change their length; then only those that do not are lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not any(a in low for a in ANCHORS):
        return []
    found, at = [], 0
    while m := _START.search(low, at):
        at = m.start() + 1
        if not _parted(low, _gap(low, m.start() - 1, -1) + 1, m.start()):
            continue
        first, second = _words_from(low, m.start(), 2)
        known = _KNOWN[first.group(), second.group()]
        words = _words_from(low, m.start(), len(known[0][0]))
        for sentence, name in known:
            if len(sentence) > len(words) or any(w.group() != s for w, s in zip(words, sentence)):
                continue
            end = words[len(sentence) - 1].end()
            if _parted(low, end, _gap(low, end, 1)):
                found.append((name, m.start(), end))
                at = end
                break
    return found


def licences(text: str | None) -> list[tuple[str, str, int, int]]:
    """``(licence, identifiers, begin, end)`` of the rules that fit, in order, without overlap.

    A rule's sentences follow each other with at most ``MAX_GAP`` code points between two of them.
    """
    found = sentences(text or "")
    near = [b[1] - a[2] <= MAX_GAP for a, b in zip(found, found[1:])]
    out, i = [], 0
    while i < len(found):
        for licence, rule in RULES:
            n = len(rule)
            if tuple(name for name, _, _ in found[i : i + n]) == rule and all(near[i : i + n - 1]):
                out.append((licence, " ".join(rule), found[i][1], found[i + n - 1][2]))
                i += n - 1
                break
        i += 1
    return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence statement: ``doc_id, licence, sentences, begin, end`` (code points of the whole text).

    Null and empty texts and texts without a known sentence have no row.  Rows that repeat give equal
    rows.  Other columns are ignored, whatever their names.
    """
    schema = "doc_id bigint, licence string, sentences string, begin int, end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d.as_py(), *x) for d, t in zip(batch.column("doc_id"), batch.column("text")) for x in licences(t.as_py())]
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(run, schema)
