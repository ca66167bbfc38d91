"""License scans: winnowed template fingerprints pick candidates, banded alignment decides.

Templates are short notices by which texts name their license. Each is cut into word 3-grams;
of every two neighbouring ones the smaller hash is kept (winnowing), in an inverted index from
hash to template and place. A document's 3-grams are looked up; a hit at nearly the same
offset between document and template makes a candidate. The candidate's part of the document
is aligned with the template inside a band around that offset, which allows for words put in,
left out or changed, and the share of template words matched in order is its coverage.
Words that tell licenses apart (``MARKS``: names, kinds, versions) must be there in any case.

The templates are broadcast: a list of a bounded number of notices (``MOST_WORDS`` in all), not
data. Words: A-Z in lower case, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

Edge cases: a null or empty text matches nothing; a template of fewer than 3 words is one
gram; of overlapping matches the one with more matched words stays (then the higher coverage,
then the smaller name), so a notice counts once; repeated rows are reported as they stand;
a null id is kept; texts of any length are taken whole; other columns are ignored; no rows
give none.
"""

from __future__ import annotations

from bisect import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.words import LETTERED, HashSet, Words, rolling, slices

GRAM, WINNOW, BAND = 3, 2, 6
COVERAGE = 0.75
MOST_WORDS = 100_000

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction"
)
_MIT_RIGHTS = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
    " copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
_MIT_WHOLE = (
    ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN"
    " ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
    " the following conditions are met"
)
_BSD_TWO = (
    ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_ADVERTISING = (
    " All advertising materials mentioning features or use of this software must display the following acknowledgement:"
    " This product includes software developed by"
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

#: Usual wordings of license notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        f"Licensed under the Apache License, Version 2.0 (the \"License\"); {_APACHE}",
        _APACHE,
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        _MIT,
        f"{_MIT}{_MIT_RIGHTS}, subject to the following conditions: The above copyright notice and this permission notice"
        f" shall be included in all copies or substantial portions of the Software.{_AS_IS}{_MIT_WHOLE}",
    ],
    "MIT-0": [f"{_MIT}{_MIT_RIGHTS}.{_AS_IS}", f"{_MIT}{_MIT_RIGHTS}.{_AS_IS}{_MIT_WHOLE}"],
    "BSD": [_BSD, "Licensed under the BSD License"],
    "BSD-2-Clause": [f"{_BSD}{_BSD_TWO}", "Licensed under the BSD 2-Clause License", "BSD 2-Clause License"],
    "BSD-3-Clause": [f"{_BSD}{_BSD_TWO}{_BSD_NAMES}", "Licensed under the BSD 3-Clause License", "BSD 3-Clause License"],
    "BSD-4-Clause": [f"{_BSD}{_BSD_TWO}{_BSD_ADVERTISING}", "Licensed under the BSD 4-Clause License", "BSD 4-Clause License"],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", "Mozilla Public License Version 1.1"],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "Mozilla Public License Version 2.0",
    ],
    "ISC": [
        f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies",
        "Licensed under the ISC License",
    ],
    "0BSD": [f"{_ISC}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "CC0-1.0": ["dedicated to the public domain under CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
}

for _name, _kind, _version, _date in (
    ("GPL-1.0", "", "1", "February 1989"),
    ("GPL-2.0", "", "2", "June 1991"),
    ("GPL-3.0", "", "3", "29 June 2007"),
    ("LGPL-2.0", "Library ", "2", "June 1991"),
    ("LGPL-2.0", "Lesser ", "2", None),
    ("LGPL-2.1", "Lesser ", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser ", "3", "29 June 2007"),
    ("AGPL-3.0", "Affero ", "3", "19 November 2007"),
):
    _title = f"GNU {_kind}General Public License"
    _published = "as published by the Free Software Foundation"
    TEMPLATES.setdefault(_name, []).extend(
        [
            f"This work is licensed under the {_title}, version {_version}",
            f"licensed under the {_title}, version {_version}",
            f"it under the terms of the {_title} {_published}, either version {_version} of the License,"
            " or (at your option) any later version",
            f"under the terms of the {_title} {_published}, version {_version}",
            f"under the terms of the {_title} version {_version} {_published}",
            f"under the terms of version {_version} of the {_title} {_published}",
            f"{_title} version {_version}",
            *([f"{_title} Version {_version}, {_date}"] if _date else []),
        ]
    )
    _family = TEMPLATES.setdefault(_name.split("-")[0], [])  # no version given
    _family += [f"licensed under the {_title}", f"under the terms of the {_title}"]

for _kind, _long in (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
):
    for _version, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        TEMPLATES[f"CC-{_kind}-{_version}"] = [
            f"Licensed under CC {_kind} {_version}",
            f"licensed under a Creative Commons {_long} {_version} {_port} License",
        ]

for _name, _notices in TEMPLATES.items():
    if _name not in ("BSD", "GPL", "LGPL", "AGPL"):
        _notices.append(f"SPDX-License-Identifier: {_name}")

#: Words that tell licenses of nearly equal notices apart: a notice has all those of its template,
#: and none of ``KINDS`` that its template has not.
KINDS = ["lesser", "library", "affero", "nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs"]
MARKS = [
    *KINDS, *"12345", "apache", "mit", "bsd", "isc", "mozilla", "gnu", "gpl", "lgpl", "agpl", "mpl", "cc", "cc0", "unlicense", "0bsd", "creative",
    "advertising", "endorse",
]


class Index:
    """Templates as word hashes, and where each winnowed gram is."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names, self.words, self.marks = [], [], []
        kinds, marks = (Words([" ".join(w).encode()], LETTERED, fold=True).hashes for w in (KINDS, MARKS))
        self.places: dict[int, list[tuple[int, int]]] = {}
        for name, notices in sorted(templates.items()):
            for notice in notices:
                hashes = Words([notice.encode()], LETTERED, fold=True).hashes
                if not len(hashes):
                    continue
                size = min(GRAM, len(hashes))
                grams = rolling(hashes, size)
                kept = {int(min(range(i, min(i + WINNOW, len(grams))), key=lambda k: (grams[k], -k))) for i in range(max(1, len(grams) - WINNOW + 1))}
                for k in kept:
                    self.places.setdefault((int(grams[k])), []).append((len(self.words), k))
                self.names.append(name)
                self.words.append(hashes)
                self.marks.append((np.intersect1d(hashes, marks), np.setdiff1d(kinds, hashes)))
        if sum(map(len, self.words)) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words")
        self.sizes = {min(GRAM, len(w)) for w in self.words}
        self.known = HashSet(np.array(list(self.places), np.uint64)) if self.places else None

    def candidates(self, words: Words):
        """Text, template and offset (word of the text less template word) of what is worth aligning."""
        if self.known is None:
            return
        owner, seen = words.text_of_words(), set()
        bounds = words.bounds.tolist()
        for size in self.sizes:
            grams = rolling(words.hashes, size)
            hits = self.known.find(grams)
            for i in hits[owner[hits] == owner[hits + size - 1]].tolist():
                text = int(owner[i])
                for template, place in self.places[int(grams[i])]:
                    # every offset within the text: notices that follow closely are told apart
                    offset = i - bounds[text] - place
                    if (text, template, offset) not in seen:
                        seen.add((text, template, offset))
                        yield text, template, offset


def align(template: np.ndarray, part: np.ndarray, first: int, band: int) -> tuple[int, int, int]:
    """Template words matched in order within ``band`` of the diagonal that starts at word
    ``first`` of ``part`` (it may be negative), and the first and last word matched; of equally
    good and short ones those that start nearest to the diagonal."""
    none = (0, 1 << 60, -1)

    def good(x):
        return x[0], x[1] - x[2], -abs(x[1] - first)

    row: dict[int, tuple[int, int, int]] = {}
    for t in range(len(template)):
        new: dict[int, tuple[int, int, int]] = {}
        left = none
        for d in range(first + t - band, first + t + band + 1):
            if not 0 <= d < len(part):
                continue
            best = max(row.get(d, none), left, key=good)
            if part[d] == template[t]:
                n, s, _ = row.get(d - 1, none)
                best = max(best, (n + 1, min(s, d), d), key=good)
            new[d] = left = best
        row = new
    return max(row.values(), key=good, default=none)


def matches(index: Index, words: Words, least: float) -> dict[int, list[tuple[str, float, int, int]]]:
    """By text: license, coverage, first word and word after the last, without overlaps."""
    found: dict[int, list] = {}
    for text, template, offset in index.candidates(words):
        own, first = index.words[template], int(words.bounds[text])
        offset += first
        low = max(first, offset - BAND)
        part = words.hashes[low : min(int(words.bounds[text + 1]), offset + len(own) + BAND)]
        if np.isin(own, part).sum() < least * len(own):  # more words than those cannot match
            continue
        n, s, e = align(own, part, offset - low, BAND)
        needed, barred = index.marks[template]
        span = part[s : e + 1]
        if n / len(own) >= least and np.isin(needed, span).all() and not np.isin(barred, span).any():
            found.setdefault(text, []).append((n, n / len(own), index.names[template], low + s, low + e + 1))
    out = {}
    for text, some in found.items():
        kept: list = []
        for n, coverage, name, s, e in sorted(set(some), key=lambda m: (-m[0], -m[1], m[2], m[3])):
            at = bisect(kept, s, key=lambda k: k[2])  # in order and without overlaps: two neighbours decide
            if (not at or kept[at - 1][3] <= s) and (at == len(kept) or e <= kept[at][2]):
                kept.insert(at, (name, coverage, s, e))
        out[text] = kept
    return out


def licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document row: its id and ``found``: license, coverage of the notice, start and end
    (code points, the end exclusive) of each notice, in the order of the text."""
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    item = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                words = Words(texts, LETTERED, fold=True)
                found: list[list[dict]] = [[] for _ in texts]
                for k, some in matches(index.value, words, coverage).items():
                    origin = words.text_starts[k]
                    for name, share, s, e in some:
                        start = len(texts[k][: words.starts[s] - origin].decode())
                        end = start + len(texts[k][words.starts[s] - origin : words.ends[e - 1] - origin].decode())
                        found[k].append({"license": name, "coverage": share, "start": start, "end": end})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(found, pa.list_(item))], ["id", "found"]
                )

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, found array<struct<license: string, coverage: double, start: long, end: long>>"
    return given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
