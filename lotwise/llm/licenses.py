"""License scans by conditional compression against templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

# Short notices as their owners publish them, with the words that tell each from its siblings.
TEMPLATES: dict[str, tuple[str, str]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "apache license version 2 0"),
    "MIT": ("Released under the MIT License.", "mit license"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "gnu general public license version 3"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "gnu general public license version 2"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public license version 3"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public license version 3"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license v 2 0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "bsd 3 clause license"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "bsd 2 clause license"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "cc by 4 0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "cc by sa 4 0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "cc by nc 4 0"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "cc by nd 4 0"),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.", "cc0 1 0"),
    "all-rights-reserved": ("All rights reserved.", "all rights reserved"),
}
# Standard file headers and full texts, with the words that tell each. Texts of many pages are known by their opening passage.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution. """
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. """
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_TEXT = "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
_MPL_TEXT = """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered
Software."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation,
either version {n} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."""
_GNU_SHORT = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation,
either version {n} of the License, or (at your option) any later version."""
_GNU_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License version {n} as published by the Free Software
Foundation."""
_GNU_TEXT = """GNU {kind} PUBLIC LICENSE Version {n}, {date} Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this
license document, but changing it is not allowed."""
_CC = "This work is licensed under a Creative Commons {kind} 4.0 International License."
_CC_TEXT = """Creative Commons {kind} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions
of this Creative Commons {kind} 4.0 International Public License ("Public License")."""
_CC0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
_CC0_TEXT = """Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES
NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."""
_BSD_TELLING = ("redistribution and use in source and binary forms", "any express or implied warranties including but not limited to")
LONG_TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", _MIT, ("free of charge to any person obtaining a copy", "including without limitation the rights to use copy modify", "in no event shall the authors or copyright holders")),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, _BSD_TELLING),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, _BSD_TELLING),
    ("ISC", _ISC, ("for any purpose with or without fee", "the author disclaims all warranties with regard to")),
    ("Apache-2.0", _APACHE, ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software")),
    ("Apache-2.0", _APACHE_TEXT, ("apache license version 2 0 january 2004",)),
    ("MPL-2.0", _MPL, ("mozilla public license v 2 0",)),
    ("MPL-2.0", _MPL_TEXT, ("mozilla public license version 2 0 1 definitions",)),
]
for _name, _kind, _n, _date, _year in (
    ("GPL-3.0", "General", "3", "29 June 2007", "2007"), ("GPL-2.0", "General", "2", "June 1991", "1989, 1991"),
    ("LGPL-3.0", "Lesser General", "3", "29 June 2007", "2007"), ("AGPL-3.0", "Affero General", "3", "19 November 2007", "2007"),
):
    _own = f"gnu {_kind.lower()} public license"
    for _text in (_GNU, _GNU_SHORT):
        LONG_TEMPLATES.append((_name, _text.format(kind=_kind, n=_n), (f"{_own} as published by the free software foundation either version {_n}",)))
    LONG_TEMPLATES.append((_name, _GNU_ONLY.format(kind=_kind, n=_n), (f"{_own} version {_n}",)))
    LONG_TEMPLATES.append((_name, _GNU_TEXT.format(kind=_kind, n=_n, date=_date, year=_year), (f"{_own} version {_n} {_date.lower()}",)))
for _name, _kind in (("CC-BY-4.0", ""), ("CC-BY-SA-4.0", "-ShareAlike"), ("CC-BY-NC-4.0", "-NonCommercial"), ("CC-BY-ND-4.0", "-NoDerivatives")):
    _own = f"creative commons attribution{_kind.lower().replace('-', ' ')} 4 0 international"
    LONG_TEMPLATES.append((_name, _CC.format(kind="Attribution" + _kind), (f"{_own} license",)))
    LONG_TEMPLATES.append((_name, _CC_TEXT.format(kind="Attribution" + _kind), (f"{_own} public license by exercising",)))
LONG_TEMPLATES += [("CC0-1.0", _CC0, ("waived all copyright and related or neighboring rights",)), ("CC0-1.0", _CC0_TEXT, ("cc0 1 0 universal",))]

# What licensing is spoken of with; words of it are looked up first.
CUE = r"(?i)licen[cs]e|copyright|rights\W+reserved|public\W+domain|creative\W+commons|\bCC\W*(?:BY|0)|free\W+of\W+charge|redistribution"
LEAST_REDUCTION = 0.05  # share by which a template has to shorten the compressed words around its telling words
LEAST_WORDING = 0.8  # share of a template's words that a notice has in order
LEAST_DENSITY = 0.5  # share of a notice's words that are the template's
# Words that say which license it is: those among a template's telling words may not be missing, and one that
# tells a kind of the same license may not be added.
NAMES = frozenset("apache mit gnu general lesser affero mozilla bsd cc by sa nc nd cc0 attribution sharealike noncommercial noderivatives".split())
KINDS = frozenset("lesser affero sa nc nd sharealike noncommercial noderivatives".split())
_COMMON = frozenset(
    """a above after all also an and any are as at be been but by can conditions do each following for from has have if in included including into is it its
    later limited may more must new no not number of on one only or other out part see so such terms than that the their then there these they this those to
    under use used version was we were when which who will with without work you your""".split()
)

# A word, or the comment word that begins a line of some languages.
_word = re.compile(r"(?m)^[ \t]*(?:dnl|REM|rem)\b|([A-Za-z0-9]+)")
_plain = re.compile(r"[A-Za-z0-9]+")


@lru_cache(maxsize=1)
def forms() -> list[tuple[str, list[str], int, int, str]]:
    """License, words, place and number of the telling words, and these; one for each telling."""
    out = []
    for name, text, tellings in [*((n, text, (telling,)) for n, (text, telling) in TEMPLATES.items()), *LONG_TEMPLATES]:
        want = normal(text).split()
        for telling in tellings:
            told = telling.split()
            at = next(i for i in range(len(want)) if want[i : i + len(told)] == told)
            out.append((name, want, at, len(told), f" {telling} "))
    return out


@lru_cache(maxsize=1)
def templates() -> dict[int, tuple[frozenset[int], frozenset[int], Counter]]:
    """One form for each template: places of all its telling words, those of its names, and its words counted."""
    first: dict[tuple, int] = {}
    told: dict[int, set[int]] = {}
    for form, (name, want, at, length, _) in enumerate(forms()):
        told.setdefault(first.setdefault((name, *want), form), set()).update(range(at, at + length))
    out = {}
    for form, places in told.items():
        want = forms()[form][1]
        named = frozenset(i for i in places if want[i] in NAMES or (want[i].isdigit() and len(want[i]) == 1))
        out[form] = frozenset(places), named, Counter(want)
    return out


def spare(form: int) -> int:
    """Number of words of the form that a notice may lack."""
    size = len(forms()[form][1])
    return int(size - LEAST_WORDING * size + 1e-9)


@lru_cache(maxsize=1)
def anchors() -> dict[str, list[tuple[int, int]]]:
    """Forms and places by word: of each form one more place than a notice may lack, so that every notice
    holds one of them; the rarest and most telling words are taken."""
    often = Counter(w for form in templates() for w in forms()[form][1])
    out: dict[str, list[tuple[int, int]]] = {}
    for form in templates():
        want = forms()[form][1]
        order = sorted(range(len(want)), key=lambda i: (want[i] in _COMMON or want[i].isdigit(), not re.search(CUE, want[i]) and want[i] not in NAMES, often[want[i]], -len(want[i]), i))
        for place in sorted(order[: spare(form) + 1]):
            out.setdefault(want[place], []).append((form, place))
    return out


@lru_cache(maxsize=1)
def compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    """One compressor without a dictionary, and one for each form as raw dictionary."""
    settings = {"level": 3, "write_content_size": False}
    given = [
        zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(want).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **settings)
        for _, want, *_ in forms()
    ]
    return zstandard.ZstdCompressor(**settings), given


def normal(text: str) -> str:
    return " ".join(w.lower() for w in _word.findall(text) if w)


def saved(words: list[str], form: int) -> tuple[int, float]:
    """Bytes and share by which knowing the form shortens the compressed words."""
    plain, given = compressors()
    data = " ".join(words).encode()
    alone, known = len(plain.compress(data)), len(given[form].compress(data))
    return alone - known, 1 - known / alone


def reduction(words: list[str], form: int) -> float:
    """Share by which knowing the form shortens the compressed words."""
    return saved(words, form)[1]


def around(own: list[str], at: int, form: int, place: int | None = None) -> list[str]:
    """Words around the word at ``at`` that stands at ``place`` of the form, or around all of its telling words:
    twice as many as the form has on either side, where all of it may stand with words added."""
    _, want, begin, told, _ = forms()[form]
    if place is not None:
        begin, told = place, 1
    return own[max(0, at - 2 * begin) : at + told + 2 * (len(want) - begin - told)]


@lru_cache(maxsize=None)
def _places(form: int, begin: int, end: int, step: int) -> dict[str, int]:
    """Bits of the places at which a stretch of the form holds each word."""
    bits: dict[str, int] = {}
    for i, w in enumerate(forms()[form][1][begin:end][::step]):
        bits[w] = bits.get(w, 0) | 1 << i
    return bits


def common(bits: dict[str, int], own: list[str], size: int) -> int:
    """Most words of a stretch of ``size`` words that ``own`` has in order; bit-parallel."""
    every = (1 << size) - 1
    row = every
    for w in own:
        if w in bits:
            met = row & bits[w]
            row = ((row + met) | (row - met)) & every
    return size - row.bit_count()


def most_held(own: list[str], at: int, form: int, place: int) -> int:
    """Bound on the words a notice holds that has the form's word of ``place`` at ``at``."""
    size = len(forms()[form][1])
    before, after = own[max(0, at - place - size) : at], own[at + 1 : at + 2 * size]
    return 1 + common(_places(form, 0, place, -1), before[::-1], place) + common(_places(form, place + 1, size, 1), after, size - place - 1)


def outward(want: list[str], own: list[str]) -> list[tuple[int, int, list[int], list[int]]]:
    """Alignments of all of ``want`` with a beginning of ``own``: number missing, number added, places
    of ``want`` missing and of ``own`` held. One for each number missing, the one that adds least."""
    same = 0
    while same < min(len(want), len(own)) and want[same] == own[same]:
        same += 1
    a, b = want[same:], own[same:]
    if not a:
        return [(0, 0, [], list(range(same)))]
    # Words missing and added up to each place of both.
    rows = [list(range(len(b) + 1))]
    for i, w in enumerate(a):
        last, row = rows[-1], [i + 1]
        for j, x in enumerate(b):
            row.append(last[j] if w == x else min(last[j + 1], row[j]) + 1)
        rows.append(row)
    least: dict[int, tuple[int, int]] = {}
    for j, cost in enumerate(rows[-1]):
        missing = (cost + len(a) - j) // 2
        if missing not in least or cost - missing < least[missing][0]:
            least[missing] = cost - missing, j
    out = []
    for missing, (added, j) in least.items():
        i, gone, held = len(a), [], []
        while i:
            if j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                held.append(same + j)
            elif j and rows[i][j] == rows[i][j - 1] + 1:
                j -= 1
            else:
                i -= 1
                gone.append(same + i)
        out.append((missing, added, gone, [*range(same), *held]))
    return out


def wording(own: list[str], at: int, form: int, place: int) -> tuple[int, list[int], list[int], list[int]] | None:
    """The nearest wording that has the form's word of ``place`` at ``at``: how many words differ, places
    missing, places held and where. None if too many are missing or added, or a name is missing."""
    want = forms()[form][1]
    _, named, _ = templates()[form]
    # At most as many words are added as the template has, so no wording is longer than this.
    before = outward(want[:place][::-1], own[max(0, at - place - len(want)) : at][::-1])
    after = outward(want[place + 1 :], own[at + 1 : at + 2 * len(want)])
    best = None
    for m1, a1, gone1, held1 in before:
        for m2, a2, gone2, held2 in after:
            held = len(want) - m1 - m2
            if held >= LEAST_WORDING * len(want) - 1e-9 and held >= LEAST_DENSITY * (held + a1 + a2) - 1e-9 and (best is None or m1 + m2 + a1 + a2 < best[0]):
                missing = sorted([*(place - 1 - i for i in gone1), *(place + 1 + i for i in gone2)])
                if named.isdisjoint(missing):
                    best = m1 + m2 + a1 + a2, missing, sorted([*(at - 1 - i for i in held1), at, *(at + 1 + i for i in held2)])
    if best is None:
        return None
    gone = set(best[1])
    return best[0], best[1], [i for i in range(len(want)) if i not in gone], best[2]


def _possible(text: str) -> list[int]:
    """Forms of which the text has enough words somewhere, and the names."""
    words = {w.lower() for w in set(_plain.findall(text))}
    if words.isdisjoint(anchors()):
        return []
    out = []
    for form, (_, named, counted) in templates().items():
        want = forms()[form][1]
        if all(want[i] in words for i in named) and sum(n for w, n in counted.items() if w not in words) <= spare(form):
            out.append(form)
    return out


def _worded(own: list[str], some: set[int]) -> Iterator[tuple]:
    """Wordings of the forms: form, number of differences, words missing, places held and of those the telling ones."""
    latest: dict[int, list[tuple]] = {}
    for at, word in enumerate(own):
        for form, place in anchors().get(word, ()):
            if form not in some:
                continue
            want, mine = forms()[form][1], latest.setdefault(form, [])
            while mine and mine[0][3][-1] < at - 2 * len(want):
                yield mine.pop(0)[:5]
            if any(w[5].get(at) == place for w in mine):
                continue  # held by a wording that is there already
            window = around(own, at, form, place)
            if not all(want[i] in window for i in templates()[form][1]) or reduction(window, form) < LEAST_REDUCTION:
                continue
            missing = len(want) - most_held(own, at, form, place)
            if missing > spare(form) or any(w[3][0] <= at <= w[3][-1] and len(w[2]) <= missing for w in mine):
                continue  # another place of a wording that is there already, which can't hold more of it
            nearest = wording(own, at, form, place)
            if nearest is None:
                continue
            differ, gone, kept, places = nearest
            among = set(places)
            if not KINDS.isdisjoint(own[i] for i in range(places[0], places[-1]) if i not in among and own[i] not in want):
                continue
            over = [w for w in mine if not among.isdisjoint(w[3])]
            if all(differ < w[1] for w in over):
                told = [p for i, p in zip(kept, places) if i in templates()[form][0]]
                new = form, differ, [want[i] for i in gone], places, told, dict(zip(places, kept))
                latest[form] = sorted([*(w for w in mine if w not in over), new], key=lambda w: w[3][-1])
    for mine in latest.values():
        yield from (w[:5] for w in mine)


def notices(text: str) -> list[tuple]:
    """Notices of a text in order: start, end, license, reduction, exact, missing and added words.

    Words run on over line ends; comment marks are none. Of each form one word more than a notice may lack is looked
    up, so that some word of every notice is met, whichever of its words are altered. The window around it is compressed with the form as
    dictionary: only one that it shortens enough can hold the notice, which the wording confirms. Of forms
    that share telling words, the one that saves most bytes of its notice is the notice; of those that save as many, the
    one with most words in common and fewest differences.
    """
    some = set(_possible(text))
    if not some:
        return []
    spans = [m.span() for m in _word.finditer(text) if m[1]]
    own = [text[a:b].lower() for a, b in spans]
    found = []
    for form, differ, missing, held, told in _worded(own, some):
        fewer, share = saved(own[held[0] : held[-1] + 1], form)
        found.append((-fewer, differ - len(held), -share, forms()[form][0], held, told, missing))
    out, used = [], set()
    for _, _, shorter, name, held, told, missing in sorted(found):
        if used.isdisjoint(told or held):
            used.update(held)
            among = set(held)
            added = [own[i] for i in range(held[0], held[-1]) if i not in among]
            end = spans[held[-1]][1]
            end += text[end : end + 1] in (".", "!", "?")
            out.append((spans[held[0]][0], end, name, round(-shorter, 4), not missing and not added, missing, added))
    return sorted(out)


def _scan(carry: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for number, own in enumerate(notices(text or "")):
                    rows.append(i)
                    found.append((number, *own))
            picked = batch.take(pa.array(rows, pa.int64()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
            names = ["block", "start", "end", "license", "reduction", "exact", "missing", "added"]
            yield pa.RecordBatch.from_arrays([*(picked.column(c) for c in carry), *(pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds))], [*carry, *names])

    return run


def scan_licenses(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """License notices in every text, one row for each.

    The words around each occurrence of a template's rarest words, whatever the line it stands in, are
    compressed with the template as raw dictionary: it has to shorten them, and ranks the templates. The
    wording confirms a notice: 0.8 of the template's words in order, with no more words added. Any of them may be altered but
    those that name the license (``NAMES`` and version numbers among the telling words).
    Returns the columns of ``carry``, then block (number among the text's notices), start and end
    (characters), license, reduction, exact (no difference), missing and added words. Null and empty texts and those
    without a notice give no row; repeated rows give repeated rows; other columns are not read.
    """
    types = dict(docs.dtypes)
    result = ", ".join([*(f"`{c}` {types[c]}" for c in carry), "block int, start long, end long, license string, reduction double, exact boolean, missing array<string>, added array<string>"])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(_scan(list(carry)), result)
