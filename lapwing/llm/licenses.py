"""License scans by patience alignment.

Words that stand once in a template and once in a stretch of text are anchors; the longest
increasing run of anchors is kept and the gaps between them are aligned again. The share of
template words matched is the coverage. Texts are read in overlapping stretches of twice the
template's length, so every occurrence lies whole in one stretch whatever the text's length;
a stretch is aligned only where it holds enough of the template's words to reach the coverage,
which loses nothing. One pass over the rows, no shuffle.

Defined results for odd input: a null or empty text has no license, a null doc_id is carried,
repeated rows are reported each, of equally good stretches the earliest counts, other columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Public license notices and texts, by name; what follows a colon tells apart the wordings of one license. Fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit": "Released under the MIT License",
    "mit:name": "the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction',
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
    'notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT '
    "WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
    "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met",
    "bsd:name": "the BSD License",
    "gpl-2.0": "GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0:name": "GNU General Public License, version 3",
    "lgpl-3.0": "GNU Lesser General Public License, version 3",
    "agpl-3.0": "GNU Affero General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-2.0:name": "Mozilla Public License, Version 2.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-4.0:name": "CC BY 4.0",
    "cc-by-sa-4.0": "Attribution-ShareAlike 4.0",
    "cc-by-sa-4.0:name": "CC BY-SA 4.0",
    "cc-by-nd-4.0": "Attribution-NoDerivatives 4.0",
    "cc-by-nd-4.0:name": "CC BY-ND 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-4.0:name": "CC BY-NC 4.0",
    "cc-by-nc-4.0:words": "Attribution-NonCommercial 4.0",
    "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0",
    "cc-by-nc-sa-4.0:words": "Attribution-NonCommercial-ShareAlike 4.0",
    "cc-by-nc-nd-4.0": "CC BY-NC-ND 4.0",
    "cc-by-nc-nd-4.0:words": "Attribution-NonCommercial-NoDerivatives 4.0",
    "all-rights-reserved": "All rights reserved",
    # Short names and identifiers.
    "apache-2.0:name": "Apache License, Version 2.0",
    "apache-2.0:short": "Apache License 2.0",
    "apache-2.0:spdx": "SPDX-License-Identifier: Apache-2.0",
    "apache-2.0:choice": "MIT OR Apache-2.0",
    "mit:spdx": "SPDX-License-Identifier: MIT",
    "mit:choice": "MIT OR Apache-2.0",
    "apache-2.0:either": "Apache-2.0 OR MIT",
    "mit:either": "Apache-2.0 OR MIT",
    "isc:name": "the ISC License",
    "isc:spdx": "SPDX-License-Identifier: ISC",
    "bsd:3-clause": "BSD-3-Clause",
    "bsd:2-clause": "BSD-2-Clause",
    "gpl-2.0:short": "GNU General Public License v2",
    "gpl-2.0:letters": "GPLv2",
    "gpl-2.0:spdx": "SPDX-License-Identifier: GPL-2.0",
    "gpl-3.0:short": "GNU General Public License v3",
    "gpl-3.0:letters": "GPLv3",
    "gpl-3.0:spdx": "SPDX-License-Identifier: GPL-3.0",
    "lgpl-3.0:short": "GNU Lesser General Public License v3",
    "lgpl-3.0:letters": "LGPLv3",
    "agpl-3.0:short": "GNU Affero General Public License v3",
    "agpl-3.0:letters": "AGPLv3",
    "mpl-2.0:spdx": "MPL-2.0",
    # Whole texts.
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
    '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY "
    'THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
    "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
    "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
    "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
    "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
    "removed or altered from any source distribution.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
    'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject "
    "to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction "
    "and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
    "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
    "language processor.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
    "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
    "non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
    "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
    "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present "
    "and future rights to this software under copyright law.",
    "wtfpl-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as "
    "long as the name is changed. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
}
#: Words that decide between licenses: those of a template must all be matched, and none of the others may stand among the words matched, nor one that
#: qualifies a name beside them. Another license's name beside them is another license.
QUALIFYING = frozenset("lesser affero nc sa nd noncommercial sharealike noderivatives noderivs".split())
DECIDING = QUALIFYING | frozenset("apache mit bsd isc mozilla gnu gpl mpl gplv2 gplv3 lgplv3 agplv3".split())
#: Words before a name, in its sentence, that turn it round, and how far before.
NEGATIONS, BEFORE = frozenset("not never nor isn aren wasn neither".split()), 4
#: Words of notices whose number is the version: the number must be matched.
VERSIONED = ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "cc-", "bsd:")
#: A version in words: 3, v3.
_version = re.compile(r"v?\d+")
_stop = re.compile(r"[.!?;\n](?:\s|$)")
HITS = "doc_id long, license string, coverage double, matched int, hits int, first_word long, last_word long, n_words long"

_word = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    return _word.findall(text.lower())


def longest_increasing(values: Sequence[int]) -> list[int]:
    """Indexes of one longest strictly increasing subsequence (patience piles with back links)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [v], [i]
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str], a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Matched positions (in ``a``, in ``b``), increasing in both."""
    if not a or not b:
        return []
    in_a, in_b = Counter(a), Counter(b)
    at_b = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    pairs = [(i, at_b[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in at_b]
    chain = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
    if not chain:
        return []
    out = []
    i0 = j0 = 0
    for n, (i, j) in enumerate([*chain, (len(a), len(b))]):
        gap_b = b[j0:j]
        # Outside the outermost anchors, only as much text as the template has left belongs to the license.
        skip = max(0, len(gap_b) - 2 * (i - i0)) if n == 0 else 0
        gap_b = gap_b[skip:] if n < len(chain) else gap_b[: 2 * (i - i0)]
        out += align(a[i0:i], gap_b, a0 + i0, b0 + j0 + skip)
        if n < len(chain):
            out.append((a0 + i, b0 + j))
        i0, j0 = i + 1, j + 1
    return out


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    counts: Mapping[str, int]

    def enough(self, words: set[str], coverage: float) -> bool:
        """Whether the words could reach the coverage."""
        return sum(n for w, n in self.counts.items() if w in words) >= coverage * len(self.words)

    @property
    def musts(self) -> set[int]:
        """Places of words that must be matched: the deciding ones, and the version of a versioned notice."""
        versioned = self.name.startswith(VERSIONED) and len(self.words) <= 20
        return {i for i, w in enumerate(self.words) if w in DECIDING or (versioned and _version.fullmatch(w))}

    def decided(self, pairs: list[tuple[int, int]], words: Sequence[str]) -> bool:
        """Whether the matched words name this license and no other."""
        first, last = pairs[0][1], pairs[-1][1]
        other = lambda w, of: w in of and w not in self.counts
        beside = [*words[max(0, first - 1) : first], *words[last + 1 : last + 2]]
        # A short name is no name when its words are scattered.
        whole = len(self.words) > 8 or last - first < len(self.words) + 2
        return whole and self.musts <= {i for i, _ in pairs} and not any(other(w, DECIDING) for w in words[first : last + 1]) and not any(other(w, QUALIFYING) for w in beside)

    def scan(self, words: list[str], coverage: float) -> list[tuple[int, int, int]]:
        """(matched, first word, last word) of each stretch that reaches the coverage, without overlap, in order."""
        size = len(self.words)
        found: list[tuple[int, int, int]] = []
        for at in range(0, max(1, len(words) - size), size):
            part = words[at : at + 2 * size]
            if not self.enough(set(part), coverage):
                continue
            tries = [(at, part)]
            # A second copy in the stretch takes words' uniqueness away: single lengths are tried from each opening word.
            opening = next((w for w in self.words if w in part), None)
            tries += [(at + k, part[k : k + size]) for k, w in enumerate(part) if w == opening] if part.count(opening) > 1 else []
            for start, piece in tries:
                pairs = align(self.words, piece)
                if len(pairs) >= coverage * size and self.decided(pairs, piece):
                    found.append((len(pairs), start + pairs[0][1], start + pairs[-1][1]))
        found.sort(key=lambda f: (-f[0], f[2] - f[1], f[1]))
        kept: list[tuple[int, int, int]] = []
        for f in found:
            if all(f[2] < g[1] or f[1] > g[2] for g in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[1])


def negated(text: str, place: int) -> bool:
    """Whether a negation stands shortly before the word that starts at ``place``, in its sentence."""
    before = text[max(0, place - 200) : place]
    if stops := [m.end() for m in _stop.finditer(before)]:
        before = before[stops[-1] :]
    return not NEGATIONS.isdisjoint(normal_words(before)[-BEFORE:])


def _scan(batches: Iterator[pa.RecordBatch], templates: list[Template], coverage: float) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("hits", pa.int32()),
        ("first_word", pa.int64()), ("last_word", pa.int64()), ("n_words", pa.int64()),
    ])
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = normal_words(text or "")
            present = set(words)
            by_name: dict[str, tuple] = {}
            places: list[int] = []
            for t in templates:
                if t.enough(present, coverage) and (found := t.scan(words, coverage)):
                    if len(t.words) <= 8:  # a name; a text of its own is no mention
                        places = places or [m.start() for m in _word.finditer(text.lower())]
                        found = [f for f in found if not negated(text.lower(), places[f[1]])]
                        if not found:
                            continue
                    best, name = max(found, key=lambda f: (f[0], -f[1])), t.name.partition(":")[0]
                    row = (doc_id, name, best[0] / len(t.words), best[0], len(found), best[1], best[2], len(words))
                    # Of a license's wordings, the one of most words matched counts.
                    if name not in by_name or row[3] > by_name[name][3]:
                        by_name[name] = row
            rows += by_name.values()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)


def license_scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """A row per document and license whose template is covered to ``coverage`` or more, deciding words (names, versions, NC, SA, ND) included
    and no other license's among them, and which no negation turns round: the best stretch's
    coverage and place (words from 0, normalised to letters and digits), and how many stretches there are."""
    ready = [Template(n, tuple(w := normal_words(t)), Counter(w)) for n, t in templates.items()]
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _scan(batches, ready, coverage), HITS)
