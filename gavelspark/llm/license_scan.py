"""License notices, through conditional compression.

Words around a phrase that speaks of licensing are a candidate block, whether the
notice is wrapped over many lines or stands in a text without any. A block is
compressed by itself and with each template as a raw zstandard dictionary; the
templates are ranked by how much of their own compressed size that saves, and
those that save a fair share are compared with the block word by word. The
wording with the most words confirmed is a notice; its words are then out, and
the rest of the block is compared again, until no template is confirmed:
compression proposes, wording decides.

Some words decide and may not differ: those that name a family (Lesser, Affero,
Mozilla, ...) veto a template that lacks them or has none of them. Where a template
states a version or a kind (4.0, BY-NC, 2-Clause), the one in the text is read, and
the license is that of the version and kind found, if there is such a one, else
none. The conditions that both BSD licenses share are the 2-Clause's, unless the
clause on names follows.

Defined results: a null or empty text has no block; a block in which no template
is confirmed gives one row without a license; of wordings that tie, the earlier
template's is taken; repeated rows are scanned each; null keys are carried, keys
may have any type; texts of any length are scanned whole; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: What a candidate block speaks of (for Java and Python alike). Fixed values.
CUES = (
    r"(?i)licen[cs]|copyright|all\s+rights\s+reserved|creative\s+commons|\bcc[ -]by|\bspdx|public\s+domain|redistribution|warranty|permission\s+is\s+hereby|"
    r"permission\s+to\s+use|without\s+limitation\s+the\s+rights|free\s+software|\bas[ -]is\b|unencumbered|neither\s+the\s+name"
)

#: Notices as their stewards word them, one for all versions and kinds (see `stated`). Fixed values.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("all-rights-reserved", "All rights reserved."),
]

#: The versions that each family has. Fixed values.
VERSIONS = {
    "Apache": ["1.0", "1.1", "2.0"], "GPL": ["1.0", "2.0", "3.0"], "LGPL": ["2.0", "2.1", "3.0"], "AGPL": ["1.0", "3.0"], "MPL": ["1.0", "1.1", "2.0"], "EPL": ["1.0", "2.0"], "BSL": ["1.0"],
    "Artistic": ["1.0", "2.0"], "CC": ["1.0", "2.0", "2.5", "3.0", "4.0"], "CC0": ["1.0"], "BSD": ["1-Clause", "2-Clause", "3-Clause", "4-Clause"],
}
#: The kinds of Creative Commons licenses. Fixed values.
KINDS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
#: Words that name a family. Fixed values.
FAMILIES = {w: w for w in ("apache", "mit", "isc", "bsd", "gnu", "lesser", "affero", "mozilla", "eclipse", "boost", "artistic", "cc", "cc0", "unencumbered")} | {"general": "gnu", "creative": "cc", "commons": "cc"}
_LONG_KINDS = {"attribution": "BY", "sharealike": "SA", "noncommercial": "NC", "noderivatives": "ND", "noderivs": "ND"}

#: zstandard's level: from this one on it looks for matches at every place of a dictionary as short as a notice.
LEVEL = 13
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def _words(text: str) -> list[str]:
    """Words and version numbers, lower case; marks around them don't count."""
    return [w.lower() for w in _WORD.findall(text)]


def wording(block: list, template: list[str], slots: list[int], near: float) -> tuple[int, int, int, int, list]:
    """The place of block most like the template: (first word, end, words of the
    template that it lacks, words of its own, what it states at the template's
    slots; None there: nothing). Found from the longest run of words that both have,
    within the template's length of it."""
    match = difflib.SequenceMatcher(None, block, template, autojunk=False)
    seed = match.find_longest_match()
    if not seed.size:
        return 0, 0, len(template), 0, []
    slack = int(near * len(template)) + 2
    low, high = max(0, seed.a - seed.b - slack), min(len(block), seed.a - seed.b + len(template) + slack)
    runs = [m for m in difflib.SequenceMatcher(None, block[low:high], template, autojunk=False).get_matching_blocks() if m.size]
    shared, first, end = sum(m.size for m in runs), low + runs[0].a, low + runs[-1].a + runs[-1].size
    says = []
    for slot in slots:
        before = max((m for m in runs if m.b <= slot), key=lambda m: m.b, default=None)
        if before is not None and slot < before.b + before.size:
            says.append(stated(template[slot]))
            continue
        after = min((m for m in runs if m.b > slot), key=lambda m: m.b, default=None)
        start = low if before is None else low + before.a + before.size
        stop = min(start + 3, high) if after is None else low + after.a
        what = stated(template[slot])[0]
        at = next((i for i in range(start, stop) if (said := stated(block[i])) and said[0] == what), None)
        says.append(None if at is None else stated(block[at]))
        if at is not None:
            shared, first, end = shared + 1, min(first, at), max(end, at + 1)
    return first, end, len(template) - shared, end - first - shared, says


def stated(word: str | None) -> tuple[str, str] | None:
    """What a word says of a license: ("version", 2.0), ("clause", 3-Clause) or ("kind", BY-NC)."""
    if word is None:
        return None
    if re.fullmatch(r"v?\d{1,2}(\.\d+)?", word):
        number = word.lstrip("v")
        return "version", number if "." in number else f"{number}.0"
    if re.fullmatch(r"\d-clause", word):
        return "clause", word.replace("c", "C")
    parts = [_LONG_KINDS.get(x, x.upper()) for x in word.split("-")]
    return ("kind", "-".join(parts)) if parts[0] == "BY" and {*parts} <= {"BY", "SA", "NC", "ND"} else None


def _plain(words: list[str]) -> bytes:
    """What is compressed: versions and kinds weigh nothing in the ranking, they are read afterwards."""
    return " ".join("#" + said[0] if (w[:1] in "vb0123456789" and (said := stated(w))) else w for w in words).encode()


def families(words: list) -> set[str]:
    return {FAMILIES[w] for w in words if w in FAMILIES}


def license_named(name: str, found: list[tuple[str, str]]) -> str | None:
    """The license of name's family with the versions and kinds that were found; None: there is no such one."""
    family, _, rest = name.partition("-")
    if family not in VERSIONS or not found:
        return name
    values = {what: {v for w, v in found if w == what} for what, _ in found}
    if any(len(v) > 1 for v in values.values()):
        return None
    one = {what: next(iter(v)) for what, v in values.items()}
    kind, version = rest.rpartition("-")[0] if family == "CC" else "", rest.rpartition("-")[2] if family == "CC" else rest
    kind, version = one.get("kind", kind), one.get("version", one.get("clause", version))
    if version not in VERSIONS[family] or (family == "CC" and kind not in KINDS):
        return None
    return "-".join(x for x in (family, kind, version) if x)


class Scanner:
    """Templates, ready to compress with. `near` is the largest share of a
    template's words that may differ; a template is compared if the block saves
    at least `saves` of the template's own compressed size with it, or if it is one
    of the three that save most (a notice of three words at the end of a long block
    saves a few bytes only)."""

    def __init__(self, templates: list[tuple[str, str]], near: float, saves: float):
        import zstandard

        self.names, self.near, self.saves = [n for n, _ in templates], near, saves
        self.words = [_words(t) for _, t in templates]
        self.reach = max(map(len, self.words))
        #: Where a template states the version or kind of its own name, and the families that it names.
        self.slots = [[j for j, w in enumerate(words) if (said := stated(w)) and said[1] in re.split("-(?=[0-9])|(?<=CC)-", name)] for name, words in zip(self.names, self.words, strict=True)]
        self.families = [families(words) for words in self.words]
        self.both_bsd = {i for i, (name, words) in enumerate(zip(self.names, self.words, strict=True)) if name == "BSD-2-Clause" and not self.slots[i]}
        self.cue = re.compile(CUES)
        self.alone = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        plain = [_plain(w) for w in self.words]
        self.cost = [max(1, len(self.alone.compress(p))) for p in plain]
        # a template stands in its dictionary twice, to be matched near its end too
        self.given = [
            zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False, dict_data=zstandard.ZstdCompressionDict((p + b"\n") * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for p in plain
        ]
        self.known: dict[tuple[str, ...], list] = {}

    def ranked(self, words: list[str]) -> list[tuple[float, int]]:
        """(share of its own size that the template saves, template), best first."""
        data = _plain(words)
        plain = len(self.alone.compress(data))
        return sorted((((plain - len(c.compress(data))) / cost, -i) for i, (c, cost) in enumerate(zip(self.given, self.cost, strict=True))), reverse=True)

    def notices(self, words: list[str]) -> list[tuple[int, int, int, float, int, int, str]]:
        """(first word, end, template, saved, missing, added, license) of each notice in a block."""
        key = tuple(words)
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            chosen, own, found = [(-at, gain) for n, (gain, at) in enumerate(self.ranked(words)) if gain >= self.saves or (n < 3 and gain > 0.05)], list(words), []
            while True:
                best = None
                for i, gain in sorted(chosen):
                    first, end, missing, added, says = wording(own, self.words[i], self.slots[i], self.near)
                    n = len(self.words[i])
                    if missing + added > self.near * n or (best is not None and n - missing <= best[0]):
                        continue
                    named = None if says and says[0] is None else license_named(self.names[i], [x for x in says if x])
                    if named is None or families(own[first:end]) != self.families[i]:
                        continue
                    best = (n - missing, (first, end, i, gain, missing, added, named))
                if best is None:
                    break
                found.append(best[1])
                own[best[1][0] : best[1][1]] = [None] * (best[1][1] - best[1][0])
            self.known[key] = sorted(found)
        return self.known[key]

    def blocks(self, text: str) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
        """Places and words of the blocks: cues within `reach` words share one, of
        at most 4 * reach words; the next then begins `reach` words before its end."""
        cues = [m.start() for m in self.cue.finditer(text)]
        if not cues:
            return
        places = [m.span() for m in _WORD.finditer(text)]
        starts = [a for a, _ in places]
        low = high = None
        for c in cues:
            at = max(0, bisect.bisect_right(starts, c) - 1)
            a, b = max(0, at - self.reach), min(len(places), at + self.reach)
            if low is not None and a <= high and b - low <= 4 * self.reach:
                high = b
                continue
            if low is not None:
                yield places[low:high], [text[x:y].lower() for x, y in places[low:high]]
            low, high = a, b
        yield places[low:high], [text[x:y].lower() for x, y in places[low:high]]

    def scan(self, text: str) -> list[tuple[int, int, str | None, float | None, int | None, int | None]]:
        """(start, end, license or None, saved, missing, added): notices, those of
        one license that follow each other within a few words as one, and BSD's
        shared conditions with the clause that follows them."""
        found: dict[tuple[int, int], tuple] = {}
        empty = []
        for places, words in self.blocks(text):
            hits = self.notices(words)
            for first, end, i, gain, missing, added, named in hits:
                found.setdefault((places[first][0], i), (places[first][0], places[end - 1][1], named, round(gain, 4), missing, added, i in self.both_bsd))
            if not hits and places:
                empty.append((places[0][0], places[-1][1], None, None, None, None))
        out: list[tuple] = []
        for hit in sorted(found.values(), key=lambda h: (h[0], h[1])):
            if out and (out[-1][2] == hit[2] and hit[0] - out[-1][1] <= 80 or out[-1][6] and hit[2] == "BSD-3-Clause" and hit[0] - out[-1][1] <= 2000):
                last = out.pop()
                hit = (last[0], max(last[1], hit[1]), hit[2], max(last[3], hit[3]), last[4] + hit[4], last[5] + hit[5], False)
            out.append(hit)
        return sorted([h[:6] for h in out] + empty, key=lambda h: h[:2])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, near: float = 0.25, saves: float = 0.3) -> DataFrame:
    """key, start, end (code points), license (null: none confirmed), saved,
    missing, added and the wording itself, for each notice, and for each block
    that speaks of licensing but holds none."""
    ship(docs.sparkSession)
    templates = templates or TEMPLATES
    rows = docs.where(F.col(text).rlike(CUES)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = {"start": pa.int64(), "end": pa.int64(), "license": pa.string(), "saved": pa.float64(), "missing": pa.int64(), "added": pa.int64(), "wording": pa.string()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, near, saves)
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for hit in scanner.scan(t):
                    at.append(i)
                    found.append((*hit, t[hit[0] : hit[1]]))
            if found:
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds.values())]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), *columns], ["key", *kinds])

    schema = f"key {dict(docs.dtypes)[key]}, start long, end long, license string, saved double, missing long, added long, wording string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("key", key)
