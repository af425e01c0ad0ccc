"""Licence scans: against a plain reading word by word, on standard notices as they are wrapped, tags, statements and distances."""

from __future__ import annotations

import os
import re

from llm.helpers import AWKWARD, collected, documents

from quillspark.llm import licenses
from quillspark.llm.common import table

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


def words_of(text: str) -> tuple[list[str], list[str]]:
    """Words, and what stands before each and after the last: a space, ``~`` (a sentence may end) or ``|`` (it ends)."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "|~\xa0" else c for c in text)
    lines = re.sub("\r\n?|[\f\x0b\x85\u2028\u2029]", "\n", text).split("\n")
    words, before, strength = [], [], "|"

    def boundary(kind: str) -> None:
        nonlocal strength
        strength = max(strength, kind, key=" ~|".index)

    for n, line in enumerate(lines):
        if n:
            boundary("~")
        if not re.search("[a-z0-9]", line) and 0 < n < len(lines) - 1:
            boundary("|")
        label = re.match(r"[^a-z0-9]*(?:[0-9]{1,2}|[a-z]|[ivx]{2,5})[.)](?=[ \t])", line)
        if label:
            boundary("|")
            line = line[label.end():]
        for run in re.finditer(r"[a-z0-9]+|[^a-z0-9\s]+|\s+", line):
            piece = run[0]
            if piece[0].isspace():
                continue
            if re.fullmatch("[a-z0-9]+", piece):
                words.append(piece)
                before.append(strength)
                strength = " "
            elif re.search("[.!?]", piece) and (run.end() == len(line) or line[run.end()].isspace()):
                boundary("|")
            elif re.search("[;:]", piece):
                boundary("~")
    return words, [*before, "|"]


LISTS = {form: form.split() for form in [*licenses.NOTICES, *licenses.TAGS, *licenses.CALLED]}


def plain(text: str | None) -> tuple[str, str]:
    """Identifiers and licences of a text."""
    words, before = words_of(text or "")

    def longest(at: int, forms) -> str | None:
        fits = [f for f in forms if words[at:at + len(LISTS[f])] == LISTS[f] and "|" not in before[at + 1:at + len(LISTS[f])]]
        return max(fits, key=lambda f: (len(f), f), default=None)

    ids, parts, at, last = [], "", 0, None
    starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words) + 1)]
    while at < len(words):
        found, end = [], at
        form = longest(at, licenses.LONGER)
        short = None if form else longest(at, [f for f in licenses.SHORTER if before[at] in "~|" and at + len(LISTS[f]) <= len(words) and before[at + len(LISTS[f])] in "~|"])
        if form or short:
            found, end = [licenses.NUMBERS[form or short]], at + len(LISTS[form or short])
        elif words[at:at + 3] == ["spdx", "license", "identifier"] and "|" not in before[at + 1:at + 4]:
            end = at + 3
            while (tag := longest(end, licenses.TAGS)) and before[end] != "|":
                found.append(licenses.TAGS[tag])
                end += len(LISTS[tag])
                if end + 1 < len(words) and words[end] in ("or", "and") and "|" not in before[end:end + 2] and longest(end + 1, licenses.TAGS):
                    end += 1
                else:
                    break
        elif words[at] in "licensed licenced relicensed relicenced released distributed redistributed published provided offered available".split():
            for lead in ("under", "under the", "under a", "under an", *(f"{u} terms of{t}" for u in ("under", "under the", "under a", "under an") for t in ("", " the", " a", " an"))):
                n = at + 1 + len(lead.split())
                if words[at + 1:n] == lead.split() and n < len(words) and "|" not in before[at + 1:n + 1] and (name := longest(n, licenses.CALLED)):
                    end = n + len(LISTS[name])  # a statement that is a known sentence counts as that
                    found = [licenses.NUMBERS.get(" ".join(words[at:end]), licenses.CALLED[name])]
        if found:
            # A match leaves its boundary marks to the text between; a space or mark is one character each.
            if last is not None and starts[at] - last > licenses.GAP:
                parts += "|"
            parts += "".join(licenses.key(licenses.STANDS[i]) for i in found)
            ids += found
            at, last = end, starts[end] - 1
        else:
            at += 1
    names: list[str] = []
    for name, rule in licenses.RULES:
        if name != licenses.RESERVED and licenses.key(rule) in parts:
            parts = parts.replace(licenses.key(rule), "|")
            names += [name] if name not in names else []
    reserved = licenses.key(next(r for name, r in licenses.RULES if name == licenses.RESERVED))
    return ",".join(map(str, ids)), ",".join(names or ([licenses.RESERVED] if reserved in parts else []))


def scanned(spark, texts):
    found = {r["doc_id"]: r for r in collected(licenses.scan(documents(spark, texts)))}
    for i, text in texts:
        if i is not None and len(text or "") < 20_000:
            assert (found[i]["sentences"], found[i]["licenses"]) == plain(text), (i, text)
    return {i: (r["licenses"], r["n_unknown"]) for i, r in found.items()}


def test_rules_in_order(spark):
    apache = "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."
    texts = [
        (1, "Text.\n" + apache + "\nMore."), (2, "LICENSED%%% under*** the&&& Apache License,, Version 2.0"), (3, apache.split(". You")[0] + ".\n" * 3 + "Released under the MIT License."),
        (4, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.\nEither version 3 of the License, or (at your option) any later version."),
        (5, "This file has a strange licence of its own. Nothing more."), (6, "Released under the MIT License! Released under the MIT License."),
        (7, "You may not use this file except in compliance with the License."),
    ]
    assert scanned(spark, texts) == {1: ("Apache-2.0", 0), 2: ("Apache-2.0", 0), 3: ("Apache-2.0,MIT", 0), 4: ("GPL-3.0-or-later", 0), 5: ("", 1), 6: ("MIT", 0), 7: ("", 0)}


def test_tags_and_statements(spark):
    cases = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;": "Apache-2.0,MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "SPDX-License-Identifier: LicenseRef-own": "", "Licensed under the Apache License, Version 2.0, and you may not use it otherwise.": "Apache-2.0",
        "This font is published under the terms of the SIL Open Font License, Version 1.1, like others.": "OFL-1.1", "The work (c) me, available under CC-BY-SA 4.0 since May.": "CC-BY-SA-4.0",
        "It is distributed under the GNU Lesser General Public License version 2.1 or later, as you like.": "LGPL-2.1-or-later", "was licensed under a scheme of its own": "",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
        "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to\nthis work.": "CC0-1.0",
        "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/": "EPL-2.0",
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.": "AGPL-3.0-or-later",
    }
    found = scanned(spark, list(enumerate(cases)))
    assert {text: found[i][0] for i, text in enumerate(cases)} == cases
    every = [(1000 + n, f"x\nSPDX-License-Identifier: {name}\ny") for n, name in enumerate(licenses.LICENSES)]
    every += [(2000 + n, f"It is licensed under the {form}, they say.") for n, form in enumerate(licenses.CALLED)]
    found = scanned(spark, every)
    assert [found[1000 + n][0] for n in range(len(licenses.LICENSES))] == list(licenses.LICENSES)
    assert all(found[2000 + n][0] for n in range(len(licenses.CALLED)))


def test_a_rule_does_not_reach_across_a_text(spark):
    apart = BSD.replace("2. Redist", "unrelated words here.\n" * 500 + "2. Redist")
    assert scanned(spark, [(1, BSD), (2, apart[:19_000])])[1] == ("BSD-2-Clause", 0)
    found = {r["doc_id"]: r["licenses"] for r in collected(licenses.scan(documents(spark, [(1, BSD), (2, apart)])))}
    assert found == {1: "BSD-2-Clause", 2: "BSD"}


def test_anchors_cover_what_is_known():
    anchor = re.compile("|".join(licenses.ANCHORS))
    assert all(anchor.search(s) for s in [*licenses.NOTICES, licenses.TAG_START, "licensed under"])
    assert len(licenses.LICENSES) >= 60


def test_awkward_rows(spark):
    texts = [*AWKWARD, (20, "license " * 20_000 + "\nReleased under the MIT License.")]
    found = scanned(spark, texts)
    assert found.pop(20) == ("MIT", 1)
    assert set(found.values()) == {("", 0)} and licenses.scan(documents(spark, texts)).count() == len(texts)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_given_documents_equal_the_plain_version(spark):
    docs = table(spark, SF_DIR, "documents")
    text = {r["doc_id"]: r["text"] for r in collected(docs.select("doc_id", "text"))}
    found = collected(licenses.scan(docs))
    assert len(found) == len(text) and any(r["licenses"] for r in found)
    assert {r["doc_id"]: (r["sentences"], r["licenses"]) for r in found} == {i: plain(t) for i, t in text.items()}


APACHE = """   Copyright 2020 Some One

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
"""
BSD = """Copyright (c) 2020, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def test_standard_notices_as_they_are_wrapped(spark):
    whole = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD3, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("software:", "software;").replace("version 3", "version 2")}
    names = list(whole)
    texts = [(i, whole[n]) for i, n in enumerate(names)]
    texts += [(100 + i, "".join(f" * {line}\r\n" for line in whole[n].splitlines())) for i, n in enumerate(names)]
    texts += [(200 + i, " ".join(whole[n].replace("MIT License\n", "").split())) for i, n in enumerate(names)]
    found = scanned(spark, texts)
    assert {i: found[i] for i, _ in texts if i < 200} == {i: (names[i % 100], 0) for i, _ in texts if i < 200}
    assert {i: found[i][0] for i, _ in texts if i >= 200} == {i: names[i % 100] for i, _ in texts if i >= 200}
    assert scanned(spark, [(1, MPL), (2, MPL.replace("v. 2.0", "v.2.0"))])[2] == ("MPL-2.0", 0)


def test_reserved_rights(spark):
    texts = [
        (1, "Some words here.\nAll rights reserved."), (2, "A heading\nALL RIGHTS RESERVED\nmore"), (3, "Words***\nAll rights reserved.***\nmore"), (4, "Nearly all rights reserved places were taken."),
        (5, "All rights reserved.\nReleased under the MIT License."),
    ]
    assert scanned(spark, texts) == {1: ("Proprietary", 0), 2: ("Proprietary", 0), 3: ("Proprietary", 0), 4: ("", 1), 5: ("MIT", 0)}


def test_scans_take_linear_time(spark):
    texts = [(i, "license " + x * 200_000 + " license") for i, x in enumerate((".", ";", "\n", "日", " ", "|", "~ ", ".)", "a\n", "1. "))]
    assert licenses.scan(documents(spark, texts)).where("n_unknown > 0").count() == len(texts)
