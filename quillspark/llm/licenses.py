"""Licence scans by sentence rules.

DataFrame operations only. A text is brought to words with marks where a sentence ends and
where it may end, so that wrapped notices stay whole. Known licence sentences are found in it
and mapped to identifiers: the sentences of standard notices (long ones also inside others),
tags such as ``SPDX-License-Identifier: MIT``, and statements such as "licensed under the
Apache License 2.0" for every licence of the table. The identifiers, in text order, are matched
against ordered rules: a rule holds where its identifiers follow each other at most ``GAP``
characters apart; what it has matched is used up, so that a longer rule, which stands earlier,
keeps shorter ones from matching its parts. The table is fixed and small, so no join is needed
and nothing is shuffled. Texts without any anchor word are not searched.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Known licence sentences, normalised; the identifier is the place in the list, from 1.
SENTENCES = [
    "licensed under the apache license version 2 0",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "released under the mit license",
    "licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "either version 3 of the license or at your option any later version",
    "either version 2 of the license or at your option any later version",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "licensed under cc by sa 4 0",
    "redistribution and use in source and binary forms with or without modification are permitted",
    "redistributions of source code must retain the above copyright notice",
    "redistributions in binary form must reproduce the above copyright notice",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    "this source code form is subject to the terms of the mozilla public license v 2 0",
    "all rights reserved under copyright",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "this is free and unencumbered software released into the public domain",
    "this software is provided as is without any express or implied warranty",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license",
    "either version 2 1 of the license or at your option any later version",
    "waived all copyright and related or neighboring rights to this work",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
]
#: Licence and the sentence identifiers that state it, in order; longer rules first.
SEQUENCES = [
    ("Apache-2.0", (1, 2, 3)),
    ("BSD-3-Clause", (15, 16, 17, 18)),
    ("BSD-2-Clause", (15, 16, 17)),
    ("BSD-2-Clause", (16, 17)),
    ("Apache-2.0", (1, 2)),
    ("GPL-3.0-or-later", (9, 10)),
    ("GPL-2.0-or-later", (9, 11)),
    ("MIT", (6, 7)),
    ("MIT", (4, 6)),
    ("Apache-2.0", (1,)),
    ("MIT", (4,)),
    ("MIT", (5,)),
    ("MIT", (6,)),
    ("GPL-3.0-only", (8,)),
    ("GPL", (9,)),
    ("CC-BY-NC-4.0", (12,)),
    ("CC-BY-4.0", (13,)),
    ("CC-BY-SA-4.0", (14,)),
    ("BSD", (15,)),
    ("MPL-2.0", (19,)),
    ("Proprietary", (20,)),
    ("ISC", (21,)),
    ("Unlicense", (22,)),
    ("Zlib", (23, 24)),
    ("Zlib", (24,)),
    ("BSL-1.0", (25,)),
    ("LGPL-2.1-or-later", (26, 28)),
    ("LGPL-3.0-or-later", (26, 10)),
    ("LGPL-2.0-or-later", (26, 11)),
    ("LGPL", (26,)),
    ("AGPL-3.0-or-later", (27, 10)),
    ("AGPL", (27,)),
    ("CC0-1.0", (29,)),
    ("WTFPL", (30,)),
    ("PostgreSQL", (31,)),
    ("EPL-2.0", (32,)),
    ("EPL-1.0", (33,)),
]

WARRANTY = "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
FREE = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"
PUBLISHED = "as published by the free software foundation either version"
#: Sentences of the standard notices, normalised, and the identifiers of ``SENTENCES`` they stand for in the rules.
NOTICES: dict[str, tuple[int, ...]] = {s: (i,) for i, s in enumerate(SENTENCES, 1)} | {
    "all rights reserved": (20,),
    "licensed under the apache license version 2 0 the license": (1,),
    "you may obtain a copy of the license at": (3,),
    "http www apache org licenses license 2 0": (),
    "https www apache org licenses license 2 0": (),
    "you may obtain a copy of the license at https www apache org licenses license 2 0": (3,),
    f"unless required by applicable law or agreed to in writing {WARRANTY}": (),
    "see the license for the specific language governing permissions and limitations under the license": (),
    "mit license": (4,),
    "the mit license": (4,),
    "the mit license mit": (4,),
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
    "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": (6,),
    f"{FREE} 3 of the license or at your option any later version": (9, 10),
    f"{FREE} 2 of the license or at your option any later version": (9, 11),
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies": (21,),
    f"you can redistribute it and or modify it under the terms of the gnu lesser general public license {PUBLISHED} 2 1 of the license or at your option any later version": (26, 28),
    f"you can redistribute it and or modify it under the terms of the gnu lesser general public license {PUBLISHED} 3 of the license or at your option any later version": (26, 10),
    f"you can redistribute it and or modify it under the terms of the gnu affero general public license {PUBLISHED} 3 of the license or at your option any later version": (27, 10),
    "see the gnu lesser general public license for more details": (),
    "see the gnu affero general public license for more details": (),
    "see the gnu general public license for more details": (),
    "you should have received a copy of the gnu general public license along with this program": (),
    "if not see http www gnu org licenses": (),
    "if not see https www gnu org licenses": (),
    "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses": (),
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": (12,),
    "this work is licensed under a creative commons attribution 4 0 international license": (13,),
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": (14,),
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": (15,),
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": (16,),
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution": (17,),
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission": (18,),
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": (),
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": (),
}

#: Licences by their SPDX identifier, and what they are called after "licensed under the", normalised.
LICENSES: dict[str, list[str]] = {
    "0BSD": ["zero clause bsd license", "0bsd license"],
    "AFL-3.0": ["academic free license version 3 0", "academic free license v 3 0"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3 0", "agpl v3", "agplv3"],
    "AGPL-3.0-or-later": [],
    "Apache-1.1": ["apache software license version 1 1"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license version 2 0", "apache 2 license"],
    "Artistic-1.0": ["artistic license 1 0"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license"],
    "BSD-4-Clause": ["bsd 4 clause license", "original bsd license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "BUSL-1.1": ["business source license 1 1", "business source license"],
    "CC-BY-1.0": ["cc by 1 0"],
    "CC-BY-2.0": ["cc by 2 0", "creative commons attribution 2 0 license"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 license", "creative commons attribution 3 0 unported license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"],
    "CC-BY-NC-3.0": ["cc by nc 3 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "CC-BY-NC-SA-3.0": ["cc by nc sa 3 0"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 license", "creative commons attribution sharealike 3 0 unported license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 license"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "cc0", "creative commons zero v1 0 universal", "creative commons cc0 license"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license"],
    "CDDL-1.1": ["common development and distribution license version 1 1"],
    "CECILL-2.1": ["cecill license version 2 1", "cecill 2 1"],
    "CPL-1.0": ["common public license 1 0", "common public license version 1 0"],
    "ECL-2.0": ["educational community license version 2 0"],
    "EPL-1.0": ["eclipse public license v1 0", "eclipse public license version 1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license v2 0", "eclipse public license version 2 0", "eclipse public license 2 0"],
    "EUPL-1.1": ["european union public licence version 1 1", "eupl version 1 1"],
    "EUPL-1.2": ["european union public licence version 1 2", "eupl version 1 2", "eupl"],
    "GFDL-1.3-or-later": ["gnu free documentation license version 1 3", "gnu free documentation license"],
    "GPL-1.0-or-later": ["gnu general public license version 1"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license version 2 0", "gnu gpl v2", "gnu gplv2", "gplv2", "gpl v2", "gpl version 2"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gplv2 or later", "gpl v2 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license version 3 0", "gnu gpl v3", "gnu gplv3", "gplv3", "gpl v3", "gpl version 3"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gplv3 or later", "gpl v3 or later"],
    "HPND": ["historical permission notice and disclaimer"],
    "ISC": ["isc license"],
    "LGPL-2.0-only": ["gnu library general public license version 2"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgplv2 1", "lgpl v2 1", "lgpl version 2 1"],
    "LGPL-2.1-or-later": ["gnu lesser general public license version 2 1 or later", "lgplv2 1 or later"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgplv3", "lgpl v3", "lgpl version 3"],
    "LGPL-3.0-or-later": ["gnu lesser general public license version 3 or later", "lgplv3 or later"],
    "LPPL-1.3c": ["latex project public license version 1 3c", "latex project public license"],
    "MIT": ["mit license", "mit x11 license", "expat license", "mit expat license"],
    "MIT-0": ["mit no attribution license", "mit 0 license"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0"],
    "MS-PL": ["microsoft public license"],
    "MS-RL": ["microsoft reciprocal license"],
    "NCSA": ["university of illinois ncsa open source license"],
    "ODbL-1.0": ["open database license", "open database license version 1 0", "odbl"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license"],
    "OSL-3.0": ["open software license version 3 0", "open software license v 3 0"],
    "PostgreSQL": ["postgresql license", "postgresql licence"],
    "PSF-2.0": ["python software foundation license version 2", "python software foundation license"],
    "Python-2.0": ["python license 2 0"],
    "Ruby": ["ruby license"],
    "SSPL-1.0": ["server side public license version 1", "server side public license"],
    "Unlicense": ["unlicense"],
    "UPL-1.0": ["universal permissive license version 1 0", "universal permissive license v 1 0"],
    "Vim": ["vim license"],
    "W3C": ["w3c software license"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "Zlib": ["zlib license"],
    "ZPL-2.1": ["zope public license version 2 1"],
}

#: A rule's identifiers stand at most so many characters apart, counted in normalised text.
GAP = 600
#: What holds where no other rule does: a reserved right beside a licence is part of its copyright line.
RESERVED = "Proprietary"
#: A sentence that speaks of a licence or of reserved rights.
MENTION = "(^| )(licen[cs]e[sd]?|rights reserved)( |$)"
#: Known sentences of so many words are also found inside others, as where a copyright line runs into them.
LONG = 9
#: Every known sentence, tag and statement holds one of these.
ANCHORS = ("licen[cs]e", "copyright", "permi", "redistribut", "software", "spdx", "rights", "public domain", "[mg]pl", "gnu", "apache", "under")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tag_of(license_: str) -> str:
    return re.sub("[^a-z0-9]+", " ", license_.lower())


#: Identifiers: places in NOTICES, from 1, then the licences of the table.
NUMBERS = {sentence: i for i, sentence in enumerate(NOTICES, 1)}
LICENSE_NUMBERS = {name: len(NOTICES) + i for i, name in enumerate(LICENSES, 1)}
TAGS = {tag_of(name): number for name, number in LICENSE_NUMBERS.items()}
CALLED = {form: LICENSE_NUMBERS[name] for name, forms in LICENSES.items() for form in [*forms, tag_of(name)]}
#: What an identifier stands for in the rules: parts of sequences, or its licence.
STANDS = {NUMBERS[s]: tuple(map(str, ids)) for s, ids in NOTICES.items()} | {n: (f"L{n}",) for n in LICENSE_NUMBERS.values()}
RULES = [(name, tuple(map(str, ids))) for name, ids in SEQUENCES] + [(name, (f"L{n}",)) for name, n in LICENSE_NUMBERS.items()]
TAG_START = "spdx license identifier "
STATED = r"(?:licen[cs]ed|relicen[cs]ed|released|distributed|redistributed|published|provided|offered|available)[ ~]under(?:[ ~](?:the|a|an))?(?:[ ~]terms[ ~]of(?:[ ~](?:the|a|an))?)?[ ~]"


def key(parts: Sequence[str]) -> str:
    return "".join(f"<{p}>" for p in parts)


def either(forms: Sequence[str]) -> str:
    """Any of ``forms`` running over soft boundaries; longer ones first."""
    return "(?:" + "|".join(f.replace(" ", "[ ~]") for f in sorted(forms, key=lambda f: (-len(f), f))) + ")"


LONGER, SHORTER = [s for s in NOTICES if len(s.split()) >= LONG], [s for s in NOTICES if len(s.split()) < LONG]
TAG_LIST = f"{either(list(TAGS))}(?:[ ~](?:or|and)[ ~]{either(list(TAGS))})*"
NOTICE = "|".join([
    rf"(?<=[ ~|]){either(LONGER)}(?=[ ~|])",
    rf"(?<=[~|]){either(SHORTER)}(?=[~|])",
    rf"(?<=[ ~|]){TAG_START.replace(' ', '[ ~]')}{TAG_LIST}(?=[ ~|])",
    rf"(?<=[ ~|]){STATED}{either(list(CALLED))}(?=[ ~|])",
])


def bounded(text: Column) -> Column:
    """Words in lower case with ``|`` where a sentence ends and ``~`` where it may.

    It ends at marks before white space, blank lines and list labels; it may end at other line
    ends, colons and semicolons. Every pattern is entered once per run, so time is linear.
    """
    out = F.translate(text, UPPER + "|~\u00a0", LOWER + "   ")
    for pattern, by in (
        (r"\r\n?|[\f\x0B\x85\u2028\u2029]", "\n"),
        (r"(?m)^[^a-z0-9\n]*+(?:[0-9]{1,2}|[a-z]|[ivx]{2,5})[.)](?=[ \t])", "|"),
        (r"(?<![^a-z0-9\s])(?=[^a-z0-9\s.!?]*+[.!?])[^a-z0-9\s]++(?=\s|$)", "|"),
        (r"\n(?=[^a-z0-9\n]*+\n)", "|"),
        (r"[\n;:]", "~"),
        (r"[^a-z0-9|~]+", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    out = F.concat(F.lit("|"), out, F.lit("|"))
    out = F.regexp_replace(out, r"(?<![ ~|])(?=[ ~]*+\|)[ ~|]++", "|")
    return F.regexp_replace(out, r"(?<![ ~])(?= *+~)[ ~]++", "~")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_known, n_unknown, sentences, licenses`` of every row of ``docs``.

    ``sentences`` are the identifiers found, in text order, ``licenses`` the licences of the
    matching rules in rule order, each once, both comma-separated; ``n_unknown`` counts
    sentences that speak of a licence beside what is known. A tag that joins identifiers by
    "or" or "and" gives each. Null and empty texts have none of these. Repeated rows and null
    ids come back one by one. Empty tables give an empty result; other columns are neither read
    nor returned. Whole texts are read, in one narrow pass.
    """
    table = lambda entries: F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    numbers, tags, called = table(NUMBERS), table(TAGS), table(CALLED)
    stands = table({i: key(parts) for i, parts in STANDS.items()})
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(key(ids)).alias("key")) for name, ids in RULES if name != RESERVED])
    anchored = F.translate("text", UPPER, LOWER).rlike("|".join(ANCHORS))
    read = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")).select(
        "doc_id", F.when(anchored, bounded(F.col("text"))).otherwise(F.lit("")).alias("text")
    )

    def identifiers(found: Column) -> Column:
        said = F.translate(found, "~", " ")
        tagged = F.transform(F.split(F.substring(said, len(TAG_START) + 1, 1 << 20), " (?:or|and) (?!later)"), lambda t: F.try_element_at(tags, t))
        stated = F.try_element_at(called, F.regexp_replace(said, f"^{STATED}", ""))
        return F.when(F.startswith(said, F.lit(TAG_START)), tagged).otherwise(F.array(F.coalesce(F.try_element_at(numbers, said), stated)))

    # A text without matches, which most are, is not cut.
    matches = F.regexp_extract_all("text", F.lit(NOTICE), 0)
    cut = read.select("doc_id", "text", F.when(F.col("text") != "", matches).otherwise(F.array().cast("array<string>")).alias("matches"))
    marked = F.when(F.size("matches") > 0, F.regexp_replace("text", NOTICE, "<")).otherwise(F.col("text"))
    known = cut.select("doc_id", marked.alias("rest"), F.transform("matches", identifiers).alias("ids"))
    beside = F.size(F.filter(F.split("rest", r"[|<]"), lambda s: F.trim(F.translate(s, "~", " ")).rlike(MENTION))).cast("long")
    gaps = F.transform(F.split("rest", "<"), lambda g: F.length(g))
    # Identifiers farther apart than a rule allows are kept apart by a mark that no rule holds.
    sequence = F.array_join(F.transform("ids", lambda ids, i: F.concat(
        F.when((i > 0) & (F.get(gaps, i) > GAP), F.lit("|")).otherwise(F.lit("")), F.array_join(F.transform(ids, lambda n: F.try_element_at(stands, n)), "")
    )), "")
    found = known.select("doc_id", F.flatten("ids").alias("ids"), beside.alias("n_unknown"), F.when(F.size("ids") > 0, sequence).alias("sequence"))
    start = F.struct(F.col("sequence").alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        holds = F.instr(state["left"], rule["key"]) > 0
        return F.when(
            holds, F.struct(F.replace(state["left"], rule["key"], F.lit("|")).alias("left"), F.array_union(state["found"], F.array(rule["license"])).alias("found"))
        ).otherwise(state)

    state = F.aggregate(rules, start, apply)
    reserved = F.lit(key(next(ids for name, ids in RULES if name == RESERVED)))
    named = F.transform(F.array(state), lambda s: F.when((F.size(s["found"]) == 0) & (F.instr(s["left"], reserved) > 0), F.lit(RESERVED)).otherwise(F.array_join(s["found"], ",")))
    licenses = F.when(F.col("sequence").isNull(), F.lit("")).otherwise(F.element_at(named, 1))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_known"), "n_unknown", F.array_join(F.col("ids").cast("array<string>"), ",").alias("sentences"), licenses.alias("licenses"))
