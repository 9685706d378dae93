"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression over the lower-cased words of a text. Its keyword must be present before it runs.
Overlapping detections are settled by priority: a detection inside one of a higher priority, or of the same priority
and greater length, is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, ArrayType, StructType

from millrace.llm.texts import map_texts, words_of

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# SPDX identifiers. A tag "SPDX-License-Identifier: X" is a signature of each, by one rule.
SPDX = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-1.0
GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IPL-1.0 ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later
LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.0 OFL-1.1
OpenSSL OSL-3.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11
Zlib ZPL-2.1
""".split()
# Signatures written by hand on lower-cased words, as label, keyword that must be there, and expression.
# First sentences of license texts and notices, then names with a version, names, grants, and wider hints.
NOTICES = """
mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?
mit | without restriction including without limitation the rights | to deal in the software without restriction including without limitation the rights to use copy modify merge publish
mit-0 | mit no attribution | mit no attribution
x11 | x consortium | except as contained in this notice the name of the x consortium shall not be used
isc | permission to use copy modify | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use copy modify | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither the name of | neither the name of (?:\\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used
bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | licensed under the apache license version 2 0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance
apache-2.0 | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache | except in compliance with the license | you may not use this file except in compliance with the license
apache-1.1 | this product includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
gpl | under the terms of the gnu general public license | redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | either version 2 of the license | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-3.0-or-later | either version 3 of the license | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-2.0-only | version 2 of the license | gnu general public license as published by the free software foundation version 2 of the license
gpl-2.0 | gnu general public license version 2 june 1991 | gnu general public license version 2 june 1991
gpl-3.0 | gnu general public license version 3 29 june 2007 | gnu general public license version 3 29 june 2007
gpl | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license
lgpl | under the terms of the gnu lesser general public license | redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | under the terms of the gnu library general public license | redistribute it and or modify it under the terms of the gnu library general public license
lgpl-2.1 | gnu lesser general public license version 2 1 february 1999 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | gnu lesser general public license version 3 29 june 2007 | gnu lesser general public license version 3 29 june 2007
lgpl | you should have received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public license
agpl | under the terms of the gnu affero general public license | redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3.0 | gnu affero general public license version 3 19 november 2007 | gnu affero general public license version 3 19 november 2007
mpl-2.0 | this source code form is subject to the terms | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla public license version 1 1 | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse public license v1 0 | accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse public license 2 0 | made available under the terms of the eclipse public license 2 0
cddl | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
boost | boost software license version 1 0 | distributed under the boost software license version 1 0
zlib | this software is provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
cc0-1.0 | waived all copyright | to the extent possible under law (?:\\S+ ){1,12}has waived all copyright
cc0-1.0 | creativecommons org publicdomain zero 1 0 | creativecommons org publicdomain zero 1 0
cc-by-4.0 | creativecommons org licenses by 4 0 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org licenses by 3 0 | creativecommons org licenses by 3 0
cc-by-sa-4.0 | creativecommons org licenses by sa 4 0 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org licenses by sa 3 0 | creativecommons org licenses by sa 3 0
cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc [0-9] [0-9]
cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd [0-9] [0-9]
cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa [0-9] [0-9]
cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd [0-9] [0-9]
wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
artistic | under the same terms as perl | under the same terms as perl(?: itself)?
openssl | openssl project for use in the openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
ofl-1.1 | sil open font license version 1 1 | this font software is licensed under the sil open font license version 1 1
ncsa | university of illinois | university of illinois (?:\\S+ )?open source license
public-domain | public domain | (?:is|are|been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain
public-domain | no copyright is claimed | no copyright is claimed
proprietary | confidential and proprietary | confidential and proprietary
proprietary | unauthorized copying of this file | unauthorized copying of this file
proprietary | all rights reserved | all rights reserved(?: worldwide)?
"""
VERSIONED = """
apache-2.0 | apache license | apache license (?:version |v ?)?2(?: 0)?
apache-2.0 | apache 2 | apache 2(?: 0)? (?:license|licence|licensed)
apache-2.0 | apache software license | apache software license (?:version |v ?)?2(?: 0)?
apache-2.0 | asl 2 | asl 2(?: 0)? (?:license|licence|licensed)
apache-1.1 | apache license | apache (?:software )?license (?:version |v ?)?1 1
apache-1.1 | apache software license | apache software license (?:version |v ?)?1 1
gpl-1.0 | general public license | (?:gnu )?general public license (?:version |v ?)1(?: 0)?
gpl-2.0 | general public license | (?:gnu )?general public license (?:version |v ?)2(?: 0)?(?: only)?
gpl-3.0 | general public license | (?:gnu )?general public license (?:version |v ?)3(?: 0)?(?: only)?
gpl-2.0-or-later | general public license | (?:gnu )?general public license (?:version |v ?)2(?: 0)? or (?:any )?later(?: version)?
gpl-3.0-or-later | general public license | (?:gnu )?general public license (?:version |v ?)3(?: 0)? or (?:any )?later(?: version)?
gpl-2.0 | gplv2 | (?:gnu )?gplv2
gpl-3.0 | gplv3 | (?:gnu )?gplv3
gpl-2.0 | gpl 2 | gpl 2(?: 0)?(?: only| or later)? (?:license|licence|licensed)
gpl-3.0 | gpl 3 | gpl 3(?: 0)?(?: only| or later)? (?:license|licence|licensed)
gpl-2.0 | gpl v2 | (?:gnu )?gpl v2
gpl-3.0 | gpl v3 | (?:gnu )?gpl v3
gpl-2.0 | gpl version 2 | (?:gnu )?gpl version 2
gpl-3.0 | gpl version 3 | (?:gnu )?gpl version 3
lgpl-2.0 | library general public license | (?:gnu )?library general public license (?:version |v ?)2(?: 0)?
lgpl-2.1 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)2 1
lgpl-3.0 | lesser general public license | (?:gnu )?lesser general public license (?:version |v ?)3(?: 0)?
lgpl-2.1 | lgplv2 | (?:gnu )?lgplv2(?: 1)?
lgpl-3.0 | lgplv3 | (?:gnu )?lgplv3
lgpl-2.1 | lgpl v2 1 | (?:gnu )?lgpl v2 1
lgpl-2.1 | lgpl version 2 1 | (?:gnu )?lgpl version 2 1
lgpl-3.0 | lgpl v3 | (?:gnu )?lgpl v3
lgpl-3.0 | lgpl version 3 | (?:gnu )?lgpl version 3
agpl-3.0 | affero general public license | (?:gnu )?affero general public license (?:version |v ?)3(?: 0)?
agpl-3.0 | agplv3 | (?:gnu )?agplv3
agpl-3.0 | agpl v3 | (?:gnu )?agpl v3
bsd-2-clause | bsd 2 clause | bsd 2 clause(?: license| licence)?
bsd-3-clause | bsd 3 clause | bsd 3 clause(?: license| licence)?
bsd-4-clause | bsd 4 clause | bsd 4 clause(?: license| licence)?
bsd-2-clause | 2 clause bsd | 2 clause bsd(?: license| licence)?
bsd-3-clause | 3 clause bsd | 3 clause bsd(?: license| licence)?
bsd-4-clause | 4 clause bsd | 4 clause bsd(?: license| licence)?
bsd-2-clause | two clause bsd | two clause bsd(?: license| licence)?
bsd-3-clause | three clause bsd | three clause bsd(?: license| licence)?
bsd-2-clause | simplified bsd | simplified bsd (?:license|licence)
bsd-3-clause | new bsd | new bsd (?:license|licence)
bsd-3-clause | modified bsd | modified bsd (?:license|licence)
bsd-3-clause | revised bsd | revised bsd (?:license|licence)
bsd-4-clause | original bsd | original bsd (?:license|licence)
0bsd | zero clause bsd | zero clause bsd(?: license| licence)?
mpl-1.0 | mozilla public license | mozilla public license (?:version |v ?)?1 0
mpl-1.1 | mozilla public license | mozilla public license (?:version |v ?)?1 1
mpl-2.0 | mozilla public license | mozilla public license (?:version |v ?)?2(?: 0)?
mpl-2.0 | mpl 2 0 | mpl 2 0(?: license| licence| licensed)?
epl-1.0 | eclipse public license | eclipse public license (?:version |v ?)?1 0
epl-2.0 | eclipse public license | eclipse public license (?:version |v ?)?2(?: 0)?
cddl-1.0 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v ?)?1 0
cddl-1.1 | common development and distribution license | common development and distribution license (?:cddl )?(?:version |v ?)?1 1
cc-by-3.0 | attribution 3 0 | creative commons attribution 3 0(?: unported| international)?(?: license)?
cc-by-4.0 | attribution 4 0 | creative commons attribution 4 0(?: international)?(?: license)?
cc-by-sa-3.0 | alike 3 0 | creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
cc-by-sa-4.0 | alike 4 0 | creative commons attribution share ?alike 4 0(?: international)?(?: license)?
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa 4 0
cc-by-4.0 | cc by 4 0 | cc by 4 0
cc-by-nc-4.0 | noncommercial 4 0 | creative commons attribution noncommercial 4 0(?: international)?(?: license)?
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc 4 0
cc0-1.0 | cc0 1 0 | cc0 1 0(?: universal)?
artistic-1.0 | artistic license | (?:perl )?artistic license (?:version |v ?)?1 0
artistic-2.0 | artistic license | (?:perl )?artistic license (?:version |v ?)?2 0
php-3.01 | php license | php license (?:version |v ?)?3 01
ofl-1.1 | open font license | (?:sil )?open font license (?:version |v ?)?1 1
eupl-1.2 | european union public | european union public licen[cs]e (?:version |v ?)?1 2
sspl-1.0 | server side public license | server side public license(?: version 1| v1)
busl-1.1 | business source license | business source license 1 1
elastic-2.0 | elastic license | elastic license (?:version |v ?)?2 0
afl-3.0 | academic free license | academic free license (?:version |v ?)?3 0
osl-3.0 | open software license | open software license (?:version |v ?)?3 0
psf-2.0 | python software foundation license | python software foundation license (?:version |v ?)?2
"""
NAMES = """
mit | mit license | mit license
mit | mit licence | mit licence
mit | expat license | expat license
mit | mit style license | mit style license
x11 | x11 license | x11 license
apache | apache license | apache license
apache | apache licence | apache licence
apache | apache software license | apache software license
gpl | general public license | (?:gnu )?general public licen[cs]e
gpl | general public licence | (?:gnu )?general public licence
gpl | gpl license | (?:gnu )?gpl license
gpl | gpl licensed | (?:gnu )?gpl licensed
lgpl | lesser general public license | (?:gnu )?lesser general public license
lgpl | library general public license | (?:gnu )?library general public license
lgpl | lgpl license | (?:gnu )?lgpl license
agpl | affero general public license | (?:gnu )?affero general public license
agpl | agpl license | (?:gnu )?agpl license
gfdl | gnu free documentation license | gnu free documentation license
bsd | bsd license | bsd license
bsd | bsd licence | bsd licence
bsd | bsd style license | bsd style license
mpl | mozilla public license | mozilla public license
mpl | mpl license | mpl license
epl | eclipse public license | eclipse public license
cddl | common development and distribution license | common development and distribution license
cpl | common public license | common public license
ibm-public | ibm public license | ibm public license
cc0 | cc0 license | cc0 license
cc0 | creative commons zero | creative commons zero(?: license)?
cc-by-sa | attribution share alike | creative commons attribution share alike(?: license)?
cc-by-sa | attribution sharealike | creative commons attribution sharealike(?: license)?
cc-by-nc | attribution noncommercial | creative commons attribution noncommercial(?: license)?
cc-by-nd | attribution noderivatives | creative commons attribution noderivatives(?: license)?
cc-by-nd | attribution noderivs | creative commons attribution noderivs(?: license)?
cc-by | creative commons attribution | creative commons attribution(?: license)?
creative-commons | creative commons license | creative commons license
isc | isc license | isc license
zlib | zlib license | zlib license
libpng | libpng license | (?:zlib )?libpng license
boost | boost software license | boost software license
unlicense | the unlicense | the unlicense
wtfpl | wtfpl license | wtfpl license
artistic | artistic license | (?:perl )?artistic license
python | python software foundation license | python software foundation license
python | psf license | psf license
php | php license | php license
ruby | ruby license | ruby license(?! plate)
openssl | openssl license | openssl license
postgresql | postgresql license | postgresql license
ofl | open font license | (?:sil )?open font license
eupl | european union public | european union public licen[cs]e
odbl | open database license | open database license
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
afl | academic free license | academic free license
osl | open software license | open software license
sleepycat | sleepycat license | sleepycat license
vim | vim license | vim license
w3c | w3c software | w3c software (?:notice and )?license
sspl | server side public license | server side public license
busl | business source license | business source license
elastic | elastic license | elastic license
ncsa | ncsa open source license | (?:university of illinois )?ncsa open source license
lppl | latex project public license | latex project public license
qpl | q public license | q public license
cecill | cecill license | cecill license
upl | universal permissive license | universal permissive license
"""
GRANTS = """
mit | under mit | (?:licensed|released|distributed|available|published|provided) under mit
mit | under the mit | (?:licensed|released|distributed|available|published|provided) under the (?:terms of the )?mit
apache-2.0 | under apache 2 | (?:licensed|released|distributed|available|published|provided) under apache 2(?: 0)?
apache-2.0 | under the apache 2 | (?:licensed|released|distributed|available|published|provided) under the apache 2(?: 0)?
gpl | under the gpl | (?:licensed|released|distributed|available|published|provided) under the (?:gnu )?gpl
gpl | under the gnu gpl | (?:licensed|released|distributed|available|published|provided) under the gnu gpl
gpl | under gpl | (?:licensed|released|distributed|available|published|provided) under gpl
lgpl | under the lgpl | (?:licensed|released|distributed|available|published|provided) under the (?:gnu )?lgpl
agpl | under the agpl | (?:licensed|released|distributed|available|published|provided) under the (?:gnu )?agpl
bsd | under the bsd | (?:licensed|released|distributed|available|published|provided) under the bsd
bsd | under bsd | (?:licensed|released|distributed|available|published|provided) under bsd
mpl | under the mpl | (?:licensed|released|distributed|available|published|provided) under the mpl
isc | under the isc | (?:licensed|released|distributed|available|published|provided) under the isc
cc0 | under cc0 | (?:licensed|released|distributed|available|published|provided) under cc0
cc-by | under cc by | (?:licensed|released|distributed|available|published|provided) under cc by
creative-commons | under creative commons | (?:licensed|released|distributed|available|published|provided) under (?:a )?creative commons
creative-commons | under a creative commons | (?:licensed|released|distributed|available|published|provided) under a creative commons
"""
HINTS = """
license-notice | see the license file | see the license file
license-notice | see license for | see license for
license-notice | license agreement | (?:end user |software )?license agreement
license-notice | licensed under | licensed under
"""
#: The lists with their priority and weight; tags come before all.
RANKED = [(NOTICES, 5, 0.95), (VERSIONED, 4, 0.9), (NAMES, 3, 0.7), (GRANTS, 2, 0.8), (HINTS, 1, 0.3)]
TAG_PRIORITY = 6


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def signatures() -> list[Signature]:
    """The rules in order of priority."""
    out = []
    for tag in SPDX:
        words = re.sub("[^a-z0-9]+", " ", tag.lower())
        out.append(Signature(tag.lower(), f"identifier {words}", f"spdx license identifier {words}", TAG_PRIORITY, 1.0))
    for lines, priority, weight in RANKED:
        for line in lines.strip().splitlines():
            out.append(Signature(*(part.strip() for part in line.split(" | ")), priority, weight))
    return out


class Scanner:
    """Detections in a text's words."""

    def __init__(self, rules: list[Signature] | None = None, phrases: dict[str, str] | None = None) -> None:
        self.rules = [(s, re.compile(rf"(?<= ){s.pattern}(?= )")) for s in (signatures() if rules is None else rules)]
        self.phrases = list((PHRASES if phrases is None else phrases).items())
        self.gate = ahocorasick.Automaton()
        by_keyword: dict[str, list[int]] = {}
        for i, (s, _) in enumerate(self.rules):
            by_keyword.setdefault(s.keyword, []).append(i)
        for keyword, at in by_keyword.items():
            self.gate.add_word(f" {keyword} ", at)
        self.gate.make_automaton()

    def places(self, joined: str) -> list[tuple[str, int]]:
        """Labels of the phrases and where they begin, in characters of the joined words."""
        out = []
        for phrase, label in self.phrases:
            at = joined.find(f" {phrase} ")
            while at >= 0:
                out.append((label, at + 1))
                at = joined.find(f" {phrase} ", at + 1)
        return out

    def detections(self, joined: str) -> list[tuple[int, int, Signature]]:
        """What is left after suppression, as (start, end, rule) in characters of the joined words."""
        due = sorted({i for _, at in self.gate.iter(joined) for i in at})
        found = [(m.start(), m.end(), s) for s, p in (self.rules[i] for i in due) for m in p.finditer(joined)]
        found.sort(key=lambda f: (f[0], -f[1], -f[2].priority, f[2].label))
        left, furthest = [], [0] * 8  # by priority, where the detections so far end at most
        for a, b, s in found:
            if max(furthest[s.priority :]) < b:
                left.append((a, b, s))
            furthest[s.priority] = max(furthest[s.priority], b)
        return left


_DETECTION = StructType([StructField("first_word", LongType()), StructField("end_word", LongType()), StructField("label", StringType()), StructField("weight", DoubleType())])
FIELDS = [StructField("n_words", LongType()), StructField("n_base", LongType()), StructField("first_word", LongType()), StructField("last_word", LongType()), StructField("base_labels", StringType()), StructField("labels", StringType()), StructField("score", DoubleType()), StructField("detections", ArrayType(_DETECTION))]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: list[Signature] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Adds the phrase places, the labels, a score (the greatest weight among them, 0 for none) and the detections.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text. Null and empty texts have none: 0 words, null
    first_word and last_word, empty labels, score 0. Very long texts are scanned whole. Repeated rows are each scanned; input columns with the name of an
    added one give way.
    """

    def make() -> Callable[[list], dict]:
        scanner = Scanner(rules, phrases)

        def run(texts: list) -> dict:
            out: dict[str, list] = {f.name: [] for f in FIELDS}
            for raw in texts:
                words = words_of(raw)
                joined = f" {b' '.join(words).decode()} "
                places, found = scanner.places(joined), scanner.detections(joined)
                base = {label for label, _ in places}
                # Where each word begins; found once for a text, so that the time grows with the text and its matches.
                begins = np.cumsum([1, *(len(w.decode()) + 1 for w in words)]) if places or found else np.zeros(0, np.int64)
                word_at = lambda at: int(np.searchsorted(begins, at))
                starts = [word_at(at) for _, at in places]
                row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s.label for *_, s in found})))
                score = max([0.7 * bool(places), *(s.weight for *_, s in found)])
                spans = [{"first_word": word_at(a), "end_word": word_at(b + 1), "label": s.label, "weight": s.weight} for a, b, s in found]
                for f, value in zip(FIELDS, (*row, float(score), spans), strict=True):
                    out[f.name].append(value)
            return out

        return run

    return map_texts(docs, FIELDS, make, text, keep)
