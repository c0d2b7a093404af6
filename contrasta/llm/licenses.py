"""License scan by ordered signature rules.

A text is reduced to its words (ASCII letters lower-cased, digits and all non-ASCII characters) with
one blank between them. The rules, in order of priority:

1. identifiers in a declared expression (``SPDX-License-Identifier: MIT OR Apache-2.0``),
2. identifiers in a license field (``"license": "ISC"``),
3. sentences of license texts and notices, each a regular expression,
4. names of licenses, each a regular expression, surest behind a declaration (``released under the
   terms of the ...``), less sure behind a mere ``under the``, least sure alone.

Every rule has a keyword, a plain part that each of its matches holds; a rule whose keyword the text
lacks is not run, and a text without any gate (a part of every keyword) runs none. A match that lies
inside a match of an earlier rule is suppressed. It is enough to ask for all matches of earlier rules,
suppressed or not, for whatever suppressed one lies inside a kept one; so one sweep by start with a
tree of ends settles all matches in ``m log m``. Base phrases are plain word sequences; they are
always reported, whatever suppresses them, and all their places count. The score is the certainty of
the surest detection.

Defined cases: null texts are empty and have no match; texts are scanned whole; repeated rows and
null ids are scanned row by row; an empty table gives no rows; other columns are ignored. A plus sign
is no word: ``GPL-2.0+`` is read as ``GPL-2.0``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z become a-z; all other bytes below 0x80 that are no letter or digit become blanks.
_FORM = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Public identifiers of licenses that stand alone.
IDENTIFIERS = """
    0BSD AFL-2.1 AFL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0
    BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause
    BSD-4-Clause-UC BSD-Source-Code BSL-1.0 BUSL-1.1 bzip2-1.0.6 C-UDA-1.0 CAL-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0
    CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.1 CECILL-B CECILL-C CERN-OHL-P-2.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 ClArtistic
    CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUDatagrid EUPL-1.1 EUPL-1.2 Fair FSFAP FTL HPND ICU IJG
    ImageMagick Intel IPL-1.0 ISC JSON Libpng libtiff LPL-1.02 LPPL-1.3c MIT MIT-0 MIT-CMU MirOS MPL-1.0 MPL-1.1 MPL-2.0
    MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-1.0 MulanPSL-2.0 NASA-1.3 NCSA NPL-1.1 NTP ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1
    OGL-UK-3.0 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PolyForm-Noncommercial-1.0.0
    PolyForm-Small-Business-1.0.0 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-3.0 Unicode-DFS-2016
    Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zlib ZPL-2.0 ZPL-2.1
""".split()

# Families whose identifiers follow a rule.
GNU = {"AGPL": ("1.0", "3.0"), "GFDL": ("1.1", "1.2", "1.3"), "GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0")}
CC_KINDS = ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Identifiers that are ordinary words; a license field alone does not make them licenses.
WORDS = frozenset("curl fair icu intel json ruby tcl vim".split())

# Sentences of license texts and notices, the more specific ones first.
TEXTS = (
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy .{1,300}? and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", "except as contained in this notice the name of .{1,60}? shall not be used in advertising"),
    ("json", "the software shall be used for good not evil"),
    ("isc", "permission to use copy modify (?:and|and or) distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "permission to use copy modify (?:and|and or) distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg"),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of (?:its|the|any) contributors"),
    ("bsd-3-clause", "the names? of the (?:author|copyright holder|contributors) may not be used to endorse or promote products"),
    ("bsd-2-clause-views", "should not be interpreted as representing official policies either expressed or implied"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "use of this source code is governed by a bsd style"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("openssl", "this product includes software developed by the openssl project"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("agpl-3.0", "specifically designed to ensure cooperation with the community in the case of network server software"),
    ("lgpl-2.1", "this is the first released version of the lesser gpl"),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("gpl", "free software you can redistribute it and or modify"),
    ("gpl", "this program comes with absolutely no warranty"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("lgpl", "you should have received a copy of the gnu library general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "the contents of this file are subject to the mozilla public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license"),
    ("eupl", "licensed under the eupl"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("zlib", "the origin of this software must not be misrepresented"),
    ("libpng", "the png reference library is supplied as is"),
    ("ncsa", "to deal with the software without restriction"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("psf", "this license agreement is between the python software foundation"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("ofl-1.1", "this font software is licensed under the sil open font license"),
    ("ofl-1.1", "the goals of the open font license ofl are to stimulate worldwide development"),
    ("upl-1.0", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("sspl", "making the functionality of the program or modified version available to third parties as a service"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("cc0", "to the extent possible under law .{1,80}? waived all copyright and related or neighboring rights"),
    ("cc0", "waives all of his or her rights to the work worldwide under copyright law"),
    ("cc", "by exercising the licensed rights defined below you accept and agree to be bound"),
    ("cc", "the work as defined below is provided under the terms of this creative commons public license"),
    ("cc-by-sa", "text is available under the creative commons attribution share ?alike license"),
    ("cc-by", "this is an open access article distributed under the terms of the creative commons attribution license"),
    ("cc-by-nc", "this is an open access article distributed under the terms of the creative commons attribution non ?commercial license"),
    ("odbl", "this database is made available under the open database license"),
    ("odbl", "openstreetmap is open data licensed under"),
    ("openrail", "use based restrictions as referenced in paragraph 5"),
    ("llama", "by using or distributing any portion or element of the llama materials"),
    ("ogl-uk", "contains public sector information licensed under the open government licen[cs]e"),
    ("government-works", "works? of the united states government (?:and )?(?:is|are) not subject to copyright"),
    ("public-domain", "released into the public domain"), ("public-domain", "dedicated to the public domain"),
    ("public-domain", "this work is in the public domain"), ("public-domain", "public domain dedication"),
    ("public-domain", "no copyright is claimed"), ("public-domain", "this file has been placed in the public domain"),
)

# Weaker marks of rights and addresses of licenses.
MARKS = (
    ("proprietary", "confidential and proprietary"), ("proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized (?:copying|use|reproduction|distribution)"), ("proprietary", "may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior )?written permission"),
    ("proprietary", "for internal use only"), ("proprietary", "trade secrets? of"),
    ("no-derivatives", "no derivative works may be"), ("noncommercial", "non ?commercial use only"), ("noncommercial", "for personal use only"),
    ("noncommercial", "may not be used for commercial purposes"), ("evaluation", "for evaluation purposes only"), ("research-only", "for research purposes only"),
    ("warranty", "the software is provided as is without warranty of any kind"), ("warranty", "provided as is without warranty"),
    ("reserved", "some rights reserved"), ("reserved", "no rights reserved"),
    ("cc-url", "creativecommons org licenses [a-z]{2}(?: [a-z]{2}){0,2} [0-9] [0-9]"), ("cc0-url", "creativecommons org publicdomain zero"),
    ("public-domain", "creativecommons org publicdomain mark"), ("gnu-url", "gnu org licen[cs]es"), ("apache-2.0", "apache org licenses license 2 0"),
    ("opensource-url", "opensource org licenses?"), ("spdx-url", "spdx org licenses"), ("mpl-2.0", "mozilla org mpl 2 0"), ("mpl-2.0", "mozilla org en us mpl 2 0"),
    ("bsl-1.0", "boost org license 1 0"), ("epl", "eclipse org legal epl"), ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"), ("ofl-1.1", "scripts sil org ofl"),
    ("odbl", "opendatacommons org licenses odbl"), ("pddl", "opendatacommons org licenses pddl"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]"), ("copyright", "c copyright"), ("copyright", "copyright ©"), ("copyright", "© (?:19|20)[0-9][0-9]"),
)

# Names of licenses, the more specific ones first.
_V, _OR, _LIC = "(?:version |v)?", "(?: of the licen[cs]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?", "(?: licen[cs]e)?"
NAMES = (
    *((f"{short}-{v}.{w}{suffix}", f"{name} (?:as published by the free software foundation )?(?:either )?{_V}{v}{minor}{tail}")
      for short, name, versions in (("agpl", "affero general public licen[cs]e", ((3, 0),)), ("lgpl", "lesser general public licen[cs]e", ((3, 0), (2, 1))),
                                    ("lgpl", "library general public licen[cs]e", ((2, 0),)), ("gpl", "general public licen[cs]e", ((3, 0), (2, 0))),
                                    ("gfdl", "free documentation licen[cs]e", ((1, 3), (1, 2))))
      for v, w in versions for minor in (f" {w}" if w else "(?: 0)?",)
      for suffix, tail in (("-or-later", _OR), ("-only", "(?: of the licen[cs]e)? only"), ("", ""))),
    *((f"{short}-{v}.{w}{suffix}", f"{short} ?v? ?{v}{minor}{tail}") for short, v, w in (("agpl", 3, 0), ("lgpl", 3, 0), ("lgpl", 2, 1), ("gpl", 3, 0), ("gpl", 2, 0))
      for minor in (f" {w}" if w else "(?: 0)?",) for suffix, tail in (("-or-later", " or (?:any )?(?:later|newer)"), ("-only", " only"), ("", ""))),
    ("agpl", "affero general public licen[cs]e"), ("agpl", f"agpl{_LIC}"), ("lgpl", "lesser general public licen[cs]e"), ("lgpl", "library general public licen[cs]e"),
    ("lgpl", f"lgpl{_LIC}"), ("gfdl", "free documentation licen[cs]e"), ("gfdl", f"gfdl{_LIC}"), ("gpl", "gnu public licen[cs]e"), ("gpl", f"gpl{_LIC}"),
    ("apache-1.1", f"apache (?:software )?licen[cs]e {_V}1 1"), ("apache-2.0", f"apache (?:software )?licen[cs]e {_V}2(?: 0)?"), ("apache-2.0", "apache v?2 0"),
    ("apache-2.0", "apache v?2 licen[cs]e"), ("apache", "apache (?:software )?licen[cs]e"), ("apache", "asl 2 0"),
    ("mit-0", "mit no attribution"), ("mit-0", "mit 0"), ("mit", "mit(?: x11)?(?: style)? licen[cs]e"), ("mit", "expat licen[cs]e"), ("mit", "the mit terms"),
    ("bsd-2-clause", f"bsd 2 clause{_LIC}"), ("bsd-2-clause", f"2 clause bsd{_LIC}"), ("bsd-2-clause", f"two clause bsd{_LIC}"), ("bsd-2-clause", f"simplified bsd{_LIC}"),
    ("bsd-2-clause", "freebsd licen[cs]e"), ("bsd-3-clause", f"bsd 3 clause{_LIC}"), ("bsd-3-clause", f"3 clause bsd{_LIC}"), ("bsd-3-clause", f"three clause bsd{_LIC}"),
    ("bsd-3-clause", f"new bsd{_LIC}"), ("bsd-3-clause", f"modified bsd{_LIC}"), ("bsd-3-clause", f"revised bsd{_LIC}"), ("bsd-4-clause", f"bsd 4 clause{_LIC}"),
    ("bsd-4-clause", f"4 clause bsd{_LIC}"), ("bsd-4-clause", f"original bsd{_LIC}"), ("0bsd", "0bsd"), ("0bsd", "zero clause bsd"), ("bsd", "bsd (?:style )?licen[cs]e"),
    ("mpl-1.1", f"mozilla public licen[cs]e {_V}1 1"), ("mpl-2.0", f"mozilla public licen[cs]e {_V}2(?: 0)?"), ("mpl-2.0", "mpl ?v?2 0"), ("mpl", "mozilla public licen[cs]e"),
    ("epl-1.0", f"eclipse public licen[cs]e {_V}1(?: 0)?"), ("epl-2.0", f"eclipse public licen[cs]e {_V}2(?: 0)?"), ("epl", "eclipse public licen[cs]e"),
    ("cddl", "common development and distribution licen[cs]e"), ("cddl", "cddl"), ("cpl-1.0", "common public licen[cs]e"), ("cpal-1.0", "common public attribution licen[cs]e"),
    ("eupl-1.2", f"european union public licen[cs]e {_V}1 2"), ("eupl", "european union public licen[cs]e"), ("eupl", "eupl"), ("ecl-2.0", "educational community licen[cs]e"),
    ("artistic-2.0", f"artistic licen[cs]e {_V}2(?: 0)?"), ("artistic", "artistic licen[cs]e"), ("perl", "same terms as perl(?: itself)?"),
    ("isc", "isc licen[cs]e"), ("zlib", "zlib(?: libpng)? licen[cs]e"), ("bsl-1.0", "boost software licen[cs]e"), ("unlicense", "the unlicense"),
    ("wtfpl", "wtfpl"), ("wtfpl", "do what the fuck you want to public licen[cs]e"), ("beerware", "beer ?ware licen[cs]e"), ("cc0-1.0", "cc0 1 0(?: universal)?"), ("cc0", "cc0"),
    ("cc0", "creative commons zero"),
    *((f"cc-{kind}{'-' + v if v else ''}", f"{start}{words}{_LIC}{' ' + v.replace('.', ' ') if v else ''}(?: international| unported| generic)?")
      for v in (*CC_VERSIONS[::-1], "")
      for kind, words in (("by-nc-nd", "non ?commercial no ?deriv(?:ative)?s"), ("by-nc-sa", "non ?commercial share ?alike"), ("by-nc", "non ?commercial"),
                          ("by-nd", "no ?deriv(?:ative)?s"), ("by-sa", "share ?alike"), ("by", ""))
      for start, words in ((f"creative commons attribution{' ' if words else ''}", words), (f"cc {kind.replace('-', ' ')}", ""))
      if v or not start.endswith("cc by")),
    ("cc", "creative commons licen[cs]e"), ("cc", "creative commons"),
    ("odbl", "open database licen[cs]e"), ("odbl", "odbl"), ("odc-by", "open data commons attribution licen[cs]e"), ("pddl", "public domain dedication and licen[cs]e"),
    ("cdla", "community data licen[cs]e agreement"), ("ogl-uk", "open government licen[cs]e"), ("ofl-1.1", "open font licen[cs]e"), ("ofl-1.1", "sil ofl"),
    ("psf", "python software foundation licen[cs]e"), ("psf", "psf licen[cs]e"), ("postgresql", "postgresql licen[cs]e"), ("ruby", "ruby licen[cs]e"), ("php", "php licen[cs]e"),
    ("openssl", "openssl licen[cs]e"), ("w3c", "w3c (?:software )?(?:notice and )?licen[cs]e"), ("x11", "x11 licen[cs]e"), ("ncsa", "ncsa open source licen[cs]e"),
    ("upl-1.0", "universal permissive licen[cs]e"), ("vim", "vim licen[cs]e"), ("ms-pl", "microsoft public licen[cs]e"), ("ms-rl", "microsoft reciprocal licen[cs]e"),
    ("osl-3.0", "open software licen[cs]e"), ("afl-3.0", "academic free licen[cs]e"), ("sspl", "server side public licen[cs]e"), ("sspl", "sspl"),
    ("busl-1.1", "business source licen[cs]e"), ("elastic-2.0", "elastic licen[cs]e"), ("commons-clause", "commons clause"), ("openrail", "open ?rail(?: m)?(?: licen[cs]e)?"),
    ("cecill", "cecill(?: [bc])?(?: licen[cs]e)?"), ("lppl", "latex project public licen[cs]e"), ("zpl", "zope public licen[cs]e"), ("qpl", "q public licen[cs]e"),
    ("ijg", "independent jpeg group licen[cs]e"), ("ftl", "freetype (?:project )?licen[cs]e"), ("mulan", "mulan permissive software licen[cs]e"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict) licen[cs]e"), ("llama", "llama [0-9](?: [0-9])? community licen[cs]e"), ("gemma", "gemma terms of use"),
)

_TERMS = "(?:the |a |an )?(?:terms (?:and conditions )?of (?:either )?(?:the |a )?)?(?:gnu )?"
#: What may stand before a name, and how sure it makes it; (nothing) comes last.
BEFORE = ((re.compile(f"(?<![^ ])(?:licen[cs]ed|released|(?:re)?distributed|available|provided|published|offered|governed|covered) (?:under|by) {_TERMS}$".encode()), 0.95),
          (re.compile(f"(?<![^ ])(?:subject to|see|under|licen[cs]e) {_TERMS}$".encode()), 0.8), (re.compile(b"$"), 0.6))
#: Longest stretch before a name that is looked at; no declaration is longer.
_REACH = 96


def form(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FORM).split())


@dataclass(frozen=True)
class Rule:
    label: str
    source: str
    regex: re.Pattern
    keyword: bytes
    certainty: float


def plain_runs(regex: str) -> list[str]:
    """The plain parts that every match of ``regex`` holds; it may have groups, classes, counts and ``?``."""
    out, depth, i = [""], 0, 0
    while i < len(regex):
        c = regex[i]
        depth += (c == "(") - (c == ")")
        if c == "[":
            i = regex.index("]", i)
        if c == "{":
            i = regex.index("}", i)
        if c == "?" and not depth:
            out[-1] = out[-1][:-1]
        if depth or c in "()[].{?":
            out.append("")
        else:
            out[-1] += c
        i += 1
    return [x.strip() for x in out]


def _rule(label: str, regex: str, certainty: float) -> Rule:
    head = re.match(r"[^\[\](){}.?|]*(?!\?)", regex)[0]
    head = head[:-1] if regex[len(head):len(head) + 1] in ("?", "{") else head
    # behind its plain head the start of a word is asked for, so that the head itself is sought as plain bytes
    bounded = f"{head}(?<![^ ]{head}){regex[len(head):]}(?![^ ])" if head else f"(?<![^ ])(?:{regex})(?![^ ])"
    keyword = max((x.encode() for x in plain_runs(regex)), key=lambda x: (any(g in x for g in GATES), len(x)))
    return Rule(label, regex, re.compile(bounded.encode()), keyword, certainty)




@lru_cache(maxsize=1)
def identifiers() -> dict[bytes, str]:
    """Words of an identifier -> its label, longest first."""
    names = IDENTIFIERS + [f"{f}-{v}{s}" for f, versions in GNU.items() for v in versions for s in ("", "-only", "-or-later")]
    names += [f"CC-{k}-{v}" for k in CC_KINDS for v in CC_VERSIONS]
    return {form(x): x.lower() for x in sorted(names, key=lambda x: (-len(form(x)), x))}


@lru_cache(maxsize=1)
def zones() -> tuple[tuple[bytes, re.Pattern, re.Pattern, float], ...]:
    """(keyword, whole expression, one identifier, certainty) of the two places of identifiers."""
    out = []
    for tag, keyword, sure, left_out in (("spdx license identifier ", "spdx license identifier", 1.0, frozenset()), ("licen[cs]e(?: is)? ", "licen", 0.8, WORDS)):
        one = b"(?<![^ ])(?:%s)(?![^ ])" % b"|".join(k for k, v in identifiers().items() if v not in left_out)
        step = one + rb"(?: with [a-z0-9]+(?: [a-z0-9]+){0,3}? exception(?: [0-9] [0-9])?(?![^ ]))?"
        out.append((keyword.encode(), re.compile(b"(?<![^ ])" + tag.encode() + step + b"(?: (?:or|and) " + step + b")*"), re.compile(one), sure))
    return tuple(out)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """The regular expressions in order: sentences, then weaker marks, then names."""
    texts = [(label, rx, 0.95) for label, rx in TEXTS] + [(label, rx, 0.4) for label, rx in MARKS]
    out = tuple(_rule(*x) for x in texts) + tuple(_rule(label, rx, 0.0) for label, rx in NAMES)
    missed = [r.source for r in out if not any(g in r.keyword for g in GATES)]
    if missed:
        raise ValueError(f"rules whose keyword holds no gate: {missed}")
    return out


# every keyword holds one of these; a text without any is left after a few scans for bytes
GATES = tuple(x.encode() for x in ("licen", "gpl", "gfdl", "bsd", "cc ", "cc0", "creative", "apache", "asl 2", "mit 0", "mit no", "mit terms", "mpl", "cddl", "eupl", "wtfpl", "unlicense",
                                   "odbl", "sil o", "sspl", "rail", "cecill", "clause", "domain", "as perl", "gemma terms", "permission", "permitted", "redistribut", "copyright", "distributed",
                                   "copying", "warranty", "advertising", "neither the name", "may not be", "not be interpreted", "software", "goal", "gnu ", "accompanying program", "fuck",
                                   "buy me", "supplied as is", "intent of this document", "hosted or managed", "to third parties", "rights", "based restrictions", "llama", "public sector",
                                   "open data", "united states government", "proprietary", "unauthorized", "use only", "trade secret", "derivative", "commercial", "purposes only", "org ",
                                   "©", "for good"))


def _suppressed(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of (start, end, rank, label, certainty) those inside no match of an earlier rank."""
    ends = sorted({b for _, b, *_ in found}, reverse=True)
    place = {b: i + 1 for i, b in enumerate(ends)}
    tree, never, kept = [1 << 60] * (len(ends) + 1), 1 << 60, []
    for a, b, rank, label, sure in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        # all matches that hold this one have come already: the least rank among those that end no earlier
        i, least = place[b], never
        while i:
            least, i = min(least, tree[i]), i & (i - 1)
        if least >= rank:
            kept.append((a, b, label, sure))
        i = place[b]
        while i < len(tree):
            tree[i], i = min(tree[i], rank), i + (i & -i)
    return kept


def matches(words: bytes) -> list[tuple[int, int, str, float]]:
    """(start, end, label, certainty) in bytes of ``words``, without those inside a match of an earlier rule."""
    if not any(g in words for g in GATES):
        return []
    found: list[tuple[int, int, int, str, float]] = []
    for z, (keyword, expression, one, sure) in enumerate(zones()):
        if keyword in words:
            for zone in expression.finditer(words):
                inside = [(m.start(), m.end(), z, identifiers()[m[0]], sure) for m in one.finditer(words, zone.start(), zone.end())]
                found += [(zone.start(), *inside[0][1:]), *inside[1:]]
    first_name, count = 2 + len(TEXTS) + len(MARKS), len(NAMES)
    for i, rule in enumerate(rules(), 2):
        if rule.keyword not in words:
            continue
        for m in rule.regex.finditer(words):
            if i < first_name:
                found.append((m.start(), m.end(), i, rule.label, rule.certainty))
                continue
            for k, (before, sure) in enumerate(BEFORE):
                said = before.search(words, max(0, m.start() - _REACH), m.start())
                if said:
                    found.append((said.start(), m.end(), i + k * count, rule.label, sure))
                    break
    return sorted(_suppressed(found))


def base_places(words: bytes) -> list[tuple[int, str]]:
    """(byte, label) of every place of a base phrase, overlapping ones too."""
    out = []
    for phrase, label in BASE:
        p = phrase.encode()
        at = words.find(p)
        while at >= 0:
            if (at == 0 or words[at - 1] == 32) and (at + len(p) == len(words) or words[at + len(p)] == 32):
                out.append((at, label))
            at = words.find(p, at + 1)
    return sorted(out)


def _word_numbers(words: bytes, places: Iterable[int]) -> dict[int, int]:
    """Byte -> blanks before it, in one walk over the text."""
    out, last, n = {}, 0, 0
    for at in sorted(set(places)):
        n += words.count(b" ", last, at)
        out[at] = n
        last = at
    return out


def scan_text(text: str | None) -> tuple:
    words = form(text)
    n = words.count(b" ") + 1 if words else 0
    base, found = base_places(words), matches(words)
    number = _word_numbers(words, [*(x for a, b, *_ in found for x in (a, b)), *(at for at, _ in base)])
    base_labels = {label for _, label in base}
    labels = base_labels | {label for _, _, label, _ in found}
    score = max([0.6 if base else 0.0, *(sure for _, _, _, sure in found)])
    return (n, len(base), number[base[0][0]] if base else None, number[base[-1][0]] if base else None, ",".join(sorted(base_labels)),
            ",".join(sorted(labels)), score, [(number[a], number[b] + 1, label, sure) for a, b, label, sure in found])


_FOUND = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("certainty", pa.float64())]))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, labels, score and ``found`` (the rules' matches by words) of every row."""
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _FOUND]
    keys = ("first_word", "end_word", "label", "certainty")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan_text(t) for t in b.column(1).to_pylist()]
            rows = [(*r[:-1], [dict(zip(keys, x, strict=True)) for x in r[-1]]) for r in rows]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        scanned, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                 "found array<struct<first_word:long,end_word:long,label:string,certainty:double>>")
