"""License rules: independent notices, every rule on strings drawn from it, suppression against brute force, work on long texts."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from contrasta.llm import licenses

# Beginnings and notices as projects publish them, and the labels they must carry.
NOTICES = [
    ("MIT License\n\nCopyright (c) 2019 Jane Roe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:", "bsd"),
    ("* Neither the name of Example Org nor the names of its\n  contributors may be used to endorse or promote products", "bsd-3-clause"),
    ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', "apache-2.0"),
    ("You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    ("This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\n"
     "of the License, or (at your option) any later version.", "gpl-2.0-or-later"),
    ("it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", None),
    ("modify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "lgpl-2.1-or-later"),
    ("under the terms of the GNU Affero General Public License version 3 only", "agpl-3.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this", "mpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", "isc"),
    ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable", "zlib"),
    ("Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)", "bsl-1.0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("are made available under the\nterms of the Eclipse Public License 2.0 which is available at", "epl-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("This work is licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd-4.0"),
    ("To the extent possible under law, Jane Roe has waived all copyright and related or neighboring rights to this work", "cc0"),
    ("# SPDX-License-Identifier: MIT", "mit"), ("// SPDX-License-Identifier: ISC", "isc"), ("<!-- SPDX-License-Identifier: EPL-2.0 -->", "epl-2.0"),
    ("/* SPDX-License-Identifier: Zlib */", "zlib"), ("SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "gpl-2.0-only"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1-or-later"),
    ('{"name": "left", "license": "MIT"}', "mit"), ('license = "BSD-3-Clause"', "bsd-3-clause"), ("License: GPL-3.0-or-later", "gpl-3.0-or-later"), ("under the gpl license", "gpl"),
    ("GNU General Public License version 2 or later", "gpl-2.0-or-later"), ("released under GPLv2 or later", "gpl-2.0-or-later"), ("a GPLv3 program", "gpl-3.0"),
    ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed", "wtfpl"),
    ("The Software shall be used for Good, not Evil.", "json"), ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", "ofl-1.1"),
    ("This program is free software; you may use it under the same terms as Perl itself", "perl"),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd"),
    ("Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential", "proprietary"),
]


@pytest.mark.parametrize(("text", "label"), [x for x in NOTICES if x[1]])
def test_notices(text, label):
    for around in (text, f"lorem ipsum {text} dolor", text.upper()):
        assert label in licenses.scan_text(around)[5].split(","), (around, licenses.scan_text(around))


@pytest.mark.parametrize("text", ["the license fair to all", "permitted to enter", "a domain of software", "he did not commit", "zlibrary", "xgpl", "gplx", "the unlicensed", "vim and ruby"])
def test_plain_prose_has_no_label(text):
    assert licenses.scan_text(text)[5:] == ("", 0.0, [])


def test_identifiers():
    for words, label in licenses.identifiers().items():
        text = f"// SPDX-License-Identifier: {label}\nfoo"
        assert (licenses.form(label), label) == (words, label.lower())
        assert label in licenses.scan_text(text)[5].split(",") and licenses.scan_text(text)[6] == 1.0
        assert (label in licenses.scan_text(f'license: "{label}"')[5].split(",")) or label in licenses.WORDS
    found = licenses.scan_text("SPDX-License-Identifier: (MIT OR Apache-2.0 WITH LLVM-exception) AND 0BSD or else")[-1]
    assert [x[2] for x in found] == ["mit", "apache-2.0", "0bsd"]
    assert "gpl-2.0" not in licenses.scan_text("SPDX-License-Identifier: GPL-2.0-or-later")[5].split(",")


def test_scores_follow_the_surest_detection():
    score = [licenses.scan_text(x)[6] for x in ("GPLv2", "under the GPLv2", "released under the GPLv2", "SPDX-License-Identifier: GPL-2.0")]
    assert score == sorted(set(score)) == [0.6, 0.8, 0.95, 1.0]


def test_rules_are_many_and_gated():
    rules = licenses.rules()
    assert len(rules) >= 300 and len({r.source for r in rules}) >= 300
    for r in rules:
        assert r.keyword and any(g in r.keyword for g in licenses.GATES)


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sampled_from(licenses.rules()).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r.source.replace(".{", "[a-z ]{"), fullmatch=True))))
def test_every_rule_on_strings_drawn_from_it(drawn):
    """Gate and keyword lose no match, and the match is found or lies inside an earlier rule's."""
    rule, text = drawn
    words = licenses.form(f"zz {text} zz")
    if re.fullmatch(rule.source.encode(), licenses.form(text)) is None:
        return  # blanks of the drawn string fell together
    assert rule.keyword in words and any(g in words for g in licenses.GATES)
    assert rule.regex.search(words)
    assert any(a <= 3 and b >= len(words) - 3 for a, b, _, _ in licenses.matches(words)) or ".{" in rule.source


def brute(words: bytes) -> list:
    """Every rule on every text, each match against all kept ones."""
    found = []
    for z, (_, expression, one, sure) in enumerate(licenses.zones()):
        for zone in expression.finditer(words):
            for n, m in enumerate(one.finditer(words, zone.start(), zone.end())):
                found.append((z, m.start() if n else zone.start(), m.end(), licenses.identifiers()[m[0]], sure))
    names = len(licenses.rules()) - len(licenses.NAMES)
    for i, r in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<![^ ])(?:{r.source})(?![^ ])".encode(), words):
            said = [(k, x.search(words[:m.start()]), sure) for k, (x, sure) in enumerate(licenses.BEFORE)] if i >= names else [(0, m, r.certainty)]
            k, start, sure = next(x for x in said if x[1])
            found.append((2 + i + k * len(licenses.NAMES), start.start(), m.end(), r.label, sure))
    kept = []
    for _, a, b, label, sure in sorted(found):
        if not any(c <= a and b <= d for c, d, _, _ in kept):
            kept.append((a, b, label, sure))
    return sorted(kept)


def test_matches_against_brute_force():
    rng = random.Random(3)
    pieces = [t for t, _ in NOTICES] + ["gpl", "license", "mit", "or", "and", "version", "2", "apache", "the", "cc by", "general public license", "under the", "licensed under", "©", "lorem ipsum"]
    for _ in range(300):
        words = licenses.form(" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))))
        assert licenses.matches(words) == brute(words)


def test_many_matches_take_linear_time():
    took = []
    for times in (4_000, 32_000):
        start = time.process_time()
        row = licenses.scan_text("gpl 2 ok apache license cc by " * times)
        took.append(time.process_time() - start)
        assert row[1] == times and row[3] == 7 * times - 2 and len(row[-1]) == 2 * times
    assert took[1] < 8 * took[0] * 3
