import re

import pytest

from clonalis.llm import licenses as lc

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use the Software.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING MERCHANTABILITY. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
APACHE = """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY. See the GNU General Public License for more details.
# You should have received a copy of the GNU General Public License."""

CASES = [
    ("x y.\nThis work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Some words. Released under the MIT License. More words.", "MIT"),
    ("a\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under the Apache-2.0 licence", "Apache-2.0"),
    ("This file is distributed under the terms of the GNU Lesser General Public License v2.1 or later.", "LGPL-2.1-or-later"),
    ("All our data are available under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("// SPDX-License-Identifier: bsd-3-clause", "bsd-3-clause"),
    (MIT, "MIT"),
    (GPL, "GPL-3.0-or-later"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Copyright (c) 2020 Someone. All rights reserved.", "All-Rights-Reserved"),
    ("Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License!", "CC-BY-NC-4.0,MIT"),
    ("He gave me a licence to drive.", ""),
    ("Licensed under the Frobnitz License.", ""),
    ("", ""),
]


def scan(text):
    matches, unknown = lc.match_rules(lc.sentences(text))
    return ",".join(sorted({m.license for m in matches})), unknown


@pytest.mark.parametrize("text,want", CASES)
def test_known_texts(text, want):
    assert scan(text)[0] == want


def test_long_rules_take_all_their_sentences():
    assert scan(MIT) == ("MIT", 0) and scan(GPL)[0] == "GPL-3.0-or-later"
    assert len(lc.match_rules(lc.sentences(MIT))[0]) == 1
    found = [s.identifier for s in lc.sentences(MIT)]
    assert found == ["MITperm", "MITnotice", "MITasIs", "NoLiability"]
    apart = MIT.replace("\n\nThe above", "\n\n" + "other words, " * 60 + "end.\n\nThe above")
    assert lc.match_rules(lc.sentences(apart))[1] > 0


def test_apache_header():
    found = [s.identifier for s in lc.sentences(APACHE)]
    assert "ApacheComply" in found and "ApacheUnless" in found and "ApacheSee" in found


def test_identifiers_do_not_depend_on_case_breaks_or_leaders():
    for text, _ in CASES[:8]:
        for other in (text.upper(), text.replace(" ", "\n * "), text.replace("icence", "icense")):
            if "SPDX" not in text and "\n" not in text:
                assert scan(other)[0] == scan(text)[0], other


def test_triggers_cover_the_patterns():
    for name, pattern in lc.SENTENCES:
        plain = re.sub(r"\(\?:.*?\)\??|\.\*|\\d\{4\}|[\^$?]", " ", pattern)
        assert lc.TRIGGER.search(plain), name


def brute(text):
    """Without the trigger's shortcuts: every sentence is cut out, then those with a trigger are kept."""
    parts, at = [], 0
    for m in re.finditer(r"[.!?;](?=[\s\"')*/#]|$)|\n[ \t*/#;%>-]*\n|\Z", text):
        parts.append(text[at : m.end()])
        at = m.end()
    return [lc.identify_lines(p) for p in parts if lc.TRIGGER.search(p)]


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = lc.scan_licenses(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [s.identifier for s in lc.sentences(texts[r.doc_id])] == brute(texts[r.doc_id])
        line = re.search(r"(?:licensed|released) under|rights reserved", texts[r.doc_id], re.I)
        assert bool(r.licenses) == bool(line), texts[r.doc_id][-200:]
    assert {n for r in rows for n in r.licenses.split(",") if n} == {"MIT", "GPL-3.0-only", "CC-BY-NC-4.0", "Apache-2.0", "All-Rights-Reserved"}


def test_edge_cases(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, MIT, 0), (4, "license " * 100000, 0), (5, "copyright\n\n" * 20000, 0)], "doc_id long, text string, matches int")
    rows = {(r.doc_id or 0): r for r in lc.scan_licenses(d).collect()}
    assert rows[0].licenses == "MIT" and MIT[rows[0].matches[0].start : rows[0].matches[0].end] == MIT
    assert (rows[4].n_sentences, rows[4].n_unmatched) == (1, 1) and rows[5].n_sentences == 20000 and rows[1].n_sentences == 0
    assert lc.scan_licenses(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [100, 5_000, 50_000, 500_000])
@pytest.mark.parametrize("lead", ["word ", "word\n", "word, word - word\n * "])
def test_licence_line_after_text_without_a_stop(n, lead):
    before = (lead * (n // len(lead) + 1)).rstrip()
    assert scan(before + "\nReleased under the MIT License.")[0] == "MIT"
    assert scan(before + "\nLicensed under the Apache License,\nVersion 2.0")[0] == "Apache-2.0"


@pytest.mark.parametrize("text,want", [
    ("Licensed under the MIT License\nThe next paragraph goes on here.", "MIT"),
    ("A heading\n# Licensed under the Apache License,\n# Version 2.0\n# and some more words\n", "Apache-2.0"),
    ("# SPDX-License-Identifier: MIT\n# Copyright 2020 Foo.", "mit"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT\n\nint x;", "apache-2.0 or mit"),
    ("SPDX-License-Identifier: MIT\nReleased under the ISC License\nmore", "ISC,mit"),
    ("Copyright (c) 2020 Foo\n" + MIT, "MIT"),
    ("Heading\n" + GPL.replace("# ", "").replace("#\n", "").replace(" ", "\n") + "\nmore words", "GPL-3.0-or-later"),
    ("Licensed under the MIT License\n" + "word\n" * 50_000, "MIT"),
    ("word\n" * 30 + "copyright 2020 by Foo,\nall rights reserved\nmore", "All-Rights-Reserved"),
    ("word licensed under the MIT License word\nmore", ""),
])
def test_licence_lines_within_a_sentence(text, want):
    assert scan(text)[0] == want


def test_places_of_licence_lines():
    text = "A heading\n * Licensed under the MIT License\nThe next paragraph."
    match, = lc.match_rules(lc.sentences(text))[0]
    assert text[match.start : match.end] == "* Licensed under the MIT License"


def test_sentences_of_a_rule_may_stand_apart():
    near, far = (lc.match_rules(lc.sentences(MIT.replace("\n\n", gap)))[0] for gap in ("\n\n", "\n\n" + " " * 5000 + "\n * \n" * 300 + "Nothing of note is said here.\n\n"))
    assert [m.license for m in near] == [m.license for m in far] == ["MIT"]
