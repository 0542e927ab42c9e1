"""License scans by sentence rules: sentences that contain a word of licenses are normalised and mapped
to known sentence identifiers, and the sequence of identifiers is matched against ordered rules."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

#: Each known sentence has one of these; only sentences that do are looked at.
TRIGGER = re.compile(r"licen[cs]|copyright|redistribut|warrant|spdx|public domain|rights reserved|permission|as is\b|\bas-is|liable|unencumbered|cc[ -]by|creative commons|\bfsf\b", re.I)
_END = re.compile(r"[.!?;](?=[\s\"')*/#]|$)|\n[ \t*/#;%>-]*\n|\Z")
_START = re.compile(r"[.!?;](?=[\s\"')*/#])|\n[ \t*/#;%>-]*\n")
#: Most other words between two sentences of one rule; white space and marks don't count.
WORDS_BETWEEN = 50
_WORD = re.compile(r"[^\W_]+")
_LEADER = re.compile(r"(?m)^[ \t]*(?:[*/#;%>|-]+[ \t]*)+")


def normalise(sentence: str) -> str:
    """Lower case, comment leaders and quotes dropped, one space between words, version numbers kept."""
    return " ".join(line for line in normal_lines(sentence) if line)


def normal_lines(sentence: str) -> list[str]:
    """Each line of a sentence, normalised."""
    text = _LEADER.sub(" ", sentence).lower().replace("licence", "license")
    text = re.sub(r"[^a-z0-9.+ \n-]+", " ", text)
    text = re.sub(r"\.(?!\d)|(?<![a-z0-9])[-.+]+(?![a-z0-9])", " ", text)
    return [" ".join(line.split()) for line in text.split("\n")]


_VERSION = r"(?: ?(?:version|ver|v))? ?(?P<version>\d(?:\.\d)?)"
_LATER = r"(?P<later>(?: (?:of the license))? (?:or(?: at your option)?(?: any)? later(?: version)?)|\+)?"
#: Names of licenses as normalised; those with a version say so by the group.
NAMES = [
    ("AGPL", r"(?:gnu )?(?:affero general public license|agpl)(?: agpl)?" + f"(?:{_VERSION}{_LATER})?"),
    ("LGPL", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)(?: lgpl)?" + f"(?:{_VERSION}{_LATER})?"),
    ("GPL", r"(?:gnu )?(?:general public license|gpl)(?: gpl)?" + f"(?:{_VERSION}{_LATER})?"),
    ("Apache", r"(?:apache(?: software)?(?: license)?)" + f"(?: ?-?{_VERSION})?(?: license)?"),
    ("MPL", r"(?:mozilla public license|mpl)" + f"(?: ?-?{_VERSION})?"),
    ("EPL", r"(?:eclipse public license|epl)" + f"(?: ?-?{_VERSION})?"),
    ("CC", r"(?:creative commons|cc)[ -](?P<parts>(?:by|attribution)(?:[ -](?:nc|nd|sa|noncommercial|non-commercial|noderivatives|noderivs|sharealike|share-alike))*)(?: (?:international|unported))?" + f"(?: ?-?{_VERSION})?(?: (?:international|unported))?(?: license)?"),
    ("CC0", r"(?:(?:creative commons )?cc0|creative commons zero)" + f"(?: ?-?{_VERSION})?(?: universal)?(?: public domain dedication)?(?: license)?"),
    ("BSD-3-Clause", r"(?:(?:new|modified|revised) bsd|bsd[ -]3-clause|3-clause bsd|three-clause bsd)(?: license)?"),
    ("BSD-2-Clause", r"(?:simplified bsd|freebsd|bsd[ -]2-clause|2-clause bsd|two-clause bsd)(?: license)?"),
    ("BSD", r"bsd(?:-style)?(?: license)?"),
    ("MIT", r"(?:mit|expat)(?: x11)?(?:-style)?(?: license)?"),
    ("ISC", r"isc(?: license)?"),
    ("Zlib", r"zlib(?: libpng)?(?: license)?"),
    ("BSL", r"boost software license" + f"(?: ?-?{_VERSION})?"),
    ("Unlicense", r"(?:the )?unlicense"),
]
_FULL = {"Apache": ".0", "GPL": ".0", "LGPL": ".0", "AGPL": ".0", "MPL": ".0", "EPL": ".0", "CC": ".0", "CC0": ".0", "BSL": ".0"}
_PARTS = {"attribution": "BY", "noncommercial": "NC", "non-commercial": "NC", "noderivatives": "ND", "noderivs": "ND", "sharealike": "SA", "share-alike": "SA"}
_WHAT = r"(?:(?:this|the|our|all|these)? ?(?:[a-z-]+ ){0,3}?(?:is|are|was|were)(?: hereby)?(?: free software)? )?"
_GRANT = (
    r"^" + _WHAT + r"(?:dual-)?(?:licensed|released|distributed|available|made available|published|provided|covered|redistributable|shared|offered)(?: to you| freely)? "
    r"(?:under|by|subject to|according to|in accordance with) (?:the |a |an )?(?:(?:terms|conditions|provisions)(?: and conditions)? of )?(?:the |a |an )?(?P<name>{})(?: terms)?$"
)
_FREE = (
    r"^(?:this|the) (?:[a-z-]+ ){1,3}is free software (?:you can|you may) redistribute it and or modify it under the terms of the (?P<name>gnu (?:affero |lesser |library )?general public license) "
    r"as published by the free software foundation(?: either)? version (?P<version>\d(?:\.\d)?) of the license(?P<later> or at your option any later version)?$"
)
#: Fixed sentences: identifier and pattern over the normalised sentence.
SENTENCES = [
    ("MITperm", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .* to deal in the software without restriction .*"),
    ("MITnotice", r"the above copyright notice and this permission notice .*shall be included in all copies or substantial portions of the software"),
    ("MITasIs", r"the software is provided as is without warranty of any kind express or implied .*"),
    ("NoLiability", r"in no event shall the authors or copyright holders be liable for any claim .*"),
    ("BSDperm", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BSDsource", r"(?:\d )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer.*"),
    ("BSDbinary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("BSDnoEndorse", r"(?:\d )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDasIs", r"this software is provided by .* as is and any express or implied warranties .* are disclaimed"),
    ("BSDnoEvent", r"in no event shall .* be liable for any direct indirect incidental special exemplary or consequential damages .*"),
    ("ISCperm", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice .* appear in all copies"),
    ("ISCasIs", r"the software is provided as is and .* disclaims all warranties .*"),
    ("GPLwarranty", r"this (?:[a-z-]+ ){1,3}is distributed in the hope that it will be useful but without any warranty.*"),
    ("GPLcopy", r"you should have received a copy of the gnu .*public license.*"),
    ("GPLsee", r"see the gnu .*public license for more details"),
    ("ApacheComply", r"you may not use this file except in compliance with the license"),
    ("ApacheObtain", r"you may obtain a copy of the license at.*"),
    ("ApacheUnless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties .*"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("UnlicensePD", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(?:this|the) (?:[a-z-]+ ){1,3}(?:is|has been)(?: placed| released| dedicated)? (?:in|into|to) the public domain"),
    ("AllRights", r"copyright .* all rights reserved"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"(?:portions )?copyright .*\b\d{4}.*"),
]
#: Ordered: the first rule whose identifiers follow each other from a sentence on wins. "x:*" gives its own license.
RULES = [
    ("MIT", ["MITperm", "MITnotice", "MITasIs", "NoLiability"]),
    ("MIT", ["MITperm", "MITnotice", "MITasIs"]),
    ("BSD-3-Clause", ["BSDperm", "BSDsource", "BSDbinary", "BSDnoEndorse", "BSDasIs", "BSDnoEvent"]),
    ("BSD-3-Clause", ["BSDperm", "BSDsource", "BSDbinary", "BSDnoEndorse"]),
    ("BSD-2-Clause", ["BSDperm", "BSDsource", "BSDbinary", "BSDasIs", "BSDnoEvent"]),
    ("BSD-2-Clause", ["BSDperm", "BSDsource", "BSDbinary"]),
    ("ISC", ["ISCperm", "ISCasIs"]),
    ("ISC", ["ISCperm"]),
    ("*", ["Grant:*", "ApacheComply", "ApacheObtain", "ApacheUnless", "ApacheSee"]),
    ("*", ["Grant:*", "ApacheComply", "ApacheObtain"]),
    ("*", ["Free:*", "GPLwarranty", "GPLsee", "GPLcopy"]),
    ("*", ["Free:*", "GPLwarranty", "GPLcopy"]),
    ("*", ["Free:*"]),
    ("*", ["Spdx:*"]),
    ("*", ["Grant:*"]),
    ("Unlicense", ["UnlicensePD"]),
    ("Public-Domain", ["PublicDomain"]),
    ("All-Rights-Reserved", ["AllRights"]),
]


def _over_lines(pattern: str) -> list[re.Pattern]:
    """The parts of a pattern between its .*, each to be searched after the one before; spaces are line breaks too,
    the first part starts a line, and the last one ends a line."""
    parts = f"(?m)^{pattern.strip('^$')}$".replace(" ", r"[ \n]").replace(r"[[ \n]-]", r"[ \n-]").split(".*")
    return [re.compile(p if p.startswith("(?m)") else "(?m)" + (".*$" if p == "$" else p)) for p in parts]


_GRANTS = [(family, _over_lines(_GRANT.replace("{}", pattern))) for family, pattern in NAMES]
_GRANTED = re.compile(r"(?:licensed|released|distributed|available|published|provided|covered|redistributable|shared|offered)(?:[ \n]to[ \n]you|[ \n]freely)?[ \n](?:under|by|subject|according|in)[ \n]")
_FREE_RE, _SPDX = _over_lines(_FREE), [re.compile(r"(?m)spdx-license-identifier[ \n](?P<name>[a-z0-9.+ -]+)$")]
_FIXED = [(name, _over_lines(pattern)) for name, pattern in SENTENCES]


def _license(family: str, found: re.Match) -> str:
    own = found.groupdict()
    name, version = family, own.get("version")
    if family == "CC":
        parts = [_PARTS.get(p, p.upper()) for p in re.findall(r"non-commercial|share-alike|[a-z]+", own["parts"])]
        name = "CC-" + "-".join(parts)
    if version:
        name += "-" + (version if "." in version else version + _FULL.get(family, ""))
        if family in ("GPL", "LGPL", "AGPL"):
            name += "-or-later" if own.get("later") else "-only"
    return name


def _found(parts: list[re.Pattern], text: str) -> Iterator[tuple[int, int, re.Match]]:
    """Where the parts follow each other. If some part is not found after the first place of those before it, it is
    not found after any later one, so the search ends."""
    at = 0
    while first := parts[0].search(text, at):
        last = first
        for part in parts[1:]:
            if not (last := part.search(text, last.end())):
                return
        yield first.start(), last.end(), first
        at = max(last.end(), first.end(), at + 1)


def identify(text: str) -> list[tuple[str, int, int]]:
    """Identifiers of the runs of lines of a text of normalised lines, with their places in it, in order: a fixed one,
    or Grant:, Free: or Spdx: with a license. Runs don't overlap; what is tried first wins."""
    out: list[tuple[int, int, str]] = []

    def add(name: str, start: int, end: int) -> None:
        k = bisect_right(out, (start, end))
        if (k == 0 or out[k - 1][1] <= start) and (k == len(out) or end <= out[k][0]):
            out.insert(k, (start, end, name))

    if "spdx" in text:
        for a, b, found in _found(_SPDX, text):
            add(f"Spdx:{found['name'].strip()}", a, b)
    if "free software foundation" in text.replace("\n", " "):
        for a, b, found in _found(_FREE_RE, text):
            words = found["name"]
            add("Free:" + _license("AGPL" if "affero" in words else "GPL" if "lesser" not in words and "library" not in words else "LGPL", found), a, b)
    if _GRANTED.search(text):
        for family, parts in _GRANTS:
            for a, b, found in _found(parts, text):
                add("Grant:" + _license(family, found), a, b)
    for name, parts in _FIXED:
        if name != "Copyright" or not out:
            for a, b, _ in _found(parts, text):
                add(name, a, b)
                if name == "Copyright":
                    break
    return [(name, a, b) for a, b, name in out]


def known_lines(sentence: str) -> list[tuple[str, int, int]]:
    """Identifiers of the runs of lines of a sentence that are known, with their character ranges: a heading or text
    without a stop may stand before, between and after them."""
    lines = normal_lines(sentence)
    known = identify("\n".join(line for line in lines if line))
    if not known:
        return []
    starts, places, at, place = [], [], 0, 0  # of the lines that have words, as normalised and as they stand
    for raw, line in zip(sentence.split("\n"), lines, strict=True):
        if line:
            starts.append(at)
            places.append((place + len(raw) - len(raw.lstrip()), place + len(raw)))
            at += len(line) + 1
        place += len(raw) + 1
    out = []
    for name, a, b in known:
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        out.append((name, places[first][0], len(sentence) if last == len(starts) - 1 else places[last][1]))
    return out


def identify_lines(sentence: str) -> str | None:
    """Identifier of the first known run of lines of a sentence."""
    return next((name for name, _, _ in known_lines(sentence)), None)


class Sentence(NamedTuple):
    identifier: str | None
    start: int
    end: int
    between: int = 0  # words after the sentence before


def sentences(text: str) -> list[Sentence]:
    """The sentences of a text that have a word of TRIGGER, in order, with their places; if runs of lines of one are
    known, each of these instead."""
    out, done = [], 0
    at = TRIGGER.search(text)
    while at:
        start = done
        for mark in _START.finditer(text, done, at.start()):
            start = mark.end()
        end = _END.search(text, at.end()).end()
        own = text[start:end]
        out += [Sentence(name, start + a, start + b) for name, a, b in known_lines(own)] or [Sentence(None, start + len(own) - len(own.lstrip()), end)]
        done = max(end, at.end())
        at = TRIGGER.search(text, done)
    return [s._replace(between=len(_WORD.findall(text, before.end, s.start))) for before, s in zip([Sentence(None, 0, 0), *out], out, strict=False)]


class Match(NamedTuple):
    license: str
    start: int
    end: int


def match_rules(found: list[Sentence]) -> tuple[list[Match], int]:
    """Licenses in the order of the text, and how many sentences belong to none. A rule is met by identifiers that
    follow each other with at most WORDS_BETWEEN other words between two, however much white space."""
    matches, at, unknown = [], 0, 0
    while at < len(found):
        for name, rule in RULES:
            part = found[at : at + len(rule)]
            if len(part) == len(rule) and all(_fits(s.identifier, r) for s, r in zip(part, rule, strict=True)) and all(s.between <= WORDS_BETWEEN for s in part[1:]):
                matches.append(Match(part[0].identifier.partition(":")[2] if name == "*" else name, part[0].start, part[-1].end))
                at += len(rule)
                break
        else:
            unknown += 1
            at += 1
    return matches, unknown


def _fits(identifier: str | None, wanted: str) -> bool:
    return identifier is not None and (identifier == wanted or wanted.endswith(":*") and identifier.startswith(wanted[:-1]))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, licenses (distinct, in code point order, comma-joined; empty if none), n_licenses
    (matches), n_sentences (with a license word), n_unmatched (of those, in no rule), matches
    (license, and its character range).

    Sentences end at . ! ? ; before white space, or at an empty line; line breaks in them are spaces.
    Known lines of a sentence count as sentences of their own; an SPDX expression ends with its line.
    Null and empty texts have none; repeated rows each get a row; an empty table gives none; other
    columns are ignored.
    """
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                found = sentences(batch.column("text")[i].as_py() or "")
                matches, unknown = match_rules(found)
                for c, v in zip(columns, (",".join(sorted({m.license for m in matches})), len(matches), len(found), unknown, [m._asdict() for m in matches]), strict=True):
                    c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), place]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "licenses", "n_licenses", "n_sentences", "n_unmatched", "matches"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"doc_id {kind}, licenses string, n_licenses bigint, n_sentences bigint, n_unmatched bigint, matches array<struct<license:string,start:bigint,end:bigint>>")
