"""License scans by ordered signature rules.

Rules are regexes over the words of a text, each behind a keyword: a text without a keyword never meets the
rule. Detections are resolved by priority: one that lies within an interval of a detection of higher priority
is suppressed. A few base phrases are always reported."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

#: Base phrases, as words, and their labels: fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Names that mean other things as well: they count with a version or a grant alone.
AMBIGUOUS = {"epl"}

_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

# Families: label, names as regexes over words, versions as (suffix of the label, regex) if there are any, SPDX identifiers.
# Words are lower case, split at every ASCII sign: "GPL-3.0" reads "gpl 3 0".
FAMILIES: list[tuple[str, list[str], list[tuple[str, str]], list[str]]] = [
    ("gpl", [r"gnu general public licen[cs]e", r"gnu gpl", r"gplv?"], [("-1.0", r"1(?: 0)?"), ("-2.0", r"2(?: 0)?"), ("-3.0", r"3(?: 0)?")], [r"gpl \d 0(?: only| or later)?"]),
    ("lgpl", [r"gnu (?:lesser|library) general public licen[cs]e", r"gnu lgpl", r"lgplv?"], [("-2.0", r"2(?: 0)?"), ("-2.1", r"2 1"), ("-3.0", r"3(?: 0)?")], [r"lgpl \d \d(?: only| or later)?"]),
    ("agpl", [r"(?:gnu )?affero general public licen[cs]e", r"gnu agpl", r"agplv?"], [("-1.0", r"1(?: 0)?"), ("-3.0", r"3(?: 0)?")], [r"agpl \d 0(?: only| or later)?"]),
    ("gfdl", [r"gnu free documentation licen[cs]e", r"gnu fdl", r"gfdl"], [("-1.1", r"1 1"), ("-1.2", r"1 2"), ("-1.3", r"1 3")], [r"gfdl 1 \d"]),
    ("apache", [r"apache(?: software)? licen[cs]e", r"apache public licen[cs]e"], [("-1.0", r"1 0"), ("-1.1", r"1 1"), ("-2.0", r"2(?: 0)?")], [r"apache \d \d"]),
    ("mit", [r"mit(?: x11)? licen[cs]e", r"x11 licen[cs]e", r"expat licen[cs]e"], [], [r"mit", r"mit 0"]),
    ("bsd", [r"(?:new |simplified |modified |original )?bsd licen[cs]e", r"berkeley software distribution licen[cs]e"], [], [r"bsd \d clause(?: clear| patent)?"]),
    ("bsd-2-clause", [r"(?:bsd )?(?:2|two) clause bsd licen[cs]e", r"freebsd licen[cs]e"], [], [r"bsd 2 clause"]),
    ("bsd-3-clause", [r"(?:bsd )?(?:3|three) clause bsd licen[cs]e", r"new bsd licen[cs]e"], [], [r"bsd 3 clause"]),
    ("isc", [r"isc licen[cs]e", r"internet systems consortium licen[cs]e"], [], [r"isc"]),
    ("mpl", [r"mozilla public licen[cs]e", r"mplv?"], [("-1.0", r"1 0"), ("-1.1", r"1 1"), ("-2.0", r"2(?: 0)?")], [r"mpl \d \d"]),
    ("epl", [r"eclipse public licen[cs]e", r"epl"], [("-1.0", r"1 0"), ("-2.0", r"2(?: 0)?")], [r"epl \d 0"]),
    ("cddl", [r"common development and distribution licen[cs]e", r"cddl"], [("-1.0", r"1 0"), ("-1.1", r"1 1")], [r"cddl 1 \d"]),
    ("cpl", [r"common public licen[cs]e"], [("-1.0", r"1 0")], [r"cpl 1 0"]),
    ("eupl", [r"european union public licen[cs]e", r"eupl"], [("-1.1", r"1 1"), ("-1.2", r"1 2")], [r"eupl 1 \d"]),
    ("artistic", [r"(?:perl )?artistic licen[cs]e"], [("-1.0", r"1 0"), ("-2.0", r"2(?: 0)?")], [r"artistic \d 0"]),
    ("boost", [r"boost software licen[cs]e"], [("-1.0", r"1 0")], [r"bsl 1 0"]),
    ("zlib", [r"zlib(?: libpng)? licen[cs]e"], [], [r"zlib"]),
    ("unlicense", [r"the unlicen[cs]e", r"unlicen[cs]e"], [], [r"unlicense"]),
    ("wtfpl", [r"do what the fuck you want to public licen[cs]e", r"wtfpl"], [("-2.0", r"2(?: 0)?")], [r"wtfpl"]),
    ("cc0", [r"cc0", r"creative commons zero", r"cc zero"], [("-1.0", r"1 0")], [r"cc0 1 0"]),
    ("cc-by", [r"cc by", r"creative commons attribution(?: licen[cs]e)?"], [("-2.0", r"2 0"), ("-2.5", r"2 5"), ("-3.0", r"3 0"), ("-4.0", r"4 0")], [r"cc by \d \d"]),
    ("cc-by-sa", [r"cc by sa", r"creative commons attribution share ?alike"], [("-2.0", r"2 0"), ("-2.5", r"2 5"), ("-3.0", r"3 0"), ("-4.0", r"4 0")], [r"cc by sa \d \d"]),
    ("cc-by-nc", [r"cc by nc", r"creative commons attribution non ?commercial"], [("-2.0", r"2 0"), ("-2.5", r"2 5"), ("-3.0", r"3 0"), ("-4.0", r"4 0")], [r"cc by nc \d \d"]),
    ("cc-by-nd", [r"cc by nd", r"creative commons attribution no ?deriv(?:ative)?s?"], [("-3.0", r"3 0"), ("-4.0", r"4 0")], [r"cc by nd \d \d"]),
    ("cc-by-nc-sa", [r"cc by nc sa", r"creative commons attribution non ?commercial share ?alike"], [("-2.0", r"2 0"), ("-3.0", r"3 0"), ("-4.0", r"4 0")], [r"cc by nc sa \d \d"]),
    ("cc-by-nc-nd", [r"cc by nc nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"], [("-3.0", r"3 0"), ("-4.0", r"4 0")], [r"cc by nc nd \d \d"]),
    ("python", [r"python software foundation licen[cs]e", r"psf licen[cs]e"], [("-2.0", r"2(?: 0)?")], [r"psf 2 0", r"python 2 0"]),
    ("php", [r"php licen[cs]e"], [("-3.0", r"3 0"), ("-3.01", r"3 01")], [r"php 3 01?"]),
    ("postgresql", [r"postgresql licen[cs]e"], [], [r"postgresql"]),
    ("openssl", [r"openssl licen[cs]e"], [], [r"openssl"]),
    ("ofl", [r"(?:sil )?open font licen[cs]e"], [("-1.0", r"1 0"), ("-1.1", r"1 1")], [r"ofl 1 \d"]),
    ("odbl", [r"open data(?:base| commons open database) licen[cs]e", r"odbl"], [("-1.0", r"1 0")], [r"odbl 1 0"]),
    ("msl", [r"microsoft (?:public|reciprocal) licen[cs]e", r"ms pl", r"ms rl"], [], [r"ms (?:pl|rl)"]),
    ("bsl", [r"business source licen[cs]e"], [("-1.1", r"1 1")], [r"busl 1 1"]),
    ("sspl", [r"server side public licen[cs]e"], [("-1.0", r"1(?: 0)?")], [r"sspl 1 0"]),
    ("elastic", [r"elastic licen[cs]e"], [("-2.0", r"2(?: 0)?")], [r"elastic 2 0"]),
    ("openrail", [r"(?:creativeml |bigcode )?open rail(?: m)?(?: licen[cs]e)?", r"openrail(?: m)?"], [], [r"openrail"]),
    ("public-domain", [r"released into the public domain", r"dedicated to the public domain", r"placed in the public domain"], [], []),
    ("proprietary", [r"all rights reserved", r"proprietary and confidential", r"unauthori[sz]ed copying(?: \w{1,24}){0,12}? strictly prohibited"], [], []),
]

_GRANT = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|redistribute it) (?:\w{1,24} ){0,3}?(?:under|by|of)(?: the)?(?: terms)?(?: of)?(?: the)?"

# Bodies, headers and notices of licenses as their texts have them: (label, confidence, regex).
# A few words may stand between parts that a holder's name or a list mark separates.
_ANY = r"(?: \w{1,24}){0,8}? "
BODIES: list[tuple[str, float, str]] = [
    ("mit", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software and associated documentation files|work)"),
    ("mit", 0.9, r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", 0.9, r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit-0", 0.7, r"permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", 0.95, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("isc", 0.9, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 0.8, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.8, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 0.95, rf"(?:neither the name|the name){_ANY}(?:may|nor){_ANY}be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 0.95, r"all advertising materials mentioning features or use of this software must display the following ack?nowledge?ment"),
    ("apache-2.0", 1.0, r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 0.95, r"(?:https? )?www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2.0", 0.9, r"intentionally submitted to licensor for inclusion in the work by the copyright owner"),
    ("apache-2.0", 0.9, r"distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", 0.9, r"perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-1.1", 0.95, r"this product includes software developed by the apache software foundation"),
    ("gpl", 0.95, r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-2.0", 1.0, r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", 1.0, r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", 1.0, r"gnu general public license as published by the free software foundation(?: under)? version 2(?: of the license)?"),
    ("gpl", 0.9, r"you should have received a copy of the gnu general public license along with this (?:program|file|package|library)"),
    ("gpl-3.0", 0.9, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", 0.9, r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", 0.9, r"the licenses for most software and other practical works are designed to take away your freedom to share and change the works"),
    ("gpl", 0.8, r"(?:https? )?www gnu org licenses gpl(?: html| txt)?"),
    ("lgpl", 0.95, r"redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("lgpl", 0.95, r"redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("lgpl-2.1", 1.0, r"gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", 1.0, r"gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", 0.9, r"you should have received a copy of the gnu lesser general public license along with this (?:program|file|package|library)"),
    ("agpl-3.0", 1.0, r"redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl", 0.9, r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", 0.95, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 0.8, r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", 1.0, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 0.95, r"if a copy of the mpl was not distributed with this file you can obtain one at(?: https?)? mozilla org mpl 2 0"),
    ("mpl-1.1", 1.0, r"the contents of this file are subject to the mozilla public license version 1 1 the license"),
    ("npl-1.1", 0.95, r"the contents of this file are subject to the netscape public license version 1 1"),
    ("epl-1.0", 1.0, r"made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 1.0, r"made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl", 0.8, r"(?:https? )?www eclipse org legal epl(?: v\d\d| 2 0)?"),
    ("cddl", 0.95, r"subject to the terms of the common development and distribution license"),
    ("eupl", 0.95, r"licensed under the eupl version 1 [12]"),
    ("eupl", 0.95, r"licensed under the eupl(?: version)?(?: v)?(?: 1 [12])?"),
    ("artistic", 0.9, r"redistribute it and or modify it under the same terms as perl itself"),
    ("artistic-2.0", 0.9, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms"),
    ("boost-1.0", 1.0, r"distributed under the boost software license version 1 0"),
    ("boost-1.0", 0.95, r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 0.95, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 0.9, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.9, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 0.9, r"the png reference library is supplied as is"),
    ("unlicense", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.95, r"for more information please refer to(?: https?)? unlicense org"),
    ("wtfpl", 0.95, r"0 you just do what the fuck you want to"),
    ("beerware", 0.95, r"you can buy me a beer in return"),
    ("cc0", 0.95, r"has waived all copyright and related or neighboring rights to"),
    ("cc0-1.0", 0.95, r"(?:https? )?creativecommons org publicdomain zero 1 0"),
    ("cc-by", 0.9, r"(?:https? )?creativecommons org licenses by \d \d"),
    ("cc-by-sa", 0.95, r"(?:https? )?creativecommons org licenses by sa \d \d"),
    ("cc-by-nc", 0.95, r"(?:https? )?creativecommons org licenses by nc \d \d"),
    ("cc-by-nd", 0.95, r"(?:https? )?creativecommons org licenses by nd \d \d"),
    ("cc-by-nc-sa", 0.95, r"(?:https? )?creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nc-nd", 0.95, r"(?:https? )?creativecommons org licenses by nc nd \d \d"),
    ("cc-by-sa", 0.9, r"creative commons attribution sharealike(?: \d \d)?(?: international| unported)?(?: public)? license"),
    ("cc-by", 0.9, r"creative commons attribution(?: \d \d)(?: international| unported)?(?: public)? license"),
    ("python-2.0", 0.9, r"this license agreement is between the python software foundation psf and the individual or organization"),
    ("php", 0.9, r"this product includes php software freely available from"),
    ("openssl", 0.95, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 0.95, r"this product includes cryptographic software written by eric young"),
    ("ofl-1.1", 0.95, r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl", 0.9, r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ms-pl", 0.9, r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("bsl-1.1", 0.9, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("sspl-1.0", 0.9, r"make the functionality of the program or (?:a )?modified versions? available to third parties as a service"),
    ("elastic-2.0", 0.9, r"you may not provide the software to third parties as a hosted or managed service"),
    ("json", 0.95, r"the software shall be used for good not evil"),
    ("ncsa", 0.9, r"to deal with the software without restriction including without limitation the rights to use"),
    ("w3c", 0.9, r"(?:this work is distributed under the )?w3c software(?: and document)? notice and license"),
    ("hpnd", 0.85, r"permission to use copy modify and distribute this software and its (?:supporting )?documentation for any purpose(?: and)? without fee is hereby granted"),
    ("x11", 0.9, r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("afl", 0.9, r"licensed under the academic free license version \d \d"),
    ("osl", 0.9, r"licensed under the open software license version \d \d"),
    ("ecl-2.0", 0.9, r"licensed under the educational community license version 2 0"),
    ("odc-by", 0.9, r"open data commons attribution license"),
    ("pddl", 0.9, r"open data commons public domain dedication(?: and)? license"),
    ("llama", 0.9, r"llama \d(?: \d)? community license(?: agreement)?"),
    ("public-domain", 0.85, r"this (?:work|file|software|code|program) (?:is|has been placed|was placed) in the public domain"),
    ("public-domain", 0.85, r"the author disclaims copyright to this source code"),
    ("proprietary", 0.85, r"confidential and proprietary information of"),
    ("proprietary", 0.85, r"no part of this (?:publication|document|work|book) may be reproduced(?: \w{1,24}){0,14}? without the prior written permission"),
    ("proprietary", 0.8, r"subject to the terms of the end user license agreement"),
]


@dataclass(frozen=True)
class Rule:
    """A signature: its label, its rank (higher wins), its confidence, a keyword any match contains, and the regex."""

    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern

    @property
    def reach(self) -> int:
        """The most characters that a match has; every quantifier in the rules is bounded."""
        return _width(self.pattern.pattern)


def _keyword(name: str) -> str:
    """The longest plain word part of a regex, which all its matches contain."""
    plain = re.sub(r"\([^()]*\)\??|\[[^\]]*\]|\.\{[^}]*\}|\w\?|\\\w", "\0", re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", "\0", name))
    return max(re.findall(r"[a-z0-9]+(?: [a-z0-9]+)*", plain.replace("\0", "\n")), key=len, default="")


def _width(pattern: str) -> int:
    from re import _parser

    widest = _parser.parse(pattern).getwidth()[1]
    if widest > 5000:
        raise ValueError(f"a rule without a bound: {pattern}")
    return widest


def _identifier(pattern: str) -> str:
    """An identifier after the words that announce it, or after other identifiers of the same expression; the match itself is the group ``id``."""
    any_of = "|".join(sorted({i for *_, spdx in FAMILIES for i in spdx}, key=lambda i: (-len(i), i)))
    return rf"spdx licen[cs]e identifier (?:(?:{any_of}) (?:or|and|with) ){{0,6}}(?P<id>{pattern})"


@cache
def rules() -> list[Rule]:
    """All rules, ordered by falling priority: identifiers, grants with a version, bodies, names with a version, grants, names."""
    out = []

    def add(label: str, priority: int, confidence: float, core: str, pattern: str) -> None:
        # letters and digits around would be part of another word
        out.append(Rule(label, priority, confidence, _keyword(core), re.compile(rf"(?<![^ ]){pattern}(?![^ ])")))

    for label, names, versions, spdx in FAMILIES:
        long = 10 * label.count("-")  # a narrower family goes before the one it belongs to
        for i in spdx:
            add(label, 500 + long, 1.0, i, _identifier(i))
            for suffix, _ in versions:  # an identifier names its version
                exact = re.sub(r"(?:\\d|\d) (?:\\d|\d)1?\??", suffix[1:].replace(".", " "), i, count=1)
                if exact != i or suffix[1:].replace(".", " ") in i:
                    plain = re.sub(r"\(\?:[^()]*\)\?", "", exact)
                    if re.fullmatch(i, plain):
                        add(label + suffix, 510 + long, 1.0, exact, _identifier(exact))
        for name in names:
            for suffix, version in versions:
                v = rf" ?(?:v|ver|version)? ?{version}"
                before = re.sub(r" (?:public )?licen\[cs\]e$", "", name)
                if before != name:  # the version in the middle: the Apache 2.0 license
                    add(label + suffix, 300 + long, 0.9, before, rf"{before}(?: v| version)? ?{version}(?: public)? licen[cs]e")
                add(label + suffix, 400 + long, 1.0, name, rf"{_GRANT} {name}{v}")
                add(label + suffix, 300 + long, 0.9, name, rf"{name}{v}")
            add(label, 200 + long, 0.8, name, rf"{_GRANT} {name}")
            if name not in AMBIGUOUS:
                add(label, 100 + long, 0.6, name, name)
    for label, confidence, body in BODIES:
        add(label, 350 + 10 * label.count("-"), confidence, body, body)
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    label: str
    priority: int
    confidence: float


class _LongestEnd:
    """The largest end of the intervals put in so far that start at or before a place (a tree of prefix maxima)."""

    def __init__(self, starts: list[int]):
        self.at = {x: i + 1 for i, x in enumerate(sorted(set(starts)))}
        self.most = [-1] * (len(self.at) + 1)

    def put(self, start: int, end: int) -> None:
        i = self.at[start]
        while i < len(self.most):
            self.most[i] = max(self.most[i], end)
            i += i & -i

    def of(self, start: int) -> int:
        i, out = self.at[start], -1
        while i:
            out = max(out, self.most[i])
            i -= i & -i
        return out


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections by falling priority and length; those within the interval of one kept before are suppressed.

    Of one label containment holds both ways: a surer detection within a longer one is part of it and gives it its confidence."""
    kept: list[Detection] = []
    ends = _LongestEnd([d.start for d in found])
    for d in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if ends.of(d.start) < d.end:
            kept.append(d)
            ends.put(d.start, d.end)
    whole: list[Detection] = []
    for d in sorted(kept, key=lambda d: (d.label, d.start, -d.end)):
        if whole and whole[-1].label == d.label and d.end <= whole[-1].end:
            best = whole.pop()
            d = replace(best, priority=max(best.priority, d.priority), confidence=max(best.confidence, d.confidence))
        whole.append(d)
    return sorted(whole, key=lambda d: (d.start, d.end, d.label))


def _stretches(line: str, hits: list[int], size: int, reach: int) -> list[tuple[int, int]]:
    """Stretches of ``line`` that all matches lie in that hold a keyword of ``size`` characters ending at one of ``hits``."""
    out: list[tuple[int, int]] = []
    for e in hits:
        a, b = max(0, e + 1 - reach), line.find(" ", min(e + 1 - size + reach, len(line) - 1))
        if out and a <= out[-1][1]:
            a = out.pop()[0]
        out.append((a, b))
    return out


class Scanner:
    def __init__(self):
        import ahocorasick

        self.by_keyword: dict[str, list[tuple[Rule, int]]] = {}
        for r in rules():
            self.by_keyword.setdefault(r.keyword, []).append((r, r.reach))
        self.machine = ahocorasick.Automaton()
        for k in {*self.by_keyword, *BASE}:
            self.machine.add_word(k, k)
        self.machine.make_automaton()

    def __getstate__(self):
        return {}

    def __setstate__(self, _):
        self.__init__()

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[Detection]]:
        """Words of the text, (word, label) of every base phrase, and resolved detections with intervals of words.

        A rule is tried only in the stretches around its keyword that a match can reach."""
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        words = _words(low)
        if not words:
            return 0, [], []
        line = " " + " ".join(words) + " "
        hits: dict[str, list[int]] = {}
        for e, k in self.machine.iter(line):
            hits.setdefault(k, []).append(e)
        if not hits:
            return len(words), [], []
        base, spans, owners = [], [], []
        for phrase, label in BASE.items():
            for e in hits.get(phrase, ()):
                if line[e + 1] == " " and line[e - len(phrase)] == " ":
                    base.append((e - len(phrase) + 1, label))
        for keyword in sorted(hits):
            for r, reach in self.by_keyword.get(keyword, ()):
                for a, b in _stretches(line, hits[keyword], len(keyword), reach):
                    for m in r.pattern.finditer(line, a, b):
                        spans.append(m.span("id") if "id" in r.pattern.groupindex else m.span())
                        owners.append(r)
        starts = 1 + np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        number = lambda at: np.searchsorted(starts, at, "right") - 1
        edges = np.array(spans, np.int64).reshape(-1, 2)
        first, last = number(edges[:, 0]).tolist(), number(edges[:, 1] - 1).tolist()
        found = [Detection(a, b + 1, r.label, r.priority, r.confidence) for a, b, r in zip(first, last, owners)]
        at = number(np.array([x for x, _ in base], np.int64)).tolist()
        return len(words), sorted(zip(at, (x for _, x in base))), resolve(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (array of word and label) and detections (start, end, label, confidence; words, end
    exclusive) of the whole text of every row.

    Null texts count as empty: no words, no detections. Repeated rows are scanned each; other columns are no input."""

    def make():
        scanner = Scanner()

        def call(texts):
            out = {"n_words": [], "base": [], "detections": []}
            for t in texts:
                n, base, found = scanner.scan(t or "")
                out["n_words"].append(n)
                out["base"].append([{"word": w, "label": x} for w, x in base])
                out["detections"].append([{"start": d.start, "end": d.end, "label": d.label, "confidence": d.confidence} for d in found])
            return None, out

        return call

    made = "n_words long, base array<struct<word:long,label:string>>, detections array<struct<start:long,end:long,label:string,confidence:double>>"
    return map_texts(docs, ["doc_id"], make, made)


def summary(scanned: DataFrame) -> DataFrame:
    """One line of figures for each row of ``scan``: places, labels and a score, the highest confidence (base: 0.6)."""
    labels = lambda col: F.concat_ws(",", F.array_sort(F.array_distinct(col)))
    base, found = F.col("base.label"), F.col("detections.label")
    score = F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size("base") > 0, 0.6).otherwise(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.array_union(base, found)).alias("labels"),
        score.alias("score"),
    )
