"""License scans by ordered signature rules.

A text becomes its lower-cased words, joined by single spaces. A rule is a pattern over such text with a label, a
priority and the keywords without which it cannot match; a document's keywords (found in one pass) choose the rules
that run. Detections of one rule may touch those of others: a detection gives way to one of higher priority whose
word interval contains its own, or to an equal-priority one with a longer interval or, for the same interval, an
earlier rule. Base phrases are rules too, but they never give way and all their places count, overlaps included.

Defined cases: null counts as empty; an empty text has no words and no labels; texts are read whole; repeated rows
are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE, EXACT, NAMED, FAMILY, HINT = 5, 4, 3, 2, 1
CONFIDENCE = {BASE: 0.6, EXACT: 1.0, NAMED: 0.9, FAMILY: 0.7, HINT: 0.4}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str  # over words joined by one space; bounds of words are added
    keywords: tuple[str, ...]  # all of them are words of any match
    priority: int

    @property
    def regex(self) -> re.Pattern:
        return re.compile(rf"(?<! \S)(?<!\S)(?:{self.pattern})(?!\S)")


BASE_PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Families: label, name pattern, keyword of the name, versions ("" where the license has none).
FAMILIES = (
    ("agpl", r"(?:gnu )?affero general public licen[cs]e", "affero", ("1.0", "3.0")),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "general", ("2.0", "2.1", "3.0")),
    ("gpl", r"(?:gnu )?general public licen[cs]e", "general", ("1.0", "2.0", "3.0")),
    ("fdl", r"(?:gnu )?free documentation licen[cs]e", "documentation", ("1.1", "1.2", "1.3")),
    ("apache", r"apache (?:software )?licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("mpl", r"mozilla public licen[cs]e", "mozilla", ("1.0", "1.1", "2.0")),
    ("epl", r"eclipse public licen[cs]e", "eclipse", ("1.0", "2.0")),
    ("cddl", r"common development and distribution licen[cs]e", "distribution", ("1.0", "1.1")),
    ("cpl", r"common public licen[cs]e", "common", ("0.5", "1.0")),
    ("eupl", r"european union public licen[cs]e", "european", ("1.0", "1.1", "1.2")),
    ("osl", r"open software licen[cs]e", "software", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"academic free licen[cs]e", "academic", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", r"artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    ("lppl", r"latex project public licen[cs]e", "latex", ("1.0", "1.1", "1.2", "1.3")),
    ("ofl", r"(?:sil )?open font licen[cs]e", "font", ("1.0", "1.1")),
    ("cecill", r"cecill(?: free software licen[cs]e)?", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("odbl", r"open (?:data commons )?(?:open )?database licen[cs]e", "database", ("1.0",)),
    ("odc-by", r"open data commons attribution licen[cs]e", "attribution", ("1.0",)),
    ("boost", r"boost software licen[cs]e", "boost", ("1.0",)),
    ("python", r"(?:python software foundation|psf) licen[cs]e", "", ("2",)),
    ("php", r"php licen[cs]e", "php", ("3.0", "3.01")),
    ("zope", r"zope public licen[cs]e", "zope", ("1.1", "2.0", "2.1")),
    ("w3c", r"w3c (?:software )?(?:notice and )?licen[cs]e", "w3c", ("",)),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft", ("",)),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft", ("",)),
    ("mit", r"mit licen[cs]e", "mit", ("",)),
    ("x11", r"x11 licen[cs]e", "x11", ("",)),
    ("isc", r"isc licen[cs]e", "isc", ("",)),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", ("",)),
    ("openssl", r"openssl licen[cs]e", "openssl", ("",)),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", ("",)),
    ("ruby", r"ruby licen[cs]e", "ruby", ("",)),
    ("vim", r"vim licen[cs]e", "vim", ("",)),
    ("sleepycat", r"sleepycat licen[cs]e", "sleepycat", ("",)),
    ("ncsa", r"(?:university of illinois )?ncsa (?:open source )?licen[cs]e", "ncsa", ("",)),
    ("upl", r"universal permissive licen[cs]e", "universal", ("1.0",)),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e|wtfpl", "", ("2",)),
    ("bsd-0-clause", r"(?:0|zero) clause bsd(?: licen[cs]e)?|bsd (?:0|zero) clause(?: licen[cs]e)?", "bsd", ("",)),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", "", ("",)),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", "bsd", ("",)),
    ("bsd-4-clause", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e", "bsd", ("",)),
)
CC_KINDS = {"by": "by", "by sa": "by-sa", "by nc": "by-nc", "by nd": "by-nd", "by nc sa": "by-nc-sa", "by nc nd": "by-nc-nd"}
CC_NAMES = {"attribution": "by", "attribution share ?alike": "by-sa", "attribution non ?commercial": "by-nc", "attribution no ?derivatives": "by-nd",
            "attribution non ?commercial share ?alike": "by-nc-sa", "attribution non ?commercial no ?derivatives": "by-nc-nd"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
# Signature sentences of license texts and notices: label, pattern, keyword, priority.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby", EXACT),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial", NAMED),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", EXACT),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", EXACT),
    ("bsd-3-clause", r"neither the name of (?:(?!neither the name of ).)+? nor the names of its contributors may be used to endorse or promote", "endorse", EXACT),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising", EXACT),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", EXACT),
    ("apache-2.0", r"www apache org licenses license 2 0", "apache", EXACT),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute", NAMED),
    ("gpl", r"you should have received a copy of the gnu general public license", "gnu", NAMED),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "library", NAMED),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", EXACT),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "implied", EXACT),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", EXACT),
    ("unlicense", r"unlicense org|the unlicense", "", NAMED),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile", EXACT),
    ("mit-0", r"mit no attribution", "attribution", EXACT),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability", NAMED),
    ("x11", r"except as contained in this notice the name of (?:(?!except as contained in ).)+? shall not be used in advertising", "advertising", EXACT),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions", NAMED),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", NAMED),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|author)(?: and contributors)? as is", "provided", NAMED),
    ("bsd", r"use of this source code is governed by a bsd style licen[cs]e", "bsd", EXACT),
    ("bsd-2-clause-views", r"the views and conclusions contained in the software and documentation are those of the authors", "conclusions", EXACT),
    ("isc", r"the software is provided as is and the author disclaims all warranties", "disclaims", NAMED),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "basis", EXACT),
    ("apache-2.0", r"you may obtain a copy of the license at (?:http |https )?www apache org", "apache", EXACT),
    ("apache-2.0", r"licensed to the apache software foundation asf under one or more contributor license agreements", "contributor", EXACT),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache", EXACT),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "hope", NAMED),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim", NAMED),
    ("gpl", r"www gnu org (?:licenses|copyleft) gpl", "gnu", NAMED),
    ("gpl-2.0", r"gnu general public license version 2 june 1991|gpl 2 0 only|gpl v2 only", "", EXACT),
    ("gpl-3.0", r"gnu general public license version 3 29 june 2007", "gnu", EXACT),
    ("gpl-linking-exception", r"as a special exception (?:(?!as a special exception ).)+? permission to link", "exception", EXACT),
    ("gpl-classpath-exception", r"classpath exception|linking this library statically or dynamically with other modules", "", EXACT),
    ("lgpl", r"this library is distributed in the hope that it will be useful but without any warranty", "hope", NAMED),
    ("lgpl", r"www gnu org licenses lgpl", "lgpl", NAMED),
    ("agpl", r"www gnu org licenses agpl", "agpl", NAMED),
    ("agpl-3.0", r"remote network interaction use with the gnu general public license", "remote", EXACT),
    ("fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "documentation", EXACT),
    ("fdl-no-invariants", r"with no invariant sections no front cover texts and no back cover texts", "invariant", EXACT),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", EXACT),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "mozilla", EXACT),
    ("mpl-2.0-incompatible", r"incompatible with secondary licenses", "incompatible", EXACT),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0", "eclipse", EXACT),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 1 0", "eclipse", EXACT),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "distribution", EXACT),
    ("cecill", r"this software is governed by the cecill (?:b |c )?licen[cs]e under french law", "french", EXACT),
    ("eupl", r"licensed under the eupl", "eupl", EXACT),
    ("zlib", r"this notice may not be removed or altered from any source distribution", "altered", NAMED),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented", EXACT),
    ("boost-1.0", r"distributed under the boost software license version 1 0", "boost", EXACT),
    ("boost-1.0", r"www boost org license 1 0 txt", "boost", EXACT),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim", NAMED),
    ("artistic", r"under the same terms as perl itself", "perl", NAMED),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", "font", EXACT),
    ("ofl", r"reserved font names?", "font", NAMED),
    ("python", r"psf is making python available to licensee on an as is basis", "psf", EXACT),
    ("openssl", r"this product includes software developed by the openssl project", "openssl", EXACT),
    ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic", EXACT),
    ("php", r"this product includes php software freely available from", "php", EXACT),
    ("w3c", r"w3c liability trademark document use and software licensing rules apply", "w3c", EXACT),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software", "deal", EXACT),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", EXACT),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "stuff", EXACT),
    ("json", r"the software shall be used for good not evil", "evil", EXACT),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights to", "waived", EXACT),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", "creativecommons", EXACT),
    ("odbl", r"opendatacommons org licenses odbl", "odbl", EXACT),
    ("pddl", r"public domain dedication and license", "dedication", EXACT),
    ("mulan-psl", r"mulan (?:permissive software license|psl)", "mulan", EXACT),
    ("elastic-2.0", r"elastic licen[cs]e(?: 2 0| version 2)?", "elastic", EXACT),
    ("sspl", r"server side public licen[cs]e", "server", EXACT),
    ("busl", r"business source licen[cs]e", "business", EXACT),
    ("commons-clause", r"commons clause(?: license condition)?", "clause", EXACT),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[cs]e", "polyform", EXACT),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)?", "", EXACT),
    ("us-government", r"this (?:work|software) is a work of the (?:united states|u s) government", "government", NAMED),
    ("crown-copyright", r"crown copyright", "crown", NAMED),
    ("ogl", r"open government licen[cs]e", "government", NAMED),
    ("no-warranty", r"(?:comes with|there is) (?:absolutely )?no warranty", "warranty", HINT),
    ("permission", r"(?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission(?: of)?", "permission", HINT),
    ("proprietary", r"no part of this (?:publication|book|document|work) may be reproduced", "reproduced", NAMED),
    ("proprietary", r"confidential and proprietary|trade secrets? of", "", NAMED),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "hereby", EXACT),
    ("beerware", r"beerware license|beer ware license|you can buy me a beer in return", "", NAMED),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", "", NAMED),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public", NAMED),
    ("public-domain", r"public domain", "public", HINT),
    ("proprietary", r"proprietary and confidential|unauthorized copying of this (?:file|document) (?:via any medium )?is strictly prohibited", "", NAMED),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*", "copyright", HINT),
    ("commercial", r"commercial licen[cs]e", "commercial", HINT),
    ("non-commercial", r"for non ?commercial use only|for personal use only", "", HINT),
    ("licensed", r"(?:licensed|released|distributed) under (?:the terms of )?(?:the|a|an)", "under", HINT),
)


def _version(v: str) -> str:
    """A version in words joined by spaces: 2.0 is also written 2."""
    return v[:-2] + "(?: 0)?" if v.endswith(".0") else v.replace(".", " ")


def rules() -> tuple[Rule, ...]:
    """All rules in order: for every family its version, or-later, only, identifier and unversioned forms."""
    out = [Rule(label, phrase, tuple(phrase.split()), BASE) for label, phrase in BASE_PHRASES]
    for label, name, key, versions in FAMILIES:
        keys = (key,) if key else ()
        short = label.replace("-", " ")
        for v in versions:
            if not v:
                continue
            number = rf"(?:version |v ?)?{_version(v)}"
            full = f"{label}-{v}"
            out += [
                Rule(full, rf"(?:{name}) {number}", keys, NAMED),
                Rule(f"{full}-or-later", rf"(?:{name}) {number} or (?:\(?at your option\)? )?(?:any )?later(?: version)?", (*keys, "later"), EXACT),
                Rule(f"{full}-only", rf"(?:{name}) {number} only", (*keys, "only"), EXACT),
                Rule(full, rf"spdx license identifier {short} {v.replace('.', ' ')}(?: only| or later)?", ("spdx",), EXACT),
                Rule(full, rf"{short} v? ?{_version(v)}", tuple(short.split()), NAMED),
                Rule(full, rf"(?:licensed|released|distributed) under (?:the terms of )?(?:the )?(?:{name}) {number}", (*keys, "under"), EXACT),
            ]
        out += [
            Rule(label, rf"(?:{name})", keys, FAMILY),
            Rule(label, rf"(?:licensed|released|distributed) under (?:the terms of )?(?:the )?(?:{name})", (*keys, "under"), NAMED),
            Rule(label, rf"spdx license identifier {short}", ("spdx",), EXACT),
        ]
    for names, lead in ((CC_KINDS, "cc"), (CC_NAMES, "creative commons")):
        for name, kind in names.items():
            out += [Rule(f"cc-{kind}-{v}", rf"{lead} {name} {_version(v)}(?: international| unported| generic)?", (lead.split()[0],), EXACT) for v in CC_VERSIONS]
            out.append(Rule(f"cc-{kind}", rf"{lead} {name}", (lead.split()[0],), NAMED))
    return (*out, *(Rule(label, p, (k,) if k else (), priority) for label, p, k, priority in SENTENCES))


@dataclass(frozen=True)
class Detection:
    label: str
    first: int  # words, from 0
    last: int
    priority: int
    order: int


class Scanner:
    """Compiled rules; without a given set, all of ``rules()``."""

    def __init__(self, table: tuple[Rule, ...] | None = None):
        table = rules() if table is None else table
        self.table = [(i, r, r.regex, frozenset(r.keywords)) for i, r in enumerate(table)]
        self.free = [x for x in self.table if not x[3]]
        # a rule is considered only in documents that hold its longest keyword
        self.by_anchor: dict[str, list] = {}
        for x in self.table:
            if x[3]:
                self.by_anchor.setdefault(self._anchor(x[1]), []).append(x)
        self.free_words = re.compile("licen[cs]e|cc0|creative|wtfpl|beer|proprietary|unauthorized|use only|bsd|gpl|gnu|classpath|linking|rail|trade")

    @staticmethod
    def _anchor(r: Rule) -> str:
        return max(r.keywords, key=len, default="")

    def detect(self, words: list[str]) -> list[Detection]:
        """Every match of every rule whose keywords the document has."""
        have = set(words)
        run = [x for a in self.by_anchor.keys() & have for x in self.by_anchor[a] if x[3] <= have]
        line = " ".join(words)
        if self.free and self.free_words.search(line):
            run += self.free
        out = []
        for i, r, regex, _ in sorted(run, key=lambda x: x[0]):
            at = first = seen = 0
            while m := regex.search(line, at):
                first, seen = first + line.count(" ", seen, m.start()), m.start()
                out.append(Detection(r.label, first, first + m.group().count(" "), r.priority, i))
                # base phrases count wherever they stand; others go on behind the match
                at = m.start() + 1 if r.priority == BASE else m.end()
        return out

    @staticmethod
    def resolve(found: list[Detection]) -> list[Detection]:
        """What is left after suppression by priority and interval containment."""
        kept: list[Detection] = []
        # intervals kept so far that no other one contains: starts and ends both ascend
        starts: list[int] = []
        ends: list[int] = []
        for d in sorted((d for d in found if d.priority != BASE), key=lambda d: (-d.priority, d.first - d.last, d.order, d.first)):
            at = bisect_right(starts, d.first)
            if at and ends[at - 1] >= d.last:
                continue
            kept.append(d)
            low, high = bisect_left(starts, d.first), bisect_right(ends, d.last)
            starts[low:high], ends[low:high] = [d.first], [d.last]
        return [d for d in found if d.priority == BASE] + kept

    def scan(self, text: str) -> tuple[int, list[Detection]]:
        words = WORDS.findall(text.encode("utf-8", "replace").lower().decode())  # A-Z only
        return len(words), self.resolve(self.detect(words)) if words else []


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the detections (label, first and last word, priority) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for b in batches:
            got = [scanner.scan(t) for t in texts(b["text"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": [n for n, _ in got], "detections": [
                [{"label": d.label, "first": d.first, "last": d.last, "priority": d.priority} for d in ds] for _, ds in got]})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_words long, detections array<struct<label:string,first:long,last:long,priority:int>>")
