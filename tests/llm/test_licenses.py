import random
import re
import time

from vigilflow.llm import licenses as lic

from .conftest import plain, with_clashes

TEXTS = [
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
    "Released under the MIT License.", "All rights reserved. all RIGHTS   reserved", "SPDX-License-Identifier: GPL-3.0-or-later", "cc by cc by", "cc-by", "ccby", "x cc\nby y",
    "the GNU Lesser General Public License, version 2.1 or (at your option) any later version", "3-clause BSD license", "", " . ", "general public licenses", "général public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "public domain",
]


def brute(text):
    """Base phrases by comparing words at every position."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hits = sorted((i, label) for label, phrase in lic.BASE_PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
    return len(words), hits


def labels(text):
    return sorted({d.label for d in lic.Scanner().scan(text)[1]})


def test_base_phrases_equal_brute_force(spark, awkward):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None if i is None else i + 100, t, s) for i, t, s in awkward] + [(90, None, "s"), (91, "all rights reserved " * 4000, "s")]
    got = lic.scan(with_clashes(plain(spark, rows))).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in got:
        hits = sorted((d["first"], d["label"]) for d in r.detections if d["priority"] == lic.BASE)
        if r.doc_id is not None:
            assert (r.n_words, hits) == brute(text[r.doc_id])
    assert lic.scan(plain(spark, [])).collect() == []


def test_rules_by_priority_and_containment():
    assert len(lic.rules()) > 400
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc-4.0"]
    assert labels(TEXTS[1]) == ["gpl", "gpl-3.0"]
    assert labels(TEXTS[10]) == ["gpl", "lgpl-2.1-or-later"]
    assert labels("Apache License") == ["apache"] and labels("the MIT licence and the Apache License 2.0") == ["apache-2.0", "mit"]
    assert labels("in the public domain") == ["public-domain"] and labels("no public domains") == []


def test_gates_lose_nothing():
    """Each text by all rules without a keyword gate."""
    s = lic.Scanner()
    for t in TEXTS + ["wtfpl 2", "beerware license", "Boost Software License 1.0", "creative commons attribution sharealike 3.0"]:
        words = lic.WORDS.findall(t.lower())
        line = " ".join(words)
        plainly = {(r.label, line.count(" ", 0, m.start())) for r in lic.rules() for m in r.regex.finditer(line)}
        assert {(d.label, d.first) for d in s.detect(words)} == plainly, t


def spell(tree, rng):
    """One random text that a pattern matches."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op == "IN":
            kind, value = rng.choice(arg)
            out += rng.choice("0123456789") if str(kind) == "CATEGORY" else chr(value)
        elif op == "BRANCH":
            out += spell(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += spell(arg[3], rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, sub = arg
            out += "".join(spell(sub, rng) for _ in range(rng.randint(low, min(high, 300) if high > 1 else high)))
        elif op == "ANY":
            out += rng.choice("abc")
        elif op != "ASSERT_NOT":
            raise AssertionError(op)
    return out


def test_every_rule_passes_its_gate():
    """Texts spelled from each rule's own pattern, alternatives and options at random: the gates let the rule run."""
    rng, s = random.Random(7), lic.Scanner()
    for i, r in enumerate(lic.rules()):
        tree = re._parser.parse(r.pattern)
        for text in {spell(tree, rng) for _ in range(12)}:
            words = text.split()
            if " ".join(words) != text or not r.regex.fullmatch(text):
                continue  # an optional word left two spaces
            assert i in {d.order for d in s.detect(words)}, (r, text)


def test_spellings_and_long_names():
    assert labels("released under the PSF licence") == ["python"]
    assert "python-2" in labels("Python Software Foundation Licence 2")
    name = "the University of " + "Somewhere far away and " * 40 + "its trustees"
    assert labels(f"Neither the name of {name} nor the names of its contributors may be used to endorse or promote products") == ["bsd-3-clause"]


def test_suppression_equals_comparing_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        found = [lic.Detection(str(i), a, a + rng.randint(0, 6), rng.randint(1, 5), rng.randint(0, 9)) for i, a in
                 enumerate(rng.randint(0, 25) for _ in range(rng.randint(0, 25)))]
        kept = []
        for d in sorted((d for d in found if d.priority != lic.BASE), key=lambda d: (-d.priority, d.first - d.last, d.order, d.first)):
            if not any(k.first <= d.first and d.last <= k.last for k in kept):
                kept.append(d)
        assert lic.Scanner.resolve(found) == [d for d in found if d.priority == lic.BASE] + kept


def test_many_detections_in_one_text():
    """Twice the text takes about twice the time, also where a sentence begins often and never ends."""
    s = lic.Scanner()

    def seconds(n):
        t = time.perf_counter()
        words, found = s.scan("the MIT license, Apache License 2.0 and neither the name of any one. " * n)
        assert words == 14 * n and len(found) == 2 * n
        return time.perf_counter() - t

    assert seconds(20_000) < 4 * seconds(10_000) + 0.5
