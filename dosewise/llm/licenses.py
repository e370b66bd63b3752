"""Licence scan: ordered signature rules behind a keyword gate, with priority and containment settling overlaps."""

import re
from bisect import bisect_right

import numpy as np

from .common import map_texts

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_WEIGHT = 0.5

# Licences by label: their names as patterns over lower-case words, the first being the usual one.
NAMES = {
    "apache-1.0": ["apache (?:software )?license(?: version)? 1 0"],
    "apache-1.1": ["apache (?:software )?license(?: version)? 1 1"],
    "apache-2.0": ["apache (?:software )?license(?: version| v)? ?2(?: 0)?", "asl ?2(?: 0)?"],
    "mit": ["(?:the )?mit license", "expat license", "mit x11 license"],
    "mit-0": ["mit no attribution(?: license)?"],
    "isc": ["isc license"],
    "bsd-0": ["(?:zero clause|0 clause) bsd(?: license)?"],
    "bsd-2": ["(?:2|two) clause bsd(?: license)?", "simplified bsd license", "freebsd license"],
    "bsd-3": ["(?:3|three) clause bsd(?: license)?", "(?:new|revised|modified) bsd license"],
    "bsd-4": ["(?:4|four) clause bsd(?: license)?", "original bsd license"],
    "gpl-1.0": ["gnu general public license(?: version| v)? ?1(?: 0)?", "gpl ?v?1(?: 0)?"],
    "gpl-2.0": ["gnu general public license(?: version| v)? ?2(?: 0)?", "gpl ?v?2(?: 0)?"],
    "gpl-3.0": ["gnu general public license(?: version| v)? ?3(?: 0)?", "gpl ?v?3(?: 0)?"],
    "lgpl-2.0": ["gnu (?:library|lesser) general public license(?: version| v)? ?2(?: 0)?", "lgpl ?v?2(?: 0)?"],
    "lgpl-2.1": ["gnu lesser general public license(?: version| v)? ?2 1", "lgpl ?v?2 1"],
    "lgpl-3.0": ["gnu lesser general public license(?: version| v)? ?3(?: 0)?", "lgpl ?v?3(?: 0)?"],
    "agpl-3.0": ["(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", "agpl ?v?3(?: 0)?"],
    "gfdl-1.1": ["gnu free documentation license(?: version| v)? ?1 1"],
    "gfdl-1.2": ["gnu free documentation license(?: version| v)? ?1 2"],
    "gfdl-1.3": ["gnu free documentation license(?: version| v)? ?1 3"],
    "mpl-1.0": ["mozilla public license(?: version| v)? ?1 0", "mpl ?1 0"],
    "mpl-1.1": ["mozilla public license(?: version| v)? ?1 1", "mpl ?1 1"],
    "mpl-2.0": ["mozilla public license(?: version| v)? ?2(?: 0)?", "mpl ?2(?: 0)?"],
    "epl-1.0": ["eclipse public license(?: version| v)? ?1(?: 0)?", "epl ?1 0"],
    "epl-2.0": ["eclipse public license(?: version| v)? ?2(?: 0)?", "epl ?2 0"],
    "eupl-1.1": ["european union public licen[cs]e(?: version| v)? ?1 1", "eupl ?1 1"],
    "eupl-1.2": ["european union public licen[cs]e(?: version| v)? ?1 2", "eupl ?1 2"],
    "cddl-1.0": ["common development and distribution license(?: version)? 1 0", "cddl ?1 0"],
    "cddl-1.1": ["common development and distribution license(?: version)? 1 1", "cddl ?1 1"],
    "cpl-1.0": ["common public license(?: version)? ?1 0"],
    "ipl-1.0": ["ibm public license(?: version)? ?1 0"],
    "osl-3.0": ["open software license(?: version| v)? ?3(?: 0)?"],
    "afl-3.0": ["academic free license(?: version| v)? ?3(?: 0)?"],
    "artistic-1.0": ["artistic license(?: version)? ?1 0"],
    "artistic-2.0": ["artistic license(?: version)? ?2(?: 0)?"],
    "bsl-1.0": ["boost software license(?: version)? ?1 0"],
    "busl-1.1": ["business source license(?: version)? ?1 1"],
    "sspl-1.0": ["server side public license(?: version| v)? ?1?", "sspl"],
    "elastic-2.0": ["elastic license(?: version)? ?2(?: 0)?"],
    "python-2.0": ["python software foundation license(?: version)? ?2?"],
    "php-3.0": ["php license(?: version)? ?3(?: 0)?"],
    "php-3.01": ["php license(?: version)? ?3 01"],
    "postgresql": ["postgresql license"],
    "ruby": ["ruby license"],
    "zlib": ["zlib license", "zlib libpng license"],
    "libpng": ["libpng license"],
    "curl": ["curl license"],
    "openssl": ["openssl license"],
    "unlicense": ["(?:the )?unlicense"],
    "wtfpl": ["wtfpl"],
    "vim": ["vim license"],
    "tcl": ["tcl tk license"],
    "ms-pl": ["microsoft public license"],
    "ms-rl": ["microsoft reciprocal license"],
    "ofl-1.1": ["(?:sil )?open font license(?: version)? ?(?:1 1)?"],
    "odbl-1.0": ["open database license(?: version)? ?(?:1 0)?", "odbl"],
    "odc-by-1.0": ["open data commons attribution license"],
    "pddl-1.0": ["public domain dedication and license", "pddl"],
    "cecill-2.1": ["cecill(?: license)?(?: version)? ?2 1"],
    "ncsa": ["university of illinois ncsa open source license", "ncsa license"],
    "upl-1.0": ["universal permissive license(?: version)? ?1 0"],
    "openrail": ["open ?rail m? ?license", "responsible ai license"],
    "cc0-1.0": ["creative commons zero", "cc0(?: 1 0)?", "cc zero"],
    "public-domain": ["dedicated to the public domain", "(?:in|into) the public domain"],
    "proprietary": ["proprietary and confidential", "confidential and proprietary", "unpublished proprietary"],
}

# Creative Commons: label and pattern by terms; the versions are added below.
COMMONS = {
    "cc-by": "(?:cc by|creative commons attribution)",
    "cc-by-sa": "(?:cc by sa|creative commons attribution share ?alike)",
    "cc-by-nd": "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)",
    "cc-by-nc": "(?:cc by nc|creative commons attribution non ?commercial)",
    "cc-by-nc-sa": "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)",
    "cc-by-nc-nd": "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)",
}
VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Clauses of licence texts: label, pattern.
CLAUSES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("bsd-4", "all advertising materials mentioning features or use of this software"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "www apache org licenses license 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify"),
    ("gpl", "you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "you should have received a copy of the gnu affero general public license"),
    ("gpl-or-later", "either version [123](?: 0)? of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("warranty", "the software is provided as is without warranty of any kind"),
    ("warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("cc0-1.0", "to the extent possible under law .{1,80}? has waived all copyright"),
    ("gfdl", "permission is granted to copy distribute and or modify this document"),
    ("reserved", "no part of this (?:publication|book|work) may be reproduced"),
    ("reserved", "unauthorized (?:copying|reproduction|distribution) .{0,60}? ?prohibited"),
    ("proprietary", "this (?:document|file|software) contains proprietary"),
    ("trademark", "is a registered trademark of"),
]
GRANT = "(?:licensed|released|distributed|available|published|provided|shared)(?: to you)? under(?: the)?(?: terms of)?(?: the)?(?: an?)?"

# Families without a version, found where no versioned name covers them.
FAMILIES = {
    "apache": "apache (?:software )?license", "gpl": "(?:gnu )?general public license", "lgpl": "(?:gnu )?lesser general public license",
    "agpl": "(?:gnu )?affero general public license", "mpl": "mozilla public license", "epl": "eclipse public license", "bsd": "bsd (?:style )?license",
    "artistic": "artistic license", "cc": "creative commons licen[cs]e", "gfdl": "(?:gnu )?free documentation license", "eupl": "european union public licen[cs]e",
}


def tag(label):
    return label.replace("-", " ").replace(".", " ")


REPEAT = re.compile(r"\{(\d+),\d+\}\??|\?")


def forms(pattern):
    """Every text that a pattern of these rules matches; a zero byte stands for whatever a repeated dot takes."""
    def choice(at):
        out, made = set(), {""}
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                out, made, at = out | made, {""}, at + 1
                continue
            if pattern.startswith("(?:", at):
                part, at = choice(at + 3)
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                part = set(re.findall(f"[{pattern[at + 1:end]}]", "abcdefghijklmnopqrstuvwxyz0123456789"))
                at = end
            else:
                part = {pattern[at].replace(".", "\0")}
            times = REPEAT.match(pattern, at + 1)
            if times and times[1] in (None, "0"):
                part = part | {""}
            at = times.end() if times else at + 1
            made = {a + b for a in made for b in part}
        return out | made, at

    return choice(0)[0]


def gate_of(pattern, more=()):
    """(words, openings) without which no text matches: the two longest of the words that stand by themselves in every form,
    and the first words of the forms, of which one must be there.  ``more`` are such words of what precedes the pattern."""
    split = [f.split() for f in forms(pattern)]
    always = set.intersection(*map(set, split)).union(more)
    words = sorted(always, key=lambda w: (len(w), w))[-2:]
    return tuple(w.encode() for w in words), frozenset(f[0].encode() for f in split)


def build_rules():
    """(priority, weight, label, pattern, gate words) in order, and for each rule its openings; a lower priority number wins."""
    rules, openings = [], []

    def add(priority, weight, label, pattern, before=""):
        gate, first = gate_of(pattern, ("under",) if before else ())
        rules.append((priority, weight, label, re.compile(rf"(?<= ){before}{pattern}(?= )".encode()), gate))
        openings.append(first)

    commons = [(f"{label}-{v.replace(' ', '.')}", f"{names}(?: licen[cs]e)?(?: version| v)? ?{v}") for label, names in COMMONS.items() for v in VERSIONS]
    named = [(label, p) for label, patterns in NAMES.items() for p in patterns] + commons
    for label in [*NAMES, *(label for label, _ in commons)]:
        add(0, 1.0, label, f"spdx license identifier {tag(label)}")
    for label, pattern in CLAUSES:
        add(1, 0.95, label, pattern)
    for label, pattern in named:
        add(2, 0.9, label, pattern, f"{GRANT} ")
    for label, pattern in named:
        add(3, 0.7, label, pattern)
    for label, pattern in COMMONS.items():
        add(4, 0.6, label, pattern)
    for label, pattern in FAMILIES.items():
        add(5, 0.5, label, pattern)
    add(6, 0.3, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]")
    return rules, openings


RULES, OPENINGS = build_rules()
# A rule that has no word which always stands by itself is gated by its openings alone.
LOOSE = frozenset(w for rule, first in zip(RULES, OPENINGS) if not rule[4] for w in first)
GATE = frozenset(w for rule, first in zip(RULES, OPENINGS) for w in (*rule[4], *first))

# Lower case for A-Z, white space for every other character below 0x80 that is no digit or letter.
FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PHRASES = {f" {phrase} ".encode(): label for phrase, label in BASE.items()}


def places(folded, phrase):
    at = folded.find(phrase)
    while at >= 0:
        yield at
        at = folded.find(phrase, at + 1)


def detections(folded, words):
    """(start, end, label, weight) of the rules' matches that no match of equal or higher rank contains."""
    present = GATE.intersection(words)
    if not present:
        return []
    found = []
    for order, (priority, weight, label, pattern, gate) in enumerate(RULES):
        if present.issuperset(gate) and not present.isdisjoint(OPENINGS[order]):
            found += [(priority, m.start() - m.end(), m.start(), order, m.end(), label, weight) for m in pattern.finditer(folded)]
    return uncontained(sorted(found))


def uncontained(ranked):
    """(start, end, label, weight), by place, of those matches that none ranked before them contains.

    A Fenwick tree over the starts holds the farthest end of the kept matches up to each start, so a match costs a few
    steps however many there are.
    """
    starts = sorted({m[2] for m in ranked})
    farthest, kept = [-1] * (len(starts) + 1), []
    for _, _, start, _, end, label, weight in ranked:
        at = place = bisect_right(starts, start)
        reach = -1
        while at:
            reach = max(reach, farthest[at])
            at &= at - 1
        if reach >= end:
            continue
        kept.append((start, end, label, weight))
        while place < len(farthest):
            farthest[place] = max(farthest[place], end)
            place += place & -place
    return sorted(kept)


def scan_text(text):
    words = text.encode().translate(FOLD).split()
    folded = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in PHRASES.items() for at in places(folded, phrase)]
    found = detections(folded, words)
    first, last = (min(base)[0], max(base)[0]) if base else (None, None)
    labels = {label for _, label in base}
    blanks = np.flatnonzero(np.frombuffer(folded, np.uint8) == 32)

    def words_before(at):
        return np.searchsorted(blanks, at).tolist()

    spans = zip(words_before([s - 1 for s, *_ in found]), words_before([e for _, e, *_ in found]), (label for *_, label, _ in found))
    miss = 1.0
    for weight in [BASE_WEIGHT] * len(base) + [w for _, _, _, w in found]:
        miss *= 1.0 - weight
    return {
        "n_words": len(words), "n_base": len(base),
        "first_word": words_before(first) if base else None, "last_word": words_before(last) if base else None,
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {d[2] for d in found})), "score": 1.0 - miss,
        "found": [f"{first}:{end}:{label}" for first, end, label in spans],
    }


FIELDS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string",
    "score": "double", "found": "strings",
}


def scan(docs, text="text", keep=("doc_id",)):
    """One row per document: its words, the places of the base phrases, and the licences that the rules detect.

    ``found`` lists the surviving detections as first word:end word:label.  ``score`` is one minus the product of what each
    detection leaves open.  A null text counts as empty: no words, no labels, score 0.  Repeated rows give a row each.
    """
    def run(texts):
        rows = [scan_text(t or "") for t in texts]
        return {k: [r[k] for r in rows] for k in FIELDS}

    return map_texts(docs, text, list(keep), FIELDS, run)
