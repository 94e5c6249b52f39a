"""Licence signatures: one ordered list of rules over normalised words, made from families.

A rule is (lead, need, pattern, label, priority). Its pattern is matched from a word equal to
``lead`` in a text of lower-case words with single spaces; ``need`` is a word the rule's text must
hold, tested before the pattern. Earlier rules win ties.
"""

from __future__ import annotations

import re

# Names people write, as word patterns; the label follows.
NAMES = [
    ("gnu general public licen[cs]e", "gpl"),
    ("gnu gpl", "gpl"),
    ("gpl", "gpl"),
    ("gnu lesser general public licen[cs]e", "lgpl"),
    ("gnu library general public licen[cs]e", "lgpl"),
    ("lesser general public licen[cs]e", "lgpl"),
    ("lgpl", "lgpl"),
    ("gnu affero general public licen[cs]e", "agpl"),
    ("affero general public licen[cs]e", "agpl"),
    ("agpl", "agpl"),
    ("gnu free documentation licen[cs]e", "gfdl"),
    ("gfdl", "gfdl"),
    ("apache licen[cs]e", "apache"),
    ("apache software licen[cs]e", "apache"),
    ("mozilla public licen[cs]e", "mpl"),
    ("mpl", "mpl"),
    ("eclipse public licen[cs]e", "epl"),
    ("epl", "epl"),
    ("common development and distribution licen[cs]e", "cddl"),
    ("cddl", "cddl"),
    ("european union public licen[cs]e", "eupl"),
    ("eupl", "eupl"),
    ("artistic licen[cs]e", "artistic"),
    ("academic free licen[cs]e", "afl"),
    ("open software licen[cs]e", "osl"),
    ("sil open font licen[cs]e", "ofl"),
    ("open font licen[cs]e", "ofl"),
    ("open database licen[cs]e", "odbl"),
    ("odbl", "odbl"),
    ("boost software licen[cs]e", "bsl"),
    ("microsoft public licen[cs]e", "ms-pl"),
    ("python software foundation licen[cs]e", "psf"),
    ("zope public licen[cs]e", "zpl"),
    ("common public licen[cs]e", "cpl"),
    ("cecill", "cecill"),
]
VERSIONS = ("1 0", "1 1", "1 2", "1 3", "2 0", "2 1", "3 0", "1", "2", "3", "4")
# Names without versions, and whole sentences of the well-known texts.
FIXED = [
    ("mit licen[cs]e", "mit"),
    ("expat licen[cs]e", "mit"),
    ("x11 licen[cs]e", "x11"),
    ("isc licen[cs]e", "isc"),
    ("zlib licen[cs]e", "zlib"),
    ("bsd licen[cs]e", "bsd"),
    ("bsd (?:2|two) clause", "bsd-2-clause"),
    ("(?:2|two) clause bsd", "bsd-2-clause"),
    ("simplified bsd licen[cs]e", "bsd-2-clause"),
    ("bsd (?:3|three) clause", "bsd-3-clause"),
    ("(?:3|three) clause bsd", "bsd-3-clause"),
    ("(?:new|revised|modified) bsd licen[cs]e", "bsd-3-clause"),
    ("bsd (?:4|four) clause", "bsd-4-clause"),
    ("unlicen[cs]e", "unlicense"),
    ("what the fuck you want to public licen[cs]e", "wtfpl"),
    ("wtfpl", "wtfpl"),
    ("postgresql licen[cs]e", "postgresql"),
    ("ruby licen[cs]e", "ruby"),
    ("php licen[cs]e", "php"),
    ("openssl licen[cs]e", "openssl"),
    ("beerware licen[cs]e", "beerware"),
    ("cc0", "cc0"),
    ("cc0 1 0", "cc0"),
    ("cc zero", "cc0"),
    ("creative commons zero", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("released into the public domain", "public-domain"),
    ("public domain dedication", "public-domain"),
    ("rights reserved", "all-rights-reserved"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("unencumbered software released into the public domain", "unlicense"),
    ("program is free software you can redistribute it and or modify", "gpl"),
    ("library is free software you can redistribute it and or modify", "lgpl"),
    ("source code form is subject to the terms of the mozilla public licen[cs]e", "mpl"),
    ("software is provided as is without any express or implied warranty", "zlib"),
    ("proprietary and confidential", "proprietary"),
]
CC_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
CC_LONG = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ative works|s|atives)"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
NOTICES = ("licen[cs]ed under(?: the)?(?: terms of)?(?: the)?", "released under(?: the)?(?: terms of)?(?: the)?",
           "distributed under(?: the)?(?: terms of)?(?: the)?", "available under(?: the)?(?: terms of)?(?: the)?",
           "spdx licen[cs]e identifier")
SHORT = ("mit", "isc", "zlib", "bsd", "x11", "ruby", "php", "postgresql", "openssl")  # no licence names by themselves
LONGEST = 24  # words a rule may span; the longest sentence above has 17


def _label(name: str, version: str) -> str:
    return f"{name}-{version.replace(' ', '.')}"


def _named() -> list[tuple[str, str]]:
    out = []
    for pattern, label in NAMES:
        for v in VERSIONS:
            full = f"{v}|{v[0]}" if v.endswith(" 0") else v
            out.append((f"{pattern}(?: version| v| as published by the free software foundation either version)? (?:{full}|v{v})(?: or later| or newer| only)?",
                        _label(label, v if " " in v or v == "4" else f"{v} 0")))
        out.append((pattern, label))
    for parts in CC_PARTS:
        long = " ".join(CC_LONG[p] for p in parts.split())
        for v in CC_VERSIONS:
            out.append((f"cc {parts} {v}", _label(f"cc-{parts.replace(' ', '-')}", v)))
            out.append((f"creative commons {long}(?: international| unported| generic| public)?(?: licen[cs]e)?(?: version)? {v}(?: international| unported| generic)?",
                        _label(f"cc-{parts.replace(' ', '-')}", v)))
        out.append((f"cc {parts}", f"cc-{parts.replace(' ', '-')}"))
        out.append((f"creative commons {long}(?: licen[cs]e)?", f"cc-{parts.replace(' ', '-')}"))
    return out + FIXED


def _leads(pattern: str) -> list[str]:
    """The words a pattern can begin with."""
    first = re.match(r"\(\?:([^)]*)\)|([^ (]+)", pattern)
    words = first[1].split("|") if first[1] else [first[2]]
    return [w.replace("[cs]", c) for w in words for c in ("cs" if "[cs]" in w else "c")]


def _need(pattern: str) -> str:
    """A word every match holds besides the first: the last plain one, else none."""
    plain = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)\??", "#", pattern).split(" ")
    words = [w for w in plain[1:] if re.fullmatch(r"[a-z]{3,}", w)]
    return max(words, key=len) if words else ""


def rules() -> list[dict]:
    """All rules in order; a longer, versioned or notice rule outranks the bare name it holds."""
    out = []
    for rank, (pattern, label) in enumerate(_named()):
        for lead in _leads(pattern):
            out.append({"lead": lead, "need": _need(pattern), "pattern": f"^({pattern})(?= |$)", "label": label, "rank": -rank})
    for notice in NOTICES:
        for name in SHORT:
            for lead in _leads(notice):
                out.append({"lead": lead, "need": name, "pattern": f"^({notice} {name})(?= |$)", "label": name, "rank": -len(out)})
    return out
