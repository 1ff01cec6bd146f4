"""Signature rules of the license scanner.

``FAMILIES``: label, title, identifiers, address, as written in notices.  Each gives a
rule for its title, for a grant that names the title, for its identifier after a tag,
and for its address.  ``PHRASES``: label and a pattern from the license text or its
usual notice.  A space in a title stands for any short gap between words.  Signatures
written one by one are in ``license_texts``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from veilframe.llm.license_texts import EXCEPTIONS, NEGATIVES, SIGNATURES

GAP = r"[^a-z0-9]{1,6}"
VERSION = rf"(?:,?{GAP}(?:version|v\.?|ver\.?))?{GAP}?"

FAMILIES = (
    ("mit", "mit license", "mit", "opensource.org/licenses/mit"),
    ("mit-0", "mit no attribution", "mit-0", "opensource.org/licenses/mit-0"),
    ("x11", "x11 license", "x11", "x.org/docs/license"),
    ("isc", "isc license", "isc", "opensource.org/licenses/isc"),
    ("apache-1.1", "apache software license 1.1", "apache-1.1", "apache.org/licenses/license-1.1"),
    ("apache-2", "apache license 2.0", "apache-2.0", "apache.org/licenses/license-2.0"),
    ("bsd-2", "bsd 2 clause", "bsd-2-clause", "opensource.org/licenses/bsd-2-clause"),
    ("bsd-3", "bsd 3 clause", "bsd-3-clause", "opensource.org/licenses/bsd-3-clause"),
    ("bsd-4", "bsd 4 clause", "bsd-4-clause", "spdx.org/licenses/bsd-4-clause"),
    ("bsd-0", "zero clause bsd", "0bsd", "opensource.org/licenses/0bsd"),
    ("bsd-clear", "clear bsd license", "bsd-3-clause-clear", "spdx.org/licenses/bsd-3-clause-clear"),
    ("bsd", "bsd license", "bsd", "opensource.org/licenses/bsd-license"),
    ("gpl-1", "gnu general public license 1", "gpl-1.0-only", "gnu.org/licenses/gpl-1.0"),
    ("gpl-2", "gnu general public license 2", "gpl-2.0-only", "gnu.org/licenses/gpl-2.0"),
    ("gpl-3", "gnu general public license 3", "gpl-3.0-only", "gnu.org/licenses/gpl-3.0"),
    ("gpl-2-plus", "gnu general public license 2 or later", "gpl-2.0-or-later", "spdx.org/licenses/gpl-2.0-or-later"),
    ("gpl-3-plus", "gnu general public license 3 or later", "gpl-3.0-or-later", "spdx.org/licenses/gpl-3.0-or-later"),
    ("gpl", "gnu general public license", "gpl", "gnu.org/licenses/gpl"),
    ("lgpl-2", "gnu library general public license 2", "lgpl-2.0-only", "gnu.org/licenses/lgpl-2.0"),
    ("lgpl-2.1", "gnu lesser general public license 2.1", "lgpl-2.1-only", "gnu.org/licenses/lgpl-2.1"),
    ("lgpl-3", "gnu lesser general public license 3", "lgpl-3.0-only", "gnu.org/licenses/lgpl-3.0"),
    ("lgpl", "gnu lesser general public license", "lgpl", "gnu.org/licenses/lgpl"),
    ("agpl-3", "gnu affero general public license 3", "agpl-3.0-only", "gnu.org/licenses/agpl-3.0"),
    ("agpl", "gnu affero general public license", "agpl", "gnu.org/licenses/agpl"),
    ("gfdl-1.3", "gnu free documentation license 1.3", "gfdl-1.3-only", "gnu.org/licenses/fdl-1.3"),
    ("gfdl", "gnu free documentation license", "gfdl", "gnu.org/licenses/fdl"),
    ("mpl-1.1", "mozilla public license 1.1", "mpl-1.1", "mozilla.org/mpl/1.1"),
    ("mpl-2", "mozilla public license 2.0", "mpl-2.0", "mozilla.org/mpl/2.0"),
    ("mpl", "mozilla public license", "mpl", "mozilla.org/mpl"),
    ("npl-1.1", "netscape public license 1.1", "npl-1.1", "mozilla.org/npl"),
    ("epl-1", "eclipse public license 1.0", "epl-1.0", "eclipse.org/legal/epl-v10"),
    ("epl-2", "eclipse public license 2.0", "epl-2.0", "eclipse.org/legal/epl-2.0"),
    ("edl-1", "eclipse distribution license 1.0", "edl-1.0", "eclipse.org/org/documents/edl-v10"),
    ("cddl-1", "common development and distribution license 1.0", "cddl-1.0", "opensource.org/licenses/cddl-1.0"),
    ("cddl-1.1", "common development and distribution license 1.1", "cddl-1.1", "spdx.org/licenses/cddl-1.1"),
    ("cpl-1", "common public license 1.0", "cpl-1.0", "opensource.org/licenses/cpl1.0"),
    ("ipl-1", "ibm public license 1.0", "ipl-1.0", "opensource.org/licenses/ipl-1.0"),
    ("artistic-1", "artistic license 1.0", "artistic-1.0", "opensource.org/licenses/artistic-license-1.0"),
    ("artistic-2", "artistic license 2.0", "artistic-2.0", "opensource.org/licenses/artistic-license-2.0"),
    ("bsl-1", "boost software license 1.0", "bsl-1.0", "boost.org/license_1_0"),
    ("busl-1.1", "business source license 1.1", "busl-1.1", "mariadb.com/bsl11"),
    ("elastic-2", "elastic license 2.0", "elastic-2.0", "elastic.co/licensing/elastic-license"),
    ("sspl-1", "server side public license 1", "sspl-1.0", "mongodb.com/licensing/server-side-public-license"),
    ("commons-clause", "commons clause license condition", "commons-clause", "commonsclause.com"),
    ("unlicense", "the unlicense", "unlicense", "unlicense.org"),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl", "wtfpl.net"),
    ("zlib", "zlib license", "zlib", "opensource.org/licenses/zlib"),
    ("libpng", "libpng license", "libpng-2.0", "libpng.org/pub/png/src/libpng-license"),
    ("openssl", "openssl license", "openssl", "openssl.org/source/license"),
    ("python-2", "python software foundation license 2", "psf-2.0", "docs.python.org/3/license"),
    ("php-3.01", "php license 3.01", "php-3.01", "php.net/license/3_01"),
    ("ruby", "ruby license", "ruby", "ruby-lang.org/en/about/license"),
    ("postgresql", "postgresql license", "postgresql", "postgresql.org/about/licence"),
    ("vim", "vim license", "vim", "vimhelp.org/uganda"),
    ("curl", "curl license", "curl", "curl.se/docs/copyright"),
    ("ncsa", "university of illinois ncsa open source license", "ncsa", "opensource.org/licenses/ncsa"),
    ("upl-1", "universal permissive license 1.0", "upl-1.0", "opensource.org/licenses/upl"),
    ("ms-pl", "microsoft public license", "ms-pl", "opensource.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal license", "ms-rl", "opensource.org/licenses/ms-rl"),
    ("eupl-1.2", "european union public licence 1.2", "eupl-1.2", "joinup.ec.europa.eu/collection/eupl"),
    ("cecill-2.1", "cecill free software license agreement 2.1", "cecill-2.1", "cecill.info/licences/licence_cecill_v2.1"),
    ("osl-3", "open software license 3.0", "osl-3.0", "opensource.org/licenses/osl-3.0"),
    ("afl-3", "academic free license 3.0", "afl-3.0", "opensource.org/licenses/afl-3.0"),
    ("ofl-1.1", "sil open font license 1.1", "ofl-1.1", "scripts.sil.org/ofl"),
    ("odbl-1", "open database license 1.0", "odbl-1.0", "opendatacommons.org/licenses/odbl"),
    ("odc-by-1", "open data commons attribution license 1.0", "odc-by-1.0", "opendatacommons.org/licenses/by"),
    ("pddl-1", "public domain dedication and license 1.0", "pddl-1.0", "opendatacommons.org/licenses/pddl"),
    ("cc0", "cc0 1.0 universal", "cc0-1.0", "creativecommons.org/publicdomain/zero"),
    ("cc-by", "creative commons attribution", "cc-by-4.0", "creativecommons.org/licenses/by/"),
    ("cc-by-sa", "creative commons attribution sharealike", "cc-by-sa-4.0", "creativecommons.org/licenses/by-sa"),
    ("cc-by-nd", "creative commons attribution noderivatives", "cc-by-nd-4.0", "creativecommons.org/licenses/by-nd"),
    ("cc-by-nc", "creative commons attribution noncommercial", "cc-by-nc-4.0", "creativecommons.org/licenses/by-nc/"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike", "cc-by-nc-sa-4.0", "creativecommons.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives", "cc-by-nc-nd-4.0", "creativecommons.org/licenses/by-nc-nd"),
    ("hippocratic-3", "hippocratic license 3.0", "hippocratic-3.0", "firstdonoharm.dev"),
    ("openrail-m", "responsible ai license openrail m", "openrail-m", "licenses.ai"),
    ("polyform-nc-1", "polyform noncommercial license 1.0.0", "polyform-noncommercial-1.0.0", "polyformproject.org/licenses/noncommercial"),
    ("parity-7", "parity public license 7.0.0", "parity-7.0.0", "paritylicense.com"),
    ("mulan-2", "mulan permissive software license 2", "mulanpsl-2.0", "license.coscl.org.cn/mulanpsl2"),
    ("w3c", "w3c software notice and license", "w3c", "w3.org/consortium/legal"),
    ("sleepycat", "sleepycat license", "sleepycat", "opensource.org/licenses/sleepycat"),
    ("beerware", "beer ware license", "beerware", "people.freebsd.org/~phk"),
)

PHRASES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors"),
    ("bsd-4", "all advertising materials mentioning features or use of this software"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "confidential and proprietary"),
    ("proprietary", "no part of this publication may be reproduced"),
)


@dataclass(frozen=True)
class Rule:
    label: str | None  # none: what lies inside is suppressed, and the match itself is no detection
    kind: str
    priority: int
    score: float
    keyword: str  # a text without it cannot match
    pattern: re.Pattern


def gapped(words: str) -> str:
    parts = [re.escape(w) for w in words.split()]
    return GAP.join(p.replace("license", "licen[cs]e") for p in parts)


def spaced(body: str) -> str:
    """A pattern in which each space stands for a gap."""
    return body.replace(" ", f"(?:{GAP})")


def titled(title: str) -> str:
    """A title; a number at its end may be led by ``version``, and by a point and zero."""
    *words, last = title.split()
    if not re.fullmatch(r"[0-9.]+", last):
        return gapped(title)
    stem = re.sub(r"(\.0)+$", "", last)
    return f"{gapped(' '.join(words))}{VERSION}{re.escape(stem)}(?:\\.0)*(?![0-9]|\\.[0-9])"


def keyword(title: str) -> str:
    """The longest word of a title that is spelled in one way."""
    fixed = [w for w in title.split() if w.isalpha() and w not in ("license", "licence")]
    return max(fixed or title.split(), key=len)


def rules() -> list[Rule]:
    edge, after = r"(?<![a-z0-9])", r"(?![a-z0-9])"
    out = []

    def add(label: str | None, kind: str, priority: int, score: float, word: str, body: str) -> None:
        out.append(Rule(label, kind, priority, score, word, re.compile(edge + body)))

    grant = rf"(?:licen[cs]ed|released|distributed|available|published|covered){GAP}(?:to you{GAP})?(?:under|by){GAP}(?:the{GAP}|a{GAP})?(?:terms{GAP}of{GAP})?(?:the{GAP})?"
    for label, title, identifier, address in FAMILIES:
        word = keyword(title)
        add(label, "title", 20 + len(title.split()), 0.8, word, titled(title) + after)
        add(label, "grant", 50 + len(title.split()), 0.95, word, grant + titled(title) + after)
        tag = r"(?:spdx-license-identifier|license-expression|license)\s{0,4}[:=]\s{0,4}[\"'(]?"
        add(label, "identifier", 90, 1.0, identifier, tag + re.escape(identifier) + r"(?![a-z0-9+-]|\.[0-9])")
        add(label, "address", 70, 0.9, address, re.escape(address))
    for label, words in PHRASES:
        add(label, "phrase", 80 if len(words.split()) > 5 else 10, 0.9 if label != "proprietary" else 0.6, max(words.split(), key=len), gapped(words) + after)
    for label, word, body in SIGNATURES:
        long = len(body.split()) > 5
        add(label, "signature", 60 if long else 15, 0.9 if long else 0.7, word, spaced(body) + after)
    for label, word, body in EXCEPTIONS:
        add(label, "exception", 85, 0.9, word, spaced(body) + after)
    for word, body in NEGATIVES:
        add(None, "negative", 100, 0.0, word, spaced(body) + after)
    short = rf"cc{GAP}by(?:{GAP}(nc))?(?:{GAP}(sa|nd))?(?:{GAP}[1-4]\.0)?{after}"
    add("cc", "short", 40, 0.9, "cc", short)
    return out
