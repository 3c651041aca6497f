"""License detection by ordered rules.

A text is put in plain form: A-Z lower-cased, runs of other ASCII than letters and digits as single blanks. Each rule is a regular
expression over that form with the words it needs (its gate), a label and a weight; rules without all their words in the text are
never run. Rules are in order of priority. A detection inside another one of an earlier rule is suppressed, whatever the labels;
rules without label only suppress. Texts are worked on whole, each expression moves forward only.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame

from touchline.llm.base import over_texts

PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# Phrases whose places are reported as they are, with their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

LIC = "licen[cs]es?"
SOME = r"(?: \S++){0,%d}?"
V = r"(?: version| v)?"

# Label, needed words, name, identifier of SPDX, address. All expressions are over plain form.
FAMILIES = [
    ("apache-2.0", "apache", rf"apache(?: software)?(?: {LIC})?(?:{V} 2| v2)(?: 0)?", "apache 2 0", rf"apache org licenses {LIC} 2 0"),
    ("apache-1.1", "apache", rf"apache(?: software)?(?: {LIC})?(?:{V} 1| v1) 1", "apache 1 1", rf"apache org licenses {LIC} 1 1"),
    ("apache-1.0", "apache", rf"apache(?: software)?(?: {LIC})?(?:{V} 1| v1)(?: 0)?", "apache 1 0", rf"apache org licenses {LIC} 1 0"),
    ("mit", "mit", r"(?:mit|expat|mit x11)", "mit", rf"opensource org {LIC} mit(?: license)?(?: php)?"),
    ("mit-0", "mit", r"mit (?:no attribution|0)", "mit 0", r"opensource org licenses mit 0"),
    ("x11", "x11", r"x11", "x11", r"xfree86 org legal licenses"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)", r"bsd 4 clause(?: uc)?", r"spdx org licenses bsd 4 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", r"bsd 3 clause(?: clear)?", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", r"bsd 2 clause(?: patent| views)?", r"opensource org licenses bsd 2 clause"),
    ("0bsd", "0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd", r"opensource org licenses 0bsd"),
    ("bsd", "bsd", r"bsd(?: style)?", "bsd", r"opensource org licenses bsd license(?: php)?"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public {LIC}(?:(?:{V} 3| v3)(?: 0)?)?", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?(?:agpl(?:(?: version| v)? 3| v3)?|agplv3)(?: 0)?", r"agpl 3 0(?: only| or later)?", r"choosealicense com licenses agpl 3 0"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public {LIC}(?:{V} 3| v3)(?: 0)?", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0(?: en)?(?: html| txt)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public {LIC}(?:{V} 2| v2) 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 1(?: en)?(?: html| txt)?"),
    ("lgpl-2.0", "library", rf"(?:gnu )?library general public {LIC}(?:(?:{V} 2| v2)(?: 0)?)?", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 0(?: en)?(?: html| txt)?"),
    ("lgpl", "lesser", rf"(?:gnu )?lesser general public {LIC}", "lgpl", r"gnu org licenses lgpl(?: en)?(?: html| txt)?"),
    ("lgpl", "lgpl", r"(?:gnu )?(?:lgpl|lgplv[23])(?:(?: version| v)? [23]| v[23])?(?: [01])?", "lgpl", r"gnu org copyleft lesser(?: html)?"),
    ("gpl-3.0", "general", rf"(?:gnu )?general public {LIC}(?:{V} 3| v3)(?: 0)?", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0(?: en)?(?: html| txt)?"),
    ("gpl-2.0", "general", rf"(?:gnu )?general public {LIC}(?:{V} 2| v2)(?: 0)?", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?"),
    ("gpl-1.0", "general", rf"(?:gnu )?general public {LIC}(?:{V} 1| v1)(?: 0)?", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0(?: html| txt)?"),
    ("gpl-3.0", "gplv3", r"(?:gnu )?gplv3", "gplv3", r"gnu org licenses gplv3(?: html)?"),
    ("gpl-2.0", "gplv2", r"(?:gnu )?gplv2", "gplv2", r"gnu org licenses gplv2(?: html)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?:(?: version| v)? [123]| v[123])?(?: 0)?", "gpl", r"gnu org (?:licenses|copyleft) gpl(?: html| txt)?"),
    ("gfdl", "documentation", rf"(?:gnu )?free documentation {LIC}(?:{V} 1 [123])?", r"gfdl 1 [123](?: only| or later)?", r"gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: html| txt)?"),
    ("mpl-2.0", "mozilla", rf"mozilla public {LIC}(?:{V} 2| v2)(?: 0)?", r"mpl 2 0(?: no copyleft exception)?", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public {LIC}(?:{V} 1| v1) 1", "mpl 1 1", r"mozilla org (?:en us )?mpl 1 1"),
    ("mpl", "mozilla", rf"mozilla public {LIC}", "mpl", r"mozilla org (?:en us )?mpl"),
    ("epl-2.0", "eclipse", rf"eclipse public {LIC}(?: -)?(?:{V} 2| v2)(?: 0)?", "epl 2 0", r"eclipse org (?:legal|org documents) epl (?:v20|2 0)(?: html)?"),
    ("epl-1.0", "eclipse", rf"eclipse public {LIC}(?:(?:{V} 1| v1)(?: 0)?)?", "epl 1 0", r"eclipse org legal epl v10(?: html)?"),
    ("edl-1.0", "eclipse", rf"eclipse distribution {LIC}(?:{V} 1 0)?", "edl 1 0", r"eclipse org org documents edl v10(?: php| html)?"),
    ("cddl-1.1", "development", rf"common development and distribution {LIC}(?:{V} 1| v1) 1", "cddl 1 1", r"oracle com technetwork cddl 1 1"),
    ("cddl-1.0", "development", rf"common development and distribution {LIC}(?:(?:{V} 1| v1)(?: 0)?)?", "cddl 1 0", r"opensource org licenses cddl(?: 1 0| 1)?(?: php)?"),
    ("cpl-1.0", "common", rf"common public {LIC}(?:{V} 1 0)?", "cpl 1 0", r"opensource org licenses cpl 1 0(?: php| txt)?"),
    ("eupl-1.2", "european", rf"european union public {LIC}(?:(?:{V} 1| v1) 2)?", "eupl 1 2", r"joinup ec europa eu (?:page|collection eupl) eupl text(?: 11 12)?"),
    ("eupl", "eupl", r"eupl(?:(?: version| v)? 1 [012])?", r"eupl 1 [01]", r"opensource org licenses eupl 1 [12]"),
    ("cecill", "cecill", r"cecill(?: [abc]| 2 [01])?", r"cecill (?:1 [01]|2 [01]|[bc])", r"cecill info(?: licences)?"),
    ("artistic-2.0", "artistic", rf"artistic {LIC}(?:{V} 2| v2)(?: 0)?", "artistic 2 0", r"opensource org licenses artistic license 2 0"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic", r"artistic 1 0(?: perl| cl8)?", r"dev perl org licenses artistic(?: html)?"),
    ("isc", "isc", r"isc", "isc", r"opensource org licenses isc(?: license)?(?: txt)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib(?: acknowledgement)?", r"(?:zlib net zlib license html|opensource org licenses zlib)"),
    ("libpng", "libpng", r"libpng", r"libpng(?: 2 0)?", r"libpng org pub png src libpng license txt"),
    ("bsl-1.0", "boost", rf"boost software {LIC}(?:(?:{V} 1| v1)(?: 0)?)?", "bsl 1 0", r"boost org license 1 0 txt"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl(?: (?:version|v)? ?2)?", "wtfpl", r"wtfpl net"),
    ("python-2.0", "python", rf"(?:python software foundation|psf|python)(?: {LIC})?(?:{V} 2| v2)?(?: 0)?", r"(?:python|psf) 2 0", r"docs python org [23] license html"),
    ("php-3.01", "php", r"php(?: version 3 0?1)?", r"php 3 0?1?", r"php net license 3 0?1(?: txt)?"),
    ("postgresql", "postgresql", r"postgresql", "postgresql", r"postgresql org about licence"),
    ("openssl", "openssl", r"openssl(?: ssleay)?", "openssl", r"openssl org source license(?: html)?"),
    ("ms-pl", "microsoft", rf"microsoft public {LIC}", "ms pl", r"opensource org licenses ms pl(?: html)?"),
    ("ms-rl", "microsoft", rf"microsoft reciprocal {LIC}", "ms rl", r"opensource org licenses ms rl(?: html)?"),
    ("ofl-1.1", "sil", rf"sil open font {LIC}(?:(?:{V} 1| v1) [01])?", r"ofl 1 [01](?: rfn| no rfn)?", r"scripts sil org ofl"),
    ("upl-1.0", "universal", rf"universal permissive {LIC}(?:{V} 1 0)?", "upl 1 0", r"oss oracle com licenses upl"),
    ("ncsa", "illinois", r"university of illinois ncsa(?: open source)?", "ncsa", r"otm illinois edu disclose protect illinois open source license"),
    ("vim", "vim", r"vim", "vim", r"vimdoc sourceforge net htmldoc uganda html"),
    ("odbl-1.0", "database", rf"open (?:data commons open )?database {LIC}(?:{V} 1 0)?", "odbl 1 0", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", "attribution", rf"open data commons attribution {LIC}(?:{V} 1 0)?", "odc by 1 0", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", "dedication", rf"(?:open data commons )?public domain dedication and {LIC}", "pddl 1 0", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("ogl-3.0", "government", rf"open government {LIC}(?:(?:{V} 3| v3)(?: 0)?)?", r"ogl (?:uk )?[123] 0", r"nationalarchives gov uk doc open government licence(?: version 3)?"),
    ("ssp-1.0", "server", rf"server side public {LIC}(?:{V} 1)?", "sspl 1 0", r"mongodb com licensing server side public license"),
    ("busl-1.1", "business", rf"business source {LIC}(?:{V} 1 1)?", "busl 1 1", r"mariadb com bsl11"),
    ("elastic-2.0", "elastic", rf"elastic {LIC}(?:(?:{V} 2| v2)(?: 0)?)?", "elastic 2 0", r"elastic co licensing elastic license"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?(?:bloom )?open ?rail(?: m| s)?", r"openrail(?: m)?", r"huggingface co spaces compvis stable diffusion license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", "nd", r"(?:creative commons|cc) by nc nd(?: [1234] [05])?", r"cc by nc nd [1234] [05]", r"creativecommons org licenses by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "sa", r"(?:creative commons|cc) by nc sa(?: [1234] [05])?", r"cc by nc sa [1234] [05]", r"creativecommons org licenses by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "nc", r"(?:creative commons|cc) by nc(?: [1234] [05])?", r"cc by nc [1234] [05]", r"creativecommons org licenses by nc(?: [1234] [05])?"),
    ("cc-by-nd", "nd", r"(?:creative commons|cc) by nd(?: [1234] [05])?", r"cc by nd [1234] [05]", r"creativecommons org licenses by nd(?: [1234] [05])?"),
    ("cc-by-sa", "sa", r"(?:creative commons|cc) by sa(?: [1234] [05])?", r"cc by sa [1234] [05]", r"creativecommons org licenses by sa(?: [1234] [05])?"),
    ("cc-by", "cc by", r"(?:creative commons|cc) by(?: [1234] [05])?", r"cc by [1234] [05]", r"creativecommons org licenses by(?: [1234] [05])?"),
]

# Needed words, label (None: only suppresses), weight, expression; the words of whole notices.
NOTICES = [
    ("not license", None, 0, rf"(?:not|never|no longer) (?:licen[cs]ed|released|available|distributed|published|covered)(?: \S++)?? (?:under|by){SOME % 9} {LIC}"),
    ("incompatible license", None, 0, rf"incompatible with(?: the)?{SOME % 8} {LIC}"),
    ("driving license", None, 0, rf"driving {LIC}"),
    ("driver license", None, 0, rf"drivers? (?:s )?{LIC}"),
    ("poetic license", None, 0, rf"poetic {LIC}"),
    ("marriage license", None, 0, rf"marriage {LIC}"),
    ("copies", "mit", 1.0, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("copies", "mit", 0.9, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("sell", "mit", 0.8, r"rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("permission", "isc", 1.0, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "isc", 0.9, r"isc disclaims all warranties with regard to this software"),
    ("redistributions", "bsd", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("endorse", "bsd-3-clause", 0.9, rf"neither the names? of{SOME % 12} (?:nor|or) the names of its contributors may be used to endorse or promote products"),
    ("advertising", "bsd-4-clause", 0.9, r"all advertising materials mentioning features or use of this software must display"),
    ("redistributions", "bsd", 0.7, r"redistributions in binary form must reproduce the above copyright notice"),
    ("redistributions", "bsd", 0.7, r"redistributions of source code must retain the above copyright notice"),
    ("compliance", "apache-2.0", 1.0, r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("basis", "apache-2.0", 0.7, r"distributed on an as is basis without warranties or conditions of any kind"),
    ("redistribute", "lgpl", 1.0, rf"(?:this|the) (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {LIC}"),
    ("redistribute", "agpl-3.0", 1.0, rf"(?:this|the) (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu affero general public {LIC}"),
    ("redistribute", "gpl", 1.0, rf"(?:this|the) (?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public {LIC}"),
    ("merchantability", "gpl", 0.5, r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("mozilla", "mpl-2.0", 1.0, r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("eclipse", "epl-2.0", 1.0, r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("development", "cddl-1.0", 0.9, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("altered", "zlib", 0.9, r"altered source versions must be plainly marked as such"),
    ("origin", "zlib", 0.8, r"the origin of this software must not be misrepresented"),
    ("boost", "bsl-1.0", 0.9, r"distributed under the boost software license version 1 0"),
    ("unencumbered", "unlicense", 1.0, r"this is free and unencumbered software released into the public domain"),
    ("fuck", "wtfpl", 1.0, r"do what the fuck you want to public license"),
    ("font", "ofl-1.1", 1.0, r"this font software is licensed under the sil open font license"),
    ("dedicated", "cc0-1.0", 0.9, r"dedicated(?: \S++){0,8}? to the public domain"),
    ("public domain", "public-domain", 0.8, r"(?:is|are|placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public domain", "public-domain", 0.5, r"public domain"),
    ("sharealike", "cc-by-nc-sa", 1.0, rf"(?:creative commons )?attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: public)? {LIC}"),
    ("sharealike", "cc-by-sa", 1.0, rf"(?:creative commons )?attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: public)? {LIC}"),
    ("noderivatives", "cc-by-nc-nd", 1.0, rf"(?:creative commons )?attribution non ?commercial no ?derivatives(?: [1234] [05])?(?: international| unported)?(?: public)? {LIC}"),
    ("noderivatives", "cc-by-nd", 1.0, rf"(?:creative commons )?attribution no ?derivatives(?: [1234] [05])?(?: international| unported)?(?: public)? {LIC}"),
    ("noncommercial", "cc-by-nc", 1.0, rf"(?:creative commons )?attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: public)? {LIC}"),
    ("attribution", "cc-by", 1.0, rf"(?:creative commons )?attribution(?: [1234] [05])?(?: international| unported)?(?: public)? {LIC}"),
    ("commons", "creative-commons", 0.5, rf"creative commons(?: {LIC})?"),
    ("commercial only", "non-commercial", 0.6, r"(?:for )?non ?commercial (?:use|purposes) only"),
    ("confidential", "proprietary", 0.8, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("unauthorized", "proprietary", 0.8, rf"unauthorized copying{SOME % 9} is strictly prohibited"),
    ("reproduced", "proprietary", 0.8, r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("agreement", "proprietary", 0.6, r"end user licen[cs]e agreement"),
    ("reserved", "reserved", 0.7, rf"copyright{SOME % 8} all rights reserved"),
    ("reserved", "reserved", 0.5, r"all rights reserved"),
    ("derechos", "reserved", 0.5, r"todos los derechos reservados"),
    ("droits", "reserved", 0.5, r"tous droits r\xc3\xa9serv\xc3\xa9s"),
    ("rechte", "reserved", 0.5, r"alle rechte vorbehalten"),
    ("copyright", "copyright", 0.3, r"copyright (?:c )?(?:19|20)\d\d"),
]
# Needed words that a text may have in other forms; any of them will do.
FORMS = {
    "agpl": "agpl agplv3", "lgpl": "lgpl lgplv2 lgplv3", "bsd": "bsd freebsd", "0bsd": "0bsd zero", "mit": "mit expat", "python": "python psf",
    "openrail": "openrail rail", "cc": "cc commons", "copies": "copies copy", "driver": "driver drivers", "not": "not never no",
    "redistributions": "redistributions redistribution", "sharealike": "sharealike alike", "noderivatives": "noderivatives derivatives",
    "noncommercial": "noncommercial commercial", "commercial": "commercial noncommercial", "license": "license licence licenses licences",
    "under": "under by with through",
}
UNDER = (
    rf"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|used){SOME % 3} (?:under|by|with|through)"
    r"(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)?"
)
# Names that say license themselves.
SAYS_IT = re.compile(r"public|CC|\bcc|unlicense|wtfpl|gpl|database|attribution|distribution|documentation|font|permissive|government|source|elastic")


@dataclass(frozen=True)
class Rule:
    """Where every set of ``gate`` has a word of the text, ``pattern`` is searched for."""

    name: str
    label: str | None
    weight: float
    gate: tuple[frozenset[bytes], ...]
    pattern: re.Pattern[bytes]


def make_rule(name: str, label: str | None, weight: float, needs: str, pattern: str) -> Rule:
    gate = tuple(frozenset(w.encode() for w in FORMS.get(n, n).split()) for n in needs.split())
    return Rule(name, label, weight, gate, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)".encode("latin-1")))


def standard_rules() -> list[Rule]:
    """By priority: what only suppresses, notices, identifiers, addresses, statements of use, names, weak notices."""
    notices = [make_rule(f"notice-{k}", label, weight, needs, pattern) for k, (needs, label, weight, pattern) in enumerate(NOTICES)]
    out = [r for r in notices if r.label is None or r.weight > 0.6]
    out += [make_rule(f"spdx-{k}", f[0], 1.0, "spdx", f"spdx license identifier {f[3]}") for k, f in enumerate(FAMILIES)]
    for k, (label, needs, _, _, address) in enumerate(FAMILIES):
        head = address.split()[0]
        out.append(make_rule(f"address-{k}", label, 0.8, head if head.isalnum() else needs, address))
    out += [make_rule(f"under-{k}", f[0], 0.95, f"{f[1]} under", rf"{UNDER} {f[2]}(?: {LIC})?") for k, f in enumerate(FAMILIES)]
    for k, (label, needs, name, _, _) in enumerate(FAMILIES):
        said, more = (name, "") if SAYS_IT.search(name) else (rf"(?:{name} {LIC}|{LIC} {name})", " license")
        out.append(make_rule(f"name-{k}", label, 0.6, needs + more, said))
    return out + [r for r in notices if r.label is not None and r.weight <= 0.6]


def uncovered(found: list[tuple[int, int, int]], ranks: int) -> list[tuple[int, int, int]]:
    """Of ``(rank, start, end)`` those that lie inside no interval of a smaller rank, in order.

    By start, with the furthest end of each rank kept in a Fenwick tree: n log(ranks) steps, however many overlap.
    """
    tree, out, k = [-1] * (ranks + 1), [], 0
    found = sorted(found, key=lambda f: (f[1], f[2], f[0]))
    while k < len(found):
        stop = k
        while stop < len(found) and found[stop][1] == found[k][1]:
            i = found[stop][0] + 1
            while i <= ranks:
                tree[i] = max(tree[i], found[stop][2])
                i += i & -i
            stop += 1
        for rank, start, end in found[k:stop]:
            i, far = rank, -1
            while i:
                far = max(far, tree[i])
                i -= i & -i
            if far < end:
                out.append((rank, start, end))
        k = stop
    return out


class Scanner:
    """Rules with the words that open them."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = standard_rules() if rules is None else rules
        self._by_word: dict[bytes, list[int]] = {}
        for k, rule in enumerate(self.rules):
            for word in rule.gate[0]:
                self._by_word.setdefault(word, []).append(k)
        self._words = frozenset(w for rule in self.rules for one in rule.gate for w in one)
        self._openers = frozenset(self._by_word)
        self._base = [(label, re.compile(rb"(?<!\S)%s(?!\S)" % phrase.encode())) for phrase, label in BASE.items()]

    def opened(self, words: list[bytes]) -> list[int]:
        """Rules with all their words in the text, by priority."""
        there = self._words.intersection(words)
        rules = {k for w in there & self._openers for k in self._by_word[w]}
        return sorted(k for k in rules if all(one & there for one in self.rules[k].gate))

    def scan(self, text: bytes) -> dict:
        words = text.translate(PLAIN).split()
        ranks = self.opened(words)
        places: list[dict] = []
        kept: list[dict] = []
        if ranks:
            plain = b" ".join(words)
            starts, at = [0], 0
            for word in words:
                at += len(word) + 1
                starts.append(at)
            for label, pattern in self._base:
                places += [{"label": label, "word": bisect_left(starts, m.start())} for m in pattern.finditer(plain)]
            found = [(k, m.start(), m.end()) for k in ranks for m in self.rules[k].pattern.finditer(plain)]
            for rank, start, end in uncovered(found, len(self.rules)):
                rule = self.rules[rank]
                if rule.label is not None:
                    first, last = bisect_left(starts, start), bisect_left(starts, end + 1) - 1
                    kept.append({"rule": rule.name, "label": rule.label, "first_word": first, "last_word": last, "weight": rule.weight})
        best: dict[str, float] = {}
        for d in kept:
            best[d["label"]] = max(best.get(d["label"], 0.0), d["weight"])
        missed = 1.0
        for label in sorted(best):
            missed *= 1.0 - best[label]
        own = {p["label"] for p in places}
        return {
            "n_words": len(words), "places": places, "detections": kept,
            "base_labels": sorted(own), "labels": sorted(own | set(best)), "score": round(1.0 - missed, 6),
        }


_scanners: list[Scanner] = []


def _work(texts: list[bytes]) -> dict[str, list]:
    if not _scanners:
        _scanners.append(Scanner())
    found = [_scanners[0].scan(t) for t in texts]
    return {name: [f[name] for f in found] for name in ("n_words", "places", "detections", "base_labels", "labels", "score")}


def find(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, ``n_words``, ``places`` of the base phrases, ``detections`` that no earlier rule covers, ``base_labels``, ``labels``
    (both sorted, distinct) and ``score``: one less the product over labels of one less the highest weight of a detection.

    A row per row of ``docs``, repeated ones too. A null, empty or blank text has no words, no labels and score 0. Other columns stay
    behind, whatever their names; an empty table gives an empty one. Base phrases are reported wherever they stand, covered or not.
    """
    schema = (
        "n_words bigint, places array<struct<label: string, word: bigint>>, detections array<struct<rule: string, label: string,"
        " first_word: bigint, last_word: bigint, weight: double>>, base_labels array<string>, labels array<string>, score double"
    )
    return over_texts(docs, _work, schema, *keep)
