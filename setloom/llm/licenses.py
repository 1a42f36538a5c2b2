"""Operator 7, license scans: ordered signature rules behind a keyword prefilter.

A text becomes its words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``). The prefilter looks every
word's hash up in a small table of keywords; only rows with one of a rule's keywords have that rule's regular expression
run over their words joined by spaces. The rules: sentences from the texts and notices of licenses, written by hand, and
mentions of some sixty licenses by name, short id and SPDX tag. Detections are word intervals; one that lies inside a longer
one is suppressed, and of equal intervals all but the one of highest priority; a sweep over the sorted intervals
finds them. Everything is one map over the rows.

The base phrases are counted at every place, suppressed by nothing. The score is the certainty that the text
carries license terms: 1 - product of (1 - weight) over its labels.

Defined results: null texts have no words, no places and empty labels; equal rows give equal results; places are
counted by row, never across rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setloom.llm.common import ALNUM_SEP, LOWER, text_blocks, words_of
from setloom.shipping import ship

BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int  # lower goes first
    keywords: tuple[str, ...]  # every match has one of these words
    pattern: str  # over words joined by single spaces
    weight: float


#: label, short id as words, name as words, keywords (the name has one), versions
LICENSES = (
    ("apache", "apache", "apache(?: software)?", ("apache",), ("2.0", "1.1", "1.0")),
    ("mit", "mit", "(?:mit|expat)", ("mit", "expat"), ()),
    ("mit-0", "mit 0", "mit no attribution", ("mit",), ()),
    ("isc", "isc", "isc", ("isc",), ()),
    ("bsd-2-clause", "bsd 2 clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", ("bsd", "freebsd"), ()),
    ("bsd-3-clause", "bsd 3 clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", ("bsd",), ()),
    ("bsd-4-clause", "bsd 4 clause", "(?:bsd 4 clause|4 clause bsd|original bsd)", ("bsd",), ()),
    ("0bsd", "0bsd", "(?:0bsd|zero clause bsd|bsd zero clause)", ("0bsd", "bsd"), ()),
    ("bsd", "bsd", "(?:bsd|berkeley software distribution)", ("bsd", "berkeley"), ()),
    ("gpl", "gpl", "(?:gnu )?(?:general public|gpl)", ("general", "gpl"), ("3.0", "3", "2.0", "2", "1.0")),
    ("lgpl", "lgpl", "(?:gnu )?(?:lesser general public|library general public|lgpl)", ("lesser", "library", "lgpl"), ("3.0", "3", "2.1", "2.0", "2")),
    ("agpl", "agpl", "(?:gnu )?(?:affero general public|agpl)", ("affero", "agpl"), ("3.0", "3", "1.0")),
    ("fdl", "gfdl", "(?:gnu )?free documentation", ("documentation",), ("1.3", "1.2", "1.1")),
    ("mpl", "mpl", "mozilla public", ("mozilla",), ("2.0", "1.1", "1.0")),
    ("epl", "epl", "eclipse public", ("eclipse",), ("2.0", "1.0")),
    ("edl", "edl", "eclipse distribution", ("eclipse",), ("1.0",)),
    ("cpl", "cpl", "common public", ("common",), ("1.0",)),
    ("cpal", "cpal", "common public attribution", ("common",), ("1.0",)),
    ("ipl", "ipl", "ibm public", ("ibm",), ("1.0",)),
    ("cddl", "cddl", "common development and distribution", ("distribution",), ("1.1", "1.0")),
    ("eupl", "eupl", "european union public", ("european",), ("1.2", "1.1", "1.0")),
    ("osl", "osl", "open software", ("software",), ("3.0", "2.1", "2.0", "1.0")),
    ("afl", "afl", "academic free", ("academic",), ("3.0", "2.1", "2.0", "1.2")),
    ("artistic", "artistic", "artistic", ("artistic",), ("2.0", "1.0")),
    ("zlib", "zlib", "zlib(?: libpng)?", ("zlib",), ()),
    ("libpng", "libpng", "(?:libpng|png reference library)", ("libpng", "png"), ("2.0",)),
    ("boost", "bsl", "boost software", ("boost",), ("1.0",)),
    ("bsl", "busl", "business source", ("business",), ("1.1",)),
    ("sspl", "sspl", "server side public", ("server",), ("1.0",)),
    ("elastic", "elastic", "elastic", ("elastic",), ("2.0",)),
    ("unlicense", "unlicense", "(?:the )?unlicense", ("unlicense",), ()),
    ("wtfpl", "wtfpl", "(?:wtfpl|do what the fuck you want to public)", ("wtfpl", "fuck"), ("2",)),
    ("odbl", "odbl", "open (?:data commons open )?database", ("database",), ("1.0",)),
    ("odc-by", "odc by", "open data commons attribution", ("commons",), ("1.0",)),
    ("pddl", "pddl", "public domain dedication and", ("dedication",), ("1.0",)),
    ("cdla", "cdla", "community data", ("community",), ("2.0", "1.0")),
    ("python", "python", "python software foundation", ("python",), ("2",)),
    ("php", "php", "php", ("php",), ("3.01", "3.0")),
    ("ruby", "ruby", "ruby", ("ruby",), ()),
    ("perl", "artistic perl", "perl", ("perl",), ()),
    ("tcl", "tcl", "(?:tcl|tcl tk)", ("tcl",), ()),
    ("vim", "vim", "vim", ("vim",), ()),
    ("postgresql", "postgresql", "postgresql", ("postgresql",), ()),
    ("openssl", "openssl", "(?:openssl|ssleay)", ("openssl", "ssleay"), ()),
    ("curl", "curl", "curl", ("curl",), ()),
    ("x11", "x11", "(?:x11|x consortium)", ("x11", "consortium"), ()),
    ("ntp", "ntp", "ntp", ("ntp",), ()),
    ("hpnd", "hpnd", "historical permission notice and disclaimer", ("historical",), ()),
    ("ncsa", "ncsa", "university of illinois(?: ncsa)?(?: open source)?", ("illinois",), ()),
    ("ecl", "ecl", "educational community", ("educational",), ("2.0", "1.0")),
    ("upl", "upl", "universal permissive", ("universal",), ("1.0",)),
    ("blueoak", "blueoak", "blue oak model", ("oak",), ("1.0",)),
    ("ofl", "ofl", "(?:sil )?open font", ("font",), ("1.1", "1.0")),
    ("lppl", "lppl", "latex project public", ("latex",), ("1.3", "1.2", "1.0")),
    ("ms-pl", "ms pl", "microsoft public", ("microsoft",), ()),
    ("ms-rl", "ms rl", "microsoft reciprocal", ("microsoft",), ()),
    ("apsl", "apsl", "apple public source", ("apple",), ("2.0", "1.2")),
    ("sleepycat", "sleepycat", "sleepycat", ("sleepycat",), ()),
    ("watcom", "watcom", "sybase open watcom public", ("watcom",), ("1.0",)),
    ("qpl", "qpl", "q public", ("q",), ("1.0",)),
    ("ogl", "ogl uk", "open government", ("government",), ("3.0", "2.0", "1.0")),
    ("cecill", "cecill", "cecill(?: free software)?", ("cecill",), ("2.1", "2.0")),
    ("mulan", "mulanpsl", "mulan permissive software", ("mulan",), ("2.0", "1.0")),
    ("json", "json", "json", ("json",), ()),
    ("beerware", "beerware", "beer ?ware", ("beerware", "beer"), ()),
)
_UNDER = "(?:licensed|released|distributed|available|published|covered|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
#: Mentions of a license: pattern around its name {n}, id {i} and version {v}; more keywords; weight.
MENTIONS = (
    (_UNDER + "{n} licen[sc]es?{v}", 0.95),
    (_UNDER + "{n}{v}", 0.9),
    ("{n} licen[sc]e{v}", 0.8),
    ("spdx license identifier {i}{w}(?: or later| only)?", 0.98),
)
CC_PARTS = ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")
CC_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0", "")
#: Sentences from the texts and notices of licenses, without A-Z and punctuation: label, keyword, pattern, weight.
SENTENCES = (
    ("apache-2.0", "apache", "www apache org licenses license 2 0", 0.98),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "contributor", "each contributor hereby grants to you a perpetual worldwide", 0.95),
    ("apache-2.0", "notice", "a readable copy of the attribution notices contained within such notice file", 0.98),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 0.9),
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    ("mit", "copies", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies", 0.95),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.98),
    ("isc", "permission", "provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 0.98),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.98),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 0.98),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission", 0.95),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display", 0.98),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.98),
    ("gpl", "gnu", "you should have received a copy of the gnu general public license", 0.95),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu", 0.9),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license", 0.98),
    ("gpl-2.0", "version", "either version 2 of the license or at your option any later version", 0.85),
    ("gpl-3.0", "version", "either version 3 of the license or at your option any later version", 0.85),
    ("lgpl", "lesser", "you should have received a copy of the gnu lesser general public license", 0.95),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify it", 0.9),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license", 0.95),
    ("agpl", "remotely", "interacting with it remotely through a computer network", 0.9),
    ("fdl", "invariant", "with no invariant sections", 0.9),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.98),
    ("mpl", "mozilla", "mozilla org mpl", 0.9),
    ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", 0.98),
    ("cddl", "cddl", "use is subject to license terms of the cddl", 0.9),
    ("eupl", "eupl", "licensed under the eupl", 0.95),
    ("artistic", "artistic", "under the same terms as perl itself the artistic license", 0.95),
    ("perl", "perl", "under the same terms as perl itself", 0.9),
    ("zlib", "altered", "altered source versions must be plainly marked as such", 0.98),
    ("zlib", "warranty", "provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 0.98),
    ("boost", "boost", "www boost org license 1 0", 0.98),
    ("boost", "reproduce", "to use reproduce display distribute execute and transmit the software", 0.95),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0.98),
    ("unlicense", "unlicense", "unlicense org", 0.9),
    ("wtfpl", "fuck", "you just do what the fuck you want to", 0.95),
    ("beerware", "beer", "you can buy me a beer in return", 0.95),
    ("postgresql", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose without fee", 0.9),
    ("openssl", "openssl", "this product includes software developed by the openssl project", 0.95),
    ("openssl", "cryptographic", "this product includes cryptographic software written by eric young", 0.95),
    ("python", "python", "psf is making python available to licensee on an as is basis", 0.98),
    ("ncsa", "illinois", "neither the names of the university of illinois", 0.9),
    ("json", "evil", "the software shall be used for good not evil", 0.98),
    ("ofl", "font", "this font software is licensed under the sil open font license", 0.98),
    ("ofl", "reserved", "reserved font name", 0.7),
    ("lppl", "latex", "www latex project org lppl", 0.95),
    ("sspl", "mongodb", "mongodb inc server side public license", 0.95),
    ("elastic", "hosted", "you may not provide the (?:products|software) to (?:others|third parties) as a hosted or managed service", 0.7),
    ("bsl", "change", "change date .{0,40}change license", 0.8),
    ("odbl", "database", "made available under the open database license", 0.95),
    ("odbl", "opendatacommons", "opendatacommons org licenses odbl", 0.98),
    ("odc-by", "opendatacommons", "opendatacommons org licenses by", 0.98),
    ("pddl", "opendatacommons", "opendatacommons org licenses pddl", 0.98),
    ("ogl", "nationalarchives", "nationalarchives gov uk doc open government licence", 0.98),
    ("ogl", "sector", "contains public sector information licensed under the open government licence", 0.98),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", 0.9),
    ("cc0", "zero", "creative commons zero", 0.9),
    ("cc0", "creativecommons", "creativecommons org publicdomain zero(?: 1 0)?", 0.98),
    ("cc0", "neighboring", "(?:has|have) (?:dedicated|waived) all copyright and related or neighboring rights", 0.95),
    ("cc-pdm", "creativecommons", "creativecommons org publicdomain mark(?: 1 0)?", 0.95),
    ("creative-commons", "creative", "creative commons(?: attribution)?(?: non ?commercial)?(?: no ?deriv(?:ative)?s)?(?: share ?alike)?(?: licen[sc]e)?", 0.7),
    ("creative-commons", "creativecommons", "creativecommons org", 0.7),
    ("creative-commons", "creative", "some rights reserved creative commons", 0.8),
    ("public-domain", "domain", "(?:in|into|to) the public domain", 0.7),
    ("public-domain", "domain", "public domain(?: work| mark| dedication)", 0.6),
    ("public-domain", "domain", "no known copyright restrictions public domain", 0.8),
    ("copyright", "copyright", "copyright (?:c |by )?(?:\\d{4})(?: \\d{4})?", 0.6),
    ("copyright", "copyrighted", "copyrighted (?:material|work|content)", 0.5),
    ("copyright", "reserved", "(?:all|some|no) rights reserved", 0.6),
    ("copyright", "reproduced", "(?:may not|no part .{0,40}may) be reproduced (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission", 0.7),
    ("copyright", "liable", "the copyright holders? (?:and contributors )?be liable", 0.6),
    ("proprietary", "proprietary", "(?:proprietary and confidential|confidential and proprietary)", 0.7),
    ("proprietary", "confidential", "this (?:document|file|software) (?:is|contains) confidential (?:information|material)?", 0.6),
    ("proprietary", "unauthorized", "unauthorized (?:copying|use|distribution|reproduction)(?: of this (?:file|software|document|work))? (?:via any medium )?is (?:strictly )?prohibited", 0.8),
    ("proprietary", "internal", "for internal use only", 0.5),
    ("proprietary", "evaluation", "(?:for )?evaluation (?:purposes|use) only", 0.5),
    ("eula", "agreement", "end user licen[sc]e agreement", 0.7),
    ("eula", "reverse", "you (?:may|shall|will) not (?:modify )?(?:decompile )?reverse engineer", 0.7),
    ("non-commercial", "commercial", "(?:for )?non commercial (?:use|purposes) only", 0.6),
    ("non-commercial", "noncommercial", "(?:for )?noncommercial (?:use|purposes) only", 0.6),
    ("academic-use", "academic", "(?:for )?academic (?:use|purposes|and research use) only", 0.6),
    ("academic-use", "research", "(?:for )?research (?:use|purposes) only", 0.6),
    ("open-access", "access", "this is an open access article distributed under the terms of", 0.8),
    ("press", "broadcast", "this material may not be published broadcast rewritten or redistributed", 0.7),
    ("press", "syndication", "for syndication rights contact", 0.5),
    ("warranty", "warranty", "without warranty of any kind", 0.6),
    ("warranty", "warranties", "without warranties or conditions of any kind", 0.6),
    ("warranty", "merchantability", "(?:implied )?warrant(?:y|ies) of merchantability", 0.6),
    ("warranty", "liable", "in no event shall the (?:authors?|copyright (?:owner|holders?)) (?:or .{0,30})?be liable", 0.6),
    ("attribution", "credit", "(?:you must )?give appropriate credit", 0.5),
    ("attribution", "attribution", "attribution (?:is )?required", 0.5),
    ("share-alike", "remix", "if you remix transform or build upon the material", 0.7),
    ("dual", "dual", "dual licensed under", 0.6),
    ("patent", "patent", "patent license to make have made use offer to sell sell import", 0.7),
)


@cache
def signatures() -> tuple[Signature, ...]:
    """All rules, each pattern once; of equal patterns the first label."""
    out: dict[str, Signature] = {}

    def add(label: str, priority: int, keywords: tuple[str, ...], pattern: str, weight: float) -> None:
        pattern = rf"(?<!\S)(?:{pattern})(?!\S)"
        out.setdefault(pattern, Signature(label, priority, keywords, pattern, weight))

    for label, key, pattern, weight in SENTENCES:
        add(label, 5, (key,), pattern, weight)
    for label, short, name, keys, versions in LICENSES:
        for i, (form, weight) in enumerate(MENTIONS):
            for k, version in enumerate((*versions, "")):
                own = f"{label}-{version}" if version else label
                words = version.replace(".", " ")
                v = f" (?:v ?|version )?{words}" if version else ""
                add(own, 10 * i + k, ("spdx",) if "{i}" in form else keys, form.format(n=name, i=short, v=v, w=f" {words}" if version else ""), weight)
        for k, version in enumerate(versions):  # the short id with a version
            add(f"{label}-{version}", 40 + k, (short.split()[0],), f"{short} (?:v ?)?{version.replace('.', ' ')}", 0.7)
    for i, part in enumerate(CC_PARTS):
        for k, v in enumerate(CC_VERSIONS):
            label = "cc-" + part.replace(" ", "-") + ("-" + v.replace(" ", ".") if v else "")
            add(label, 10 * i + k, ("cc",), f"cc {part}{' ' + v if v else ''}", 0.9)
            if part != "by" or v:
                add(label, 10 * i + k, ("creativecommons",), f"creativecommons org licenses {part}{' ' + v if v else ''}", 0.95)
    return tuple(out.values())


def word_hashes(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    data = np.frombuffer(raw, np.uint8)
    return words_of(LOWER[data], np.array([0, len(raw)]), ALNUM_SEP)[3]


class Scanner:
    """The compiled rules, and the keyword table of the prefilter."""

    def __init__(self) -> None:
        self.rules = [(s, re.compile(s.pattern)) for s in signatures()]
        by: dict[str, list[int]] = {}
        for i, (s, _) in enumerate(self.rules):
            for k in s.keywords:
                by.setdefault(k, []).append(i)
        keys = sorted(by)
        h = word_hashes(keys)
        order = np.argsort(h)
        self.hashes = h[order]
        self.rules_of = [by[keys[i]] for i in order]
        self.map = np.zeros(1 << 16, bool)
        self.map[self.hashes >> np.uint64(48)] = True
        self.phrases = [word_hashes(p.split()) for p, _ in BASE_PHRASES]

    def detections(self, words: list[str], rules: set[int]) -> list[tuple[int, int, Signature]]:
        """Word intervals (first, last + 1) of the rules' matches that nothing suppresses."""
        text = " ".join(words)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        found: list[tuple[int, int, int, str, Signature]] = []
        for i in sorted(rules):
            s, pattern = self.rules[i]
            places = [m.span() for m in pattern.finditer(text)]
            if places:
                first, last = np.searchsorted(starts, np.array(places).T)
                found += [(a, -b, s.priority, s.label, s) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        # By start, the longest first: what ends before something earlier does lies inside it.
        kept, reach = [], -1
        for a, b, _, _, s in sorted(found, key=lambda x: x[:4]):
            if -b > reach:
                kept.append((a, -b, s))
                reach = -b
        return kept

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """Of each row: n_words, n_base, first_word, last_word, base labels, detections."""
        low = LOWER[data]
        starts, ends, counts, h = words_of(low, offsets, ALNUM_SEP)
        n = len(offsets) - 1
        places: list[list[int]] = [[] for _ in range(n)]
        labels: list[set[str]] = [set() for _ in range(n)]
        for p, (_, label) in zip(self.phrases, BASE_PHRASES, strict=True):
            m = len(h) - len(p) + 1
            if m <= 0:
                continue
            at = np.flatnonzero(h[:m] == p[0])
            for j in range(1, len(p)):
                at = at[h[at + j] == p[j]]
            row = np.searchsorted(counts, at, side="right") - 1
            for r, w, fits in zip(row.tolist(), at.tolist(), (at + len(p) <= counts[row + 1]).tolist(), strict=True):
                if fits:
                    places[r].append(w - int(counts[r]))
                    labels[r].add(label)
        at = np.flatnonzero(self.map[h >> np.uint64(48)]) if len(h) else np.zeros(0, np.int64)
        key = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[key] == h[at]
        row = np.searchsorted(counts, at[ok], side="right") - 1
        rules: dict[int, set[int]] = {}
        for r, k in set(zip(row.tolist(), key[ok].tolist(), strict=True)):
            rules.setdefault(r, set()).update(self.rules_of[k])
        out = []
        for r in range(n):
            found: list = []
            if r in rules:
                words = [bytes(low[a:b]).decode("utf-8", "replace") for a, b in zip(starts[counts[r] : counts[r + 1]], ends[counts[r] : counts[r + 1]], strict=True)]
                found = self.detections(words, rules[r])
            p = places[r]
            out.append((int(counts[r + 1] - counts[r]), len(p), min(p, default=None), max(p, default=None), sorted(labels[r]), found))
        return out


_FOUND = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64())]))
_ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_list", T.ArrayType(T.StringType())),
    T.StructField("detections", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("priority", T.IntegerType()), T.StructField("weight", T.DoubleType())]))),
])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, word counts, base places and labels, and the detections that stay (label, word interval, priority)."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], *_ADDED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            rows = [x for _, _, data, offsets in text_blocks(b.column("text")) for x in scanner.block(data, offsets)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            found = [[{"label": s.label, "first": a, "last": z, "priority": s.priority, "weight": s.weight} for a, z, s in x] for x in cols[5]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(list(c), pa.int64()) for c in cols[:4]), pa.array(list(cols[4]), pa.list_(pa.string())), pa.array(found, _FOUND)], ["doc_id", *_ADDED.names])

    return slim.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """The op7 result."""
    every = F.array_sort(F.array_distinct(F.concat("base_list", F.transform("detections", lambda d: d["label"]))))
    weight = lambda x: F.array_max(F.transform(F.filter("detections", lambda d: d["label"] == x), lambda d: d["weight"]))
    miss = F.aggregate(every, F.lit(1.0), lambda a, x: a * (1.0 - F.coalesce(weight(x), F.lit(0.5))))
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.round(1.0 - miss, 6).alias("score"))


def brute_detections(text: str | None) -> list[tuple[int, int, str]]:
    """First word, last word + 1 and label of what stays, in plain Python, for tests: every rule, every pair of intervals."""
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined, found = " ".join(words), []
    for s in signatures():
        for m in re.finditer(s.pattern, joined):
            a, b = joined[: m.start()].count(" "), joined[: m.end()].count(" ") + 1
            found.append((a, b, s.priority, s.label))
    return sorted({(a, b, label) for a, b, p, label in found if not any(c <= a and b <= d and (d - c > b - a or (q, other) < (p, label)) for c, d, q, other in found)})


def brute_force(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base labels in plain Python, for tests."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    at = [(i, label) for p, label in BASE_PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))
