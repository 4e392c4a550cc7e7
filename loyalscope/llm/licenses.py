"""License scans: ordered signature rules over a text's normalised words.

A text becomes its words (ASCII lower case; ASCII letters, digits and everything beyond ASCII) joined by
one space. Rules are regular expressions over that string. A rule runs only if its own keywords stand in
the text; every keyword is looked for once a text, so ordinary documents cost about a hundred substring
searches. Every match is an interval of words with the rule's priority; a match that lies within one of
a higher priority (or of the same priority and longer) is suppressed: "GNU Lesser General Public License"
is not also the general one. The places of the base phrases are counted apart from the rules and stay.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loyalscope.llm.common import Memo, raw_texts, worker_cache

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Hand-written: (label, name as a pattern of words, SPDX identifier as words, the name's keyword).
NAMES = (
    ("mit", r"(?:mit|expat|x11)", "mit", "mit|expat|x11"),
    ("mit-0", r"mit (?:no attribution|0)", "mit 0", "mit"),
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version)? (?:v ?)?2(?: 0)?", "apache 2 0", "apache"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? (?:v ?)?1 1", "apache 1 1", "apache"),
    ("apache", r"apache(?: software)?", "apache", "apache"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause", "bsd 2 clause", "bsd"),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause", "bsd 3 clause", "bsd"),
    ("bsd-4-clause", r"(?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause", "bsd 4 clause", "bsd"),
    ("0bsd", r"(?:zero clause bsd|0bsd|bsd zero clause)", "0bsd", "bsd|0bsd"),
    ("bsd", r"(?:berkeley software distribution|bsd(?: style)?)", "bsd", "bsd|berkeley"),
    ("isc", r"(?:isc|internet systems consortium)", "isc", "isc|consortium"),
    ("gpl-2.0", r"(?:gnu )?(?:gpl|general public license)(?: version)? ?v?2(?: 0)?", "gpl 2 0", "gpl|general"),
    ("gpl-3.0", r"(?:gnu )?(?:gpl|general public license)(?: version)? ?v?3(?: 0)?", "gpl 3 0", "gpl|general"),
    ("gpl", r"(?:gnu (?:gpl|general public)|gpl|general public)", "gpl", "gpl|general"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)(?: version)? ?v?2 1", "lgpl 2 1", "lgpl|lesser|library"),
    ("lgpl-3.0", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version)? ?v?3(?: 0)?", "lgpl 3 0", "lgpl|lesser"),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public)", "lgpl", "lgpl|lesser|library"),
    ("agpl-3.0", r"(?:gnu )?(?:agpl|affero general public license)(?: version)? ?v?3(?: 0)?", "agpl 3 0", "agpl|affero"),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public)", "agpl", "agpl|affero"),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation)", "gfdl", "gfdl|documentation"),
    ("mpl-1.1", r"(?:mpl|mozilla public license)(?: version)? ?v?1 1", "mpl 1 1", "mpl|mozilla"),
    ("mpl-2.0", r"(?:mpl|mozilla public license)(?: version)? ?v?2(?: 0)?", "mpl 2 0", "mpl|mozilla"),
    ("mpl", r"(?:mpl|mozilla public)", "mpl", "mpl|mozilla"),
    ("epl-1.0", r"(?:epl|eclipse public license)(?: version)? ?v?1 0", "epl 1 0", "epl|eclipse"),
    ("epl-2.0", r"(?:epl|eclipse public license)(?: version)? ?v?2(?: 0)?", "epl 2 0", "epl|eclipse"),
    ("epl", r"(?:epl|eclipse public)", "epl", "epl|eclipse"),
    ("cddl", r"(?:cddl|common development and distribution)", "cddl 1 0", "cddl|development"),
    ("cpl", r"(?:common public)", "cpl 1 0", "common"),
    ("eupl", r"(?:eupl|european union public)", "eupl 1 2", "eupl|european"),
    ("artistic", r"(?:perl )?artistic", "artistic 2 0", "artistic"),
    ("zlib", r"(?:zlib(?: libpng)?)", "zlib", "zlib"),
    ("boost", r"(?:boost(?: software)?|bsl)", "bsl 1 0", "boost|bsl"),
    ("python", r"(?:python(?: software foundation)?|psf)", "python 2 0", "python|psf"),
    ("ruby", r"ruby", "ruby", "ruby"),
    ("php", r"php", "php 3 01", "php"),
    ("postgresql", r"postgresql", "postgresql", "postgresql"),
    ("openssl", r"openssl", "openssl", "openssl"),
    ("unlicense", r"(?:unlicense)", "unlicense", "unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl", "wtfpl|fuck"),
    ("cc0", r"(?:cc0|cc zero|creative commons zero)", "cc0 1 0", "cc0|zero"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative|s|atives))", "cc by nc nd 4 0", "cc|commons"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", "cc by nc sa 4 0", "cc|commons"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)", "cc by nc 4 0", "cc|commons"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative|s|atives))", "cc by nd 4 0", "cc|commons"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)", "cc by sa 4 0", "cc|commons"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "cc by 4 0", "cc|commons"),
    ("odbl", r"(?:odbl|open database)", "odbl 1 0", "odbl|database"),
    ("pddl", r"(?:pddl|public domain dedication and)", "pddl 1 0", "pddl|dedication"),
    ("ofl", r"(?:sil )?(?:ofl|open font)", "ofl 1 1", "ofl|font"),
    ("ms-pl", r"(?:ms pl|microsoft public)", "ms pl", "ms|microsoft"),
    ("ms-rl", r"(?:ms rl|microsoft reciprocal)", "ms rl", "ms|microsoft"),
    ("upl", r"(?:upl|universal permissive)", "upl 1 0", "upl|universal"),
    ("sspl", r"(?:sspl|server side public)", "sspl 1 0", "sspl|server"),
    ("bsl", r"(?:business source)", "busl 1 1", "business"),
    ("elastic", r"elastic", "elastic 2 0", "elastic"),
    ("openrail", r"(?:open ?rail(?: m)?|responsible ai)", "openrail", "rail|openrail|responsible"),
)
#: Names that are also products, institutes or plain words: a grant needs "licensed", the word license, or "under" with a version.
BARE = {"mit", "apache", "isc", "artistic", "zlib", "boost", "python", "ruby", "php", "postgresql", "openssl", "elastic", "cpl", "bsl", "odbl", "openrail"}
BARE_GRANT = (r"(?:licensed (?:to you )?under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?"
              r"|(?:released|distributed|available|published|provided|redistributed|covered|made available) (?:to you )?"
              r"(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{name}) licen[cs]e"
              r"|(?:released|distributed|available|published|provided|redistributed|covered|made available) (?:to you )?"
              r"under (?:the )?(?:terms of )?(?:the )?(?:{name}) (?:version )?v? ?\d+(?: \d+)?)(?: version \d+(?: \d+)?)?")
# Hand-written templates: (what, pattern around the name, keyword, priority, confidence).
TEMPLATES = (
    ("spdx", r"spdx license identifier {spdx}(?: only| or later)?", "spdx", 60, 1.0),
    ("grant", r"(?:licensed|released|distributed|available|published|provided|redistributed|covered|made available) (?:to you )?"
              r"(?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?(?: version \d+(?: \d+)?)?", "under|by", 50, 0.95),
    ("title", r"(?:the )?(?:{name}) licen[cs]e(?: (?:version|v) ?\d+(?: \d+)?)?(?: or (?:any )?later(?: version)?)?", "license|licence", 40, 0.85),
    ("terms", r"(?:terms|conditions|copy|text|version) of (?:the )?(?:{name})(?: licen[cs]e)", "of", 45, 0.9),
    ("version", r"(?:the )?(?:{name})(?: licen[cs]e)?(?: only| or (?:any )?later(?: version)?)?", "", 43, 0.8),
    ("field", r"licen[cs]e (?:is |type |name |id )?(?:the )?(?:{name})", "license|licence", 35, 0.75),
)
# Hand-written: sentences of license texts (label, pattern, keyword, priority, confidence).
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby", 80, 1.0),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby", 80, 1.0),
    ("bsd", r"redistributions? (?:and use )?(?:of|in) source (?:code|and binary forms)(?: must retain the above copyright notice)?", "source", 70, 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "binary", 70, 0.95),
    ("bsd-3-clause", r"neither the name of .{0,120}? nor the names of its contributors may be used to endorse or promote", "neither", 80, 0.95),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", "advertising", 80, 0.95),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", 60, 0.9),
    ("apache-2.0", r"www apache org licenses license 2 0", "apache", 75, 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu", 85, 1.0),
    ("gpl", r"www gnu org (?:licenses|copyleft) gpl", "gnu", 70, 0.95),
    ("lgpl", r"www gnu org (?:licenses|copyleft) lgpl", "gnu", 70, 0.95),
    ("agpl", r"www gnu org licenses agpl", "gnu", 70, 0.95),
    ("gpl-later", r"either version \d+ of the license or at your option any later version", "option", 80, 0.9),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla", 85, 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "authors", 70, 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 85, 1.0),
    ("boost", r"www boost org license 1 0", "boost", 75, 0.95),
    ("cc", r"creativecommons org licenses [a-z]+(?: [a-z]+){0,2}(?: \d \d)?", "creativecommons", 65, 0.9),
    ("cc0", r"creativecommons org publicdomain zero(?: 1 0)?", "creativecommons", 70, 0.95),
    ("cc", r"(?:some rights reserved|creative commons)(?: licen[cs]e)?", "commons|some", 20, 0.6),
    ("public-domain", r"(?:in|into|to|as) the public domain", "public", 30, 0.7),
    ("public-domain", r"public domain (?:dedication|work|mark)", "public", 35, 0.8),
    ("copyleft", r"copyleft(?: licen[cs]e)?", "copyleft", 15, 0.5),
    ("all-rights-reserved", r"all rights reserved(?: worldwide)?", "reserved", 25, 0.6),
    ("copyright", r"copyright (?:c )?(?:\d{4}(?: \d{4})*)(?: (?:by )?[a-z]+){0,3}", "copyright", 10, 0.4),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", "proprietary", 40, 0.7),
    ("proprietary", r"(?:contains|constitutes?) (?:valuable )?trade secrets?", "secret|secrets", 40, 0.7),
    ("proprietary", r"(?:unauthorized|unauthorised) (?:copying|use|reproduction|redistribution) .{0,60}? (?:strictly )?prohibited", "prohibited", 30, 0.6),
    ("proprietary", r"may not be (?:copied|reproduced|redistributed)(?: or [a-z]+)* without (?:the )?(?:prior )?(?:written )?permission", "permission", 40, 0.7),
    ("permission-required", r"(?:with|by) (?:kind |written |prior )*permission (?:of|from)", "permission", 15, 0.4),
    ("eula", r"end user licen[cs]e agreement", "user", 45, 0.8),
    ("commercial", r"commercial licen[cs]e(?: agreement)?", "commercial", 30, 0.6),
    ("non-commercial", r"(?:for )?(?:non ?commercial|personal|educational) use only", "use only", 20, 0.5),
    ("dual", r"dual licen[cs]ed", "dual", 20, 0.5),
    ("as-is", r"provided as is without (?:any )?warrant(?:y|ies)", "warranty|warranties", 12, 0.4),
)


class Rule(NamedTuple):
    label: str
    name: str
    pattern: re.Pattern
    keywords: tuple[tuple[bytes, ...], ...]      # one of each must begin a word of the text
    priority: int
    confidence: float


def rules() -> tuple[Rule, ...]:
    """All rules, by priority. Several hundred: every name under every template, and the texts."""
    def rule(label, name, pattern, keywords, priority, confidence):
        compiled = re.compile(rb" (?:" + pattern.encode() + rb")(?= )")
        return Rule(label, name, compiled, tuple(tuple(b" " + k.encode() for k in ks.split("|")) for ks in keywords), priority, confidence)

    out = [rule(label, f"text{i}", pattern, (word,), priority, confidence)
           for i, (label, pattern, word, priority, confidence) in enumerate(TEXTS)]
    for label, name, spdx, word in NAMES:
        for what, template, around, priority, confidence in TEMPLATES:
            if what == "version" and not label[-1].isdigit():      # a bare name says little
                continue
            specific = 5 * (any(c.isdigit() for c in label) or "nc" in label or "sa" in label or label in ("lgpl", "agpl", "cc-by-nd"))
            keywords = (around,) if what == "spdx" else (around, word)
            if what == "grant" and label in BARE:
                template = BARE_GRANT
            out.append(rule(label, what, template.format(name=name, spdx=spdx), keywords, priority + specific, confidence))
    return tuple(sorted(out, key=lambda r: -r.priority))


def gates() -> tuple[tuple[tuple[bytes, ...], tuple[tuple[tuple[bytes, ...], Rule], ...]], ...]:
    """Rules by their last keywords (the name's, if there is one), each with its other keywords."""
    out: dict[tuple[bytes, ...], list] = {}
    for r in rules():
        out.setdefault(r.keywords[-1], []).append((r.keywords[0], r))
    return tuple((last, tuple(own)) for last, own in out.items())


# ASCII capitals become small; other ASCII beside letters and digits becomes a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normalise(raw: bytes) -> list[bytes]:
    return raw.translate(TABLE).split()


def _word_at(text: bytes, places: list[int]) -> list[int]:
    """Which word begins after the space at each place of `` word word ... ``."""
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return np.searchsorted(spaces, places).tolist()


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(word, label) of every place of every base phrase in `` word word ... ``, overlaps included."""
    found = []
    for phrase, label in BASE:
        wanted = f" {phrase} ".encode()
        at = text.find(wanted)
        while at >= 0:
            found.append((at, label))
            at = text.find(wanted, at + 1)
    found.sort()
    return list(zip(_word_at(text, [at for at, _ in found]), (label for _, label in found))) if found else []


def unsuppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Matches that lie within no match of a higher priority, nor of their own priority that is longer."""
    kept: list[tuple[int, int, Rule]] = []
    for priority in sorted({r.priority for *_, r in found}, reverse=True):
        above = sorted((lo, hi) for lo, hi, _ in kept)
        starts, reach = np.array([x[0] for x in above]), np.maximum.accumulate(np.array([x[1] for x in above] or [0]))
        own, far = sorted((f for f in found if f[2].priority == priority), key=lambda f: (f[0], -f[1], f[2].label, f[2].name)), -1
        for lo, hi, r in own:
            i = int(np.searchsorted(starts, lo, side="right"))
            if hi > far and not (i and reach[i - 1] >= hi):
                kept.append((lo, hi, r))
            far = max(far, hi)
    return kept


def detections(text: bytes, gated=None) -> list[tuple[int, int, Rule]]:
    """(first word, end word, rule) of the matches that no other match suppresses."""
    found, seen = [], Memo(text.__contains__, 10_000)
    for last, own in gated or gates():
        if any(seen[k] for k in last):
            for first, r in own:
                if any(seen[k] for k in first):
                    found += [(m.start() + 1, m.end(), r) for m in r.pattern.finditer(text)]
    if not found:
        return []
    kept = unsuppressed(found)
    if not kept:
        return []
    starts, ends = (_word_at(text, x) for x in ([lo - 1 for lo, *_ in kept], [hi for _, hi, _ in kept]))
    return sorted(((a, b, r) for a, b, (*_, r) in zip(starts, ends, kept)), key=lambda d: (d[0], d[1], d[2].label, d[2].name))


def _scan(batches):
    gated = worker_cache("licenses", "gates", gates)
    for batch in batches:
        n, base, found = [], [], []
        for raw in raw_texts(batch.column(1)):
            words = normalise(raw)
            n.append(len(words))
            text = b" " + b" ".join(words) + b" "
            base.append([{"word": w, "label": label} for w, label in base_places(text)])
            found.append([{"start": a, "end": b, "label": r.label, "rule": r.name, "confidence": r.confidence} for a, b, r in detections(text, gated)])
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(n, pa.int64()), pa.array(base, pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
            pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()),
                                                ("confidence", pa.float64())])))], names=["id", "n_words", "base", "found"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``base`` (word, label of every place of a base phrase) and ``found`` per row.

    ``found``: the rules' detections that are not suppressed, as word intervals with label, rule and
    confidence. NULL or empty text: no words, nothing found. Whole texts are scanned; repeated rows and
    NULL ids pass through.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_scan, (
        f"id {kind}, n_words long, base array<struct<word: long, label: string>>, "
        "found array<struct<start: long, end: long, label: string, rule: string, confidence: double>>")).withColumnRenamed("id", id_col)
