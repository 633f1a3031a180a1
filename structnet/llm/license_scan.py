"""License scan: base phrases on words, and ordered signature rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from structnet.llm.common import WORD_BYTES, map_rows, texts

PHRASES = ((b"under the mit license".split(), "mit"), (b"apache license version 2".split(), "apache-2"), (b"cc by nc".split(), "cc-by-nc"))

#: Identifier, and the names that a notice calls the license by.
LICENSES = (
    ("0bsd", "zero[- ]clause bsd", "bsd zero clause"),
    ("afl-3.0", "academic free license"),
    ("agpl-3.0", "gnu affero general public license", "agpl"),
    ("apache-1.1", "apache software license,? version 1\\.1"),
    ("apache-2.0", "apache license,?(?: version)? 2(?:\\.0)?", "apache 2(?:\\.0)? license"),
    ("apsl-2.0", "apple public source license"),
    ("artistic-2.0", "artistic license"),
    ("bsd-2-clause", "bsd[- ]2[- ]clause", "simplified bsd", "two[- ]clause bsd"),
    ("bsd-3-clause", "bsd[- ]3[- ]clause", "new bsd", "modified bsd", "three[- ]clause bsd"),
    ("bsd-4-clause", "bsd[- ]4[- ]clause", "original bsd", "four[- ]clause bsd"),
    ("bsl-1.0", "boost software license"),
    ("busl-1.1", "business source license"),
    ("cc-by-4.0", "cc[- ]by(?![- ](?:nc|nd|sa))", "creative commons attribution(?![- ](?:non|no|share))"),
    ("cc-by-nc-4.0", "cc[- ]by[- ]nc(?![- ](?:nd|sa))", "creative commons attribution[- ]noncommercial(?![- ](?:no|share))"),
    ("cc-by-nc-nd-4.0", "cc[- ]by[- ]nc[- ]nd", "creative commons attribution[- ]noncommercial[- ]noderivatives"),
    ("cc-by-nc-sa-4.0", "cc[- ]by[- ]nc[- ]sa", "creative commons attribution[- ]noncommercial[- ]sharealike"),
    ("cc-by-nd-4.0", "cc[- ]by[- ]nd", "creative commons attribution[- ]noderivatives"),
    ("cc-by-sa-4.0", "cc[- ]by[- ]sa", "creative commons attribution[- ]sharealike"),
    ("cc0-1.0", "cc0", "creative commons zero"),
    ("cddl-1.0", "common development and distribution license"),
    ("cecill-2.1", "cecill"),
    ("cpal-1.0", "common public attribution license"),
    ("cpl-1.0", "common public license"),
    ("ecl-2.0", "educational community license"),
    ("epl-1.0", "eclipse public license,?(?: version| v)? ?1(?:\\.0)?"),
    ("epl-2.0", "eclipse public license(?!,?(?: version| v)? ?1)"),
    ("eupl-1.2", "european union public licen[cs]e"),
    ("gfdl-1.3", "gnu free documentation license"),
    ("gpl-2.0", "gnu general public license,?(?: version| v)? ?2", "gplv2", "gpl[- ]2"),
    ("gpl-3.0", "gnu general public license,?(?: version| v)? ?3", "gplv3", "gpl[- ]3"),
    ("gpl", "gnu general public license"),
    ("hpnd", "historical permission notice and disclaimer"),
    ("isc", "isc license"),
    ("lgpl-2.1", "gnu lesser general public license,?(?: version| v)? ?2", "gnu library general public license", "lgplv2"),
    ("lgpl-3.0", "gnu lesser general public license,?(?: version| v)? ?3", "lgplv3"),
    ("lgpl", "gnu lesser general public license"),
    ("lppl-1.3c", "latex project public license"),
    ("mit", "mit license", "expat license"),
    ("mit-0", "mit no attribution"),
    ("mpl-1.1", "mozilla public license,?(?: version| v)? ?1\\.1"),
    ("mpl-2.0", "mozilla public license(?!,?(?: version| v)? ?1)"),
    ("ms-pl", "microsoft public license"),
    ("ms-rl", "microsoft reciprocal license"),
    ("mulanpsl-2.0", "mulan permissive software license"),
    ("ncsa", "university of illinois/?ncsa open source license"),
    ("odbl-1.0", "open database license"),
    ("ofl-1.1", "sil open font license"),
    ("osl-3.0", "open software license"),
    ("postgresql", "postgresql licen[cs]e"),
    ("psf-2.0", "python software foundation license"),
    ("qpl-1.0", "q public license"),
    ("ruby", "ruby license"),
    ("sspl-1.0", "server side public license"),
    ("unlicense", "the unlicense"),
    ("upl-1.0", "universal permissive license"),
    ("vim", "vim license"),
    ("w3c", "w3c software notice and license"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("x11", "x11 license"),
    ("zlib", "zlib license", "zlib/libpng license"),
    ("zpl-2.1", "zope public license"),
)

#: How a name becomes rules: priority, weight, pattern. A higher priority wins.
TAG = (50, 0.99, r"spdx-license-identifier\s*:\s*\(?{id}\b")
NOTICES = (
    (40, 0.95, r"(?:licensed|released|distributed|published|available|made available|provided)\s+under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+)?{name}"),
    (35, 0.9, r"(?:subject\s+to|in\s+accordance\s+with|governed\s+by|pursuant\s+to|under)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{name}"),
    (30, 0.85, r"(?:see|read|copy\s+of)\s+(?:the\s+)?{name}"),
    (25, 0.8, r"licen[cs]es?\s*[:=]\s*[\"']?(?:the\s+)?{name}"),
    (10, 0.5, r"{name}"),
)
#: Identifiers after the first of an SPDX expression, and after a key that is called license; the span is that of the identifier.
LATER_TAG = (50, 0.99, r"spdx-license-identifier\s*:[ \t(]*(?:[\w.+-]+[ \t)]+(?:and|or|with)[ \t(]+)+(?P<id>{id}(?:-only|-or-later|\+)?)(?![\w+-])")
KEYED = (45, 0.9, r"\blicen[cs]es?[\"']?\s*[:=]\s*[\"']?(?P<id>{id}(?:-only|-or-later|\+)?)(?![\w+-])")
#: Short names with a version that stand for a license anywhere.
SHORT = (20, 0.6, (("mpl-1.1", r"mpl[- ]?v?1\.1"), ("mpl-2.0", r"mpl[- ]?v?2(?:\.0)?"), ("lgpl-2.1", r"lgpl[- ]?v?2(?:\.[01])?"), ("lgpl-3.0", r"lgpl[- ]?v?3(?:\.0)?"), ("agpl-3.0", r"agpl[- ]?v?3(?:\.0)?"),
                   ("epl-1.0", r"epl[- ]?v?1\.0"), ("epl-2.0", r"epl[- ]?v?2\.0"), ("cddl-1.0", r"cddl[- ]?v?1\.[01]"), ("eupl-1.2", r"eupl[- ]?v?1\.2"), ("apache-2.0", r"apache[- ]v?2\.0")))
#: Sentences of license bodies, by hand: label, weight, keyword, wording; between words there may be marks of comments.
WORDING = (
    ("mit", 0.85, "permission", "permission is hereby granted,? free of charge,? to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0.8, "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 0.5, "merchantability", "the software is provided [\"'`]*as is[\"'`]*,? without warranty of any kind,? express or implied,? including but not limited to the warranties of merchantability"),
    ("bsl-1.0", 0.9, "permission", "permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software"),
    ("bsd-2-clause", 0.8, "redistribution", "redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd-2-clause", 0.6, "redistributions", "redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice"),
    ("bsd-3-clause", 0.85, "endorse", "neither the names? of [^.;]{1,200} (?:nor the names of )?(?:its|their|any|the) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 0.9, "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("isc", 0.85, "permission", "permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted,? provided that the above copyright notice"),
    ("0bsd", 0.85, "permission", "permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted(?!,? provided)"),
    ("zlib", 0.8, "warranty", "this software is provided [\"'`]*as-is[\"'`]*,? without any express or implied warranty"),
    ("zlib", 0.85, "altered", "altered source versions must be plainly marked as such"),
    ("apache-2.0", 0.85, "perpetual", "grants to you a perpetual,? worldwide,? non-exclusive,? no-charge,? royalty-free,? irrevocable (?:\\(except as stated in this section\\) patent|copyright) license"),
    ("gpl", 0.8, "redistribute", "this program is free software[:;,] you can redistribute it and/or modify it"),
    ("lgpl", 0.8, "redistribute", "this library is free software[:;,] you can redistribute it and/or modify it"),
    ("unlicense", 0.9, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("ofl-1.1", 0.85, "permission", "permission is hereby granted,? free of charge,? to any person obtaining a copy of the font software"),
)
#: A text without any of these has no rule match: every name below has one of them, and so have tags. Words only, since names allow any white space between theirs.
GATES = ("licen", "spdx", "cc by", "cc-by", "cc0", "commons", "bsd", "gpl", "cecill", "attribution", "historical", "mpl", "epl", "cddl", "eupl", "apache", *sorted({w[2] for w in WORDING}))


class Rule(NamedTuple):
    order: int
    priority: int
    weight: float
    label: str
    keyword: str
    pattern: re.Pattern


def _spaced(name: str) -> str:
    """Spaces of a name as any white space, outside of classes."""
    return re.sub(r"(\[[^\]]*\])| ", lambda m: m[1] or r"\s+", name)


def _keyword(name: str) -> str:
    """The longest piece of plain letters that every match of the name has."""
    plain = re.sub(r"\(\?[:!].*?\)+\??|\[[^\]]*\]\??|\\.|.\?", "\0", name)
    return max(re.findall(r"[a-z0-9][a-z0-9 ]*", plain), key=len).strip().split(" ")[0]


def rules() -> list[Rule]:
    """Several hundred rules in order: by priority, then as the licenses stand."""
    out = []
    for label, *names in LICENSES:
        tag = re.escape(label)
        out += [(*TAG[:2], label, "spdx", TAG[2].format(id=tag)), (*LATER_TAG[:2], label, "spdx", LATER_TAG[2].format(id=tag)), (*KEYED[:2], label, "licen", KEYED[2].format(id=tag))]
        for name in names:
            out += [(priority, weight, label, _keyword(name), r"\b" + p.format(name=_spaced(name)) + r"\b") for priority, weight, p in NOTICES]
    out += [(SHORT[0], SHORT[1], label, label.split("-")[0], rf"\b{name}(?![\w])") for label, name in SHORT[2]]
    out += [(15, weight, label, keyword, r"\b" + _spaced(wording).replace(r"\s+", r"[\s*#/>;-]+")) for label, weight, keyword, wording in WORDING]
    out.sort(key=lambda r: -r[0])
    return [Rule(i, p, w, label, k, re.compile(pattern, re.IGNORECASE | re.ASCII)) for i, (p, w, label, k, pattern) in enumerate(out)]


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections left: one within the interval of another of no lower priority goes; of equal intervals the first rule stays."""
    reach: dict[int, int] = {}
    out = []
    for start, end, rule in sorted(found, key=lambda x: (x[0], -x[1], x[2].order)):
        if not any(priority >= rule.priority and far >= end for priority, far in reach.items()):
            out.append((start, end, rule))
            reach[rule.priority] = max(end, reach.get(rule.priority, 0))
    return out


class Scanner:
    def __init__(self) -> None:
        self.rules = rules()
        self.by_keyword: dict[str, list[Rule]] = {}
        for rule in self.rules:
            self.by_keyword.setdefault(rule.keyword, []).append(rule)

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) in code points."""
        low = text.lower()
        if not any(g in low for g in GATES):
            return []
        found = [(*m.span("id" if "id" in r.pattern.groupindex else 0), r) for k, group in self.by_keyword.items() if k in low for r in group for m in r.pattern.finditer(text)]
        return suppressed(found)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a base phrase."""
    out = []
    for phrase, label in PHRASES:
        at = -1
        try:
            while True:
                at = words.index(phrase[0], at + 1)
                if words[at:at + len(phrase)] == phrase:
                    out.append((at, label))
        except ValueError:
            pass
    return sorted(out)


def scan(text: str, scanner: Scanner) -> tuple:
    words = text.encode().translate(WORD_BYTES).split()
    base = phrase_places(words)
    rest = scanner.detections(text)
    starts, labels = [x[0] for x in base], sorted({x[1] for x in base})
    miss = 1.0
    for weight in [0.9] * bool(base) + [x[2].weight for x in rest]:
        miss *= 1 - weight
    every = sorted({*labels, *(x[2].label for x in rest)})
    spans = ",".join(f"{r.label}:{s}:{e}" for s, e, r in rest)
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(every), 1 - miss, spans


def find_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases are looked up on the words of the whole text, A-Z lower-cased. Signature rules run on the text if it
    holds their keyword; :func:`suppressed` resolves overlaps; ``spans`` are ``label:start:end`` in code points. ``score``
    is the chance that any detection is right, detections being independent; 0 without one. Null texts count as
    empty: no words, empty labels, null places. A null doc_id stays null; rows that repeat are scanned each; other
    columns are ignored; an empty table gives none.
    """

    def found(rows: Iterator[tuple]) -> Iterator[tuple]:
        scanner = Scanner()
        for doc_id, text in rows:
            yield doc_id, *scan(text, scanner)

    arrow = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])
    return map_rows(texts(docs), found, ["doc_id", "text"], "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string", arrow)
