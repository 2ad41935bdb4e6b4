"""Operator 6, license scans: ordered signature rules.

Rules are hand-written regular expressions over words, each with a label, a
keyword, a priority and a confidence. A text is cut into lower-cased words of
ASCII letters, digits and all characters beyond ASCII. A rule's pattern is only
tried around words that match its keyword, on the words joined by single spaces.
Overlapping detections are resolved in order: by priority, then the longer, then
the earlier; a detection contained in the interval of an accepted one is
suppressed. Base phrases are counted at all places and keep their labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.common import spread_text, table
from cairn.llm.kernels import ALNUM_WORDS, Prefix, Words, slices, text_buffer

REACH = 24
"""Words on either side of a keyword that its rules are tried on."""

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


VERSION = r"(?: (?:version|v|ver))? ?"


def spellings(rule: Rule) -> list[str]:
    """The words that can hold a rule's keyword in a match: itself, its plural, and
    itself with a version's first digit, if the pattern allows them."""
    out, glued = [rule.keyword], rule.pattern.find(rule.keyword + VERSION)
    if f"{rule.keyword}s?" in rule.pattern:
        out.append(f"{rule.keyword}s")
    if glued >= 0:
        digit = re.search("[0-9]", rule.pattern[glued + len(rule.keyword + VERSION):])
        out.append(rule.keyword + digit[0])
    return out


def _named() -> list[Rule]:
    """Rules for licenses by name: a grant, an SPDX tag, and a bare name."""
    version = VERSION
    names = [  # label, keyword, name, SPDX identifier as words
        ("apache-2.0", "apache", rf"apache (?:software )?licen[cs]e{version}(?:2(?: 0)?)?", "apache 2 0"),
        ("apache-1.1", "apache", rf"apache (?:software )?licen[cs]e{version}1 1", "apache 1 1"),
        ("mit", "mit", r"(?:the )?mit(?: x11)? licen[cs]e", "mit"),
        ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?", "mit 0"),
        ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "bsd 2 clause"),
        ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "bsd 3 clause"),
        ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", "bsd 4 clause"),
        ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", "bsd"),
        ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: licen[cs]e)?", "0bsd"),
        ("gpl-1.0", "gpl", rf"gpl{version}1(?: 0)?", "gpl 1 0"),
        ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{version}2(?: 0)?", "gpl 2 0"),
        ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{version}3(?: 0)?", "gpl 3 0"),
        ("gpl-2.0", "general", r"general public licen[cs]e (?:version|v) ?2(?: 0)?", "gpl 2 0 only"),
        ("gpl-3.0", "general", r"general public licen[cs]e (?:version|v) ?3(?: 0)?", "gpl 3 0 only"),
        ("lgpl-2.1", "general", r"(?:gnu )?(?:lesser|library) general public licen[cs]e (?:version|v) ?2(?: [01])?", "lgpl 2 1"),
        ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[cs]e (?:version|v) ?3(?: 0)?", "lgpl 3 0"),
        ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e", "lgpl"),
        ("lgpl-2.1", "lgpl", rf"lgpl{version}2(?: [01])?", "lgpl 2 1 only"),
        ("lgpl-3.0", "lgpl", rf"lgpl{version}3(?: 0)?", "lgpl 3 0 only"),
        ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[cs]e(?: (?:version|v) ?3(?: 0)?)?", "agpl 3 0"),
        ("agpl-3.0", "agpl", rf"agpl{version}3(?: 0)?", "agpl 3 0 only"),
        ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{version}(?:2(?: 0)?)", "mpl 2 0"),
        ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{version}1 1", "mpl 1 1"),
        ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{version}(?:2(?: 0)?)", "epl 2 0"),
        ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{version}1(?: 0)?", "epl 1 0"),
        ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e", "edl 1 0"),
        ("cddl-1.0", "distribution", rf"common development and distribution licen[cs]e(?:{version}1(?: 0)?)?", "cddl 1 0"),
        ("cpl-1.0", "common", r"common public licen[cs]e", "cpl 1 0"),
        ("isc", "isc", r"isc licen[cs]e", "isc"),
        ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
        ("libpng", "libpng", r"libpng licen[cs]e", "libpng"),
        ("boost-1.0", "boost", rf"boost software licen[cs]e{version}(?:1(?: 0)?)?", "bsl 1 0"),
        ("unlicense", "unlicense", r"the unlicense", "unlicense"),
        ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
        ("artistic-2.0", "artistic", rf"artistic licen[cs]e{version}2(?: 0)?", "artistic 2 0"),
        ("artistic-1.0", "artistic", r"artistic licen[cs]e", "artistic 1 0"),
        ("perl", "perl", r"same terms as perl(?: itself)?", "perl"),
        ("python-2.0", "python", r"python software foundation licen[cs]e", "python 2 0"),
        ("php-3.0", "php", r"php licen[cs]e", "php 3 0"),
        ("ruby", "ruby", r"ruby licen[cs]e", "ruby"),
        ("openssl", "openssl", r"openssl licen[cs]e", "openssl"),
        ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
        ("ofl-1.1", "font", rf"(?:sil )?open font licen[cs]e{version}(?:1 1)?", "ofl 1 1"),
        ("ubuntu-font-1.0", "font", r"ubuntu font licen[cs]e", "ubuntu font 1 0"),
        ("eupl-1.2", "european", r"european union public licen[cs]e", "eupl 1 2"),
        ("osl-3.0", "open", r"open software licen[cs]e", "osl 3 0"),
        ("afl-3.0", "academic", r"academic free licen[cs]e", "afl 3 0"),
        ("ms-pl", "microsoft", r"microsoft public licen[cs]e", "ms pl"),
        ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", "ms rl"),
        ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
        ("upl-1.0", "universal", r"universal permissive licen[cs]e", "upl 1 0"),
        ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[cs]e", "odbl 1 0"),
        ("odc-by", "commons", r"open data commons attribution licen[cs]e", "odc by 1 0"),
        ("pddl", "commons", r"open data commons public domain dedication(?: and licen[cs]e)?", "pddl 1 0"),
        ("cdla-permissive", "data", r"community data licen[cs]e agreement permissive", "cdla permissive 2 0"),
        ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", "gfdl 1 3"),
        ("hpnd", "historical", r"historical permission notice", "hpnd"),
        ("x11", "x11", r"x11 licen[cs]e", "x11"),
        ("curl", "curl", r"curl licen[cs]e", "curl"),
        ("tcl", "tcl", r"tcl(?: tk)? licen[cs]e", "tcl"),
        ("vim", "vim", r"vim licen[cs]e", "vim"),
        ("beerware", "beer", r"beer ware licen[cs]e", "beerware"),
        ("sspl-1.0", "server", r"server side public licen[cs]e", "sspl 1 0"),
        ("busl-1.1", "business", r"business source licen[cs]e", "busl 1 1"),
        ("elastic-2.0", "elastic", r"elastic licen[cs]e", "elastic 2 0"),
        ("commons-clause", "clause", r"commons clause(?: licen[cs]e)?", "commons clause"),
        ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[cs]e", "polyform noncommercial 1 0 0"),
        ("openrail", "rail", r"(?:creativeml )?open rail(?: m)?(?: licen[cs]e)?", "openrail"),
        ("bigscience-rail", "bigscience", r"bigscience (?:bloom )?rail licen[cs]e", "bigscience rail 1 0"),
        ("llama-community", "community", r"community licen[cs]e agreement", "llama community"),
    ]
    out = []
    for label, keyword, name, tag in names:
        out += [Rule(label, keyword, rf"(?:licensed|released|distributed|available|provided|published) (?:\w+ )?under (?:the )?"
                                     rf"(?:terms of (?:the )?)?{name}", 30, 0.98),
                Rule(label, keyword, name, 20, 0.85),
                Rule(label, "spdx", rf"spdx license identifier {tag}\b", 40, 1.0)]
    return out


def _creative_commons() -> list[Rule]:
    out = []
    parts = [("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
             ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
             ("by-nc", "by nc", "attribution non ?commercial"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
             ("by-sa", "by sa", "attribution share ?alike"), ("by", "by", "attribution")]
    for k, (label, short, words) in enumerate(parts):
        for number in ("4 0", "3 0", "2 5", "2 0", "1 0"):
            out.append(Rule(f"cc-{label}-{number.replace(' ', '.')}", "cc", rf"cc {short} {number}", 36 - k, 0.99))
            out.append(Rule(f"cc-{label}-{number.replace(' ', '.')}", "creative",
                            rf"creative commons {words}(?: (?:\w+ )?(?:public )?licen[cs]e)? {number}", 36 - k, 0.99))
        out.append(Rule(f"cc-{label}", "cc", rf"cc {short}", 26 - k, 0.9))
        out.append(Rule(f"cc-{label}", "creative", rf"creative commons {words}", 26 - k, 0.9))
        out.append(Rule(f"cc-{label}", "creativecommons", rf"creativecommons org licenses {short}", 38 - k, 1.0))
    out += [Rule("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 30, 0.98),
            Rule("cc0", "creativecommons", r"creativecommons org publicdomain zero", 38, 1.0),
            Rule("cc", "creative", r"creative commons licen[cs]e", 10, 0.7)]
    return out


def _statements() -> list[Rule]:
    return [Rule(*x) for x in [
        ("reserved", "reserved", r"all rights reserved", 12, 0.8),
        ("reserved", "reserved", r"some rights reserved", 12, 0.6),
        ("copyright", "copyright", r"copyright (?:c |by )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", 8, 0.5),
        ("copyright", "copyrighted", r"copyrighted (?:material|work)", 8, 0.5),
        ("proprietary", "proprietary", r"proprietary and confidential", 18, 0.9),
        ("proprietary", "confidential", r"strictly confidential", 14, 0.6),
        ("proprietary", "permission", r"without (?:the )?(?:prior )?(?:express )?written permission", 14, 0.7),
        ("proprietary", "redistribute", r"(?:may|do) not (?:copy or )?redistribute", 14, 0.7),
        ("non-commercial", "commercial", r"(?:for )?non commercial use only", 16, 0.8),
        ("non-commercial", "noncommercial", r"(?:for )?noncommercial use only", 16, 0.8),
        ("no-training", "used", r"not be used (?:for|in) (?:ai|machine learning|model)? ?training", 22, 0.95),
        ("no-training", "mining", r"text and data mining (?:is )?(?:not permitted|reserved|prohibited)", 22, 0.95),
        ("public-domain", "domain", r"(?:released|dedicated) (?:in|to|into) the public domain", 24, 0.95),
        ("public-domain", "domain", r"public domain", 9, 0.6),
        ("mit", "hereby", r"permission is hereby granted free of charge to any person", 32, 0.99),
        ("mit", "merchantability", r"warranties of merchantability fitness for a particular purpose and noninfringement", 28, 0.9),
        ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification", 28, 0.95),
        ("bsd-3-clause", "endorse", r"endorse or promote products derived from this software", 32, 0.97),
        ("bsd-4-clause", "advertising", r"all advertising materials mentioning features", 34, 0.98),
        ("gpl", "gnu", r"gnu general public licen[cs]e", 15, 0.9),
        ("gpl", "general", r"general public licen[cs]e", 13, 0.85),
        ("gpl-or-later", "later", r"(?:either )?version \d(?: \d)? (?:of the license )?or at your option any later version", 33, 0.98),
        ("gpl", "copyleft", r"copyleft", 7, 0.5),
        ("zlib", "origin", r"the origin of this software must not be misrepresented", 32, 0.99),
        ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 31, 0.97),
        ("apache-2.0", "licenses", r"www apache org licenses license 2 0", 38, 1.0),
        ("mit", "opensource", r"opensource org licenses mit", 38, 1.0),
        ("see-license", "license", r"see (?:the )?license (?:file )?for (?:more )?(?:details|information)", 6, 0.4),
        ("see-license", "license", r"license (?:txt|md) file", 6, 0.4),
        ("eula", "agreement", r"end user licen[cs]e agreement", 17, 0.85),
        ("terms", "terms", r"subject to (?:the )?terms (?:and conditions|of use|of service)", 5, 0.4),
        ("trademark", "trademark", r"registered trademarks? of", 4, 0.3),
        ("fair-use", "fair", r"fair use", 3, 0.3),
        ("crown", "crown", r"crown copyright", 16, 0.8),
        ("ogl", "government", r"open government licen[cs]e", 22, 0.9),
    ]]


RULES = _named() + _creative_commons() + _statements()
_BY_KEYWORD: dict[str, list[int]] = {}
for _i, _r in enumerate(RULES):
    for _word in spellings(_r):
        _BY_KEYWORD.setdefault(_word, []).append(_i)
_COMPILED = [re.compile(rf"(?<!\S){r.pattern}(?!\S)") for r in RULES]


def hash_words(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) + 1 for x in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    return Prefix(raw, True).of(starts, ends)


_KEYWORDS = sorted(_BY_KEYWORD)
_KEY_HASH = hash_words(_KEYWORDS)
_KEY_ORDER = np.argsort(_KEY_HASH)
_KEY_SORTED = _KEY_HASH[_KEY_ORDER]
_PHRASES = [(hash_words(p.split()), label) for p, label in BASE.items()]
_BITS = np.zeros(1 << 16, bool)
for _h in [_KEY_HASH, *[h[:1] for h, _ in _PHRASES]]:
    _BITS[(_h >> np.uint64(48)).astype(np.int64)] = True


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Detections (first word, end, rule) that no accepted one contains, in
    order of priority, length, place and rule."""
    found = sorted(set(found), key=lambda x: (-RULES[x[2]].priority, x[0] - x[1], x[0], x[2]))
    taken: list[tuple[int, int, int]] = []
    reach = 0
    index: dict[int, list[tuple[int, int]]] = {}
    for a, b, r in found:
        near = (iv for k in range((a - reach) // REACH, a // REACH + 1) for iv in index.get(k, ()))
        if any(x <= a and b <= y for x, y in near):
            continue
        taken.append((a, b, r))
        index.setdefault(a // REACH, []).append((a, b))
        reach = max(reach, b - a)
    return sorted(taken)


def scan(data: np.ndarray, offs: np.ndarray):
    """Per row of a slice: (words, base places, first, last, base labels, labels,
    score, detections)."""
    rows = len(offs) - 1
    w = Words(data, offs, lower=True, table=ALNUM_WORDS)
    n_base, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
    base: list[set] = [set() for _ in range(rows)]
    maybe = np.flatnonzero(_BITS[(w.hash >> np.uint64(48)).astype(np.int64)])
    for phrase, label in _PHRASES:
        at = maybe[w.hash[maybe] == phrase[0]]
        at = at[at + len(phrase) <= len(w.hash)]
        for k in range(1, len(phrase)):
            at = at[(w.hash[at + k] == phrase[k]) & (w.doc[at + k] == w.doc[at])]
        doc = w.doc[at]
        place = at - w.first[doc]
        n_base += np.bincount(doc, minlength=rows)
        for d, p in zip(doc.tolist(), place.tolist()):
            first[d] = p if first[d] < 0 else min(first[d], p)
            last[d] = max(last[d], p)
            base[d].add(label)
    key = np.minimum(np.searchsorted(_KEY_SORTED, w.hash[maybe]), len(_KEY_SORTED) - 1)
    hit = _KEY_SORTED[key] == w.hash[maybe]
    at, key = maybe[hit], _KEY_ORDER[key[hit]]
    found: list[list] = [[] for _ in range(rows)]
    raw = data.tobytes()
    for d in np.unique(w.doc[at]).tolist():
        mine = w.doc[at] == d
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        for k in np.unique(key[mine]).tolist():
            end = lo
            spots = at[mine & (key == k)]
            windows: list[list[int]] = []  # stretches around the keyword, merged
            for p in spots.tolist():
                a, b = max(lo, p - REACH), min(hi, p + REACH + 1)
                if windows and a <= end:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
                end = b
            for a, b in windows:
                words = [raw[w.start[i]:w.end[i]].decode("utf-8", "replace").lower() if raw[w.start[i]:w.end[i]].isascii()
                         else raw[w.start[i]:w.end[i]].decode("utf-8", "replace") for i in range(a, b)]
                text = " ".join(words)
                place = np.cumsum([0] + [len(x) + 1 for x in words])
                for r in _BY_KEYWORD[_KEYWORDS[k]]:
                    for m in _COMPILED[r].finditer(text):
                        x = int(np.searchsorted(place, m.start()))
                        y = int(np.searchsorted(place, m.end()))
                        found[d].append((a - lo + x, a - lo + y, r))
    out = []
    for d in range(rows):
        kept = resolve(found[d]) if found[d] else []
        labels = base[d] | {RULES[r].label for _, _, r in kept}
        score = max([RULES[r].confidence for _, _, r in kept] + [0.5 if base[d] else 0.0])
        out.append((int(w.count[d]), int(n_base[d]), int(first[d]) if first[d] >= 0 else None, int(last[d]) if last[d] >= 0 else None,
                    ",".join(sorted(base[d])), ",".join(sorted(labels)), float(score),
                    [{"label": RULES[r].label, "from_word": a, "to_word": b, "confidence": RULES[r].confidence} for a, b, r in kept]))
    return out


OUT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
       "detections array<struct<label:string,from_word:long,to_word:long,confidence:double>>")
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
    [("label", pa.string()), ("from_word", pa.int64()), ("to_word", pa.int64()), ("confidence", pa.float64())]))]
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]


def _scan_task(batches):
    for b in batches:
        data, offs = text_buffer(b.column("text"))
        for lo, hi in slices(offs):
            cols = list(zip(*scan(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *[pa.array(c, k) for c, k in zip(cols, _KINDS)]],
                                             names=_NAMES)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Rows, one per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (the best confidence), detections.

    Null and empty texts have no words, no labels and score 0. Repeated rows are
    scanned each; a null doc_id is kept. An empty table gives no rows. Only doc_id
    and text are read.
    """
    return spread_text(docs.select("doc_id", "text")).mapInArrow(_scan_task, OUT)


def q_op6(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
