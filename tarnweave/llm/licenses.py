"""License scan: Aho-Corasick finds SPDX tags and notice phrases, a shunting-yard parser evaluates expressions.

A text is normalised once: a line break with the comment leaders after it, and any run of white space, count as
one space. The automaton finds tags and the phrases that notices are known by; what a phrase leaves open, the
version, "or later", the variant, is read from the text after it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, pick, plain, spread

#: (licence or None, end of the notice) from the lower-case text and the end of the phrase.
Reader = Callable[[str, int], "tuple[str | None, int]"]
_VERSION = re.compile(r"[,:;]? ?\(?(?:[a-z]*gpl ?)?\)?[,:;]?(?: ?\"[a-z]+\")?(?: as published by the free software foundation[,;:]?)?(?: either)?(?: -)? ?\(?(?:version|ver\.?|v\.?)? ?-?(\d+(?:\.\d+)*)\)?")
_LATER = re.compile(r"\+|-or-later|,?(?: of the license)?,? \(?(?:or|and)(?: \(?at your option\)?,?)? (?:any )?(?:later|newer|above|higher|greater)(?: versions?)?|,? \(?or \(at your option\) any later version")
_CC = re.compile(r"(?:(?:[ -]+|, ?)(?:non-?commercial|nc|share-?alike|share alike|sa|no-?deriv(?:ative)?s?|no derivatives?|nd))*")
_CC_PART = re.compile(r"non-?commercial|nc|share-?alike|share alike|sa|no-?deriv(?:ative)?s?|no derivatives?|nd")
_CC_VERSION = re.compile(r"(?: international| unported| generic)?(?: (?:public )?license)?[,-]? ?\(?(?:version |v\.? ?)?(\d\.\d)\)?")


def _fixed(name: str) -> Reader:
    return lambda low, end: (name, end)


def _gnu(name: str, first: str | None, known: dict[str, str]) -> Reader:
    """A GNU licence: -only or -or-later as the text says; without a version any that was published may be chosen, from `first` on (None: no notice)."""

    def read(low: str, end: int) -> tuple[str | None, int]:
        m = _VERSION.match(low, end)
        version = m and known.get(m[1])
        if not version:
            return (f"{name}-{first}-or-later", end) if first else (None, end)
        later = _LATER.match(low, m.end())
        return f"{name}-{version}-{'or-later' if later else 'only'}", (later or m).end()

    return read


def _versioned(name: str, known: dict[str, str], default: str | None) -> Reader:
    def read(low: str, end: int) -> tuple[str | None, int]:
        m = _VERSION.match(low, end)
        version = m and known.get(m[1])
        if version:
            return f"{name}-{version}", m.end()
        return (f"{name}-{default}" if default else None), end

    return read


def _creative(low: str, end: int) -> tuple[str | None, int]:
    """CC-BY and its variants; 4.0 where no version is named."""
    m = _CC.match(low, end)
    parts = {p.replace("-", "").replace(" ", "")[:2] for p in _CC_PART.findall(m[0])}
    kind = "".join(x for x, k in (("-NC", {"nc", "no"}), ("-SA", {"sa", "sh"}), ("-ND", {"nd"})) if k & parts)
    if any(p.startswith("no") and "com" not in p for p in _CC_PART.findall(m[0])):
        kind = kind.replace("-NC", "-NC-ND") if re.search("nc|non-?com", m[0]) else kind.replace("-NC", "-ND")
    v = _CC_VERSION.match(low, m.end())
    return f"CC-BY{kind}-{v[1] if v else '4.0'}", (v or m).end()


def _bsd(low: str, end: int) -> tuple[str | None, int]:
    """The clauses of this notice, which its disclaimer ends, tell the variant."""
    over = low.find("such damage", end)
    after = low.find("redistribution and use in source", end)
    stop = min(x for x in (over if over >= 0 else len(low), after if after >= 0 else len(low)))
    if low.find("all advertising materials", end, stop) >= 0:
        return "BSD-4-Clause", end
    third = any(low.find(p, end, stop) >= 0 for p in ("neither the name", "the names of its contributors may not", "may not be used to endorse"))
    return "BSD-3-Clause" if third else "BSD-2-Clause", end


_GPL = {"1": "1.0", "1.0": "1.0", "2": "2.0", "2.0": "2.0", "3": "3.0", "3.0": "3.0"}
_LGPL = {"2": "2.0", "2.0": "2.0", "2.1": "2.1", "3": "3.0", "3.0": "3.0"}
_AGPL = {"1": "1.0", "1.0": "1.0", "3": "3.0", "3.0": "3.0"}
_FDL = {"1.1": "1.1", "1.2": "1.2", "1.3": "1.3"}
RESERVED = "LicenseRef-proprietary"
#: Notice phrase (lower case, single spaces, "license") -> what it says. The longest phrase at a place holds.
PHRASES: dict[str, Reader] = {
    **{p: _fixed("MIT") for p in ("mit license", "mit-license", "expat license", "permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby granted, free of charge")},
    **{p: _versioned("Apache", {"1.0": "1.0", "1.1": "1.1", "2": "2.0", "2.0": "2.0"}, "2.0") for p in ("apache license", "apache software license", "apache public license")},
    "apache-2.0": _fixed("Apache-2.0"),
    **{p: _gnu("GPL", "1.0", _GPL) for p in ("gnu general public license", "gnu gpl", "general public license", "under the gpl", "under gpl")},
    **{p: _gnu("LGPL", "2.1", _LGPL) for p in ("gnu lesser general public license", "lesser general public license", "gnu lgpl", "under the lgpl", "under lgpl")},
    **{p: _gnu("LGPL", "2.0", _LGPL) for p in ("gnu library general public license", "library general public license")},
    **{p: _gnu("AGPL", "3.0", _AGPL) for p in ("gnu affero general public license", "affero general public license", "gnu agpl", "under the agpl", "under agpl")},
    **{p: _gnu("GFDL", "1.1", _FDL) for p in ("gnu free documentation license",)},
    **{p: _gnu("GPL", None, _GPL) for p in ("gpl", "gplv", "gpl-")},
    **{p: _gnu("LGPL", None, _LGPL) for p in ("lgpl", "lgplv", "lgpl-")},
    **{p: _gnu("AGPL", None, _AGPL) for p in ("agpl", "agplv", "agpl-")},
    "mozilla public license": _versioned("MPL", {"1": "1.0", "1.0": "1.0", "1.1": "1.1", "2": "2.0", "2.0": "2.0"}, "2.0"),
    "eclipse public license": _versioned("EPL", {"1": "1.0", "1.0": "1.0", "2": "2.0", "2.0": "2.0"}, "2.0"),
    "common development and distribution license": _versioned("CDDL", {"1": "1.0", "1.0": "1.0", "1.1": "1.1"}, "1.0"),
    "european union public license": _versioned("EUPL", {"1.0": "1.0", "1.1": "1.1", "1.2": "1.2"}, "1.2"),
    "artistic license": _versioned("Artistic", {"1": "1.0", "1.0": "1.0", "2": "2.0", "2.0": "2.0"}, "1.0"),
    "academic free license": _versioned("AFL", {"2.1": "2.1", "3": "3.0", "3.0": "3.0"}, "3.0"),
    "boost software license": _fixed("BSL-1.0"),
    "microsoft public license": _fixed("MS-PL"),
    "server side public license": _fixed("SSPL-1.0"),
    "business source license": _fixed("BUSL-1.1"),
    "elastic license": _fixed("Elastic-2.0"),
    "sil open font license": _fixed("OFL-1.1"),
    "python software foundation license": _fixed("PSF-2.0"),
    "zlib license": _fixed("Zlib"),
    "zlib/libpng license": _fixed("Zlib"),
    **{f"this software is provided {q}as-is{q}, without any express or implied warranty": _fixed("Zlib") for q in ("'", '"')},
    **{p: _fixed("BSD-2-Clause") for p in ("bsd 2-clause", "bsd-2-clause", "2-clause bsd", "simplified bsd", "freebsd license", "bsd two-clause", "two-clause bsd")},
    **{p: _fixed("BSD-3-Clause") for p in ("bsd 3-clause", "bsd-3-clause", "3-clause bsd", "new bsd license", "modified bsd license", "revised bsd license", "bsd three-clause", "three-clause bsd")},
    **{p: _fixed("BSD-4-Clause") for p in ("bsd 4-clause", "bsd-4-clause", "4-clause bsd", "original bsd license")},
    "redistribution and use in source and binary forms": _bsd,
    **{p: _fixed("ISC") for p in ("isc license", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted")},
    **{p: _fixed("Unlicense") for p in ("the unlicense", "this is free and unencumbered software released into the public domain")},
    **{p: _fixed("CC0-1.0") for p in ("cc0 1.0", "cc0-1.0", "cc0 license", "creative commons zero", "cc0 public domain dedication")},
    **{p: _creative for p in ("cc by", "cc-by", "creative commons attribution")},
    **{p: _fixed("WTFPL") for p in ("wtfpl", "do what the fuck you want to public license")},
    "all rights reserved": _fixed(RESERVED),
}
#: Phrases whose last letter may stand before another: a version follows.
OPEN = ("v", "-")
#: A text without any of these has neither tag nor notice. Every phrase holds one of them.
HINT = re.compile(r"(?i)licen[cs]e|spdx|gpl|wtfpl|bsd|cc0|cc[ -]|creative|apache-|hereby granted|redistribution|as-is|as[\x{2010}-\x{2015}]is|unencumbered|reserved".replace(r"\x{2010}", "\u2010").replace(r"\x{2015}", "\u2015"))
TAG = "spdx-license-identifier:"
ALLOWED = frozenset({"MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "0BSD", "CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "Zlib", "BSL-1.0", "Python-2.0", "PSF-2.0"})
#: Exceptions that make an otherwise refused licence acceptable, as (licence, exception).
EXCEPTIONS = frozenset({("GPL-2.0-only", "Classpath-exception-2.0"), ("GPL-2.0-or-later", "Classpath-exception-2.0"), ("GPL-3.0-only", "GCC-exception-3.1"), ("GPL-3.0-or-later", "GCC-exception-3.1")})
_TOKEN = re.compile(r"\(|\)|/|[A-Za-z0-9.+:\-]+")
PREC = {"or": 1, "/": 1, "and": 2, "with": 3}


def parse(expression: str) -> list[str] | None:
    """Postfix form (shunting yard; WITH binds tightest, then AND, then OR and its old form "/"; all left to right); None if malformed."""
    out: list[str] = []
    ops: list[str] = []
    want = True  # an operand or "(" comes next
    for tok in _TOKEN.findall(expression):
        low = tok.lower()
        if low in PREC:
            if want:
                return None
            while ops and ops[-1] != "(" and PREC[ops[-1]] >= PREC[low]:
                out.append(ops.pop())
            ops.append("or" if low == "/" else low)
            want = True
        elif tok == "(":
            if not want:
                return None
            ops.append(tok)
        elif tok == ")":
            if want:
                return None
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        else:
            if not want:
                return None
            out.append(tok)
            want = False
    if want:
        return None
    while ops:
        if ops[-1] == "(":
            return None
        out.append(ops.pop())
    return out


def evaluate(postfix: list[str], allowed: frozenset = ALLOWED, exceptions: frozenset = EXCEPTIONS) -> bool | None:
    """Whether the expression permits use: OR needs one side, AND both, WITH a listed pair or an allowed licence; a final "+" (or later) asks for the licence before it. None if malformed."""
    names = {a.lower(): a for a in allowed}
    pairs = {(a.lower(), b.lower()) for a, b in exceptions}
    stack: list[tuple[bool, str | None]] = []
    for tok in postfix:
        if tok in PREC:
            (rv, rn), (lv, ln) = stack.pop(), stack.pop()
            if tok == "with":
                if ln is None or rn is None:
                    return None
                stack.append((lv or (ln.lower(), rn.lower()) in pairs, None))
            else:
                stack.append(((lv and rv) if tok == "and" else (lv or rv), None))
        else:
            stack.append((tok.lower() in names or tok.rstrip("+").lower() in names, tok))
    return stack[0][0]


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in PHRASES:
        a.add_word(phrase, phrase)
    a.add_word(TAG, TAG)
    a.make_automaton()
    return a


_LEADER = r"(?://+!?|/\*+(?!/)|#+|\*+(?!/)|;+|--+(?!>)|%+|!+|>+|\|+|\"+(?=[ \t])|'+(?=[ \t])|(?:dnl|rem|REM)\b)"
_SPACE = re.compile(rf"[^\S\n\r]*[\n\r]\s*(?:{_LEADER}\s*)*|[^\S\n\r]{{2,}}|[^\S \n\r]")
_SAME = str.maketrans({"\n": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-"})


def normal(text: str) -> tuple[str, str]:
    """(text where a line break with comment leaders after it is one line feed and other white space one space, the same in lower case with spaces alone, straight quotes and "license")."""
    flat = _SPACE.sub(lambda m: "\n" if "\n" in m[0] or "\r" in m[0] else " ", text)
    low = flat.lower()
    if len(low) != len(flat):  # a few letters change length in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in flat)
    return flat, low.translate(_SAME).replace("licence", "license")


def _tag_text(flat: str, begin: int, stop: int) -> tuple[str, int]:
    """(expression, end) after a tag; it ends with the line or where operands no longer alternate with operators. "/" is written OR."""
    end, want, depth, parts = begin, True, 0, []
    for m in _TOKEN.finditer(flat, begin, stop):
        tok = m[0].lower()
        if flat[end : m.start()].strip():
            break
        if tok in PREC:
            if want:
                break
            want = True
        elif tok == "(":
            if not want:
                break
            depth += 1
        elif tok == ")":
            if want or not depth:
                break
            depth -= 1
        elif not want:
            break
        else:
            want = False
        parts.append((flat[end : m.start()] if parts else "", m[0]))
        end = m.end()
    while parts and parts[-1][1] == "/":
        parts.pop()
    text = "".join(" OR " if t == "/" else ("" if i and parts[i - 1][1] == "/" else gap) + t for i, (gap, t) in enumerate(parts))
    return text.rstrip(".,;:- ").strip(), end


def scan(text: str | None) -> tuple[list[str], list[str], str | None, bool | None]:
    """(SPDX expressions, licences of notices, joint expression, permitted) of one text.

    Licences in order of first mention, once each. "All rights reserved" counts (as LicenseRef-proprietary) only
    where nothing else grants a right. The joint expression ANDs them all; permitted is None where nothing was
    found, and false where a tag's expression is malformed.
    """
    if not text:
        return [], [], None, None
    flat, low = normal(text)
    hits = []
    for end, phrase in automaton().iter(low):
        begin, end = end + 1 - len(phrase), end + 1
        if begin and low[begin - 1].isalnum() or end < len(low) and low[end].isalnum() and phrase != TAG and not phrase.endswith(OPEN):
            continue
        hits.append((begin, end, phrase))
    hits.sort(key=lambda h: (h[0], -h[1]))
    tags, notices, reach, line = {}, {}, 0, -1
    for begin, end, phrase in hits:
        if begin < reach:
            continue
        if phrase == TAG:
            if line < end:
                line = flat.find("\n", end)
                line = len(flat) if line < 0 else line
            expr, reach = _tag_text(flat, end, line)
            tags[expr] = None
        else:
            name, stop = PHRASES[phrase](low, end)
            if name:
                reach = stop
                notices[name] = None
    if RESERVED in notices and (tags or len(notices) > 1):
        del notices[RESERVED]
    tags, notices = list(tags), list(notices)
    if not tags and not notices:
        return [], [], None, None
    both = [*tags, *notices]
    joint = " AND ".join(f"({t})" if " " in t and len(both) > 1 else t for t in both)
    if any(parse(t) is None for t in tags):
        return tags, notices, joint, False
    return tags, notices, joint, bool(evaluate(parse(joint)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, tags, notices (arrays), expression, permitted.

    Null, empty and unlicensed texts have empty arrays, a null expression and null permitted. Repeated
    rows give repeated results, null ids stay, other columns are ignored, an empty table gives no rows. No shuffle;
    whole texts and whole expressions, however long.
    """
    schema = T.StructType([T.StructField("doc_id", pick(docs, doc_id=id_col).schema["doc_id"].dataType), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("notices", T.ArrayType(T.StringType())), T.StructField("expression", T.StringType()), T.StructField("permitted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = plain(batch.column(1))
            for i, j in chunks(texts):
                part = texts.slice(i, j - i)
                rows = [([], [], None, None)] * len(part)
                for k in np.flatnonzero(pc.match_substring_regex(part, HINT.pattern)):
                    rows[k] = scan(part[int(k)].as_py())
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())], schema.names
                )

    return spread(pick(docs, doc_id=id_col, text=text_col)).mapInArrow(run, schema)
